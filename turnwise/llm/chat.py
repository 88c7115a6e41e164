"""Chat logs folded into final messages and rendered as marked text, with DataFrame functions only.

A log row is an event: (conv_id, seq, message, role, kind, text).  Kinds: ``delta`` appends text to
its message, ``edit`` replaces what the message said, ``regenerate`` empties it for new deltas,
``delete`` removes it.  Events of a conversation are ordered by ``seq``; a message stands where its
first event stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, SPLIT, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates give a meaning; inside texts and roles they are escaped.
CONTROL = (BEGIN, SPLIT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
RESETS = ("edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """A backslash inside every control string and before every backslash.

    The result holds no control string, and ``unescape`` restores the text exactly.
    """
    found = r"(?<=<)(?=\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(?<=\[)(?=INST\]|/INST\])"
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), found, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, place, role, text), one exchange by conversation.

    Events without a known kind count as ``delta``; a null text is empty.  An event without a
    ``message`` is a message of its own.  A message takes the first role that its events name, else
    the empty role.  Events of equal ``seq`` are ordered by kind, role and text, and repeated rows
    act once each.  A message that ends deleted is gone.  Events without ``conv_id`` form one
    conversation.
    """
    order = ["seq", "kind", "role", "text"]
    kept = events.select(
        "conv_id", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role",
        F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    numbered = kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    key = F.when(F.col("message").isNull(), F.col("place")).alias("own")
    messages = numbered.groupBy("conv_id", "message", key).agg(
        F.array_sort(F.collect_list(F.struct("place", "kind", "role", "text"))).alias("events"))
    resets = F.transform("events", lambda e, i: F.when(e["kind"].isin(*RESETS), i))
    live = F.expr("slice(events, reset + 1, size(events))")
    said = F.transform(live, lambda e: F.when(e["kind"].isin("regenerate", "delete"), F.lit("")).otherwise(e["text"]))
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return (messages.withColumn("reset", F.coalesce(F.array_max(resets), F.lit(0)))
            .where("element_at(events, -1).kind <> 'delete'")
            .select("conv_id", F.col("events")[0]["place"].alias("place"),
                    F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), F.array_join(said, "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """One marked text per conversation: (conv_id, formatted)."""
    turn = F.struct("place", F.concat(
        F.lit(BEGIN), escape(F.col("role")), F.lit(SPLIT), escape(F.col("text")), F.lit(END)).alias("marked"))
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["marked"]), "").alias("formatted"))


def parse(rendered: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``turns`` (role and text, unescaped) and ``mask`` read back from ``formatted``.

    The mask holds the places of the trained role's texts in ``formatted``: code points, end
    exclusive, escapes included.
    """
    cut = rendered.withColumn("marked", F.split("formatted", f"(?<=\\Q{END}\\E)(?!$)"))
    pairs = cut.withColumn("pairs", F.transform(
        F.filter("marked", lambda t: t != ""), lambda t: F.struct(
            F.substring_index(t, SPLIT, 1).alias("head"),
            F.substring_index(F.substring_index(t, SPLIT, -1), END, 1).alias("body"))))
    turns = F.transform("pairs", lambda p: F.struct(
        unescape(F.substr(p["head"], F.lit(len(BEGIN) + 1))).alias("role"), unescape(p["body"]).alias("text")))
    places = F.aggregate(
        "pairs", F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("starts")),
        lambda state, p: F.struct(
            (state["at"] + F.length(p["head"]) + F.length(p["body"]) + len(SPLIT + END)).alias("at"),
            F.concat(state["starts"], F.array(state["at"] + F.length(p["head"]) + len(SPLIT))).alias("starts")),
        lambda state: state["starts"])
    mask = F.filter(F.zip_with("pairs", "starts", lambda p, start: F.when(
        p["head"] == BEGIN + trained_role, F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end")))),
        lambda m: m.isNotNull())
    return (pairs.withColumn("turns", turns).withColumn("starts", places).withColumn("mask", mask)
            .drop("marked", "pairs", "starts"))


def digests(parsed: DataFrame) -> DataFrame:
    """Per conversation: what its formatted text says and what the mask covers."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    covered = F.array_join(F.transform("mask", lambda m: unescape(
        F.substr("formatted", m["start"] + 1, m["end"] - m["start"]))), "")
    return parsed.withColumn("loss", covered).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def turn_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: each row is one whole message."""
    return conversations.selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS seq", "CAST(NULL AS BIGINT) AS message",
        "CAST(role AS STRING) AS role", "'delta' AS kind", "CAST(text AS STRING) AS text")
