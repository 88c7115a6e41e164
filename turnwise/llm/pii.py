"""Personal data in texts, found with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for bank accounts,
number ranges for addresses, digit counts for telephones), and words near a span adjust its score.
Spans are in code points with exclusive ends.  Every pattern is possessive and starts only where a
run starts or the last match ended, so a text is read in linear time however long a run is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name

#: The kinds of the contract in its order, then those this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Texts without this cannot hold a valid span of the kind; it saves the search for positions.
HINT = {
    "email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": "[+][0-9]", "iban": r"[A-Z][A-Z][0-9][0-9]", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|correo|courriel", "ip": r"\bip\b|server|host|address|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta", "ssn": "ssn|social|security|insurance",
}
CONTEXT_CHARS, CONTEXT_SCORE, LEAST_SCORE = 40, 0.4, 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    doubled = F.translate(digits, "0123456789", "0246813579")
    places = F.sequence(F.lit(1), F.length(digits))
    values = F.transform(places, lambda i: F.substr(
        F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(digits), i, F.lit(1)).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number leaves 1 modulo 97 (first four places last, letters from 10)."""
    compact = F.replace(account, F.lit(" "))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, "(?!$)"), F.lit(0), lambda a, c: F.when(
        F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return mod97(match) if kind == "iban" else F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind: the gaps before matches give their places."""
    pattern = F.lit(f"(?s)\\G(.*?)({PATTERN[kind]})")
    pairs = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda gap, match: F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size"),
                                    _valid(kind, match).alias("valid")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.from_json(F.lit("[]"), SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + pair["size"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), _score(kind, text, start, end).alias("score"))
        return F.struct(end.alias("at"), F.when(pair["valid"], F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(pairs, empty, step, lambda state: state["spans"])
    return F.when(text.rlike(HINT[kind]), spans).otherwise(F.from_json(F.lit("[]"), SPAN))


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    """The kind's own score, raised where one of its context words stands near."""
    low = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    near = F.concat(F.substr(text, (low + 1).cast("int"), (start - low).cast("int")), F.lit(" "),
                    F.substr(text, (end + 1).cast("int"), F.lit(CONTEXT_CHARS)))
    return F.lit(SCORE[kind]) + F.when(F.lower(near).rlike(CONTEXT[kind]), CONTEXT_SCORE * (1 - SCORE[kind])).otherwise(0.0)


def find_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """``docs`` with the array of spans of ``text``, by kind, then start.

    A null or empty text has no spans.  Added kinds need a score of ``LEAST_SCORE``; the kinds of
    the contract stay whatever their score.  A column of the same name is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [_found(kind, text) for kind in BASE]
    parts += [F.filter(_found(kind, text), lambda s: s["score"] >= LEAST_SCORE) for kind in ADDED]
    return docs.withColumn(name, F.concat(*parts))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts by kind, the digest of the contract's spans and all spans."""
    found = find_spans(docs.select("doc_id", "text"), "found").select("doc_id", "found")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, named by the first.  Texts without spans, null texts and
    all other columns stay as they are, whatever their names; ``n_chars`` follows the text where the
    table has it.  Repeated rows are treated alike.
    """
    found = free_name(docs, "found_spans")
    merged = free_name(docs, "merged_spans")
    marked = find_spans(docs, found).withColumn(merged, F.aggregate(
        F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint,kind:string>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] > s["start"]), F.concat(
            F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(
                F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"),
                F.element_at(out, -1)["kind"].alias("kind"))))).otherwise(F.concat(out, F.array(s)))))
    pieces = F.transform(merged, lambda s, i: F.concat(
        F.expr("text").substr(
            (F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(0) + 1).cast("int"),
            (s["start"] - F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(0)).cast("int")),
        F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    tail = F.expr(f"substr(text, CAST(element_at({merged}, -1).end + 1 AS INT))")
    cleaned = F.when(F.size(merged) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    out = marked.withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(merged) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
