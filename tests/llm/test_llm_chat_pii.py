"""Chat formatting and personal data against plain Python."""

import hashlib
import random
import re

from turnwise.llm import chat, pii

PARTS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "|",
         "\n", "é𝒳", "a", " ", "s>", "im_end|>", "[", "$1", "<|endoftext|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_texts_survive_formatting(spark):
    rng, rows, turns = random.Random(2), [], {}
    for c in range(80):
        turns[c] = [(i, rng.choice(["user", "assistant", "as\nsistant<|im_sep|>"]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))))
                    for i in range(rng.randint(1, 6))]
        rows += [(c, *turn, "x") for turn in turns[c]]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    rendered = chat.render(chat.fold_events(chat.turn_events(given)))
    got = {r.conv_id: r for r in chat.digests(chat.parse(rendered)).collect()}
    whole = {r.conv_id: r.formatted for r in rendered.collect()}
    for c, rows in turns.items():
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in rows))
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(rows), len(loss), sha(loss), len(whole[c]))
        assert whole[c].count("<|im_start|>") == whole[c].count("<|im_end|>") == len(rows)
        assert not any(s in whole[c] for s in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"))


def test_events_fold_into_final_messages(spark):
    events = spark.createDataFrame([
        (1, 1, 10, "user", "delta", "he"), (1, 2, 10, None, "delta", "llo"), (1, 3, 11, "assistant", "delta", "bad"),
        (1, 4, 11, None, "regenerate", None), (1, 5, 11, None, "delta", "go"), (1, 6, 11, None, None, "od"),
        (1, 7, 10, None, "edit", "hi"), (1, 8, 12, "assistant", "delta", "x"), (1, 9, 12, None, "delete", None),
        (2, None, None, None, None, None), (2, 5, None, "user", "delta", "t"), (2, 5, None, "user", "delta", "t"),
        (None, 1, None, "user", "delta", "n"),
    ], "conv_id long, seq long, message long, role string, kind string, text string")
    got = sorted(((r.conv_id or 0, r.place, r.role, r.text) for r in chat.fold_events(events).collect()))
    assert [(c, r, t) for c, _, r, t in got] == [
        (0, "user", "n"), (1, "user", "hi"), (1, "assistant", "good"), (2, "", ""), (2, "user", "t"), (2, "user", "t")]
    assert chat.digests(chat.parse(chat.render(chat.fold_events(events.limit(0))))).count() == 0


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


HARD = [
    None, "", "a@b.c_x@y.z @q a@b a@b.c.d.", "x.1.2.3.4.5.6.7 001.2.3.0000255 256.1.1.1 1.1.1.256",
    "4111 1111 1111 1111 x 4111-1111-1111-1111-1 é𝒳 a@b.co", "+1 (234) 567-8901 ++49 1+22.2222222-",
    "9" * 20_000 + " " + "a." * 20_000 + "@" + "b." * 5000 + "c", "1" + " 1" * 30_000, "𝒳" * 5 + "+12345678 a@b.c",
]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    rows = list(enumerate(HARD)) + [
        (100 + i, "".join(rng.choice(["a", ".", "@", "1", "25", "-", " ", "+", "4111111111111111", "é", "(", "_"]) for _ in range(40)))
        for i in range(300)]
    rows.append((None, "a@b.c"))
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, found string").repartition(3)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, text in rows:
        spans = base_spans(text or "")
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), text
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    assert pii.report(docs.limit(0)).count() == 0


def test_added_kinds_need_checks_and_context(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 iban", "GB83 WEST 1234 5698 7654 32 iban", "my ssn 123-45-6789" + " " * 60 + "123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got == {0: "iban:0:27", 1: "", 2: "ssn:7:18"}


def test_masking_changes_only_spans(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.co, 10.0.0.1!", "en", "s", 24), (2, None, "en", "s", None), (3, "plain", "en", "s", 5)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "é mail <EMAIL>, <IP>!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "plain"
    assert pii.redact(docs).dtypes == docs.dtypes
