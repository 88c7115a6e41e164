"""Text expressions: phrase counts, tokens, tags, turn labels.

Helpers return Spark SQL expression text.  All of it is built-in, evaluated per utterance
on the scan side, so text itself never has to be shuffled for the counting features.
"""

from __future__ import annotations

from collections.abc import Sequence

from .scalars import lit

# ---------------------------------------------------------------------------
# Word lists, patterns and labels that define the features.
# ---------------------------------------------------------------------------
HEDGE = (
    "maybe", "perhaps", "probably", "guess", "think", "might", "possibly", "not sure",
    "unsure", "confused", "confusing", "don't know", "dont know", "no idea", "i don't get",
    "i dont get", "lost", "stuck", "hard", "difficult",
)
AFFIRM = (
    "yes", "yeah", "yep", "correct", "exactly", "right", "well done", "good job", "perfect",
    "brilliant", "great", "excellent", "nice", "spot on", "that's it", "lovely", "fantastic",
    "super",
)
NEGATE = ("no", "not quite", "incorrect", "wrong", "nope", "not really", "almost")
FILLER = (
    "um", "uh", "erm", "er", "hmm", "mm", "mmm", "like", "you know", "sort of", "kind of",
)
UNDERSTAND_CHECK = (
    "does that make sense", "make sense", "do you understand", "got it", "is that clear",
    "are you with me", "any questions", "can you see why", "do you follow",
)
AFFIRM_MARKERS = (
    "exactly", "well done", "that's right", "thats right", "correct", "perfect", "brilliant",
    "excellent", "spot on", "good job", "great job", "nice work", "well spotted",
    "absolutely", "you got it", "that's it", "thats it", "lovely", "fantastic", "super",
    "yes good", "good boy", "good girl",
)
CORRECTION_MARKERS = (
    "not quite", "not right", "close", "almost", "nearly", "try again", "have another go",
    "not exactly", "that's wrong", "thats wrong", "incorrect", "let's try", "lets try",
    "remember", "careful", "actually", "hmm no", "no,", "not really", "think again",
    "look again", "check that", "not the",
)
REEXPLAIN_MARKERS = (
    "so what we do", "the way to", "let me show", "let me explain", "we need to",
    "the rule is", "remember that", "so first", "step by step", "what we're doing",
    "the reason", "because when", "so if we", "you have to",
)
ROLES = ("tutor", "student", "background")
WORD = r"[a-z']+"
BRACKET = r"\[[^\]]{0,40}\]"
UNCLEAR = r"(?i)\[unclear\]"
FALSE_START = r"(?i)\b[a-z]{1,12}-(?:\s|$)"
SELF_CORRECTION = (
    r"(?i)\b(i mean|sorry|no wait|actually|rather|let me rephrase|scratch that)\b"
)
LONG_TURN_CHARS = 200
TUTOR_MOVES = (
    "questioning", "explaining", "scaffolding", "affirming", "correcting", "checking",
    "managing",
)
STUDENT_MOVES = ("answering", "asking", "expressing_confusion", "acknowledging", "off_task")
MOVE_CHECKING = (
    r"(?i)\b(does that make sense|make sense|do you understand|is that clear|"
    r"are you with me|do you follow|got it|any questions)\b"
)
MOVE_AFFIRMING = (
    r"(?i)\b(well done|good job|exactly|perfect|brilliant|excellent|correct|that's right|"
    r"spot on|lovely|fantastic|great|nice one|super)\b"
)
MOVE_CORRECTING = (
    r"(?i)\b(not quite|not right|incorrect|that's wrong|almost|nearly|try again|"
    r"remember that|actually it)\b"
)
MOVE_SCAFFOLDING = (
    r"(?i)\b(what if|let's try|first|next step|start by|think about|can you see|"
    r"what do we do|hint|step by step|break (it|this) down)\b"
)
MOVE_MANAGING = (
    r"(?i)\b(hello|hi there|good morning|good afternoon|bye|see you|can you hear|"
    r"your microphone|let's begin|welcome back|thank you for)\b"
)
MOVE_CONFUSED = (
    r"(?i)\b(i don'?t know|i'?m not sure|confused|don'?t get it|no idea|stuck|"
    r"what do you mean|i don'?t understand|pardon)\b"
)
MOVE_ACKNOWLEDGING = (
    r"(?i)^\s*(ok(ay)?|yeah|yes|yep|mm-?hmm|right|sure|got it|alright)[.!]?\s*$"
)
STRIP = r"^\s+|\s+$"
BLANKS = r"\s+"
PUNCTUATED = r"^[.,:;]+|[.,:;]+$"
TERM = r"(?U)\b\w\w+\b"
ROLE_TAGS = (("tutor", "T:"), ("student", "S:"), ("background", "B:"))
OTHER_TAG = "?:"
# ---------------------------------------------------------------------------


def normalized_role(role: str) -> str:
    return f"lower(trim(coalesce(CAST({role} AS STRING), 'unknown')))"


def phrase_count(text: str, phrases: Sequence[str]) -> str:
    """Non-overlapping substring occurrences summed over the phrases (not word-bounded); phrases are ASCII.

    Most texts lack most phrases, and ``contains`` sees that sooner than ``replace``.
    """
    parts = [
        f"CASE WHEN NOT contains({text}, {lit(p)}) THEN 0L "
        f"ELSE (octet_length({text}) - octet_length(replace({text}, {lit(p)}))) div {len(p)} END"
        for p in phrases
    ]
    return f"({' + '.join(parts)})"


def phrase_count_bounded(text: str, phrases: Sequence[str]) -> str:
    """As ``phrase_count`` but only at word boundaries."""
    parts = [f"regexp_count({text}, {lit('(?<![A-Za-z0-9_])' + p + '(?![A-Za-z0-9_])')})" for p in phrases]
    return f"({' + '.join(parts)})"


def without_tags(text: str) -> str:
    """Lower-cased text with short bracket tags blanked."""
    return f"regexp_replace(lower({text}), {lit(BRACKET)}, ' ')"


def words(text: str) -> str:
    return f"regexp_extract_all({without_tags(text)}, {lit(WORD)}, 0)"


def regex_count(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {lit(pattern)})"


def _pairs(tokens: str, make: str) -> str:
    n = f"greatest(size({tokens}) - 1, 0)"
    return f"zip_with(slice({tokens}, 1, {n}), slice({tokens}, 2, {n}), (a, b) -> {make})"


def adjacent_repeats(tokens: str) -> str:
    """Equal neighbours inside one token array."""
    return f"size(filter({_pairs(tokens, 'a = b')}, same -> same))"


def tutor_turn_label(text: str, word_bounded: bool = False) -> str:
    """correct, affirm, reexplain or other, from marker counts and length.

    Counting substrings makes "incorrect" count for both sides and end as ``affirm``;
    ``word_bounded`` counts whole words instead.
    """
    count = phrase_count_bounded if word_bounded else phrase_count
    t = f"lower(coalesce({text}, ''))"
    corrections, affirmations = count(t, CORRECTION_MARKERS), count(t, AFFIRM_MARKERS)
    return (
        f"(CASE WHEN {corrections} > {affirmations} THEN 'correct' WHEN {affirmations} > 0 THEN 'affirm' "
        f"WHEN {count(t, REEXPLAIN_MARKERS)} > 0 OR length({t}) > {LONG_TURN_CHARS} THEN 'reexplain' "
        f"ELSE 'other' END)"
    )


def turn_label(role: str, text: str) -> str:
    """``tutor_turn_label`` on tutor rows, null elsewhere."""
    return f"(CASE WHEN {role} = 'tutor' THEN {tutor_turn_label(text)} END)"


def stripped(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), {lit(STRIP)}, '')"


def move_label(role: str, text: str) -> str:
    """Dialogue move by first matching rule; roles other than tutor/student manage."""
    t = stripped(text)
    tutor = (
        ("managing", f"{t} RLIKE {lit(MOVE_MANAGING)}"),
        ("checking", f"{t} RLIKE {lit(MOVE_CHECKING)}"),
        ("correcting", f"{t} RLIKE {lit(MOVE_CORRECTING)}"),
        ("affirming", f"{t} RLIKE {lit(MOVE_AFFIRMING)}"),
        ("scaffolding", f"{t} RLIKE {lit(MOVE_SCAFFOLDING)}"),
        ("questioning", f"contains({t}, '?')"),
        ("explaining", "true"),
    )
    student = (
        ("expressing_confusion", f"{t} RLIKE {lit(MOVE_CONFUSED)}"),
        ("asking", f"contains({t}, '?')"),
        ("acknowledging", f"{t} RLIKE {lit(MOVE_ACKNOWLEDGING)}"),
        ("off_task", f"length({t}) < 3"),
        ("answering", "true"),
    )
    rules = [f"WHEN {role} = 'tutor' AND {test} THEN '{move}'" for move, test in tutor]
    rules += [f"WHEN {role} = 'student' AND {test} THEN '{move}'" for move, test in student]
    return f"(CASE {' '.join(rules)} ELSE 'managing' END)"


def accepted_label(raw: str, role: str, text: str) -> str:
    """First word of an external label if the role knows it, otherwise the rule label."""
    word = f"element_at(split(lower({stripped(raw)}), {lit(BLANKS)}), 1)"
    first = f"regexp_replace({word}, {lit(PUNCTUATED)}, '')"
    known = lambda moves: ", ".join(f"'{m}'" for m in moves)
    return (
        f"(CASE WHEN {role} = 'tutor' AND {first} IN ({known(TUTOR_MOVES)}) THEN {first} "
        f"WHEN {role} <> 'tutor' AND {first} IN ({known(STUDENT_MOVES)}) THEN {first} "
        f"ELSE {move_label(role, text)} END)"
    )


def role_tag(role: str) -> str:
    rules = " ".join(f"WHEN {role} = '{name}' THEN '{tag}'" for name, tag in ROLE_TAGS)
    return f"(CASE {rules} ELSE '{OTHER_TAG}' END)"


def content_words(text: str, stopwords: Sequence[str]) -> str:
    """Lower-cased words of two or more characters minus the stopwords."""
    tokens = f"regexp_extract_all(lower({text}), {lit(TERM)}, 0)"
    if not stopwords:
        return tokens
    stop = "array(" + ", ".join(lit(s) for s in stopwords) + ")"
    return f"filter({tokens}, w -> NOT array_contains({stop}, w))"


CONCAT = "concat_ws(' ', a, b)"


def with_bigrams(tokens: str) -> str:
    """The tokens followed by every pair of neighbours."""
    return f"concat({tokens}, {_pairs(tokens, CONCAT)})"


# Feature-column prefixes and their block, first match wins.
BLOCK_PREFIXES = (
    ("struct_", "structural"), ("ling_", "linguistic"), ("temp_", "temporal"),
    ("lo_", "lo_alignment"), ("fb_", "feedback"), ("fbs_", "feedback"),
    ("traj_", "trajectory"), ("lopos_", "lo_position"), ("cont_", "content"),
    ("emb_", "embeddings"),
)


def block_of(column: str, explicit: dict[str, str] | None = None) -> str:
    """Feature column name to block: an explicit map first, then the prefix rule."""
    rules = [f"WHEN {column} = '{f}' THEN '{b}'" for f, b in (explicit or {}).items()]
    rules += [f"WHEN startswith({column}, '{p}') THEN '{b}'" for p, b in BLOCK_PREFIXES]
    return f"(CASE {' '.join(rules)} ELSE 'other' END)"
