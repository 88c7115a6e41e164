"""Numeric and small text expressions shared by every block.

Every helper returns Spark SQL expression text, for ``selectExpr`` or ``F.expr``.  Text keeps
plans cheap to build: one call into the JVM per expression instead of one per operator.
"""

from __future__ import annotations

from collections.abc import Sequence

EPS = 1e-6  # fixed value: probability clip


def lit(text: str) -> str:
    """A raw SQL string literal (no backslash escapes)."""
    return 'r"' + text + '"'


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}D"


def safe_div(a: str, b: str, default: float = 0.0) -> str:
    """Quotient as double; ``default`` where the denominator is zero."""
    return f"(CASE WHEN ({b}) = 0 THEN {num(default)} ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def clip_probability(p: str, eps: float = EPS) -> str:
    return f"greatest(least(CAST({p} AS DOUBLE), {num(1.0 - eps)}), {num(eps)})"


def logit(p: str, eps: float = EPS) -> str:
    c = clip_probability(p, eps)
    return f"ln({c} / (1D - {c}))"


def sigmoid(z: str) -> str:
    return f"(1D / (1D + exp(-({z}))))"


def log_loss(y: str, p: str, eps: float = EPS) -> str:
    """Per-row negative log likelihood of a 0/1 (or fractional) label."""
    c = clip_probability(p, eps)
    return f"(-(({y}) * ln({c}) + (1D - ({y})) * ln(1D - {c})))"


def shrink(p: str, weight: str, base: str) -> str:
    """Pull a prediction toward the base rate; order is unchanged."""
    return clip_probability(f"(({base}) + ({weight}) * (({p}) - ({base})))")


def blend_logit(preds: Sequence[str], weights: Sequence[str]) -> str:
    """Weighted sum of logits as a probability; a null input abstains to the first one."""
    total = " + ".join(f"({w}) * {logit(p)}" for p, w in zip(preds, weights))
    known = " AND ".join(f"({p}) IS NOT NULL" for p in preds)
    return f"(CASE WHEN {known} THEN {sigmoid(total)} ELSE {preds[0]} END)"


def calibrated(p: str, calibrator: dict) -> str:
    """Apply a calibrator given as plain numbers: none, platt or isotonic."""
    c = clip_probability(p)
    method = calibrator.get("method", "none")
    if method == "platt":
        return sigmoid(f"{num(calibrator['coef'])} * {logit(p)} + {num(calibrator['intercept'])}")
    if method == "isotonic" and len(calibrator["x"]):
        return interpolate(c, calibrator["x"], calibrator["y"])
    return c


def interpolate(x: str, xs: Sequence[float], ys: Sequence[float]) -> str:
    """Piecewise-linear interpolation over ascending knots, clamped at both ends."""
    knots = "array(" + ", ".join(
        f"named_struct('x', {num(a)}, 'y', {num(b)})" for a, b in zip(xs, ys)
    ) + ")"
    below = f"element_at(filter({knots}, k -> k.x <= {x}), -1)"
    above = f"element_at(filter({knots}, k -> k.x > {x}), 1)"
    return (
        f"(CASE WHEN {x} <= {num(xs[0])} THEN {num(ys[0])} WHEN {x} >= {num(xs[-1])} THEN {num(ys[-1])} "
        f"ELSE {below}.y + ({x} - {below}.x) * ({above}.y - {below}.y) / ({above}.x - {below}.x) END)"
    )


# Fixed value: accepted relative time, hours:minutes:seconds with an optional fraction.
ELAPSED = r"^\s*(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d+))?\s*$"


def elapsed_seconds(text: str) -> str:
    """``H:MM:SS[.f]`` to seconds; null when the text has another form."""
    part = lambda i: f"regexp_extract({text}, {lit(ELAPSED)}, {i})"
    whole = " + ".join(
        f"try_cast({part(i)} AS DOUBLE) * {scale}D" for i, scale in ((1, 3600), (2, 60), (3, 1))
    )
    fraction = f"CASE WHEN {part(4)} = '' THEN 0D ELSE try_cast(concat('0.', {part(4)}) AS DOUBLE) END"
    return f"(CASE WHEN {text} RLIKE {lit(ELAPSED)} THEN {whole} + {fraction} END)"


def evenly_spaced(n: str, k: int) -> str:
    """Distinct 0-based positions ``round(linspace(0, n-1, k))``, halves to even.

    With ``n <= k`` every position is taken.  The array holds at most ``k`` entries.
    """
    step = max(k - 1, 1)
    return (
        f"(CASE WHEN {n} <= 0 THEN cast(array() AS array<bigint>) "
        f"WHEN {n} <= {k} THEN sequence(0L, CAST(least({n}, {k}) AS BIGINT) - 1L) "
        f"ELSE array_distinct(transform(sequence(0, {k - 1}), "
        f"i -> CAST(bround(i * (CAST({n} - 1 AS DOUBLE) / {step}D)) AS BIGINT))) END)"
    )


def with_instruction(text: str, prefix: str) -> str:
    """Query-side instruction prefix for asymmetric encoders."""
    return f"concat({lit(prefix)}, coalesce({text}, ''))"


def token_estimate(n_chars: str) -> str:
    """Length-based token count: one token per four characters, floored."""
    return f"CAST(floor(({n_chars}) / 4) AS BIGINT)"


def seeded_hash(*cols: str, seed: int = 0) -> str:
    """Deterministic order key that any SQL engine can reproduce."""
    inner = ", ".join(f"CAST({c} AS STRING)" for c in cols)
    return f"md5(concat_ws('|', {inner}, '{seed}'))"
