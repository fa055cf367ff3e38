"""Expressions over array<double> feature vectors, and hash-based draws that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: str | Column, b: str | Column, p: float = 2.0) -> Column:
    """Minkowski distance."""
    if p == 2:
        return F.sqrt(squared_distance(a, b))
    if p == 1:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.pow(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(0.0), lambda s, x: s + x), 1 / p)


def interpolate(seed: str | Column, other: str | Column, gap: Column) -> Column:
    """seed + gap * (other - seed)."""
    return F.zip_with(seed, other, lambda p, q: p + gap * (q - p))


def interpolate_each(seed: str | Column, other: str | Column, gaps: str | Column, halved: Column) -> Column:
    """A gap for each dimension, halved where the target is of the majority."""
    step = F.zip_with(gaps, F.zip_with(seed, other, lambda p, q: q - p), lambda g, d: F.when(halved, g / 2).otherwise(g) * d)
    return F.zip_with(seed, step, lambda p, d: p + d)


def uniform(seed: int, *keys: str | Column) -> Column:
    """A draw from [0, 1) that depends on the seed and the keys alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(seed: int, *keys: str) -> str:
    """The same draw in ANSI SQL for DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8))::BIGINT / 4294967296.0)"


def as_text(v: str | Column) -> Column:
    """The vector's numbers to six places, parted by commas, for comparison with other engines."""
    return F.array_join(F.transform(v, lambda x: F.round(x, 6).cast("decimal(18,6)").cast("string")), ",")


def as_text_sql(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CAST(CAST(round(x, 6) AS DECIMAL(18, 6)) AS VARCHAR)), ',')"


def rbf(d: Column, gamma: float) -> Column:
    """exp(-(d / gamma)^2); 0 for gamma 0."""
    return F.exp(-F.pow(d / gamma, 2)) if gamma else F.lit(0.0)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; a constant becomes 1."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(1.0)


def argmax(p: str | Column) -> Column:
    """Position of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(z: str | Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def hardness(p_true: Column, kind: str = "absolute") -> Column:
    """Of a row by the probability of its class: absolute, squared (Brier) or entropy (cross entropy)."""
    if kind == "absolute":
        return 1 - p_true
    if kind == "squared":
        return F.pow(1 - p_true, 2)
    return -F.ln(F.greatest(p_true, F.lit(1e-12)))


def margin_hardness(proba: str, label: str) -> Column:
    """(1 - p_true + largest other) / 2."""
    own = F.get(proba, F.col(label))
    others = F.array_max(F.transform(proba, lambda x, i: F.when(i != F.col(label), x).otherwise(-1.0)))
    return (1 - own + others) / 2


def paced_hardness(h: Column, strategy: str, density: Column | None = None, proba: str | Column | None = None) -> Column:
    """Margin hardness as a pacing strategy sees it: density weighs it by .55 to 1, margin and boundary lift it by the power .75,
    entropy averages it with the probabilities' entropy over its largest value."""
    if strategy in ("density", "boundary", "density_cost"):
        h = F.least(F.greatest(h * (0.55 + 0.45 * density), F.lit(0.0)), F.lit(1.0))
    if strategy in ("margin", "boundary"):
        return F.least(F.greatest(F.pow(h, 0.75), F.lit(0.0)), F.lit(1.0))
    if strategy == "entropy":
        total = -F.aggregate(proba, F.lit(0.0), lambda s, p: s + p * F.ln(p + 1e-12))
        return 0.5 * h + 0.5 * total / F.ln(F.size(proba))
    return h


def balance_entropy(counts: str | Column) -> Column:
    """log2 S - (sum c log2 c) / S of a count vector; 0 when empty."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    inner = F.aggregate(F.transform(counts, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.log2(total) - inner / total).otherwise(0.0)


def normal_name(x: str | Column) -> Column:
    """Lower case without hyphens and underscores."""
    return F.regexp_replace(F.lower(x), "[-_]", "")
