"""Dempster-Shafer mass functions as long tables (id, focal array<int> sorted, mass double)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOTAL_CONFLICT = 1 - 1e-12


def combine(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Dempster's rule for the masses of each id; on total conflict the mean of both."""
    pairs = a.select(id_col, F.col("focal").alias("fa"), F.col("mass").alias("ma")).join(b.select(id_col, F.col("focal").alias("fb"), F.col("mass").alias("mb")), id_col)
    met = pairs.select(id_col, F.array_sort(F.array_intersect("fa", "fb")).alias("focal"), (F.col("ma") * F.col("mb")).alias("mass"))
    met = met.groupBy(id_col, "focal").agg(F.sum("mass").alias("mass"))
    conflict = met.groupBy(id_col).agg(F.sum(F.when(F.size("focal") == 0, F.col("mass")).otherwise(0.0)).alias("k"))
    good = met.where(F.size("focal") > 0).join(conflict.where(F.col("k") < TOTAL_CONFLICT), id_col).select(id_col, "focal", (F.col("mass") / (1 - F.col("k"))).alias("mass"))
    clash = conflict.where(F.col("k") >= TOTAL_CONFLICT).select(id_col)
    mixed = a.unionByName(b).join(clash, id_col, "left_semi").groupBy(id_col, "focal").agg((F.sum("mass") / 2).alias("mass"))
    return good.unionByName(mixed)


def combine_all(tables: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Dempster's rule from left to right; a short list of sources, not of rows."""
    out = tables[0]
    for t in tables[1:]:
        out = combine(out, t, id_col)
    return out


def from_probability(rows: DataFrame, proba: str, confidence: str | float, id_col: str = "id") -> DataFrame:
    """Confidence times the probability on single classes, the rest on the whole frame."""
    conf = F.col(confidence) if isinstance(confidence, str) else F.lit(confidence)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))
    p = F.posexplode(proba).alias("c", "p")
    single = rows.select(id_col, conf.alias("conf"), p).select(id_col, F.array("c").alias("focal"), (F.col("conf") * F.col("p")).alias("mass"))
    whole = rows.select(id_col, F.sequence(F.lit(0), F.size(proba) - 1).alias("focal"), (1 - conf).alias("mass"))
    return single.unionByName(whole).where("mass > 0").groupBy(id_col, "focal").agg(F.sum("mass").alias("mass"))


def pignistic(masses: DataFrame, id_col: str = "id") -> DataFrame:
    """id, class, probability: each focal set's mass shared equally among its classes."""
    rows = masses.select(id_col, F.explode("focal").alias("class"), (F.col("mass") / F.size("focal")).alias("p"))
    return rows.groupBy(id_col, "class").agg(F.sum("p").alias("probability"))
