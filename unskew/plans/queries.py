"""Queries over the star schema and embedding tables, one for each operator, and the same in ANSI SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dempster
from ..functions import vectors as V
from ..operators import knn, metrics, neighbourhood, report, resamplers, sampling, selection
from ..sources import baselines
from ..streaming import monitor
from . import benchmark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for sums whose order differs from engine to engine."""
    return df.select([F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- labelled points: the embeddings, their ten labels gathered into three classes of 6 : 3 : 1 ------------------------

POINTS = """points AS (
    SELECT vec_id AS id, CASE WHEN label < 6 THEN 0 WHEN label < 9 THEN 1 ELSE 2 END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)"""
PAIRS = """pairs AS (
    SELECT a.id, a.label, a.f, b.id AS nb, b.label AS nl, b.f AS g,
           sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
    FROM points a JOIN points b ON a.id <> b.id)"""


def nearest_sql(k: int, name: str = "near", where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM pairs WHERE {where}) WHERE r <= {k})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("label") < 6, 0).when(F.col("label") < 9, 1).otherwise(2)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("features"))


def small_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of three dimensions, each the sum of a third of the embedding: what tree learners are quick on."""
    part = lambda a: F.aggregate(F.slice("features", a, 21), F.lit(0.0), lambda s, x: s + x)
    return points(spark, sf_dir).select("id", "label", F.array(part(1), part(22), part(43)).alias("features"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN label < 6 THEN 0 WHEN label < 9 THEN 1 ELSE 2 END AS label FROM embeddings) GROUP BY label")
def class_counts(spark, sf_dir):
    return sampling.class_counts(points(spark, sf_dir))


@query("""
    WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CAST(round_even(avg(n), 0) AS BIGINT) AS mean_target, max(n) AS max_target, min(n) AS min_target FROM c""")
def class_targets(spark, sf_dir):
    return sampling.class_targets(read(spark, sf_dir, "lineitem"), "l_returnflag")


@query("""
    SELECT o_orderpriority, n, CASE WHEN place = 1 THEN 'majority' ELSE 'minority' END AS role, CAST(place AS INTEGER) AS place FROM (
        SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1)""")
def split_classes(spark, sf_dir):
    return sampling.split_classes(read(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def label_index(spark, sf_dir):
    return sampling.label_index(read(spark, sf_dir, "orders"), "o_orderpriority")


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""
    WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2
               FROM lineitem WHERE l_orderkey % 5 <> 0)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END, 6) AS quantity_scaled,
           round((l_extendedprice - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END, 6) AS price_scaled
    FROM lineitem, s""")
def standard_scaling(spark, sf_dir):
    """Fitted on four fifths of the orders, applied to all."""
    rows = read(spark, sf_dir, "lineitem").withColumn("features", F.array("l_quantity", "l_extendedprice"))
    scaled = sampling.scale(rows, F.col("l_orderkey") % 5 != 0)
    return rounded(scaled.select("l_orderkey", "l_linenumber", "l_partkey", F.get("features", F.lit(0)).alias("quantity_scaled"), F.get("features", F.lit(1)).alias("price_scaled")))


FOLD_SQL = f"row_number() OVER (PARTITION BY o_orderpriority ORDER BY {V.uniform_sql(42, 'o_orderkey')}, o_orderkey)"


@query(f"SELECT o_orderkey, o_orderpriority, CAST(({FOLD_SQL} - 1) % 5 + 1 AS INTEGER) AS fold FROM orders")
def stratified_folds(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return sampling.stratified_folds(rows, 5, 42, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "fold")


@query(f"""
    WITH c AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
    w AS (SELECT *, n * ceil(total * 0.3) / total AS want FROM c),
    q AS (SELECT o_orderpriority, floor(want) + CASE WHEN row_number() OVER (ORDER BY want - floor(want) DESC, o_orderpriority) <= ceil(total * 0.3) - sum(floor(want)) OVER () THEN 1 ELSE 0 END AS test FROM w),
    o AS (SELECT o_orderkey, o_orderpriority, {FOLD_SQL} AS r FROM orders)
    SELECT o_orderkey, o_orderpriority, CASE WHEN r <= test THEN 'test' ELSE 'train' END AS split FROM o JOIN q USING (o_orderpriority)""")
def stratified_holdout(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return sampling.stratified_holdout(rows, 0.3, 42, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "split")


@query(f"""
    WITH c AS (SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS p FROM orders GROUP BY 1),
    q AS (SELECT o_orderpriority, CASE WHEN p = 1 THEN n ELSE greatest(1, (SELECT max(n) FROM c) // 10) END AS want FROM c),
    o AS (SELECT o_orderkey, o_orderpriority, {FOLD_SQL} AS r FROM orders)
    SELECT o_orderkey, o_orderpriority FROM o JOIN q USING (o_orderpriority) WHERE r <= want""")
def imbalance_ratio(spark, sf_dir):
    return sampling.imbalance_ratio(read(spark, sf_dir, "orders"), 10, 42, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(f"""
    WITH o AS (SELECT o_orderkey, o_orderpriority, {FOLD_SQL} AS r FROM orders)
    SELECT o_orderkey, o_orderpriority FROM o WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))""")
def random_balance(spark, sf_dir):
    return sampling.random_balance(read(spark, sf_dir, "orders"), 42, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(f"""
    WITH c AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
    q AS (SELECT o_orderpriority, CASE WHEN total <= 1000 THEN n ELSE greatest(1, round_even(1000 * n / total, 0)) END AS want FROM c),
    o AS (SELECT o_orderkey, o_orderpriority, {FOLD_SQL} AS r FROM orders)
    SELECT o_orderkey, o_orderpriority FROM o JOIN q USING (o_orderpriority) WHERE r <= want""")
def stratified_cap(spark, sf_dir):
    return sampling.stratified_cap(read(spark, sf_dir, "orders"), 1000, 42, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(f"""
    SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
        ORDER BY ln(greatest({V.uniform_sql(7, 'o_orderkey')}, 1e-12)) / greatest(o_totalprice, 1e-12) DESC, o_orderkey) AS r FROM orders) WHERE r <= 100""")
def weighted_sample(spark, sf_dir):
    """A hundred orders of each priority, drawn by price without replacement."""
    rows = read(spark, sf_dir, "orders")
    return sampling.weighted_without_replacement(rows, F.col("o_totalprice"), 100, 7, "o_orderpriority", id_col="o_orderkey").select("o_orderkey", "o_orderpriority")


@query(f"""
    WITH o AS (SELECT o_orderkey, o_orderpriority, {V.uniform_sql(3, 'o_orderkey')} AS h FROM orders),
    b AS (SELECT *, CASE WHEN max(h) OVER g > min(h) OVER g THEN least(floor((h - min(h) OVER g) / (max(h) OVER g - min(h) OVER g) * 20), 19) ELSE 0 END AS bin FROM o WINDOW g AS (PARTITION BY o_orderpriority)),
    s AS (SELECT o_orderpriority, bin, count(*) AS have, 1 / (avg(h) + tan(pi() * 3 / 18) + 1e-12) AS w FROM b GROUP BY 1, 2), l AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)),
    t AS (SELECT *, least(have, floor(least * w / sum(w) OVER (PARTITION BY o_orderpriority))) AS take FROM s, l), k AS (SELECT *, least - sum(take) OVER (PARTITION BY o_orderpriority) AS lack FROM t),
    x AS (SELECT o_orderpriority, bin, w, lack, unnest(range(1, CAST(least(have - take, greatest(lack, 1)) AS BIGINT) + 1)) AS turn FROM k WHERE have > take),
    m AS (SELECT o_orderpriority, bin, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, w DESC, bin) AS p FROM x) WHERE p <= lack GROUP BY 1, 2),
    d AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, bin ORDER BY {V.uniform_sql(45, 'o_orderkey')}, o_orderkey) AS r FROM b)
    SELECT d.o_orderkey, d.o_orderpriority FROM d JOIN k USING (o_orderpriority, bin) LEFT JOIN m USING (o_orderpriority, bin) WHERE r <= take + coalesce(more, 0)""")
def self_paced_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("h", V.uniform(3, "o_orderkey"))
    return sampling.self_paced(rows, "h", 3, 10, label="o_orderpriority", id_col="o_orderkey").select("o_orderkey", "o_orderpriority")


# -- neighbours --------------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(5)} SELECT id, nb AS neighbour, nl AS neighbour_label, CAST(r AS INTEGER) AS rank, round(d, 6) AS dist FROM near")
def knn_join(spark, sf_dir):
    return rounded(knn.neighbours(points(spark, sf_dir), 5).select("id", "neighbour", "neighbour_label", "rank", "dist"))


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(5)} SELECT id, label, round(avg(CASE WHEN nl = label THEN 1.0 ELSE 0.0 END), 6) AS safe FROM near GROUP BY id, label")
def safe_level(spark, sf_dir):
    return rounded(knn.safe_level(points(spark, sf_dir), 5))


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(5, where='label = 2 AND nl <> 2')} SELECT id, round(max(d), 6) AS dist FROM near GROUP BY id")
def cross_class_distance(spark, sf_dir):
    return rounded(knn.cross_class_distance(points(spark, sf_dir), 2, 5))


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(1, where='label = nl')} SELECT label, round(quantile_cont(d, 0.5), 6) AS median_dist FROM near GROUP BY label")
def median_distance(spark, sf_dir):
    return rounded(knn.median_distance(points(spark, sf_dir)))


def region_sql(where: str) -> str:
    """CTEs from pairs to `region`: whole ordered lists until five rows of other classes in a row."""
    return f"""listed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM pairs WHERE {where}),
    islands AS (SELECT *, sum(CASE WHEN nl = label THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY r) AS island FROM listed),
    running AS (SELECT *, sum(CASE WHEN nl <> label THEN 1 ELSE 0 END) OVER (PARTITION BY id, island ORDER BY r) AS run FROM islands),
    region AS (SELECT * FROM (SELECT *, max(CASE WHEN run >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_ FROM running) WHERE coalesce(over_, 0) = 0)"""


@query(f"WITH {POINTS}, {PAIRS}, {region_sql('true')} SELECT id, nb AS neighbour, CAST(r AS INTEGER) AS rank FROM region")
def candidate_region(spark, sf_dir):
    """Whole lists, whatever their length."""
    return knn.candidate_region(points(spark, sf_dir), 5).select("id", "neighbour", "rank")


@query(ORACLE_SQL["candidate_region"])
def candidate_region_whole(spark, sf_dir):
    """The same lists, asked for by few neighbours at first, so that most rows ask again."""
    return knn.candidate_region(points(spark, sf_dir), 5, reach=8).select("id", "neighbour", "rank")


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(12)}
    SELECT e.id, e.nb AS neighbour, CAST(e.r AS INTEGER) AS rank FROM near e WHERE NOT EXISTS (
        SELECT 1 FROM near z WHERE z.id = e.id AND z.r < e.r AND z.nl <> e.label
          AND list_sum(list_transform(list_zip(list_transform(list_zip(e.f, e.g), lambda q: (q[1] + q[2]) / 2), z.g), lambda w: (w[1] - w[2]) * (w[1] - w[2]))) < e.d * e.d / 4)""")
def clean_directions(spark, sf_dir):
    rows = points(spark, sf_dir)
    return knn.clean_directions(knn.neighbours(rows, 12), rows).select("id", "neighbour", "rank")


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, own AS (SELECT id, avg(1 / greatest(d, 1e-10)) AS r FROM near WHERE nl = label GROUP BY id),
    a AS (SELECT p.id, p.label, coalesce(r, 1.0) AS r FROM points p LEFT JOIN own USING (id)),
    b AS (SELECT *, exp(-r / avg(r) OVER (PARTITION BY label)) AS e FROM a)
    SELECT id, label, round(e / avg(e) OVER (PARTITION BY label), 6) AS density FROM b""")
def inverse_density(spark, sf_dir):
    return rounded(knn.inverse_density(points(spark, sf_dir), 5))


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(7)} SELECT id, label, round(CASE WHEN sum(d) > 0 THEN sum(CASE WHEN nl = label THEN d ELSE 0 END) / sum(d) ELSE 0 END, 6) AS rate FROM near GROUP BY id, label")
def reception_rate(spark, sf_dir):
    return rounded(knn.reception_rate(points(spark, sf_dir), 7))


@query(f"""
    WITH {POINTS}, {PAIRS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM pairs) WHERE r <= (SELECT greatest(15, floor(sqrt(count(*)))) FROM points)),
    w AS (SELECT greatest(quantile_cont(kth, 0.5), 1e-12) AS dc FROM (SELECT max(d) AS kth FROM near GROUP BY id)), rho AS (SELECT id, sum(exp(-((d / dc) ** 2))) AS rho FROM near, w GROUP BY id),
    up AS (SELECT p.id, p.nb, p.d, row_number() OVER (PARTITION BY p.id ORDER BY p.d, p.nb) AS place FROM pairs p JOIN rho a ON a.id = p.id JOIN rho b ON b.id = p.nb WHERE b.rho > a.rho OR b.rho = a.rho AND b.id < a.id)
    SELECT rho.id, round(rho, 6) AS rho, nb AS parent, round(d, 6) AS delta FROM rho LEFT JOIN (SELECT * FROM up WHERE place = 1) u ON u.id = rho.id""")
def density_parent(spark, sf_dir):
    return rounded(knn.density_parent(points(spark, sf_dir)))


@query(f"""
    WITH {POINTS}, t AS (SELECT label, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS x FROM points),
    m AS (SELECT label, i, count(*) AS n, avg(x) AS mu FROM t GROUP BY label, i), g AS (SELECT i, avg(x) AS mu FROM t GROUP BY i),
    d AS (SELECT m.label, m.i, m.n, m.mu - g.mu AS d FROM m JOIN g USING (i))
    SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(sum(a.n * a.d * b.d), 6) AS scatter FROM d a JOIN d b ON a.label = b.label AND b.i <= a.i GROUP BY a.i, b.i""")
def between_class_scatter(spark, sf_dir):
    return rounded(neighbourhood.between_class_scatter(points(spark, sf_dir)))


SAME = "CASE WHEN nl = label THEN 1.0 ELSE 0.0 END"


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, s AS (SELECT id, label, avg({SAME}) AS s FROM near GROUP BY 1, 2)
    SELECT label, CAST(sum((s >= 0.8)::INT) AS BIGINT) AS safe, CAST(sum((s < 0.8 AND s >= 0.4)::INT) AS BIGINT) AS border, CAST(sum((s < 0.4 AND s > 0)::INT) AS BIGINT) AS rare, CAST(sum((s = 0)::INT) AS BIGINT) AS outlier FROM s GROUP BY label""")
def region_types(spark, sf_dir):
    return neighbourhood.region_types(knn.neighbours(points(spark, sf_dir), 5))


SIMILARITY = """mix AS (SELECT label AS a, nl AS b, count(*) AS n FROM near GROUP BY 1, 2), share AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM mix),
    sim AS (SELECT x.a, y.b, CASE WHEN x.a = y.b THEN 1.0 ELSE (coalesce(p.p, 0) + coalesce(q.p, 0)) / 2 END AS similarity
            FROM (SELECT DISTINCT a FROM share) x CROSS JOIN (SELECT DISTINCT a AS b FROM share) y LEFT JOIN share p ON p.a = x.a AND p.b = y.b LEFT JOIN share q ON q.a = y.b AND q.b = x.a),
    safety AS (SELECT id, label, avg(similarity) AS safety FROM near JOIN sim ON label = a AND nl = b GROUP BY 1, 2)"""


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, {SIMILARITY} SELECT a, b, round(similarity, 6) AS similarity FROM sim")
def class_similarity(spark, sf_dir):
    return rounded(neighbourhood.class_similarity(knn.neighbours(points(spark, sf_dir), 5)))


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, {SIMILARITY} SELECT id, label, round(safety, 6) AS safety FROM safety")
def similarity_safety(spark, sf_dir):
    return rounded(neighbourhood.safety(knn.neighbours(points(spark, sf_dir), 5)))


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, {SIMILARITY}, g AS (SELECT CAST(round_even(avg(n), 0) AS BIGINT) AS goal FROM (SELECT count(*) AS n FROM points GROUP BY label))
    SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY round(safety, 9) DESC, id) AS r FROM safety) WHERE r <= (SELECT goal FROM g)""")
def soup_undersample(spark, sf_dir):
    """To the mean class size by safety, scores to nine places."""
    rows = points(spark, sf_dir)
    goal = sampling.class_targets(rows).first()["mean_target"]
    scores = rounded(neighbourhood.safety(knn.neighbours(rows, 5)), 9)
    return neighbourhood.drop_least_safe(rows, scores, goal).select("id", "label")


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, {SIMILARITY}, g AS (SELECT CAST(round_even(avg(n), 0) AS BIGINT) AS goal FROM (SELECT count(*) AS n FROM points GROUP BY label)),
    r AS (SELECT id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY round(safety, 9) DESC, id) - 1 AS r FROM safety)
    SELECT label, id, copies FROM (SELECT label, id, CAST(greatest(goal - n, 0) // n + CASE WHEN r < greatest(goal - n, 0) % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r, g) WHERE copies > 0""")
def soup_replicate(spark, sf_dir):
    rows = points(spark, sf_dir)
    goal = sampling.class_targets(rows).first()["mean_target"]
    return neighbourhood.repeat_safest(rows, rounded(neighbourhood.safety(knn.neighbours(rows, 5)), 9), goal)


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, s AS (SELECT id, label, avg({SAME}) AS safe FROM near GROUP BY 1, 2), g AS (SELECT CAST(round_even(avg(n), 0) AS BIGINT) AS goal FROM (SELECT count(*) AS n FROM points GROUP BY label))
    SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY ln(greatest({V.uniform_sql(42, 'id')}, 1e-12)) / (1 - safe + 1e-6), id) AS r FROM s) WHERE r <= (SELECT goal FROM g)""")
def roulette_delete(spark, sf_dir):
    rows = points(spark, sf_dir)
    return neighbourhood.roulette_delete(rows, knn.safe_level(rows, 5), sampling.class_targets(rows).first()["mean_target"])


DID = """did AS (SELECT id, label, coalesce(avg(CASE WHEN nl <> label THEN d END), 0) / greatest(coalesce(avg(CASE WHEN nl = label THEN d END), 0), 1e-12) AS did FROM near GROUP BY 1, 2)"""


@query(f"WITH {POINTS}, {PAIRS}, {nearest_sql(5)}, {DID} SELECT id, label, round(ln(greatest(did, 1e-12)), 6) AS log_did, did < avg(did) OVER (PARTITION BY label) AS hard FROM did")
def did_scores(spark, sf_dir):
    """As logs, as rows without neighbours of their class have very large scores."""
    got = neighbourhood.did(knn.neighbours(points(spark, sf_dir), 5))
    return rounded(got.select("id", "label", F.ln(F.greatest("did", F.lit(1e-12))).alias("log_did"), "hard"))


@query(f"""
    WITH w AS (SELECT o_orderkey AS id, o_orderpriority, floor(o_totalprice) AS weight FROM orders),
    s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY o_orderpriority) * 5000 AS share FROM w)
    SELECT o_orderpriority, id, CAST(floor(share) + CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY share - floor(share) DESC, id) <= 5000 - sum(floor(share)) OVER (PARTITION BY o_orderpriority) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM s""")
def largest_remainder(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", F.floor("o_totalprice").cast("double").alias("weight"))
    return neighbourhood.largest_remainder(rows, 5000, "id", "weight", "o_orderpriority")


@query("""
    WITH b AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders)
    SELECT o_orderkey, round((least(greatest(o_totalprice, lo), hi) - lo) / (hi - lo), 6) AS scaled FROM orders, b""")
def density_clip(spark, sf_dir):
    return rounded(neighbourhood.density_clipped(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "scaled"))


CENTRES = """c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS x FROM points) GROUP BY 1, 2) GROUP BY label),
    e AS (SELECT p.id, p.label, c.label AS k, list_sum(list_transform(list_zip(p.f, c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM points p CROSS JOIN c)"""


@query(f"""
    WITH {POINTS}, {CENTRES}, s AS (SELECT *, exp(min(d2) OVER (PARTITION BY id) - d2) AS x, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS r FROM e)
    SELECT id, label AS y, CAST(max(CASE WHEN r = 1 THEN k END) AS INTEGER) AS yhat, round(max(CASE WHEN r = 1 THEN x END) / sum(x), 6) AS top FROM s GROUP BY 1, 2""")
def nearest_centroid(spark, sf_dir):
    got = neighbourhood.nearest_centroid(points(spark, sf_dir))
    return rounded(got.select("id", "y", "yhat", F.array_max("proba").alias("top")))


@query(f"""
    WITH {POINTS}, {CENTRES}, w AS (SELECT id, label, 1 / greatest(d2, 1e-24) AS w FROM e), u AS (SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS u FROM w),
    h AS (SELECT id, label, -sum(u * ln(greatest(u, 1e-12))) AS entropy FROM u GROUP BY 1, 2)
    SELECT id, label, round(entropy, 6) AS entropy, entropy > (SELECT avg(entropy) + stddev_pop(entropy) FROM h) AS overlap FROM h""")
def membership_entropy(spark, sf_dir):
    return rounded(neighbourhood.membership_entropy(points(spark, sf_dir)))


@query(f"""
    WITH {POINTS}, {PAIRS}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM pairs WHERE label = 2 AND nl = 2) WHERE r <= 3),
    m AS (SELECT id, nb, list_transform(list_zip(f, g), lambda z: z[1] + 0.5 * (z[2] - z[1])) AS mid FROM own),
    n AS (SELECT m.id, m.nb, p.label, row_number() OVER (PARTITION BY m.id, m.nb ORDER BY sqrt(list_sum(list_transform(list_zip(m.mid, p.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), p.id) AS r FROM m CROSS JOIN points p)
    SELECT id, nb AS neighbour, round(avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END), 6) AS pure FROM n WHERE r <= 3 GROUP BY 1, 2""")
def midpoint_weights(spark, sf_dir):
    return rounded(neighbourhood.midpoint_weights(points(spark, sf_dir), 2, 3))


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5, 'mixed', 'label = 2')}, {nearest_sql(5, 'own', 'label = 2 AND nl = 2')}, {nearest_sql(1, 'far', 'label = 2 AND nl <> 2')},
    s AS (SELECT id, avg({SAME}) AS support FROM mixed GROUP BY id), d AS (SELECT id, 1 / greatest(avg(d), 1e-12) AS density FROM own GROUP BY id), i AS (SELECT id, min(d) AS isolation FROM far GROUP BY id),
    j AS (SELECT * FROM s JOIN d USING (id) JOIN i USING (id))
    SELECT id, round(0.4 * support + 0.3 * (density - min(density) OVER ()) / (max(density) OVER () - min(density) OVER ()) + 0.3 * (isolation - min(isolation) OVER ()) / (max(isolation) OVER () - min(isolation) OVER ()), 6) AS trust FROM j""")
def qc_trust(spark, sf_dir):
    return rounded(neighbourhood.trust(points(spark, sf_dir), 2, 5))


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5, where='label IN (0, 2) AND nl IN (0, 2)')}, o AS (SELECT id, label, sum((nl <> label)::INT) AS o FROM near GROUP BY 1, 2)
    SELECT id, label FROM o WHERE o >= 3 AND o < 5""")
def border_rows(spark, sf_dir):
    return neighbourhood.border_rows(points(spark, sf_dir), 2, 0)


@query(f"""
    WITH {POINTS}, {CENTRES}, s AS (SELECT id, label, k, exp(min(d2) OVER (PARTITION BY id) - d2) AS x FROM e), p AS (SELECT id, label, k, x / sum(x) OVER (PARTITION BY id) AS p FROM s),
    f AS (SELECT id, k AS class, 0.8 * p AS single, 0.2 / 3 AS rest FROM p)
    SELECT id, class, round(single + rest, 6) AS probability FROM f""")
def mass_from_probability(spark, sf_dir):
    """Probabilities discounted by 0.2 to the whole frame, and back."""
    rows = neighbourhood.nearest_centroid(points(spark, sf_dir))
    return rounded(dempster.pignistic(dempster.from_probability(rows, "proba", 0.8)))


@query(f"""
    WITH {POINTS}, t AS (SELECT id, label, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS x FROM points)
    SELECT a.label, CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM t a JOIN t b ON a.id = b.id AND b.i <= a.i GROUP BY a.label, a.i, b.i""")
def class_covariance(spark, sf_dir):
    return rounded(neighbourhood.class_covariance(points(spark, sf_dir)))


@query("""
    WITH r AS (SELECT l_quantity AS v, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem),
    g AS (SELECT v, sum((y = 0)::INT)::DOUBLE AS c0, sum((y = 1)::INT)::DOUBLE AS c1, sum((y = 2)::INT)::DOUBLE AS c2 FROM r GROUP BY v),
    w AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(c0) OVER d AS l0, sum(c1) OVER d AS l1, sum(c2) OVER d AS l2, sum(c0) OVER () AS t0, sum(c1) OVER () AS t1, sum(c2) OVER () AS t2 FROM g WINDOW d AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    k AS (SELECT (v + nx) / 2 AS threshold, ((l0 + l1 + l2) - (l0 * l0 + l1 * l1 + l2 * l2) / (l0 + l1 + l2)
        + ((t0 - l0) + (t1 - l1) + (t2 - l2)) - ((t0 - l0) ** 2 + (t1 - l1) ** 2 + (t2 - l2) ** 2) / ((t0 - l0) + (t1 - l1) + (t2 - l2))) / (t0 + t1 + t2) AS gini FROM w WHERE nx IS NOT NULL)
    SELECT threshold, round(gini, 6) AS gini FROM k ORDER BY k.gini, threshold LIMIT 1""")
def best_split(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"))
    return rounded(neighbourhood.best_split(rows, "l_quantity", "y", 3))


@query(f"""
    WITH o AS (SELECT o_orderkey, o_orderpriority, {FOLD_SQL} AS r FROM orders), g AS (SELECT o_orderpriority AS "set", count(*) AS goal FROM orders GROUP BY 1)
    SELECT "set", o_orderpriority AS label, count(*) AS n FROM o, g WHERE r <= goal GROUP BY 1, 2""")
def balanced_sets(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return neighbourhood.balanced_sets(rows).groupBy("set", "label").agg(F.count("*").alias("n"))


BALL = f"""own AS (SELECT *, row_number() OVER (ORDER BY {V.uniform_sql(42, 'id')}, id) AS place FROM points WHERE label = 2),
    far AS (SELECT id, max(d) AS radius FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM pairs WHERE label = 2 AND nl <> 2) WHERE r <= 5 GROUP BY id),
    slots AS (SELECT s AS slot, floor({V.uniform_sql(42, "'seed'", 's')} * (SELECT count(*) FROM own)) + 1 AS place FROM range(200) t(s)),
    way AS (SELECT slot, own.id, own.f, list_transform(range(len(own.f)), lambda i: sqrt(-2 * ln(greatest({V.uniform_sql(42, "'r'", 'slot', 'i')}, 1e-12))) * cos(2 * pi() * {V.uniform_sql(42, "'a'", 'slot', 'i')})) AS w FROM slots JOIN own USING (place)),
    made AS (SELECT slot, list_transform(list_zip(f, w), lambda z: z[1] + z[2] / sqrt(list_sum(list_transform(w, lambda x: x * x))) * (coalesce(radius, 1.0) * {V.uniform_sql(42, "'reach'", 'slot')} ** (1.0 / len(f)))) AS x FROM way LEFT JOIN far USING (id))"""


@query(f"WITH {POINTS}, {PAIRS}, {BALL} SELECT -1 - slot AS id, 2 AS label, {V.as_text_sql('x')} AS features FROM made")
def sphere_oversample(spark, sf_dir):
    got = neighbourhood.sphere_oversample(points(spark, sf_dir), 2, 200)
    return got.select("id", "label", V.as_text("features").alias("features"))


WAYS = f"""clean AS (SELECT e.* FROM region e WHERE NOT EXISTS (SELECT 1 FROM region z WHERE z.id = e.id AND z.r < e.r AND z.nl <> e.label
          AND list_sum(list_transform(list_zip(list_transform(list_zip(e.f, e.g), lambda q: (q[1] + q[2]) / 2), z.g), lambda v: (v[1] - v[2]) * (v[1] - v[2]))) < e.d * e.d / 4)),
    ways AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) - 1 AS way, count(*) OVER (PARTITION BY id) AS size FROM clean),
    own AS (SELECT *, row_number() OVER (ORDER BY {V.uniform_sql(42, 'id')}, id) AS place FROM points WHERE label = 2),
    slots AS (SELECT s AS slot, s % (SELECT count(*) FROM own) + 1 AS place FROM range(200) t(s)),
    drawn AS (SELECT slot, own.id, own.label, own.f AS f0, floor({V.uniform_sql(42, "'way'", 'slot')} * coalesce(size, 0)) AS way FROM slots JOIN own USING (place) LEFT JOIN (SELECT DISTINCT id, size FROM ways) USING (id)),
    made AS (SELECT slot, f0, coalesce(g, f0) AS g, coalesce(nl <> drawn.label, false) AS halved FROM drawn LEFT JOIN ways ON ways.id = drawn.id AND ways.way = drawn.way)"""


@query(f"""
    WITH {POINTS}, {PAIRS}, {region_sql('label = 2')}, {WAYS}
    SELECT -1 - slot AS id, 2 AS label, {V.as_text_sql(f"list_transform(range(len(f0)), lambda i: f0[i + 1] + CASE WHEN halved THEN 0.5 ELSE 1.0 END * {V.uniform_sql(42, chr(39) + 'gap' + chr(39), 'slot', 'i')} * (g[i + 1] - f0[i + 1]))")} AS features FROM made""")
def orem_generate(spark, sf_dir):
    return neighbourhood.orem_generate(points(spark, sf_dir), 2, 200).select("id", "label", V.as_text("features").alias("features"))


@query("""
    WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT CAST(CASE WHEN hi > lo THEN least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def equal_width_bins(spark, sf_dir):
    """Twenty bins of one width; the largest value belongs to the last."""
    rows = read(spark, sf_dir, "orders").select("o_totalprice")
    ends = rows.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19))).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""
    WITH o AS (SELECT o_orderkey, o_orderpriority, {V.uniform_sql(5, 'o_orderkey')} AS p FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p DESC, o_orderkey) = 1 AS best FROM o),
    r AS (SELECT *, row_number() OVER (ORDER BY best DESC, p DESC, o_orderkey) AS place FROM f WHERE p >= 0.5 OR best)
    SELECT o_orderkey, o_orderpriority FROM r WHERE place <= 500 OR best""")
def budgeted_selection(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", V.uniform(5, "o_orderkey").alias("p"))
    return selection.budgeted(rows, "p", 500, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


WEIGHED = f"""w AS (SELECT p.id, p.label, p.f, e.d2 AS wt FROM points p JOIN e ON e.id = p.id AND e.k = p.label WHERE p.label = 2), k AS (SELECT (SELECT count(*) FROM points WHERE label = 0) - count(*) AS want, count(*) AS n, sum(wt) + 1e-10 AS total FROM w),
    y AS (SELECT w.*, greatest(1, round_even(wt / total * want, 0))::BIGINT AS m, row_number() OVER (ORDER BY wt, id) AS r FROM w, k), o AS (SELECT want - sum(m) AS off FROM y, k GROUP BY want),
    s AS (SELECT y.*, off, k.n AS n, coalesce(sum(m - 1) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y, o, k),
    times AS (SELECT id, label, f, r, CASE WHEN off > 0 THEN m + CASE WHEN r > n - off THEN 1 ELSE 0 END ELSE m - least(m - 1, greatest(-off - before, 0)) END AS m FROM s),
    kin AS (SELECT * FROM (SELECT a.id, b.id AS nb, b.f AS g, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), b.id) AS near FROM w a JOIN w b ON a.id <> b.id) WHERE near <= 5),
    drawn AS (SELECT *, floor({V.uniform_sql(42, 'id', 'copy', "'near'")} * (SELECT least(5, n - 1) FROM k)) + 1 AS near FROM (SELECT *, unnest(range(1, CAST(m AS BIGINT) + 1)) AS copy FROM times))"""


@query(f"""
    WITH {POINTS}, {CENTRES}, {WEIGHED}
    SELECT CAST(-(r * 4294967296 + copy) AS BIGINT) AS id, label, {V.as_text_sql(f"list_transform(list_zip(f, g), lambda z: z[1] + {V.uniform_sql(42, 'id', 'copy', chr(39) + 'gap' + chr(39))} * (z[2] - z[1]))")} AS features FROM drawn JOIN kin USING (id, near)""")
def weighted_oversample(spark, sf_dir):
    """The smallest class to the size of the largest, weighed by squared distance to its centre."""
    rows = points(spark, sf_dir)
    centres = neighbourhood.centroids(rows)
    weighed = rows.join(F.broadcast(centres), "label").withColumn("w", V.squared_distance("features", "centre"))
    got = selection.weighted_oversample(weighed, "w", 2, sampling.class_targets(rows).first()["max_target"])
    return got.select("id", "label", V.as_text("features").alias("features"))


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(10, 'own', 'label = nl')}, e AS (SELECT id, nb, exp(min(d * d) OVER (PARTITION BY id) - d * d) AS e FROM own)
    SELECT id, nb AS neighbour, round(e / (sum(e) OVER (PARTITION BY id) + 1e-12), 6) AS p FROM e""")
def target_distribution(spark, sf_dir):
    return rounded(selection.target_distribution(points(spark, sf_dir)))


@query(f"""
    WITH {POINTS}, {PAIRS}, {CENTRES}, q AS (SELECT p.id, p.label, p.f AS s, c.centre AS z FROM points p JOIN c ON c.label = 2 WHERE p.label = 2),
    b AS (SELECT id, greatest(min(d) * 0.95, 1e-12) AS b FROM pairs WHERE nl <> label GROUP BY id), m AS (SELECT id, s, z, b, sqrt(list_sum(list_transform(list_zip(s, z), lambda t: (t[2] - t[1]) * (t[2] - t[1])))) AS far FROM q JOIN b USING (id))
    SELECT id, {V.as_text_sql('CASE WHEN far > b THEN list_transform(list_zip(s, z), lambda t: t[1] + (t[2] - t[1]) / far * b) ELSE z END')} AS features FROM m""")
def within_boundary(spark, sf_dir):
    """The centre of the smallest class as each of its rows may see it."""
    rows = points(spark, sf_dir)
    centre = neighbourhood.centroids(rows).where("label = 2").drop("label")
    asked = rows.where("label = 2").crossJoin(F.broadcast(centre)).select("id", "label", F.col("features").alias("seed"), F.col("centre").alias("features"))
    return selection.within_boundary(asked, rows).select("id", V.as_text("features").alias("features"))


STRATEGIES = ("spe", "density", "margin", "boundary", "entropy")


@query(f"""
    WITH {POINTS}, {CENTRES}, x AS (SELECT id, label, k, exp(min(d2) OVER (PARTITION BY id) - d2) AS x FROM e), p AS (SELECT id, label, k, x / sum(x) OVER (PARTITION BY id) AS p FROM x),
    h AS (SELECT id, label, (1 - max(CASE WHEN k = label THEN p END) + max(CASE WHEN k <> label THEN p END)) / 2 AS h, -sum(p * ln(p + 1e-12)) / ln(count(*)) AS entropy, {V.uniform_sql(6, 'id')} AS density FROM p GROUP BY id, label),
    d AS (SELECT *, least(greatest(h * (0.55 + 0.45 * density), 0), 1) AS dense FROM h)
    SELECT id, label, round(h, 6) AS spe, round(dense, 6) AS density, round(h ** 0.75, 6) AS margin, round(dense ** 0.75, 6) AS boundary, round(0.5 * h + 0.5 * entropy, 6) AS entropy FROM d""")
def hardness_strategies(spark, sf_dir):
    """Margin hardness under the nearest centre, by pacing strategy; densities are drawn."""
    rows = neighbourhood.nearest_centroid(points(spark, sf_dir)).withColumnRenamed("y", "label")
    h = V.margin_hardness("proba", "label")
    return rounded(rows.select("id", "label", *[V.paced_hardness(h, s, V.uniform(6, "id"), "proba").alias(s) for s in STRATEGIES]))


# -- resampling and learners -------------------------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT CASE WHEN label < 6 THEN 0 WHEN label < 9 THEN 1 ELSE 2 END AS label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT label, (SELECT max(n) FROM c) AS n FROM c""")
def smote_counts(spark, sf_dir):
    """Class sizes after SMOTE: all as large as the largest."""
    return sampling.smote(points(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


def smote_sql(rows: str, k: int) -> str:
    """CTEs from rows (id, label, f) to `lifted` (id, label, x)."""
    u = lambda name: V.uniform_sql(42, "label", "slot", f"'{name}'")
    gap = "sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {V.uniform_sql(42, 'id')}, id) - 1 AS place FROM {rows}),
    sizes AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM {rows} GROUP BY label), slots AS (SELECT label, n, unnest(range(most - n)) AS slot FROM sizes),
    drawn AS (SELECT s.label, s.slot, p.id, p.f FROM (SELECT *, least(floor({u('seed')} * n), n - 1) AS place FROM slots) s JOIN numbered p ON p.label = s.label AND p.place = s.place),
    kin AS (SELECT * FROM (SELECT a.id, b.id AS nb, b.f AS g, row_number() OVER (PARTITION BY a.id ORDER BY {gap}, b.id) AS r FROM {rows} a JOIN {rows} b ON a.label = b.label AND a.id <> b.id) WHERE r <= {k}),
    ranked AS (SELECT d.*, floor({u('near')} * h.have) + 1 AS r FROM drawn d LEFT JOIN (SELECT id, max(r) AS have FROM kin GROUP BY id) h USING (id)),
    lifted AS (SELECT id, label, f AS x FROM {rows} UNION ALL
               SELECT -(label::BIGINT * 1099511627776 + slot + 1), label, list_transform(list_zip(f, coalesce(g, f)), lambda z: z[1] + {u('gap')} * (z[2] - z[1])) FROM ranked LEFT JOIN kin USING (id, r))"""


LIFTED = f"SELECT id, label, {V.as_text_sql('x')} AS features FROM lifted"


@query(f"WITH {POINTS}, {smote_sql('points', 5)} {LIFTED}")
def smote(spark, sf_dir):
    return sampling.smote(points(spark, sf_dir)).select("id", "label", V.as_text("features").alias("features"))


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(7)}, rate AS (SELECT id, label, CASE WHEN sum(d) > 0 THEN sum(CASE WHEN nl = label THEN d ELSE 0 END) / sum(d) ELSE 0 END AS rate FROM near GROUP BY 1, 2),
    inverse AS (SELECT id, label, 1 / greatest(rate, 1e-6) AS v FROM rate), big AS (SELECT label FROM points GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
    marked AS (SELECT id, label, v / max(v) OVER (PARTITION BY label) AS p, row_number() OVER (PARTITION BY label ORDER BY v, id) AS place FROM inverse),
    kept AS (SELECT p.* FROM points p JOIN marked m USING (id) WHERE m.label <> (SELECT label FROM big) OR m.place = 1 OR {V.uniform_sql(42, 'p.id')} >= m.p), {smote_sql('kept', 7)} {LIFTED}""")
def up_down_sampling(spark, sf_dir):
    return sampling.up_down(points(spark, sf_dir)).select("id", "label", V.as_text("features").alias("features"))


def _resampled(method: str, **settings):
    def run(spark, sf_dir):
        rows = points(spark, sf_dir).withColumn("fold", F.lit(1))
        return resamplers.resample(rows, method, ["fold"], **settings).groupBy("fold", "label").agg(F.count("*").alias("n"), F.avg(F.get("features", F.lit(0))).alias("mean_first"))

    return run


for _name in ("EB-SMOTE", "glos", "mc_ccr", "mc_rbo", "mdo", "nromm", "orem_m", "QC-SMOTE", "shsampler", "smom", "soup"):
    QUERIES[f"resample_{_name.lower().replace('-', '_')}"] = _resampled(_name)
BALANCED_SQL = """
    WITH c AS (SELECT CASE WHEN label < 6 THEN 0 WHEN label < 9 THEN 1 ELSE 2 END AS label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT 1 AS fold, label, CAST({goal} AS BIGINT) AS n FROM c"""


def _sizes(method: str, goal: str):
    def run(spark, sf_dir):
        return QUERIES[f"resample_{method}"](spark, sf_dir).select("fold", "label", "n")

    QUERIES[f"resampled_sizes_{method}"] = run
    ORACLE_SQL[f"resampled_sizes_{method}"] = BALANCED_SQL.format(goal=goal)


for _name in ("glos", "mdo", "orem_m", "qc_smote", "smom"):
    _sizes(_name, "(SELECT max(n) FROM c)")
for _name in ("shsampler", "soup"):
    _sizes(_name, "(SELECT round_even(avg(n), 0) FROM c)")


@query()
def benchmark_grid(spark, sf_dir):
    """All learners with quick settings on two folds of the points; their results by metric."""
    rows = sampling.stratified_folds(small_points(spark, sf_dir), 2).withColumnRenamed("fold", "own")
    folds = rows.withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.lit("points").alias("dataset"), "fold", F.when(F.col("fold") == F.col("own"), "test").otherwise("train").alias("split"), "id", "features", F.col("label").alias("label_idx")
    )
    return benchmark.results(benchmark.predictions(folds, list(benchmark.LEARNERS), smoke=True), "points").drop("Runtime_mean", "Runtime_std")


# -- metrics: the line items by line number as models, with a probability from their numbers ---------------------------

PRED = """pred AS (
    SELECT l_linenumber AS model, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
           a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2,
           CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS yhat
    FROM (SELECT *, (1 + l_partkey % 13)::DOUBLE AS a, (1 + l_suppkey % 11)::DOUBLE AS b, (1 + l_orderkey % 7)::DOUBLE AS c FROM lineitem))"""


def predictions(spark, sf_dir):
    a, b, c = ((1 + F.col(x) % m).cast("double") for x, m in (("l_partkey", 13), ("l_suppkey", 11), ("l_orderkey", 7)))
    rows = read(spark, sf_dir, "lineitem")
    proba = F.transform(F.array(a, b, c), lambda x: x / (a + b + c))
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rows.select(F.col("l_linenumber").alias("model"), y.alias("y"), proba.alias("proba")).withColumn("yhat", V.argmax("proba"))


@query(f"WITH {PRED} SELECT model, y, yhat, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["model"])


@query(f"WITH {PRED}, c AS (SELECT y, yhat, count(*) AS n FROM pred GROUP BY ALL) SELECT y, yhat, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c")
def confusion_shares(spark, sf_dir):
    return metrics.row_normalised(metrics.confusion(predictions(spark, sf_dir), ["model"]), []).select("y", "yhat", F.col("n").cast("decimal(38,0)").cast("long").alias("n"), "share")


@query(f"""
    WITH {PRED}, k AS (SELECT model, unnest([0, 1, 2]) AS c FROM (SELECT DISTINCT model FROM pred)),
    t AS (SELECT k.model, k.c, sum(CASE WHEN y = c AND yhat = c THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y = c THEN 1 ELSE 0 END)::DOUBLE AS act,
                 sum(CASE WHEN yhat = c THEN 1 ELSE 0 END)::DOUBLE AS prd, count(*)::DOUBLE AS s FROM k JOIN pred USING (model) GROUP BY k.model, k.c)
    SELECT model, round(sum(tp) / max(s), 6) AS "Accuracy", round(avg(CASE WHEN prd > 0 THEN tp / prd ELSE 0 END), 6) AS "Precision", round(avg(CASE WHEN act > 0 THEN tp / act ELSE 0 END), 6) AS "Recall",
           round(avg(2 * tp / (act + prd)), 6) AS "F1", round(exp(avg(ln(CASE WHEN tp > 0 THEN tp / act ELSE 1e-3 END))), 6) AS "GMean",
           round((sum(tp) * max(s) - sum(act * prd)) / sqrt((max(s) * max(s) - sum(prd * prd)) * (max(s) * max(s) - sum(act * act))), 6) AS "MCC",
           round(sum((1 + 0.5 * (tp / act - ((s - act) - (prd - tp)) / (s - act))) * tp / act) / 3, 6) AS "IBA",
           round((sum(tp) / max(s) - sum(act * prd) / (max(s) * max(s))) / (1 - sum(act * prd) / (max(s) * max(s))), 6) AS "Kappa"
    FROM t GROUP BY model""")
def confusion_metrics(spark, sf_dir):
    return rounded(metrics.from_confusion(metrics.confusion(predictions(spark, sf_dir), ["model"]), ["model"], 3))


@query(f"""
    WITH {PRED}, l AS (SELECT model, unnest([{{'k': 0, 's': p0, 'p': (y = 0)::INT}}, {{'k': 1, 's': p1, 'p': (y = 1)::INT}}, {{'k': 2, 's': p2, 'p': (y = 2)::INT}}], recursive := true) FROM pred),
    r AS (SELECT *, rank() OVER (PARTITION BY model, k ORDER BY s) + (count(*) OVER (PARTITION BY model, k, s) - 1) / 2.0 AS rk FROM l),
    u AS (SELECT model, k, (sum(CASE WHEN p = 1 THEN rk ELSE 0 END) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (count(*) - sum(p))) AS auc FROM r GROUP BY model, k),
    g AS (SELECT model, k, s, sum(p) AS p, count(*) AS n FROM l GROUP BY model, k, s),
    h AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS above FROM g WINDOW w AS (PARTITION BY model, k ORDER BY s DESC)),
    a AS (SELECT model, k, sum(p * tp::DOUBLE / above) / sum(p) AS ap FROM h GROUP BY model, k)
    SELECT u.model, round(avg(auc), 6) AS "AUC", round(avg(ap), 6) AS "AUPRC" FROM u JOIN a USING (model, k) GROUP BY u.model""")
def ranking_metrics(spark, sf_dir):
    return rounded(metrics.ranking(predictions(spark, sf_dir), ["model"], 3))


# -- report: a result table from line items ----------------------------------------------------------------------------

CELLS = """cells AS (
    SELECT 'model_' || l_linenumber AS "Model", 'IR' || ((l_suppkey % 3 + 1) * 10) || '_set' || (l_suppkey % 12) AS "Dataset",
           CASE l_suppkey % 3 WHEN 0 THEN 'keel' WHEN 1 THEN 'bearing' ELSE 'heart' END AS "Source",
           CASE WHEN l_linenumber = 3 AND l_suppkey % 12 = 5 THEN NULL ELSE avg(l_quantity) / 50 END AS "F1", avg(l_partkey % 97) / 97 AS "GMean", avg(l_orderkey % 89) / 89 AS "AUC",
           avg(l_partkey % 83) / 83 AS "AUPRC", count(*)::DOUBLE AS "Runtime", CASE WHEN l_linenumber = 6 AND l_suppkey % 12 = 1 THEN 'stopped' ELSE ' ' END AS "Error"
    FROM lineitem GROUP BY l_linenumber, l_suppkey % 12, l_suppkey % 3)"""
BAD = """("F1" IS NULL OR trim("Error") <> '')"""


def result_cells(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumns({"n": F.col("l_suppkey") % 12, "m": F.col("l_suppkey") % 3})
    one = rows.groupBy("l_linenumber", "n", "m").agg(
        (F.avg("l_quantity") / 50).alias("F1"), (F.avg(F.col("l_partkey") % 97) / 97).alias("GMean"), (F.avg(F.col("l_orderkey") % 89) / 89).alias("AUC"),
        (F.avg(F.col("l_partkey") % 83) / 83).alias("AUPRC"), F.count("*").cast("double").alias("Runtime"),
    )
    return one.select(
        F.concat(F.lit("model_"), "l_linenumber").alias("Model"), F.concat(F.lit("IR"), (F.col("m") + 1) * 10, F.lit("_set"), "n").alias("Dataset"),
        F.element_at(F.array(F.lit("keel"), F.lit("bearing"), F.lit("heart")), (F.col("m") + 1).cast("int")).alias("Source"),
        F.when(~((F.col("l_linenumber") == 3) & (F.col("n") == 5)), F.col("F1")).alias("F1"), "GMean", "AUC", "AUPRC", "Runtime",
        F.when((F.col("l_linenumber") == 6) & (F.col("n") == 1), "stopped").otherwise(" ").alias("Error"),
    )


def _rank_sql(m: str) -> str:
    way = "ASC" if m == "Runtime" else "DESC"
    return f"""rank() OVER (PARTITION BY "Group" ORDER BY "{m}" {way}) + (count(*) OVER (PARTITION BY "Group", "{m}") - 1) / 2.0 AS "{m}_rank\""""


RANKED_SQL = f"""
    WITH {CELLS}, g AS (
        SELECT *, unnest(list_filter(['Overall', "Source", CASE WHEN "Source" = 'bearing' THEN 'Bearing_IR' || regexp_extract("Dataset", '^IR([0-9]+)_', 1) END], lambda x: x IS NOT NULL)) AS "Group" FROM cells),
    w AS (SELECT "Group", count(DISTINCT "Dataset") AS required FROM g GROUP BY 1),
    m AS (SELECT "Group", "Model", count(DISTINCT CASE WHEN NOT {BAD} THEN "Dataset" END) AS n_datasets, avg("F1") AS "F1", avg("GMean") AS "GMean", avg("AUC") AS "AUC", avg("AUPRC") AS "AUPRC", avg("Runtime") AS "Runtime" FROM g GROUP BY 1, 2),
    d AS (SELECT m.* FROM m JOIN w USING ("Group") WHERE n_datasets = required),
    r AS (SELECT *, {", ".join(_rank_sql(m) for m in report.METRICS)} FROM d)
    SELECT "Group", "Model", n_datasets, {", ".join(f'round("{m}", 6) AS "{m}"' for m in report.METRICS)}, {", ".join(f'CAST("{m}_rank" AS DOUBLE) AS "{m}_rank"' for m in report.METRICS)},
        CAST(("F1_rank" + "GMean_rank" + "AUC_rank" + "AUPRC_rank") / 4.0 AS DOUBLE) AS "Avg_Rank_excl_Runtime",
        CAST(("F1_rank" + "GMean_rank" + "AUC_rank" + "AUPRC_rank" + "Runtime_rank") / 5.0 AS DOUBLE) AS "Avg_Rank_incl_Runtime" FROM r"""


@query(RANKED_SQL)
def report_rankings(spark, sf_dir):
    return rounded(report.rankings(report.with_group(result_cells(spark, sf_dir))))


@query(f"""WITH {CELLS} SELECT "Model", "Dataset" FROM cells WHERE {BAD}""")
def failed_cells(spark, sf_dir):
    return report.failed_cells(result_cells(spark, sf_dir))


@query(f"""
    WITH {CELLS}, s AS (SELECT "Dataset", min("Source") AS "Source" FROM cells GROUP BY 1), m AS (SELECT DISTINCT "Model" FROM cells)
    SELECT m."Model", s."Source", count(*) AS n FROM m CROSS JOIN s WHERE NOT EXISTS (
        SELECT 1 FROM cells c WHERE c."Model" = m."Model" AND c."Dataset" = s."Dataset" AND NOT {BAD}) GROUP BY 1, 2""")
def missing_by_source(spark, sf_dir):
    return report.missing_by_source(result_cells(spark, sf_dir))


@query(f"""
    WITH {CELLS}, d AS (SELECT DISTINCT "Dataset" FROM cells), m AS (SELECT 'model_' || unnest(range(1, 10)) AS "Model")
    SELECT m."Model", d."Dataset" FROM m CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c."Model" = m."Model" AND c."Dataset" = d."Dataset" AND trim(c."Error") = '')""")
def open_cells(spark, sf_dir):
    """What a resumed run of nine models has left to do."""
    cells = result_cells(spark, sf_dir)
    catalog = cells.select(F.col("Dataset").alias("name"), F.lit("").alias("source")).distinct()
    return report.open_cells(benchmark.grid(catalog, [f"model_{i}" for i in range(1, 10)]).select("Model", "Dataset"), cells)


@query("""
    SELECT "Model", "Dataset", last_key FROM (SELECT l_linenumber AS "Model", l_suppkey AS "Dataset", l_orderkey AS last_key, row_number() OVER (PARTITION BY l_linenumber, l_suppkey
        ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_orderkey DESC) AS r FROM lineitem) WHERE r = 1""")
def last_results(spark, sf_dir):
    """The last line item of each number and supplier; returned ones count as errors."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("Model"), F.col("l_suppkey").alias("Dataset"), F.col("l_orderkey").alias("last_key"), F.when(F.col("l_returnflag") == "R", "returned").alias("Error"))
    return report.last_results(rows, "last_key").drop("Error")


@query("""
    SELECT "Model", _orig_model, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '2-HIGH' THEN 'top' ELSE o_orderpriority END AS "Model", o_orderpriority AS _orig_model FROM orders)
    WHERE "Model" <> _orig_model GROUP BY 1, 2""")
def renamed_models(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("Model"))
    return report.renamed(report.normalise_models(rows, {"1-URGENT": "top", "2-HIGH": "top"}))


MEANS_SQL = ", ".join(f"('{m}', {f}, {g}, {a}, {p})" for m, f, g, a, p in baselines.MEANS)


@query(f"""
    WITH {CELLS}, m AS (SELECT CASE "Model" WHEN 'model_1' THEN 'SPE' ELSE "Model" END AS "Model", avg("F1") AS "F1", avg("GMean") AS "GMean", avg("AUC") AS "AUC", avg("AUPRC") AS "AUPRC" FROM cells GROUP BY 1),
    b AS (SELECT * FROM (VALUES {MEANS_SQL}) AS t("Model", "F1", "GMean", "AUC", "AUPRC"))
    SELECT "Model", round("F1", 6) AS "F1", round("GMean", 6) AS "GMean", round("AUC", 6) AS "AUC", round("AUPRC", 6) AS "AUPRC" FROM (SELECT * FROM m UNION ALL SELECT * FROM b WHERE "Model" NOT IN (SELECT "Model" FROM m))""")
def means_with_baselines(spark, sf_dir):
    """The cells' means, one model under a published name, with the published means of all others."""
    cells = report.normalise_models(result_cells(spark, sf_dir), {"model_1": "SPE"})
    means = cells.groupBy("Model").agg(*[F.avg(m).alias(m) for m in report.METRICS if m != "Runtime"])
    return rounded(report.with_baselines(means, baselines.baselines(spark)))


@query("""
    WITH m AS (SELECT DISTINCT event_type AS "Model" FROM events), t AS (SELECT min(title) AS "Paper", replace(lower(title), '_', '') AS name FROM (SELECT unnest(['CLI_CK', 'View', 'view_', 'none']) AS title) GROUP BY 2)
    SELECT "Model", coalesce("Paper", "Model") AS "Paper" FROM m LEFT JOIN t ON name = replace(replace(lower("Model"), '_', ''), '-', '')""")
def paper_names(spark, sf_dir):
    models = read(spark, sf_dir, "events").select(F.col("event_type").alias("Model")).distinct()
    titles = spark.createDataFrame([(x,) for x in ("CLI_CK", "View", "view_", "none")], "Title string")
    return report.paper_names(models, titles)


# -- functions ---------------------------------------------------------------------------------------------------------


@query(f"""
    WITH {PRED} SELECT model, y, round(avg(1 - CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END), 6) AS absolute, round(avg((1 - CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) ** 2), 6) AS squared,
        round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS entropy,
        round(avg((1 - CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + CASE y WHEN 0 THEN greatest(p1, p2) WHEN 1 THEN greatest(p0, p2) ELSE greatest(p0, p1) END) / 2), 6) AS margin
    FROM pred GROUP BY model, y""")
def hardness(spark, sf_dir):
    own = F.get("proba", F.col("y"))
    kinds = [F.avg(V.hardness(own, k)).alias(k) for k in ("absolute", "squared", "entropy")]
    return rounded(predictions(spark, sf_dir).groupBy("model", "y").agg(*kinds, F.avg(V.margin_hardness("proba", "y")).alias("margin")))


@query(f"""
    WITH {PRED}, c AS (SELECT model, yhat, sum((y = 0)::INT)::DOUBLE AS a, sum((y = 1)::INT)::DOUBLE AS b, sum((y = 2)::INT)::DOUBLE AS c FROM pred GROUP BY 1, 2)
    SELECT model, yhat, round(log2(a + b + c) - (CASE WHEN a > 0 THEN a * log2(a) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b) ELSE 0 END + CASE WHEN c > 0 THEN c * log2(c) ELSE 0 END) / (a + b + c), 6) AS bent FROM c""")
def balance_entropy(spark, sf_dir):
    sums = [F.sum((F.col("y") == c).cast("double")) for c in range(3)]
    return rounded(predictions(spark, sf_dir).groupBy("model", "yhat").agg(F.array(*sums).alias("c")).select("model", "yhat", V.balance_entropy("c").alias("bent")))


@query(f"""
    WITH {PRED}, h AS (SELECT model, CAST(least(floor((1 - CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) * 10), 9) AS BIGINT) AS bin FROM pred)
    SELECT model, bin, count(*) AS n FROM h GROUP BY 1, 2""")
def loss_histogram(spark, sf_dir):
    own = F.get("proba", F.col("y"))
    return predictions(spark, sf_dir).groupBy("model", F.least(F.floor((1 - own) * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""
    WITH {PRED}, m AS (SELECT model, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM pred GROUP BY model), q AS (SELECT model, 0.6 * p0 AS a0, 0.6 * p1 AS a1, 0.6 * p2 AS a2, 0.3 * p2 AS b0, 0.3 * p0 AS b1, 0.3 * p1 AS b2 FROM m),
    k AS (SELECT *, a0 * (b1 + b2) + a1 * (b0 + b2) + a2 * (b0 + b1) AS k FROM q),
    f AS (SELECT model, (a0 * b0 + a0 * 0.7 + 0.4 * b0) / (1 - k) AS m0, (a1 * b1 + a1 * 0.7 + 0.4 * b1) / (1 - k) AS m1, (a2 * b2 + a2 * 0.7 + 0.4 * b2) / (1 - k) AS m2, 0.28 / (1 - k) AS all_ FROM k)
    SELECT model, CAST(c AS INTEGER) AS class, round(CASE c WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END + all_ / 3, 6) AS probability FROM f, (SELECT unnest([0, 1, 2]) AS c)""")
def dempster_pignistic(spark, sf_dir):
    """Two sources of evidence for each model's class shares, combined and turned into probabilities."""
    shares = predictions(spark, sf_dir).groupBy(F.col("model").alias("id")).agg(*[F.avg(F.get("proba", F.lit(c))).alias(f"p{c}") for c in range(3)])
    rows = shares.select("id", F.array("p0", "p1", "p2").alias("one"), F.array("p2", "p0", "p1").alias("two"))
    both = dempster.combine(dempster.from_probability(rows, "one", 0.6), dempster.from_probability(rows, "two", 0.3))
    return rounded(dempster.pignistic(both).withColumnRenamed("id", "model"))


@query("""
    WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT window_start, count(*) AS classes, round(max(n) / min(n), 6) AS ir FROM b GROUP BY 1""")
def stream_imbalance(spark, sf_dir):
    """The streaming monitor's plan over the events as a batch."""
    return rounded(monitor.imbalance(monitor.class_balance(read(spark, sf_dir, "events"), "ts", "event_type")))
