"""Queries of ensembles, forests and generators that work on whole tables, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cascade, clusters, elm, ensembles, forest, generators, lifting
from .queries import PAIRS, POINTS, QUERIES, nearest_sql, points, query, read, rounded

FLAGS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
LINES = "lines AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_linenumber < 4 THEN 0 WHEN l_linenumber < 6 THEN 1 ELSE 2 END AS label, l_quantity / 51.0::DOUBLE AS h FROM lineitem)"


def lines(spark, sf_dir) -> DataFrame:
    """Line items as rows: an id of their own, the return flag as label, a number in [0, 1) as hardness, four features of few values."""
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), label.alias("label"), (F.col("l_quantity") / 51.0).alias("h"),
        F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_linenumber", "l_discount", "l_tax")]).alias("features"),
    )


def uneven_lines(spark, sf_dir) -> DataFrame:
    """The same with labels of uneven classes, by line number."""
    at = F.get("features", F.lit(1))
    return lines(spark, sf_dir).withColumn("label", F.when(at < 4, 0).when(at < 6, 1).otherwise(2))


def answers(scored: DataFrame) -> DataFrame:
    """id, yhat and the probabilities as text."""
    return scored.select("id", V.argmax("proba").alias("yhat"), V.as_text("proba").alias("proba"))


# -- balanced forests ----------------------------------------------------------------------------------------------------


@query(f"""
    WITH v AS (
        SELECT {FLAGS} AS label, unnest([0, 1, 2, 3]) AS feature,
               unnest([l_quantity::DOUBLE, l_linenumber::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS x FROM lineitem),
    c AS (SELECT feature, x, sum((label = 0)::INT) AS a, sum((label = 1)::INT) AS b, sum((label = 2)::INT) AS c FROM v GROUP BY ALL),
    k AS (
        SELECT feature, (x + lead(x) OVER w) / 2 AS threshold, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(c) OVER w AS lc,
               sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb, sum(c) OVER (PARTITION BY feature) AS tc
        FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)),
    r AS (SELECT *, [la / ta, lb / tb, lc / tc] AS l, [(ta - la) / ta, (tb - lb) / tb, (tc - lc) / tc] AS g FROM k WHERE threshold IS NOT NULL),
    e AS (
        SELECT *, list_transform([[1.0::DOUBLE, 1.0, 1.0], l, g], lambda q: log2(list_sum(q)) - list_sum(list_transform(q, lambda s: CASE WHEN s > 0 THEN s * log2(s) ELSE 0 END)) / list_sum(q)) AS bent FROM r),
    n AS (SELECT *, round(bent[1] - (la + lb + lc) / (ta + tb + tc) * bent[2] - (ta + tb + tc - la - lb - lc) / (ta + tb + tc) * bent[3], 9) AS gain FROM e
          WHERE la + lb + lc >= 2 AND ta + tb + tc - la - lb - lc >= 2)
    SELECT CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold, CAST(la AS DOUBLE) AS left_0, CAST(lb AS DOUBLE) AS left_1, CAST(lc AS DOUBLE) AS left_2
    FROM n ORDER BY gain DESC, feature, threshold LIMIT 1""")
def balanced_split(spark, sf_dir):
    """The first cut of a tree under balance entropy, over all rows and features."""
    rows = lines(spark, sf_dir)
    nodes = forest.node_table(rows, forest.grow(rows, 1, 1, mtry=4, bootstrap=False))
    root, left = nodes.where("node = 0").select("feature", "threshold", "left"), nodes.select(F.col("node").alias("left"), "counts")
    return rounded(root.join(left, "left").select("feature", "threshold", *[F.get("counts", F.lit(c)).alias(f"left_{c}") for c in range(3)]))


@query()
def balanced_forest(spark, sf_dir):
    """200 trees on bootstraps that hold every class; the rows' mean class shares."""
    rows = points(spark, sf_dir)
    return answers(forest.predicted(forest.spread(rows), forest.grow(rows, 200)))


@query()
def deep_balanced_cascade(spark, sf_dir):
    rows = points(spark, sf_dir)
    return answers(cascade.predict(rows, cascade.fit(rows)))


# -- self-paced samples and ensembles ------------------------------------------------------------------------------------

TAKEN = f"""{LINES},
    target AS (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM lines GROUP BY label)),
    bins AS (SELECT label, least(floor(h * 20), 19)::INT AS bin, avg(h) AS h, count(*) AS have FROM lines GROUP BY 1, 2),
    w AS (SELECT *, 1 / (h + tan(pi() * 3 / 18)) AS w, sum(have) OVER (PARTITION BY label) AS n FROM bins),
    s AS (SELECT *, w / (sum(w) OVER (PARTITION BY label) + 1e-12) AS share FROM w),
    f AS (SELECT *, least(have, floor(share * target))::BIGINT AS first FROM s, target),
    l AS (SELECT *, least(n, target) - sum(first) OVER (PARTITION BY label) AS lack FROM f),
    spare AS (SELECT label, bin, share, lack, unnest(generate_series(1, least(have - first, greatest(lack, 1))::BIGINT)) AS turn FROM l WHERE have > first),
    more AS (SELECT label, bin, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, share DESC, bin) AS p FROM spare) WHERE p <= lack GROUP BY 1, 2),
    taken AS (SELECT l.label, l.bin, l.have, CASE WHEN n <= target THEN l.have ELSE first + coalesce(more, 0) END AS take FROM l LEFT JOIN more USING (label, bin))"""


def _target(rows: DataFrame) -> int:
    return rows.groupBy("label").count().agg(F.min("count")).first()[0]


@query(f"WITH {TAKEN} SELECT label, bin, have, CAST(take AS BIGINT) AS take FROM taken")
def paced_bins(spark, sf_dir):
    """What the third of ten rounds takes of each hardness bin."""
    rows = uneven_lines(spark, sf_dir)
    return ensembles.hardness_bins(rows, "h", 3, 10, _target(rows))


@query(f"""
    WITH {TAKEN}, placed AS (
        SELECT id, label, least(floor(h * 20), 19)::INT AS bin, row_number() OVER (PARTITION BY label, least(floor(h * 20), 19)::INT ORDER BY {V.uniform_sql(45, 'id')}, id) AS place FROM lines)
    SELECT id, label FROM placed JOIN taken USING (label, bin) WHERE place <= take""")
def paced_round(spark, sf_dir):
    """The rows of that round's sample."""
    rows = uneven_lines(spark, sf_dir)
    return ensembles.paced_sample(rows, "h", 3, 10, _target(rows)).select("id", "label")


@query(f"""
    WITH {LINES}, b AS (SELECT id, label, least(floor(h * 20), 19)::INT AS bin FROM lines),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label, bin ORDER BY {V.uniform_sql(42, 'id')}, id) AS place, count(*) OVER (PARTITION BY label, bin) AS have FROM b),
    slots AS (SELECT label, bin, have, unnest(generate_series(0, have // 2)) AS draw FROM (SELECT DISTINCT label, bin, have FROM placed)),
    drawn AS (SELECT label, bin, draw, least(floor({V.uniform_sql(42, 'label', 'bin', 'draw')} * have) + 1, have)::BIGINT AS place FROM slots)
    SELECT d.label, d.bin, draw, id FROM drawn d JOIN placed p USING (label, bin, place)""")
def bins_with_replacement(spark, sf_dir):
    """Half as many draws, and one, as each hardness bin has rows."""
    rows = uneven_lines(spark, sf_dir).select("id", "label", F.least(F.floor(F.col("h") * 20), F.lit(19)).cast("int").alias("bin"))
    wanted = rows.groupBy("label", "bin").agg((F.expr("count(*) div 2") + 1).alias("n"))
    return ensembles.sample_with_replacement(rows, wanted, ["label", "bin"]).select("label", "bin", "draw", "id")


@query()
def self_paced_ensemble(spark, sf_dir):
    """30 forests of 30 trees on samples that move from easy to evenly hard rows."""
    rows = points(spark, sf_dir)
    return answers(ensembles.fit_self_paced(rows).predict(forest.spread(rows)))


# -- boosting by margins -------------------------------------------------------------------------------------------------


def _steps(spark, sf_dir) -> DataFrame:
    """Points of two features in steps of a half: few values, so that SQL can try all cuts."""
    return points(spark, sf_dir).withColumn("features", F.transform(F.slice("features", 1, 2), lambda x: F.round(x * 2) / 2))


def _stump_sql(i: int, state: str) -> str:
    """The stump of a round: its cut of least weighted Gini impurity, its sides' classes, its vote, and the weights after it."""
    return f"""
    v{i} AS (SELECT feature, x, label, w FROM (SELECT label, w, unnest([0, 1]) AS feature, unnest(f) AS x FROM {state})),
    c{i} AS (SELECT feature, x, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS a, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS b, sum(CASE WHEN label = 2 THEN w ELSE 0 END) AS c FROM v{i} GROUP BY ALL),
    k{i} AS (
        SELECT feature, (x + lead(x) OVER o) / 2 AS threshold, sum(a) OVER o AS la, sum(b) OVER o AS lb, sum(c) OVER o AS lc,
               sum(a) OVER p - sum(a) OVER o AS ra, sum(b) OVER p - sum(b) OVER o AS rb, sum(c) OVER p - sum(c) OVER o AS rc
        FROM c{i} WINDOW o AS (PARTITION BY feature ORDER BY x), p AS (PARTITION BY feature)),
    s{i} AS (
        SELECT feature, threshold, CASE WHEN la >= lb AND la >= lc THEN 0 WHEN lb >= lc THEN 1 ELSE 2 END AS low, CASE WHEN ra >= rb AND ra >= rc THEN 0 WHEN rb >= rc THEN 1 ELSE 2 END AS high
        FROM k{i} WHERE threshold IS NOT NULL
        ORDER BY round((la + lb + lc) - (la * la + lb * lb + lc * lc) / (la + lb + lc) + (ra + rb + rc) - (ra * ra + rb * rb + rc * rc) / (ra + rb + rc), 12), feature, threshold LIMIT 1),
    y{i} AS (SELECT t.*, CASE WHEN f[feature + 1] <= threshold THEN low ELSE high END AS said FROM {state} t, s{i}),
    b{i} AS (SELECT ln(greatest(sum(CASE WHEN said = label THEN w ELSE 0 END), 1e-10) / greatest(sum(CASE WHEN said <> label THEN w ELSE 0 END), 1e-10)) AS beta FROM y{i}),
    o{i} AS (SELECT y.* EXCLUDE (votes), list_transform([0, 1, 2], lambda q: votes[q + 1] + CASE WHEN q = said THEN beta ELSE 0 END) AS votes, beta FROM y{i} y, b{i}),
    p{i} AS (SELECT *, list_transform(votes, lambda z: exp(z - list_max(votes)) / list_sum(list_transform(votes, lambda y: exp(y - list_max(votes))))) AS p FROM o{i}),
    u{i} AS (SELECT * EXCLUDE (w), w * exp(-gamma * density * (p[label + 1] - list_max(list_transform([0, 1, 2], lambda q: CASE WHEN q = label THEN -1 ELSE p[q + 1] END)) + 1)) * exp(-beta * (said = label)::INT) AS w FROM p{i}),
    t{i} AS (SELECT id, label, f, gamma, density, votes, w / sum(w) OVER () AS w FROM u{i})"""


STEPS = POINTS.replace("list_transform(embedding, lambda x: x::DOUBLE)", "list_transform(embedding[1:2], lambda x: CASE WHEN x < 0 THEN -floor(-x::DOUBLE * 2 + 0.5) ELSE floor(x::DOUBLE * 2 + 0.5) END / 2)")


@query(f"""
    WITH {STEPS}, {PAIRS}, {nearest_sql(5)}, own AS (SELECT id, avg(1 / greatest(d, 1e-10)) AS r FROM near WHERE nl = label GROUP BY id),
    a AS (SELECT p.id, p.label, f, coalesce(r, 1.0) AS r FROM points p LEFT JOIN own USING (id)),
    e AS (SELECT *, exp(-r / avg(r) OVER (PARTITION BY label)) AS e, count(*) OVER (PARTITION BY label) AS n FROM a),
    t0 AS (SELECT id, label, f, n::DOUBLE / min(n) OVER () AS gamma, e / avg(e) OVER (PARTITION BY label) AS density, [0.0::DOUBLE, 0.0, 0.0] AS votes, 1.0 / count(*) OVER () AS w FROM e),
    {_stump_sql(1, 't0')}, {_stump_sql(2, 't1')}
    SELECT id, label, round(w * 1000, 6) AS weight, round(votes[1], 6) AS vote_0, round(votes[2], 6) AS vote_1, round(votes[3], 6) AS vote_2 FROM t2""")
def margin_weights(spark, sf_dir):
    """Weights and votes after two rounds of boosting."""
    _, state = ensembles.fit_margin_boost(_steps(spark, sf_dir), 2)
    return rounded(state.select("id", "label", (F.col("w") * 1000).alias("weight"), *[F.get("votes", F.lit(c)).alias(f"vote_{c}") for c in range(3)]))


@query()
def margin_boost(spark, sf_dir):
    """50 stumps boosted by adaptive margins over all dimensions."""
    rows = points(spark, sf_dir)
    return answers(ensembles.fit_margin_boost(rows)[0].predict(rows))


# -- random-layer machines -----------------------------------------------------------------------------------------------


@query()
def random_layer_council(spark, sf_dir):
    """A machine of 2,000 units for each class, weighted by how they do on the nearest checked rows."""
    rows = points(spark, sf_dir)
    return answers(elm.fit_council(rows).predict(rows))


# -- generators ----------------------------------------------------------------------------------------------------------

#: Energy for spheres among points of 64 dimensions, whose nearest others are about 20 away by sums of absolute differences.
WIDE = 60.0
TAXI = PAIRS.replace("sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))", "list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))")
SPHERES = f"""{POINTS}, {TAXI},
    ordered AS (SELECT id, nb, d, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r, d - coalesce(lag(d) OVER (PARTITION BY id ORDER BY d, nb), 0) AS step FROM pairs WHERE label = 2 AND nl <> 2),
    costs AS (SELECT *, sum(r * step) OVER (PARTITION BY id ORDER BY r) AS cost FROM ordered),
    inside AS (SELECT * FROM costs WHERE cost < {WIDE}),
    ends AS (SELECT id, count(*) AS m, max(d) AS far, max(cost) AS spent FROM inside GROUP BY id),
    radii AS (
        SELECT p.id, coalesce(far, 0) + ({WIDE} - coalesce(spent, 0)) / CASE WHEN coalesce(m, 0) = (SELECT count(*) FROM points WHERE label <> 2) AND m > 0 THEN m ELSE coalesce(m, 0) + 1 END AS radius
        FROM points p LEFT JOIN ends USING (id) WHERE label = 2)"""


@query(f"WITH {SPHERES} SELECT id, round(radius, 6) AS radius FROM radii")
def energy_spheres(spark, sf_dir):
    return rounded(generators.spheres(points(spark, sf_dir), 2, WIDE)[0])


@query(f"""
    WITH {SPHERES},
    pushes AS (
        SELECT i.nb AS id, j AS k, sum((radius - i.d) / i.d * (x.f[j] - c.f[j])) AS push
        FROM inside i JOIN radii USING (id) JOIN points x ON x.id = i.nb JOIN points c ON c.id = i.id, (SELECT unnest(generate_series(1, 64)) AS j) GROUP BY 1, 2),
    moves AS (SELECT id, list(push ORDER BY k) AS move FROM pushes GROUP BY id)
    SELECT p.id, label, {V.as_text_sql("CASE WHEN move IS NULL THEN f ELSE list_transform(list_zip(f, move), lambda z: z[1] + z[2]) END")} AS features FROM points p LEFT JOIN moves USING (id)""")
def energy_moves(spark, sf_dir):
    rows = points(spark, sf_dir)
    return generators.pushed(rows, generators.spheres(rows, 2, WIDE)[1]).select("id", "label", V.as_text("features").alias("features"))


@query(f"""
    WITH {POINTS}, {PAIRS}, {nearest_sql(5, where='label = 2')}, same AS (SELECT id, sum((nl = 2)::INT) AS weight FROM near GROUP BY id)
    SELECT id, CAST(weight AS BIGINT) AS weight FROM same WHERE weight >= 2""")
def ellipsoid_seeds(spark, sf_dir):
    return generators.trusted_seeds(points(spark, sf_dir), 2).select("id", F.col("weight").cast("long").alias("weight"))


# -- clusters ------------------------------------------------------------------------------------------------------------


@query(f"""
    WITH RECURSIVE {POINTS}, {PAIRS}, k AS (SELECT least(greatest(15, floor(sqrt(count(*)))), count(*) - 1) AS k, ceil(sqrt(count(*) / 2)) AS centres FROM points),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM pairs) WHERE r <= (SELECT k FROM k)),
    w AS (SELECT greatest(quantile_cont(kth, 0.5), 1e-12) AS dc FROM (SELECT max(d) AS kth FROM near GROUP BY id)),
    rho AS (SELECT id, sum(exp(-((d / dc) ** 2))) AS rho, max(d) AS kth FROM near, w GROUP BY id),
    up AS (SELECT p.id, p.nb, p.d, row_number() OVER (PARTITION BY p.id ORDER BY p.d, p.nb) AS place FROM pairs p JOIN rho a ON a.id = p.id JOIN rho b ON b.id = p.nb WHERE b.rho > a.rho OR b.rho = a.rho AND b.id < a.id),
    found AS (SELECT rho.id, rho, nb AS parent, coalesce(d, kth) AS delta FROM rho LEFT JOIN (SELECT * FROM up WHERE place = 1) u ON u.id = rho.id),
    placed AS (SELECT *, row_number() OVER (ORDER BY rho * delta DESC, id) AS place FROM found),
    climb(id, spot) AS (
        SELECT id, id FROM placed UNION ALL
        SELECT c.id, p.parent FROM climb c JOIN placed p ON p.id = c.spot WHERE p.place > (SELECT centres FROM k) AND p.parent IS NOT NULL),
    ends AS (SELECT c.id, min(CASE WHEN p.place <= (SELECT centres FROM k) THEN c.spot END) AS cluster FROM climb c JOIN placed p ON p.id = c.spot GROUP BY c.id)
    SELECT f.id, coalesce(cluster, (SELECT id FROM placed WHERE place = 1)) AS cluster, round(rho, 6) AS rho, round(delta, 6) AS delta FROM ends JOIN found f USING (id)""")
def density_clusters(spark, sf_dir):
    return rounded(clusters.density_clusters(points(spark, sf_dir)).select("id", "cluster", "rho", "delta"))


@query(f"""
    WITH RECURSIVE {POINTS}, {PAIRS}, own AS (SELECT * FROM pairs WHERE label = 1 AND nl = 1),
    kth AS (SELECT id, max(d) AS kth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM own) WHERE r <= 5 GROUP BY id),
    e AS (SELECT round(quantile_cont(kth, 0.5), 4) + 0.00005 AS eps FROM kth WHERE kth > 0),
    near AS (SELECT id, nb, d FROM own, e WHERE d <= eps),
    cores AS (SELECT id FROM near GROUP BY id HAVING count(*) + 1 >= 4),
    links AS (SELECT n.id AS a, n.nb AS b FROM near n JOIN cores x ON n.id = x.id JOIN cores y ON n.nb = y.id),
    reach(a, b) AS (SELECT id, id FROM cores UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    named AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a),
    edge AS (SELECT n.id, cluster, row_number() OVER (PARTITION BY n.id ORDER BY d, nb) AS r FROM near n JOIN named c ON c.id = n.nb WHERE n.id NOT IN (SELECT id FROM cores))
    SELECT p.id, n.id IS NOT NULL AS core, coalesce(n.cluster, b.cluster) AS cluster
    FROM points p LEFT JOIN named n ON n.id = p.id LEFT JOIN edge b ON b.id = p.id AND b.r = 1 WHERE p.label = 1""")
def eps_clusters(spark, sf_dir):
    """Of one class, within the median distance to its rows' fifth neighbours."""
    own = points(spark, sf_dir).where("label = 1")
    return clusters.eps_clusters(own, round(clusters.class_eps(own), 4) + 0.00005, 4)


def _lifted(make):
    def run(spark, sf_dir):
        made = make(points(spark, sf_dir))
        return made.groupBy(F.lit(1).alias("fold"), "label").agg(F.count("*").alias("n"), F.avg(F.get("features", F.lit(0))).alias("mean_first"))

    return run


# these methods' plan forms take the place of their kernels
QUERIES["resample_mc_ccr"] = _lifted(generators.energy_resample)
QUERIES["resample_mc_rbo"] = _lifted(generators.potential_resample)
QUERIES["resample_mdo"] = _lifted(generators.ellipsoid_resample)
QUERIES["resample_eb_smote"] = _lifted(lifting.eb_resample)
QUERIES["resample_glos"] = _lifted(lifting.glos_resample)
QUERIES["resample_orem_m"] = _lifted(lifting.orem_resample)
QUERIES["resample_qc_smote"] = _lifted(lifting.qc_resample)
QUERIES["resample_shsampler"] = _lifted(lifting.sh_resample)
QUERIES["resample_smom"] = _lifted(lifting.smom_resample)
QUERIES["resample_nromm"] = _lifted(lifting.nromm_resample)
QUERIES["resample_soup"] = _lifted(lifting.soup_resample)
