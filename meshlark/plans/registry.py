"""Named queries over the star-schema test tables, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from meshlark.operators import mesh as M
from meshlark.operators import metrics as E
from meshlark.operators import selection as S
from meshlark.operators import stats as A
from meshlark.operators import trace as T
from meshlark.operators import windows as W
from meshlark.operators.lineage import cut
from meshlark.plans import views as V
from meshlark.plans.views import GRID, MAX_LEVEL, TILE, load, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
TREE = ["tree"]
N = GRID // TILE


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    from meshlark.plans import further  # noqa: F401 - adds its queries

    return dict(QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def csv(c):
    """An array as text, which compares alike in every engine."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- windows -------------------------------------------------------------------------------------

SLIDING = """
all_w AS (SELECT traj_idx, pos AS start, list(frame_id) OVER w AS f FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))
SELECT traj_idx, start, array_to_string(f[1:5:2], ',') AS inputs, array_to_string(f[7:9:2], ',') AS targets FROM all_w WHERE len(f) = 9
"""


@query("w1_sliding_windows", with_views(SLIDING, "frames"))
def _(spark, d):
    return W.sliding(V.frames(spark, d), 3, 2, 2).select("traj_idx", "start", csv("inputs").alias("inputs"), csv("targets").alias("targets"))


@query("w3_gap_free_windows", with_views("""
all_w AS (SELECT traj_idx, pos AS start, list(frame_id) OVER w AS f, list(source_index) OVER w AS s FROM gappy WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT traj_idx, start, s[1] AS frame_idx, array_to_string(f[1:3], ',') AS inputs, array_to_string(f[4:5], ',') AS targets FROM all_w
WHERE len(f) = 5 AND s[2] - s[1] = 1 AND s[3] - s[2] = 1 AND s[4] - s[3] = 1 AND s[5] - s[4] = 1
""", "gappy"))
def _(spark, d):
    return W.gap_free(V.gappy(spark, d), 3, 2).select("traj_idx", "start", "frame_idx", csv("inputs").alias("inputs"), csv("targets").alias("targets"))


@query("w5_greedy_starts", with_views("""
c AS (SELECT traj_idx, pos AS start FROM frames WHERE event_type <> 'error'),
k AS (SELECT traj_idx, min(start) AS start FROM c GROUP BY 1 UNION ALL SELECT k.traj_idx, (SELECT min(c.start) FROM c WHERE c.traj_idx = k.traj_idx AND c.start >= k.start + 7) FROM k WHERE k.start IS NOT NULL)
SELECT traj_idx, start FROM k WHERE start IS NOT NULL UNION SELECT traj_idx, max(start) FROM c GROUP BY 1
""", "frames"))
def _(spark, d):
    return W.greedy_starts(V.frames(spark, d).where("event_type <> 'error'").select("traj_idx", F.col("pos").alias("start")), 7)


@query("w6_gradient_location", with_views("""
p AS (SELECT traj_idx, pos, value AS v, lag(value) OVER w AS b, lead(value) OVER w AS a FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos)),
s AS (SELECT *, abs(coalesce(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END, 0)) AS g FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY traj_idx ORDER BY g DESC, pos) AS k FROM s)
SELECT traj_idx, pos * 0.5::DOUBLE AS location FROM r WHERE k = 1
""", "frames"))
def _(spark, d):
    return W.gradient_location(V.frames(spark, d), ["traj_idx"], "pos", "value", 0.5)


@query("w7_adjacent_gaps", with_views("SELECT traj_idx, frame_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY traj_idx ORDER BY pos))::BIGINT AS gap FROM frames", "frames"))
def _(spark, d):
    timed = V.frames(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return W.adjacent_gaps(timed, "traj_idx", "pos", "us").select("traj_idx", "frame_id", "gap")


ROLL = """
w AS (SELECT traj_idx, pos AS start, list(value) OVER w AS f FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT traj_idx, start, k::INT AS step, round({value}, 6) AS forecast FROM w, range(1, 5) r(k) WHERE len(f) = 4
"""


def _rollout(linear):
    def f(spark, d):
        w = W.sliding(V.frames(spark, d), 3, 1, frame="value")
        out = W.extrapolate(w, 4, 3, linear).select("traj_idx", "start", F.posexplode("forecast").alias("k", "v"))
        return out.select("traj_idx", "start", (F.col("k") + 1).alias("step"), F.round("v", 6).alias("forecast"))

    return f


query("w8_rollout_persistence", with_views(ROLL.format(value="f[3]"), "frames"))(_rollout(False))
query("r1_rollout_linear", with_views(ROLL.format(value="f[3] + k * (f[3] - f[2])"), "frames"))(_rollout(True))


@query("w9_reuse_distance", with_views("SELECT event_id, (rank_sequence - lag(rank_sequence) OVER (PARTITION BY epoch, rank, key ORDER BY rank_sequence, event_id))::BIGINT AS reuse FROM access", "access"))
def _(spark, d):
    return W.reuse_distance(V.access(spark, d), ["epoch", "rank", "key"], "rank_sequence", "event_id").select("event_id", F.col("reuse").cast("long").alias("reuse"))


@query("w10_equal_shards", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events)
SELECT event_id, (k % 7)::INT AS shard, (k // 7)::BIGINT AS slot FROM r WHERE k < n // 7 * 7
""")
def _(spark, d):
    return W.equal_shards(load(spark, d, "events").select("event_id"), ["event_id"], 7)


@query("w12_unique_labels", "SELECT s_suppkey, CASE WHEN k = 1 THEN label ELSE label || '#' || k END AS unique_label FROM (SELECT s_suppkey, 'run' || s_nationkey AS label, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)")
def _(spark, d):
    runs = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("run"), F.col("s_nationkey")).alias("label"))
    return W.unique_labels(runs, "label", "s_suppkey").select("s_suppkey", "unique_label")


@query("w13_frontier", with_views("SELECT traj_idx, coalesce(max(pos) FILTER (WHERE event_type = 'purchase' AND pos < 40), -1)::BIGINT AS frontier FROM frames GROUP BY 1", "frames"))
def _(spark, d):
    f = V.frames(spark, d)
    return W.frontier(f, f.where("event_type = 'purchase' AND pos < 40"))


# ---- selection, splits, sets ---------------------------------------------------------------------


@query("p1_stride_fraction", with_views("""
k AS (SELECT traj_idx, frame_id, row_number() OVER (PARTITION BY traj_idx ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY traj_idx) AS n FROM frames WHERE pos % 3 = 0)
SELECT traj_idx, frame_id FROM k WHERE k >= floor(n * 0.25::DOUBLE) AND k < floor(n * 0.75::DOUBLE)
""", "frames"))
def _(spark, d):
    return S.stride_fraction(V.frames(spark, d), 3, 0.25, 0.75).select("traj_idx", "frame_id")


@query("p17_beyond_frontier", with_views("""
w AS (SELECT traj_idx, pos AS start, list(pos) OVER w AS f FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
u AS (SELECT traj_idx, max(pos) AS m FROM frames WHERE event_type = 'purchase' AND pos < 40 GROUP BY 1)
SELECT w.traj_idx, start FROM w LEFT JOIN u USING (traj_idx) WHERE len(f) = 4 AND list_min(f) > coalesce(m, -1)
""", "frames"))
def _(spark, d):
    f = V.frames(spark, d)
    w = W.sliding(f, 3, 1, frame="pos").withColumn("positions", F.concat("inputs", "targets"))
    return S.beyond_frontier(w, W.frontier(f, f.where("event_type = 'purchase' AND pos < 40"))).select("traj_idx", "start")


@query("u2_prefix_split", with_views("""
w AS (SELECT traj_idx, pos AS start, pos + 4 AS stop, row_number() OVER (ORDER BY traj_idx, pos) AS k FROM frames f WHERE pos + 4 <= (SELECT max(pos) FROM frames g WHERE g.traj_idx = f.traj_idx)),
cut AS (SELECT traj_idx, max(stop) AS c FROM w WHERE k <= floor((SELECT count(*) FROM w) * 0.8::DOUBLE) GROUP BY 1)
SELECT traj_idx, frame_id, CASE WHEN pos <= c THEN 'train' ELSE 'val' END AS role FROM frames LEFT JOIN cut USING (traj_idx)
""", "frames"))
def _(spark, d):
    f = V.frames(spark, d)
    w = W.sliding(f, 4, 1, frame="pos").select("traj_idx", "start", F.element_at("targets", -1).alias("stop"))
    return S.prefix_split(w, f, 0.8).select("traj_idx", "frame_id", "role")


@query("o8_suffix_cohort", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, floor(count(*) OVER () * 0.8::DOUBLE) AS first FROM events) SELECT event_id FROM r WHERE k >= first AND (k - first) % 5 = 0")
def _(spark, d):
    return S.suffix_cohort(load(spark, d, "events").select("event_id"), 0.8, 5, ["event_id"])


@query("o6_seeded_sample", "SELECT event_id FROM events ORDER BY md5('s7:' || event_id) LIMIT 100")
def _(spark, d):
    return S.seeded_sample(load(spark, d, "events").select("event_id"), 100, "s7", "event_id")


@query("t23_seeded_part", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('s7:' || event_id)) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE k <= greatest(1, floor(n * 0.1::DOUBLE))")
def _(spark, d):
    return S.seeded_part(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], 0.1, "s7", "event_id")


@query("o4_greedy_knapsack", """
WITH RECURSIVE i AS (SELECT s_nationkey AS key, count(*) AS refs, 10.0::DOUBLE + s_nationkey * 3 AS size FROM supplier GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY -refs / size, -refs, key) AS k FROM i),
s AS (SELECT 0::BIGINT AS k, 0.0::DOUBLE AS used, NULL::INT AS taken
      UNION ALL SELECT o.k, CASE WHEN used + size <= 300 THEN used + size ELSE used END, CASE WHEN used + size <= 300 THEN o.key END FROM s JOIN o ON o.k = s.k + 1)
SELECT taken AS key FROM s WHERE taken IS NOT NULL
""")
def _(spark, d):
    items = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("refs")).withColumn("size", 10.0 + F.col("key") * 3)
    return S.greedy_knapsack(items, 300.0, "key", "refs", "size")


@query("j3_missing_references", "SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    store = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return S.missing(load(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), store, "custkey")


@query("s15_content_conflicts", "SELECT l_partkey AS k, count(DISTINCT md5(l_returnflag)) AS contents FROM lineitem GROUP BY 1 HAVING count(DISTINCT md5(l_returnflag)) > 1")
def _(spark, d):
    return S.conflicts(load(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.md5("l_returnflag").alias("digest")), "k", "digest")


@query("j19_role_overlap", "SELECT user_id, count(DISTINCT event_type) AS roles FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def _(spark, d):
    return S.duplicates(load(spark, d, "events"), "user_id", "event_type")


@query("j1_window_frames", with_views("""
w AS (SELECT traj_idx, pos AS start, list(frame_id) OVER w AS f FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
e AS (SELECT traj_idx, start, unnest(f) AS frame_id, generate_subscripts(f, 1) - 1 AS slot FROM w WHERE len(f) = 4)
SELECT e.traj_idx, start, slot::INT AS slot, round(value, 4) AS value FROM e JOIN frames USING (frame_id)
""", "frames"))
def _(spark, d):
    f = V.frames(spark, d)
    w = W.sliding(f, 4, 0).select("traj_idx", "start", F.posexplode("inputs").alias("slot", "frame_id"))
    return w.join(f.select("frame_id", F.round("value", 4).alias("value")), "frame_id").drop("frame_id")


@query("a42_reference_counts", with_views("""
w AS (SELECT list(frame_id) OVER w AS f FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT frame_id, count(*) AS refs FROM (SELECT unnest(f) AS frame_id FROM w WHERE len(f) = 5) GROUP BY 1
""", "frames"))
def _(spark, d):
    return W.sliding(V.frames(spark, d), 5, 0).select(F.explode("inputs").alias("frame_id")).groupBy("frame_id").agg(F.count("*").alias("refs"))


# ---- metrics -------------------------------------------------------------------------------------

SQL_METRICS = {
    "MSE": "avg((prediction - target) ^ 2)", "MAE": "avg(abs(prediction - target))", "NMAE": "avg(abs(prediction - target)) / (avg(abs(target)) + 1e-7)",
    "NMSE": "avg((prediction - target) ^ 2) / (avg(target * target) + 1e-7)", "RMSE": "sqrt(avg((prediction - target) ^ 2))",
    "NRMSE": "sqrt(avg((prediction - target) ^ 2) / (avg(target * target) + 1e-7))", "RelativeL2": "sqrt(avg((prediction - target) ^ 2) / (avg(target * target) + 1e-7))",
    "VMSE": "avg((prediction - target) ^ 2) / (var_samp(target) + 1e-7)", "VRMSE": "sqrt(avg((prediction - target) ^ 2) / (var_samp(target) + 1e-7))",
    "LInfinity": "max(abs(prediction - target))", "PearsonR": "covar_pop(prediction, target) / (stddev_samp(prediction) * stddev_samp(target) + 1e-7)",
}


def rounded(df, keys, names, digits=6):
    return df.select(*keys, *[F.round(n, digits).alias(n) for n in names])


@query("a1_a11_metrics", with_views("SELECT win, field, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in SQL_METRICS.items()) + " FROM pairs GROUP BY 1, 2", "pairs"))
def _(spark, d):
    return rounded(E.evaluate(V.pairs(spark, d), ["win", "field"], list(E.METRICS)), ["win", "field"], list(E.METRICS))


@query("a13_level_metrics", with_views(f"""
leafs AS (SELECT win, level, leaf, {SQL_METRICS['RMSE']} AS RMSE, {SQL_METRICS['NMAE']} AS NMAE FROM pairs GROUP BY 1, 2, 3),
pooled AS (SELECT win, level, {SQL_METRICS['RelativeL2']} AS r FROM pairs GROUP BY 1, 2)
SELECT l.win, l.level, count(*) AS leaves, round(avg(RMSE), 6) AS RMSE, round(avg(NMAE), 6) AS NMAE, round(any_value(r), 6) AS RelativeL2 FROM leafs l JOIN pooled p ON l.win = p.win AND l.level = p.level GROUP BY 1, 2
""", "pairs"))
def _(spark, d):
    return rounded(E.evaluate_levels(V.pairs(spark, d), ["win"], "leaf", "level", ["RMSE", "NMAE", "RelativeL2"]), ["win", "level", "leaves"], ["RMSE", "NMAE", "RelativeL2"])


@query("a20_report", with_views(f"""
w AS (SELECT leaf, win, field, {SQL_METRICS['MSE']} AS MSE, {SQL_METRICS['RMSE']} AS RMSE FROM pairs GROUP BY 1, 2, 3)
SELECT leaf, round(sqrt(avg(MSE)), 6) AS cell_RMSE, round(avg(RMSE), 6) AS RMSE FROM w GROUP BY 1
""", "pairs"))
def _(spark, d):
    w = E.evaluate(V.pairs(spark, d), ["leaf", "win", "field"], ["MSE", "RMSE"])
    return rounded(E.report(w, "leaf", "MSE", ["RMSE"]), ["leaf"], ["cell_RMSE", "RMSE"])


@query("a16_pooled_mse", with_views("SELECT win, round(sum((prediction - target) ^ 2) / count(*), 6) AS MSE FROM pairs GROUP BY 1", "pairs"))
def _(spark, d):
    rows = V.pairs(spark, d).groupBy("win", "level").agg(F.sum(F.pow(F.col("prediction") - F.col("target"), F.lit(2.0))).alias("sq"), F.count("*").alias("px"))
    return rounded(E.pooled_mse(rows, ["win"], "sq", "px"), ["win"], ["MSE"])


@query("a38_lp_loss", with_views("SELECT win, round(sqrt(sum((prediction - target) ^ 2) + 1e-12) / sqrt(sum(target ^ 2) + 1e-12), 8) AS loss FROM pairs GROUP BY 1", "pairs"))
def _(spark, d):
    return rounded(E.lp_loss(V.pairs(spark, d), ["win"], 2, True), ["win"], ["loss"], 8)


@query("a39_masked_mse", with_views("SELECT win, round(avg((prediction - target) ^ 2) FILTER (WHERE field = 'F'), 6) AS loss FROM pairs GROUP BY 1 HAVING count(*) FILTER (WHERE field = 'F') > 0", "pairs"))
def _(spark, d):
    p = V.pairs(spark, d).withColumn("m", F.col("field") == "F")
    return rounded(E.masked_mse(p, ["win"], "m"), ["win"], ["loss"])


@query("j18_baseline_agreement", with_views(f"""
a AS (SELECT leaf, {SQL_METRICS['RMSE']} AS r FROM pairs WHERE win = 'A' GROUP BY 1), b AS (SELECT leaf, {SQL_METRICS['RMSE']} AS r FROM pairs WHERE win = 'R' GROUP BY 1)
SELECT round(max(abs(a.r - b.r) / greatest(abs(b.r), 1e-30)), 6) AS RMSE FROM a JOIN b USING (leaf)
""", "pairs"))
def _(spark, d):
    p = V.pairs(spark, d)
    a, b = (E.evaluate(p.where(F.col("win") == w), ["leaf"], ["RMSE"]) for w in "AR")
    return rounded(E.relative_difference(a, b, "leaf", ["RMSE"]), [], ["RMSE"])


# ---- statistics and transforms -------------------------------------------------------------------

LONG = "long AS (SELECT unnest(['quantity', 'price', 'tax']) AS field, unnest([l_quantity, l_extendedprice / 1000, l_tax]) AS v FROM lineitem)"
STATS = "stats AS (SELECT field, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM long GROUP BY 1)"


def long(spark, d):
    line = load(spark, d, "lineitem")
    return line.select(F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("price"), F.col("l_extendedprice") / 1000, F.lit("tax"), F.col("l_tax"))).alias("field", "v"))


@query("a25_mean_std", f"WITH {LONG}, {STATS} SELECT field, n, round(mean, 5) AS mean, round(std, 5) AS std FROM stats")
def _(spark, d):
    return rounded(A.mean_std(long(spark, d)), ["field", "n"], ["mean", "std"], 5)


@query("a26_moments", f"WITH {LONG} SELECT field, count(*) AS n, round(avg(v), 5) AS mean, round(var_pop(v) * count(*) / 1000000, 5) AS m2, round(stddev_pop(v), 5) AS std FROM long GROUP BY 1")
def _(spark, d):
    return rounded(A.moments(long(spark, d)).withColumn("m2", F.col("m2") / 1000000), ["field", "n"], ["mean", "m2", "std"], 5)


@query("a27_weighted_quantile", "WITH g AS (SELECT l_returnflag AS k, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v) AS c, sum(w) OVER (PARTITION BY k) AS t FROM g) SELECT k, min(v) AS quantile FROM c WHERE c >= 0.99::DOUBLE * t GROUP BY 1")
def _(spark, d):
    return A.weighted_quantile(load(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w")), 0.99, ["k"])


@query("a31_robust_range", "SELECT l_returnflag AS k, round(quantile_cont(l_extendedprice, 0.005), 4) AS low, round(quantile_cont(l_extendedprice, 0.995), 4) AS high FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(A.robust_range(load(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v")), ["k"]), ["k"], ["low", "high"], 4)


@query("p4_standardize", f"WITH {LONG}, {STATS} SELECT field, round(min((v - mean) / std), 5) AS lo, round(max((v - mean) / std), 5) AS hi, round(avg(abs((v - mean) / std)), 5) AS spread FROM long JOIN stats USING (field) GROUP BY 1")
def _(spark, d):
    v = long(spark, d)
    z = A.standardize(v, A.mean_std(v))
    return rounded(z.groupBy("field").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg(F.abs("v")).alias("spread")), ["field"], ["lo", "hi", "spread"], 5)


@query("p5_destandardize", f"WITH {LONG} SELECT field, round(min(v), 5) AS lo, round(max(v), 5) AS hi FROM long GROUP BY 1")
def _(spark, d):
    v = long(spark, d)
    s = A.mean_std(v)
    return rounded(A.destandardize(A.standardize(v, s), s).groupBy("field").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), ["field"], ["lo", "hi"], 5)


@query("p7_merge_energy", "SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'energy' ELSE event_type END AS field, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def _(spark, d):
    named = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("energy_"), F.col("event_type"))).otherwise(F.col("event_type"))
    return rounded(A.merge_energy(load(spark, d, "events").select("user_id", named.alias("field"), F.col("value").alias("v")), ["user_id"]), ["user_id", "field"], ["v"], 4)


@query("p8_asinh_scale", "SELECT event_id, round((asinh(value / 50) - 1.5) / 0.75, 8) AS scaled, round(sinh(asinh(value / 50)) * 50, 6) AS restored FROM events")
def _(spark, d):
    scaled = A.asinh_scale(F.col("value"), 50.0, 1.5, 0.75)
    return load(spark, d, "events").select("event_id", F.round(scaled, 8).alias("scaled"), F.round(A.asinh_unscale(scaled, 50.0, 1.5, 0.75), 6).alias("restored"))


@query("p12_periodic_roll", with_views("SELECT channel, x, ((y + 17) % 64)::INT AS y, v FROM field", "field"))
def _(spark, d):
    return A.roll(V.field(spark, d), F.lit(17), GRID)


@query("p15_crop", with_views("SELECT channel, x, y, v FROM field WHERE x >= 6 AND x < 33 AND y >= 19 AND y < 64", "field"))
def _(spark, d):
    return A.crop(V.field(spark, d), GRID, GRID, 0.1, 0.51, 0.3, 1.0)


@query("p13_residual", with_views("SELECT f.traj_idx, f.pos, round(f.value - b.value, 6) AS value FROM frames f JOIN frames b ON f.traj_idx = b.traj_idx AND b.pos = 3 WHERE f.pos > 3", "frames"))
def _(spark, d):
    return rounded(A.residual(V.frames(spark, d).select("traj_idx", "pos", "value"), ["traj_idx"], "pos", 3, "value"), ["traj_idx", "pos"], ["value"])


@query("p18_keep_schedule", "SELECT p_partkey, round(0.3 + 0.7 * (1 - cos(least(1.0, p_size / 40.0) * pi())) / 2, 8) AS keep FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", F.round(A.keep_ratio(F.col("p_size"), 40.0, 0.3, "cosine"), 8).alias("keep"))


@query("a30_block_mean", with_views("SELECT channel, (x // 3)::INT AS x, (y // 3)::INT AS y, round(avg(v), 6) AS v FROM field WHERE x < 63 AND y < 63 GROUP BY 1, 2, 3", "field"))
def _(spark, d):
    return rounded(A.block_mean(V.field(spark, d), 3, ["channel"], GRID), ["channel", "x", "y"], ["v"])


@query("a29_peak_over_time", "SELECT (l_partkey % 16)::INT AS x, (l_suppkey % 16)::INT AS y, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return load(spark, d, "lineitem").groupBy((F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y")).agg(F.max("l_extendedprice").alias("v"))


# ---- access traces -------------------------------------------------------------------------------


@query("a33_trace_summary", with_views("""
t AS (SELECT rank, epoch, key, cache_hit, (end_ns - start_ns) / 1e6 AS total, (source_ready_ns - start_ns) / 1e6 AS source FROM access)
SELECT rank, epoch, count(*) AS reads, sum(cache_hit::INT)::BIGINT AS hits, count(DISTINCT key) FILTER (WHERE NOT cache_hit) AS missed_keys, round(avg(total), 4) AS mean_ms, round(quantile_cont(total, 0.95), 4) AS p95_ms, round(max(source), 4) AS max_source_ms
FROM t GROUP BY GROUPING SETS ((rank), (epoch), ())
""", "access"))
def _(spark, d):
    return rounded(T.summary(V.access(spark, d)), ["rank", "epoch", "reads", "hits", "missed_keys"], ["mean_ms", "p95_ms", "max_source_ms"], 4)


OPEN = """
e AS (SELECT {keys} start_ns, end_ns, row_number() OVER (ORDER BY start_ns, event_id) AS k FROM access WHERE {cond}),
c AS (SELECT {akeys} a.k, count(*) AS n FROM e a JOIN e b ON {join} b.k <= a.k AND (b.end_ns > a.start_ns OR b.k = a.k) GROUP BY ALL)
SELECT {keys} max(n)::BIGINT AS most FROM c {group}
"""


@query("a34_max_concurrency", with_views("""
e AS (SELECT start_ns, end_ns, row_number() OVER (ORDER BY start_ns, event_id) AS k FROM access),
v AS (SELECT start_ns AS t, 1 AS phase, k, 1 AS d FROM e UNION ALL SELECT end_ns, CASE WHEN end_ns > start_ns THEN 0 ELSE 1 END, k, -1 FROM e),
s AS (SELECT sum(d) OVER (ORDER BY t, phase, k, d DESC ROWS UNBOUNDED PRECEDING) AS n FROM v)
SELECT max(n)::BIGINT AS most FROM s
""", "access"))
def _(spark, d):
    return T.max_concurrency(V.access(spark, d), [], "start_ns", "end_ns")


@query("a35_miss_contention", with_views(OPEN.format(keys="key,", akeys="a.key,", cond="NOT cache_hit", join="a.key = b.key AND", group="GROUP BY key"), "access"))
def _(spark, d):
    return T.max_concurrency(V.access(spark, d).where("NOT cache_hit"), ["key"], "start_ns", "end_ns")


@query("a23_stage_profile", "SELECT o_orderstatus AS bucket, o_orderpriority AS stage, round(avg(o_totalprice), 4) AS mean_s, round(sum(o_totalprice) / 1000, 4) AS sum_s, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderstatus), 8) AS share FROM orders GROUP BY 1, 2")
def _(spark, d):
    out = T.stage_profile(load(spark, d, "orders").select(F.col("o_orderstatus").alias("bucket"), F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("s")), "bucket", "stage", "s")
    return out.select("bucket", "stage", F.round("mean_s", 4).alias("mean_s"), F.round(F.col("sum_s") / 1000, 4).alias("sum_s"), F.round("share", 8).alias("share"))


@query("a36_online_metric", "SELECT count(value) AS n, round(sum(value), 4) AS total, max(value) AS most, round((SELECT quantile_cont(value, 0.95) FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 1024)), 6) AS p95 FROM events")
def _(spark, d):
    out = T.recent(load(spark, d, "events"), "event_id", "value")
    return out.select("n", F.round("total", 4).alias("total"), "most", F.round("p95", 6).alias("p95"))


@query("a32_benchmark_summary", "WITH r AS (SELECT o_totalprice / 1000 AS t, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 5000 ELSE 0 END AS g FROM orders) SELECT round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS std, round(median(t), 6) AS median, round(quantile_cont(t, 0.75) - quantile_cont(t, 0.25), 6) AS iqr, min(t) AS least, max(t) AS most, round(avg(g) FILTER (WHERE g > 0), 6) AS regrid_mean, round(sum(g) / greatest(sum(t), 1e-12), 8) AS regrid_share FROM r")
def _(spark, d):
    r = load(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("t"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 5000).otherwise(0.0).alias("g"))
    out = T.benchmark_summary(r, "t", "g")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "iqr")], "least", "most", F.round("regrid_mean", 6).alias("regrid_mean"), F.round("regrid_share", 8).alias("regrid_share"))


# ---- meshes --------------------------------------------------------------------------------------

IN_SQL = """
thr AS (SELECT {t}, {tol}::DOUBLE * (max(v) - min(v)) AS thr FROM {f} GROUP BY 1),
cells AS (SELECT {t}, l.range::INT AS level, (x // (32 >> l.range))::INT AS ix, (y // (32 >> l.range))::INT AS iy, max(v) - min(v) AS r FROM {f}, range(3) l GROUP BY 1, 2, 3, 4),
inner0 AS (SELECT c.{t}, level, ix, iy FROM cells c JOIN thr USING ({t}) WHERE r > thr)
"""
NEAR = "SELECT {t}, ix + dx AS x, iy + dy AS y FROM {src} , (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) WHERE level = {k}"


def balanced_sql(src: str, out: str, t: str) -> str:
    """The sweep of two levels, as views: out holds the balanced internal cells."""
    steps, now = [], src
    for k in (2, 1):
        nxt = out if k == 1 else f"{out}_{k}"
        steps.append(f"{nxt} AS (SELECT {t}, level, ix, iy FROM {now} UNION SELECT {t}, {k - 1}, (x // 2)::INT, (y // 2)::INT FROM ({NEAR.format(t=t, src=now, k=k)}) WHERE x >= 0 AND y >= 0 AND x < {N << k} AND y < {N << k})")
        now = nxt
    return ",\n".join(steps)


def leaves_sql(src: str, out: str, t: str) -> str:
    return f"""
{out}_n AS (SELECT DISTINCT {t}, 0 AS level, a.range::INT AS ix, b.range::INT AS iy FROM thr, range({N}) a, range({N}) b
  UNION ALL SELECT {t}, level + 1, (2 * ix + q.range % 2)::INT, (2 * iy + q.range // 2)::INT FROM {src}, range(4) q),
{out} AS (SELECT * FROM {out}_n ANTI JOIN {src} USING ({t}, level, ix, iy))"""


SMOOTH_IN = IN_SQL.format(t="tree", f="smooth", tol=0.2)
FIELD_IN = IN_SQL.format(t="channel", f="field", tol=0.6)


def smooth_mesh(spark, d, balanced=False):
    f = V.smooth(spark, d)
    inner, base = M.adapt(f, TREE, TILE, MAX_LEVEL, 0.2), M.roots(f.select(*TREE).distinct(), TREE, N, N)
    if balanced:
        inner = M.balance(inner, TREE, N, N, MAX_LEVEL)
    return f, cut(inner), base  # every branch of a query reads the mesh once built


def field_mesh(spark, d, balanced=False):
    f, k = V.field(spark, d), ["channel"]
    inner, base = M.adapt(f, k, TILE, MAX_LEVEL, 0.6), M.roots(f.select(*k).distinct(), k, N, N)
    return f, cut(M.balance(inner, k, N, N, MAX_LEVEL) if balanced else inner), base


@query("t11_adapt_on_field", with_views(SMOOTH_IN + "," + leaves_sql("inner0", "leaf", "tree") + "SELECT tree, level, ix, iy FROM leaf", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d)
    return M.leaves(inner, base, TREE).select("tree", "level", "ix", "iy")


@query("t11_adapt_channels", with_views(FIELD_IN + "," + leaves_sql("inner0", "leaf", "channel") + "SELECT channel, level, ix, iy FROM leaf", "field"))
def _(spark, d):
    _, inner, base = field_mesh(spark, d)
    return M.leaves(inner, base, ["channel"])


@query("t5_balance", with_views(SMOOTH_IN + "," + balanced_sql("inner0", "bal", "tree") + "," + leaves_sql("bal", "leaf", "tree") + "SELECT tree, level, ix, iy FROM leaf", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    return M.leaves(inner, base, TREE).select("tree", "level", "ix", "iy")


@query("t10_merge_trees", with_views(FIELD_IN + ", one AS (SELECT DISTINCT 0 AS channel, level, ix, iy FROM inner0)," + balanced_sql("one", "bal", "channel") + "SELECT level, ix, iy FROM bal", "field"))
def _(spark, d):
    _, inner, _ = field_mesh(spark, d)
    one = inner.select(F.lit(0).alias("channel"), *M.CELL).distinct()
    return M.balance(one, ["channel"], N, N, MAX_LEVEL).select("level", "ix", "iy")


TWO = SMOOTH_IN + "," + balanced_sql("inner0", "bal", "tree") + "," + leaves_sql("inner0", "la", "tree") + "," + leaves_sql("bal", "lb", "tree")


@query("t7_topology_diff", with_views(TWO + """
SELECT tree, level, ix, iy, CASE WHEN EXISTS (SELECT 1 FROM la WHERE la.tree = n.tree AND la.level < n.level AND la.ix = n.ix >> (n.level - la.level) AND la.iy = n.iy >> (n.level - la.level)) THEN 1 ELSE 2 END AS op
FROM lb n ANTI JOIN la USING (tree, level, ix, iy)
""", "smooth"))
def _(spark, d):
    _, a, base = smooth_mesh(spark, d)
    _, b, _ = smooth_mesh(spark, d, True)
    return M.diff(M.leaves(a, base, TREE), M.leaves(b, base, TREE), TREE).select("tree", "level", "ix", "iy", "op")


@query("t8_apply_diff", with_views(TWO + "SELECT tree, level, ix, iy FROM lb", "smooth"))
def _(spark, d):
    _, a, base = smooth_mesh(spark, d)
    _, b, _ = smooth_mesh(spark, d, True)
    la, lb = M.leaves(a, base, TREE), M.leaves(b, base, TREE)
    return M.apply_diff(la, M.diff(la, lb, TREE), TREE).select("tree", "level", "ix", "iy")


BAL = SMOOTH_IN + "," + balanced_sql("inner0", "bal", "tree") + "," + leaves_sql("bal", "leaf", "tree")
BOX = "box AS (SELECT tree, level, ix, iy, ix << (3 - level) AS x0, (ix + 1) << (3 - level) AS x1, iy << (3 - level) AS y0, (iy + 1) << (3 - level) AS y1 FROM leaf)"


@query("j8_face_neighbours", with_views(BAL + "," + BOX + """
SELECT a.tree, a.level, a.ix, a.iy, b.level AS nlevel, b.ix AS nx, b.iy AS ny, CASE WHEN b.x1 = a.x0 THEN 'W' WHEN b.x0 = a.x1 THEN 'E' WHEN b.y1 = a.y0 THEN 'S' ELSE 'N' END AS side FROM box a JOIN box b
ON a.tree = b.tree AND (((b.x1 = a.x0 OR b.x0 = a.x1) AND b.y0 < a.y1 AND a.y0 < b.y1) OR ((b.y1 = a.y0 OR b.y0 = a.y1) AND b.x0 < a.x1 AND a.x0 < b.x1))
""", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    return M.neighbours(M.leaves(inner, base, TREE), TREE, MAX_LEVEL)


@query("j12_sibling_groups", with_views(BAL + "SELECT tree, level - 1 AS level, ix >> 1 AS ix, iy >> 1 AS iy FROM leaf WHERE level > 0 GROUP BY ALL HAVING count(*) = 4", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    return M.siblings(M.leaves(inner, base, TREE), TREE).select("tree", *M.CELL)


@query("j5_point_in_leaf", with_views(BAL + "SELECT tree, x, y, level, ix, iy FROM grid JOIN leaf ON ix = x // (32 >> level) AND iy = y // (32 >> level)", "smooth"))
def _(spark, d):
    f, inner, base = smooth_mesh(spark, d, True)
    return M.covering(f, M.leaves(inner, base, TREE), TREE, TILE, MAX_LEVEL).select("tree", "x", "y", *M.CELL)


MEANS = "means AS (SELECT tree, level, ix, iy, ((x - ix * (32 >> level)) // ((32 >> level) // 2))::INT AS px, ((y - iy * (32 >> level)) // ((32 >> level) // 2))::INT AS py, avg(v) AS v FROM smooth JOIN leaf USING (tree) WHERE ix = x // (32 >> level) AND iy = y // (32 >> level) GROUP BY 1, 2, 3, 4, 5, 6)"


def patched(spark, d):
    f, inner, base = smooth_mesh(spark, d, True)
    leaf = cut(M.leaves(inner, base, TREE))
    return leaf, cut(M.leaf_means(f, leaf, TREE, TILE, MAX_LEVEL, 2))


@query("t6_assign_patches", with_views(BAL + "," + MEANS + "SELECT tree, level, ix, iy, px, py, round(v, 8) AS v FROM means", "smooth"))
def _(spark, d):
    return rounded(patched(spark, d)[1], ["tree", "level", "ix", "iy", "px", "py"], ["v"], 8)


@query("t14_leaves_to_grid", with_views(BAL + "," + MEANS + "SELECT tree, x, y, round(m.v, 8) AS v FROM grid JOIN means m ON ix = x // (32 >> level) AND iy = y // (32 >> level) AND px = (x - ix * (32 >> level)) // ((32 >> level) // 2) AND py = (y - iy * (32 >> level)) // ((32 >> level) // 2)", "smooth"))
def _(spark, d):
    return rounded(M.paint(patched(spark, d)[1], TREE, TILE, 2), ["tree", "x", "y"], ["v"], 8)


@query("t3_coarsen_siblings", with_views(BAL + "," + MEANS + "SELECT tree, level - 1 AS level, ix >> 1 AS ix, iy >> 1 AS iy, ((ix % 2) * 2 + px) // 2 AS px, ((iy % 2) * 2 + py) // 2 AS py, round(sum(v) / 4, 8) AS v FROM means WHERE level > 0 GROUP BY 1, 2, 3, 4, 5, 6", "smooth"))
def _(spark, d):
    return rounded(M.coarsen_mean(patched(spark, d)[1].where("level > 0"), TREE, 2), ["tree", "level", "ix", "iy", "px", "py"], ["v"], 8)


@query("t2_refine_bilinear", with_views(BAL + "," + MEANS + """,
taps(q, k, i, w) AS (VALUES (0, 0, 0, 1.0::DOUBLE), (0, 1, 0, 2.0::DOUBLE / 3), (0, 1, 1, 1.0::DOUBLE / 3), (1, 0, 0, 1.0::DOUBLE / 3), (1, 0, 1, 2.0::DOUBLE / 3), (1, 1, 1, 1.0::DOUBLE))
SELECT tree, level + 1 AS level, 2 * ix + a.q AS ix, 2 * iy + b.q AS iy, a.k AS px, b.k AS py, round(sum(v * a.w * b.w), 8) AS v FROM means JOIN taps a ON px = a.i JOIN taps b ON py = b.i GROUP BY 1, 2, 3, 4, 5, 6
""", "smooth"))
def _(spark, d):
    return rounded(M.refine_bilinear(patched(spark, d)[1], TREE, 2), ["tree", "level", "ix", "iy", "px", "py"], ["v"], 8)


@query("t16_export_leaves", with_views(BAL + """
SELECT tree, level, ix, iy, ix >> level AS tile_ix, iy >> level AS tile_iy, round((ix + 0.5) / (2 << level), 8) AS cx, round((iy + 0.5) / (2 << level), 8) AS cy, round(0.5 / (2 << level), 8) AS hx, (ix = 0 OR iy = 0 OR ix + 1 = 2 << level OR iy + 1 = 2 << level) AS boundary,
 (ix % (1 << level) + ((iy % (1 << level)) << 3) + (level << 6) + ((ix >> level)::BIGINT << 12) + ((iy >> level)::BIGINT << 24))::BIGINT AS uid FROM leaf
""", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    out = M.export(M.leaves(inner, base, TREE), TREE, N, N, MAX_LEVEL)
    return out.select("tree", *M.CELL, "tile_ix", "tile_iy", *[F.round(c, 8).alias(c) for c in ("cx", "cy", "hx")], "boundary", "uid")


@query("t17_uid_round_trip", with_views(BAL + "SELECT tree, level, ix, iy FROM leaf", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    out = M.export(M.leaves(inner, base, TREE), TREE, N, N, MAX_LEVEL)
    return out.select("tree", *[c.alias(n) for n, c in M.uid_parts(F.col("uid"), MAX_LEVEL).items()])


@query("w11_bucket_layout", with_views(BAL + """,
z AS (SELECT *, (SELECT sum(((((ix << (3 - level)) >> b) & 1) << (2 * b)) + ((((iy << (3 - level)) >> b) & 1) << (2 * b + 1))) FROM range(16) t(b)) AS m FROM leaf)
SELECT tree, level, ix, iy, row_number() OVER (PARTITION BY tree, level ORDER BY m) - 1 AS position FROM z
""", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    return M.bucket_layout(M.leaves(inner, base, TREE), TREE, MAX_LEVEL)


@query("t31_tree_info", with_views(FIELD_IN + "," + leaves_sql("inner0", "leaf", "channel") + "SELECT channel, count(*) AS leaves, max(level)::BIGINT AS deepest, count(DISTINCT (ix >> level, iy >> level)) AS tiles FROM leaf GROUP BY 1", "field"))
def _(spark, d):
    _, inner, base = field_mesh(spark, d)
    return M.info(M.leaves(inner, base, ["channel"]), ["channel"])


@query("o3_fingerprint", with_views(FIELD_IN + "," + leaves_sql("inner0", "leaf", "channel") + "SELECT channel, sha256(string_agg(level || ',' || lpad(ix::VARCHAR, 8, '0') || ',' || lpad(iy::VARCHAR, 8, '0'), ';' ORDER BY level, ix, iy)) AS digest FROM leaf GROUP BY 1", "field"))
def _(spark, d):
    _, inner, base = field_mesh(spark, d)
    return M.fingerprint(M.leaves(inner, base, ["channel"]), ["channel"])


@query("t15_coverage", with_views(FIELD_IN + "," + leaves_sql("inner0", "leaf", "channel") + f"SELECT channel FROM leaf GROUP BY 1 HAVING sum(1 << (2 * (3 - level))) <> {N * N << 2 * MAX_LEVEL}", "field"))
def _(spark, d):
    _, inner, base = field_mesh(spark, d)
    return M.uncovered(M.leaves(inner, base, ["channel"]), ["channel"], N, N, MAX_LEVEL)


EXPANDED = BAL + "," + BOX + """,
grow AS (SELECT DISTINCT b.tree, b.level, b.ix, b.iy FROM box a JOIN box b ON a.tree = b.tree AND b.level < a.level AND (((b.x1 = a.x0 OR b.x0 = a.x1) AND b.y0 < a.y1 AND a.y0 < b.y1) OR ((b.y1 = a.y0 OR b.y0 = a.y1) AND b.x0 < a.x1 AND a.x0 < b.x1))),
grown AS (SELECT tree, level, ix, iy FROM bal UNION SELECT * FROM grow),""" + balanced_sql("grown", "wide", "tree")


@query("t13_expand_fine", with_views(EXPANDED + "SELECT tree, level, ix, iy FROM wide", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d)
    return M.expand_fine(inner, base, TREE, N, N, MAX_LEVEL, 1).select("tree", *M.CELL)


@query("t34_protected", with_views(BAL + "," + MEANS + "SELECT tree, level, ix, iy FROM means GROUP BY 1, 2, 3, 4 HAVING max(v) - min(v) >= 0.25 * 0.021::DOUBLE", "smooth"))
def _(spark, d):
    return M.protected(patched(spark, d)[1], TREE, 0.021).select("tree", *M.CELL)


@query("t35_dilate", with_views(BAL + "," + MEANS + "," + BOX + """,
p AS (SELECT tree, level, ix, iy FROM means GROUP BY 1, 2, 3, 4 HAVING max(v) - min(v) >= 0.25 * 0.4::DOUBLE)
SELECT tree, level, ix, iy FROM p UNION SELECT b.tree, b.level, b.ix, b.iy FROM p JOIN box a USING (tree, level, ix, iy) JOIN box b ON a.tree = b.tree AND (((b.x1 = a.x0 OR b.x0 = a.x1) AND b.y0 < a.y1 AND a.y0 < b.y1) OR ((b.y1 = a.y0 OR b.y0 = a.y1) AND b.x0 < a.x1 AND a.x0 < b.x1))
""", "smooth"))
def _(spark, d):
    leaf, values = patched(spark, d)
    return M.dilate(M.protected(values, TREE, 0.4), leaf, TREE, MAX_LEVEL, 1).select("tree", *M.CELL)


@query("t24_patch_refinement", with_views("SELECT DISTINCT k.range::INT AS level, a.range::INT AS ix, b.range::INT AS iy FROM placed, range(3) k, range(8) a, range(8) b WHERE placed.level > k.range AND a.range < 2 << k.range AND b.range < 2 << k.range AND x0 < (a.range + 1) * (32 >> k.range) AND x1 > a.range * (32 >> k.range) AND y0 < (b.range + 1) * (32 >> k.range) AND y1 > b.range * (32 >> k.range)", "patches"))
def _(spark, d):
    return M.patch_internals(V.patches(spark, d), TREE, TILE, MAX_LEVEL).select(*M.CELL)


@query("j6_finest_patch_wins", with_views("SELECT x, y, arg_max(v, (level, -patch_id)) AS v FROM grid JOIN placed ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2", "grid", "patches"))
def _(spark, d):
    return M.finest_wins(V.patches(spark, d), TREE).select("x", "y", "v")


# ---- adapting a mesh to its values ---------------------------------------------------------------

from meshlark.operators import regrid as R  # noqa: E402


@query("t12_error_metric", with_views(BAL + "," + MEANS + """,
pts AS (SELECT tree, level, ix, iy, k, (ix + 0.5::DOUBLE + dx) * (32 >> level) AS sx, (iy + 0.5::DOUBLE + dy) * (32 >> level) AS sy FROM leaf, (VALUES (0, 0, 0), (1, -1, 0), (2, 1, 0), (3, 0, -1), (4, 0, 1)) s(k, dx, dy)),
held AS (SELECT p.*, l.level AS hl, l.ix AS hx, l.iy AS hy, (sx - l.ix * (32 >> l.level)) / (32 >> l.level) * 2 - 0.5::DOUBLE AS u, (sy - l.iy * (32 >> l.level)) / (32 >> l.level) * 2 - 0.5::DOUBLE AS w
  FROM pts p JOIN leaf l ON l.tree = p.tree AND l.ix = floor(sx)::INT // (32 >> l.level) AND l.iy = floor(sy)::INT // (32 >> l.level) WHERE sx >= 0 AND sy >= 0),
got AS (SELECT h.tree, h.level, h.ix, h.iy, k, sum(v * CASE a.t WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END * CASE b.t WHEN 0 THEN 1 - (w - floor(w)) ELSE w - floor(w) END) AS s
  FROM held h, (VALUES (0), (1)) a(t), (VALUES (0), (1)) b(t), means m
  WHERE m.tree = h.tree AND m.level = hl AND m.ix = hx AND m.iy = hy AND m.px = greatest(0, least(1, floor(u) + a.t)) AND m.py = greatest(0, least(1, floor(w) + b.t)) GROUP BY 1, 2, 3, 4, 5),
allk AS (SELECT p.tree, p.level, p.ix, p.iy, p.k, coalesce(s, 0) AS s FROM pts p LEFT JOIN got g ON p.tree = g.tree AND p.level = g.level AND p.ix = g.ix AND p.iy = g.iy AND p.k = g.k),
e AS (SELECT a.tree, a.level, a.ix, a.iy, max(abs(a.s - c.s)) AS e FROM allk a JOIN allk c ON a.tree = c.tree AND a.level = c.level AND a.ix = c.ix AND a.iy = c.iy AND c.k = 0 AND a.k > 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT tree, level, ix, iy, max(v) - min(v) AS r FROM means GROUP BY 1, 2, 3, 4)
SELECT e.tree, e.level, e.ix, e.iy, round(greatest(e, r), 8) AS error FROM e JOIN r ON e.tree = r.tree AND e.level = r.level AND e.ix = r.ix AND e.iy = r.iy
""", "smooth"))
def _(spark, d):
    return rounded(R.error_metric(patched(spark, d)[1], TREE, 2, TILE, MAX_LEVEL, N, N), ["tree", "level", "ix", "iy"], ["error"], 8)


@query("j9_corner_neighbours", with_views(BAL + "," + BOX + """
SELECT a.tree, a.level, a.ix, a.iy, c.corner, b.level AS nlevel, b.ix AS nx, b.iy AS ny FROM box a, (VALUES ('SW', 0, 0), ('SE', 1, 0), ('NW', 0, 1), ('NE', 1, 1)) c(corner, e, n), box b
WHERE a.tree = b.tree AND (CASE e WHEN 0 THEN a.x0 - 1 ELSE a.x1 END) >= b.x0 AND (CASE e WHEN 0 THEN a.x0 - 1 ELSE a.x1 END) < b.x1 AND (CASE n WHEN 0 THEN a.y0 - 1 ELSE a.y1 END) >= b.y0 AND (CASE n WHEN 0 THEN a.y0 - 1 ELSE a.y1 END) < b.y1
""", "smooth"))
def _(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    return R.corner_neighbours(M.leaves(inner, base, TREE), TREE, N, N, MAX_LEVEL)


@query("j13_value_copy", with_views(TWO + """,
src AS (SELECT tree, level, ix, iy, level * 1000 + ix * 10.0::DOUBLE + iy AS v FROM la)
SELECT t.tree, t.level, t.ix, t.iy, v FROM lb t JOIN src s ON s.tree = t.tree AND s.ix = floor((t.ix + 0.5) * (32 >> t.level))::INT // (32 >> s.level) AND s.iy = floor((t.iy + 0.5) * (32 >> t.level))::INT // (32 >> s.level)
""", "smooth"))
def _(spark, d):
    _, a, base = smooth_mesh(spark, d)
    _, b, _ = smooth_mesh(spark, d, True)
    source = M.leaves(a, base, TREE).withColumn("v", F.col("level") * 1000 + F.col("ix") * 10.0 + F.col("iy"))
    return R.copy_values(source, M.leaves(b, base, TREE), TREE, TILE, MAX_LEVEL)


@query("t18_regrid")
def _(spark, d):
    """A loop of dependent decisions, which SQL does not express; tests/test_regrid.py compares it with a plain Python version."""
    return rounded(R.regrid(patched(spark, d)[1], TREE, 2, TILE, N, N, MAX_LEVEL, 0.2, nearby=1), ["tree", "level", "ix", "iy", "px", "py"], ["v"], 8)


# ---- further mesh, join and metric operators -----------------------------------------------------


def smooth_leaves(spark, d):
    _, inner, base = smooth_mesh(spark, d, True)
    return M.leaves(inner, base, TREE), base


@query("t4_refine_where", with_views(BAL + "SELECT tree, level, ix, iy FROM leaf WHERE level >= 2 OR ix <> 0 UNION ALL SELECT tree, level + 1, (2 * ix + q.range % 2)::INT, (2 * iy + q.range // 2)::INT FROM leaf, range(4) q WHERE level < 2 AND ix = 0", "smooth"))
def _(spark, d):
    leaf, _ = smooth_leaves(spark, d)
    return M.refine_where(leaf, (F.col("level") < 2) & (F.col("ix") == 0), TREE).select("tree", *M.CELL)


@query("t4_coarsen_where", with_views(BAL + "SELECT tree, level, ix, iy FROM leaf WHERE level <= 1 UNION SELECT tree, 1, ix >> (level - 1), iy >> (level - 1) FROM leaf WHERE level > 1", "smooth"))
def _(spark, d):
    leaf, _ = smooth_leaves(spark, d)
    return M.coarsen_where(leaf, F.col("level") >= 1, TREE, MAX_LEVEL).select("tree", *M.CELL)


@query("t9_refine_only_export", with_views(BAL + "SELECT tree, level, ix, iy FROM leaf", "smooth"))
def _(spark, d):
    leaf, base = smooth_leaves(spark, d)
    return M.refine_only(M.diff(base, leaf, TREE), base, TREE).select("tree", *M.CELL)


@query("t21_cells_from_centres", with_views(BAL + "SELECT tree, level, ix, iy FROM leaf", "smooth"))
def _(spark, d):
    leaf, _ = smooth_leaves(spark, d)
    out = M.export(leaf, TREE, N, N, MAX_LEVEL).select("tree", "level", "cx", "cy")
    return M.from_centres(out, N, N).select("tree", *M.CELL)


@query("t26_regular_centres", "SELECT a.range::INT AS ix, b.range::INT AS iy, round((a.range + 0.5) / 12, 8) AS cx, round((b.range + 0.5) / 5, 8) AS cy FROM range(12) a, range(5) b")
def _(spark, d):
    return M.regular_centres(spark, 12, 5).select("ix", "iy", F.round("cx", 8).alias("cx"), F.round("cy", 8).alias("cy"))


@query("t28_rasterize", with_views("SELECT channel, a.range::INT AS x, b.range::INT AS y, v FROM range(20) a, range(20) b, field f WHERE f.x = floor((a.range + 0.5) * 64 / 20) AND f.y = floor((b.range + 0.5) * 64 / 20)", "field"))
def _(spark, d):
    return M.rasterize(V.field(spark, d), ["channel"], GRID, 20)


@query("t38_overlap_repair", with_views(BAL + "SELECT tree, level, ix, iy FROM leaf", "smooth"))
def _(spark, d):
    leaf, base = smooth_leaves(spark, d)
    return M.repair_overlaps(leaf.unionByName(base), TREE).select("tree", *M.CELL)


@query("j7_patches_to_grid", with_views("fine AS (SELECT x, y, arg_max(v, (level, -patch_id)) AS v FROM grid JOIN placed ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2) SELECT (x // 4)::INT AS x, (y // 4)::INT AS y, round(avg(v), 6) AS v FROM fine GROUP BY 1, 2".replace(") SELECT", ")\nSELECT"), "grid", "patches"))
def _(spark, d):
    return rounded(M.patches_to_grid(V.patches(spark, d), TREE, 4), ["x", "y"], ["v"])


@query("j10_topology_match", with_views(TWO + "SELECT tree, level, ix, iy FROM la SEMI JOIN lb USING (tree, level, ix, iy)", "smooth"))
def _(spark, d):
    _, a, base = smooth_mesh(spark, d)
    _, b, _ = smooth_mesh(spark, d, True)
    return M.leaves(a, base, TREE).join(M.leaves(b, base, TREE), [*TREE, *M.CELL], "left_semi").select("tree", *M.CELL)


@query("j11_ancestors", with_views(BAL + "SELECT tree, level, ix, iy, k.range::INT AS alevel, ix >> (level - k.range)::INT AS ax, iy >> (level - k.range)::INT AS ay FROM leaf, range(4) k WHERE k.range < level", "smooth"))
def _(spark, d):
    leaf, _ = smooth_leaves(spark, d)
    return M.ancestors(leaf, TREE)


@query("a14_level_counts", with_views(FIELD_IN + "," + leaves_sql("inner0", "leaf", "channel") + "SELECT channel, k.range::INT AS level, count(leaf.ix) AS n FROM (SELECT DISTINCT channel FROM leaf) c CROSS JOIN range(4) k LEFT JOIN leaf ON leaf.channel = c.channel AND leaf.level = k.range GROUP BY 1, 2".replace("SELECT channel, k.range", "SELECT c.channel, k.range"), "field"))
def _(spark, d):
    _, inner, base = field_mesh(spark, d)
    return E.level_counts(M.leaves(inner, base, ["channel"]), ["channel"], MAX_LEVEL)


@query("a40_multiscale_loss", with_views("l AS (SELECT win, level, leaf, sqrt(sum((prediction - target) ^ 2) + 1e-12) AS l FROM pairs GROUP BY 1, 2, 3)\nSELECT win, round(avg(l), 5) AS loss FROM l GROUP BY 1", "pairs"))
def _(spark, d):
    return rounded(E.multiscale_loss(V.pairs(spark, d), ["win"], ["level", "leaf"]), ["win"], ["loss"], 5)


@query("a41_full_field_loss", with_views("l AS (SELECT win, field, sqrt(sum((prediction - target) ^ 2) + 1e-12) AS l FROM pairs GROUP BY 1, 2)\nSELECT win, round(avg(l), 4) AS loss FROM l GROUP BY 1", "pairs"))
def _(spark, d):
    return rounded(E.full_field_loss(V.pairs(spark, d), ["win"], "field"), ["win"], ["loss"], 4)


@query("a24_conserved_difference", with_views("SELECT win, field, round(abs(sum(prediction) - sum(target)) * 0.25 / 1000, 5) AS difference FROM pairs GROUP BY 1, 2", "pairs"))
def _(spark, d):
    return rounded(E.conserved_difference(V.pairs(spark, d), ["win", "field"], 0.5, 0.0005), ["win", "field"], ["difference"], 5)


@query("a43_channel_range", with_views("SELECT channel, max(v) - min(v) AS span FROM field GROUP BY 1", "field"))
def _(spark, d):
    return V.field(spark, d).groupBy("channel").agg((F.max("v") - F.min("v")).alias("span"))


@query("p3_latest_frame_detectors", with_views("SELECT traj_idx, pos, event_type, value FROM frames f WHERE pos = (SELECT max(pos) FROM frames g WHERE g.traj_idx = f.traj_idx) AND event_type IN ('click', 'view', 'purchase')", "frames"))
def _(spark, d):
    f = V.frames(spark, d)
    last = f.groupBy("traj_idx").agg(F.max("pos").alias("pos"))
    return f.join(last, ["traj_idx", "pos"], "left_semi").where(F.col("event_type").isin("click", "view", "purchase")).select("traj_idx", "pos", "event_type", "value")


@query("j4_reference_dedupe", with_views("w AS (SELECT traj_idx, pos AS start, list(frame_id) OVER w AS f FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))\nSELECT DISTINCT f[3] AS reference FROM w WHERE len(f) = 4", "frames"))
def _(spark, d):
    return W.sliding(V.frames(spark, d), 3, 1).select(F.element_at("inputs", -1).alias("reference")).distinct()


@query("j15_predictions_and_truth", with_views("w AS (SELECT traj_idx, pos AS start, list(value) OVER w AS f FROM frames WINDOW w AS (PARTITION BY traj_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))\nSELECT k::INT AS step, round(sqrt(avg((f[3 + k] - f[3]) ^ 2)), 6) AS RMSE FROM w, range(1, 3) r(k) WHERE len(f) = 5 GROUP BY 1", "frames"))
def _(spark, d):
    w = W.extrapolate(W.sliding(V.frames(spark, d), 3, 2, frame="value"), 2, 3)
    both = w.select(F.posexplode(F.zip_with("forecast", "targets", lambda p, t: F.struct(p.alias("prediction"), t.alias("target")))).alias("k", "p"))
    both = both.select((F.col("k") + 1).alias("step"), "p.prediction", "p.target")
    return rounded(E.evaluate(both, ["step"], ["RMSE"]), ["step"], ["RMSE"])


@query("j17_common_steps", "SELECT DISTINCT l_linenumber AS step FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 6")
def _(spark, d):
    line = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("step"), "l_returnflag")
    steps = lambda where: line.where(where).select("step").distinct()  # noqa: E731 - once a task, before they meet
    return steps("l_returnflag = 'A'").intersect(steps("l_returnflag = 'R' and step < 6"))


@query("u5_inventory_digest", "SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "\n"), 256).alias("digest"))


@query("o2_morton_order", with_views(BAL + """
SELECT tree, level, ix, iy, (SELECT sum(((((ix << (3 - level)) >> b) & 1) << (2 * b)) + ((((iy << (3 - level)) >> b) & 1) << (2 * b + 1))) FROM range(16) t(b))::BIGINT AS morton FROM leaf
""", "smooth"))
def _(spark, d):
    leaf, _ = smooth_leaves(spark, d)
    return leaf.select("tree", *M.CELL, M.morton("level", "ix", "iy", MAX_LEVEL).alias("morton"))
