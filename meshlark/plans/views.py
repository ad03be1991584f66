"""Engine inputs drawn from the star-schema test tables: as DataFrames, and as the same text for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID, TILE, MAX_LEVEL = 64, 32, 3

FRAMES = "SELECT user_id AS traj_idx, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, event_id AS frame_id, ts, value, event_type FROM events"
GAPPY = "SELECT traj_idx, CAST(row_number() OVER (PARTITION BY traj_idx ORDER BY pos) - 1 AS BIGINT) AS pos, pos AS source_index, frame_id, value FROM frames WHERE event_type <> 'error'"
PAIRS = "SELECT l_returnflag AS win, l_linestatus AS field, l_shipmode_level AS level, l_partkey % 16 AS leaf, l_quantity * p_retailprice / 1000 AS prediction, l_extendedprice / 1000 AS target FROM (SELECT *, l_linenumber % 3 AS l_shipmode_level FROM lineitem) l JOIN part ON l_partkey = p_partkey"
FIELD_SUMS = "SELECT CAST(l_partkey % 64 AS INT) AS x, CAST(l_suppkey % 64 AS INT) AS y, l_returnflag AS channel, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"
#: For each supplier two frames of two channels on a 64 x 64 grid.
FIELD_POINTS = "SELECT l_suppkey AS tree, CAST(l_linenumber % 2 AS INT) AS t, l_linestatus AS channel, CAST(l_partkey % 64 AS INT) AS x, CAST((l_partkey * 7 + l_orderkey) % 64 AS INT) AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4, 5"
ACCESS = "SELECT event_id, event_type AS key, CAST(user_id % 4 AS INT) AS rank, CAST(day(ts) % 2 AS INT) AS epoch, user_id, ts, event_id % 3 = 0 AS cache_hit FROM events"
#: A tree for each nation of suppliers, and where its spot is.
SPOTS = "SELECT s_nationkey AS tree, CAST(sum(s_suppkey) % 62 AS INT) AS sx, CAST(sum(s_suppkey * 7 + s_nationkey) % 62 AS INT) AS sy FROM supplier GROUP BY 1"
#: DuckDB text of the views.
SQL = {
    "frames": f"frames AS ({FRAMES})",
    "gappy": f"gappy AS ({GAPPY})",
    "pairs": f"pairs AS ({PAIRS})",
    "grid": "grid AS (SELECT a.range::INT AS x, b.range::INT AS y FROM range(64) a, range(64) b)",
    "field": f"sums AS ({FIELD_SUMS}), field AS (SELECT channel, x, y, coalesce(v, 0.0) AS v FROM grid CROSS JOIN (SELECT DISTINCT channel FROM sums) LEFT JOIN sums USING (x, y, channel))",
    "fields": f"points AS ({FIELD_POINTS}), fields AS (SELECT tree, t, channel, x, y, coalesce(v, 0.0) AS v FROM grid CROSS JOIN (SELECT DISTINCT tree, t, channel FROM points) LEFT JOIN points USING (tree, t, channel, x, y))",
    "smooth": f"spots AS ({SPOTS}), smooth AS (SELECT tree, x, y, 0.01::DOUBLE * (x / 64.0::DOUBLE + y / 64.0::DOUBLE) + CASE WHEN y BETWEEN sy AND sy + 1 AND x BETWEEN sx AND sx + 1 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM grid CROSS JOIN spots)",
    "access": f"acc0 AS ({ACCESS}), access AS (SELECT *, epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + (event_id % 7) * 1000000 AS source_ready_ns, epoch_us(ts) * 1000 + (event_id % 7 + event_id % 11) * 60000000000 AS end_ns, row_number() OVER (PARTITION BY epoch, rank ORDER BY ts, event_id) AS rank_sequence FROM acc0)",
    "patches": "patches AS (SELECT p_partkey AS patch_id, p_size % 3 AS level, (16 >> (p_size % 3))::INT AS side, p_retailprice AS v FROM part), placed AS (SELECT 0 AS tree, patch_id, level, v, ((patch_id * 7) % (64 // side) * side)::INT AS x0, ((patch_id * 5) % (64 // side) * side)::INT AS y0, ((patch_id * 7) % (64 // side) * side + side)::INT AS x1, ((patch_id * 5) % (64 // side) * side + side)::INT AS y1 FROM patches)",
}
NEEDS = {"gappy": ["frames"], "field": ["grid"], "fields": ["grid"], "smooth": ["grid"]}


def with_views(body: str, *names: str) -> str:
    """WITH the named views and what they need, then body, which may start with more views."""
    order: list[str] = []
    for n in names:
        order += [m for m in [*NEEDS.get(n, []), n] if m not in order]
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order) + ("\n" if body.lstrip().startswith("SELECT") else ",\n") + body


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark, d):
    return spark.sql(FRAMES.replace("FROM events", "FROM {events}"), events=load(spark, d, "events"))


def gappy(spark, d):
    return spark.sql(GAPPY.replace("FROM frames", "FROM {frames}"), frames=frames(spark, d))


def pairs(spark, d):
    return spark.sql(PAIRS.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part ", "JOIN {part} "), lineitem=load(spark, d, "lineitem"), part=load(spark, d, "part"))


def grid(spark):
    """A fixed 64 x 64 spine."""
    return spark.range(GRID * GRID).select((F.col("id") % GRID).cast("int").alias("x"), F.floor(F.col("id") / GRID).cast("int").alias("y"))


def field(spark, d):
    sums = spark.sql(FIELD_SUMS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=load(spark, d, "lineitem"))
    full = sums.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("x")).select("channel", "x", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("y"))
    return full.join(sums, ["channel", "x", "y"], "left").select("channel", "x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))


def fields(spark, d):
    """Frames of every supplier: as many trees as the table has suppliers, with its quantities as values."""
    points = spark.sql(FIELD_POINTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=load(spark, d, "lineitem"))
    frame = Window.partitionBy("tree", "t", "channel").orderBy("at")
    points = points.withColumn("at", F.col("x") * GRID + F.col("y"))
    # each point writes the empty pixels before it, the last one those behind it too: frames are filled
    # without a join, one side of which would be as large as the grids and look as small as their list
    before = F.coalesce(F.lag("at").over(frame), F.lit(-1))
    until = F.when(F.lead("at").over(frame).isNull(), F.lit(GRID * GRID - 1)).otherwise(F.col("at"))
    runs = points.select("tree", "t", "channel", "at", "v", before.alias("_from"), until.alias("_to"))
    full = runs.select("tree", "t", "channel", "at", "v", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("p"))
    v = F.when(F.col("p") == F.col("at"), F.coalesce("v", F.lit(0.0))).otherwise(F.lit(0.0))
    return full.select("tree", "t", "channel", F.floor(F.col("p") / GRID).cast("int").alias("x"), (F.col("p") % GRID).cast("int").alias("y"), v.alias("v"))


def smooth(spark, d):
    """A slope with one spot, on a grid for each tree."""
    spots = spark.sql(SPOTS.replace("FROM supplier", "FROM {supplier}"), supplier=load(spark, d, "supplier"))
    cells = spots.select("tree", "sx", "sy", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("y"))
    spot = F.when((F.col("y") - F.col("sy")).between(0, 1) & (F.col("x") - F.col("sx")).between(0, 1), 3.0).otherwise(0.0)
    return cells.select("tree", "x", "y", (0.01 * (F.col("x") / 64.0 + F.col("y") / 64.0) + spot).alias("v"))


def access(spark, d):
    a = spark.sql(ACCESS.replace("FROM events", "FROM {events}"), events=load(spark, d, "events"))
    us = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    a = a.withColumns({"start_ns": us, "source_ready_ns": us + F.col("event_id") % 7 * 1000000, "end_ns": us + (F.col("event_id") % 7 + F.col("event_id") % 11) * 60000000000})
    from meshlark.operators.windows import running_sum

    one = a.withColumn("one", F.lit(1).cast("long"))  # a running count over ranges: epochs and ranks are few, whatever the table
    return running_sum(one, ["epoch", "rank"], ["ts", "event_id"], "one", "rank_sequence").drop("one")


def patches(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("patch_id"), (F.col("p_size") % 3).alias("level"), F.expr("shiftright(16, p_size % 3)").alias("side"), F.col("p_retailprice").alias("v"))
    at = lambda k: F.expr(f"cast((patch_id * {k}) % cast(64 / side as int) * side as int)")
    return p.select(F.lit(0).alias("tree"), "patch_id", "level", "v", at(7).alias("x0"), at(5).alias("y0"), (at(7) + F.col("side")).alias("x1"), (at(5) + F.col("side")).alias("y1"))
