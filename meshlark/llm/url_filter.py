"""URL filters [native]: a sort-merge range join of reversed-host keys with nested rules.

A rule (host, path) becomes the key ``reversed host + separator + path``, and thereby the interval
of all keys that begin so. A url gives one key for its host and for each parent domain that a rule
can name. Keys and both ends of the rule intervals are sorted together; a running count of open
intervals is the depth of the stack of active rules, and the last rule opened at the depth of a url
is the top of its stack, i.e. the longest rule nested around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import LOWER, UPPER, shuffle_partitions

SEP = "\u0001"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or end; empty where there is no ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(F.translate(host, SEP, "�"), r"\."))


def url_filter(urls: DataFrame, rules, url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Judge every row of urls; adds host, path, rule and verdict.

    rules: DataFrame or list of (action, host, path), action allow or block. A rule fits its host
    and every subdomain if the url's path starts with the rule's path. The longest fitting rule
    (host + path; the longer host at a tie) decides, block over allow where both name the same
    rule; a url with no fitting rule gets a null rule and ``default``.

    Null urls and urls without ``://`` have empty host and path and get the default. Repeated rows
    are judged each and kept each; other columns pass through, except that a column named like one
    of the four results is replaced. An empty table or rule list gives the expected empty or
    all-default result.

    Scale: urls are dealt over (top label, salt) groups, ``salts`` (default: the shuffle
    partitions) to a label, so a hot host or label is spread; only rule rows are replicated, once a
    salt. One shuffle; the windows stream their group in sorted order and spill.
    """
    spark = urls.sparkSession
    salts = salts or shuffle_partitions(spark)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
    labels = _reversed(F.translate("host", UPPER, LOWER))
    ruled = (
        rules.where("host is not null and path is not null and action is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action", labels.alias("labels"))
        .groupBy("host", "path", "labels")
        .agg(F.max("action").alias("action"))
    )
    bound = ruled.agg(F.max(F.size("labels")).alias("d"), F.max(F.length("path")).alias("p")).first()
    depth, longest = bound["d"] or 0, bound["p"] or 0

    key = lambda labels, path: F.concat(F.concat_ws(".", labels), F.lit(SEP), path).cast("binary")
    rule = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("nh"), F.concat("host", "path").alias("rule"), "action")
    start = ruled.select(F.col("labels")[0].alias("top"), key(F.col("labels"), F.col("path")).alias("pos"), rule.alias("rule"))
    ends = F.array(F.struct("pos", F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.concat("pos", F.lit(b"\xff")).alias("pos"), F.lit(2).alias("kind"), F.lit(-1).alias("step")))
    row = F.struct(*[F.col(c) for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url_col])
    keyed = urls.select(row.alias("row"), F.monotonically_increasing_id().alias("rid"))
    url = F.col("row").getField(url_col)
    keyed = keyed.withColumns({"host": url_host(url), "path": url_path(url)}).withColumn("labels", _reversed(F.col("host")))
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("labels"), F.lit(depth)))), lambda n: key(F.slice("labels", 1, n), F.substring("path", 1, longest)))
    keyed = keyed.select(F.col("labels")[0].alias("top"), F.pmod("rid", F.lit(salts)).cast("int").alias("salt"), "rid", "row", "host", "path", F.explode(ups).alias("pos"))

    dealt = start.select("top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "rule", F.explode(ends).alias("e")).select("top", "salt", "rule", "e.pos", "e.kind", "e.step")
    events = keyed.withColumns({"kind": F.lit(1), "step": F.lit(0)}).unionByName(dealt, allowMissingColumns=True)
    sweep = Window.partitionBy("top", "salt").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("top", "salt", "depth").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("depth", F.sum("step").over(sweep))
    opened = F.last(F.when(F.col("kind") == 0, F.col("rule")), ignorenulls=True).over(level)
    best = (
        swept.withColumn("hit", F.when(F.col("depth") > 0, opened))
        .where("kind = 1")
        .groupBy("top", "salt", "rid")
        .agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("hit").alias("hit"))
    )
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return best.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))
