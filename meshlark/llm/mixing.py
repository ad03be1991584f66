"""Mixing sources to target weights [native]: hash-seeded Poisson replication and a global shuffle."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import numbered, place

#: 13 hexadecimal digits of a digest are a number below 2**52, exact in a double.
HEX, SCALE = 13, float(2**52)
#: A larger rate is the sum of parts of at most this one; parts of a row are made so many at a time.
PART_RATE, PARTS_AT_ONCE = 64.0, 1024


def hash_uniform(*parts: Column) -> Column:
    """In [0, 1), from md5 over the parts joined by colons; null parts count as the text null."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("bigint").cast("double") / F.lit(SCALE)


def poisson_cdf(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until it no longer differs from 1 in a double."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        if k > rate and 1.0 - total < 2**-53 or k > rate + 40 * math.sqrt(rate) + 60:
            return out
        k += 1


def source_rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", text_col: str = "text", budget_chars: float | None = None) -> tuple[dict[str, float], float]:
    """Target repetitions of each listed source, and of all others together.

    A source's rate is weight * budget / its characters; what the listed weights leave of 1 goes to
    the other sources (null included) in proportion to their size. budget_chars: by default the
    size of the input. At most len(weights) + 1 sums come to the driver.
    """
    if any(not 0 <= w <= 1 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are shares of the whole: each from 0 to 1, and no more than 1 in all")
    rows, source = numbered(docs), F.col(place(docs, source_col))
    named = F.when(source.isin(*weights), source) if weights else F.lit(None).cast("string")
    sums = {r["s"]: float(r["n"] or 0) for r in rows.groupBy(named.alias("s")).agg(F.sum(F.length(place(docs, text_col))).alias("n")).collect()}
    total = budget_chars if budget_chars is not None else sum(sums.values())
    rest = max(0.0, 1.0 - sum(weights.values()))
    rate = lambda w, n: w * total / n if n > 0 else 0.0
    return {s: rate(w, sums.get(s, 0.0)) for s, w in weights.items()}, rate(rest, sums.get(None, 0.0))


def mix(docs: DataFrame, weights: dict[str, float], seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget_chars: float | None = None) -> DataFrame:
    """Replicate documents to the target weights; adds copy (from 1) and shuffle_key.

    A row's count inverts the Poisson distribution with its source's rate at a number hashed from
    (seed, id), so it needs no state and is the same in every run. Rows with count 0 go: that is the
    sampling. A null text has no characters, a null source is one of the unlisted; rows that repeat
    an id get equal counts; an empty table gives an empty result. Input columns named copy or
    shuffle_key, in any case, are replaced; others, whatever their names, pass through. Weights
    outside 0 to 1, or of more than 1 together, raise ValueError.

    A rate over PART_RATE is drawn as a sum of independent parts of equal rates, each with a hash of its
    own, made PARTS_AT_ONCE at a time in different tasks: neither the plan nor an array grows with the
    rate. Copies of all rows are then numbered by part, unique but with gaps, and copy is a long.

    The rows are dealt out by shuffle_key, a digest of (seed, id, copy), and sorted by it within
    each partition: a global shuffle without a sampling pass, even whatever the sources' sizes.
    """
    rates, other = source_rates(docs, weights, source_col, text_col, budget_chars)
    rows, doc, source = numbered(docs), F.col(place(docs, id_col)), F.col(place(docs, source_col))
    parts = lambda rate: max(1, math.ceil(rate / PART_RATE))
    listed = lambda f: reduce(lambda rest, s: F.when(source == s, f(rates[s])).otherwise(rest), reversed(list(rates)), f(other))
    count = lambda rate: F.size(F.filter(F.array(*[F.lit(p) for p in poisson_cdf(rate / parts(rate))]), lambda p: p <= F.col("u")))
    many = listed(lambda rate: F.lit(parts(rate)).cast("long"))
    drawn = rows.where(many == 1).select("*", hash_uniform(F.lit(seed), doc).alias("u"), F.lit(0).cast("long").alias("part"))
    if max(parts(r) for r in (*rates.values(), other)) > 1:
        some = rows.where(many > 1).select("*", many.alias("many")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / PARTS_AT_ONCE))).alias("lot")).repartition("lot", doc)
        last = F.least(F.col("many"), (F.col("lot") + 1) * PARTS_AT_ONCE) - 1
        some = some.select("*", F.explode(F.sequence(F.col("lot") * PARTS_AT_ONCE, last)).alias("part"))
        drawn = drawn.unionByName(some.select(*rows.columns, hash_uniform(F.lit(seed), F.lit("part"), F.col("part"), doc).alias("u"), "part"))
    kept = {f"c{i}": c for i, c in enumerate(docs.columns) if c.lower() not in ("copy", "shuffle_key")}
    out = drawn.select("*", listed(count).alias("n")).where("n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    copy = F.col("k") if max(parts(r) for r in (*rates.values(), other)) == 1 else F.col("part") * F.lit(len(poisson_cdf(PART_RATE))) + F.col("k")
    out = out.withColumn("copy", copy)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(doc.cast("string"), F.lit("null")), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    out = out.select(*kept, "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return out.toDF(*kept.values(), "copy", "shuffle_key")
