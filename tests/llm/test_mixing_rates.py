"""Mixing at rates of a million: parts, spread over tasks, with neither plan nor arrays that grow."""

import math
import time

from pyspark.sql import functions as F

from meshlark.llm import mixing


def test_a_rate_of_a_million(spark):
    docs = spark.createDataFrame([(0, "small", "x")] + [(k, "big", "y" * 100_000) for k in range(1, 21)], "doc_id long, source string, text string")
    began = time.time()
    out = mixing.mix(docs, {"small": 0.5})
    n = {r.source: (r.n, r.copies) for r in out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "copy").alias("copies")).collect()}
    assert time.time() - began < 60
    assert abs(n["small"][0] - 1_000_010) < 5 * math.sqrt(1e6) and n["small"][0] == n["small"][1]
    assert len(out._jdf.queryExecution().logical().toString()) < 200_000


def test_small_rates_are_drawn_as_before(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], "t" * 10) for k in range(400)], "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.copy) for r in mixing.mix(docs, {"a": 0.9}).collect())
    rates, other = mixing.source_rates(docs, {"a": 0.9})
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.hash_uniform(F.lit("mix-1"), F.col("doc_id")).alias("u")).collect()}
    count = lambda k: sum(p <= u[k] for p in mixing.poisson_cdf(rates["a"] if k % 2 == 0 else other))
    assert got == sorted((k, c) for k in u for c in range(1, count(k) + 1))


def test_large_rates_have_the_variance_of_a_poisson(spark):
    docs = spark.createDataFrame([(k, "a", "x") for k in range(300)] + [(1000 + k, "b", "y" * 700) for k in range(100)], "doc_id long, source string, text string")
    rates, _ = mixing.source_rates(docs, {"a": 0.5})
    assert rates["a"] > mixing.PART_RATE
    n = [r["count"] for r in mixing.mix(docs, {"a": 0.5}).where("source = 'a'").groupBy("doc_id").count().collect()]
    mean = sum(n) / len(n)
    assert abs(mean - rates["a"]) < 5 * math.sqrt(rates["a"] / 300)
    assert 0.6 < sum((x - mean) ** 2 for x in n) / len(n) / rates["a"] < 1.5
