"""Held-out accuracy of the toxicity score, and odd rows."""

import random

from conftest import DATA

from meshlark.llm import queries
from meshlark.llm.toxicity import fit, score


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    d = f"{DATA}/sf0.1"
    got = queries.op6_toxicity(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert auc([(r.score, r.toxic) for r in rows]) > 0.93
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_odd_rows(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    plain = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    toxic = [" ".join(rng.choices(words, k=30)) + " worthless scoundrel " + " ".join(rng.choices(words, k=30)) + " scoundrel" for _ in range(120)]
    model = fit(toxic, plain)
    rows = [(1, toxic[0], 0.5), (2, plain[-1], 0.1), (3, None, None), (4, "", 0.0), (None, "x " * 200_000, 1.0), (1, toxic[0], 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4]
    assert auc([(model.score(t), 1) for t in toxic] + [(model.score(t), 0) for t in plain]) > 0.9
    assert score(df.limit(0), model).count() == 0
    assert 0 < fit([], plain).score("anything") < 0.5


def test_one_long_text_does_not_end_the_training(spark):
    from conftest import DATA
    from pyspark.sql import functions as F

    from meshlark.llm import toxicity

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    toxic = labels.where("toxic = 1").where(~toxicity.held_out(F.col("doc_id")))
    first = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    longer = docs.withColumn("text", F.when(F.col("doc_id") == first, F.expr(f"repeat(text, cast({toxicity.TOXIC_CHARS} / length(text) as int) + 1)")).otherwise(F.col("text")))
    probe = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic")

    def gap(rows):
        model = toxicity.train(rows, labels)
        means = {r.toxic: r.s for r in toxicity.score(probe, model).groupBy("toxic").agg(F.avg("score").alias("s")).collect()}
        return means[1] - means[0]

    whole = gap(docs)
    assert whole > 0.5 and gap(longer) > 0.9 * whole
