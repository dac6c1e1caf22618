import math
import random
import zlib

from pyspark.sql import functions as F

from relpipe.llm import quality as q

from .support import documents, odd_texts, words


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        texts.append(words(rng, 40) + "." if good else " | ".join(words(rng, 40).upper().split()))
        labels.append((i, int(good), 0))
    return documents(spark, texts, extra=True), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def holds(rule, values):
    return all(low < values[name] <= high for name, low, high in rule.bounds)


def test_the_compiled_expression_equals_the_rules(spark):
    docs, labels = corpus(spark)
    model = q.fit(docs, labels, "quality")
    assert 0 < len(model.rules) < 200 and all(len(r.bounds) <= 3 for r, _ in model.rules)
    rows = q.score_quality(docs, model).collect()
    assert list(rows[0].asDict()) == docs.columns  # a column of the result's name is replaced
    for r in rows:
        values = dict(zip(q.STATISTICS, q.statistics(r.text), strict=True))
        total = model.intercept + sum(w for rule, w in model.rules if holds(rule, values))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9
        assert (r.score >= 0.3) == (r.doc_id % 5 != 0)


def test_statistics():
    assert q.statistics(None) == q.statistics("") == (0.0,) * len(q.STATISTICS)
    s = dict(zip(q.STATISTICS, q.statistics("AB cd!\nAB cd!\n12 |"), strict=True))
    assert s["repeated_lines"] == 1 - 2 / 3 and s["upper"] == 0.5 and s["bars"] == 1 / 18 and s["distinct_words"] == 4 / 6
    for t in odd_texts():
        assert all(math.isfinite(x) for x in q.statistics(t))


def test_odd_texts_and_missing_labels(spark):
    docs, labels = corpus(spark)
    odd = documents(spark, odd_texts(), extra=True)
    model = q.fit(docs, labels, "quality")
    rows = q.score_quality(odd, model).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r.score <= 1 for r in rows)
    assert q.score_quality(odd.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.filter("quality = 1"), labels.selectExpr("doc_id + 10000 AS doc_id", "quality"), labels.withColumn("quality", F.lit(None).cast("int"))):
        scores = {r.score for r in q.score_quality(odd, q.fit(docs, none, "quality")).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.query(spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)
