import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relpipe.llm import mixing

from .support import documents, odd_texts, words


def brute_count(doc_id, rate, seed=42):
    draws = math.ceil(rate / mixing.RATE)
    total = 0
    for i in range(1, draws + 1):
        name = f"{seed}:{'null' if doc_id is None else doc_id}:{i}"
        u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / draws)
        k = 0
        while c <= u and k < mixing.COUNTS:
            k += 1
            p = p * (rate / draws) / k
            c += p
            total += 1
    return total


def test_counts_are_the_inverse_of_poisson(spark):
    sources = ["a"] * 200 + ["b"] * 50 + [None] * 20 + ["rare"]
    docs = documents(spark, [words(random.Random(i), 3) for i in range(271)], sources=sources, extra=True)
    weights = {"a": 1.0, "b": 3.0, "rare": 2.0, None: 1.0}
    rate = {s: w / 7 * 271 / n for (s, w), n in zip(weights.items(), (200, 50, 1, 20), strict=True)}
    out = mixing.mix(docs, weights, copy_col="nth")
    found = Counter(r.doc_id for r in out.collect())
    for i, s in enumerate(sources):
        assert found[i] == brute_count(i, rate[s]), (i, s)
    assert out.drop("nth").columns == docs.columns
    assert {(r.doc_id, r.nth) for r in out.collect()} == {(i, k) for i, n in found.items() for k in range(1, n + 1)}


def test_shares_come_near_their_targets(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 9 THEN 'hot' ELSE 'cold' END AS source", "'x' AS text")
    found = {r.source: r["count"] for r in mixing.mix(docs, {"hot": 1, "cold": 1}).groupBy("source").count().collect()}
    assert abs(found["hot"] - 10_000) < 400 and abs(found["cold"] - 10_000) < 1_000


def test_order_is_global_and_repeatable(spark):
    docs = documents(spark, [str(i) for i in range(300)])
    one = [(r.doc_id, r.place) for r in mixing.mix(docs, {}, order_col="place", copy_col="nth").collect()]
    assert Counter(one) == Counter((r.doc_id, r.place) for r in mixing.mix(docs.repartition(7), {}, order_col="place", copy_col="nth").collect())
    assert [i for i, _ in one] != sorted(i for i, _ in one)


def test_odd_cases(spark):
    docs = documents(spark, odd_texts(), extra=True)
    out = mixing.mix(docs, {"src0": 0.0})
    assert "src0" not in {r.source for r in out.collect()}
    assert {r.text for r in out.collect()} <= set(odd_texts())
    assert mixing.mix(docs.limit(0), {}).count() == 0
    twice = Counter(r.doc_id for r in mixing.mix(docs.unionByName(docs), {}).collect())
    assert all(n % 2 == 0 for n in twice.values())
    assert mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long")), {}).count() % len(odd_texts()) in range(len(odd_texts()))
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(docs, {"a": -1.0})


def test_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    result = con.sql(mixing.ORACLE_SQL)
    df = mixing.query(spark, sf).select(*result.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, result.fetchall()))
