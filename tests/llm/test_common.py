import os
import random

from pyspark.sql import functions as F

from relpipe.llm import common


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(i, (i + 1) % 30 + 900) for i in range(900, 930)] + [(7, 7), (3, 9), (9, 3)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    wanted = {(v, root(v)) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    found = common.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sample_is_bounded_and_whole_where_small(spark):
    df = spark.range(10_000).withColumn("g", F.when(F.col("id") < 9_900, "big").when(F.col("id") < 9_990, "small"))
    found = {r.g: r["count"] for r in common.bounded_sample(df, "g", 500, "id").groupBy("g").count().collect()}
    assert found == {"small": 90, None: 10, "big": 500}


def test_copies_neither_fill_a_sample_nor_empty_it(spark):
    copies = spark.range(20_000).selectExpr("'copied' AS text", "'xx' AS lang")
    others = spark.range(100).selectExpr("concat('text ', id) AS text", "'xx' AS lang")
    for more in range(4):  # whatever the copies' hash is beside the others'
        df = copies.selectExpr(f"concat(text, {more}) AS text", "lang").unionByName(others)
        assert common.bounded_sample(df, "lang", 1500, "text").count() == 101
        assert common.bounded_sample(df, "lang", 50, "text").count() == 50
    assert common.bounded_sample(others.limit(0), "lang", 5, "text").count() == 0


def test_labelled_sample_with_repeated_ids(spark):
    docs = spark.range(300).selectExpr("id % 100 AS doc_id", "concat('t', id) AS text").unionByName(spark.range(5000).selectExpr("7L AS doc_id", "'t7' AS text"))
    labels = spark.range(4000).selectExpr("IF(id < 2000, 7, id % 100) AS doc_id", "CAST(IF(id < 2000, 1, id % 2) AS INT) AS toxic")
    sample, sizes = common.labelled_sample(docs, labels, "toxic", 30)
    rows = sample.collect()
    assert sizes == {0: 50, 1: 50} and len(rows) == 60 == len({(r.doc_id, r.label) for r in rows})
    assert all(r.label == r.doc_id % 2 for r in rows)
    assert all(r.text == min(f"t{r.doc_id + k}" for k in (0, 100, 200)) for r in rows)


def test_materialized_folders_can_be_deleted(spark):
    df = common.materialize(spark.range(3).toDF("x"))
    path = common._written[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    mark = common.written()
    other = common.materialize(spark.range(2).toDF("x"))
    common.forget(spark, mark)
    assert os.path.isdir(path) and common.written() == mark and other.columns == ["x"]
    common.forget(spark)
    assert not os.path.exists(path)


def test_unique_names(spark):
    df = spark.createDataFrame([(1, 2)], "__A int, ___a int")
    assert common.unique_name(df, "a") == "____a"
