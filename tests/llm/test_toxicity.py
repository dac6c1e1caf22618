import math
import random
import zlib

from pyspark.sql import functions as F

from relpipe.llm import toxicity as tox
from relpipe.llm.common import learn_bucket

from .support import documents, odd_texts, words


def corpus(spark, n=240, seed=1):
    rng = random.Random(seed)
    bad = ["vileword", "awfulness", "nastyest"]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = words(rng, 30).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(toxic), 1))
    return documents(spark, texts, extra=True), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def brute(vectors, query, k):
    scores = [(sum(w * v.get(t, 0) for t, w in query.items()), -i) for i, v in enumerate(vectors)]
    return sorted((s for s in scores if s[0] > 0), reverse=True)[:k]


def test_block_max_search_is_exact():
    rng = random.Random(3)

    def vector(n):
        v = {rng.randrange(30): rng.random() for _ in range(n)}
        norm = sum(w * w for w in v.values()) ** 0.5
        return {t: w / norm for t, w in v.items()} if norm else {}

    vectors = [vector(rng.randint(0, 6)) for _ in range(333)]
    for block in (1, 7, 64, 1000):
        index = tox.BlockMaxIndex(vectors, 30, block)
        for k in (1, 5, 400):
            for _ in range(20):
                q = vector(rng.randint(0, 5))
                found, wanted = index.nearest(q, k), brute(vectors, q, k)
                assert [round(c, 9) for c, _ in found] == [round(c, 9) for c, _ in wanted]
    assert tox.BlockMaxIndex([], 5).nearest({1: 1.0}, 3) == []


def test_examples_teach(spark):
    docs, labels = corpus(spark)
    model = tox.fit(docs, labels)
    assert {"vileword", "vile*"} <= set(model.vocabulary)
    rows = tox.score_toxicity(docs, model).collect()
    assert list(rows[0].asDict()) == [*[c for c in docs.columns if c not in ("score", "evidence")], "score", "evidence"]
    for r in rows:
        assert (r.score >= 0.7) == (r.doc_id % 4 == 0)
        assert 0 <= r.score <= 1 and len(r.evidence) <= 3
        assert all(e.toxic == int(int(e.doc_id) % 4 == 0) for e in r.evidence)


def test_labels_decide_only_by_the_rows_given(spark):
    docs, labels = corpus(spark)
    same = tox.fit(docs.withColumnRenamed("lang", "l2"), labels.filter("doc_id < 200"))
    assert all(int(i) < 200 for i in same.ids)


def test_odd_texts_and_missing_labels(spark):
    docs, labels = corpus(spark)
    odd = documents(spark, odd_texts(), extra=True)
    rows = {r.doc_id: r for r in tox.score_toxicity(odd, tox.fit(docs, labels)).collect()}
    assert len(rows) == len(odd_texts()) and all(0 <= r.score < 0.7 for r in rows.values())
    assert rows[0].score == rows[1].score and rows[0].evidence == []
    for none in (labels.limit(0), labels.filter("toxic = 0"), labels.selectExpr("doc_id + 10000 AS doc_id", "toxic"), labels.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic")):
        model = tox.fit(docs, none)
        assert all(0 < r.score < 1 for r in tox.score_toxicity(odd, model).collect())
    assert tox.score_toxicity(odd.limit(0), tox.fit(docs, labels)).count() == 0


def test_query_equals_brute_force(spark):
    """Scores from all cosines, without index, stems' numbers or shortcuts; only the choice of terms and the two numbers of
    the calibration are the model's."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(learn_bucket(F.col("doc_id"), 3) != 1)
    model = tox.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def vector(text):
        v = {t: (1 + math.log(n)) * model.idf[model.vocabulary[t]] for t, n in tox.terms(text).items() if t in model.vocabulary and model.idf[model.vocabulary[t]]}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()} if norm else {}

    examples = [(vector(texts[i]), bool(y), w) for i, y, w in zip(model.ids, model.toxic, model.weight, strict=True)]
    rows = tox.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:: max(1, len(rows) // 400)]:
        v = vector(texts[r.doc_id])
        cosines = sorted(((sum(w * e.get(t, 0.0) for t, w in v.items()), -i) for i, (e, _, _) in enumerate(examples)), reverse=True)[: model.k]
        votes = [0.05 * (1 - model.base), 0.05 * model.base]
        for c, i in cosines:
            if c > 0:
                votes[examples[-i][1]] += c**6 * examples[-i][2]
        z = model.slope * math.log(votes[1] / votes[0]) + model.shift
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6, r.doc_id


def test_repeated_ids_of_documents_and_labels(spark):
    docs, labels = corpus(spark, 80)
    model = tox.fit(docs, labels)
    again = tox.fit(docs.unionByName(docs), labels.unionByName(labels).unionByName(labels))
    assert again.vocabulary == model.vocabulary and again.ids == model.ids and again.base == model.base


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = tox.query(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
