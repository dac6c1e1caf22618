import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relpipe.llm import langid

from .support import documents, odd_texts, words

ALPHABETS = {"xx": "aeiourt", "yy": "aäöshnd", "zz": "bcdñolp"}


def labelled(spark, n=60, seed=1):
    rng = random.Random(seed)
    langs = [list(ALPHABETS)[i % 3] for i in range(n)]
    return documents(spark, [words(rng, rng.randint(8, 60), ALPHABETS[lang]) for lang in langs], langs=langs, extra=True)


def test_counts_cover_the_whole_text_and_every_gram(monkeypatch):
    rng = random.Random(2)
    text = words(rng, 400)
    whole = langid.counts(text)
    # one letter, two letters and three letters at each place, over the text with a space at each end
    n = len(text) + 2
    assert whole.sum() == n + (n - 1) + (n - 2)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (langid.counts(text) == whole).all()
    assert (langid.counts("  12 " + text.upper() + "!!  ") == whole).all()
    assert langid.counts(None) is langid.counts("") is langid.counts(" 12 !?\n") is None


def test_learned_languages_are_told_apart(spark):
    docs = labelled(spark)
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert list(found[0].asDict()) == [*[c for c in docs.columns if c not in ("score", "rejected")], "lang_pred", "score", "rejected"]
    assert all(r.lang_pred == r.lang and not r.rejected and 0 <= r.score <= 1 for r in found)


def test_odd_texts(spark):
    model = langid.fit(labelled(spark))
    rows = {r.doc_id: r for r in langid.identify(documents(spark, odd_texts(), extra=True), model).collect()}
    for i in (0, 1, 2, 11):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows[5].asDict() | {"doc_id": 6} == rows[6].asDict() | {"source": rows[5].source}
    assert rows[8].lang_pred in ALPHABETS and rows[9].rejected  # letters of no learned language are too far away


def test_no_labels_and_empty_tables(spark):
    docs = labelled(spark)
    none = langid.fit(docs.filter("lang IS NULL"))
    assert none is None
    assert all(r.lang_pred == "und" for r in langid.identify(docs, none).collect())
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0
    assert langid.keep_identified(docs.limit(0)).columns == docs.columns


def test_pipeline_stage_keeps_clean_documents(spark):
    docs = labelled(spark, 90).unionByName(documents(spark, [None, "123 456", ""], extra=True, ids=[900, 901, 902]))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(90))


SCRIPTS = {"cyrillic": "абвгдежзийклмнопрстуфхцчшщыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "consonants": "bcdfghjklmnpqrstvwxz", "han": "".join(chr(0x4E00 + i) for i in range(1500))}


def test_unlearned_scripts_are_rejected_at_any_length_and_short_clean_texts_are_not(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learned(docs)
    rng = random.Random(5)
    texts = [words(rng, n, letters) for letters in SCRIPTS.values() for n in (5, 50, 500, 5000) for _ in range(10)]
    rows = langid.identify(documents(spark, texts), model).collect()
    assert sum(not r.rejected for r in rows if len(texts[r.doc_id].split()) > 5) == 0
    assert sum(not r.rejected for r in rows) <= 4
    # documents that their labels call good: few are rejected, short runs of them included
    good = docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").select("doc_id", "text")
    for part in (good, good.withColumn("text", F.regexp_extract("text", r"^(?:\S+\s+){0,9}\S+", 0))):
        found = langid.identify(part, model)
        assert found.filter("rejected").count() < 0.01 * part.count()
    assert langid.identify(docs, model).filter("rejected").count() > 0


@pytest.mark.parametrize(("lang", "least"), [("fr", 0.9), ("en", 0.95)])
def test_a_language_that_was_not_learned_is_rejected(spark, lang, least):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs.filter(F.col("lang") != lang))
    foreign = langid.identify(docs.filter(F.col("lang") == lang), model)
    assert foreign.filter("rejected").count() >= least * foreign.count()


def test_copies_of_one_text_leave_the_sample_to_others(spark):
    docs = labelled(spark, 60).select("doc_id", "text", "lang")
    many = spark.range(3000).selectExpr("id + 1000 AS doc_id", "'aaaa eeee aaaa' AS text", "'xx' AS lang")
    found = langid.identify(docs, langid.fit(docs.unionByName(many), per_language=30)).collect()
    assert all(r.lang_pred == r.lang for r in docs.join(spark.createDataFrame([(r.doc_id, r.lang_pred) for r in found], "doc_id bigint, lang_pred string"), "doc_id").collect())


def test_nearest_centroid_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learned(docs)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        c = langid.counts(r.text)
        v = np.log1p(c) * model.idf
        cosines = (v / np.linalg.norm(v)) @ model.centroids.T.astype(float)
        assert abs(rows[r.doc_id].score - min(1, cosines.max())) < 1e-4
        assert rows[r.doc_id].lang_pred in {model.langs[j] for j in np.flatnonzero(cosines > cosines.max() - 1e-5)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.query(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
