import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from relpipe.llm import orderminhash as omh

from .support import documents, odd_texts, words

MASK = (1 << 64) - 1


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def chain(longs, seed=42):
    for v in longs:
        seed = xx(struct.pack("<Q", v & MASK), seed)
    return seed


def brute_codes(text, keep=2):
    """The fingerprint's entries by the definition, in plain Python: each ranks all numbered k-mers by its own hash."""
    t = (text or "").strip(" ")
    if not re.search(r"\S", t, re.ASCII):
        return []
    tokens = [part for w in re.split(r"\s+", t, flags=re.ASCII) for part in (w if len(w) > omh.LONG_WORD else [w])]
    h = [xx(w.encode()) for w in tokens]
    kmers = [chain(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) > 5 else [chain(h)]
    seen, ranked = {}, []
    for pos, k in enumerate(kmers):
        k >>= 32
        n = seen[k] = seen.get(k, -1) + 1
        ranked.append((xx(struct.pack("<i", n), xx(struct.pack("<Q", k))) >> 32, pos))
    out = []
    for e in range(64):
        least = sorted(ranked, key=lambda x: ((x[0] - (e << 26)) % (1 << 32), x[1]))[:keep]
        out.append(chain([u for u, _ in sorted(least, key=lambda x: (x[1], x[0]))]) & 0xFFFF)
    return out


def codes(spark, texts):
    df = omh.with_codes(documents(spark, texts, extra=True), "text", "codes")
    return {r.doc_id: list(r.codes) for r in df.select("doc_id", "codes").collect()}


def test_codes_equal_the_definition(spark):
    rng = random.Random(1)
    vocabulary = words(rng, 6).split()
    texts = odd_texts() + [words(rng, n) for n in range(12)] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(60)] + ["x " * 500]
    found = codes(spark, texts)
    for i, text in enumerate(texts):
        assert found[i] == brute_codes(text), repr(text)[:80]


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(3)
    base = words(rng, 600).split()
    other = words(rng, 600)
    few = base[:]
    few[100] = "edited"
    blocks = base[300:] + base[:300]
    shuffled = base[:]
    rng.shuffle(shuffled)
    texts = [" ".join(base), " ".join(few), " ".join(base[:300] + other.split()[:300]), " ".join(blocks), " ".join(shuffled), other]
    df = omh.with_codes(documents(spark, texts), "text", "codes").select("doc_id", "codes")
    first = df.filter("doc_id = 0").select(F.col("codes").alias("a"))
    like = {r.doc_id: r.s for r in df.crossJoin(first).select("doc_id", omh.likeness(F.col("a"), F.col("codes")).alias("s")).collect()}
    assert like[0] == 1.0 and like[1] > 0.9 and 0.3 < like[2] < 0.7 and like[4] < 0.1 and like[5] < 0.1
    # the same k-mers in another order are less alike: what a bag of k-mers cannot see
    assert like[1] > like[3] > like[5]


def independent(text, draws=64, keep=2):
    """Order MinHash with an independent hash for each entry."""
    h = [xx(w.encode()) for w in text.split()]
    kmers = [chain(h[i : i + 5]) for i in range(len(h) - 4)]
    return [tuple(k for _, _, k in sorted(sorted((xx(struct.pack("<Q", k), e), i, k) for i, k in enumerate(kmers))[:keep], key=lambda x: x[1])) for e in range(draws)]


@pytest.mark.parametrize(("n", "tolerance"), [(20, 0.08), (40, 0.06), (60, 0.06), (150, 0.06)])
def test_moved_blocks_are_seen_in_short_texts_as_by_independent_hashes(spark, n, tolerance):
    rng = random.Random(n)
    pairs, wanted = [], []
    for _ in range(20):
        w = words(rng, n).split()
        q = n // 4
        moved = w[3 * q :] + w[2 * q : 3 * q] + w[q : 2 * q] + w[:q]
        pairs += [" ".join(w), " ".join(moved)]
        wanted.append(sum(x == y for x, y in zip(independent(pairs[-2]), independent(pairs[-1]), strict=True)) / 64)
    found = codes(spark, pairs)
    share = [sum(x == y for x, y in zip(found[i], found[i + 1], strict=True)) / 64 for i in range(0, 40, 2)]
    assert abs(sum(share) - sum(wanted)) / 20 < tolerance


def test_one_long_word_does_not_change_the_words_around_it(spark):
    rng = random.Random(7)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(200))
    df = omh.with_codes(documents(spark, [base, base + " x", base + " " + "".join(rng.choice("abcdefgh") for _ in range(50))]), "text", "codes")
    first = df.filter("doc_id = 0").select(F.col("codes").alias("a"))
    like = {r.doc_id: r.s for r in df.crossJoin(first).select("doc_id", omh.likeness(F.col("a"), F.col("codes")).alias("s")).collect()}
    assert like[1] > 0.95 and like[2] > 0.75


@pytest.mark.parametrize("most", [2, 4096])
@pytest.mark.parametrize("rows_per_block", [1, 3, 1000])
@pytest.mark.parametrize("ids", [list(range(14)), [5, 5, 5, None, None, 7, 1, 2, 900, 901, -4, 12, 13, 5]])
def test_next_row(spark, ids, rows_per_block, most):
    docs = documents(spark, odd_texts(), ids=ids, extra=True).withColumn("text", F.coalesce("text", F.lit("")))
    found = omh.with_next(docs, "doc_id", ("doc_id", "text"), rows_per_block=rows_per_block, most=most).collect()
    assert len(found) == len(ids)
    ordered = sorted(ids, key=lambda i: (i is not None, i or 0))
    follows = list(zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert sorted(map(str, follows)) == sorted(str((r.doc_id, r.next_doc_id)) for r in found)
    assert sorted(r.next_text for r in found) == sorted(r.text for r in found)  # each row is the next of one row


@pytest.mark.parametrize("most", [3, 4096])
def test_no_id_fills_a_block(spark, most):
    ids = [None] * 1500 + [7] * 1500 + list(range(1500))
    rng = random.Random(4)
    docs = documents(spark, [words(rng, 3) for _ in ids], ids=ids).select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    blocks = omh.with_blocks(docs, "doc_id", "tie", "block", 100, most).persist()
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert max(sizes) <= (300 if most > 45 else 900) and sum(sizes) == len(ids)
    spans = sorted((r.block, r.lo, r.hi) for r in blocks.withColumn("k", F.struct(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("i"), "tie")).groupBy("block").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))
    blocks.unpersist()
    found = omh.with_next(docs.select("doc_id", "text"), "doc_id", ("doc_id",), rows_per_block=100, most=most).collect()
    ordered = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(map(str, zip(ordered, ordered[1:] + ordered[:1], strict=True))) == sorted(str((r.doc_id, r.next_doc_id)) for r in found)


@pytest.mark.parametrize("n_heavy", [0, 500])
def test_more_blocks_than_an_int_has_room_for(spark, n_heavy):
    """The blocks' numbers are multiplied by 2 ** 21: from 1024 blocks on, as of about 2 million documents."""
    docs = spark.range(2500).unionByName(spark.range(n_heavy).selectExpr("2499L AS id")).selectExpr("id AS doc_id", "id AS tie")
    blocks = omh.with_blocks(docs, "doc_id", "tie", "block", 1 if not n_heavy else 2, 4096)
    found = blocks.groupBy("doc_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).orderBy("doc_id").collect()
    assert len(found) == 2500 and len({r.lo for r in found}) > 1023
    assert all(a.hi <= b.lo for a, b in zip(found, found[1:], strict=False))


def test_fingerprints(spark):
    texts = odd_texts()
    docs = documents(spark, texts, extra=True)
    rows = {r.doc_id: r for r in omh.fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].fingerprint == "".join(f"{c:04x}" for c in brute_codes(text))
        assert rows[i].edited_fingerprint == "".join(f"{c:04x}" for c in brute_codes(edited))
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[0].near_next == 1.0 and rows[5].near_next == 1.0
    assert omh.fingerprints(docs.limit(0)).count() == 0
    alone = omh.fingerprints(docs.filter("doc_id = 5")).collect()
    assert alone[0].near_next == 1.0


def test_no_python_runs_on_the_executors(spark):
    plan = omh.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
