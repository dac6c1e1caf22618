import random

import pytest
import xxhash
from pyspark.sql import functions as F

from relpipe.llm import common, simhash
from relpipe.plans import physical_plan

from .support import documents, odd_texts, words


def brute_fingerprint(text):
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance=4):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def near_values(seed=3, groups=40, size=8):
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        v = rng.getrandbits(64)
        for _ in range(size):
            for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints_match_the_definition():
    rng = random.Random(0)
    for text in [*odd_texts(), *[words(rng, n) for n in range(12)], "A\x0bB\x1cc d\x85e f g", "Ä Ö Ü a b c"]:
        if text and "\x1c" in text or text and len(text) > 50_000:
            continue
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_only_ascii_space_separates_words():
    assert simhash.fingerprint("a\x1cb") == xxhash.xxh64_intdigest("a\x1cb".encode(), 42)
    assert simhash.fingerprint("a b c\x0bd") == xxhash.xxh64_intdigest("a b c d".encode(), 42)


def test_every_near_pair_meets_at_a_home_anchor():
    for width, t in ((21, 1), (22, 1), (16, 1), (9, 2), (32, 2)):
        checks, home, masks = simhash.code_masks(width, 1 + t)
        n = 2**checks - 1

        def syndrome(v, n=n):
            s = 0
            for i in range(1, n + 1):
                s ^= i if v >> (i - 1) & 1 else 0
            return s

        rng = random.Random(width)
        for _ in range(300):
            x = rng.getrandbits(width)
            y = x
            for b in rng.sample(range(width), rng.randint(0, t)):
                y ^= 1 << b
            anchor = x ^ home[syndrome(x)]
            assert syndrome(anchor) == 0 and (anchor ^ x).bit_count() <= 1
            assert anchor in {y ^ m for m in masks[syndrome(y)]}


@pytest.mark.parametrize(("hot", "blocks"), [(10_000, 3), (1, 3), (10_000, 2)])
def test_links_join_just_what_all_pairs_join(spark, hot, blocks):
    values = near_values()
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    edges = [(r.a, r.b) for r in simhash.links(fps, blocks=blocks, hot=hot, cell=16).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in edges) or hot == 1  # a forest may name a class by a farther member
    parent = {signed(v): signed(v) for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    wanted = brute_components(values)
    ours = {}
    for v in values:
        ours.setdefault(root(signed(v)), set()).add(v)
    brute = {}
    for v in values:
        brute.setdefault(wanted[v], set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, brute.values()))


def test_components_of_odd_documents(spark):
    texts = odd_texts()
    docs = documents(spark, [*texts, None, texts[5]], extra=True)
    found = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in enumerate([*texts, None, texts[5]])}
    classes = brute_components(sorted(set(fps.values())))
    for i, fp in fps.items():
        assert found[i].fp == signed(fp)
        assert found[i].component_id == min(j for j, g in fps.items() if classes[g] == classes[fp])
    assert found[0].component_id == found[1].component_id == found[2].component_id == 0


def test_null_and_repeated_ids_and_an_empty_table(spark):
    docs = documents(spark, ["x y z", "x y z", "other text here", None], ids=[None, 7, 7, None])
    found = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.simhash_components(docs).collect())
    assert found == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.keep_one_of_each(docs.limit(0)).columns == docs.columns


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    long = words(rng, 3000)
    near = long.replace(long.split()[1500], "changed", 1)
    texts = [long, "alone in the world today", long, near, "alone in the world today", "quite another thing said here"]
    docs = documents(spark, texts, extra=True)
    twice = docs.unionByName(docs.filter(F.col("doc_id").isin(0, 5)))
    kept = simhash.keep_one_of_each(twice)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 5]


def test_one_of_each_group_stays_where_ids_are_null_or_shared(spark):
    rng = random.Random(9)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    # three groups of null ids, two groups led by the id 7, and a row of id 7 that the id 3 leads
    texts, ids = [a, a, b, b, c, d, d, e, a + " more", e], [None, None, None, None, None, 7, 7, 7, 3, 8]
    docs = documents(spark, [*texts, "one and only", "one and only"], ids=[*ids, 7, 3], extra=True)
    fps = [simhash.fingerprint(t) for t in texts]
    classes = brute_components(sorted(set(fps)))
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(docs).collect()]
    groups = {classes[f] for f in fps}
    assert len(kept) == len(groups) + 1
    assert {classes[simhash.fingerprint(t)] for _, t in kept if t in texts} == groups
    assert kept.count((None, b)) == kept.count((None, c)) == kept.count((7, d)) == kept.count((7, e)) == kept.count((3, "one and only")) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = simhash.query(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: simhash.fingerprint(t) for i, t in docs.items()}
    classes = brute_components(sorted(set(fps.values())))
    low = {}
    for i in sorted(fps):
        low.setdefault(classes[fps[i]], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{v:016x}", low[classes[v]]) for i, v in fps.items()}
    assert len(rows) == len(docs)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is materialized."""
    seen, real = [], common.materialize

    def kept(df):
        seen.append(physical_plan(df))
        return real(df)

    for module in (common, simhash):
        monkeypatch.setattr(module, "materialize", kept)
    return seen


@pytest.mark.parametrize("hot", [48, 1])
def test_nothing_over_the_bound_is_broadcast(spark, monkeypatch, plans, hot):
    """However small Spark takes the files of a side to be: the driver would hold them."""
    monkeypatch.setattr(common, "SMALL", -1, raising=False)
    values = near_values(groups=6)
    fps = common.materialize(spark.createDataFrame([(signed(v),) for v in values], "fp bigint"))
    found = common.components(simhash.links(fps, hot=hot)).collect()
    wanted = brute_components(values)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.id)
    linked = [set(map(signed, (v for v in values if wanted[v] == w))) for w in set(wanted.values())]
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in linked if len(g) > 1)
    rows = simhash.simhash_components(documents(spark, odd_texts()))
    assert rows.count() == len(odd_texts())
    assert not [p for p in [*plans, physical_plan(rows)] if "BroadcastHashJoin" in p]


def test_no_ids_over_the_bound_are_broadcast_to_the_texts(spark, monkeypatch, plans):
    rng = random.Random(5)
    texts = [words(rng, 30) for _ in range(6)] * 2
    docs = common.materialize(documents(spark, texts, ids=[*range(6), 0, 1, *range(8, 12)]))
    wanted = sorted(map(tuple, simhash.keep_one_of_each(docs).collect()), key=str)
    monkeypatch.setattr(common, "SMALL", -1, raising=False)
    plans.clear()
    kept = simhash.keep_one_of_each(docs)
    assert sorted(map(tuple, kept.collect()), key=str) == wanted and {r[0] for r in wanted} == set(range(6)) and len(wanted) == 6
    assert not [p for p in [*plans, physical_plan(kept)] if "BroadcastHashJoin" in p]
