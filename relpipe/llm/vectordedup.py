"""Near-duplicate embeddings by range search on a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to shards around clustered centres, each node to its few nearest, so that shards
overlap; where many centres are needed, a shard's nodes are dealt again, around centres of its own. Shards that are still
too large are cut at random and searched piece against piece. In each shard every node's candidates (its nearest members,
and some members at random that give long edges) are robust-pruned: a candidate goes where one already chosen is nearer to
it by the factor alpha. Adjacency lists of all shards are united into one flat graph.

Every node is searched for in each of its shards: greedily from the shard's medoid, and on from all nodes within range until
no more turn up, along those edges of the united graph that stay in the shard. Found pairs are verified in double precision
and counted where they are found; of two shards that hold both nodes of a pair, only the one of the least number counts it.
So neither pairs nor vectors leave a shard, only numbers of links and a spanning forest. Recall is audited against all
nodes; where it falls short, each node goes to more shards, and in the end all nodes are compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, hash_fraction, materialize, table

#: Nodes for one centre, and rows of a piece of a shard.
SHARD, CELL = 400, 1600
DEGREE, NEAR, FAR, ALPHA = 16, 64, 32, 1.2
BEAM, EXPAND, QUERIES = 24, 4, 512
#: Centres of one level.
CENTRES = 2048
#: Numbers of nearest centres that a node goes to, tried one after the other; after the last, all nodes are compared.
SPREADS = (3, 6, 12)


def unit(v) -> np.ndarray | None:
    """v scaled to length 1 in double precision; None where it is null, zero, or has null or non-finite components."""
    if v is None:
        return None
    x = np.asarray(v, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def prune(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of x."""
    m = len(x)
    rng = np.random.default_rng(seed)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    near = min(NEAR, m - 1)
    if near <= 0:
        return [np.zeros(0, dtype=np.int64) for _ in range(m)]
    cand = np.concatenate([np.argpartition(-sims, near - 1, axis=1)[:, :near], rng.integers(0, m, (m, FAR))], axis=1)
    own = np.arange(m)[:, None]
    dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, cand, axis=1)))
    alive = cand != own
    chosen = [[] for _ in range(m)]
    np.fill_diagonal(sims, 1)
    for _ in range(DEGREE):
        best = np.where(alive, dist, np.inf).argmin(axis=1)
        some = alive[own[:, 0], best]
        if not some.any():
            break
        pick = cand[own[:, 0], best]
        for i in np.flatnonzero(some).tolist():
            chosen[i].append(pick[i])
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[pick[:, None], cand]))
        alive &= (ALPHA * between > dist) & (cand != pick[:, None]) | ~some[:, None]
    return [np.array(c, dtype=np.int64) for c in chosen]


def search(x: np.ndarray, starts: np.ndarray, links: np.ndarray, queries: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with a product of at least `low` that range-expanding greedy search finds.

    x: rows; starts, links: their adjacency lists end to end; the search starts at the medoid.
    """
    m = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), QUERIES):
        q = queries[a : a + QUERIES]
        sims = np.full((len(q), m), -2.0, dtype=np.float32)
        done = np.zeros((len(q), m), dtype=bool)
        sims[:, medoid] = q @ x[medoid]

        def expand(qs: np.ndarray, nodes: np.ndarray, q=q, sims=sims, done=done) -> None:
            done[qs, nodes] = True
            n = starts[nodes + 1] - starts[nodes]
            flat = np.repeat(starts[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            key = np.unique(np.repeat(qs, n) * m + links[flat])
            key = key[sims.reshape(-1)[key] < -1.5]
            for i in range(0, len(key), 1 << 17):
                k = key[i : i + (1 << 17)]
                sims.reshape(-1)[k] = np.einsum("ij,ij->i", q[k // m], x[k % m])

        beam = min(BEAM, m)
        active = np.arange(len(q))
        while len(active):
            top = np.argpartition(-sims[active], beam - 1, axis=1)[:, :beam]
            value = np.take_along_axis(sims[active], top, axis=1)
            value[np.take_along_axis(done[active], top, axis=1) | (value < -1.5)] = -3
            best = np.argsort(-value, axis=1)[:, :EXPAND]
            ok = np.take_along_axis(value, best, axis=1) > -3
            keep = ok.any(axis=1)
            rows, cols = np.nonzero(ok)
            if len(rows):
                expand(active[rows], np.take_along_axis(top, best, axis=1)[rows, cols])
            active = active[keep]
        while len((more := np.nonzero((sims >= low - 0.05) & ~done))[0]):
            expand(*more)
        qs, rows = np.nonzero(sims >= low - 1e-4)
        found.append((qs + a, rows))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node of the class, node) that join just what the pairs (a, b) join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[far]], nodes[far]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[: min(k, len(x))]]
    for _ in range(8):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def _units(column: pd.Series, dtype=np.float32) -> np.ndarray:
    return np.stack([unit(v) for v in column]).astype(dtype)


def _centres(nodes: DataFrame, n: int, sample: int = 1 << 22) -> dict[int, np.ndarray]:
    """By length of vector: a centre for SHARD nodes, CENTRES at most, fitted on a bounded sample (at most about `sample`
    numbers over all lengths). Lengths that the sample does not have are not in it."""
    share = hash_fraction(F.col("node"), F.lit("centre"))
    total = nodes.agg(F.sum(F.size("v"))).first()[0] or 1
    few = min(1.0, sample / total, 32 * CENTRES / n)
    got = nodes.filter(share < few).orderBy("node").limit(2 * sample).select("v").collect()
    of: dict[int, list] = {}
    for r in got:
        of.setdefault(len(r.v), []).append(unit(r.v))
    return {size: _cluster(np.array(vs, dtype=np.float32), max(1, min(CENTRES, round(len(vs) / few / SHARD)))) for size, vs in of.items()}


def _dealt(nodes: DataFrame, centres: dict[int, np.ndarray], spread: int) -> DataFrame:
    """(node, copies, v, shard) of each node's nearest centres; a shard is a length of vector and a centre."""
    kind = nodes.schema["v"].dataType.simpleString()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf.v.map(len)):
                c = centres.get(size)
                near = np.zeros((len(part), 1), dtype=np.int64) if c is None else np.argsort(-(_units(part.v) @ c.T), axis=1, kind="stable")[:, :spread]
                r = near.shape[1]
                yield pd.DataFrame({"node": np.repeat(part.node.to_numpy(), r), "copies": np.repeat(part.copies.to_numpy(), r), "v": [v for v in part.v for _ in range(r)], "shard": near.reshape(-1) + (size << 32)})

    return nodes.mapInPandas(deal, f"node long, copies long, v {kind}, shard long")


def _dealt_again(dealt: DataFrame, spread: int, chunk: int = 20_000) -> DataFrame:
    """The nodes of shards that are large for one level of centres are dealt around centres of the shard, a bounded number
    fitted on a bounded sample of it; such a shard is named by the old one's number and the new centre's."""
    most = 4 * spread * CELL
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    if sizes.isEmpty():
        return dealt
    sizes = materialize(sizes)
    kind = dealt.schema["v"].dataType.simpleString()
    large = dealt.join(F.broadcast(sizes), "shard")  # a row a centre of the first level at most
    sample = large.filter(hash_fraction(F.col("node"), F.lit("again")) < F.least(F.lit(1.0), F.lit(32.0 * CENTRES) / F.col("n")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        c = _cluster(_units(pdf.v), max(1, min(CENTRES, round(spread * pdf.n.iloc[0] / SHARD / 2))))
        return pd.DataFrame({"shard": pdf.shard.iloc[0], "c": [v.astype(float) for v in c]})

    fitted = materialize(sample.groupBy("shard").applyInPandas(fit, "shard long, c array<double>"))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = large.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts))
    centres = fitted.join(F.broadcast(sizes), "shard").select("shard", "c", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))

    def deal(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(own):
            return pd.DataFrame({"node": [], "copies": [], "v": [], "shard": []})
        c = np.stack(sorted(own.c.to_list(), key=lambda v: v.tolist())).astype(np.float32)
        near = np.argsort(-(_units(pdf.v) @ c.T), axis=1, kind="stable")[:, :spread]
        r = near.shape[1]
        return pd.DataFrame({"node": np.repeat(pdf.node.to_numpy(), r), "copies": np.repeat(pdf.copies.to_numpy(), r), "v": [v for v in pdf.v for _ in range(r)], "shard": pdf.shard.iloc[0] + ((near.reshape(-1) + 1) << 12)})

    again = rows.groupBy("shard", "part").cogroup(centres.groupBy("shard", "part")).applyInPandas(deal, f"node long, copies long, v {kind}, shard long")
    return dealt.join(F.broadcast(sizes.select("shard")), "shard", "left_anti").select(*dealt.columns).unionByName(again)


def build_graph(members: DataFrame) -> DataFrame:
    """(node, links): for members (shard, salt, node, v), the united adjacency lists of all shards."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf.node.to_numpy()
        links = prune(_units(pdf.v), int(ids.min() % (1 << 31)))
        return pd.DataFrame({"node": ids, "out": [ids[c] for c in links]})

    lists = members.groupBy("shard", "salt").applyInPandas(grow, "node long, out array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("links"))


def _found(x: np.ndarray, ids: np.ndarray, lists: list[np.ndarray], low: float) -> np.ndarray:
    """Pairs of rows that the search finds, as a symmetric matrix, along the given lists taken both ways."""
    count = [len(v) for v in lists]
    ends = np.concatenate(lists) if sum(count) else np.zeros(0, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    at = order[np.minimum(np.searchsorted(ids[order], ends), len(ids) - 1)]
    here = ids[at] == ends  # the flat graph's edges to nodes of other shards lead out of this one
    a, b = np.repeat(np.arange(len(ids)), count)[here], at[here]
    key = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))
    starts = np.searchsorted(key, np.arange(len(ids) + 1) * len(ids))
    near = np.zeros((len(x), len(x)), dtype=bool)
    near[search(x, starts, key % len(ids), x, low)] = True
    return near | near.T


def _tally(v: list, ids: np.ndarray, copies: np.ndarray, salts: np.ndarray, near: np.ndarray | None, shards: np.ndarray | None, shard: int, low: float) -> pd.DataFrame:
    """(a, n, b): the copies that each node a is verified to link with, and edges (b, a) of a forest of the links, with n 0.

    near: pairs to verify, all where None; pairs within one of two pieces are another cell's, and pairs that a shard of a
    lesser number holds too are that one's."""
    x = np.stack(v)
    m, across = len(ids), salts.min() != salts.max()
    links, label = np.zeros(m, dtype=np.int64), np.arange(m)
    rows_a, rows_b = [], []
    for i in range(0, m, 256):
        part = slice(i, min(m, i + 256))
        hit = x[part] @ x.T >= low
        if near is not None:
            hit &= near[part]
        hit[np.arange(part.stop - i), np.arange(i, part.stop)] = False
        if across:
            hit &= salts[part, None] != salts[None, :]
        rows, cols = np.nonzero(hit)
        if shards is not None and len(rows):
            twice = np.zeros(len(rows), dtype=bool)
            for k in range(shards.shape[1]):
                mine = shards[rows + i, k]
                lesser = (mine >= 0) & (mine < shard)
                if lesser.any():
                    twice[lesser] |= (shards[cols[lesser]] == mine[lesser, None]).any(axis=1)
            rows, cols = rows[~twice], cols[~twice]
        np.add.at(links, rows + i, copies[cols])
        if len(rows):
            low_end, far_end = forest(rows + i, cols)
            rows_a.append(low_end)
            rows_b.append(far_end)
    some = np.flatnonzero(links)
    out = [pd.DataFrame({"a": ids[some], "n": links[some], "b": ids[some]})]
    if rows_a:
        low_end, far_end = forest(np.concatenate(rows_a), np.concatenate(rows_b))
        out.append(pd.DataFrame({"a": ids[far_end], "n": 0, "b": ids[low_end]}))
    return pd.concat(out)


def _cells(rows: DataFrame, rows_per_piece: int) -> DataFrame:
    """rows (shard, ...) with salt, i and j: shards are cut into pieces, and each two pieces of a shard meet in a cell (i, j)."""
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.ceil(F.col("n") / rows_per_piece).cast("int").alias("pieces"))
    sizes = materialize(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= 200_000 else sizes
    salted = rows.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    return salted.withColumn("o", other).withColumn("i", F.least("salt", "o")).withColumn("j", F.greatest("salt", "o")).drop("pieces")


def _searched(nodes: DataFrame, centres: dict[int, np.ndarray], spread: int, low: float) -> DataFrame:
    """(a, n, b) as in _tally, over all shards."""
    dealt = materialize(_dealt_again(materialize(_dealt(nodes, centres, spread)), spread))
    cells = _cells(dealt, CELL)
    graph = build_graph(cells.filter("o = salt").select("shard", "salt", "node", "v"))
    memory = materialize(graph.join(dealt.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("shards")), "node"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        v = [unit(x) for x in pdf.v]
        ids, n_shards = pdf.node.to_numpy(), max(map(len, pdf.shards))
        shards = np.full((len(ids), n_shards), -1, dtype=np.int64)
        for r, s in enumerate(pdf.shards):
            shards[r, : len(s)] = s
        near = _found(np.stack(v).astype(np.float32), ids, [np.asarray(x, dtype=np.int64) for x in pdf.links], low)
        return _tally(v, ids, pdf.copies.to_numpy(), pdf.salt.to_numpy(), near, shards, int(pdf.shard.iloc[0]), low)

    return materialize(cells.join(memory, "node").groupBy("shard", "i", "j").applyInPandas(find, "a long, n long, b long"))


def _compared(nodes: DataFrame, low: float) -> DataFrame:
    """(a, n, b) as in _tally by comparing all nodes of one length with each other, piece against piece: exact, in time that
    grows with the square of their number."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tally([unit(x) for x in pdf.v], pdf.node.to_numpy(), pdf.copies.to_numpy(), pdf.salt.to_numpy(), None, None, 0, low)

    cells = _cells(nodes.withColumn("shard", F.size("v").cast("long")), 2 * CELL)
    return materialize(cells.groupBy("shard", "i", "j").applyInPandas(find, "a long, n long, b long"))


def links_of(nodes: DataFrame, low: float = 0.9, aim: float = 0.95) -> tuple[DataFrame, float | None]:
    """For nodes (node, copies, v): rows (a, n, b), n parts of the number of other vectors that a links with, and forest
    edges (a, b) where n is 0; and the audited recall, None where no node of the audit has a link."""
    n = nodes.count()
    if not n:
        return nodes.select(F.col("node").alias("a"), F.col("copies").alias("n"), F.col("node").alias("b")), None
    truth = audited(nodes, n, low)
    centres = _centres(nodes, n)
    for spread in SPREADS:
        found = _searched(nodes, centres, spread, low)
        sure, seen = recall(truth, found)
        if sure is None or sure >= aim:
            return found, seen
    return _compared(nodes, low), 1.0 if truth else None


def audited(nodes: DataFrame, n: int, low: float, queries: int = 512, most: int = 8192, enough: int = 64) -> dict[int, int]:
    """node -> the number of others that it links with, for nodes chosen by a hash that have any, compared with all nodes.

    More nodes are asked for, `most` at most, until `enough` of them have links."""
    width = max(1, nodes.agg(F.max(F.size("v"))).first()[0])
    most = max(queries, min(most, (1 << 22) // width))
    while True:
        got = nodes.filter(hash_fraction(F.col("node"), F.lit("audit")) < min(1.0, queries / n)).orderBy("node").limit(2 * queries).select("node", "v").collect()
        by_size: dict[int, list] = {}
        for r in got:
            by_size.setdefault(len(r.v), []).append(r)
        asked = {size: (np.array([r.node for r in rs]), np.stack([unit(r.v) for r in rs])) for size, rs in by_size.items()}

        def compare(batches: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for size, part in pdf.groupby(pdf.v.map(len)):
                    if size in asked:
                        ids, x = asked[size]
                        other, u, weight = part.node.to_numpy(), _units(part.v, np.float64), part.copies.to_numpy()
                        total = np.zeros(len(ids), dtype=np.int64)
                        for i in range(0, len(u), 256):
                            hit = (u[i : i + 256] @ x.T >= low) & (other[i : i + 256, None] != ids[None, :])
                            total += weight[i : i + 256] @ hit
                        yield pd.DataFrame({"node": ids, "n": total})[total > 0]

        true = nodes.mapInPandas(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
        if len(true) >= enough or queries >= min(n, most):
            return {r.node: r.n for r in true}
        queries = min(most, 4 * queries)


def recall(truth: dict[int, int], found: DataFrame) -> tuple[float | None, float | None]:
    """The least lower bound (one-sided, 95 %) and mean of the audited nodes' shares of links found, over nodes of one link,
    of two to nine and of more, where there are enough of them to tell; None where no audited node has a link."""
    if not truth:
        return None, None
    ids = found.sparkSession.createDataFrame([(i,) for i in truth], "a long")
    seen = {r.a: r.n for r in found.join(F.broadcast(ids), "a", "left_semi").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    strata: dict[int, list[float]] = {}
    for i, n in truth.items():
        strata.setdefault(0 if n == 1 else 1 if n < 10 else 2, []).append(seen.get(i, 0) / n)
    told = [np.array(s) for s in strata.values() if len(s) >= 30] or [np.array([x for s in strata.values() for x in s])]
    bounds = [(float(s.mean() - 1.645 * s.std() / np.sqrt(len(s))), float(s.mean())) for s in told]
    return min(b for b, _ in bounds), min(m for _, m in bounds)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", low: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_recall.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, and so do vectors of
    different lengths. Equal vectors link with each other. Rows repeated with one id count as vectors of their own, and
    each is kept if the id is its component's smallest. A null id is smallest only where its component has no other.
    audit_recall is null where no audited vector has a link. An empty table gives an empty one; other columns are not read.
    """

    kind, array = vectors.schema[id_col].dataType.simpleString(), vectors.schema[vector_col].dataType.simpleString()

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf.vec_id, "v": [None if unit(v) is None else v for v in pdf.v]})

    rows = materialize(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInPandas(checked, f"vec_id {kind}, v {array}"))
    valid, invalid = rows.filter("v IS NOT NULL"), rows.filter("v IS NULL")
    # numbers of nodes are fixed by being written
    nodes = materialize(valid.groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    found, seen = links_of(nodes.select("node", "copies", "v"), low)
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    of = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("id", "node")
    placed = nodes.join(of, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    known = materialize(placed.join(lowest, "component").select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"))
    told = F.lit(seen).cast("double").alias("audit_recall")
    linked = valid.join(known, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), told)
    alone = invalid.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), told)
    return linked.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
