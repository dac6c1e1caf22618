"""SimHash near-duplicates, joined by anchor-point covering.

Fingerprints at most `max_distance` bits apart are linked. The 64 bits are cut into `blocks` equal parts; two linked
fingerprints differ in at most t = max_distance // blocks bits of some part. For each part a covering code is fixed: a
Hamming code on the first 15 (or 31, or 7) bits times all words of the other bits. It has covering radius 1, so each
part lies within one bit of its home anchor. A fingerprint goes to its home anchor, and a replica of it to every anchor
within 1 + t bits. If x and y differ in at most t bits of the part, y has a replica at the home anchor of x: each linked
pair meets. Comparing home against replica per anchor is an equi-join on the anchor.

Equal fingerprints are one node, so exact copies are never paired. Anchors with many distinct fingerprints are cut into
cells of bounded size; a cell returns a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import columns, components, materialize, release_memory, side, table, unique_name

BITS = 64
#: Distinct fingerprints from which on two blocks with a 31-bit code cost less than three with a 15-bit code: replicas rise
#: from about 45 to 310 a fingerprint, but anchors from 2^17 to 2^26 a block.
MANY = 1 << 25
#: Shingles whose bits are summed at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """SimHash of 4-word shingles (repeats included) as an unsigned 64-bit integer; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 4:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[3:], strict=False)]
    ones = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for i in range(0, len(values), CHUNK):
        bits = np.unpackbits(values[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64), index=batch.index)
    release_memory()


def parts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def code_masks(width: int, reach: int) -> tuple[int, list[int], list[list[int]]]:
    """The covering code of a block: number of check bits; by syndrome, the change to the home anchor, and the changes
    to all anchors within `reach` bits."""
    checks = max(r for r in (2, 3, 4, 5) if 2**r - 1 <= width)
    n = 2**checks - 1
    by_syndrome: list[list[int]] = [[] for _ in range(n + 1)]
    free = [sum(1 << (n + i) for i in c) for k in range(reach + 1) for c in combinations(range(width - n), k)]
    for k in range(reach + 1):
        for c in combinations(range(1, n + 1), k):
            syndrome = 0
            for i in c:
                syndrome ^= i
            error = sum(1 << (i - 1) for i in c)
            by_syndrome[syndrome] += [error | f for f in free if k + f.bit_count() <= reach]
    return checks, [0 if s == 0 else 1 << (s - 1) for s in range(n + 1)], by_syndrome


def _shift(block: Column, tag: Column) -> Callable[[Column], Column]:
    return lambda mask: block.bitwiseXOR(mask) + tag


def _anchor_columns(fp: Column, blocks: int, max_distance: int) -> tuple[Column, Column]:
    """Arrays of anchor keys: the home of each block; all anchors within reach of each block."""
    homes, near = [], []
    for k, (first, width) in enumerate(parts(blocks)):
        checks, home, masks = code_masks(width, 1 + max_distance // blocks)
        block = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        syndrome = F.lit(0)
        for j in range(checks):
            members = sum(1 << (i - 1) for i in range(1, 2**checks) if i >> j & 1)
            syndrome = syndrome + F.bit_count(block.bitwiseAND(F.lit(members))) % 2 * (1 << j)
        tag = F.lit(k << 40)
        homes.append(block.bitwiseXOR(F.element_at(F.array(*[F.lit(m).cast("long") for m in home]), syndrome.cast("int") + 1)) + tag)
        table_ = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks])
        near.append(F.transform(F.element_at(table_, syndrome.cast("int") + 1), _shift(block, tag)))
    return F.array(*homes), F.concat(*near)


def _forest(cell: pd.DataFrame, max_distance: int) -> pd.DataFrame:
    """A spanning forest of the links between a cell's home and replica rows."""
    own = cell.loc[cell.home, "fp"].unique().astype(np.int64)
    other = cell.loc[~cell.home, "fp"].unique().astype(np.int64)
    near = np.bitwise_count(own[:, None].view(np.uint64) ^ other[None, :].view(np.uint64)) <= max_distance
    label, far = own.copy(), other.copy()
    top = np.iinfo(np.int64).max
    while True:
        a = np.minimum(label, np.where(near, far[None, :], top).min(axis=1, initial=top))
        b = np.minimum(far, np.where(near, a[:, None], top).min(axis=0, initial=top))
        if (a == label).all() and (b == far).all():
            break
        label, far = a, b
    pairs = pd.DataFrame({"a": np.concatenate([own, other]), "b": np.concatenate([label, far])})
    return pairs[pairs.a != pairs.b].drop_duplicates()


def links(fps: DataFrame, max_distance: int = 4, blocks: int = 3, hot: int = 48, cell: int = 1024) -> DataFrame:
    """Edges (a, b) between distinct values of `fp` that join just the same fingerprints as all pairs within
    max_distance bits do. Anchors with over `hot` home rows go through cells of about `cell` rows a side."""
    homes, near = _anchor_columns(F.col("fp"), blocks, max_distance)
    home = fps.select("fp", F.explode(homes).alias("anchor"))
    replica = fps.select("fp", F.explode(near).alias("anchor"))
    crowded = materialize(home.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    sizes = side(crowded)
    other = replica.withColumnRenamed("fp", "fp2")
    light = home.join(sizes.select("anchor"), "anchor", "left_anti").join(other.hint("merge"), "anchor").filter((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_distance)).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    if crowded.isEmpty():
        return light.distinct()
    full = replica.join(sizes, "anchor")
    span = full.groupBy("anchor").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
    span = materialize(span.select("anchor", F.ceil(F.col("n") / cell).cast("int").alias("rows"), F.ceil(F.col("m") / cell).cast("int").alias("cols")))
    span = side(span)
    row = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("rows")).cast("int")
    col = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("cols")).cast("int")
    cells = (
        home.join(span, "anchor").select("anchor", "fp", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("home"))
        .unionByName(replica.join(span, "anchor").select("anchor", "fp", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), col.alias("j"), F.lit(False).alias("home")))
    )
    dense = cells.groupBy("anchor", "i", "j").applyInPandas(lambda pdf: _forest(pdf, max_distance), "a long, b long")
    return light.unionByName(dense).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: id, fp (long), component_id (the smallest id reachable over links, its own included).

    Null, empty and blank texts have fingerprint 0 and link like any other; repeated rows keep their own rows; a null id
    takes part in linking but is never chosen as component_id unless all ids of its group are null. Other columns of
    docs, whatever their names, are not read. The number of blocks, where not given, follows from the number of distinct
    fingerprints; it changes the cost, not the result.
    """
    return _rows_by_component(docs, id_col, text_col, max_distance, blocks).select("doc_id", "fp", "component_id")


def _rows_by_component(docs: DataFrame, id_col: str, text_col: str, max_distance: int, blocks: int | None = None) -> DataFrame:
    """simhash_components with one more column: component, the least fingerprint of the group, which no other group has."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = nodes.count()
    blocks = blocks or (3 if n <= MANY else 2)
    # an anchor is hot where it has some times the home rows that evenly spread fingerprints would give it
    anchors = 2 ** min(width - code_masks(width, 0)[0] for _, width in parts(blocks))
    parents = components(links(nodes.select("fp"), max_distance, blocks, hot=max(48, 4 * n // anchors)))
    grouped = nodes.join(parents.hint("merge"), nodes.fp == parents.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = materialize(grouped.join(lowest.hint("merge"), "component").select("fp", "component_id", "component"))
    return rows.join(side(by_fp), "fp").select("doc_id", "fp", "component_id", "component")


def keep_one_of_each(docs: DataFrame, max_distance: int = 4) -> DataFrame:
    """The documents, all columns, without all but one of each group of near-duplicates: the smallest doc_id stays.

    Repeated rows with that id count as copies of each other, so one of them stays. Groups whose ids are all null keep
    one row too, and so does each of several groups whose smallest ids are equal.
    """
    fp, single = unique_name(docs, "fp"), unique_name(docs, "id")
    found = materialize(_rows_by_component(docs, "doc_id", "text", max_distance))
    leads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy(F.col("doc_id").alias(single)).agg(F.count(F.lit(1)).alias("n"), F.max(leads).alias("leads"))
    # mostly fewer ids go than stay, so the texts meet those that go; repeated ids are taken apart below
    gone = materialize(ids.filter((F.col("n") > 1) | ~F.col("leads")))
    same = docs["doc_id"].eqNullSafe(F.col(single))
    once = docs.join(side(gone.select(single)), same, "left_anti").select(*columns(docs))
    several = gone.filter((F.col("n") > 1) & F.col("leads")).select(single)
    if several.isEmpty():
        return once
    several = side(several)
    # rows that share an id are told apart by their fingerprints; the id alone would pair each of them with each group's mark
    marks = found.filter(leads).join(several, found["doc_id"].eqNullSafe(F.col(single)), "left_semi")
    marks = materialize(marks.groupBy("component", F.col("doc_id").alias(single)).agg(F.min("fp").alias(f"{fp}_lead")))
    repeated = docs.join(several, same, "left_semi").withColumn(fp, fingerprint_udf(F.col("text")))
    repeated = repeated.join(side(marks.drop("component")), (F.col(fp) == F.col(f"{fp}_lead")) & repeated["doc_id"].eqNullSafe(F.col(single)))
    return once.unionByName(repeated.dropDuplicates(["doc_id", fp]).select(*columns(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
