"""Order MinHash fingerprints of whole texts, sensitive to edit distance.

A text is a sequence of words; its k-mers are runs of five words, each numbered by its occurrence in the text. Each entry of
a fingerprint has a hash of its own over all numbered k-mers: one hash, turned by the entry's share of its range, so entry e
of 64 ranks a k-mer by (hash - e / 64) mod 1. The `keep` k-mers least by it are selected, put back in text order, and their
tuple is hashed: the entry changes when a selected k-mer goes and also when selected k-mers change places. The likeness of
two fingerprints comes from the share of equal entries.

The turned hashes share one order around a circle, so all entries are read off one sorted array: those of entry e are the
first from e / 64 on, past the end at its start. Everything is DataFrame functions on arrays of longs within a row: no
shuffle, no Python. A k-mer's hash and position are packed in one long, so that sorting an array of longs sorts by both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, materialize, table, unique_name

WORDS = 5
#: Entries are 2 ** BIN_BITS. An array has fewer than 2 ** POS_BITS elements, so no position is lost.
BIN_BITS, HASH_BITS, POS_BITS = 6, 32, 31
ENTRIES = 1 << BIN_BITS
POS_MASK, HASH_MASK, SLOT_BITS = (1 << POS_BITS) - 1, (1 << HASH_BITS) - 1, 16
#: Longer words (scripts without spaces, junk) are cut into single characters; the words around them stay words.
LONG_WORD = 32


def _bin(x: Column) -> Column:
    return F.shiftright(x, HASH_BITS - BIN_BITS + POS_BITS)


def with_codes(df: DataFrame, text: str, out: str, keep: int = 2) -> DataFrame:
    """Adds out: the fingerprint's entries, each 16 bits of its tuple's hash.

    Null and blank texts have no entry. Texts of fewer than five words have one k-mer, the whole, and a tuple has no more
    k-mers than there are.
    """
    tokens, hashes, kmers, keys, picked = (unique_name(df, f"{x}_{out}") for x in ("tokens", "hashes", "kmers", "keys", "picked"))
    none = F.array().cast("array<bigint>")
    t = F.trim(F.col(text))
    words = F.split(t, r"\s+")
    df = df.withColumn(tokens, F.when(t.rlike(r"\S"), words).otherwise(F.array().cast("array<string>")))
    cut = F.flatten(F.transform(F.col(tokens), lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    df = df.withColumn(tokens, F.when(F.exists(F.col(tokens), lambda w: F.length(w) > LONG_WORD), cut).otherwise(F.col(tokens)))
    df = df.withColumn(hashes, F.transform(F.col(tokens), lambda w: F.xxhash64(w)))
    h = F.col(hashes)
    short = lambda x: F.shiftrightunsigned(x, 64 - HASH_BITS)
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: short(F.xxhash64(*[h[i + j] for j in range(WORDS)])))
    df = df.withColumn(kmers, F.when(F.size(h) > WORDS, runs).when(F.size(h) > 0, F.array(short(F.xxhash64(h)))).otherwise(none))
    m = F.col(kmers)

    def pack(kmer: Column, occurrence: Column, pos: Column) -> Column:
        return F.shiftleft(short(F.xxhash64(kmer, occurrence)), POS_BITS).bitwiseOR(pos.cast("long"))

    # repeated k-mers: sorting (k-mer, position) brings equal ones together in text order, which numbers them
    s, starts = (unique_name(df, f"{x}_{out}") for x in ("sorted", "starts"))
    repeated = F.size(F.array_distinct(m)) < F.size(m)
    df = df.withColumn(s, F.when(repeated, F.sort_array(F.transform(m, lambda x, i: F.shiftleft(x, POS_BITS).bitwiseOR(i.cast("long"))))).otherwise(none))
    c = F.col(s)
    first = lambda i: (i == 0) | (F.shiftright(c[i], POS_BITS) != F.shiftright(c[F.greatest(i - 1, F.lit(0))], POS_BITS))
    df = df.withColumn(starts, F.when(F.size(c) > 0, F.filter(F.sequence(F.lit(0), F.size(c) - 1), first)).otherwise(F.array().cast("array<int>")))
    b = F.col(starts)

    def group(start: Column, g: Column) -> Column:
        end = F.coalesce(F.get(b, g + 1), F.size(c))
        return F.transform(F.slice(c, start + 1, end - start), lambda x, i: pack(F.shiftright(x, POS_BITS), i, x.bitwiseAND(F.lit(POS_MASK))))

    once = F.transform(m, lambda x, i: pack(x, F.lit(0), i))
    df = df.withColumn(keys, F.sort_array(F.when(F.size(c) > 0, F.flatten(F.transform(b, group))).otherwise(once)))
    # the first `keep` from any entry's place on are among the first `keep` of each sixty-fourth of the circle
    k = F.col(keys)
    df = df.withColumn(picked, F.filter(k, lambda x, i: (i < keep) | (_bin(k[F.greatest(i - keep, F.lit(0))]) != _bin(x))))
    p = F.col(picked)
    firsts = unique_name(df, f"firsts_{out}")
    df = df.withColumn(firsts, F.when(F.size(p) > 0, F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (_bin(p[F.greatest(i - 1, F.lit(0))]) != _bin(p[i])))).otherwise(F.array().cast("array<int>")))
    f = F.col(firsts)

    def entry(i: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.least(F.lit(keep), F.size(p)) - 1), lambda j: p[(i + j) % F.size(p)])
        ordered = F.sort_array(F.transform(own, lambda x: F.shiftleft(x.bitwiseAND(F.lit(POS_MASK)), HASH_BITS).bitwiseOR(F.shiftright(x, POS_BITS))))
        slot = F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit(HASH_MASK))))
        return slot.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")

    # entries between two filled parts of the circle share the next one's k-mers
    def share(i: Column, g: Column) -> Column:
        before = F.when(g == 0, F.lit(-1).cast("long")).otherwise(_bin(p[F.get(f, g - 1)]))
        return F.array_repeat(entry(i), (_bin(p[i]) - before).cast("int"))

    rest = F.array_repeat(entry(F.lit(0)), (F.lit(ENTRIES - 1) - _bin(p[F.size(p) - 1])).cast("int"))
    df = df.withColumn(out, F.when(F.size(p) > 0, F.concat(F.flatten(F.transform(f, share)), rest)).otherwise(F.array().cast("array<int>")))
    return df.drop(tokens, hashes, kmers, s, starts, keys, picked, firsts)


def likeness(a: Column, b: Column, keep: int = 2) -> Column:
    """From 0 to 1: the share of k-mers that two texts have in common, in order, as their fingerprints tell.

    The share p of equal entries estimates that `keep` selected k-mers are all common and in the same order, so
    p ** (1 / keep) is near the Jaccard likeness j of the k-mers where none has changed its place; 2 j / (1 + j) is their
    common share. It is 1 for equal fingerprints, two without entries included.
    """
    j = F.pow(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / ENTRIES, F.lit(1.0 / keep))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * j / (1 + j))


def as_text(codes: Column) -> Column:
    """Four hex digits an entry."""
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def with_blocks(docs: DataFrame, id_col: str, tie: str, out: str, rows_per_block: int, most: int) -> DataFrame:
    """docs with out: the number of a block of about `rows_per_block` rows, rising with (id_col, tie), null ids first.

    Blocks begin at quantiles of the ids, `most` at most. A block with more rows is cut again: the rows of the id that it
    begins with by ranges of the hash `tie`, and the others at quantiles of the block, of which there are `most` at most
    again. So `most` squared blocks are in reach, no id's rows stay together but equal ones, and what is sent to tasks is
    bounded."""
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("filled"), F.min(id_col).alias("low")).first()
    if stats.n <= rows_per_block:
        return docs.withColumn(out, F.lit(0).cast("long"))
    i, kind, high = F.col(id_col), docs.schema[id_col].dataType, 1 << 20
    parts = max(1, min(most, -(-stats.filled // rows_per_block)))
    bounds: list = []
    if stats.filled:
        got = docs.agg(F.percentile_approx(id_col, [x / parts for x in range(1, parts)], 20 * parts).alias("q")).first().q if parts > 1 else []
        bounds = sorted({*got, stats.low})
    fine, coarse = (F.array(*[F.lit(b) for b in bs]).cast(f"array<{kind.simpleString()}>") for bs in (bounds, bounds[::64]))
    part = F.size(F.filter(coarse, lambda b: b <= i))
    number = F.when(i.isNull(), 0).otherwise((part - 1) * 64 + F.size(F.filter(F.slice(fine, (part - 1) * 64 + 1, 64), lambda b: b <= i)))
    rows = docs.withColumn(out, number.cast("long"))  # it is multiplied by 2 * high
    begins = F.when(F.col(out) > 0, F.element_at(fine, F.col(out).cast("int"))) if bounds else F.lit(None).cast(kind)
    first = i.eqNullSafe(begins)
    sizes = rows.groupBy(out).agg(F.sum(first.cast("long")).alias("first"), F.sum((~first).cast("long")).alias("rest")).filter((F.col("first") > 2 * rows_per_block) | (F.col("rest") > 2 * rows_per_block))
    heavy = sizes.collect()  # at most `most` + 1 rows
    if not heavy:
        return rows.withColumn(out, F.col(out) * 2 * high)
    cuts = [(k[out], max(1, min(high, -(-k["first"] // rows_per_block)))) for k in heavy]
    finer = max(1, min(most, max(-(-k["rest"] // rows_per_block) for k in heavy)))
    inner = rows.filter(F.col(out).isin([c for c, _ in cuts]) & ~first).groupBy(out).agg(F.percentile_approx(id_col, [x / finer for x in range(1, finer)] or [0.5], 20 * finer).alias("cuts"))
    whole, slices, at = (unique_name(docs, x) for x in ("whole", "slices", "cuts"))
    many = docs.sparkSession.createDataFrame(cuts, f"{whole} long, {slices} int").join(inner, F.col(whole) == F.col(out), "left").select(whole, slices, F.col("cuts").alias(at))
    many = materialize(many)  # a row for each block that is cut again, with `most` ids at most
    rows = rows.join(F.broadcast(many), F.col(out) == F.col(whole), "left")
    share = F.shiftrightunsigned(F.col(tie).bitwiseXOR(F.lit(-(1 << 63))), 1) / F.lit(float(1 << 63))
    slice_ = F.floor(share * F.coalesce(slices, F.lit(1))).cast("long")
    return rows.withColumn(out, F.col(out) * 2 * high + F.when(first, F.least(slice_, F.lit(high - 1))).otherwise(high + F.coalesce(F.size(F.filter(at, lambda b: b <= i)), F.lit(0)))).drop(whole, slices, at)


def with_next(docs: DataFrame, id_col: str, values: tuple[str, ...], enrich: Callable[[DataFrame], DataFrame] = lambda df: df, rows_per_block: int = 2000, most: int = 4096) -> DataFrame:
    """enrich(docs) with next_<value>: the values of the next row in ascending id_col, the first row's after the last.

    Null ids come first; rows of one id are in the order of a hash of all their columns. Rows are dealt to blocks, and each
    block's first row is sent to the block before too, so a task holds a block and each row is shuffled once.
    """
    block, tie, ghost, wrapped, head = (unique_name(docs, x) for x in ("block", "tie", "ghost", "wrapped", "head"))
    rows = with_blocks(docs.withColumn(tie, F.xxhash64(*columns(docs))), id_col, tie, block, rows_per_block, most)
    key = F.struct(F.col(id_col).isNotNull().alias("filled"), F.col(id_col).alias("id"), F.col(tie).alias("tie"))
    heads = materialize(rows.groupBy(block).agg(F.min(key).alias(head)))
    # one row a block: a window over all of them is small beside any block's
    before = F.lag(block).over(Window.orderBy(block))
    last = heads.agg(F.max(block).alias("last")).first().last
    heads = heads.select(F.col(block).alias(f"{block}_of"), head, F.coalesce(before, F.lit(last)).alias(f"{block}_to"), before.isNull().alias(f"{wrapped}_to"))
    few = F.broadcast(heads) if heads.count() <= 100_000 else heads
    same = (F.col(block) == F.col(f"{block}_of")) & F.col(id_col).eqNullSafe(F.col(head).id) & (F.col(tie) == F.col(head).tie)
    ghosts = rows.join(few, same).dropDuplicates([block]).withColumn(block, F.col(f"{block}_to")).withColumn(wrapped, F.col(f"{wrapped}_to")).select(*columns(rows), F.col(wrapped))
    both = rows.withColumn(wrapped, F.lit(False)).withColumn(ghost, F.lit(False)).unionByName(ghosts.withColumn(ghost, F.lit(True)))
    order = Window.partitionBy(block).orderBy(F.col(wrapped), F.col(id_col).asc_nulls_first(), F.col(tie), F.col(ghost))
    found = enrich(both).select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    return found.filter(~F.col(ghost)).drop(block, tie, wrapped, ghost)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited text's digest, both fingerprints, and the likeness to the edited text and to the next one.

    The edited text has the last half of its code points (rounded down) replaced by as many of the next document's first.
    Null texts count as empty. In a table of one row the next document is the row itself. Repeated rows keep their rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ("text", "codes"), lambda df: with_codes(df, "text", "codes"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "codes", F.coalesce("next_codes", "codes").alias("next_codes"))
    rows = with_codes(rows, "edited", "edited_codes")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
