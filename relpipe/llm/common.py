"""Helpers that the operators share: reading tables, cutting lineage, sampling, connected components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and the session runs in
    one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors need a folder that all of them share")
        path = "file:///tmp/checkpoints"
    return path.rstrip("/")


#: Folders that this process has written to the shared one.
_written: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which forget() deletes."""
    path = f"{shared_dir(spark)}/relpipe-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and lost executors cost nothing.

    The folder stays until forget(), since lazy results read it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark of what has been written so far, for forget()."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Deletes what was written after the mark `since`; call it when the results that read it are written or collected."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def release_memory() -> None:
    """Gives a Python worker's freed memory back at the end of a task: Spark keeps workers, and what they hold is missing
    from the executor's memory while other stages run."""
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: Rows that are broadcast at most, by side().
SMALL = 100_000


def side(df: DataFrame) -> DataFrame:
    """A narrow df as a side of a join: broadcast where it has at most SMALL rows, else merged by key. Left to itself Spark
    broadcasts by the compressed size of a file or shuffle, of which the driver holds a multiple, several at a time.

    df is counted first, and so should be materialized."""
    return F.broadcast(df) if df.count() <= SMALL else df.hint("merge")


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, so that extra columns of any name may pass through."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """All columns of df, whatever characters their names have, but those that new columns of these names replace."""
    names = {w.lower() for w in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in names]


def learn_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; null ids fall in no bucket."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def hash_fraction(*cols: Column) -> Column:
    """A value in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(df: DataFrame, by: str, bound: int, *key: str) -> DataFrame:
    """At most `bound` distinct keys of each value of `by`, one row each: those whose hashes are least; all keys where
    there are fewer. Copies of a key count once, however many there are. Other columns than `by` and key are not kept.

    Keys are counted approximately first, so that only about twice the bound of hashes, without the keys, is ranked.
    """
    value, h, limit = (unique_name(df, x) for x in ("value", "hash", "limit"))
    u = F.xxhash64(*[F.col(k) for k in key])
    place = F.shiftrightunsigned(u, 1)
    sizes = df.groupBy(F.col(by).alias(value)).agg(F.approx_count_distinct(u).alias("n"))
    sizes = materialize(sizes.select(value, F.when(F.col("n") <= 2 * bound, F.lit((1 << 63) - 1)).otherwise((F.lit(2.0 * bound) / F.col("n") * float(1 << 63)).cast("long")).alias(limit)))
    few = sizes.count() <= 10_000

    def under(limits: DataFrame) -> DataFrame:
        side = F.broadcast(limits) if few else limits
        return df.join(side, df[by].eqNullSafe(F.col(value))).filter(place <= F.col(limit))

    ranked = under(sizes).select(F.col(value), place.alias(h)).distinct()
    rank = Window.partitionBy(value).orderBy(h)
    last = ranked.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= bound).groupBy(value).agg(F.max(h).alias(limit))
    return under(materialize(last)).select(by, *key).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most `per_class` documents of each label 0 or 1, and the numbers of labelled ids.

    Ids of labels count once a label, however often they are repeated; null ids and other labels do not count. Of several
    documents with one id the least text is taken. The labels' side of the join has at most 2 * per_class rows.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").distinct()
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    few = materialize(bounded_sample(known, "label", per_class, "doc_id"))
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return materialize(found.select("doc_id", "text", "label")), sizes


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (id, component) per node, component the smallest id.

    Alternates large-star and small-star steps, each an aggregate that is combined before its shuffle, and a join. The
    aggregates are written to the shared folder before they are joined: then both sides of a join are plain exchanges, and
    adaptive execution can split those of a hub, whose edges never gather in one task.
    """
    state = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: a is the larger end, so the least neighbour of b is among the edges whose larger end is b
        low = materialize(state.groupBy("a").agg(F.min("b").alias("m")))
        above = low.select(F.col("a").alias("b"), "m")
        state = materialize(state.join(side(above), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        # small star: the lesser neighbours of a, and a itself, go to the least of them
        low = materialize(state.groupBy("a").agg(F.min("b").alias("m")))
        rest = state.join(side(low), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = materialize(low.withColumnRenamed("m", "b").unionByName(rest).distinct())
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (now.n, now.h):
            break
        before = (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
