"""Mixing sources to target weights by Poisson replication.

A source with target weight w gets the mean repetition rate r = (w / sum of weights) * total / (its documents), so that its
expected share of a corpus of `total` documents is its weight. Each document is repeated k times, k being the inverse of
the Poisson(r) distribution at a hash of seed and doc_id; no sampling state, so a lost task gives the same copies again.
Rates over 32 are split into equal independent draws, which add up to the same distribution. Copies are dealt to
partitions and ordered within them by a hash: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table, unique_name

#: The largest rate of one draw, and the counts its distribution is tabulated to; the tail beyond is under 2^-52.
RATE, COUNTS = 32, 120


def uniform(*parts: Column) -> Column:
    """A value in [0, 1) with 52 bits, from the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, ... COUNTS."""
    first = F.exp(-rate)

    def step(acc: Column, k: Column) -> Column:
        p = acc.p * rate / k
        c = acc.c + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc.all, F.array(c)).alias("all"))

    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(COUNTS)), start, step, lambda acc: acc.all)


def rates(docs: DataFrame, weights: dict[str | None, float], default_weight: float = 1.0, epochs: float = 1.0, by: str = "source") -> DataFrame:
    """(source, n, rate) of each source, null included; total is `epochs` times the number of documents."""
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col(by).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = docs.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(F.col(by).alias("source"), "n", weight.alias("weight"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(float(total.weight or 1.0))
    return sizes.select("source", "n", (share * F.lit(epochs * float(total.n or 0)) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 42, by: str = "source", id_col: str = "doc_id", copy_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """docs with each row repeated by its count, in random order; copy_col and order_col name the copy's number and the
    place in the order, where wanted.

    A null source is a source of its own. Sources without a weight get default_weight; a source of weight 0 goes.
    Repeated rows and equal ids get equal counts; null ids count as one id. Null, empty and very long texts are rows like
    any other: only source and id are looked at. Columns of the names copy_col and order_col are replaced; all others
    pass through. Rows whose order is equal may come in any order. An empty table gives an empty one.
    """
    source, n_draws, cdf, copy, order = (unique_name(docs, x) for x in ("source", "draws", "cdf", "copy", "order"))
    per_source = rates(docs, weights, default_weight, epochs, by).select(F.col("source").alias(source), F.ceil(F.col("rate") / RATE).cast("int").alias(n_draws), "rate")
    per_source = per_source.select(source, n_draws, _distribution(F.col("rate") / F.greatest(F.col(n_draws), F.lit(1))).alias(cdf))
    per_source = F.broadcast(per_source) if per_source.count() <= 20_000 else per_source
    rows = docs.join(per_source, docs[by].eqNullSafe(F.col(source)))

    def draw(i: Column) -> Column:
        u = uniform(F.lit(seed), F.col(id_col), i)
        return F.size(F.filter(cdf, lambda c: c <= u))

    drawn = F.when(F.col(n_draws) > 0, F.aggregate(F.sequence(F.lit(1), F.col(n_draws)), F.lit(0), lambda acc, i: acc + draw(i))).otherwise(0)
    rows = rows.withColumn(copy, drawn).filter(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    rows = rows.withColumn(order, F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy).cast("string")).cast("binary")))
    rows = rows.repartition(order).sortWithinPartitions(order)
    extra = [F.col(c).alias(name) for c, name in ((copy, copy_col), (order, order_col)) if name]
    return rows.select(*columns(docs, tuple(c for c in (copy_col, order_col) if c)), *extra)


#: Relative weights of the query's and the pipeline's sources; a source of another name has weight 1.
WEIGHTS: dict[str | None, float] = {f"src{i}": 1.0 + i % 4 for i in range(20)}

ORACLE_SQL = f"""
WITH weight(source, weight) AS (VALUES {", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items())}),
sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT s.source, s.n, coalesce(w.weight, 1.0::DOUBLE) AS weight FROM sized s LEFT JOIN weight w ON s.source = w.source),
total AS (SELECT sum(n) AS n, sum(weight) AS weight FROM weighted),
rated AS (SELECT w.source, w.weight / t.weight * t.n / w.n AS rate FROM weighted w CROSS JOIN total t),
terms AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rated CROSS JOIN (SELECT range AS k FROM range(0, 60)) ks),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, text, source, ('0x' || substr(md5('42:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, c.k + 1 AS copy FROM drawn d JOIN cdf c ON d.source = c.source AND c.c <= d.u)
SELECT doc_id, source, text, copy::INTEGER AS copy, md5('42:order:' || doc_id || ':' || copy) AS place FROM counted
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, WEIGHTS, copy_col="copy", order_col="place")
