"""Quality scores by a sparse rule ensemble.

Statistics of each whole text feed a small forest of shallow trees, fitted on a bounded sample of labelled rows. Every path
from a root to a node is a conjunctive rule over statistics. A lasso logistic regression over the rules keeps a few of
them; those are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import labelled_sample, learn_bucket, materialize, release_memory, table, unique_name

STATISTICS = (
    "log_chars", "log_words", "word_chars", "upper", "digits", "spaces", "bangs", "bars", "symbols", "stops", "other_bytes",
    "byte_entropy", "distinct_words", "top_word", "repeated_lines", "line_words", "marked_words",
)


def _mask(chars: str) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(chars.encode())] = True
    return found


UPPER, LOWER, DIGITS = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("0123456789")
SYMBOLS, STOPS = _mask("#$%&*+=<>@^_`~\\/[]{}"), _mask(".,;:?")


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of a whole text; zeros for null and empty texts."""
    if not text:
        return (0.0,) * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = text.split()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = hist[hist > 0] / n
    letters = int(hist[UPPER].sum() + hist[LOWER].sum())
    nw = max(1, len(words))
    return (
        math.log1p(len(text)),
        math.log1p(len(words)),
        min(100.0, sum(map(len, words)) / nw),
        float(hist[UPPER].sum()) / max(1, letters),
        float(hist[DIGITS].sum()) / n,
        float(hist[32] + hist[9] + hist[10] + hist[13]) / n,
        float(hist[33]) / n,
        float(hist[124]) / n,
        float(hist[SYMBOLS].sum()) / n,
        float(hist[STOPS].sum()) / n,
        float(hist[128:].sum()) / n,
        float(-(share * np.log2(share)).sum()),
        len(counts) / nw,
        max(counts.values(), default=0) / nw,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(nw / max(1, len(lines))),
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?") / nw,
    )


@F.pandas_udf(StructType([StructField(s, DoubleType()) for s in STATISTICS]))
def statistics_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([statistics(t) for t in batch], columns=list(STATISTICS), index=batch.index)
    release_memory()


@dataclass(frozen=True)
class Rule:
    """A conjunction: for some statistics, an exclusive lower and an inclusive upper bound."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, of: str) -> Column:
        test = F.lit(True)
        for name, low, high in self.bounds:
            value = F.col(of)[name]
            if low > -math.inf:
                test = test & (value > F.lit(low))
            if high < math.inf:
                test = test & (value <= F.lit(high))
        return F.when(test, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, of: str) -> Column:
        """The probability of label 1 as an expression over the struct column of statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.lit(float(weight)) * rule.column(of)
        return 1 / (1 + F.exp(-total))


def _paths(node, bounds: dict[str, tuple[float, float]]) -> Iterator[Rule]:
    """The rule of each node below a tree's root."""
    if bounds:
        yield Rule(tuple((k, *bounds[k]) for k in sorted(bounds)))
    if node.subtreeDepth() == 0:
        return
    name, cut = STATISTICS[node.split().featureIndex()], node.split().threshold()
    low, high = bounds.get(name, (-math.inf, math.inf))
    yield from _paths(node.leftChild(), bounds | {name: (low, min(high, cut))})
    yield from _paths(node.rightChild(), bounds | {name: (max(low, cut), high)})


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int = 4000, trees: int = 16, depth: int = 3, penalty: float = 0.002) -> Ensemble:
    """Learns from the texts of labelled documents; at most `per_class` ids of each label are used, chosen by a hash of the
    id, and the intercept is set back to the labels' own proportions. With one label only, the score is constant. Repeated
    ids count once a label, null ids and labels not at all, and null texts as empty ones."""
    examples, sizes = labelled_sample(docs, labels, label, per_class)
    if len(sizes) < 2:
        n = sum(sizes.values())
        p = (sizes.get(1, 0) + 1) / (n + 2)
        return Ensemble(math.log(p / (1 - p)), ())
    sample = materialize(examples.select(statistics_udf("text").alias("s"), F.col("label").cast("double").alias("label")))
    flat = sample.select("label", *[F.col("s")[c].alias(c) for c in STATISTICS]).coalesce(8)
    taken = {int(r.label): r["count"] for r in sample.groupBy("label").count().collect()}
    if len(taken) < 2:
        return Ensemble(math.log((sizes[1] + 1) / (sizes[0] + 1)), ())
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=42)
    grown = forest.fit(VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(flat))
    rules = list(dict.fromkeys(r for t in grown.trees for r in _paths(t._call_java("rootNode"), {})))
    fixed = math.log(sizes[1] / sizes[0]) - math.log(taken[1] / taken[0])
    if not rules:
        return Ensemble(math.log(sizes[1] / sizes[0]), ())
    of = unique_name(sample, "r")
    hits = sample.select("label", *[r.column("s").alias(f"{of}{i}") for i, r in enumerate(rules)]).coalesce(8)
    table_ = VectorAssembler(inputCols=[f"{of}{i}" for i in range(len(rules))], outputCol="x").transform(hits).select("label", "x")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", regParam=penalty, elasticNetParam=1.0, standardization=True, maxIter=100).fit(table_)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept) + fixed, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def score_quality(docs: DataFrame, model: Ensemble, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the probability that the quality label is 1. Null and empty texts get the score of empty
    statistics; texts of any length are read whole; repeated rows get equal scores; all other columns pass through, but one
    of the name `out` is replaced; an empty table gives an empty one."""
    stats = unique_name(docs, "stats")
    return docs.withColumn(stats, statistics_udf(F.col(text_col))).withColumn(out, model.score(stats)).drop(stats)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(learn_bucket(F.col("doc_id"), 5) != 0)
    model = fit(docs, labels, "quality")
    held_out = F.coalesce(learn_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
