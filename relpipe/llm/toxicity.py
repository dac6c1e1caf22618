"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled texts. Terms are words, the stems "first four letters*", and "stem*@n" for stems
that occur at least n times, since a cosine does not see how often a lone term occurs; of these, the terms whose
chi-square with the label stands out among all candidates make up the vocabulary. Texts and examples are TF-IDF
vectors over it. The k examples of greatest cosine are found exactly with a block-max inverted index: examples lie in
blocks, each term keeps its greatest weight in each block, and blocks are visited by falling upper bound until no bound
exceeds the k-th best cosine. Votes are weighted by cosine, shrunk to the labels' base rate, and calibrated by a logistic
fit on the examples, each scored without itself. The nearest examples are the evidence.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, labelled_sample, learn_bucket, materialize, release_memory, table, unique_name

STEM = 4
#: Numbers of occurrences from which on a stem gives another term.
LEVELS = (2, 4)
#: The power of the cosine that weighs a vote.
SHARP = 6
WORD = regex.compile(r"\p{L}+")


def terms(text: str | None) -> Counter:
    """Counts of the terms of a whole text."""
    words = Counter(WORD.findall((text or "").lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        if len(w) > STEM:
            stems[f"{w[:STEM]}*"] += n
    often = {f"{s}@{level}": 1 for s, n in stems.items() if n >= LEVELS[0] for level in LEVELS if n >= level}
    return words + stems + Counter(often)


class BlockMaxIndex:
    """Exact nearest neighbours by dot product over sparse non-negative unit vectors."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = 64):
        self.block, self.n = block, len(vectors)
        self.n_blocks = max(1, -(-self.n // block))
        rows = sorted((t, d, w) for d, v in enumerate(vectors) for t, w in v.items())
        self.docs = np.array([d for _, d, _ in rows], dtype=np.int64)
        self.weights = np.array([w for _, _, w in rows])
        of = np.array([t for t, _, _ in rows], dtype=np.int64)
        at = of * self.n_blocks + self.docs // block
        self.starts = np.searchsorted(at, np.arange(n_terms * self.n_blocks + 1))
        self.top = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.top, at, self.weights)
        self.top = self.top.reshape(n_terms, self.n_blocks)

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k greatest (cosine, -example), best first; only examples that share a term; ties go to the lower example."""
        if not query or not self.n:
            return []
        ids = list(query)
        bound = np.array([query[t] for t in ids]) @ self.top[ids]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < best[0][0] - 1e-12:
                break
            scores = np.zeros(self.block)
            for t in ids:
                lo, hi = self.starts[t * self.n_blocks + b], self.starts[t * self.n_blocks + b + 1]
                scores[self.docs[lo:hi] - b * self.block] += query[t] * self.weights[lo:hi]
            for i in np.flatnonzero(scores).tolist():
                item = (float(scores[i]), -(b * self.block + i))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(best, reverse=True)


@dataclass
class Model:
    base: float
    """Share of toxic labels among all labels to learn from."""
    vocabulary: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    """Of each example: what its class weighs among all labels over what it weighs in the sample."""
    stems: dict[str, int] = field(default_factory=dict)
    levels: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    k: int = 15

    def __post_init__(self):
        """Numbers of stems and of their levels; a stem that is not in the vocabulary but whose level is gets weight 0."""
        for term in [t for t in self.vocabulary if "@" in t]:
            self.vocabulary.setdefault(term.split("@")[0], len(self.vocabulary))
        self.idf = np.concatenate([self.idf, np.zeros(len(self.vocabulary) - len(self.idf))])
        self.stems = {t[:-1]: i for t, i in self.vocabulary.items() if t.endswith("*")}
        for term, i in self.vocabulary.items():
            if "@" in term:
                stem, level = term.split("@")
                self.levels.setdefault(self.vocabulary[stem], []).append((int(level), i))

    def vector(self, text: str | None) -> dict[int, float]:
        if not self.vocabulary:
            return {}
        found: dict[int, int] = {}
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            if (t := self.vocabulary.get(w)) is not None:
                found[t] = n
            if len(w) > STEM and (t := self.stems.get(w[:STEM])) is not None:
                found[t] = found.get(t, 0) + n
        for t in [t for t in found if t in self.levels]:
            for level, i in self.levels[t]:
                if found[t] >= level:
                    found[i] = 1
        found = {t: (1 + math.log(n)) * self.idf[t] for t, n in found.items() if self.idf[t]}
        norm = math.sqrt(sum(v * v for v in found.values()))
        return {t: v / norm for t, v in found.items()} if norm else {}

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Log odds of the distance-weighted share of toxic examples, shrunk to the base rate."""
        rest = 0.05
        up = rest * self.base + sum(c**SHARP * self.weight[-i] for c, i in near if self.toxic[-i])
        down = rest * (1 - self.base) + sum(c**SHARP * self.weight[-i] for c, i in near if not self.toxic[-i])
        return math.log(up / down)

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(self.vector(text), self.k) if self.index else []
        z = self.slope * self.vote(near) + self.shift
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), near


def _calibrate(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on z by Newton's method, held near slope 1 and shift 0."""
    x = np.stack([z, np.ones_like(z)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -60, 60)))
        grad = x.T @ (w * (y - p)) - 1.0 * (b - [1.0, 0.0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2)
        b = b + np.linalg.solve(hess, grad)
    return max(0.05, float(b[0])), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2500, k: int = 15) -> Model:
    """Learns from the texts of labelled documents; at most `per_class` ids of each label, chosen by a hash of the id.

    Without labels of both kinds every text gets the base rate (1/2 without labels). Repeated ids count once a label, null
    ids and labels not at all. What is collected is the sample's terms that stand out and its vectors over them, whose
    number the sample bounds."""
    sample, sizes = labelled_sample(docs, labels, label, per_class)
    base = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len(sizes) < 2:
        return Model(base)
    counts = {int(r.label): r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(base)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label_, text in zip(pdf.label, pdf.text, strict=True):
                found = list(terms(text))
                yield pd.DataFrame({"term": found, "label": [label_] * len(found)})

    seen = sample.select("label", "text").mapInPandas(explode, "term string, label int")
    n1, n0 = counts[1], counts[0]
    per_term = seen.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    n = F.lit(float(n1 + n0))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / (F.lit(float(n1) * float(n0)) * (a + b) * (n - a - b + 1e-9))
    rated = materialize(per_term.select("term", (a + b).alias("df"), chi2.alias("chi2")))
    # chance terms reach this with odds of about 1 in 100 over all that occur often enough to
    enough = 2 * math.log(100 * max(1, rated.filter("df >= 4").count()))
    chosen = rated.filter(F.col("chi2") > enough).collect()
    vocabulary = {r.term: i for i, r in enumerate(sorted(chosen, key=lambda r: r.term))}
    df = {r.term: r.df for r in chosen}
    model = Model(base, vocabulary, np.array([math.log(1 + (n1 + n0) / df[t]) for t in vocabulary]), k=k)
    if not vocabulary:
        return model

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.vector(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "label": pdf.label, "terms": [list(v) for v in found], "weights": [list(v.values()) for v in found]})

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInPandas(vectors, f"doc_id {kind}, label int, terms array<int>, weights array<double>").collect()  # the bounded sample, a few terms each
    # examples with the same strongest term lie together, so that blocks have tight bounds
    rows = sorted(rows, key=lambda r: (r.terms[int(np.argmax(r.weights))] if r.terms else len(vocabulary), r.doc_id))
    known_vectors = [dict(zip(r.terms, r.weights, strict=True)) for r in rows]
    model.index = BlockMaxIndex(known_vectors, len(model.vocabulary))
    model.ids = [r.doc_id for r in rows]
    model.toxic = np.array([r.label == 1 for r in rows])
    total = sizes[0] + sizes[1]
    model.weight = np.where(model.toxic, (sizes[1] / total) / (n1 / (n1 + n0)), (sizes[0] / total) / (n0 / (n1 + n0)))
    z = np.array([model.vote([x for x in model.index.nearest(v, k + 1) if -x[1] != i][:k]) for i, v in enumerate(known_vectors)])
    model.slope, model.shift = _calibrate(z, model.toxic.astype(float), model.weight)
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", evidence: int = 3) -> DataFrame:
    """docs with score (the probability that the toxic label is 1) and evidence: the nearest examples' ids, labels and
    cosines. Null, empty and term-less texts have no evidence and score by the base rate; texts of any length are read
    whole; of examples equally near the one first in the index counts; repeated rows score alike; columns of docs with the
    results' names are replaced; an empty table gives an empty one."""

    @F.pandas_udf("score double, evidence array<struct<doc_id:string,toxic:int,cosine:double>>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                p, near = model.score(t)
                rows.append((p, [{"doc_id": str(model.ids[-i]), "toxic": int(model.toxic[-i]), "cosine": min(1.0, c)} for c, i in near[:evidence]]))
            yield pd.DataFrame(rows, columns=["score", "evidence"], index=batch.index)
        release_memory()

    out = unique_name(docs, "toxicity")
    return docs.withColumn(out, scored(F.col(text_col))).select(*columns(docs, ("score", "evidence")), f"{out}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(learn_bucket(F.col("doc_id"), 3) != 1)
    found = score_toxicity(docs, fit(docs, labels))
    held_out = F.coalesce(learn_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")
