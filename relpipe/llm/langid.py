"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed letter n-grams (one to three letters, with word ends). For each
language several centroids are clustered (spherical k-means) on a bounded sample of labelled texts. A text gets the
language of the centroid with the greatest cosine. Since a cosine rises with a text's length, in its own language and in any
other, a text is compared with runs of like length from the language's own texts: it is rejected where its cosine is under
`slack` times their median and also under what their spread explains. Median and spread (the median deviation) do not
follow the few texts of a sample that are in no language at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, columns, learn_bucket, materialize, release_memory, table, unique_name

UNDETERMINED = "und"
DIM = 1 << 12
SPACE = 32
#: Characters whose n-grams are counted at a time, so that a very long text needs little memory.
CHUNK = 1 << 18

#: Powers of two: the lengths, in letters, of the runs whose cosines are known.
LENGTHS = np.arange(3, 18)

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """By code point, the lower-case letter, or a space where it is no letter."""
    global _letters
    if _letters is None:
        found = np.full(0x110000, SPACE, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                found[c] = ord(low) if len(low) == 1 else c
        _letters = found
    return _letters


def letters(text: str | None) -> np.ndarray | None:
    """The text's letters in lower case, with single spaces between words and at both ends; None where it has no letter."""
    if not text:
        return None
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    if (codes == SPACE).all():
        return None
    codes = np.concatenate([[SPACE], codes, [SPACE]]).astype(np.uint32)
    blank = codes == SPACE
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return codes[keep]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams over the whole text; None where it has no letter."""
    codes = letters(text)
    return None if codes is None else gram_counts(codes)


def length_of(grams: np.ndarray) -> float:
    """The length in letters of the text with these counts: each place but the ends begins a gram of each size."""
    return max(1.0, float(grams.sum()) / 3 - 1)


def gram_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams of what letters() gives."""
    total = np.zeros(DIM, dtype=np.int64)
    for i in range(0, len(codes), CHUNK):
        c = codes[max(0, i - 2) : i + CHUNK]
        new = i - max(0, i - 2)  # earlier characters only give context
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for grams, n in ((one, 1), (two, 2), (three, 3)):
            total += np.bincount(grams[max(0, new - n + 1) :] >> np.uint32(20), minlength=DIM)
    return total


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    m = np.log1p(np.stack(rows)) * idf
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    """Of each centroid."""
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray
    """Of each centroid, the least cosine that is not rejected, for texts of 2 ** LENGTHS letters."""

    def least(self, centroid: int, length: float) -> float:
        return float(np.interp(np.log2(length), LENGTHS, self.floor[centroid]))


def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (x @ centres.T).argmax(axis=1)


def _floors(rows: list[np.ndarray], idf: np.ndarray, centres: np.ndarray, slack: float, spread: float = 2.5, enough: int = 10) -> np.ndarray:
    """For each of LENGTHS, the least cosine that is not rejected, from the cosines of runs of that many letters, one of each
    text, with their nearest centre: under `slack` times the median, and `spread` standard deviations under it.

    Lengths that fewer than `enough` texts reach take the next shorter one's; where none does, all count."""

    def floor(found: list[np.ndarray]) -> float:
        cosines = (vectors(found, idf) @ centres.T).max(axis=1)
        middle = float(np.median(cosines))
        return min(slack * middle, middle - spread * 1.4826 * float(np.median(np.abs(cosines - middle))))

    rng = np.random.default_rng(11)
    known: dict[int, tuple[int, float]] = {}
    for k in LENGTHS:
        m = 1 << k
        at = [(r, int(rng.integers(0, len(r) - 1 - m))) for r in rows if len(r) - 2 >= m]
        runs = [gram_counts(np.concatenate([[SPACE], r[a + 1 : a + 1 + m], [SPACE]]).astype(np.uint32)) for r, a in at]
        if runs:
            known[k] = (len(runs), floor(runs))
    if not known:
        known = {LENGTHS[0]: (0, floor([gram_counts(r) for r in rows]))}
    sure = [k for k, (n, _) in known.items() if n >= enough] or list(known)
    return np.interp(LENGTHS, sure, [known[k][1] for k in sure])


def fit(labelled: DataFrame, per_language: int = 1500, clusters: int = 4, slack: float = 0.75) -> Model | None:
    """Learns from rows (text, lang) with non-null lang; at most `per_language` different texts of each language are used,
    chosen by a hash of the text. Each language is fitted in its own task on that bounded sample; the model has `clusters`
    vectors of DIM numbers a language. None where no row can be used.
    """
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    sample = materialize(bounded_sample(usable, "lang", per_language, "text"))

    def read(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [c for c in map(letters, sorted(pdf.text)) if c is not None]

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [gram_counts(c) for c in read(pdf)]
        df = np.sum([r > 0 for r in rows], axis=0) if rows else np.zeros(DIM, dtype=np.int64)
        return pd.DataFrame({"n": [len(rows)], "df": [np.asarray(df, dtype=np.int64)]})

    seen = sample.groupBy("lang").applyInPandas(frequencies, "n long, df array<long>").collect()
    n = sum(r.n for r in seen)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.sum([r.df for r in seen], axis=0))) + 0.1

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = read(pdf)
        if not rows:
            return pd.DataFrame({"lang": [], "centre": [], "floor": []}, dtype=object)
        centres, _ = _cluster(vectors([gram_counts(c) for c in rows], idf), clusters)
        floor = _floors(rows, idf, centres, slack)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]] * len(centres), "centre": [c.astype(float) for c in centres], "floor": [floor] * len(centres)})

    found = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, centre array<double>, floor array<double>").collect(), key=lambda r: (r.lang, list(r.centre)))
    return Model([r.lang for r in found], np.array([r.centre for r in found], dtype=np.float32), idf, np.array([r.floor for r in found]))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine, 0 to 1) and rejected.

    A rejected text has letters, but is too far from its nearest centroid, whose language lang_pred still tells. Null, empty
    and blank texts and texts without a letter: lang_pred und, score 0, rejected. Texts of any length are read whole. Where there is no model, every text is so.
    Ties go to the language first in order. Repeated rows get equal results; all other columns pass through, and columns
    of docs with the results' names are replaced.
    """
    out = unique_name(docs, "lang")

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows: list[tuple[str, float, bool]] = []
            for i in range(0, len(batch), 64):
                found = [counts(t) if model else None for t in batch.iloc[i : i + 64]]
                some = [c for c in found if c is not None]
                best = iter(())
                if some:
                    cosine = vectors(some, model.idf) @ model.centroids.T
                    at = cosine.argmax(axis=1)
                    top = cosine[np.arange(len(at)), at]
                    best = iter([(model.langs[j], min(1.0, max(0.0, float(v))), bool(v < model.least(j, length_of(c)))) for c, j, v in zip(some, at, top, strict=True)])
                rows += [(UNDETERMINED, 0.0, True) if c is None else next(best) for c in found]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"], index=batch.index)
        release_memory()

    found = docs.withColumn(out, nearest(F.col(text_col)))
    new = ("lang_pred", "score", "rejected")
    return found.select(*columns(docs, new), *[F.col(out)[c].alias(c) for c in new])


def learned(docs: DataFrame) -> Model | None:
    """The model learned from the documents that are not held out."""
    return fit(docs.filter(learn_bucket(F.col("doc_id"), 5) != 0))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is identified; rejected ones, those without a letter included, go.

    Nothing but text is looked at: null ids, sources and labels, repeated rows and columns of any name stay as they are, and
    equal texts share one fate. Where no document can be learned from, none is identified."""
    mark = unique_name(docs, "rejected")
    found = identify(docs.select(F.struct(*columns(docs)).alias("row"), "text"), learned(docs)).withColumnRenamed("rejected", mark)
    return found.filter(~F.col(mark)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learned(docs))
    held_out = F.coalesce(learn_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")

