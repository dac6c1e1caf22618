"""Small fixtures with the cases that every operator must handle."""

import random

#: Names that operators use inside; documents may have columns of these names.
CLASHES = ("fp", "anchor", "row", "base", "terms", "key", "words", "score_", "rate", "copy", "block", "stats", "u", "node", "__fp", "__id", "dotted.name", "score", "rejected", "evidence")


def words(rng, n, alphabet="etaoinshrdlu"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))


def documents(spark, texts, extra=False, langs=None, sources=None, ids=None):
    """A documents table of the texts; extra adds columns whose names clash with names used inside operators."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    sources = sources or [f"src{i % 3}" for i in range(len(texts))]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in zip(ids, texts, langs, sources, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for c in CLASHES:
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def odd_texts(seed=1):
    """Null, empty, blank, short, very long, non-Latin and repeated texts."""
    rng = random.Random(seed)
    base = words(rng, 40)
    return [None, "", "  \n\t ", "a", "a b", base, base, base.upper(), words(rng, 20_000), "漢字かな交じり文" * 50, "🙂 é ß \x00 x", "1234 5678", base + " end", words(rng, 6)]
