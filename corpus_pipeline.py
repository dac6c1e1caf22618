"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relpipe.llm.bpe import bpe_tokens, default_path
from relpipe.llm.common import new_path
from relpipe.llm.langid import keep_identified
from relpipe.llm.mixing import WEIGHTS, mix
from relpipe.llm.pii import sanitise
from relpipe.llm.simhash import keep_one_of_each


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null, empty and blank texts, those without a letter, and those too far from
    every learned language. The model is learned from these documents' own lang column; where no row can be learned from,
    or the table is empty, nothing stays. Ids, sources and other columns may be null or repeated; all columns pass through."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; null ids come last, and rows that
    share the id and the group count as copies. Null and empty texts are one group. All columns pass through."""
    return keep_one_of_each(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it are replaced in the texts, and n_chars follows; no row goes or is added. Null and
    empty texts and texts without such data stay as they are, whatever else their rows hold."""
    return sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights of their sources, and shuffled; a row may come no time or several times.
    A null source is a source of its own; null ids count as one id; texts are not looked at."""
    return mix(docs, WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows to train on: all columns of docs, the token ids of the text and their number, and digests of the ids and of
    the text decoded from them. Null and empty texts have no tokens. Columns of docs with the new names are replaced."""
    return bpe_tokens(docs, default_path())


STAGES = [
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the first, second and last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. They are read from the shared folder, where each stage leaves its rows for the next;
    `relpipe.llm.common.forget(spark)` deletes all of these folders when the result has been used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
