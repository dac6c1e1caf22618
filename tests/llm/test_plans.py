"""What the operators ask of Spark: columns read, exchanges, joins."""

import re

import pytest

from relpipe.llm import bpe, langid, mixing, orderminhash, registry, urlfilter
from relpipe.plans import physical_plan

SF = "/root/testdata/sf0.001"


def read(plan):
    """The columns of all scans of test tables."""
    scans = re.findall(r"Location: \S+ \[file:/root/testdata\S*\](?:.|\n)*?ReadSchema: struct<([^\n]*)>", plan)
    return {re.sub(r":.*", "", c) for s in scans for c in s.split(",")}


@pytest.mark.parametrize(("query", "columns"), [(bpe.query, {"doc_id", "text"}), (langid.query, {"doc_id", "text"}), (orderminhash.query, {"doc_id", "text"}), (mixing.query, {"doc_id", "text", "source"})])
def test_only_needed_columns_are_read(spark, query, columns):
    assert read(physical_plan(query(spark, SF))) == columns


def test_pages_are_not_read_whole(spark):
    assert read(physical_plan(urlfilter.query(spark, SF))) <= {"page_id", "url"}


@pytest.mark.parametrize(("query", "most"), [(bpe.query, 0), (langid.query, 0), (mixing.query, 1)])
def test_texts_are_exchanged_no_more_than_needed(spark, query, most):
    plan = physical_plan(query(spark, SF))
    with_text = [p for p in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan) if "text" in p]
    assert len(set(with_text)) <= most
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.MODULES)
    assert numbers == list(range(1, 11))
    assert set(registry.queries()) == set(registry.MODULES)
