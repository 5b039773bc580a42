"""One row of each component stays, with and without ids, and where an id has several texts."""

from __future__ import annotations

import random

from panelwright.llm import simhash_dedup

from .texts import prose


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, doc string").repartition(3)
    found = simhash_dedup.one_per_component(docs)
    assert found.columns == docs.columns
    return sorted(map(tuple, found.collect()), key=str)


def test_rows_without_id_take_part(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(None, a, "x", "y"), (3, a, "x", "y"), (7, a, "x", "y"), *[(None, b, "x", "y")] * 3, (None, b, "z", "y"), (4, c, "x", None), (4, c, "x", None)]
    found = kept(spark, rows)
    assert [r[:2] for r in found] == sorted([(3, a), (None, b), (4, c)], key=str)
    assert kept(spark, []) == []


def test_an_id_with_several_texts(spark):
    """Each component keeps a row of its own, whichever text's digest comes first."""
    rng = random.Random(9)
    for _ in range(4):
        a, b = prose(rng, 200), prose(rng, 200)
        assert [r[:2] for r in kept(spark, [(5, a, "", ""), (5, b, "", "")])] == sorted([(5, a), (5, b)], key=str)
        assert [r[:2] for r in kept(spark, [(5, a, "", ""), (5, b, "", ""), (2, b, "", "")])] == sorted([(5, a), (2, b)], key=str)
