"""The mix reaches its queries with positions and in their order."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from panelwright.llm import mixing

from .test_rows import water_fill
from .texts import SCHEMA, documents


def test_queries_give_the_mix_in_order(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.positions)
    want = sorted(map(key, mixing.mixed(docs).collect()))
    rows = corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()
    assert sorted(map(key, rows)) == want
    firsts = [r.positions[0] if r.positions else 2.0 for r in rows]
    assert firsts == sorted(firsts) and firsts[0] < firsts[-2] and any(len(r.positions) == 2 for r in rows)
    found = entry.queries()["op6_mix_sources"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken, [p for p in (r.position, r.position_again) if p is not None]) for r in found) == want
    firsts = [2.0 if r.position is None else r.position for r in found]
    assert firsts == sorted(firsts)


def test_rows_without_id_are_dealt_to_many_windows(spark):
    """A third of all rows equal and without id, and all of one source."""
    docs = spark.createDataFrame([(None, "s", "a b c")] * 400 + [(i, "s", "a b") for i in range(800)], "doc_id long, source string, text string").repartition(4)
    rows = mixing.mixed(docs, mix=mixing.Mix(rows_per_bucket=50)).collect()
    assert len(rows) == 1200 and sum(r.taken for r in rows) == round(rows[0].target) == 1.5 * 2800
    taken = sorted(p for r in rows for p in r.positions)
    assert len(set(taken)) == len(taken)


def test_many_sources_are_ranked_and_filled(spark):
    docs = spark.createDataFrame([(i, f"s{i % 300:03d}" if i % 7 else None, "w " * (1 + i % 13)) for i in range(3000)], "doc_id long, source string, text string")
    rows = mixing.mixed(docs).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    names = sorted(s for s in size if s) + [None]
    want = dict(zip(names, water_fill([size[s] for s in names]), strict=True))
    assert all(abs(r.target - want[r.source]) < 1e-6 * want[r.source] for r in rows)
