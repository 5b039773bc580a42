"""The token cache is used from run to run, tokenizers that join across white space encode whole texts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from panelwright.llm import queries, token_counts

TEXTS = ["two  words", "two words ", "  lead", "it's\tfour\n\n\nwords", "x y", "", None, "<|endoftext|> and\r\nmore", "é́ ́"]


def rows(spark):
    return spark.createDataFrame([(i % 7 if i != 3 else None, t, "d") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, content_digest string").repartition(3)


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_counts_are_the_librarys(spark, tmp_path, name, spaced):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer, model = token_counts.JsonTokenizer.from_path(path), Tokenizer.from_file(path)
    assert tokenizer.spaced is spaced
    found = token_counts.token_counts(rows(spark), tokenizer, f"file://{tmp_path}/c").collect()
    want = [(i % 7 if i != 3 else None, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS * 2)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(rows(spark).limit(0), tokenizer, f"file://{tmp_path}/none").collect() == []


def test_tokenizers_are_told_apart():
    split = {"type": "Split", "pattern": {"Regex": "[a-z]+|[^\\sa-z]+"}, "behavior": "Removed", "invert": True}
    of = lambda **k: json.dumps({"normalizer": None, "pre_tokenizer": split, "added_tokens": [], **k}).encode()
    assert token_counts.splits_at_space(of())
    assert token_counts.splits_at_space(of(pre_tokenizer={"type": "WhitespaceSplit"}))
    for other in (
        {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Metaspace"}}, {"normalizer": {"type": "Prepend", "prepend": "x"}}, {"added_tokens": [{"content": "a b"}]},
        {"pre_tokenizer": split | {"pattern": {"Regex": " ?[a-z]+"}}}, {"pre_tokenizer": split | {"behavior": "Isolated"}}, {"pre_tokenizer": split | {"pattern": {"Regex": "[a-z]+(?!\\s)"}}},
    ):
        assert not token_counts.splits_at_space(of(**other))


def test_the_query_reads_and_extends_a_kept_cache(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows(spark).withColumn("text", F.concat(F.col("text"), F.lit(" new"))).unionByName(rows(spark)).write.parquet(f"{tmp_path}/b/documents.parquet")
    cache = f"file://{tmp_path}/kept"
    spark.conf.set(queries.TOKEN_CACHE, cache)
    try:
        first = sorted(map(tuple, queries.op2_token_counts(spark, f"{tmp_path}/a").collect()), key=str)
        n = spark.read.parquet(cache).count()
        spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1000).write.parquet(f"file://{tmp_path}/marked")
        assert sorted(map(tuple, queries.op2_token_counts(spark, f"{tmp_path}/a").collect()), key=str) == first
        assert spark.read.parquet(cache).count() == n
        spark.conf.set(queries.TOKEN_CACHE, f"file://{tmp_path}/marked")  # stored counts are used, misses alone are encoded
        found = queries.op2_token_counts(spark, f"{tmp_path}/b").collect()
        assert sum(r.n_tokens >= 1000 for r in found) == 2 * len(TEXTS) + 2 * TEXTS.count(None)
        assert spark.read.parquet(f"file://{tmp_path}/marked").count() > n
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)
