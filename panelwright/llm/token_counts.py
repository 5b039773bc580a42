"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised form together with the digest of the tokenizer file. Stored counts are
joined by that key; only distinct texts without a stored count are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import exists, hot_join, materialise

CACHE = T.StructType([T.StructField("content_digest", T.BinaryType()), T.StructField("tokenizer_digest", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Entries of a worker's memo of pieces; the memo is emptied when it is full.
MEMO_PIECES = 600_000


#: Normalisers that treat a text piece by piece as they treat it whole, where pieces end at white space.
_PIECEWISE = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")
_SPACES = " \t\n\x0b\x0c\r"


def _piecewise_normaliser(how: dict | None) -> bool:
    if how is None or how["type"] in _PIECEWISE:
        return True
    if how["type"] == "Sequence":
        return all(map(_piecewise_normaliser, how["normalizers"]))
    return how["type"] == "Replace" and how["pattern"] == {"Regex": "\\s+"} and how["content"] == " "


def _splits_at_space(how: dict | None) -> bool:
    """Whether the pre-tokenizer drops all ASCII white space, whatever stands beside it."""
    if how is None:
        return False
    if how["type"] == "Sequence":
        return bool(how["pretokenizers"]) and _splits_at_space(how["pretokenizers"][0])
    if how["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    if how["type"] != "Split" or how["behavior"] != "Removed" or not how["invert"] or "Regex" not in how["pattern"]:
        return False
    import regex

    text = how["pattern"]["Regex"]
    if regex.search(r"\(\?[=!<]|(?<!\[)\^|\$|\\[bB]", text):  # looks at what stands beside a match
        return False
    sides = ("", "a", "1", "!", "'s", "é")
    probes = [before + space * n + after for space in _SPACES for n in (1, 2, 3) for before in sides for after in sides]
    return not any(set(m[0]) & set(_SPACES) for p in probes for m in regex.finditer(text, p))


def splits_at_space(payload: bytes) -> bool:
    """Whether a tokenizers .json file gives a text the tokens of its white-space separated pieces, one after another."""
    how = json.loads(payload)
    joined = any(set(t["content"]) & set(_SPACES) for t in how.get("added_tokens") or [])
    return not joined and _piecewise_normaliser(how.get("normalizer")) and _splits_at_space(how.get("pre_tokenizer"))


class JsonTokenizer:
    """A tokenizers .json file.

    Where its pre-tokenizer never joins text across ASCII white space (spaced), a text's tokens are those of its pieces
    between white space, and pieces are encoded once per worker. Other tokenizers encode texts whole.
    """

    def __init__(self, name: str, payload: bytes, memo_pieces: int = MEMO_PIECES):
        self.name, self.payload, self.memo_pieces = name, payload, memo_pieces
        self.digest = hashlib.sha256(payload).hexdigest()
        self.spaced = splits_at_space(payload)

    @classmethod
    def from_path(cls, path: str, **kw) -> JsonTokenizer:
        return cls(Path(path).name, Path(path).read_bytes(), **kw)

    def counter(self) -> Callable[[bytes], int]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_buffer(self.payload)
        model.no_truncation()
        model.no_padding()
        if not self.spaced:
            return lambda raw: len(model.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)
        memo: dict[bytes, int] = {}

        def count(raw: bytes) -> int:
            pieces = raw.split()  # bytes are split at ASCII white space only
            try:
                return sum(map(memo.__getitem__, pieces))
            except KeyError:
                pass
            new = list({p for p in pieces if p not in memo})
            if len(memo) + len(new) > self.memo_pieces:
                memo.clear()
                new = list(set(pieces))
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                found = model.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
                memo.update(zip(some, map(len, found), strict=True))
            return sum(map(memo.__getitem__, pieces))

        return count


def content_digest(text: Column, spaced: bool = True) -> Column:
    """Digest of the text. spaced: with runs of ASCII white space as one space and none at the ends, as for tokenizers that
    see no difference."""
    text = F.coalesce(text, F.lit(""))
    if spaced:
        text = F.trim(F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), " {2,}", " "))
    return F.unhex(F.sha2(text, 256))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First row of each digest that this task sees, so that a text copied a million times is shuffled once per task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, digest in enumerate(batch.column(0).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _encoded(tokenizer: JsonTokenizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.counter()
        for batch in _once(batches):
            counts = [count(raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array([tokenizer.digest] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=CACHE.names)

    return run


def read_cache(docs: DataFrame, cache_path: str) -> DataFrame:
    """Stored counts; empty where nothing was stored yet."""
    spark = docs.sparkSession
    return spark.read.schema(CACHE).parquet(cache_path) if exists(spark, cache_path) else spark.createDataFrame([], CACHE)


def append_misses(docs: DataFrame, tokenizer: JsonTokenizer, cache_path: str, *, text_col: str = "text") -> None:
    """Encode each distinct text that has no stored count under this tokenizer once, and append the counts."""
    stored = read_cache(docs, cache_path).filter(F.col("tokenizer_digest") == tokenizer.digest).select("content_digest")
    texts = docs.select(content_digest(F.col(text_col), tokenizer.spaced).alias("content_digest"), F.coalesce(F.col(text_col), F.lit("")).alias("content_text"))
    misses = texts.mapInArrow(_once, texts.schema).join(stored, "content_digest", "left_anti")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    misses.repartition(parts, "content_digest").mapInArrow(_encoded(tokenizer), CACHE).write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer: JsonTokenizer, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, content_digest, n_tokens for every row of docs; appends what the cache lacks.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get a row. An empty table gives an empty one.
    Only id_col and text_col are read, so other columns may have any names. Null ids stay null. A count appended twice,
    by two jobs at once, is read once. Digests are made once and written; counts of very common texts are broadcast.
    """
    append_misses(docs, tokenizer, cache_path, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = materialise(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col(text_col), tokenizer.spaced).alias("content_digest")), "token-digests")
    stored = read_cache(docs, cache_path).filter(F.col("tokenizer_digest") == tokenizer.digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = materialise(keyed.groupBy("content_digest").agg(F.count("*").alias("copies")).join(stored, "content_digest", "left"), "token-counts")
    return hot_join(keyed, counts, ["content_digest"], "copies").select(F.col("id").alias(id_col), "n_bytes", "content_digest", "n_tokens")
