"""Quality rules with compression bands.

Text that compresses far better than prose repeats itself; text that hardly compresses is noise. A document is judged
by the zstandard ratio (compressed by raw bytes) of its whole text and of its fixed chunks. The limits depend on the
length, because short texts give a compressor little to find: the longer, the lower the ratios of prose.

High limits are fixed between prose and noise. Low limits can be fitted to labelled documents (fitted_rules): junk that
repeats its symbols or cells compresses better than good prose of its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .shared import apart

SYMBOLS = X.byte_table("#*$%&|<>")


@dataclass(frozen=True)
class Band:
    """Up to max_bytes of text (None: any), ratios below low are repetitive and above high incompressible."""

    max_bytes: int | None
    low: float
    high: float


@dataclass(frozen=True)
class CompressionRules:
    """High limits lie midway between the largest ratio of prose and the smallest of random letters and digits, by length.

    Chunks have the limits of their length, the low one times chunk_slack. A remainder of fewer than min_chunk_bytes
    belongs to the chunk before.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    chunk_bytes: int = 4096
    min_chunk_bytes: int = 1024
    bands: tuple[Band, ...] = (
        Band(512, 0.25, 0.78), Band(1024, 0.20, 0.73), Band(2048, 0.20, 0.67), Band(4096, 0.18, 0.63), Band(8192, 0.18, 0.61), Band(None, 0.15, 0.60)
    )
    chunk_slack: float = 0.85
    max_bad_chunk_share: float = 0.5

    def band(self, size: int) -> Band:
        return next(b for b in self.bands if b.max_bytes is None or size <= b.max_bytes)


METRICS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.DoubleType()) for n in ("zstd_ratio", "bad_chunk_share")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys, and for each but the first in that order whether it equals the one before."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, ordered[1:] == ordered[:-1]


def text_metrics(part: X.Slice) -> dict[str, np.ndarray]:
    """The base counts for each document of a slice."""
    starts, ends, first = part.words(X.SPACED)
    n, docs = len(part), np.arange(len(part), dtype=np.uint64)
    salt = X.mix(docs + np.uint64(1))
    sums = X.window_sums(X._CODES[part.data])
    words = X.span_hash(sums, starts, ends)
    head = X.SPACED[part.data] & ((part.data & 0xC0) != 0x80)
    out = {"n_words": np.diff(first), "word_chars": X.tally(head, part.bounds), "n_symbols": X.tally(SYMBOLS[part.data], part.bounds)}

    ls, le, of = part.lines()
    filled = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, of = ls[filled], le[filled], of[filled]
    order, same = _repeats(X.span_hash(sums, ls, le) ^ salt[of])
    out["n_dup_lines"] = np.bincount(of[order[1:][same]], minlength=n)

    repeat = np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        doc = np.repeat(np.arange(n), np.diff(first))
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        grams = X.mix(words[at] + X.mix(words[at + 1] + X.mix(words[at + 2]))) ^ salt[doc[at]]
        order, same = _repeats(grams)
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeat[at[twice] + k] = True
    out["n_repeat_words"] = X.tally(repeat, first)
    return out


def _ratio(packer: zstandard.ZstdCompressor, raw: memoryview) -> float:
    return len(packer.compress(raw)) / len(raw) if len(raw) else 1.0


def band_verdict(raw: memoryview, rules: CompressionRules, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole-text ratio, share of chunks outside the chunk band, and whether both are within limits. Empty: 1.0, 0.0, True."""
    whole = _ratio(packer, raw)
    bad = number = at = 0
    while at < len(raw):
        end = at + rules.chunk_bytes if len(raw) - at >= rules.chunk_bytes + rules.min_chunk_bytes else len(raw)
        number += 1
        limits = rules.band(end - at)
        bad += not limits.low * rules.chunk_slack <= (whole if end - at == len(raw) else _ratio(packer, raw[at:end])) <= limits.high
        at = end
    share = bad / number if number else 0.0
    band = rules.band(len(raw))
    return whole, share, not len(raw) or (band.low <= whole <= band.high and share <= rules.max_bad_chunk_share)


def judged(rules: CompressionRules, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            for part in X.slices(batch.column(batch.schema.get_field_index(text_col))):
                cols = text_metrics(part)
                raw, b = memoryview(part.data), part.bounds
                verdicts = [band_verdict(raw[b[i] : b[i + 1]], rules, packer) for i in range(len(part))]
                n = cols["n_words"]
                cols["zstd_ratio"] = np.array([v[0] for v in verdicts], dtype=float)
                cols["bad_chunk_share"] = np.array([v[1] for v in verdicts], dtype=float)
                cols["base_failed"] = (n < rules.min_words) | (100 * cols["n_repeat_words"] > rules.max_repeat_percent * n)
                cols["kept"] = ~cols["base_failed"] & np.array([v[2] for v in verdicts], dtype=bool)
                rows = batch.slice(part.first, len(part))
                names = [f.name for f in METRICS]
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(cols[k]) for k in names)], names=[*rows.schema.names, *names])

    return run


def quality_rules(docs: DataFrame, *, text_col: str = "text", rules: CompressionRules = CompressionRules()) -> DataFrame:
    """docs with METRICS added; one narrow pass, rows and order of partitions unchanged.

    Null text counts as empty: no words, base_failed. Repeated rows are judged alike. An empty table gives an empty
    one. Columns of docs that bear a METRICS name are replaced. Texts are judged whole whatever their length.
    """
    names = {f.name for f in METRICS}
    kept = docs.select([c for c in docs.columns if c not in names])
    return kept.mapInArrow(judged(rules, text_col), T.StructType([*kept.schema.fields, *METRICS.fields]))


#: Upper ends of the lengths that low limits are fitted for.
FITTED_BYTES = (512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 16384, 32768, 65536, 131072, 262144, 1048576)


def _ratios(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in X.slices(batch.column(1)):
                raw, b = memoryview(part.data), part.bounds
                found = [_ratio(packer, raw[b[i] : b[i + 1]]) for i in range(len(part))]
                ids = batch.column(0).slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(b)), pa.array(found, pa.float64())], names=["id", "size", "ratio"])

    return run


def fitted_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", rules: CompressionRules = CompressionRules(), least: int = 20, margin: float = 0.03) -> CompressionRules:
    """rules whose low limits are, by length, the smallest ratio of all documents labelled good, less a margin.

    Labels: rows (id_col, good_col 0 or 1), as many as there are; null and repeated ids in either table do no harm.
    Lengths with fewer than `least` good documents keep their limit, and no limit is lowered. Texts stay where they are
    read: ids with ratios meet the labels, first one row for each id and length. The driver gets one row for each length.
    Without labels, the rules stay.
    """
    good = labels.filter((F.col(good_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND length(text) > 0")
    sizes = T.StructType([texts.schema["id"], T.StructField("size", T.LongType()), T.StructField("ratio", T.DoubleType())])
    of = sum((F.col("size") > b).cast("int") for b in FITTED_BYTES)
    by_id = texts.mapInArrow(_ratios(rules.level), sizes).groupBy("id", of.alias("of")).agg(F.count("*").alias("n"), F.min("ratio").alias("ratio"))
    found = {r.of: r for r in by_id.join(good, "id", "left_semi").groupBy("of").agg(F.sum("n").alias("n"), F.min("ratio").alias("ratio")).collect()}
    bands = []
    ends = sorted({*FITTED_BYTES, *(b.max_bytes for b in rules.bands if b.max_bytes is not None)})
    for end in (*ends, None):
        old = rules.band(end if end is not None else max(ends) + 1)
        seen = found.get(sum(b < end for b in FITTED_BYTES) if end is not None else len(FITTED_BYTES))
        low = max(old.low, seen.ratio * (1 - margin)) if seen and seen.n >= least else old.low
        bands.append(Band(end, low, old.high))
    return replace(rules, bands=tuple(bands))


def kept_rows(docs: DataFrame, *, text_col: str = "text", rules: CompressionRules = CompressionRules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their own columns, whatever their names.

    Null and empty texts go, repeated rows stay or go alike, an empty table gives an empty one.
    """
    own, name, back = apart(docs)
    return back(quality_rules(own, text_col=name(text_col), rules=rules).filter("kept"))
