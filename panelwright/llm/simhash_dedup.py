"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most 3 bits, some segment starts
a chain whose cumulative differences stay within the proportional budgets 3/4, 6/4, 9/4 and 12/4 of a bit, that is 0, 1, 2
and 3 bits. So the first segment is equal, and of the four bytes of the next two at least two are equal, one of them in
the second segment. These five choices of bytes for each of the four chain starts make 20 keys of 32 bits that a pair can
meet under; met pairs must keep the budgets along the chain before the full Hamming distance is taken.

A bucket of one key may hold many fingerprints of one large family. Beyond a size its pairs are not formed: members are
joined through the fingerprints between them (see _between), which is exact and linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, forest
from .shared import apart, hot_join, materialise

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Shifts of the two bytes that are joined to the first segment, in a fingerprint turned so that its chain starts at bit 0.
BYTE_CHOICES = ((16, 24), (16, 32), (16, 40), (24, 32), (24, 40))
#: Bits of the first one, two, three and four segments of a chain, and how many may differ there.
BUDGETS = ((0xFFFF, 0), (0xFFFFFFFF, 1), (0xFFFFFFFFFFFF, 2), (0xFFFFFFFFFFFFFFFF, 3))
#: Members of a bucket whose pairs are compared one with another; larger buckets are joined through fingerprints between.
PAIRED_BUCKET = 1024
_BITS_AT_A_TIME = 1 << 15


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 of all word shingles of a text in UTF-8, A-Z lowered; 0 where there is no word."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter([h(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BITS_AT_A_TIME):
        part = hashes[at : at + _BITS_AT_A_TIME]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second column, text, becomes its fingerprint; other columns stay."""
    for batch in batches:
        texts = (t.as_buffer() for t in batch.column(1).cast(pa.binary()))  # copied one at a time
        found = np.array([fingerprint(t.to_pybytes() if t else b"") for t in texts], dtype=np.uint64).view(np.int64)
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=[names[0], "fp", *names[2:]])


def _turned(fp: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """fp rotated so that segment start becomes the lowest."""
    by = np.uint64(16) * np.asarray(start, np.uint64)
    return (fp >> by) | (fp << ((np.uint64(64) - by) & np.uint64(63)))


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint, and the fingerprints once for each key."""
    keys, kinds = [], 0
    for start in range(4):
        turned = _turned(fp, start)
        for one, two in BYTE_CHOICES:
            value = (turned & np.uint64(0xFFFF)) | ((turned >> np.uint64(one)) & np.uint64(255)) << np.uint64(16) | ((turned >> np.uint64(two)) & np.uint64(255)) << np.uint64(24)
            keys.append(value | np.uint64(kinds) << np.uint64(32))
            kinds += 1
    return np.concatenate(keys), np.tile(fp, kinds)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, fp = chain_keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64))], names=["bucket", "fp"])


def linked(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs that met under a key keep the budgets along the key's chain, and then in full."""
    differ = _turned(a ^ b, (key >> np.uint64(32)) // np.uint64(len(BYTE_CHOICES)))
    at = np.arange(len(a))
    for mask, budget in BUDGETS:
        at = at[np.bitwise_count(differ[at] & np.uint64(mask)) <= budget]
    return at


def _pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within the groups of equal keys; key is sorted."""
    us, vs = [], []
    at, step = np.arange(len(key)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        got = at[linked(key[at], fp[at], fp[at + step])]
        us.append(fp[got])
        vs.append(fp[got + step])
        step += 1
        if step % 256 == 0:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs = [u], [v]
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _bucket_links(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by bucket: links (bucket null), and the members of buckets above the limit as they are."""

    def batch_of(bucket, u, v):
        u, v = (pa.array(x.view(np.int64)) for x in (u, v))
        bucket = pa.nulls(len(u), pa.int64()) if bucket is None else pa.array(bucket.view(np.int64))
        return pa.RecordBatch.from_arrays([bucket, u, v], names=["bucket", "u", "v"])

    def settle(key, fp, open_key):
        """Links of the small groups, rows of the large ones; open_key: a group known to be large."""
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        large = np.repeat((np.diff(np.r_[first, len(key)]) > limit) | (key[first] == open_key if open_key is not None else False), np.diff(np.r_[first, len(key)]))
        if large.any():
            yield batch_of(key[large], fp[large], fp[large])
        if not large.all():
            yield batch_of(None, *_pairs(key[~large], fp[~large]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.uint64)
        large = None
        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
            fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(key):
                continue
            cut = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))  # the last group may go on
            if cut:
                yield from settle(key[:cut], fp[:cut], large)
                key, fp, large = key[cut:], fp[cut:], large if large == key[-1] else None
            if len(key) > limit or large is not None:
                large = key[-1]
                yield batch_of(key, fp, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from settle(key, fp, large)

    return run


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member of a large bucket, the fingerprints up to two bits off, outside the key's bits.

    Of two members up to three bits apart, some fingerprint is at most one bit from one of them and two from the other.
    Members at most one bit from it are within two bits of each other, and within three of those two bits from it. So
    linking everybody near a fingerprint to one member at most one bit from it links right and misses nothing.
    """
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        for key, fp in zip(keys, fps, strict=True):
            kind = int(key) >> 32
            start, (one, two) = kind // len(BYTE_CHOICES), BYTE_CHOICES[kind % len(BYTE_CHOICES)]
            fixed = {*range(16), *range(one, one + 8), *range(two, two + 8)}
            free = [(i + 16 * start) % 64 for i in range(64) if i not in fixed]
            flips = [0, *(1 << i for i in free), *(1 << i | 1 << j for i, j in combinations(free, 2))]
            near = fp ^ np.array(flips, np.uint64)
            n = len(near)
            columns = (np.full(n, key).view(np.int64), near.view(np.int64), np.full(n, fp).view(np.int64), np.arange(n) <= len(free))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "near", "fp", "close"])


def fingerprint_links(fps: DataFrame, *, paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """Edges (u, v) whose components are those of the distinct fingerprints fp linked at 3 or fewer differing bits.

    Fingerprints are longs without nulls; repeated ones count once. One fingerprint, or an empty table, has no edges.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp").distinct().mapInArrow(_keyed, "bucket long, fp long")
    met = materialise(keyed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(paired_bucket), "bucket long, u long, v long"), "simhash-met")
    near = met.filter("bucket is not null").select("bucket", F.col("u").alias("fp")).mapInArrow(_between, "bucket long, near long, fp long, close boolean")
    hubs = near.filter("close").groupBy("bucket", "near").agg(F.min("fp").alias("v"))
    through = near.join(hubs, ["bucket", "near"]).filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return met.filter("bucket is null").select("u", "v").unionByName(through)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _rooted(nodes: DataFrame, paired_bucket: int) -> DataFrame:
    """nodes (one row for each fingerprint fp) with the root of its component."""
    stars = components(fingerprint_links(nodes, paired_bucket=paired_bucket))
    return nodes.join(stars, nodes["fp"] == stars["u"], "left").select(nodes["*"], F.coalesce("v", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """One row per row of docs: id, fingerprint (hex), component_id (smallest id of its component).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each get a row. A row without
    id takes part and counts for no component_id; a component without any id has none. An empty table gives an empty one.
    Only the two named columns are read. Equal fingerprints are collapsed before anything is compared.
    """
    read = docs.select(F.col(id_col).alias("id"), text_col)
    prints = materialise(read.mapInArrow(_fingerprints, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])), "simhash-fp")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "simhash-nodes")
    rooted = materialise(_rooted(nodes, paired_bucket), "simhash-rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_prints")), "simhash-roots")
    classes = materialise(hot_join(rooted, named, ["root"], "n_prints").select("fp", "component_id", "n"), "simhash-classes")
    return hot_join(prints, classes, ["fp"], "n").select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """docs with one row left of each component: that with the smallest id, nulls last. Columns unchanged.

    Rows are told apart by two digests of all columns, not by id: an id that occurs with several texts counts in the
    component of each. Of several rows with the smallest id the one with the smallest digests stays, of equal rows any.
    Rows without id take part like any other; a component without any id keeps one of them. Null and empty texts are one
    component. An empty table gives an empty one.
    """
    own, name, back = apart(docs)
    ident, text = name(id_col), name(text_col)
    keyed = own.select("*", F.xxhash64(*own.columns).alias("row"), F.xxhash64(F.lit(1), *own.columns).alias("digest"))
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("row", T.LongType()), T.StructField("digest", T.LongType())]
    prints = keyed.select(F.col(ident).alias("id"), text, "row", "digest").mapInArrow(_fingerprints, T.StructType(fields))
    rows = prints.groupBy("fp", "id", "row", "digest").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "digest", "n"))
    nodes = materialise(rows.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    chosen = materialise(_rooted(nodes, paired_bucket).groupBy("root").agg(F.min("first").alias("first")).select("first.row", "first.digest", "first.n"), "simhash-chosen")
    single = keyed.join(chosen.filter("n = 1"), ["row", "digest"], "left_semi")
    repeated = chosen.filter("n > 1").withColumn("chosen", F.lit(True))
    if repeated.isEmpty():
        return back(single)
    several = hot_join(keyed, materialise(repeated, "simhash-repeated"), ["row", "digest"], "n").filter("chosen").drop("chosen")
    return back(single.unionByName(several.dropDuplicates(["row", "digest"])))
