"""Operators with a row for each document, against plain Python."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import io
import random
import re

import pytest
import xxhash

from panelwright.llm import compression_rules, mixing, simhash_dedup, token_counts, warc

from .texts import SCHEMA, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


def by_id(rows, key="doc_id"):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_quality_rules(spark, docs):
    found = by_id(compression_rules.quality_rules(docs).collect())
    assert sum(map(len, found.values())) == len(documents())
    for doc_id, text, *_ in documents():
        text = text or ""
        words = WORDS.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = collections.Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        for r in found[doc_id]:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert got == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed), (doc_id, text[:60])
            assert not (failed and r.kept)
    assert found[9 * 7][0].kept is False


def test_compression_bands_reject_both_ends():
    rng = random.Random(3)
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(4000)).encode()
    dull = b"same again and " * 500
    rules = compression_rules.CompressionRules()
    packer = compression_rules.zstandard.ZstdCompressor(level=rules.level)
    assert compression_rules.band_verdict(memoryview(dull), rules, packer)[2] is False
    assert compression_rules.band_verdict(memoryview(bytes(rng.randrange(256) for _ in range(9000))), rules, packer)[2] is False
    assert compression_rules.band_verdict(memoryview(b""), rules, packer) == (1.0, 0.0, True)
    assert 0 < compression_rules.band_verdict(memoryview(noise), rules, packer)[0] <= 1.02


def test_token_counts_and_cache(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    tokenizer = token_counts.JsonTokenizer.from_path(path, memo_pieces=50)
    for _ in range(2):
        found = by_id(token_counts.token_counts(docs, tokenizer, cache).collect())
        assert sum(map(len, found.values())) == len(documents())
        for doc_id, text, *_ in documents():
            for r in found[doc_id]:
                assert r.n_bytes == len((text or "").encode())
                assert r.n_tokens == len(model.encode(text or "", add_special_tokens=False).ids), text
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.distinct().count() == stored.select("content_digest").distinct().count()
    other = token_counts.JsonTokenizer("other", tokenizer.payload + b"\n")
    token_counts.append_misses(docs, other, cache)
    assert spark.read.parquet(cache).count() == 2 * stored.filter(stored.tokenizer_digest == tokenizer.digest).count()


def brute_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """id of the smallest member for each (id, fingerprint)."""
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for i, f in fps:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return [low.get(find(f)) for _, f in fps]


def test_simhash(spark, docs):
    found = simhash_dedup.near_duplicates(docs).collect()
    rows = [(d[0], brute_fingerprint(d[1])) for d in documents()]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows), strict=True)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_dedup.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for i, _, c in want if i == c and i is not None})


@pytest.mark.parametrize("limit", [4, 1024])
def test_links_of_families_of_fingerprints(spark, limit):
    """With buckets above the limit and below it, components are those of all pairs."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash_dedup.fingerprint_links(spark.createDataFrame(signed, "fp long"), paired_bucket=limit)
    star = {r.u: r.v for r in simhash_dedup.components(edges).collect()}
    want = brute_components([(s[0], f) for s, f in zip(signed, fps, strict=True)])
    assert [star.get(s[0], s[0]) for s in signed] == want


def water_fill(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, targets, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = total / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
        for i in full or open_:
            targets[i] = 2.0 * sizes[i] if full else level * weights[i]
        total -= sum(targets[i] for i in full)
        open_ = open_ - full if full else set()
    return targets


@pytest.mark.parametrize("rows_per_bucket", [5, 20_000])
def test_mix(spark, docs, rows_per_bucket):
    mix = mixing.Mix(rows_per_bucket=rows_per_bucket)
    found = mixing.mixed(docs, mix=mix)
    rows = found.collect()
    assert len(rows) == len(documents())
    size = {d[0]: len(WORDS.findall(d[1] or "")) for d in documents()}
    per = collections.Counter()
    for d in documents():
        per[d[3]] += size[d[0]] if d[0] is not None else len(WORDS.findall(d[1]))
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    targets = dict(zip(names, water_fill([per[s] for s in names]), strict=True))
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == per[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        assert all(0 <= p <= 1 for p in r.positions) and (len(r.positions) > 0) == (r.taken > 0)
    assert all(taken[s] == round(targets[s]) for s in names)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(mixing.mixed(docs.repartition(2), mix=mix).collect(), key=key)
    order = [r.position for r in mixing.by_position(found).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.positions) for r in rows)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_demand_is_inverted(spark):
    rows = spark.range(0, 101).selectExpr("id / 100 AS share", "explode(array(0, 1, 2)) AS rank")
    got = rows.select("*", mixing._inverse_demand(rows["share"], rows["rank"], mixing.Mix().schedules).alias("t")).collect()
    for r in got:
        a, _, b = mixing.Mix().schedules[r["rank"]]
        assert a * r.t + (b - a) * r.t**2 / 2 == pytest.approx(r.share, abs=1e-9)


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 100_000, "<p>a</p>", "", "WARC/1.1\r\n\r\n", "x\r\n\r\ny"]
    pages = [(i * 3, None if i == 1 else f"http://h/{i}?é", t, "extra") for i, t in enumerate(html)] + [(None, "http://n", "<p>a</p>", "extra")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string").repartition(3)
    path = f"file://{tmp_path}/warc"
    rows = {r.page_id: r for r in warc.page_records(df, path).collect()}
    assert len(rows) == len(pages)
    last = {}
    for i, _, t, _ in pages:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", i))
    for i, _, t, _ in pages:
        raw, keeper = (t or "").encode(), last[t or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want = (i, len(raw), digest, "response", None) if i == keeper else (i, len(raw), digest, "revisit", keeper)
        assert tuple(rows[i]) == want
    back = {r.target_uri: bytes(r.payload).decode() for r in warc.read_warc(spark, path).filter("record_type = 'response'").collect()}
    assert back["http://h/8?é"] == "x\r\n\r\ny" and back["http://h/4?é"] == html[4]
    assert warc.read_warc(spark, path).filter("target_uri = 'http://h/5?é'").select("payload_digest").count() == 1
    assert warc.read_warc(spark, path, payloads=False).filter("record_type IN ('response') AND payload IS NOT NULL").count() == 0
    large = warc.page_records(df, f"file://{tmp_path}/warc2", min_revisit_bytes=5).filter("payload_bytes = 0").collect()
    assert {r.record_type for r in large} == {"response"}


class Counted(io.BytesIO):
    read_bytes = 0

    def readinto(self, b):
        n = super().readinto(b)
        self.read_bytes += n
        return n


@pytest.mark.parametrize("form", ["plain", "members", "foreign gzip"])
def test_warc_records_are_skipped_unread(form):
    rng = random.Random(1)
    payloads = [rng.randbytes(300_000), b"", b"x\r\n\r\ny", rng.randbytes(10)]
    records = [warc.record_bytes({"WARC-Type": t, "WARC-Record-ID": str(i)}, p) for i, (t, p) in enumerate(zip(["a", "b", "a", "b"], payloads, strict=True))]
    pack = {"plain": lambda r: r, "members": warc.gzip_member, "foreign gzip": gzip.compress}[form]
    raw = b"".join(map(pack, records))
    assert form == "plain" or gzip.decompress(raw) == b"".join(records)
    for kind in "ab":
        source = Counted(raw)
        got = list(warc.scan(warc.BufferedReader(source), lambda f, kind=kind: f["warc-type"] == kind))
        assert [f["warc-record-id"] for f, _ in got] == list("0123")
        assert [b for _, b in got] == [p if t == kind else None for t, p in zip("abab", payloads, strict=True)]
        assert kind == "a" or form == "foreign gzip" or source.read_bytes < 100_000
    with pytest.raises(ValueError):
        list(warc.scan(warc.BufferedReader(io.BytesIO(warc.gzip_member(records[2])[:-8] + b"12345678")), lambda f: True))


def test_warc_filters_are_taken_over():
    left = [warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]
    reader = warc.WarcReader({"path": "file:///none"}, warc.StructType.fromDDL(warc.SCHEMA))
    assert list(reader.pushFilters(left)) == left[1:] and reader.tests == [("record_type", "in", ("revisit",))]
