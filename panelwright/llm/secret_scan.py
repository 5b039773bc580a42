"""Secret scans: candidates found by form, false positives removed by a random forest.

Candidates are long runs of key characters with a digit, mixed case or capitals only, what stands after an assignment to
a secret's name, passwords in addresses, and private key blocks. The forest looks at length, character transitions,
dictionary coverage, whether the candidate is part of a path, and the neighbouring words. It is trained on the driver
from labelled findings. Dictionary and transitions can be those of the corpus (corpus_words).
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.trees import RandomForest
from . import textops as X
from .shared import apart, materialise

KEY_CHARS = X.byte_table((string.ascii_letters + string.digits + "+/_=-.~").encode())
MIN_RUN, MIN_ASSIGNED = 16, 6
#: Of either case so many letters make a run without a digit a candidate.
MIN_CASES = 3
CONTEXT = 80
SECRET_NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "auth", "authorization", "bearer", "credential", "credentials", "private_key")
HARMLESS_NAMES = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "revision", "version", "build", "isbn", "serial", "integrity", "fingerprint", "png", "jpeg", "image", "href", "src", "url", "path", "file", "example", "page", "order", "id")
DICTIONARY = tuple(
    "able about access account action add address after all also and any app apply area array auth back base before best block board body book both box branch build button by cache call can case cell change check child city class clear click client close cloud code color column com come commit common config connect content copy core count create data date day default delete demo detail dev device dir document down draft edit email end engine error event example export feature field file filter find first folder font for form format from full function game general get global group guide has head help here high history home host how icon image import index info input install item job json key kind label large last layer left level library license light line link list load local location lock log login long loop main make manager map mark master match menu message meta method mode model module month more most move music name native network never next node not note number object of off old one open option order out output owner page part password path pattern phone place plan point post power press preview price private process product profile project public query question random read real record region release remote report request reset result right role room root route row rule run sample save scale schema screen script search section secret select self send server service session set shape share short show side simple site size small some sort source space stack start state static status step stop store stream string style sub super support switch system table tag target task team template test text than that the theme this thread time title token tool top total track tree true type under unit update url use user util value version video view web week wide width window with word work world write year your zone".split()
)
_WORDS = re.compile(rb"[A-Za-z_][A-Za-z_0-9-]*")
#: What is assigned: between quotes of one line, or up to white space or punctuation.
_ASSIGNED = re.compile(rb"[ \t]*[:=][ \t]*(?:\"([^\"\n]{%d,})\"|'([^'\n]{%d,})'|[\"']?([^\s\"'<>;,()]{%d,}))" % (MIN_ASSIGNED, MIN_ASSIGNED, MIN_ASSIGNED))
_NAMES = tuple(n.encode() for n in SECRET_NAMES)
#: What a name, with or without a quote and blanks after it, ends in.
_NAME_END = X.byte_table((string.ascii_letters + "\"' \t").encode())
#: A block up to its end line, or as far as its lines look like a key's: headers, then base64.
_PRIVATE_KEY = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[ \t\r]*\n[ \t]*(?:(?:Proc-Type|DEK-Info): [^\n]*|[A-Za-z0-9+/=]*)(?=[ \t\r]*(?:\n|$)))*(?:[ \t\r]*\n?[ \t]*[A-Za-z0-9+/= \\n]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")
_ADDRESS_PASSWORD = re.compile(rb"://[^\s/:@]*+:([^\s/:@]{4,}+)@")


def _named(before: bytes) -> bool:
    """Does a secret's name stand at the end, with or without a quote after it?"""
    return (before[:-1] if before[-1:] in (b'"', b"'") else before).lower().endswith(_NAMES)


def candidates(part: X.Slice) -> list[list[tuple[int, int, str]]]:
    """For each document of a slice its candidates (start, end, kind), byte offsets, sorted, none inside another."""
    data, bounds = part.data, part.bounds
    raw = data.tobytes()
    found: list[tuple[int, int, str]] = []
    starts, ends, _ = part.words(KEY_CHARS)
    sums = [np.r_[0, np.cumsum((data >= low) & (data <= high))] for low, high in ((48, 57), (65, 90), (97, 122))]
    digit, upper, lower = (c[ends] - c[starts] for c in sums)
    cased = (upper >= MIN_CASES) & (lower >= MIN_CASES) | (upper == ends - starts)
    for i in np.flatnonzero((ends - starts >= MIN_RUN) & ((digit > 0) | cased)):
        start, end = int(starts[i]), int(ends[i])
        name = raw[start:end].find(b"=")
        if 0 < name < end - start - MIN_ASSIGNED and _named(raw[max(start, start + name - 40) : start + name]):
            start += name + 1  # NAME=value without a space
        while end > start and raw[end - 1 : end] == b".":
            end -= 1
        if end - start >= MIN_ASSIGNED:
            found.append((start, end, "run"))
    reach = -1
    signs = np.flatnonzero((data == 61) | (data == 58))
    for at in signs[_NAME_END[data[signs - 1]] & (signs > 0)].tolist():
        if at < reach:
            continue  # inside what is assigned already
        doc = int(np.searchsorted(bounds, at, side="right")) - 1
        first, last = int(bounds[doc]), int(bounds[doc + 1])
        if _named(raw[max(first, at - 40) : at].rstrip(b" \t")) and (m := _ASSIGNED.match(raw, at, last)):
            reach = m.end(m.lastindex)
            found.append((m.start(m.lastindex), reach, "assigned"))
    if b"://" in raw:
        for doc in range(len(part)):
            for m in _ADDRESS_PASSWORD.finditer(raw, bounds[doc], bounds[doc + 1]):
                found.append((m.start(1), m.end(1), "address"))
    if b"PRIVATE KEY-----" in raw:
        for doc in range(len(part)):
            for m in _PRIVATE_KEY.finditer(raw[bounds[doc] : bounds[doc + 1]]):
                found.append((int(bounds[doc]) + m.start(), int(bounds[doc]) + m.end(), "private key"))
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(part))]
    reach = -1
    for start, end, kind in sorted(found, key=lambda c: (c[0], -c[1], c[2])):
        if end <= reach:
            continue
        doc = int(np.searchsorted(bounds, start, side="right")) - 1
        reach = end
        out[doc].append((start - int(bounds[doc]), end - int(bounds[doc]), kind))
    return out


class Lexicon:
    """Known words, and the log-probabilities of their letter pairs, smoothed."""

    def __init__(self, words: Iterable[str] = DICTIONARY):
        self.words = {w.encode() for w in words} | {w.encode() for w in DICTIONARY}
        self.longest = max(map(len, self.words))
        counts = Counter(w[i : i + 2] for w in self.words for i in range(len(w) - 1))
        total = sum(counts.values()) + 26 * 26
        letters = string.ascii_lowercase
        self.pairs = {(a + b).encode(): math.log((counts[(a + b).encode()] + 1) / total) for a in letters for b in letters}
        self.rare = min(self.pairs.values()) - 1
        self.table = np.array([self.pairs[(a + b).encode()] for a in letters for b in letters])
        self.beginnings = {w[:3] for w in self.words}


def corpus_words(docs: DataFrame, *, text_col: str = "text", size: int = 20_000, least: int = 3) -> list[str]:
    """The words of 4 to 20 letters a-z that most documents have, `size` of them at most, each in `least` or more.

    Documents are counted over the whole corpus. Words are taken by steps of a sixteenth of a doubling of that count; of
    the step that goes beyond size, the words with the highest counts, of equal ones those with the smallest digests. The
    driver gets a row for each step and then the words of this list alone. Null and empty texts have no words, repeated
    rows count again, an empty table has none.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?<![a-z0-9_])([a-z]{4,20})(?![a-z0-9_])"), F.lit(1)))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    common = materialise(counted.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "corpus-words")
    taken, lowest, part = 0, None, None
    for r in common.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if taken + r.words > size:
            part = r.step
            break
        taken, lowest = taken + r.words, r.step
    rows = common.filter(F.col("step") >= lowest).collect() if lowest is not None else []
    if part is not None and taken < size:
        rows += common.filter(F.col("step") == part).orderBy(F.desc("n"), F.xxhash64("word"), "word").limit(size - taken).collect()
    return [r.word for r in sorted(rows, key=lambda r: (-r.n, r.word))]


_CLASSES = bytes(1 if chr(i).isdigit() else 2 if 97 <= i <= 122 else 3 if 65 <= i <= 90 else 4 for i in range(256))
_LOWERED = np.frombuffer(bytes(i - 97 if 97 <= i <= 122 else 26 for i in range(256)), np.uint8).astype(np.int64)
#: Words of a value that only says where a secret would go.
PLACEHOLDERS = frozenset("your my the a an please enter insert here example sample changeme change placeholder replace is not none null empty required optional must should invalid wrong forgot reset asked for".split())
FEATURES = ("length", "digits", "uppers", "hex", "entropy", "transitions", "pairs", "coverage", "path", "secret_near", "harmless_near", "largest_share", "quoted", "assigned", "dashes", "capitals", "address", "blanks", "placeholders")


def features(before: bytes, token: bytes, after: bytes, lexicon: Lexicon) -> list[float]:
    n = max(1, len(token))
    low = token.lower()
    kinds = np.frombuffer(token.translate(_CLASSES), np.uint8)
    counts = [c for c in np.bincount(np.frombuffer(token, np.uint8), minlength=256).tolist() if c]
    codes = _LOWERED[np.frombuffer(low, np.uint8)]
    letters = (codes[:-1] < 26) & (codes[1:] < 26)
    pairs = lexicon.table[codes[:-1][letters] * 26 + codes[1:][letters]]
    covered, i = 0, 0
    while i < len(low):
        size = 0
        if low[i : i + 3] in lexicon.beginnings:
            size = next((k for k in range(min(lexicon.longest, len(low) - i), 2, -1) if low[i : i + k] in lexicon.words), 0)
        covered += size
        i += size or 1
    near = [w.lower().decode() for w in _WORDS.findall(before)[-4:]]
    parts = {p for w in near for p in re.split(r"[_-]", w)} | set(near)
    return [
        min(n, 400), float((kinds == 1).sum()) / n, float((kinds == 3).sum()) / n, float(not token.strip(b"0123456789abcdefABCDEF")),
        -sum(c / n * math.log2(c / n) for c in counts), float((kinds[1:] != kinds[:-1]).sum()) / n,
        float(pairs.mean()) if len(pairs) else lexicon.rare, covered / n,
        float(token.count(b"/") + (b"://" in before[-12:]) + before.endswith((b"/", b"\\")) + bool(re.search(rb"\.[a-z]{2,4}$", token))),
        float(any(s in parts or s in near for s in SECRET_NAMES)), float(any(h in parts for h in HARMLESS_NAMES)), max(counts, default=0) / n,
        float(before.endswith((b'"', b"'")) and after.startswith((b'"', b"'"))), float(bool(re.search(rb"[:=][ \t]*[\"']?$", before))), float(token.count(b"-")),
        float(token.isupper()), float(before.endswith(b":") and after.startswith(b"@")), float(token.count(b" ")), float(sum(w.lower().decode() in PLACEHOLDERS for w in _WORDS.findall(token[:400]))),
    ]


def labelled_findings(n: int = 9000, seed: int = 11) -> list[tuple[bytes, bytes, bytes, int]]:
    """Made findings (before, candidate, after, is a secret), half of them secrets; the same for the same arguments."""
    rng = random.Random(seed)
    some = lambda chars, k: "".join(rng.choices(chars, k=k))
    word = lambda: rng.choice(DICTIONARY)
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 5)))
    b64 = lambda k: base64.b64encode(rng.randbytes(k)).decode()
    made = lambda: "".join(rng.choice(["ba", "co", "di", "fe", "gu", "ha", "lo", "ma", "ni", "or", "pe", "ri", "st", "ta", "un"]) for _ in range(rng.randint(2, 4)))
    uuid = lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))

    def secret() -> tuple[str, str, str]:
        kind = rng.randrange(11)
        name = rng.choice(["token", "secret", "password", "api_key", "API_KEY", "auth_token", "client_secret", "access_key", "Authorization: Bearer", "PRIVATE_TOKEN", "db_password", "passwd"])
        token = [
            lambda: some(hexes, rng.choice([32, 40, 64])), lambda: b64(rng.randint(15, 48)), lambda: rng.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + "234567" * rng.randint(0, 1), 16),
            lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + some(alnum, rng.randint(20, 40)), lambda: some(alnum + "!@#$%^&*", rng.randint(10, 24)),
            lambda: some(alnum, rng.randint(20, 64)), lambda: f"eyJ{b64(rng.randint(15, 36))}.{b64(rng.randint(30, 180))}.{b64(rng.choice([24, 32, 64]))}".replace("=", ""), lambda: some(string.ascii_letters, rng.randint(18, 40)),
            lambda: some(alnum + "!$%_-.", rng.randint(6, 20)), lambda: some(alnum + "!$%_-.", rng.randint(6, 12)), lambda: " ".join(made() if rng.random() < 0.6 else word() for _ in range(rng.randint(3, 6))),
        ][kind]()
        if kind == 10:
            quote = rng.choice(['"', "'"])
            return f"{prose()} {rng.choice(['password', 'passphrase', 'passwd', 'pwd', 'secret', 'db_password', 'PASSPHRASE'])}{rng.choice([' = ', '=', ': '])}{quote}", token, f"{quote} {prose()}"
        if kind == 8:
            return f"{prose()} {rng.choice(['postgres', 'https', 'redis', 'mongodb', 'ftp'])}://{word()}:", token, f"@{word()}.{word()}.com/{word()}"[:8]
        if kind in (2, 3, 6) and rng.random() < 0.5:
            return f"{prose()} ", token, f" {prose()}"
        quote = rng.choice(['"', "'", ""])
        return f"{prose()} {name}{rng.choice([' = ', '=', ': ', ' : '])}{quote}", token, f"{quote} {prose()}"

    def harmless() -> tuple[str, str, str]:
        kind = rng.randrange(13)
        if kind == 12:
            quote = rng.choice(['"', "'"])
            said = [rng.choice(["enter", "your", "the", "please", "insert", "a", "change", "is", "must", "not", "invalid", "wrong", "forgot"]) for _ in range(rng.randint(1, 3))]
            return f"{prose()} {rng.choice(['password', 'token', 'secret', 'auth', 'api_key', 'passphrase'])}{rng.choice([': ', ' = ', '='])}{quote}", " ".join([*said, *(word() for _ in range(rng.randint(1, 3))), *rng.choice([[], ["here"], ["required"]])]), f"{quote} {prose()}"
        if kind == 0:
            return f"{prose()} {rng.choice(['commit', 'sha1:', 'md5 =', 'checksum:', 'revision', 'etag: ', 'hash ='])} ", some(hexes, rng.choice([32, 40, 64])), f" {prose()}"
        if kind == 1:
            return f"{prose()} {rng.choice(['id', 'uuid', 'guid', 'page'])}{rng.choice([': ', '=', ' '])}", uuid(), f" {prose()}"
        if kind == 2:
            return f"{prose()} {rng.choice(['https://www.', 'src=', 'see ', '/usr/'])}", "/".join([word() + rng.choice([".com", ""]), *(word() + rng.choice(["", some(string.digits, 2)]) for _ in range(rng.randint(2, 5)))]) + rng.choice([".html", ".png", ".py", "/1"]), f" {prose()}"
        if kind == 3:
            return f"{prose()} ", "_".join(word() for _ in range(rng.randint(3, 6))) + f"_{rng.randint(0, 99)}", f"{rng.choice(['(', ' ', ' = '])}{prose()}"
        if kind == 4:
            return f"{prose()} {rng.choice(['', 'tel ', 'order ', 'isbn ', 'number '])}", some(string.digits, rng.choice([16, 17, 19, 20])), f" {prose()}"
        if kind == 5:
            return f"{prose()} {rng.choice(['data:image/png;base64,', 'integrity=sha256-', 'font ' ])}", b64(rng.randint(30, 120)), f"\" {prose()}"
        if kind == 6:
            return f"{prose()} {rng.choice(['password', 'token', 'api_key', 'secret'])}{rng.choice([' = ', ': '])}\"", rng.choice(["your_api_key_here_1", "xxxxxxxxxxxxxxxx0", "changeme12345678", "example_token_123", "<insert-token-1>", "os.environ.get_1", "0000000000000000", "placeholder_key_1"]), f'" {prose()}'
        if kind == 8:
            return f"{prose()} ", "".join(word().capitalize() for _ in range(rng.randint(3, 6))), f"{rng.choice(['(', ' ', '.'])}{prose()}"
        if kind == 9:
            return f"{prose()} ", "_".join(word().upper() for _ in range(rng.randint(3, 5))), f" {prose()}"
        if kind == 10:
            return f"{prose()} ", rng.choice(["", "A", "The"]) + rng.choice([".", "-", "/", "..."]).join(rng.choice([word(), word().capitalize()]) for _ in range(rng.randint(3, 6))), f" {prose()}"
        if kind == 7:
            return f"{prose()} ", "-".join(word() for _ in range(rng.randint(3, 6))) + f"-{rng.randint(1, 2030)}", f" {prose()}"
        return f"{prose()} {rng.choice(['token', 'password', 'secret', 'auth'])}{rng.choice([': ', ' = '])}", "".join(word() for _ in range(rng.randint(1, 4))), f" {prose()}"

    rows = []
    for i in range(n):
        label = i % 2
        rows.append((*(s.encode() for s in (secret() if label else harmless())), label))
    return rows


@dataclass
class SecretModel:
    forest: RandomForest
    lexicon: Lexicon
    threshold: float = 0.5

    def scores(self, findings: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
        """Findings that are equal in what is looked at are looked at once."""
        place: dict[tuple[bytes, bytes, bytes], int] = {}
        which = [place.setdefault(f, len(place)) for f in findings]
        return self.forest.predict(np.array([features(*f, self.lexicon) for f in place]))[which] if findings else np.zeros(0)


def train(findings: list[tuple[bytes, bytes, bytes, int]] | None = None, *, words: Iterable[str] = (), trees: int = 40, max_findings: int = 20_000, seed: int = 7) -> SecretModel:
    """Fit on labelled findings; without any, on labelled_findings(). words are added to the dictionary.

    Of more than max_findings a random sample is taken, of each label half of max_findings at most, or what the other
    label leaves free. Findings of one label only are refused: a model of them would say the same of everything.
    """
    rows = labelled_findings() if findings is None else list(findings)
    sides = [[r for r in rows if bool(r[3]) == side] for side in (False, True)]
    if not all(sides):
        raise ValueError("findings of both labels are needed")
    half = max_findings // 2
    room = [max(half, max_findings - len(sides[1 - k])) for k in (0, 1)]
    draw = random.Random(seed)
    rows = [r for side, most in zip(sides, room, strict=True) for r in (side if len(side) <= most else draw.sample(side, most))]
    lexicon = Lexicon(words)
    x, y = np.array([features(*r[:3], lexicon) for r in rows]), np.array([r[3] for r in rows], float)
    return SecretModel(RandomForest(n_estimators=trees, max_depth=10, min_samples_leaf=2, max_features="sqrt", random_state=seed).fit(x, y), lexicon)


_SECRET = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]
FINDING_FIELDS = [T.StructField("n_candidates", T.LongType()), T.StructField("secrets", T.ArrayType(T.StructType(_SECRET)))]
_FINDINGS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def judged(part: X.Slice, model: SecretModel) -> tuple[list[int], list[list[dict]]]:
    """Number of candidates and the secrets of each document of a slice."""
    every = candidates(part)
    texts, place = [], []
    for doc, found in enumerate(every):
        raw = part.data[part.bounds[doc] : part.bounds[doc + 1]] if found else None
        for start, end, kind in found:
            texts.append(tuple(raw[a:b].tobytes() for a, b in ((max(0, start - CONTEXT), start), (start, end), (end, end + 8))))
            place.append((doc, start, end, kind))
    secrets: list[list[dict]] = [[] for _ in every]
    for (doc, start, end, kind), score in zip(place, model.scores(texts), strict=True):
        if kind == "private key" or score >= model.threshold:
            secrets[doc].append({"start": start, "end": end, "kind": kind, "score": 1.0 if kind == "private key" else float(score)})
    return list(map(len, every)), secrets


def _scanned(text_col: str, model: SecretModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(batch.schema.get_field_index(text_col))):
                n, secrets = judged(part, model)
                rows = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64()), pa.array(secrets, _FINDINGS)], names=[*rows.schema.names, *(f.name for f in FINDING_FIELDS)])

    return run


def scan_secrets(docs: DataFrame, model: SecretModel | None = None, *, text_col: str = "text") -> DataFrame:
    """docs with n_candidates and secrets (UTF-8 byte spans, kind, score); one narrow pass over whole texts.

    Null and empty texts have no candidates. Repeated rows are judged alike; an empty table gives an empty one. Columns of
    docs with the names of the added ones are replaced. Overlapping candidates: the first, of those the longest.
    """
    names = {f.name for f in FINDING_FIELDS}
    read = docs.select([c for c in docs.columns if c not in names])
    return read.mapInArrow(_scanned(text_col, model or train()), T.StructType([*read.schema.fields, *FINDING_FIELDS]))


MASK = b"[SECRET]"


def _masked(text: str, length: str | None, model: SecretModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in X.slices(batch.column(at)):
                _, secrets = judged(part, model)
                rows = batch.slice(part.first, len(part))
                hit = [i for i, found in enumerate(secrets) if found]
                if not hit:
                    yield rows
                    continue
                columns = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
                texts = columns[text].to_pylist()
                sizes = columns[length].to_pylist() if length else None
                for i in hit:
                    raw, out, reach = texts[i].encode(), [], 0
                    for s in secrets[i]:
                        out += [raw[reach : s["start"]], MASK]
                        reach = s["end"]
                    texts[i] = b"".join([*out, raw[reach:]]).decode("utf-8", "replace")
                    if sizes and sizes[i] is not None:
                        sizes[i] = len(texts[i])
                columns[text] = pa.array(texts, columns[text].type)
                if sizes:
                    columns[length] = pa.array(sizes, columns[length].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def mask_secrets(docs: DataFrame, model: SecretModel | None = None, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each secret replaced by MASK, and the length column, where it is an integer column, set anew for such texts.

    All rows and all other columns stay as they are, whatever their names. Null and empty texts stay; repeated rows are
    masked alike; an empty table gives an empty one. One narrow pass.
    """
    own, name, back = apart(docs)
    whole = length_col in docs.columns and isinstance(docs.schema[length_col].dataType, T.IntegralType)
    return back(own.mapInArrow(_masked(name(text_col), name(length_col) if whole else None, model or train()), own.schema))


def secret_counts(docs: DataFrame, model: SecretModel | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_candidates, n_secrets and the secrets' spans as text (start-end, comma-joined) for every row.

    Null and empty texts have none, repeated rows each get a row, an empty table gives an empty one, only the two named
    columns are read.
    """
    found = scan_secrets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    spans = F.array_join(F.transform("secrets", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.select(F.col("id").alias(id_col), "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("secret_spans"))
