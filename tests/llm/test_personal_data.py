"""Personal data against the literal patterns, and what checksums and words nearby add."""

from __future__ import annotations

import random
import re
import time

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from panelwright.llm import personal_data

from .texts import SCHEMA, documents

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        twice = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
        return 16 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(twice)) % 10 == 0
    return True


def brute(text):
    return [(kind, *m.span()) for kind, p in PATTERNS.items() for m in p.finditer(text) if valid(kind, m[0])]


def base(text):
    return [s[:3] for s in personal_data.found(text) if s[4]]


PIECES = ["a@b.c", "@", "x.y_z@d-e.f.g", "..", ".", "-", " ", "+1 (555) 010-9999", "+", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256", "007", "1", "é", "٣", "\n", "(", ")", "_", "%", "4111-1111-1111-1111 ", "GB82 WEST 1234 5698 7654 32", "0000000000000000"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@example("1.2.3.4.5.6.7.8.9")
@example("a@b.c_d@e.f")
@example("a@b.c@d.e")
@example("1.2.3.256.5.6.7.8")
@example("+1234567+12345678 (9")
@example("00000256.1.1.001")
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == brute(text)


def test_what_is_added():
    kinds = lambda text: [(k, text[a:b]) for k, a, b, _, own in personal_data.found(text) if not own]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 TODAY, not GB83 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("DE89370400440532013000.") == [("iban", "DE89370400440532013000")]
    assert kinds("ssn 123-45-6789; part 123-45-6780; social 666-45-6789") == [("national_id", "123-45-6789")]
    assert kinds("call (555) 010-9999 now") == [("local_phone", "(555) 010-9999")] and kinds("lot 555-010-9999 now") == []
    assert kinds("4111111111111111 4465758382889438") == [("card", "4111111111111111")]
    assert kinds("amex 3782 822463 10005") == [("card", "3782 822463 10005")] and kinds("3782 822463 10005") == []


def test_scores_follow_the_words_nearby():
    score = lambda text: personal_data.found(text)[0][3]
    assert score("visa 4111111111111111") > score("some 4111111111111111") > score("isbn 4111111111111111")
    assert score("x" * 60 + " visabc 4111111111111111") == score("some 4111111111111111")


def test_rows(spark):
    docs = spark.createDataFrame([(*d, "own") for d in documents()], T.StructType([*SCHEMA.fields, T.StructField("spans", T.StringType())])).repartition(3)
    found = personal_data.find_personal_data(docs).collect()
    assert len(found) == len(documents())
    assert all([(s.kind, s.start, s.end) for s in r.spans if s.base] == brute(r.text or "") for r in found)
    assert personal_data.find_personal_data(docs.limit(0)).count() == 0


def test_masks(spark):
    rows = [(1, "mail é a@b.c, 1.2.3.4 +1 (555) 010-9999", "s"), (2, None, "s"), (3, "", None), (4, "clean", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = personal_data.mask_personal_data(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "mail é [EMAIL], [IP] [PHONE]", "s"), (2, None, "s"), (3, "", None), (4, "clean", "s")]


def test_time_grows_with_the_text():
    rng = random.Random(1)
    n = 2_000_000
    for text in ("a" * n, "1" * n, "1." * (n // 2), "1 " * (n // 2), "a@" * (n // 2), "+1 " * (n // 3), "+1" + " (" * (n // 2), "".join(rng.choices("AB12 ", k=n)), "123-45-6789 ssn " * (n // 16), "a@b.c " * (n // 6)):
        began = time.perf_counter()
        personal_data.found(text)
        assert time.perf_counter() - began < 25, text[:20]
