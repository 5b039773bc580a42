"""Precision and recall on planted secrets and look-alikes whose forms the training findings don't have."""

from __future__ import annotations

import base64
import random
import string
import time
import uuid

import pyarrow as pa
import pytest

from panelwright.llm import secret_scan
from panelwright.llm import textops as X

from .texts import prose

ALNUM = string.ascii_letters + string.digits
HEX = "0123456789abcdef"


def planted(rng: random.Random) -> list[tuple[str, str]]:
    """(text around {}, secret)."""
    some = lambda chars, k: "".join(rng.choices(chars, k=k))
    b64 = lambda k: base64.urlsafe_b64encode(rng.randbytes(k)).decode().rstrip("=")
    return [
        ('curl -H "X-Api-Key: {}" https://h', some(ALNUM, 32)), ("export STRIPE_SECRET='{}'", "sk_test_" + some(ALNUM, 24)), ("google key {} leaked", "AIza" + some(ALNUM + "_-", 35)),
        ("SENDGRID={} # mail", f"SG.{b64(16)}.{b64(32)}"), ("npm token {}", "npm_" + some(ALNUM, 36)), ("hook https://hooks.slack.com {}", "xoxp-" + some(string.digits, 12) + "-" + some(ALNUM, 24)),
        ('{{"client_secret": "{}"}}', "GOCSPX-" + some(ALNUM, 28)), ("mysql://root:{}@db.local/x", some(ALNUM + "!%", 12)), ("amqp://guest:{}@mq:5672", some(ALNUM, 9)),
        ("DB_PASSWORD={}", some(ALNUM + "#!", 14)), ("password: {}", some(string.ascii_lowercase, 3) + some(string.digits, 3) + "!" + some(string.ascii_uppercase, 3)), ("user admin pwd = '{}'", some(ALNUM + "@$", 11)),
        ("Authorization: Bearer {}", f"eyJ{b64(20)}.{b64(60)}.{b64(32)}"), ("aws_secret_access_key = {}", base64.b64encode(rng.randbytes(30)).decode()), ("id {} here", "AKIA" + some(string.ascii_uppercase + "234567", 16)),
        ("auth_token: \"{}\"", some(HEX, 40)), ("access_token={}&x=1", some(ALNUM, 48)), ("the secret is secret = {}", some(string.ascii_letters, 24)), ("passphrase: '{}'", some(ALNUM + "_", 20)), ("token := \"{}\"", "glpat-" + some(ALNUM, 20)),
    ]


def look_alikes(rng: random.Random) -> list[str]:
    some = lambda chars, k: "".join(rng.choices(chars, k=k))
    words = lambda k: [rng.choice("river stone garden window market letter summer winter travel corner silver forest".split()) for _ in range(k)]
    return [
        f"merged in commit {some(HEX, 40)} today", f"sha256:{some(HEX, 64)} is the image digest", f"session {uuid.UUID(int=rng.getrandbits(128))} ended", f"checksum = {some(HEX, 32)}", f"isbn {some(string.digits, 13)} order {some(string.digits, 17)}",
        f"{words(1)[0]}.{some(string.digits, 2)}@mail{some(string.digits, 1)}.example.com", f"https://www.{words(1)[0]}.org/{'/'.join(words(3))}/index{some(string.digits, 3)}.html", f"call {'_'.join(words(4))}_{some(string.digits, 2)}()", f"{''.join(w.capitalize() for w in words(4))}Factory.create",
        f"the {'-'.join(words(4))}-2024 edition", f"password: {' '.join(words(2))} is asked for", f"token = get_{'_'.join(words(2))}()", 'api_key = "YOUR_API_KEY_HERE"', 'password = "xxxxxxxxxxxx"', f"/usr/share/{'/'.join(words(3))}/lib{words(1)[0]}.so.1.2.{some(string.digits, 1)}",
        f"2024-01-{some('12', 1)}{some('012345', 1)}T10:20:30.{some(string.digits, 6)}Z", f"phone +49-{some(string.digits, 3)}-{some(string.digits, 8)}", f"{'_'.join(w.upper() for w in words(4))} = 3", f"see {'.'.join(words(5))}", f"data:image/png;base64,{base64.b64encode(rng.randbytes(60)).decode()}",
    ]


@pytest.mark.parametrize("words", [(), ("river", "stone", "garden", "window")])
def test_precision_and_recall(words):
    rng = random.Random(77)
    model = secret_scan.train(words=words)
    found = total = wrong = clean = 0
    missed = []
    for _ in range(15):
        around = [(f"{prose(rng, 15)}\n{form.format(secret)}\n{prose(rng, 15)}", secret) for form, secret in planted(rng)]
        _, secrets = secret_scan.judged(next(X.slices(pa.array([t for t, _ in around]))), model)
        for (text, secret), got in zip(around, secrets, strict=True):
            at = text.encode().index(secret.encode())
            hit = any(s["start"] <= at and s["end"] >= at + len(secret.encode()) - 2 for s in got)
            found, total = found + hit, total + 1
            missed += [] if hit else [text.split("\n")[-2][:60]]
        texts = [f"{prose(rng, 15)}\n{t}\n{prose(rng, 15)}" for t in look_alikes(rng)]
        _, secrets = secret_scan.judged(next(X.slices(pa.array(texts))), model)
        wrong += sum(bool(s) for s in secrets)
        clean += len(texts)
    assert found / total >= 0.9, (found / total, missed[:20])
    assert found / (found + wrong) >= 0.9, (wrong, clean)


def test_words_of_the_corpus(spark):
    docs = spark.createDataFrame([("alpha beta Alpha x1alpha",), ("alpha gamma",), ("ALPHA gamma beta",), (None,), ("",)], "text string").repartition(3)
    assert secret_scan.corpus_words(docs, least=2) == ["alpha", "beta", "gamma"]
    assert secret_scan.corpus_words(docs, least=1, size=1) == ["alpha"] and secret_scan.corpus_words(docs.limit(0)) == []


def spans(text, model=None):
    _, found = secret_scan.judged(next(X.slices(pa.array([text]))), model or secret_scan.train())
    return [text.encode()[s["start"] : s["end"]].decode() for s in found[0]]


@pytest.mark.parametrize("text", ["token=" * 900_000, "password: " * 500_000, "token='" * 700_000, "://a" * 1_200_000, "://" + "u" * 5_000_000, "secret = \"" * 500_000, "=" * 5_000_000])
def test_five_megabytes_in_seconds(text):
    model = secret_scan.train(trees=3)
    began = time.perf_counter()
    secret_scan.judged(next(X.slices(pa.array([text]))), model)
    assert time.perf_counter() - began < 30


def test_long_user_names_and_quoted_phrases_are_masked_whole():
    model = secret_scan.train()
    assert spans(f"see postgres://{'u' * 300}:xK9$wq72Lm@db.host/x now", model) == ["xK9$wq72Lm"]
    assert spans("set password='correct horse battery staple' then", model) == ["correct horse battery staple"]
    assert spans('passphrase = "orbit lantern velvet 92 thunder"', model) == ["orbit lantern velvet 92 thunder"]
    assert spans('password = "enter your password here"; token: "please insert a token"', model) == []


def test_part_of_a_step_of_words(spark):
    docs = spark.createDataFrame([("alpha beta gamma delta epsilon zeta",)] * 5, "text string")
    assert len(secret_scan.corpus_words(docs, size=6)) == 6
    five = secret_scan.corpus_words(docs, size=5)
    assert len(five) == 5 and five == secret_scan.corpus_words(docs.repartition(4), size=5)
    more = docs.union(spark.createDataFrame([("omega",)] * 40, "text string"))
    assert "omega" in secret_scan.corpus_words(more, size=3) and len(secret_scan.corpus_words(more, size=3)) == 3
