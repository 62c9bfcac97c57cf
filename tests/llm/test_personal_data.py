"""Personal data: base spans against a plain scan, added spans on planted forms, odd rows."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factorspark.llm import personal_data
from factorspark.llm.boosting import boost, sigmoid_fit

FOLDER = "/root/testdata/sf0.01"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_base(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            holds = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                     "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                     "phone": 9 <= len(digits) <= 15}[kind]
            if holds:
                found.append((m.start(), order, m.end()))
    return sorted(found)


def written(spans):
    return ",".join(f"{personal_data.KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


@pytest.fixture(scope="module")
def judge(spark):
    return personal_data.fitted(spark.read.parquet(f"{FOLDER}/documents.parquet"))


@given(st.text("01259 -.+()@aZ_é٣,", max_size=80))
@settings(max_examples=600, deadline=None)
def test_base_spans_equal_the_plain_patterns(text):
    assert personal_data.base_spans(text) == plain_base(text)


def test_report_of_the_documents(spark, judge):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    report = personal_data.report(docs, judge).collect()
    assert {r["doc_id"] for r in report} == set(texts) and len(report) == len(texts)
    for r in report:
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in personal_data.BASE] == [sum(b[1] == i for b in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(written(base).split(",")) <= set(r["spans"].split(","))
    clean = [r for r in report if not plain_base(texts[r["doc_id"]])]
    assert sum(r["n_added"] for r in clean) <= 0.002 * len(clean)


@pytest.mark.parametrize("text, kind, shown", [
    ("Words here and john.doe [at] mail [dot] example [dot] com then others", "email_like", "john.doe [at] mail [dot] example [dot] com"),
    ("The ran 10[.]0[.]0[.]7 of and", "ip_like", "10[.]0[.]0[.]7"),
    ("Then shown 4111.1111.1111.1111 of the", "card_like", "4111.1111.1111.1111"),
    ("Then (415) 555-0132 of the", "phone_like", "(415) 555-0132"),
    ("and DE89 3704 0044 0532 0130 00 then", "id_like", "DE89 3704 0044 0532 0130 00"),
    ("one 7536784127813050 4845168114407329 two", "card_like", "7536784127813050"),
])
def test_other_forms_are_added(judge, text, kind, shown):
    base, found = personal_data.spans_of(text, judge)
    assert (kind, shown) in [(personal_data.KINDS[k], text[s:e]) for s, k, e in found if (s, k, e) not in base]


@pytest.mark.parametrize("text", [
    "On 2020-01-15 12:30 and 12.05.2021 the total was 1,234,567.00 of version 3.2.1", "We met at home. The end at noon.",
    "The number 4111.1111.1111.1112 fails its check", "isbn 978-3-16-148410-0 on page 12-13-14", "", "a b c", "at . dot @ +",
])
def test_other_numbers_are_left_alone(judge, text):
    assert personal_data.spans_of(text, judge)[1] == plain_base(text)


def test_odd_rows(spark, judge):
    rows = [(1, None), (None, "mail a@b.cd"), (2, ""), (2, "\U0001F511 ip 1.2.3.4, 1.2.3.4"), (2, "\U0001F511 ip 1.2.3.4, 1.2.3.4"), (3, "x@y" + " 1" * 50_000 + "9" * 100_000 + "a" * 100_000)]
    docs = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "doc_id long, text string, spans string, id int")
    got = sorted((r["doc_id"] or 0, r["spans"], r["n_email"], r["n_ip"]) for r in personal_data.report(docs, judge).collect())
    assert got == [(0, "email:5:11", 1, 0), (1, "", 0, 0), (2, "", 0, 0), (2, "ip:5:12,ip:14:21", 0, 2), (2, "ip:5:12,ip:14:21", 0, 2), (3, "", 0, 0)]
    cleaned = personal_data.redact(docs, judge)
    assert cleaned.columns == docs.columns
    assert {r["text"] for r in cleaned.where("doc_id IS NULL OR doc_id < 3").collect()} == {None, "mail [EMAIL]", "", "\U0001F511 ip [IP], [IP]"}
    empty = docs.limit(0)
    assert personal_data.report(empty, personal_data.fitted(empty)).count() == 0


@pytest.mark.parametrize("piece", ["1", "a", "1 ", "a@", "1.2.", "+1 ", "(1) ", " at ", "A1", "12-", "a.b@c-"])
def test_time_follows_the_length(judge, piece):
    started = time.perf_counter()
    personal_data.spans_of(piece * (200_000 // len(piece)), judge)
    assert time.perf_counter() - started < 20


def test_overlapping_spans_are_one_mask():
    assert personal_data.redacted("abcdefghij", [(1, 0, 4), (3, 2, 6), (8, 1, 9)]) == "a[EMAIL]gh[IP]j"[:8] + "gh[IP]j"


def test_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(4000, 5))
    label = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    label = np.where(rng.random(4000) < 0.1, 1 - label, label)
    trees = boost(rows[:2000], label[:2000], np.ones(2000))
    margin = trees.margin(rows[2000:])
    assert ((margin > 0) == label[2000:]).mean() > 0.86
    a, b = sigmoid_fit(margin[:1000], label[2000:3000], np.ones(1000))
    chance = 1 / (1 + np.exp(-(a * margin[1000:] + b)))
    assert abs(chance.mean() - label[3000:].mean()) < 0.05
    sure = chance > 0.8
    assert abs(chance[sure].mean() - label[3000:][sure].mean()) < 0.06
