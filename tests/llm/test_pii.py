"""Operator 6: base spans against Python's regular expressions, added spans and redaction by example."""

from __future__ import annotations

import hashlib
import re

import pytest

from planweft.llm import pii, pii_examples

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


TEXTS = [
    None, "", "nothing here", "a@b.c x@1.2.3.4 me.you+z@ex-am.ple.org.", "x@a.b_foo@c.d@e.f", "..@..a@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.2 1.2.3", "é中😀 10.0.0.1 ü",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 5500005555555559", "+1 (456) 555-2186 +12 +123456789 +1-2-3-4-5-6-7-8-9-0 1234567890123456789012",
    "12 345 6789 0123 4567 89 +49 (0) 30.123 456", "@" * 50, "9" * 20_000, "a." * 20_000 + "@", "x@" + "a." * 20_000 + "b", "1 " * 6000, "1.1.1.1 " * 400, "+" * 300 + "1 23456789",
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark, rows=1500)


def test_base_spans(spark, model):
    df = spark.createDataFrame([(i, t, "kind", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, kind string, s int")
    for r in pii.personal_data(df, model).collect():
        text = TEXTS[r.doc_id] or ""
        spans = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PLAIN], text[:80]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text[:80]
        assert r.spans.startswith(listed)


def test_added_spans(spark, model):
    texts = {
        "call (212) 555-0199 now": "number", "ssn 123-45-6789 ok": "number", 'here token = "b44e15aa91ab85687d33eeaaf9ac699e1188f962" yes': "secret",
        "order 123-45-6789 ok": None, "key = paragraph of": None, "password: required for": None, "write to anna [at] example [dot] org soon": "address",
        "host 2001:db8:0:0:1:2:3:4 up": "device", "ship to 12 Linden Avenue now": "address", "born on 12.03.1985 there": "number", "published 12.03.1985 there": None, "ask Dr. Clara Weber today": "person",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.personal_data(df, model).collect()}
    assert {t: (found[i].split(":")[0] or None) for i, t in enumerate(texts)} == texts


def test_redaction(spark, model):
    df = spark.createDataFrame([(1, "mail é a@b.c or +1 (456) 555-2186, 10.0.0.1!", 1), (2, None, 2), (3, "clean text", 3)], "doc_id long, text string, e int")
    out = {r.doc_id: r for r in pii.redact(df, model).collect()}
    assert out[1].text == "mail é [EMAIL] or [PHONE], [IP]!" and out[2].text is None and out[3].text == "clean text" and out[1].e == 1


def test_no_rows_and_null_ids(spark, model):
    df = spark.createDataFrame([(None, "a@b.c")], "doc_id long, text string")
    assert pii.personal_data(df, model).collect()[0].n_email == 1
    assert pii.personal_data(df.limit(0), model).collect() == []


def test_running_sums(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 1000), x -> cast(x % 7 AS bigint)) AS a", "cast(array() AS array<bigint>) AS e")
    r = df.selectExpr(f"{pii.running_sums('a')} AS s", f"{pii.running_sums('e')} AS n").collect()[0]
    total, wanted = 0, []
    for x in range(1, 1001):
        total += x % 7
        wanted.append(total)
    assert list(r.s) == wanted and list(r.n) == []


def test_plan_is_native(spark, model):
    text = pii.personal_data(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", text)


def test_sentences_of_other_forms(spark, model):
    """Forms that training has not seen: precision and recall."""
    made = pii.made_up(spark, pii_examples.HELD_OUT, 1040, seed=77).withColumnRenamed("id", "doc_id")
    found = {r.doc_id: r.n_spans > 0 for r in pii.personal_data(made, model).collect()}
    private = {r.doc_id: r.private for r in made.collect()}
    caught = sum(private[i] and found[i] for i in found)
    assert caught / sum(private.values()) >= 0.95 and caught / sum(found.values()) >= 0.95


def test_redaction_grows_with_the_text(spark, model):
    """16,000 spans in one text, and four times that in no more than twice four times the time."""
    import time

    took = []
    for n in (16_000, 64_000):
        df = spark.createDataFrame([(1, "x@y.z 10.0.0.1 é " * n)], "doc_id long, text string")
        pii.redact(df, model).collect()
        start = time.time()
        text = pii.redact(df, model).collect()[0].text
        took.append(time.time() - start)
        assert text == "[EMAIL] [IP] é " * n
    assert took[0] < 3 and took[1] < 8 * took[0]


def test_redaction_by_brute_force(spark, model):
    import random

    r = random.Random(3)
    bits = ["a@b.c", "+1 (456) 555-2186", "10.0.0.1", "4111 1111 1111 1111", "é", "😀", " ", "word ", "\n", "call 212-555-0199 ", "1" * 16, "token=abcdef0123456789", "x" * 300]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {x.doc_id: x.text for x in pii.redact(df, model).collect()}
    for x in pii.personal_data(df, model).collect():
        text, spans = dict(rows)[x.doc_id], sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in x.spans.split(",") if s))
        out, at = "", 0
        for i, (a, b, kind) in enumerate(spans):
            if i and a < at:
                at = max(at, b)
                continue
            out, at = out + text[at:a] + f"[{kind.upper()}]", b
        assert clean[x.doc_id] == out + text[at:]


def test_repeated_rows_count_each(spark, model):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (1, None)], "doc_id long, text string")
    assert sorted(r.n_email for r in pii.personal_data(df, model).collect()) == [0, 1, 1]
    assert sorted(r.text or "" for r in pii.redact(df, model).collect()) == ["", "[EMAIL]", "[EMAIL]"]
