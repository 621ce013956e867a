"""Base spans against Python's regular expressions, discovery, and redaction."""

import hashlib
import random
import re
import time

import pytest

from sentigrade.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(match):
    return re.sub("[^0-9]", "", match)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def base(text):
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if f(m[0])] for k, p, f in PATTERNS]
    joined = ",".join(s for group in spans for s in group)
    return (*map(len, spans), hashlib.sha256(joined.encode()).hexdigest()), joined


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["1", "2", "255", "256", ".", ".", "@", "a", "b.c", "+", "+1", " ", "-", "(", ")", "4111 1111 1111 1111", "é", "日", "\n",
             "%", "_", "0", "000", "1.2.3.4", "x@y.zz", "+1 (555) 123-4567", "5", "🎉", "4111-1111-1111-1111", "a@b.c_d@e.f"]
    made = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(1500)]
    made += [(None, None), (None, ""), (7, None), (9000, "1" * 300 + " " + "9 " * 500), (9001, "a." * 3000 + "@" + "b." * 500 + "c"),
             (9002, "x" * 100_000), (9003, "1." * 20_000), (9004, "+" + "1 " * 3000), (9005, "a@" * 3000), (9006, "1 2.3.4.5 " * 300)]
    return made


def test_base_spans(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", pii.F.lit("x")).repartition(4)
    got = pii.report(pii.with_spans(df)).collect()
    found = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr)
    assert found == sorted(((k, *base(t)[0]) for k, t in rows), key=repr)
    texts = {k: t for k, t in rows if k is not None and k >= 9000}
    for r in got:
        if r.doc_id in texts:
            assert set(filter(None, base(texts[r.doc_id])[1].split(","))) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def letters(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        number = f"41111111111{rng.randrange(10**4):04d}"
        number += next(c for c in "0123456789" if luhn(number + c))
        rows.append((k, f"so wire it to accountnumber {number[:4]} {number[4:8]} {number[8:12]} {number[12:]}, thanks again"))
    # No Luhn number, no base span: only the context tells.
    rows += [(100 + k, f"Bonjour, accountnumber 9999 8888 7777 {1 + k:04d}. thanks") for k in range(3)]
    rows += [(200 + k, f"page {k} of {k * 17} on 2024-01-{1 + k:02d} costs 9999 8888 7777 6666 points") for k in range(20)]
    rows += [(300, "nothing to see here"), (301, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_discover_what_no_pattern_finds(letters):
    got = {r.doc_id: r for r in pii.report(pii.with_spans(letters)).collect()}
    assert all(got[k].n_card == 1 and got[k].n_discovered == 0 for k in range(60))
    for k in range(3):
        if not luhn(f"999988887777{1 + k:04d}"):
            assert got[100 + k].spans == "card:23:42" and got[100 + k].n_card == 0 and got[100 + k].n_discovered == 1
    assert all(not got[k].spans for k in (*range(200, 220), 300, 301))
    assert not any(r.n_discovered for r in pii.report(pii.with_spans(letters, min_support=1000)).collect())


def test_redaction(spark, letters):
    extra = spark.createDataFrame(
        [(400, "é🎉 me@x.org, +1 (555) 123-4567 and 1.2.3.4!"), (400, "é🎉 me@x.org, +1 (555) 123-4567 and 1.2.3.4!"), (None, "10.0.0.1"), (401, "")],
        "doc_id long, text string",
    )
    df = letters.unionByName(extra).withColumn("_all", pii.F.lit(3))
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert texts.count((400, "é🎉 [EMAIL], [PHONE] and [IP]!")) == 2 and (None, "[IP]") in texts
    assert (301, None) in texts and (300, "nothing to see here") in texts and (401, "") in texts
    assert (0, "so wire it to accountnumber [CARD], thanks again") in texts
    assert pii.redact(df.limit(0)).count() == 0 and pii.with_spans(df.limit(0)).count() == 0


def test_identifiers_beside_other_words_with_digits(spark):
    rows = [(k, f"reach me by telefon +49 30 55{k:05d} in the morning") for k in range(40)]
    texts = [
        "mail bob@x.org, telefon 5551234567 in the morning",
        "write bob@x.org, 5559876543 in the morning",
        "my telefon 0301234567 10115 Berlin",
        "my telefon A0301234567 0307654321 in the morning",
        "telefon 5551112222, 5553334444 in the morning",
    ]
    df = spark.createDataFrame(rows + [(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[100] == "mail [EMAIL], telefon [PHONE] in the morning"
    assert out[101] == "write [EMAIL], [PHONE] in the morning"
    assert "0301234567" not in out[102] and out[102].startswith("my telefon [PHONE]")
    assert "0307654321" not in out[103] and "A0301234567" in out[103]
    assert out[104] == "telefon [PHONE], [PHONE] in the morning"


def test_no_python_on_the_main_path(letters):
    plan = pii.report(pii.with_spans(letters))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_running_results_in_pieces(spark):
    F = pii.F
    rows = [([],), ([4],), ([3, 1, 2],), (list(range(50)),), (None,)]
    df = spark.createDataFrame(rows, "a array<int>")
    for items in (1, 2, 7, 256):
        sums = pii.running(df, "a", "s", lambda x, y: x + y, F.lit(0), items)
        most = pii.running(sums, "a", "m", F.greatest, F.lit(-1), items).collect()
        for r in most:
            want = [sum(r.a[: k + 1]) for k in range(len(r.a))] if r.a else r.a
            assert r.s == want and r.m == ([max(r.a[: k + 1]) for k in range(len(r.a))] if r.a else r.a)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    texts = ["mail bob@example.org or +1 (555) 123-4567, 10.0.0.1 now", "é🎉" * 9 + " me@x.org", "4111 1111 1111 1111", "x" * 50, "1.2.3.4,5.6.7.8"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == [
        "mail [EMAIL] or [PHONE], [IP] now", "é🎉" * 9 + " [EMAIL]", "[CARD]", "x" * 50, "[IP],[IP]"]
    got = {r.doc_id: r for r in pii.report(pii.with_spans(df)).collect()}
    assert all((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == base(texts[k])[0] for k, r in got.items())


def test_a_text_of_many_spans_takes_time_in_proportion(spark):
    text = " ".join(f"+1 555 {k:07d}" for k in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "1 " * 30_000)], "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r for r in pii.report(pii.with_spans(df)).collect()}
    assert time.time() - begun < 60
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone, got[1].base_sha256) == base(text)[0]
    assert pii.redact(df.where("doc_id = 1")).first().text == " ".join(["[PHONE]"] * 100_000)
