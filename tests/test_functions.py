"""Column functions on edge rows, against plain Python."""

import re

from pyspark.sql import functions as F

from sentigrade.functions import lists, text, values

EDGE = [
    "a b\u0085c\u001cd　e", "<a\rb>x<c\nd>y", "www", "http", "Kelvin K", "x www.a.b y https://q z",
    "<<b>>c", "᠎a​b", "ÉÀ naïve-don't?!", "\x1f \x1e", "<a>b<", "w ww\u001cwwwx y", "",
]


def python_clean(t):
    t = re.sub(r"http\S+|www\S+|https\S+", "", t.lower())
    t = re.sub(r"[^a-zA-Z0-9\s.,!?'\-]", "", re.sub(r"<.*?>", "", t))
    return " ".join(t.split())


def test_clean_text_and_word_count_match_python(spark):
    df = spark.createDataFrame(list(enumerate(EDGE)) + [(99, None)], "i int, t string")
    rows = df.select("t", text.clean_text("t").alias("c"), text.word_count("t").alias("n")).collect()
    for row in rows:
        assert row.c == ("" if row.t is None else python_clean(row.t))
        assert row.n == (0 if row.t is None else len(row.t.split()))


def test_normalize_name_and_split_field(spark):
    df = spark.createDataFrame([(" The  Game: II! ", " a | |b|", None)], "n string, l string, e string")
    row = df.select(
        text.normalize_name("n"), text.split_field("l", "|"), text.split_field("e", ",")
    ).first()
    assert list(row) == ["the game ii", ["a", "b"], []]


def test_parse_range(spark):
    given = ["1,000 .. 2,000", "0", "", None, "500", "soon", "0 .. 20,000"]
    df = spark.createDataFrame([(g,) for g in given], "t string")
    found = [tuple(r[0]) for r in df.select(values.parse_range("t")).collect()]
    none = (None, None)
    assert found == [(1000, 2000), none, none, none, (500, 500), none, (0, 20000)]


def test_revenue_tiers_and_prices(spark):
    given = [(None, 1.0), (0, 1.0), (10, None), (10, 0.0), (1, 4000.0), (10**4, 10.0), (10**6, 10.0)]
    df = spark.createDataFrame(given, "n bigint, p double")
    revenue = values.estimated_revenue("n", "p")
    rows = df.select(revenue.alias("r"), values.success_tier(revenue).alias("t"), values.price_tier("p").alias("k"))
    assert [tuple(r) for r in rows.collect()] == [
        (None, None, 1), (None, None, 1), (None, None, None), (0.0, "Flop", 0),
        (120000.0, "Moderate", 4), (3e6, "Hit", 2), (3e8, "Blockbuster", 2),
    ]


def test_dates_and_order(spark):
    df = spark.createDataFrame(
        [("Sep 10, 2024",), ("10 Sep, 2024",), ("2024-09-10",), ("Coming soon",), ("",), (None,)], "d string"
    )
    days = [str(r[0]) for r in df.select(values.parse_date("d")).collect()]
    assert days == ["2024-09-10"] * 3 + ["None"] * 3
    pairs = [
        ("2024-01-01", "2024-01-02", True), ("2024-01-02T00:00:01+00:00", "2024-01-02", False),
        ("x", "2024-01-02", None), (None, "2024-01-02", None), ("2024-01-01", "", None),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    for row in df.select(values.is_before_release("a", "b").alias("got"), "want").collect():
        assert row.got == row.want


def test_sets_and_flags(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a", "a"]), ([], []), (["a"], ["a", "c"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(lists.same_set("x", "y")).collect()] == [True, False, False]
    flags = lists.flag_columns("x", ("Co-op", "Open World", "a"), "tag_")
    assert list(flags) == ["tag_co_op", "tag_open_world", "tag_a"]
    assert [r.tag_a for r in df.withColumns(flags).collect()] == [1, 0, 1]


def test_labels(spark):
    df = spark.createDataFrame([(0.05, 0.0005), (-0.3, 0.04), (-0.6, 0.04), (0.6, 0.5), (None, None)], "r double, p double")
    rows = df.select(values.effect_size("r"), values.stars("p"), values.verdict("r", "p")).collect()
    assert [tuple(r) for r in rows] == [
        ("Negligible", "***", "PARTIALLY SUPPORTED"), ("Medium", "*", "PARTIALLY SUPPORTED"),
        ("Large", "*", "SUPPORTED"), ("Large", "", "NOT SUPPORTED"), (None, "", "NOT SUPPORTED"),
    ]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert df.select(F.sum(values.null_if_nan("x"))).first()[0] == 1.0
