"""URL rules and vocabulary against a plain reading of the contract."""

import re

import pytest

from sentigrade.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1", "http://example.org/en/1", "http://example.org/en/12?x=/es/",
    "http://notexample.org/es/", "http://x.com/fr/a", "http://com/de/", "http://x.com/de", "http://x.org", "http://x.org/",
    "http://x.org?casino", "ftp://casino.net/", "http://casinos-win.net", "http://mycasino.net", "http://cheap.net/win",
    "http://cheap-cheap.net/cheap", "http://xxx.net", "http://a.net/é-porn-日", "http://a.net://b.org/", "http://x.org#/es/",
    "://y.org/", "HTTP://CASINO.NET/", "http://a.net/" + "x" * 50_000 + "/porn", "http://u@x.org:80/a", "http://free.net/free_win",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest)
    fit = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    words = set(re.split("[^a-z0-9]+", rest))
    if fit:
        best = max(fit, key=lambda r: len(r.text))
        return host, path, best.text, best.verdict
    return host, path, None, "block" if words & set(uf.STRICT) or len(words & set(uf.SOFT)) >= 2 else "allow"


def test_verdicts(spark):
    rows = [(k, url) for k, url in enumerate(URLS + URLS[4:8])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(df).collect()}
    assert got == {k: judged(url) for k, url in rows}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("http://casino.net", "mine", 7)], "url string, host string, extra int")
    row = uf.judge_urls(df).first()
    assert (row.host, row.verdict, row.extra) == ("casino.net", "block", 7)
    assert uf.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, hits", [("casino", (1, 0, 0)), ("casinox", (0, 0, 0)), ("win-win", (0, 2, 1)), ("free win", (0, 2, 2)), ("", (0, 0, 0))])
def test_boundaries(text, hits):
    assert uf.count_hits(uf.build_automaton(uf.STRICT, uf.SOFT), text) == hits
