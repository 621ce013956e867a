"""URL filter: longest fitting host rule first, then a weighted vocabulary of URL terms.

Host, path and rules are column expressions.  The vocabulary is one Aho-Corasick automaton a task
builds once; it counts terms in everything behind ``://``, lower-cased.  A hit counts only between
boundaries, that is where no ASCII letter or digit touches it.  One strict term, or ``min_soft``
different soft terms, reject the URL.

Null URLs and URLs without ``://`` have an empty host and path, no rule and no hits: they are allowed.
Repeated rows are judged alike; other columns stay as they are, and columns named like a result are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
STRICT = (
    "casino", "casinos", "cialis", "escort", "escorts", "hentai", "malware", "nude", "nudes", "phishing", "pills",
    "porn", "porno", "pornography", "scam", "sex", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "adult", "bet", "betting", "bingo", "bonus", "cheap", "click", "coupon", "crack", "cracked", "dating", "deal",
    "deals", "discount", "download", "farm", "free", "gamble", "gambling", "hack", "hot", "jackpot", "keygen", "loan",
    "loans", "lottery", "meds", "offer", "offers", "pharma", "pharmacy", "pill", "poker", "prize", "promo", "serial",
    "slot", "slots", "torrent", "torrents", "win", "winner", "xx",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(_LOWER + "0123456789")


def behind_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    start = F.instr(url, "://")
    return F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(behind_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column, pick) -> Column:
    """``pick(rule)`` of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    return F.coalesce(*(F.when(fits(r, host, path), F.lit(pick(r))) for r in ordered), F.lit(None).cast("string"))


def build_automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for weight, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            automaton.add_word(term, (weight, term))
    automaton.make_automaton()
    return automaton


def count_hits(automaton: ahocorasick.Automaton, text: str) -> tuple[int, int, int]:
    """Strict hits, soft hits, different soft terms of a lower-cased text."""
    strict = soft = 0
    seen = set()
    for last, (weight, term) in automaton.iter(text):
        first = last - len(term) + 1
        if (first and text[first - 1] in _WORD) or (last + 1 < len(text) and text[last + 1] in _WORD):
            continue
        if weight == "strict":
            strict += 1
        else:
            soft += 1
            seen.add(term)
    return strict, soft, len(seen)


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """An Arrow-batched function of lower-cased texts; every different text of a batch is read once."""
    kept: list[ahocorasick.Automaton] = []

    @F.pandas_udf("strict_hits long, soft_hits long, soft_terms long")
    def hits(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(build_automaton(strict, soft))
        codes, different = pd.factorize(texts)
        counts = [count_hits(kept[0], t) for t in different]
        frame = pd.DataFrame(counts, columns=["strict_hits", "soft_hits", "soft_terms"], dtype="int64")
        return frame.take(codes).reset_index(drop=True)

    return hits


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    min_soft: int = 2,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the hit counts."""
    hits = vocabulary_hits(tuple(strict), tuple(soft))
    address = pages[url]
    rest = F.translate(behind_scheme(address), _UPPER, _LOWER)
    found = pages.withColumns({"host": host_of(address), "path": path_of(address), "_hits": hits(rest)})
    host, path = F.col("host"), F.col("path")
    rejected = (F.col("_hits.strict_hits") >= 1) | (F.col("_hits.soft_terms") >= min_soft)
    return found.withColumns(
        {
            "rule": longest_rule(rules, host, path, lambda r: r.text),
            "verdict": F.coalesce(
                longest_rule(rules, host, path, lambda r: r.verdict),
                F.when(rejected, "block").otherwise("allow"),
            ),
            "strict_hits": F.col("_hits.strict_hits"),
            "soft_hits": F.col("_hits.soft_hits"),
            "soft_terms": F.col("_hits.soft_terms"),
        }
    ).drop("_hits")
