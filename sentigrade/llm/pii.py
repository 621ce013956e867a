"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

Base spans come from one regular expression for each kind (email, ip, card, phone) and a check of the
match; they are the seeds.  What is left of the text is cut into runs of words that hold a digit or an at
sign, and every sub-run of a run is an instance: no kind looks like more than ``MOST_WORDS`` such words.
The contexts of an instance are lexical patterns: left word, right word, and both; a base span next to
it counts as one word, whatever it holds.  In every round patterns and instances score each other over
the graph of patterns and sites.  A site is a place where a pattern stands: for a left word what follows
it in the run, for a right word what comes before it, for both what is between them.  A pattern's
confidence in a kind is the share of its sites with an instance of that kind, weighted by the best
instance's score; an instance that looks like the kind scores the noisy-or of its confident patterns.
Instances above ``min_score`` join the seeds; after ``rounds`` rounds all occurrences outside base spans
become spans, except inside a longer one.

Everything is a DataFrame expression.  Counts are formed before the shuffles; a context that a third of
all rows share is one row in the joins, and joins of occurrences are split by adaptive execution.

Null texts count as empty and have no spans.  Rows are known by key and hash of the text: repeated rows
get the same spans, null keys are keys like others.  Key and text are read by name, so further columns and their
names don't matter; an empty table gives no rows.  The cost of a text is in proportion to its length and spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Kind:
    """``trigger`` is a cheap test whether a text can hold a match; ``looks`` that of a discovered instance."""

    name: str
    trigger: Callable[[Column], Column]
    pattern: str
    check: str  # SQL of a match ``m``
    looks: str


# The patterns match what the plain ones match; possessive repeats and look-behinds only save the search
# from starting again inside a run that has failed.
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + CASE
    WHEN (length({_DIGITS}) - i) % 2 = 0 THEN cast(substr({_DIGITS}, i, 1) AS int)
    ELSE cast(substr({_DIGITS}, i, 1) AS int) * 2 - CASE WHEN substr({_DIGITS}, i, 1) > '4' THEN 9 ELSE 0 END
    END) % 10 = 0"""
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

KINDS = (
    Kind(
        "email",
        lambda text: text.contains("@"),
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        rf"^[^@{_SPACE}]+\x20?@\x20?[^@{_SPACE}]+$",
    ),
    Kind(
        "ip",
        lambda text: text.rlike(r"[0-9]\.[0-9]"),
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        rf"m rlike r'^{_OCTET}(\.{_OCTET}){{3}}$'",
        r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}$",
    ),
    Kind(
        "card",
        lambda text: text.rlike(r"[0-9][\x20-]?[0-9]"),
        r"[0-9](?:[\x20-]?[0-9])++",
        f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
        r"^[0-9]([ -]?[0-9]){12,18}$",
    ),
    Kind(
        "phone",
        lambda text: text.contains("+"),
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({_DIGITS}) BETWEEN 8 AND 15",
        r"^\+?[0-9(]([ ().-]{0,2}[0-9]){6,14}$",
    ),
)
NAMES = tuple(kind.name for kind in KINDS)

#: Stands in for the characters of base spans; the same character of a text is read as ``_OTHER``.
_MASK, _OTHER = "\uffff", "\ufffe"
_BREAK = rf"{_SPACE}{_MASK}"
CANDIDATE = rf"{_MASK}++|(?<![^{_BREAK}])[^{_BREAK}]*[0-9@][^{_BREAK}]*(?:\x20[^{_BREAK}]*[0-9][^{_BREAK}]*)*+"
#: A card has up to 19 digits, and every word but the first of a run holds one.
MOST_WORDS = 19
_OPENING, _CLOSING = r"^[\x22'(\[{<|,;:]*", r"[\x22')\]}>|.,;:!?#%&*$]*$"

#: Elements of an array, and letters of a text, that are built up at a time.
SCAN_ITEMS, PIECE = 256, 16_384


def _pieces(text: Column, pattern: str, trigger: Column) -> tuple[Column, Column]:
    """What stands between the matches, and the matches."""
    none = F.array().cast("array<string>")
    return (
        F.when(trigger, F.split(text, pattern, -1)).otherwise(none),
        F.when(trigger, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
    )


def running(
    rows: DataFrame, source: str, out: str, merge: Callable[[Column, Column], Column], zero: Column, items: int = SCAN_ITEMS
) -> DataFrame:
    """``rows`` with ``out``, what ``merge`` makes of every element of the array ``source`` and those before it.

    Arrays grow by copying, so they are built in pieces of ``items`` elements and each piece is shifted by
    what the pieces before it add up to: the cost is in proportion to the array.
    """

    def grown(elements: Column, first: Column) -> Column:
        return F.aggregate(elements, first, lambda made, x: F.concat(made, F.array(merge(F.element_at(made, -1), x))))

    size = F.size(source)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / items).cast("int")), lambda j: F.slice(source, j * items + 1, items))
    scans = F.transform(pieces, lambda piece: grown(F.slice(piece, 2, items), F.slice(piece, 1, 1)))
    rows = rows.withColumn("_scans", F.when(size > 0, scans))
    before = grown(F.transform(F.slice("_scans", F.lit(1), F.size("_scans") - 1), lambda scan: F.element_at(scan, -1)), F.array(zero))
    shifted = F.zip_with("_scans", before, lambda scan, last: F.transform(scan, lambda x: merge(last, x)))
    empty = F.slice(source, 1, 0)
    return rows.withColumn(out, F.when(F.col("_scans").isNotNull(), F.flatten(shifted)).otherwise(empty)).drop("_scans")


def _with_ends(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_ends``, where each of ``_matches`` ends, ``_gaps`` standing between them."""
    lengths = F.expr("zip_with(slice(_gaps, 1, size(_matches)), _matches, (g, m) -> length(g) + length(m))")
    return running(rows.withColumn("_lengths", lengths), "_lengths", "_ends", lambda a, b: a + b, F.lit(0)).drop("_lengths")


def with_base_spans(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with an array of (start, end) for each kind, columns named _email, _ip, _card, _phone."""
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for kind in KINDS:
        gaps, matches = _pieces(source, kind.pattern, kind.trigger(source))
        documents = _with_ends(documents.withColumns({"_gaps": gaps, "_matches": matches}))
        found = F.expr(
            f"""transform(
                  filter(zip_with(_ends, _matches, (e, m) -> struct(e - length(m) AS start, e AS end, {kind.check} AS ok)), x -> x.ok),
                  x -> struct(x.start AS start, x.end AS end))"""
        )
        documents = documents.withColumn(f"_{kind.name}", found)
    return documents.drop("_gaps", "_matches", "_ends")


def _merged(documents: DataFrame, spans: Column, touching: bool) -> DataFrame:
    """``documents`` with ``_regions``: (start, end, kind, kinds) of spans (start, end, kind) that overlap, and of
    ``touching`` ones, as one; kind is that of the first span, kinds lists the numbers of all."""
    documents = documents.withColumn("_spans", F.array_sort(spans)).withColumn("_span_ends", F.expr("transform(_spans, s -> s.end)"))
    documents = running(documents, "_span_ends", "_most", F.greatest, F.lit(-1))
    apart = ">" if touching else ">="
    marked = F.expr(
        f"""zip_with(_spans, concat(array(-1), slice(_most, 1, greatest(size(_most) - 1, 0))), (s, p) ->
              struct(s.start AS start, s.kind AS kind, s.start {apart} p AS begins))"""
    )
    documents = documents.withColumn("_marked", F.when(F.size("_spans") > 0, marked))
    regions = F.expr(
        """zip_with(
             filter(_marked, x -> x.begins),
             arrays_zip(
               filter(zip_with(_most, concat(slice(transform(_marked, x -> x.begins), 2, size(_marked)), array(true)), (m, last) -> if(last, m, null)), m -> m IS NOT NULL),
               slice(split(array_join(transform(_marked, x -> concat(if(x.begins, ',', ''), x.kind)), ''), ','), 2, size(_marked))),
             (x, y) -> struct(x.start AS start, y['0'] AS end, x.kind AS kind, y['1'] AS kinds))"""
    )
    none = F.expr("cast(array() AS array<struct<start:int,end:int,kind:int,kinds:string>>)")
    documents = documents.withColumn("_regions", F.coalesce(regions, none))
    return documents.drop("_spans", "_span_ends", "_most", "_marked")


def _rebuilt(documents: DataFrame, text: str, inside: str) -> DataFrame:
    """``documents`` with ``_parts``: for pieces of the text, (done: with ``inside`` in place of the regions, held: the
    letters of the regions, ``_MASK`` in front of each).

    ``inside`` is SQL of a region ``r`` and of first, where its letters in the piece begin, and n, their number.
    The text is cut before it is read by place, as finding a place means counting the letters before it.
    """
    documents = documents.withColumn("_pieces", F.when(F.size("_regions") > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0))))
    parts = F.expr(
        f"""transform(_pieces, (c, j) -> aggregate(
              transform(filter(_regions, r -> r.end > j * {PIECE} AND r.start < (j + 1) * {PIECE}), r -> struct(
                r AS r, r.start >= j * {PIECE} AS begins, greatest(r.start - j * {PIECE}, 0) AS first,
                least(r.end - j * {PIECE}, {PIECE}) - greatest(r.start - j * {PIECE}, 0) AS n)),
              struct(0 AS at, '' AS done, '' AS held),
              (s, x) -> struct(
                x.first + x.n AS at,
                concat(s.done, substr(c, s.at + 1, x.first - s.at), {inside}) AS done,
                concat(s.held, if(x.begins, '{_MASK}', ''), substr(c, x.first + 1, x.n)) AS held),
              s -> struct(concat(s.done, substr(c, s.at + 1)) AS done, s.held AS held)))"""
    )
    return documents.withColumn("_parts", parts).drop("_pieces")


def with_candidates(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with ``_candidates``: (start, end, instance, left, right, base, kinds) of every region of
    base spans and every run of words with a digit or an at sign between them."""
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    documents = _merged(documents.withColumn("_source", F.translate(source, _MASK, _OTHER)), _spans_with_kind(), True)
    documents = _rebuilt(documents, "_source", f"repeat('{_MASK}', x.n)")
    masked = F.expr("array_join(transform(_parts, p -> p.done), '')")
    letters = F.expr(f"slice(split(array_join(transform(_parts, p -> p.held), ''), '{_MASK}'), 2, size(_regions))")
    documents = documents.withColumns({"_masked": F.coalesce(masked, "_source"), "_letters": letters})
    gaps, matches = _pieces(F.col("_masked"), CANDIDATE, F.col("_masked").rlike(f"[0-9@{_MASK}]"))
    documents = _with_ends(documents.withColumns({"_gaps": gaps, "_matches": matches}))
    kind = "array<struct<start:int,end:int,instance:string,left:string,right:string,base:boolean,kinds:string>>"
    word = rf"[^{_SPACE}]++"
    after = r"^[\x22')\]}>|.,;:!?]++"  # punctuation that belongs to a base span

    def gap(own: str, before: str) -> str:
        return f"CASE WHEN startswith({before}, '{_MASK}') THEN regexp_replace({own}, r\"{after}\", '') ELSE {own} END"

    def nearest(inside: str, beside: str, word_beside: str) -> str:
        return f"""lower(CASE WHEN {inside} <> '' THEN {inside} WHEN startswith({beside}, '{_MASK}') THEN '{_MASK}'
                     ELSE coalesce(regexp_extract({beside}, r'{word_beside}', 0), '') END)"""

    left = nearest(rf"regexp_extract({gap('x.gap', 'x.last')}, r'(?<![^{_SPACE}])({word})[{_SPACE}]*+$', 1)", "x.last", rf"(?<![^{_SPACE}]){word}$")
    right = nearest(rf"regexp_extract({gap('x.after', 'x.own')}, r'^[{_SPACE}]*+({word})', 1)", "x.next", rf"^{word}")
    neighbours = F.arrays_zip(
        F.col("_ends").alias("ends"), F.col("_matches").alias("own"),
        F.expr("slice(_gaps, 1, size(_matches))").alias("gap"), F.expr("slice(_gaps, 2, size(_matches))").alias("after"),
        F.expr("concat(array(cast(null AS string)), slice(_matches, 1, size(_matches) - 1))").alias("last"),
        F.expr("concat(slice(_matches, 2, size(_matches)), array(cast(null AS string)))").alias("next"),
    )
    documents = documents.withColumn("_near", F.when(F.size("_matches") > 0, neighbours))
    found = F.expr(
        f"""transform(_near, x -> struct(
              x.ends - length(x.own) AS start, x.ends AS end, x.own AS instance, {left} AS left, {right} AS right, startswith(x.own, '{_MASK}') AS base))"""
    )
    documents = documents.withColumn("_found", found)
    both = F.expr(
        f"""cast(concat(
              transform(filter(_found, x -> NOT x.base), x -> struct(x.start AS start, x.end AS end, x.instance AS instance, x.left AS left, x.right AS right, x.base AS base, '' AS kinds)),
              coalesce(zip_with(filter(_found, x -> x.base), zip_with(_letters, _regions, (t, r) -> struct(t AS text, r.kinds AS kinds)),
                (x, y) -> struct(x.start AS start, x.end AS end, y.text AS instance, x.left AS left, x.right AS right, x.base AS base, y.kinds AS kinds)),
                cast(array() AS {kind}))) AS {kind})"""
    )
    none = F.expr(f"cast(array() AS {kind})")
    return documents.withColumn("_candidates", F.coalesce(both, none)).drop(
        "_gaps", "_matches", "_masked", "_source", "_regions", "_parts", "_letters", "_ends", "_near", "_found"
    )


def _trimmed(piece: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(piece, _OPENING, ""), _CLOSING, "")


def _words_of_runs(occurrences: DataFrame) -> DataFrame:
    """A row for each word of a run: its start, it and the ``MOST_WORDS`` words after it, it and those before
    it, how many words follow, and the words left of it and right of it."""
    words = occurrences.where(~F.col("base")).withColumn("words", F.split("instance", " "))
    words = running(words.withColumn("sizes", F.expr("transform(words, w -> length(w) + 1)")), "sizes", "ends", lambda a, b: a + b, F.lit(0))
    words = words.withColumn("starts", F.expr("zip_with(ends, sizes, (e, n) -> e - n)"))
    each = F.expr(
        f"""transform(sequence(0, size(words) - 1), i -> struct(
              start + starts[i] AS start, slice(words, i + 1, {MOST_WORDS + 1}) AS next, size(words) - i AS rest,
              slice(words, greatest(0, i - {MOST_WORDS - 1}) + 1, least(i + 1, {MOST_WORDS})) AS last,
              CASE WHEN i = 0 THEN left ELSE lower(words[i - 1]) END AS left,
              CASE WHEN i = size(words) - 1 THEN right ELSE lower(words[i + 1]) END AS next_right, right AS right))"""
    )
    return words.select("_key", "_hash", F.explode(each).alias("w")).select("_key", "_hash", "w.*")


def _sub_runs(words: DataFrame) -> DataFrame:
    """_key, _hash, start, end, instance, left, right of every sub-run."""
    taken = words.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), "rest"))))
    piece = F.array_join(F.expr("slice(next, 1, n)"), " ")
    taken = taken.withColumn("piece", piece).select(
        "_key",
        "_hash",
        (F.col("start") + F.length(F.regexp_extract("piece", _OPENING, 0))).alias("start"),
        (F.col("start") + F.length("piece") - F.length(F.regexp_extract(F.regexp_replace("piece", _OPENING, ""), _CLOSING, 0))).alias("end"),
        _trimmed(F.col("piece")).alias("instance"),
        "left",
        F.when(F.col("n") < F.col("rest"), F.lower(F.expr("get(next, n)"))).otherwise(F.col("right")).alias("right"),
    )
    return taken.where("instance <> ''")


def row_key(key: str, text: str) -> dict[str, Column]:
    return {"_key": F.col(key), "_hash": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))}


def discover(rows: DataFrame, rounds: int, min_support: int, min_confidence: float, min_score: float) -> DataFrame:
    """_key, _hash, kind, start, end of the occurrences that contexts discover.

    ``rows``: _key, _hash, the base spans and _candidates.
    """
    occurrences = (
        rows.where(F.size("_candidates") > 0)
        .withColumn("c", F.explode("_candidates"))
        .select(
            "_key", "_hash", "c.*", *(F.col("c.kinds").contains(str(n)).alias(f"is_{k}") for n, k in enumerate(NAMES)),
        )
    )
    regions = materialize(
        occurrences.where("base").groupBy("instance", "left", "right", *(f"is_{k}" for k in NAMES)).agg(F.count("*").alias("n")),
        "pii-regions",
    )
    words = materialize(_words_of_runs(occurrences), "pii-candidates")
    both = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("b:"), "left", F.lit(" "), "right"))

    def patterns(left: Column | None, right: Column | None) -> Column:
        """(pattern, site) of a row; a site begins with how its instances are read."""

        def one(name: str, side: str, site: Column) -> Column:
            return F.when(F.col(side) != "", F.struct(F.concat(F.lit(name), side).alias("pattern"), site.alias("site")))

        return F.explode(F.array_compact(F.array(one("l:", "left", left), one("r:", "right", right))))

    exact = F.concat(F.lit("="), "instance")
    # At the right of a word the run goes on or ends; the site is what comes before.
    beside = words.select("left", F.col("next_right").alias("right"), F.slice("next", 1, MOST_WORDS).alias("next"), "last").select(
        patterns(F.concat(F.lit("<"), F.array_join("next", " ")), F.concat(F.lit(">"), F.array_join("last", " "))).alias("p"), F.lit(1).alias("n")
    )
    around = F.when(both.isNotNull(), F.struct(both.alias("pattern"), exact.alias("site")))
    sites = (
        beside.unionByName(regions.select(patterns(exact, exact).alias("p"), "n"))
        .unionByName(regions.select(around.alias("p"), "n").where("p is not null"))
        .unionByName(_sub_runs(words).select(around.alias("p"), F.lit(1).alias("n")).where("p is not null"))
    )
    graph = materialize(sites.groupBy("p.pattern", "p.site").agg(F.sum("n").alias("n")), "pii-graph")
    seeds = (
        regions.select("instance", F.explode(F.array_compact(F.array(*(F.when(F.col(f"is_{k}"), k) for k in NAMES)))).alias("kind"))
        .distinct()
        .withColumn("score", F.lit(1.0))
    )
    seeds = materialize(seeds, "pii-seeds")
    looks = F.array_compact(F.array(*(F.when(F.col("instance").rlike(k.looks), k.name) for k in KINDS)))
    # The instances of every site; only seeds and what looks like a kind can have a score.
    parts = F.expr("split(substr(site, 2), ' ')")
    read = (
        F.when(F.col("site").startswith("="), F.array(F.expr("substr(site, 2)")))
        .when(F.col("site").startswith("<"), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: _trimmed(F.array_join(F.slice(parts, F.lit(1), k), " "))))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: _trimmed(F.array_join(F.slice(parts, -k, k), " "))))
    )
    members = graph.select("site").distinct().select("site", F.explode(F.array_distinct(read)).alias("instance"))
    is_seed = seeds.select("instance").distinct().withColumn("seed", F.lit(True))
    members = members.join(is_seed, "instance", "left").withColumn("kinds", looks)
    members = materialize(members.where("seed or size(kinds) > 0"), "pii-members")
    fresh = materialize(
        members.where("seed is null").join(graph, "site").select("pattern", "instance", F.explode("kinds").alias("kind")).distinct(), "pii-unseen"
    )
    totals = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    known = seeds
    for _ in range(rounds):
        best_here = (
            members.select("site", "instance").join(known, "instance").groupBy("site", "kind")
            .agg(F.max_by("score", F.struct("score", "instance")).alias("score"), F.max_by("instance", F.struct("score", "instance")).alias("instance"))
        )
        confident = (
            graph.join(best_here, "site")
            .groupBy("pattern", "kind", "instance")
            .agg(F.sum(F.col("n") * F.col("score")).alias("own"))
            .groupBy("pattern", "kind")
            .agg(F.sum("own").alias("own"), F.count("*").alias("support"))
            .where(F.col("support") >= min_support)
            .join(totals, "pattern")
            .withColumn("confidence", F.col("own") / F.col("total"))
            .where(F.col("confidence") >= min_confidence)
        )
        scored = (
            fresh.join(confident.select("pattern", "kind", "confidence"), ["pattern", "kind"])
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
            .where(F.col("score") >= min_score)
        )
        known = materialize(seeds.unionByName(scored), "pii-known")
    best = known.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return _sub_runs(words).join(best, "instance").select("_key", "_hash", "kind", "start", "end").distinct()


def with_spans(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rounds: int = 3,
    min_support: int = 5,
    min_confidence: float = 0.8,
    min_score: float = 0.9,
) -> DataFrame:
    """One row for each document: _key, _hash, the base spans, and ``_more``: (kind number, start, end) discovered."""
    keyed = documents.select(*(c.alias(name) for name, c in row_key(key, text).items()), F.col(text).alias("_text"))
    rows = materialize(with_candidates(with_base_spans(keyed, "_text"), "_text").drop("_text"), "pii-rows")
    found = discover(rows, rounds, min_support, min_confidence, min_score)
    number = F.element_at(F.create_map(*(x for k, name in enumerate(NAMES) for x in (F.lit(name), F.lit(k)))), F.col("kind"))
    more = found.groupBy("_key", "_hash").agg(F.collect_set(F.struct(number.alias("kind"), "start", "end")).alias("_more"))
    # By start and falling end a longer span around one comes first: the furthest end so far tells, with its start.
    order = F.transform("_more", lambda x: F.struct(x.start.alias("start"), (-x.end).alias("end"), x.kind.alias("kind")))
    more = more.withColumn("_order", F.array_sort(order)).withColumn("_reach", F.expr("transform(_order, x -> struct(-x.end AS end, -x.start AS start))"))
    more = running(more, "_reach", "_far", F.greatest, F.struct(F.lit(-1).alias("end"), F.lit(0).alias("start")))
    longest = F.expr(
        """transform(filter(arrays_zip(_order, _far), x -> NOT (x._far.end > -x._order.end OR -x._far.start < x._order.start)),
             x -> struct(x._order.kind AS kind, x._order.start AS start, -x._order.end AS end))"""
    )
    more = more.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), longest.alias("_more"))
    same = rows["_key"].eqNullSafe(F.col("_k")) & (rows["_hash"] == F.col("_h"))
    none = F.expr("cast(array() AS array<struct<kind:int,start:int,end:int>>)")
    return rows.join(more, same, "left").select(
        "_key", "_hash", *(f"_{k}" for k in NAMES), F.coalesce("_more", none).alias("_more")
    )


def _spans_with_kind() -> Column:
    def with_kind(k: int) -> Column:
        return F.transform(f"_{NAMES[k]}", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(k).alias("kind")))

    return F.concat(*map(with_kind, range(len(NAMES))))


def _numbered() -> Column:
    """All base spans as (kind number, start, end), by kind, then start."""

    def numbered(k: int) -> Column:
        return F.transform(
            f"_{NAMES[k]}", lambda s: F.struct(F.lit(k).alias("kind"), s.start.alias("start"), s.end.alias("end"))
        )

    return F.concat(*map(numbered, range(len(NAMES))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ","
    )


def report(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans, their digest, and all spans, of the rows of ``with_spans``."""
    base = _numbered()
    return spans.select(
        F.col("_key").alias(key),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in NAMES),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(base, "_more"))).alias("spans"),
        F.size("_more").cast("long").alias("n_discovered"),
    )


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; all rows and other columns stay.

    Overlapping spans become one, named by the one that begins first.  Null texts stay null.
    """
    spans = with_spans(documents, key, text, **settings)
    # Only documents with spans take part in the join; equal rows have equal spans.
    some = spans.withColumn("_all", F.concat(_numbered(), "_more")).where(F.size("_all") > 0).dropDuplicates(["_key", "_hash"])
    all_spans = F.transform("_all", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    some = _merged(some, all_spans, False).select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "_regions")
    # The document's own columns travel in one struct, so none can clash.
    rows = documents.select(
        F.struct("*").alias("_doc"),
        F.col(text).cast("string").alias("_text"),
        *(c.alias(name) for name, c in row_key(key, text).items()),
    )
    names = ", ".join(f"'[{k.upper()}]'" for k in NAMES)
    same = rows["_key"].eqNullSafe(F.col("_k")) & (rows["_hash"] == F.col("_h"))
    joined = _rebuilt(rows.join(some, same, "left"), "_text", f"if(x.begins, array({names})[x.r.kind], '')")
    redacted = F.coalesce(F.expr("array_join(transform(_parts, p -> p.done), '')"), F.col("_text"))
    return joined.select(*(redacted.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in documents.columns))
