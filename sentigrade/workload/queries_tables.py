"""Queries over sources, column functions and relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists, text, values
from ..learning import outcomes
from ..operators import aggregates, relational
from ..session import scratch_folder
from ..sources import manifest, payloads, readers, registry, sinks
from .registry import HELPERS, query
from .views import MODELS

CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), "
    r"'http\S+|www\S+', '', 'g'), '<.*?>', '', 'g'), '[^a-zA-Z0-9\s.,!?''\-]', '', 'g'), '\s+', ' ', 'g'))"
)
WORDS = r"len(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> ''))"

HELPERS["clean_reviews"] = (
    f"SELECT *, {CLEAN.format(c='review_text')} AS cleaned_text FROM reviews WHERE review_text IS NOT NULL"
)
HELPERS["long_reviews"] = "SELECT * FROM clean_reviews WHERE length(cleaned_text) > 10"
HELPERS["success_metrics"] = """
    SELECT *, CASE WHEN estimated_revenue_usd IS NULL THEN NULL WHEN estimated_revenue_usd < 100000 THEN 'Flop'
                   WHEN estimated_revenue_usd < 1000000 THEN 'Moderate'
                   WHEN estimated_revenue_usd < 10000000 THEN 'Hit' ELSE 'Blockbuster' END AS success_tier,
           steamspy_owners_min IS NOT NULL
             AND (steam_total_reviews IS NOT NULL OR steam_metacritic_score IS NOT NULL) AS data_complete,
           (steamspy_owners_min + steamspy_owners_max) / 2.0e0 AS owners_midpoint,
           CASE WHEN steamspy_positive + steamspy_negative > 0
                THEN steamspy_positive / (steamspy_positive + steamspy_negative) END AS review_score
    FROM (SELECT *, CASE WHEN steam_total_reviews <> 0 THEN steam_total_reviews * 30.0e0 * steam_current_price_usd END
                      AS estimated_revenue_usd FROM outcomes)"""


def success_metrics(t):
    """Collected outcomes with the derived columns."""
    df = t.outcomes.withColumn(
        "estimated_revenue_usd", values.estimated_revenue("steam_total_reviews", "steam_current_price_usd")
    )
    return df.withColumns(
        {
            "success_tier": values.success_tier("estimated_revenue_usd"),
            "data_complete": values.data_complete(
                "steamspy_owners_min", "steam_total_reviews", "steam_metacritic_score"
            ),
            "owners_midpoint": values.midpoint("steamspy_owners_min", "steamspy_owners_max"),
            "review_score": values.review_score("steamspy_positive", "steamspy_negative"),
        }
    )


# --- Sources ------------------------------------------------------------------------------------


@query("split_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, nullif(text, '') AS text FROM documents")
def split_csv(t):
    """All texts, line breaks and quotes included, written as CSV and read back in blocks of 64 KB."""
    path = scratch_folder(t.spark, "csv")
    sinks.write_result(t.documents.select("doc_id", "source", "text"), path)
    return readers.split_csv(t.spark, path, ["doc_id", "source", "text"], block_bytes=1 << 16).drop("path", "block", "place")


@query("result_round_trip", "SELECT row_id, game_name, review_type, nullif(review_text, '') AS review_text FROM reviews")
def result_round_trip(t):
    """A result table as the sink writes it and the reader reads it."""
    path = scratch_folder(t.spark, "result")
    sinks.write_result(t.reviews.select("row_id", "game_name", "review_type", "review_text"), path)
    schema = "row_id bigint, game_name string, review_type string, review_text string"
    return t.spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


@query(
    "union_first_wins",
    """SELECT app_id, app_name, developer, CAST(rank AS INT) AS origin FROM (
         SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY rank) AS place FROM (
           SELECT app_id, app_name, developer, 0 AS rank FROM game_metadata WHERE required_age < 30
           UNION ALL SELECT app_id, upper(app_name), developer, 1 FROM game_metadata)) WHERE place = 1""",
)
def union_first_wins(t):
    columns = ["app_id", "app_name", "developer"]
    training = t.game_metadata.where("required_age < 30").select(*columns, F.lit(0).alias("origin"))
    validation = t.game_metadata.select(
        "app_id", F.upper("app_name").alias("app_name"), "developer", F.lit(1).alias("origin")
    )
    return relational.first_wins_union([training, validation], "app_id")


@query(
    "coerce_blank_null",
    """SELECT app_id, app_name, CASE WHEN app_id % 4 <> 0 THEN steam_total_reviews END AS steam_total_reviews,
              CASE WHEN app_id % 3 <> 0 THEN steam_current_price_usd END AS steam_current_price_usd,
              CASE WHEN steamspy_languages <> '' THEN steamspy_languages END AS steamspy_languages,
              app_id % 2 = 0 AS data_complete FROM outcomes""",
)
def coerce_blank_null(t):
    raw = t.outcomes.select(
        F.col("app_id").cast("string").alias("app_id"),
        "app_name",
        F.when(F.col("app_id") % 4 != 0, F.col("steam_total_reviews").cast("string"))
        .otherwise(" ")
        .alias("steam_total_reviews"),
        F.when(F.col("app_id") % 3 != 0, F.col("steam_current_price_usd").cast("string"))
        .otherwise("n/a")
        .alias("steam_current_price_usd"),
        "steamspy_languages",
        F.when(F.col("app_id") % 2 == 0, "TRUE").otherwise("").alias("data_complete"),
    )
    return readers.coerce_metrics(raw)


@query(
    "unify_sources",
    """SELECT app_id, app_name, review_text AS text, 'steam_' || review_type AS sentiment_source,
              CAST(NULL AS VARCHAR) AS timestamp, review_type = 'early_access' AS is_pre_release,
              'player' AS author_type, CAST(NULL AS VARCHAR) AS source_url FROM reviews
       UNION ALL SELECT app_id, app_name, text, 'youtube_comment', role, CAST(NULL AS BOOLEAN), 'community',
              'https://video/' || CAST(conv_id AS VARCHAR) FROM comments
       UNION ALL SELECT app_id, app_name, short_description, 'preview_article', release_date,
              CASE WHEN release_date = '' THEN true ELSE release_date < '2015-06-01' END, 'critic', developer
              FROM game_metadata""",
)
def unify_sources(t):
    comments = t.comments.select(
        "app_id",
        "app_name",
        "text",
        F.col("role").alias("published_at"),
        F.concat(F.lit("https://video/"), "conv_id").alias("video_url"),
    )
    articles = t.game_metadata.select(
        "app_id",
        "app_name",
        F.col("developer").alias("source_url"),
        F.col("release_date").alias("date"),
        F.col("short_description").alias("text"),
    )
    return readers.unify(
        [
            readers.reviews_as_records(t.reviews),
            readers.comments_as_records(comments),
            readers.articles_as_records(articles, F.lit("2015-06-01")),
        ]
    )


@query(
    "json_flatten",
    """SELECT app_id, developer || ', Studio' AS developer,
              CASE WHEN app_id % 7 = 0 THEN '' ELSE publisher END AS publisher, release_date,
              CASE WHEN required_age < 40 THEN app_id / 100.0e0 WHEN required_age < 45 THEN 0.0e0 END AS current_price_usd,
              developer || '|' || split_part(app_name, ' ', 1) AS genres, '' AS categories,
              CASE app_id % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'windows|mac' ELSE 'windows|linux' END AS platforms,
              CASE WHEN required_age % 2 = 0 THEN required_age ELSE 0 END AS required_age, short_description
       FROM game_metadata""",
)
def json_flatten(t):
    described = lambda c: F.struct(c.alias("description"))
    document = F.struct(
        F.array("developer", F.lit("Studio")).alias("developers"),
        F.when(F.col("app_id") % 7 != 0, F.array("publisher")).alias("publishers"),
        F.struct(F.col("release_date").alias("date")).alias("release_date"),
        # An empty object is no price.
        F.when(F.col("required_age") < 40, F.create_map(F.lit("initial"), F.col("app_id")))
        .when(F.col("app_id") % 2 == 0, F.create_map().cast("map<string,bigint>"))
        .alias("price_overview"),
        (F.col("required_age") < 45).alias("is_free"),
        F.array(
            described(F.col("developer")),
            described(F.lit("")),
            described(F.substring_index("app_name", " ", 1)),
        ).alias("genres"),
        F.struct(
            F.lit(True).alias("windows"),
            (F.col("app_id") % 3 == 2).alias("linux"),
            (F.col("app_id") % 3 == 1).alias("mac"),
        ).alias("platforms"),
        F.when(F.col("required_age") % 2 == 0, F.col("required_age").cast("string"))
        .otherwise("unknown")
        .alias("required_age"),
        "short_description",
    )
    return payloads.flatten_store_json(t.game_metadata.select("app_id", F.to_json(document).alias("body")))


@query(
    "top_tags",
    """SELECT app_id, 1000 * app_id AS steamspy_owners_min, 5000 + 1000 * app_id AS steamspy_owners_max,
              string_agg(tag, '|' ORDER BY votes DESC, tag) FILTER (WHERE place <= 10) AS steamspy_tags,
              CAST(sum(votes) AS BIGINT) AS steamspy_positive
       FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY votes DESC, tag) AS place FROM (
               SELECT app_id, 'tag' || lpad(CAST(floor((ts % 86400) / 3600) AS BIGINT)::VARCHAR, 2, '0') AS tag,
                      count(*) AS votes FROM raw_reviews_ts GROUP BY ALL)) GROUP BY app_id""",
)
def top_tags(t):
    hour = F.floor((F.col("ts") % 86400) / 3600).cast("string")
    votes = t.raw_reviews_ts.groupBy("app_id", F.concat(F.lit("tag"), F.lpad(hour, 2, "0")).alias("tag")).count()
    # An app has at most 24 tags here, one per hour.
    tags = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "count"))))
    apps = votes.groupBy("app_id").agg(tags.alias("tags"), F.sum("count").alias("positive"))
    owners = F.concat(
        F.format_number(F.col("app_id") * 1000, 0), F.lit(" .. "), F.format_number(F.col("app_id") * 1000 + 5000, 0)
    )
    documents = apps.select("app_id", F.to_json(F.struct(owners.alias("owners"), "positive", "tags")).alias("body"))
    return payloads.flatten_engagement_json(documents).select(
        "app_id", "steamspy_owners_min", "steamspy_owners_max", "steamspy_tags", "steamspy_positive"
    )


@query(
    "route_and_cap",
    """SELECT app_id, row_id, ts, review_type FROM (
         SELECT *, row_number() OVER (PARTITION BY app_id, review_type ORDER BY ts DESC, row_id) AS place FROM (
           SELECT r.app_id, r.row_id, r.ts, 'early_access' AS review_type FROM raw_reviews_ts r JOIN registry g ON r.app_id = g.app_id
           WHERE early_flag OR ts BETWEEN start_date AND CASE WHEN end_date = 9999999999 THEN 2000000000 ELSE end_date END
           UNION ALL SELECT r.app_id, r.row_id, r.ts, 'post_release' FROM raw_reviews_ts r JOIN registry g ON r.app_id = g.app_id
           WHERE end_date <> 9999999999 AND ts > end_date)) WHERE place <= 150""",
)
def route_and_cap(t):
    routed = registry.route_reviews(t.raw_reviews_ts, t.registry, max_reviews=150)
    return routed.select("app_id", "row_id", "ts", "review_type")


@query(
    "resume_anti",
    """SELECT model, seed, fold FROM training_results r WHERE NOT EXISTS (
         SELECT 1 FROM training_results_gaps g WHERE g.model = r.model AND g.seed = r.seed AND g.fold = r.fold)""",
)
def resume_anti(t):
    keys = ["model", "seed", "fold"]
    return relational.not_done(t.training_results.select(*keys), t.training_results_gaps, keys)


@query(
    "merge_new",
    """SELECT model, seed, fold, CAST(0 AS INT) AS imported, n_events FROM training_results_gaps
       UNION ALL SELECT model, seed, fold, CAST(1 AS INT), n_events FROM training_results r WHERE NOT EXISTS (
         SELECT 1 FROM training_results_gaps g WHERE g.model = r.model AND g.seed = r.seed AND g.fold = r.fold)""",
)
def merge_new(t):
    def columns(df, imported):
        return df.select("model", "seed", "fold", F.lit(imported).alias("imported"), "n_events")

    return relational.append_unseen(
        columns(t.training_results_gaps, 0), columns(t.training_results, 1), ["model", "seed", "fold"]
    )


@query(
    "manifest_diff",
    """SELECT coalesce(a.path, b.path) AS path, a.hash AS current_hash, b.hash AS stored_hash,
              CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed'
                   WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END AS state
       FROM (SELECT 'doc' || doc_id AS path, md5(text) AS hash FROM documents) a
       FULL JOIN (SELECT 'doc' || (doc_id + 1) AS path, md5(CASE WHEN lang = 'en' THEN lower(text) ELSE text END) AS hash
                  FROM documents) b ON a.path = b.path""",
)
def manifest_diff(t):
    current = t.documents.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.md5("text").alias("hash"))
    older = F.when(F.col("lang") == "en", F.lower("text")).otherwise(F.col("text"))
    stored = t.documents.select(
        F.concat(F.lit("doc"), F.col("doc_id") + 1).alias("path"), F.md5(older).alias("hash")
    )
    return manifest.manifest_diff(current, stored)


@query(
    "source_hashes",
    """SELECT 'lang=' || lang AS folder, md5(string_agg(doc_id || ',' || n || chr(10), '' ORDER BY doc_id)) AS hash
       FROM (SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, doc_id, length(text) AS n FROM documents) GROUP BY lang""",
)
def source_hashes(t):
    """Files written from a table, one for each language, and hashed again by the executors."""
    folder = scratch_folder(t.spark, "sources")
    rows = t.documents.select("lang", "doc_id", F.length("text").alias("n"))
    rows.repartition("lang").sortWithinPartitions("lang", "doc_id").write.partitionBy("lang").csv(folder)
    folder_of = F.element_at(F.split("path", "/"), -2).alias("folder")
    return manifest.source_hashes(t.spark, f"{folder}/lang=*").select(folder_of, "hash")


@query(
    "build_counts",
    """SELECT count(*) AS n_rows, count(DISTINCT game_name) AS n_games,
              count(CASE WHEN review_type = 'early_access' THEN 1 END) AS n_early,
              count(CASE WHEN review_type = 'post_release' THEN 1 END) AS n_post
       FROM (SELECT *, row_number() OVER (PARTITION BY app_id, review_text ORDER BY source_file, row_id) AS place
             FROM long_reviews) WHERE place = 1""",
)
def build_counts(t):
    built = relational.dedup_reviews(relational.clean_reviews(t.reviews))
    return built.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("game_name").alias("n_games"),
        F.count_if(F.col("review_type") == "early_access").alias("n_early"),
        F.count_if(F.col("review_type") == "post_release").alias("n_post"),
    )


HELPERS["candidates"] = """
    SELECT p_partkey AS app_id, p_name AS name, 10 * p_size AS total_reviews, 7 * p_size AS positive_reviews,
           CAST(p_size * 20000 + p_partkey % 100 AS BIGINT) AS owners_midpoint FROM part"""


def candidates(t):
    """A discovery listing built from the part table, as landed JSON."""
    owners = F.concat(
        F.format_number(F.col("p_size") * 20000, 0),
        F.lit(" .. "),
        F.format_number(F.col("p_size") * 20000 + 2 * (F.col("p_partkey") % 100), 0),
    )
    document = F.struct(
        F.col("p_name").alias("name"),
        (F.col("p_size") * 7).alias("positive"),
        (F.col("p_size") * 3).alias("negative"),
        owners.alias("owners"),
    )
    return payloads.parse_candidates(
        t.part.select(F.col("p_partkey").alias("app_id"), F.to_json(document).alias("body"))
    )


HELPERS["discovered"] = """
    SELECT app_id, name, CAST(total_reviews AS BIGINT) AS total_reviews, CAST(positive_reviews AS BIGINT) AS positive_reviews,
           owners_midpoint, category FROM (
      SELECT *, row_number() OVER (PARTITION BY category ORDER BY total_reviews DESC, app_id) AS place FROM (
        SELECT *, CASE WHEN owners_midpoint < 500000 THEN 'indie' ELSE 'aaa' END AS category FROM candidates c
        WHERE total_reviews >= 200 AND NOT EXISTS (SELECT 1 FROM registry r WHERE r.app_id = c.app_id)))
    WHERE place <= CASE category WHEN 'indie' THEN 60 ELSE 40 END"""


@query("discover_quota", "SELECT * FROM discovered")
def discover_quota(t):
    return registry.discover(candidates(t), t.registry, min_reviews=200, k=100)


@query(
    "registry_append",
    """SELECT app_id, name, start_date, end_date, split, CAST(NULL AS BOOLEAN) AS discovered, CAST(NULL AS BIGINT) AS owners_midpoint,
              CAST(NULL AS BIGINT) AS total_reviews, CAST(NULL AS VARCHAR) AS category FROM registry
       UNION ALL SELECT app_id, name, NULL, NULL, 'training', true, owners_midpoint, total_reviews, category FROM discovered""",
)
def registry_append(t):
    found = registry.discover(candidates(t), t.registry, min_reviews=200, k=100)
    return registry.add_to_registry(t.registry, found)


# --- Column functions ---------------------------------------------------------------------------


@query("clean_text", f"SELECT doc_id, {CLEAN.format(c='text')} AS cleaned_text FROM documents")
def clean_text(t):
    return t.documents.select("doc_id", text.clean_text("text").alias("cleaned_text"))


@query("word_count", f"SELECT doc_id, CAST({WORDS.format(c='text')} AS INT) AS n_words FROM documents")
def word_count(t):
    return t.documents.select("doc_id", text.word_count("text").alias("n_words"))


@query("short_filter", "SELECT row_id, length(cleaned_text) AS n_chars FROM clean_reviews WHERE length(cleaned_text) > 300")
def short_filter(t):
    kept = relational.clean_reviews(t.reviews, minimum=300)
    return kept.select("row_id", F.char_length("cleaned_text").cast("bigint").alias("n_chars"))


@query(
    "normalize_name",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS name_key
        FROM documents""",
)
def normalize_name(t):
    return t.documents.select("doc_id", text.normalize_name("text").alias("name_key"))


@query(
    "parse_range",
    """SELECT app_id, CASE WHEN app_id % 5 = 4 THEN NULL ELSE steamspy_owners_min END AS low,
              CASE app_id % 5 WHEN 4 THEN NULL WHEN 3 THEN steamspy_owners_min ELSE steamspy_owners_max END AS high
       FROM outcomes""",
)
def parse_range(t):
    low, high = F.format_number("steamspy_owners_min", 0), F.format_number("steamspy_owners_max", 0)
    written = (
        F.when(F.col("app_id") % 5 == 4, F.when(F.col("app_id") % 2 == 0, "0").otherwise(""))
        .when(F.col("app_id") % 5 == 3, low)
        .otherwise(F.concat(low, F.lit(" .. "), high))
    )
    parsed = t.outcomes.select("app_id", values.parse_range(written).alias("r"))
    return parsed.select("app_id", "r.low", "r.high")


@query(
    "midpoint",
    """SELECT app_id, CAST((steamspy_owners_min + steamspy_owners_max + app_id) // 2 AS BIGINT) AS floor_mid,
              (steamspy_owners_min + steamspy_owners_max) / 2.0e0 AS exact_mid FROM outcomes""",
)
def midpoint(t):
    odd = F.col("steamspy_owners_max") + F.col("app_id")
    return t.outcomes.select(
        "app_id",
        values.floor_midpoint("steamspy_owners_min", odd).alias("floor_mid"),
        values.midpoint("steamspy_owners_min", "steamspy_owners_max").alias("exact_mid"),
    )


@query("review_score", "SELECT app_id, review_score FROM success_metrics", "review_score")
def review_score(t):
    return t.outcomes.select(
        "app_id", values.review_score("steamspy_positive", "steamspy_negative").alias("review_score")
    )


@query("revenue", "SELECT app_id, estimated_revenue_usd FROM success_metrics")
def revenue(t):
    return success_metrics(t).select("app_id", "estimated_revenue_usd")


@query("success_tier", "SELECT app_id, success_tier FROM success_metrics")
def success_tier(t):
    return success_metrics(t).select("app_id", "success_tier")


@query(
    "price_tier",
    """SELECT app_id, CAST(CASE WHEN steam_current_price_usd IS NULL THEN NULL WHEN steam_current_price_usd <= 0 THEN 0
              WHEN steam_current_price_usd < 10 THEN 1 WHEN steam_current_price_usd < 20 THEN 2
              WHEN steam_current_price_usd < 30 THEN 3 ELSE 4 END AS INT) AS price_tier FROM outcomes""",
)
def price_tier(t):
    return t.outcomes.select("app_id", values.price_tier("steam_current_price_usd").alias("price_tier"))


@query(
    "release_features",
    """SELECT app_id, CAST(year(d) AS INT) AS release_year, CAST(month(d) AS INT) AS release_month,
              CAST(month(d) >= 10 AS INT) AS release_is_q4, CAST(year(d) >= 2020 AS INT) AS ea_cohort_post_2020,
              CAST(2024 - year(d) AS INT) AS years_since_release
       FROM (SELECT app_id, try_cast(release_date AS DATE) AS d FROM game_metadata)""",
)
def release_features(t):
    # The same dates in the formats that occur in collected data.
    day = F.to_date(F.when(F.col("release_date") != "", F.col("release_date")))
    written = (
        F.when(F.col("app_id") % 3 == 0, F.date_format(day, "MMM d, yyyy"))
        .when(F.col("app_id") % 3 == 1, F.date_format(day, "d MMM, yyyy"))
        .otherwise(F.col("release_date"))
    )
    parsed = t.game_metadata.select("app_id", values.parse_date(written).alias("day"))
    return parsed.withColumns(values.release_features("day", 2024)).drop("day")


@query(
    "split_field",
    """SELECT app_id, array_to_string(list_filter(list_transform(string_split(genres, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS parts,
              CAST(len(list_filter(list_transform(string_split(genres, '|'), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS n_parts
       FROM game_metadata""",
)
def split_field(t):
    parts = text.split_field("genres", "|")
    return t.game_metadata.select(
        "app_id", F.array_join(parts, ";").alias("parts"), F.size(parts).alias("n_parts")
    )


HELPERS["genre_lists"] = """
    SELECT *, list_filter(list_transform(string_split(genres, '|'), lambda x: trim(x)), lambda x: x <> '') AS g,
           list_filter(string_split(categories, '|'), lambda x: x <> '') AS c,
           list_filter(string_split(platforms, '|'), lambda x: x <> '') AS p,
           string_split(developer, ',') AS devs,
           list_transform(string_split(publisher, ','), lambda x: trim(x)) AS pubs FROM game_metadata"""


def _flag_sql(prefix: str, names, items: str) -> str:
    return ", ".join(
        f"CAST(list_contains({items}, '{n}') AS INT) AS {lists.flag_name(prefix, n)}" for n in names
    )


@query(
    "flags",
    f"""SELECT app_id, {_flag_sql("genre_", lists.GENRES, "g")}, {_flag_sql("supports_", lists.PLATFORMS, "p")},
               {_flag_sql("tag_", lists.TAGS, "s")}
        FROM genre_lists JOIN (SELECT app_id, string_split(steamspy_tags, '|') AS s FROM outcomes) USING (app_id)""",
)
def flags(t):
    df = t.game_metadata.join(t.outcomes.select("app_id", "steamspy_tags"), "app_id").select(
        "app_id",
        text.split_field("genres", "|").alias("g"),
        text.split_field("platforms", "|").alias("p"),
        text.split_field("steamspy_tags", "|").alias("s"),
    )
    columns = lists.flag_columns("g", lists.GENRES, "genre_")
    columns |= lists.flag_columns("p", lists.PLATFORMS, "supports_")
    columns |= lists.flag_columns("s", lists.TAGS, "tag_")
    return df.withColumns(columns).drop("g", "p", "s")


@query(
    "any_contains",
    """SELECT app_id, len(list_filter(c, lambda x: contains(x, 'Multi-player') OR contains(x, 'Co-op'))) > 0 AS has_multiplayer_category,
              len(list_filter(c, lambda x: contains(x, 'Controller'))) > 0 AS has_controller_support,
              len(list_filter(c, lambda x: contains(x, 'Cloud'))) > 0 AS has_cloud_saves FROM genre_lists""",
)
def any_contains(t):
    parts = text.split_field("categories", "|")
    marks = [lists.any_contains(parts, m).alias(name) for name, m in lists.CATEGORY_MARKS.items()]
    return t.game_metadata.select("app_id", *marks)


@query(
    "same_set",
    """SELECT app_id, developer = publisher OR (developer = 'Brand#1' AND publisher = 'Brand#1, Brand#1') AS is_self_published
       FROM game_metadata""",
)
def same_set(t):
    developers, publishers = text.split_field("developer", ","), text.split_field("publisher", ",")
    return t.game_metadata.select("app_id", lists.same_set(developers, publishers).alias("is_self_published"))


@query(
    "list_sizes",
    """SELECT app_id, CAST(len(g) AS INT) AS num_genres, CAST(len(c) AS INT) AS num_categories, CAST(len(p) AS INT) AS num_platforms,
              CAST(len(devs) AS INT) AS num_developers, CAST(len(pubs) AS INT) AS num_publishers FROM genre_lists""",
)
def list_sizes(t):
    sizes = lists.list_sizes(
        num_genres=text.split_field("genres", "|"),
        num_categories=text.split_field("categories", "|"),
        num_platforms=text.split_field("platforms", "|"),
        num_developers=text.split_field("developer", ","),
        num_publishers=text.split_field("publisher", ","),
    )
    return t.game_metadata.select("app_id", *[c.alias(name) for name, c in sizes.items()])


@query(
    "derive_numeric",
    """SELECT app_id, ln(1 + ea_review_count) AS log_ea_review_count, abs(ea_predicted_positive_ratio - 0.5e0) AS sentiment_confidence,
              CASE WHEN ea_review_count > 20 THEN pr_review_count / (ea_review_count - 20) END AS ea_to_pr_review_ratio
       FROM game_features""",
    "log_ea_review_count sentiment_confidence ea_to_pr_review_ratio",
)
def derive_numeric(t):
    return t.game_features.select(
        "app_id",
        F.log1p("ea_review_count").alias("log_ea_review_count"),
        values.confidence("ea_predicted_positive_ratio").alias("sentiment_confidence"),
        values.guarded_ratio("pr_review_count", F.col("ea_review_count") - 20).alias("ea_to_pr_review_ratio"),
    )


@query(
    "to_numeric",
    """SELECT app_id, try_cast(split_part(genres, '|', 1) || app_id AS DOUBLE) AS never, CAST(app_id AS DOUBLE) AS always,
              CASE WHEN app_id % 3 = 0 THEN CAST(required_age AS DOUBLE) ELSE 0.0e0 END AS required_age FROM game_metadata""",
)
def to_numeric(t):
    mixed = F.when(F.col("app_id") % 3 == 0, F.col("required_age").cast("string")).otherwise("adults")
    first = F.concat(F.substring_index("genres", "|", 1), "app_id")
    return t.game_metadata.select(
        "app_id",
        values.to_numeric(first).alias("never"),
        values.to_numeric(F.concat(F.lit(" "), "app_id")).alias("always"),
        F.coalesce(values.to_numeric(mixed), F.lit(0.0)).alias("required_age"),
    )


@query(
    "before_release",
    """SELECT row_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts < TIMESTAMP '2024-01-15 12:00:00' END AS is_before
       FROM (SELECT event_id AS row_id, event_type, ts FROM events)""",
)
def before_release(t):
    written = F.when(F.col("event_type") == "error", "soon").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return t.events.select(
        F.col("event_id").alias("row_id"),
        values.is_before_release(written, F.lit("2024-01-15T12:00:00")).alias("is_before"),
    )


@query(
    "effect_labels",
    """SELECT event_id, CASE WHEN abs(r) < 0.1 THEN 'Negligible' WHEN abs(r) < 0.3 THEN 'Small' WHEN abs(r) < 0.5 THEN 'Medium'
              ELSE 'Large' END AS effect_size,
              CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars,
              CASE WHEN p < 0.05 AND abs(r) > 0.3 THEN 'SUPPORTED' WHEN p < 0.05 THEN 'PARTIALLY SUPPORTED' ELSE 'NOT SUPPORTED' END AS verdict
       FROM (SELECT event_id, ((event_id * 37) % 201 - 100) / 100.0e0 AS r, value / 1000.0e0 AS p FROM events)""",
)
def effect_labels(t):
    r = ((F.col("event_id") * 37) % 201 - 100) / 100.0
    p = F.col("value") / 1000.0
    return t.events.select(
        "event_id",
        values.effect_size(r).alias("effect_size"),
        values.stars(p).alias("stars"),
        values.verdict(r, p).alias("verdict"),
    )


@query("data_complete", "SELECT app_id, data_complete FROM success_metrics")
def data_complete(t):
    return success_metrics(t).select("app_id", "data_complete")


# --- Filters, joins, set operations -------------------------------------------------------------


@query(
    "dropna_subset",
    "SELECT app_id, estimated_revenue_usd FROM success_metrics WHERE estimated_revenue_usd IS NOT NULL AND review_score IS NOT NULL",
)
def dropna_subset(t):
    kept = success_metrics(t).na.drop(subset=["estimated_revenue_usd", "review_score"])
    return kept.select("app_id", "estimated_revenue_usd")


@query(
    "dropna_thresh",
    """SELECT app_id FROM success_metrics WHERE (steam_metacritic_score IS NOT NULL)::INT + (estimated_revenue_usd IS NOT NULL)::INT
         + (steam_current_price_usd IS NOT NULL)::INT >= 2""",
)
def dropna_thresh(t):
    columns = ["steam_metacritic_score", "estimated_revenue_usd", "steam_current_price_usd"]
    return success_metrics(t).na.drop(thresh=2, subset=columns).select("app_id")


@query(
    "dedup_first",
    """SELECT app_id, review_text, row_id, source_file FROM (
         SELECT *, row_number() OVER (PARTITION BY app_id, review_text ORDER BY source_file, row_id) AS place FROM reviews_dup)
       WHERE place = 1""",
)
def dedup_first(t):
    return relational.dedup_reviews(t.reviews_dup)


@query(
    "enrich_left",
    """SELECT r.app_id, row_id, developer, publisher, release_date, current_price_usd
       FROM raw_reviews_ts r LEFT JOIN game_metadata m ON r.app_id = m.app_id""",
)
def enrich_left(t):
    reviews = t.raw_reviews_ts.select("app_id", "row_id")
    return relational.enrich_left(reviews, t.game_metadata)


@query(
    "join_suffix",
    """SELECT g.app_id, g.game_name, g.ea_review_count, m.app_name, m.app_name AS game_name_m, m.steam_total_reviews
       FROM game_features g JOIN success_metrics m ON g.app_id = m.app_id""",
)
def join_suffix(t):
    right = success_metrics(t).select(
        "app_id", "app_name", F.col("app_name").alias("game_name"), "steam_total_reviews"
    )
    left = t.game_features.select("app_id", "game_name", "ea_review_count")
    return relational.join_games(left, right, "_m")


@query(
    "join_by_name",
    """SELECT g.game_name, g.ea_review_count, v.app_name, v.yt_comment_count, lower(g.game_name) AS name_key
       FROM game_features g JOIN video_sentiment v ON lower(g.game_name) = lower(v.app_name)""",
)
def join_by_name(t):
    left = t.game_features.select("game_name", "ea_review_count")
    right = t.video_sentiment.select(F.concat(F.lit(" "), F.upper("app_name"), F.lit("! ")).alias("app_name"), "yt_comment_count")
    joined = relational.join_games(left, right, "_m")
    return joined.withColumn("app_name", F.lower(F.regexp_replace("app_name", "[! ]", "")))


HELPERS["matrix"] = f"""
    SELECT g.*, v.* EXCLUDE (app_id, app_name), m.* EXCLUDE (app_id, app_name), ln(1 + ea_review_count) AS log_ea_review_count,
           abs(ea_predicted_positive_ratio - 0.5e0) AS sentiment_confidence,
           abs(yt_predicted_positive_ratio - 0.5e0) AS yt_sentiment_confidence, ln(1 + yt_comment_count) AS log_yt_comment_count,
           CAST(year(rel) AS INT) AS release_year, CAST(month(rel) AS INT) AS release_month,
           CAST(month(rel) >= 10 AS INT) AS release_is_q4, CAST(year(rel) >= 2020 AS INT) AS ea_cohort_post_2020,
           CAST(2024 - year(rel) AS INT) AS years_since_release, steam_current_price_usd AS price_usd,
           CAST(CASE WHEN steam_current_price_usd IS NULL THEN NULL WHEN steam_current_price_usd <= 0 THEN 0
              WHEN steam_current_price_usd < 10 THEN 1 WHEN steam_current_price_usd < 20 THEN 2
              WHEN steam_current_price_usd < 30 THEN 3 ELSE 4 END AS INT) AS price_tier,
           CAST(len(l.g) AS INT) AS num_genres, CAST(len(l.c) AS INT) AS num_categories, CAST(len(l.p) AS INT) AS num_platforms,
           CAST(CASE steamspy_languages WHEN '' THEN 0 WHEN 'English' THEN 1 ELSE 3 END AS INT) AS num_languages,
           CAST(len(string_split(steamspy_tags, '|')) AS INT) AS num_top_tags,
           CAST(len(l.pubs) AS INT) AS num_publishers, CAST(len(l.devs) AS INT) AS num_developers,
           CAST(developer = publisher OR (developer = 'Brand#1' AND publisher = 'Brand#1, Brand#1') AS INT) AS is_self_published,
           CASE WHEN ea_review_count > 0 THEN pr_review_count / ea_review_count END AS ea_to_pr_review_ratio,
           CAST(l.required_age AS DOUBLE) AS required_age,
           {_flag_sql("supports_", lists.PLATFORMS, "l.p")}, {_flag_sql("genre_", lists.GENRES, "l.g")},
           {_flag_sql("tag_", lists.TAGS, "string_split(steamspy_tags, '|')")},
           CAST(len(list_filter(l.c, lambda x: contains(x, 'Multi-player') OR contains(x, 'Co-op'))) > 0 AS INT) AS has_multiplayer_category,
           CAST(len(list_filter(l.c, lambda x: contains(x, 'Controller'))) > 0 AS INT) AS has_controller_support,
           CAST(len(list_filter(l.c, lambda x: contains(x, 'Cloud'))) > 0 AS INT) AS has_cloud_saves
    FROM game_features g JOIN (SELECT *, try_cast(steam_release_date AS DATE) AS rel FROM success_metrics) m ON g.app_id = m.app_id
      LEFT JOIN video_sentiment v ON g.app_id = v.app_id LEFT JOIN genre_lists l ON g.app_id = l.app_id"""

MATRIX_COLUMNS = tuple(
    dict.fromkeys(
        [
            *outcomes.STEAM_FEATURES,
            *outcomes.YOUTUBE_FEATURES,
            *outcomes.METADATA_FEATURES,
            "owners_midpoint", "steamspy_owners_min", "steam_metacritic_score", "steamspy_avg_playtime",
            "review_score", "estimated_revenue_usd", "success_tier",
        ]
    )
)
_MATRIX_DOUBLES = (
    "log_ea_review_count sentiment_confidence yt_sentiment_confidence log_yt_comment_count "
    "ea_to_pr_review_ratio review_score"
)


def matrix(t):
    return outcomes.feature_matrix(
        t.game_features, success_metrics(t), 2024, t.video_sentiment, t.game_metadata
    )


@query("feature_matrix", f"SELECT app_id, {', '.join(MATRIX_COLUMNS)} FROM matrix", _MATRIX_DOUBLES)
def feature_matrix(t):
    return matrix(t).select("app_id", *MATRIX_COLUMNS)


@query(
    "topk_multi",
    "SELECT app_id, success_tier, review_score FROM success_metrics ORDER BY success_tier DESC NULLS LAST, review_score DESC NULLS LAST, app_id LIMIT 15",
    "review_score",
)
def topk_multi(t):
    order = [F.col("success_tier").desc_nulls_last(), F.col("review_score").desc_nulls_last(), F.col("app_id")]
    return relational.top_rows(success_metrics(t), order, 15).select("app_id", "success_tier", "review_score")


@query(
    "training_plan",
    """SELECT * FROM (
         SELECT model, seed, fold FROM (SELECT DISTINCT seed FROM training_results)
           CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS model)
           CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS fold)) p
       WHERE NOT EXISTS (SELECT 1 FROM training_results_gaps g
                         WHERE g.model = p.model AND g.seed = p.seed AND g.fold = p.fold)""",
)
def training_plan(t):
    seeds = t.training_results.select("seed").distinct()
    return relational.training_plan(seeds, MODELS, 5, t.training_results_gaps)


_GATED = outcomes.METADATA_FEATURES


HELPERS["variance_gate"] = (
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, CAST(sum({c}) AS DOUBLE) AS total, CAST(min({c}) AS DOUBLE) AS low,
                   CAST(max({c}) AS DOUBLE) AS high, bool_and({c} IN (0, 1)) AS is_binary,
                   count({c}) >= 5 AND CASE WHEN bool_and({c} IN (0, 1)) THEN sum({c}) >= 2 AND count({c}) - sum({c}) >= 2
                     ELSE count(DISTINCT {c}) >= 2 END AS keep FROM matrix"""
        for c in _GATED
    )
)


@query("variance_gate", "SELECT * FROM variance_gate", "total low high")
def variance_gate(t):
    return relational.varying_columns(matrix(t), _GATED)


@query(
    "subset_summary",
    """SELECT count(*) AS n_samples, count(CASE WHEN positive = 1 THEN 1 END) AS n_positive,
              count(CASE WHEN positive = 0 THEN 1 END) AS n_negative, avg(positive) AS positive_ratio,
              count(DISTINCT game_name) AS n_games FROM labelled_reviews WHERE review_type = 'early_access'""",
    "positive_ratio",
)
def subset_summary(t):
    return aggregates.subset_summary(relational.subset(t.labelled_reviews, review_type="early_access"))
