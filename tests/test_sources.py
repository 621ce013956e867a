"""Files in the collectors' formats: readers, payloads, registry, manifest and the dataset build."""

import csv
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sentigrade.plans import flows
from sentigrade.sources import manifest, payloads, readers, registry, sinks

EARLY = 'app_id,app_name,review_text,positive\n1,One,"Great ""fun"",\nreally a lot of it",1\n1,One,short,0\n1,One,,1\n1,One,a duplicate review text,1\n'
POST = "app_id,app_name,review_text,positive\n1,One,a duplicate review text,0\n1,One,Some other long review,0\n"
METADATA = (
    "app_id,app_name,developer,publisher,release_date,current_price_usd,genres,categories,platforms,required_age,short_description\n"
    "1,One,Dev,Pub,2020-01-01,9.99,Action|RPG,,windows,,text\n"
)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "One_early_access_reviews.csv").write_text(EARLY)
    (folder / "One_post_release_reviews.csv").write_text(POST)
    (folder / "other_reviews.csv").write_text(POST)
    (folder / "game_metadata.csv").write_text(METADATA)
    return folder


def test_read_reviews(spark, raw):
    df = readers.read_reviews(spark, str(raw))
    assert df.count() == 6
    assert {(r.game_name, r.review_type) for r in df.select("game_name", "review_type").distinct().collect()} == {
        ("One", "early_access"), ("One", "post_release"),
    }
    assert df.where(F.col("review_text").contains('"fun",\nreally')).count() == 1


def test_build_dataset_and_staleness(spark, raw, tmp_path):
    output = str(tmp_path / "out")
    places = ({"training": str(raw)}, {"training": str(raw / "game_metadata.csv")}, output)
    rows = flows.build_dataset(spark, *places)
    assert rows == {"training_rows": 3, "validation_rows": 0}
    built = spark.read.parquet(f"{output}/training")
    kept = built.where("review_text = 'a duplicate review text'").collect()
    assert [(r.review_type, r.positive, r.developer) for r in kept] == [("early_access", 1, "Dev")]
    status = manifest.status(spark, f"{output}/manifest", str(raw)).first()
    assert (status.tracked_files, status.is_stale) == (3, False)
    (raw / "Two_post_release_reviews.csv").write_text(POST)
    assert manifest.status(spark, f"{output}/manifest", str(raw)).first().is_stale
    assert flows.build_dataset(spark, *places)["training_rows"] == 3


def test_metrics_csv_round_trip(spark, tmp_path):
    from sentigrade import schemas

    header = schemas.SUCCESS_METRICS.fieldNames()
    lines = {"app_id": "5", "app_name": "Five", "steam_current_price_usd": "9.5", "data_complete": "True", "steam_total_reviews": ""}
    text = ",".join(header) + "\n" + ",".join(lines.get(c, "") for c in header) + "\n"
    (tmp_path / "m.csv").write_text(text)
    df = readers.read_metrics(spark, str(tmp_path / "m.csv"))
    row = df.first()
    assert (row.app_id, row.steam_current_price_usd, row.data_complete) == (5, 9.5, True)
    assert row.steam_total_reviews is None and row.success_tier is None
    sinks.write_metrics(df, str(tmp_path / "back"))
    assert readers.read_metrics(spark, str(tmp_path / "back")).first() == row


def test_registry_and_routing(spark, tmp_path):
    games = {
        "training_games": [
            {"app_id": 1, "name": "A", "start_date": 100, "end_date": 200},
            {"app_id": 2, "name": "B", "start_date": 100, "end_date": 9999999999},
        ],
        "validation_games": [{"app_id": 3, "name": "C", "start_date": None, "end_date": None}],
    }
    (tmp_path / "r.json").write_text(json.dumps(games))
    found = readers.read_registry(spark, str(tmp_path / "r.json"))
    assert {(r.app_id, r.split, r.still_open) for r in found.collect()} == {
        (1, "training", False), (2, "training", True), (3, "validation", None),
    }
    reviews = [
        (1, 150, False, 1), (1, 250, False, 2), (1, 250, True, 3), (1, 50, False, 4), (1, 200, False, 5),
        (2, 5000, False, 6), (2, 50, False, 7), (3, 10, True, 8), (3, 10, False, 9),
    ]
    df = spark.createDataFrame(reviews, "app_id long, ts long, early_flag boolean, row_id long")
    routed = {(r.row_id, r.review_type) for r in registry.route_reviews(df, found).collect()}
    early, post = "early_access", "post_release"
    assert routed == {(1, early), (2, post), (3, early), (3, post), (5, early), (6, early), (8, early), (9, post)}
    capped = registry.route_reviews(df, found, max_reviews=1, rows=2)
    # The latest review wins, the lower row number where times are equal.
    assert {(r.row_id, r.review_type) for r in capped.where("app_id = 1").collect()} == {(3, early), (2, post)}


def test_payloads(spark):
    store = {
        "developers": ["A", "B"], "publishers": [], "release_date": {"date": "Sep 10, 2024"}, "is_free": True,
        "genres": [{"description": "Action"}, {"id": 3}], "platforms": {"windows": True, "mac": False, "linux": True},
        "required_age": "17", "metacritic": {"score": 80}, "recommendations": {"total": 12},
    }
    engagement = {"owners": "0 .. 20,000", "positive": 5, "negative": 1, "tags": [], "languages": ""}
    df = spark.createDataFrame([(1, json.dumps(store))], "app_id long, body string")
    row = payloads.flatten_store_json(df).first()
    assert (row.developer, row.publisher, row.current_price_usd) == ("A, B", "", 0.0)
    assert (row.genres, row.categories, row.platforms, row.required_age) == ("Action", "", "windows|linux", 17)
    engaged = payloads.flatten_engagement_json(spark.createDataFrame([(2, json.dumps(engagement))], "app_id long, body string"))
    first = engaged.first()
    assert (first.steamspy_owners_min, first.steamspy_owners_max, first.steamspy_tags) == (0, 20000, None)
    rows = {r.app_id: r for r in payloads.build_metrics(engaged, payloads.flatten_store_outcomes(df)).collect()}
    assert (rows[1].last_error, rows[1].estimated_revenue_usd, rows[1].success_tier) == ("SteamSpy failed", 0.0, "Flop")
    assert (rows[2].last_error, rows[2].success_tier, rows[2].data_complete) == ("Steam Store failed", None, False)


def test_preview_articles(spark, tmp_path):
    (tmp_path / "p.csv").write_text("app_id,app_name,source_url,publication,date,text\n1,A,u,P,2023-06-15,Nice\n2,B,u,P,,Old\n")
    rows = readers.read_preview_articles(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.author_type, r.is_pre_release, r.sentiment_source) for r in rows] == [("critic", True, "preview_article")] * 2


def test_discovery_quota(spark):
    rows = [(i, f"g{i}", 1000 - i, 10, 100 if i % 4 else 900_000) for i in range(40)] * 2
    found = spark.createDataFrame(rows, "app_id long, name string, total_reviews long, positive_reviews long, owners_midpoint long")
    known = spark.createDataFrame([(0, "training"), (1, "validation")], "app_id long, split string")
    picked = registry.discover(found, known, min_reviews=970, k=5).collect()
    assert [r.app_id for r in picked] == [2, 3, 4, 5, 8]
    added = registry.add_to_registry(known, spark.createDataFrame(picked), "validation")
    assert added.where("discovered").count() == 5


def odd_table(rng, rows):
    parts = ["a", "é🎉", "\n", '"', '""', ",", "\r\n", " ", "long " * 9, ""]
    return [(str(k), "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for k in range(rows)]


@pytest.mark.parametrize("block_bytes", [1, 7, 64, 100_000])
def test_blocks_of_a_file_give_its_records(spark, tmp_path, block_bytes):
    rng, want = random.Random(block_bytes), []
    for number in range(3):
        rows = odd_table(rng, [0, 40, 300][number] if block_bytes > 1 else 12)
        with open(tmp_path / f"f {number}.csv", "w", newline="", encoding="utf-8") as file:
            writer = csv.writer(file, lineterminator="\n", quoting=csv.QUOTE_ALL if number == 1 else csv.QUOTE_MINIMAL)
            writer.writerow(["id", "text"] if number else ["text", "id"])
            writer.writerows(rows if number else [r[::-1] for r in rows])
        want += [(k, t or None) for k, t in rows]
    got = readers.split_csv(spark, str(tmp_path), ["id", "text", "absent"], block_bytes=block_bytes)
    found = got.collect()
    assert sorted(((r.id, r.text) for r in found), key=repr) == sorted(want, key=repr) and {r.absent for r in found} == {None}
    again = sorted((r.path, r.block, r.place, r.id) for r in found)
    assert [int(r[3]) for r in again if "f 2" in r[0]] == list(range(300 if block_bytes > 1 else 12))


def test_a_tree_hash_is_that_of_its_blocks(spark, tmp_path):
    contents = {"a.csv": b"x" * 1000, "b.csv": b"y", "c.csv": bytes(range(256)) * 10}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    for size in (64, 1000, 10**6):
        found = {r.path.rsplit("/", 1)[1]: r.hash for r in manifest.tree_hashes(spark, str(tmp_path), block_bytes=size).collect()}
        for name, content in contents.items():
            blocks = [content[k : k + size] for k in range(0, max(1, len(content)), size)]
            assert found[name] == hashlib.md5("".join(hashlib.md5(b).hexdigest() for b in blocks).encode()).hexdigest()
