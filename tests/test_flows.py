"""The flows end to end on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sentigrade.plans import flows


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        (
            f"game {k % 8}", k % 8, k, ("early_access", "post_release")[k // 8 % 2],
            ("good fun great " if k % 3 else "bad dull broken ") + f"word{k % 7} word{k % 5} " * (1 + k % 4), int(k % 3 > 0),
        )
        for k in range(240)
    ]
    df = spark.createDataFrame(rows, "game_name string, app_id bigint, row_id bigint, review_type string, review_text string, positive int")
    return df.withColumn("cleaned_text", F.col("review_text"))


def test_train_and_compare(spark, reviews, tmp_path):
    path, models = str(tmp_path / "results"), ["NaiveBayes", "LogisticRegression"]
    tables = flows.train_and_compare(reviews, path, models, seeds=(0, 1), k=2, features=50, parallelism=2)
    assert tables["friedman"].columns and tables["average_ranks"].count() == 2
    assert tables["wilcoxon"].count() == 1 and {r.position for r in tables["model_summary"].collect()} == {1, 2}
    assert spark.read.parquet(path).count() == 8
    again = flows.train_and_compare(reviews, path, models, seeds=(0, 1), k=2)
    assert spark.read.parquet(path).count() == 8 and again.keys() == tables.keys()
    alone = flows.train_and_compare(reviews, str(tmp_path / "one"), models[:1], k=2, features=50)
    assert list(alone) == ["model_summary"]
    flows.save_tables(alone, str(tmp_path / "tables"))
    assert spark.read.option("header", True).csv(str(tmp_path / "tables" / "model_summary")).count() == 1


def score(df):
    good = F.col("review_text").contains("good")
    return df.withColumns({"predicted": good.cast("int"), "probability": F.when(good, 0.9).otherwise(0.2) + F.col("row_id") / 1e4})


@pytest.fixture(scope="module")
def success(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"app_id": range(40), "app_name": [f"game {k}" for k in range(40)]})
    table["owners_midpoint"] = rng.uniform(1e3, 1e6, 40)
    table["steamspy_owners_min"] = (table["owners_midpoint"] // 2).astype("int64")
    table["steam_metacritic_score"] = rng.integers(40, 95, 40)
    table["steamspy_avg_playtime"] = rng.integers(10, 900, 40)
    table["review_score"] = rng.uniform(0, 1, 40)
    table["estimated_revenue_usd"] = np.exp(rng.normal(11, 2, 40))
    table["success_tier"] = np.where(table["estimated_revenue_usd"] > 6e4, "Hit", "Flop")
    table["steam_current_price_usd"] = rng.uniform(0, 40, 40)
    table["steam_release_date"] = [f"20{10 + k % 14}-0{1 + k % 9}-11" for k in range(40)]
    return spark.createDataFrame(table)


def test_validate(reviews, success):
    tables = flows.validate(reviews, score, success, as_of_year=2024)
    games = tables["game_sentiment"].collect()
    assert len(games) == 8 and tables["accuracy"].where("is_pooled = 1").first().n_reviews == 120
    assert tables["hypothesis"].first().n_samples == 8
    assert {"success", "metadata", "top_metadata"} <= set(tables) and tables["top_metadata"].count() <= 15


def test_predict_success(spark, success):
    rng = np.random.default_rng(4)
    names = ["ea_predicted_positive_ratio", "ea_avg_positive_probability", "ea_actual_positive_ratio", "ea_sentiment_std",
             "ea_mean_review_length", "ea_long_review_ratio", "ea_neg_pos_length_ratio"]
    table = pd.DataFrame(rng.uniform(0.1, 1, (40, len(names))), columns=names)
    table["app_id"], table["game_name"], table["ea_review_count"] = range(40), [f"game {k}" for k in range(40)], rng.integers(5, 500, 40)
    tables = flows.predict_success(spark.createDataFrame(table), success, 2024, tier_folds=4)
    assert tables["ablation"].count() == 5 and tables["tiers"].count() == 40 and tables["revenue"].count() == 40
    assert tables["tier_confusion"].agg(F.sum("n")).first()[0] == 40
    assert tables["revenue_scores"].first().n == 40 and tables["tier_report"].count() > 0
