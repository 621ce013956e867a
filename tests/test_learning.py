"""Folds, TF-IDF, cross-validation, outcome models and saved predictors."""

import dataclasses
import json
import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sentigrade.learning import bayes, boosting, by_feature, held_out, features, folds, left_out, outcomes, runner, scoring
from sentigrade.learning.classifiers import TrainingCounts, make_classifier, row_weight
from sentigrade.operators import relational
from sentigrade.plans import flows
from sentigrade.workload import queries_learning

GOOD, BAD = "good great lovely fun", "bad awful boring broken"


@pytest.fixture(scope="module")
def reviews(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        positive = int(i % 3 != 0)
        words = rng.choice((GOOD if positive else BAD).split(), 4).tolist() + rng.choice(["game", "level", "music"], 4).tolist()
        rows.append((i, " ".join(words), positive, f"g{i % 6}", i % 6, "early_access" if i % 2 else "post_release"))
    return spark.createDataFrame(
        rows, "row_id long, cleaned_text string, positive int, game_name string, app_id long, review_type string"
    ).withColumn("review_text", F.col("cleaned_text"))


@pytest.mark.parametrize("name, models", [("gbt_cv", 1), ("gbt2_cv", 1), ("cv_results", 5)])
def test_queries_run_five_folds_of_their_models(monkeypatch, name, models):
    asked = {}

    def run_cv(reviews, path, models, **options):
        asked.update(options, models=models)
        raise KeyError

    monkeypatch.setattr(queries_learning, "run_cv", run_cv)
    monkeypatch.setattr(queries_learning, "scratch_folder", lambda *_: "")
    monkeypatch.setattr(queries_learning, "labelled", lambda t: None)
    with pytest.raises(KeyError):
        getattr(queries_learning, name)(SimpleNamespace(spark=None))
    assert asked["k"] == 5 and len(set(asked["models"])) == models


def test_a_query_leaves_out_one_game_at_a_time(monkeypatch):
    asked = []
    monkeypatch.setattr(queries_learning, "stored_matrix", lambda t: None)
    monkeypatch.setattr(outcomes, "feature_columns", lambda *_: [])
    monkeypatch.setattr(outcomes, "loo_classify", lambda *a, folds=None, **o: asked.append(folds))
    queries_learning.tier_loo(None)
    assert asked == [None]


def test_folds_partition_every_label(reviews):
    dealt = folds.stratified_folds(reviews, "row_id", "positive", 5, 1).toPandas()
    sizes = dealt.groupby(["positive", "fold"]).size()
    assert sizes.sum() == 90 and sizes.loc[0].tolist() == [6] * 5 and sizes.loc[1].tolist() == [12] * 5
    other = folds.stratified_folds(reviews, "row_id", "positive", 5, 2).toPandas()
    assert (dealt.sort_values("row_id")["fold"].tolist()) != other.sort_values("row_id")["fold"].tolist()


def test_pipeline_features_equal_the_table_form(reviews):
    terms = features.with_terms(reviews)
    stages = features.TfidfFeatures().fit(terms)
    vocabulary = stages[0].vocabulary
    vectors = {r.row_id: r.features for r in features.apply_stages(terms, stages).collect()}
    table = features.tfidf_table(reviews, "row_id", "cleaned_text").collect()
    assert sum(v.numNonzeros() for v in vectors.values()) == len(table)
    for r in table:
        assert vectors[r.row_id][vocabulary.index(r.term)] == pytest.approx(r.weight)


def test_weights_sum_to_the_expected_total():
    counts = TrainingCounts(30, 60)
    assert "CASE WHEN" in str(row_weight("SVM", "positive", counts))
    with pytest.raises(ValueError):
        make_classifier("Nothing", "positive", 0, 1.0)


def test_cross_validation_resumes_and_models_are_saved(spark, reviews, tmp_path):
    path, models = str(tmp_path / "results"), str(tmp_path / "models")
    first = runner.run_cv(reviews, path, ["NaiveBayes"], seeds=(3,), k=2, models_path=models)
    assert first.count() == 2
    both = runner.run_cv(reviews, path, ["NaiveBayes", "LogisticRegression"], seeds=(3,), k=2)
    assert both.count() == 4
    assert both.agg(F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).first()[0] == 180
    assert both.agg(F.min("f1_score")).first()[0] > 0.9
    model = scoring.load_predictor(spark, models)
    scored = scoring.score(model, reviews)
    assert scored.where("predicted = positive").count() >= 88
    assert set(scored.columns) == {*reviews.columns, "probability", "predicted"}
    with pytest.raises(FileNotFoundError):
        scoring.load_predictor(spark, models, "SVM")
    tables = flows.compare_models(both, ["NaiveBayes", "LogisticRegression"])
    assert tables["wilcoxon"].count() == 1 and tables["model_summary"].count() == 2


def test_any_batch_predictor(reviews):
    def load():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([1.0 if "good" in t else 0.5 for t in texts])

        return predict

    scored = scoring.score_with(load, reviews, "cleaned_text")
    expected = reviews.where(F.col("cleaned_text").contains("good")).count()
    assert scored.agg(F.sum("predicted")).first()[0] == expected


@pytest.fixture(scope="module")
def games():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3))
    table = pd.DataFrame(x, columns=["a", "b", "c"])
    table["constant"] = 0.1
    table["revenue"] = np.expm1(np.abs(3 + x @ [1, -2, 0.5] + rng.normal(size=30) / 5))
    table["tier"] = np.where(x[:, 0] > 0, "Hit", "Flop")
    table["app_id"] = range(30)
    return table


def brute_ridge(x, y, new, alpha=1.0):
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-12] = 1
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return ((new - mean) / scale) @ w + y.mean()


def test_loo_ridge_equals_refits(spark, games):
    columns = ["a", "b", "c", "constant"]
    df = spark.createDataFrame(games)
    extra = spark.createDataFrame([(None, 1.0, 1.0, 0.1, 5.0, "Hit", 99), (1.0, 1.0, 1.0, 0.1, 0.0, "Hit", 98)], df.schema)
    found = outcomes.loo_ridge(df.union(extra), "app_id", columns, "revenue").toPandas().sort_values("app_id")
    x, y = games[columns].to_numpy(), np.log1p(games["revenue"].to_numpy())
    expected = [brute_ridge(np.delete(x, i, 0), np.delete(y, i), x[i]) for i in range(30)]
    assert len(found) == 30
    assert np.allclose(found["predicted_log"], expected, atol=1e-9)
    scores = outcomes.revenue_scores(outcomes.loo_ridge(df, "app_id", columns, "revenue")).first()
    errors = np.abs(games["revenue"] - np.maximum(np.expm1(expected), 0))
    assert scores.mae == pytest.approx(errors.mean())
    assert scores.r2 == pytest.approx(1 - ((y - expected) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert outcomes.loo_ridge(df.limit(4), "app_id", columns, "revenue") is None


def test_tier_prediction_and_new_games(spark, games):
    df = spark.createDataFrame(games)
    found = outcomes.loo_classify(df, "app_id", ["a", "b"], "tier", folds=3).toPandas()
    assert sorted(found["app_id"]) == list(range(30)) and found["correct"].mean() > 0.7
    each = outcomes.loo_classify(df.where("app_id < 12"), "app_id", ["a", "b"], "tier")
    assert each.count() == 12
    single = df.withColumn("tier", F.lit("Hit"))
    same = outcomes.loo_classify(single, "app_id", ["a", "b"], "tier", folds=3)
    assert same.where("correct").count() == 30
    new = outcomes.predict_new(df, df, "app_id", ["a", "b"], "tier", "revenue").toPandas().sort_values("app_id")
    assert (new["prob_moderate"] == 0).all() and (new["prob_blockbuster"] == 0).all()
    assert np.allclose(new["prob_flop"] + new["prob_hit"], 1)
    x, y = games[["a", "b"]].to_numpy(), np.log1p(games["revenue"].to_numpy())
    assert np.allclose(new["predicted_revenue_usd"], np.maximum(np.expm1(brute_ridge(x, y, x)), 0))


def test_logistic_scaling_matches_a_population_scaled_fit(spark, games):
    """The penalty correction makes sample scaling equal to population scaling."""
    x = games[["a", "b"]].to_numpy()
    label = (games["tier"] == "Hit").to_numpy().astype(float)
    rows = spark.createDataFrame([(float(t), r.tolist()) for t, r in zip(label, x)], "_label double, _x array<double>")
    model = outcomes._tier_model(outcomes._with_vector(rows), 30, 2).stages[-1]
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros(2), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w -= 0.02 * (z.T @ (p - label) + w)
        b -= 0.02 * (p - label).sum()
    expected = w * math.sqrt(30 / 29)
    assert np.allclose(model.coefficients.toArray(), expected, rtol=0.02, atol=0.01)


def slope_of(model, x, y, penalty=1.0):
    """Gradient of the penalised loss at a fit, written out row by row."""
    z = (x - model.mean) / model.scale
    total = np.zeros_like(model.theta)
    for row, label in zip(np.hstack([z, np.ones((len(z), 1))]), y):
        logits = model.theta @ row
        if len(logits) == 1:
            error = np.array([1 / (1 + np.exp(-logits[0])) - (label == model.classes[1])])
        else:
            p = np.exp(logits - logits.max())
            error = p / p.sum() - (label == model.classes)
        total += error[:, None] * row
    total[:, :-1] += penalty * model.theta[:, :-1]
    return total


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_refits_reach_the_optimum_of_the_rows_left(classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(40, 5)) * [1, 10, 0.1, 1, 0]
    y = np.argmax(x[:, :1] * np.arange(classes) + rng.gumbel(size=(40, classes)), axis=1)
    y[0] = classes + 3  # a class of one row: leaving it out leaves the class out
    for number, model in held_out.refits(x, y, np.arange(40), np.arange(40)):
        rest = np.arange(40) != number
        assert np.array_equal(model.classes, np.unique(y[rest]))
        assert np.abs(slope_of(model, x[rest], y[rest])).max() < 1e-7
        alone = held_out.fit(x[rest], y[rest])
        assert np.allclose(alone.logits(x) - alone.logits(x)[:, :1], model.logits(x) - model.logits(x)[:, :1], atol=1e-6)
    same = held_out.fit(x, np.ones(40, dtype=int))
    assert (same.predict(x) == 1).all()


def test_separated_classes_have_a_fit():
    x = np.vstack([np.full((20, 1), -5.0), np.full((20, 1), 5.0), np.full((20, 1), 100.0)])
    y = np.repeat([0, 1, 2], 20)
    model = held_out.fit(x, y)
    assert np.abs(slope_of(model, x, y)).max() < 1e-6 and (model.predict(x) == y).all()


@pytest.fixture(scope="module")
def tiers(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(36, 2))
    names = np.array(["Flop", "Moderate", "Hit", "Blockbuster"])
    table = pd.DataFrame({"app_id": range(36), "a": x[:, 0], "b": x[:, 1], "tier": names[np.clip((x[:, 0] + 1.5).astype(int), 0, 3)]})
    return table, spark.createDataFrame(table)


def test_leaving_out_rows_equals_models_trained_alone(tiers):
    table, df = tiers
    got = outcomes.loo_classify(df.repartition(3), "app_id", ["a", "b"], "tier").toPandas().set_index("app_id")
    x = table[["a", "b"]].to_numpy()
    names = list(outcomes.values.TIERS)
    y = np.array([names.index(t) for t in table["tier"]])
    for k in range(36):
        rest = np.arange(36) != k
        want = names[int(held_out.fit(x[rest], y[rest]).predict(x[k : k + 1])[0])]
        assert got.loc[k, "predicted_tier"] == want and got.loc[k, "correct"] == (want == table["tier"][k])


def test_folds_by_refits_equal_folds_by_the_cluster(tiers, monkeypatch):
    _, df = tiers
    columns = ("app_id", ["a", "b"], "tier")
    here = {r.app_id: r.predicted_tier for r in outcomes.loo_classify(df, *columns, folds=4).collect()}
    monkeypatch.setattr(outcomes, "MOST_CELLS", 10)
    there = {r.app_id: r.predicted_tier for r in outcomes.loo_classify(df, *columns, folds=4).collect()}
    assert here.keys() == there.keys() and sum(here[k] != there[k] for k in here) <= 1
    with pytest.raises(ValueError, match="number of folds"):
        outcomes.loo_classify(df, *columns)


def plain_vocabulary(texts, size=10_000):
    counts = [Counter(words + [" ".join(p) for p in zip(words, words[1:])]) for words in (t.split() for t in texts)]
    tf, df = sum(counts, Counter()), Counter(t for c in counts for t in c)
    terms = [t for t in tf if 2 <= df[t] <= 0.95 * len(texts)]
    return {t: math.log((len(texts) + 1) / (df[t] + 1)) + 1 for t in sorted(terms, key=lambda t: (-tf[t], t))[:size]}


def test_fold_statistics_by_subtraction_equal_counts_of_each_part(spark, reviews):
    rows = {r.row_id: r.cleaned_text for r in reviews.collect()}
    terms = features.with_terms(reviews.select("row_id", "cleaned_text"))
    assigned = terms.withColumn("folds", F.array((F.col("row_id") % 3).cast("int"), (F.col("row_id") % 7 % 3).cast("int")))
    statistics = features.fold_statistics(assigned, "row_id", 2, 3)
    for place, fold_of in enumerate((lambda k: k % 3, lambda k: k % 7 % 3)):
        for fold in range(3):
            train = [t for k, t in rows.items() if fold_of(k) != fold]
            found = features.Vocabulary.of_fold(statistics, place, fold, 3, len(train), 40)
            want = plain_vocabulary(train, 40)
            assert list(found.terms) == list(want) and np.allclose(found.weights, list(want.values()))
    vectors = {r.row_id: r.features for r in found.vectors(terms, ["row_id"]).collect()}
    staged = features.apply_stages(terms, found.stages())
    assert all(np.allclose(vectors[r.row_id].toArray(), r.features.toArray()) for r in staged.collect()) and len(vectors) == 90


def test_features_of_counts_equal_those_of_words(spark, reviews):
    words = reviews.select("row_id", features.word_array(F.col("cleaned_text")).alias("words"))
    terms = features.with_terms(reviews).select("terms").collect()
    known = sorted({t for r in terms for t in r.terms})
    one, two = (features.Vocabulary(tuple(known[k::3][::-1]), np.arange(1.0, len(known[k::3]) + 1)) for k in (0, 1))
    both = features.Vocabulary.union([one, two])
    counted = both.counted(words, ["row_id"], "words", True)
    for vocabulary in (one, two):
        want = {r.row_id: r.features for r in vocabulary.vectors(words, ["row_id"], "words", True).collect()}
        found = {r.row_id: r.features for r in vocabulary.vectors_of_counts(counted, ["row_id"], both).collect()}
        assert found == want


def test_a_saved_model_scores_without_python_for_each_row(spark, reviews):
    vocabulary = features.Vocabulary(("a",), np.ones(1))
    model = features.text_model(vocabulary, features.Normalizer(inputCol="features", outputCol="prediction"))
    plan = model.transform(reviews)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "PythonUDF" not in plan and "EvalPython" not in plan


def test_copies_are_dropped_before_texts_are_cleaned(spark):
    rows = [(1, "a game I liked <b>x</b>", None, 1), (1, "a game I liked <b>x</b>", 1, 2), (1, "A game I liked", 1, 3), (1, "<b>short</b>", 1, 4), (2, None, 1, 5), (2, "a game I liked", 0, 6)]
    df = spark.createDataFrame([(*r, f"f{r[0]}") for r in rows], "app_id long, review_text string, positive int, row_id long, source_file string")
    before = relational.dedup_reviews(relational.clean_reviews(df))
    assert sorted(relational.distinct_reviews(df).collect()) == sorted(before.select(*df.columns, "cleaned_text").collect())
    found = relational.distinct_reviews(df, labelled=True)
    assert sorted(r.row_id for r in found.collect()) == sorted(r.row_id for r in before.where("positive IS NOT NULL").collect()) == [3, 6]


def test_no_python_for_each_row_in_the_features(spark, reviews):
    terms = features.with_terms(reviews.select("row_id", "cleaned_text"))
    plan = features.Vocabulary(("a",), np.ones(1)).vectors(terms, ["row_id"])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "PythonUDF" not in plan and "EvalPython" not in plan


def sparse_of(dense):
    row, feature = np.nonzero(dense)
    return boosting.Sparse.of(len(dense), row, feature, dense[row, feature])


def plain_split(dense, g, h, shape):
    """Gain of the best split over all features and all values, row by row."""
    score = lambda a, b: a * a / (b + shape.penalty + 1e-12)
    best = 0.0
    for f in range(dense.shape[1]):
        for value in np.unique(dense[:, f])[1:] if (dense[:, f] == 0).any() else np.unique(dense[:, f]):
            right = dense[:, f] >= value
            if min(right.sum(), (~right).sum()) >= max(1, shape.least_rows) and min(h[right].sum(), h[~right].sum()) >= shape.least_curvature:
                best = max(best, score(g[right].sum(), h[right].sum()) + score(g[~right].sum(), h[~right].sum()) - score(g.sum(), h.sum()))
    return best


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(20):
        dense = rng.integers(0, 4, (60, 6)) * rng.random((60, 6)).round(1) * (rng.random((60, 6)) < 0.4)
        dense = np.ceil(dense * 2)  # few values, each its own bin
        g, h = rng.normal(size=60), np.full(60, 0.25)
        shape = boosting.Shape(leaves=2, least_curvature=0.5)
        x = sparse_of(dense)
        tree, node = boosting.grow(x, boosting.Bins(x), g, h, np.ones(60, dtype=bool), np.ones(6, dtype=bool), shape)
        assert len(tree.feature) == 3
        right = dense[:, tree.feature[0]] >= tree.least[0]
        assert np.array_equal(node == tree.right[0], right)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1 + 1e-12)
        gain = score(right) + score(~right) - score(np.ones(60, dtype=bool))
        assert gain == pytest.approx(plain_split(dense, g, h, shape))


@pytest.mark.parametrize("name", ["GradientBoosting", "GradientBoosting31"])
def test_boosters_keep_their_limits_and_learn(name):
    rng = np.random.default_rng(6)
    dense = rng.random((1500, 30)) * (rng.random((1500, 30)) < 0.3)
    y = ((dense[:, 0] > 0.5) ^ (dense[:, 1] > 0) ^ (rng.random(1500) < 0.05)).astype(float)
    x, shape = sparse_of(dense), boosting.SHAPES[name]
    trees = boosting.boost(x, y, np.ones(1500), shape, 1)
    assert len(trees) == 100
    for tree in trees:
        leaves = [k for k, f in enumerate(tree.feature) if f < 0]
        depth = {0: 0}
        for k, (a, b) in enumerate(zip(tree.left, tree.right)):
            if a >= 0:
                depth[a] = depth[b] = depth[k] + 1
        assert len(leaves) <= shape.leaves and max(depth.values()) <= shape.depth
    if name == "GradientBoosting31":
        assert max(sum(f < 0 for f in t.feature) for t in trees) == 31 and max(sum(f < 0 for f in t.feature) for t in trees[:3]) == 31
    total = boosting.margins(trees, x)
    assert ((total > 0) == y).mean() > 0.93
    assert np.allclose(total[:50], boosting.margins(trees, sparse_of(dense[:50])))


def test_all_models_run_and_boosters_are_saved(spark, reviews, tmp_path):
    results = runner.run_cv(reviews, str(tmp_path / "r"), runner.MODELS, seeds=(0, 1), k=2, models_path=str(tmp_path / "m"), parallelism=2)
    rows = results.collect()
    assert len(rows) == 5 * 2 * 2
    # 45 rows leave the booster of 20 rows a leaf nothing to split.
    assert min(r.accuracy for r in rows if r.model != "GradientBoosting31") > 0.9
    for name in ("GradientBoosting", "GradientBoosting31"):
        model = scoring.load_predictor(spark, str(tmp_path / "m"), name, seed=1, fold=1)
        scored = scoring.score(model, reviews)
        assert scored.count() == 90 and (name == "GradientBoosting31" or scored.where("predicted = positive").count() > 80)
        assert set(scored.columns) == {*reviews.columns, "probability", "predicted"}


def test_no_row_for_each_text_and_term_is_shuffled(spark, reviews):
    table = features.tfidf_table(reviews, "row_id", "cleaned_text")
    scored = bayes.fold_predictions(reviews, "row_id", "positive", "cleaned_text", 2)
    terms = reviews.select("row_id", features.word_array(F.col("cleaned_text")).alias("words"), F.array(F.lit(0)).alias("folds"))
    sums = features.fold_statistics(terms, "row_id", 1, 2, "words", True)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (table, scored, sums)]
    assert "Exchange" not in plans[0] + plans[1] and "hashpartitioning(row_id" not in plans[2]


def test_pairs_end_with_the_text_also_where_a_key_is_repeated(spark):
    rows = [(1, "aa bb"), (1, "cc dd"), (2, "aa bb cc"), (3, "bb cc dd zz"), (4, None)]
    found = features.tfidf_table(spark.createDataFrame(rows, "k bigint, t string"), "k", "t").collect()
    got = {(r.k, r.term): (r.tf, r.df) for r in found}
    assert got[1, "aa bb"] == (1, 2) and (1, "bb cc") not in got and got[2, "bb cc"] == (1, 2) and got[3, "cc dd"] == (1, 2)
    assert not any(t == "zz" for _, t in got) and {k for k, _ in got} == {1, 2, 3}


@pytest.mark.parametrize("tiers_seen", [4, 2])
def test_leaving_out_rows_of_a_large_table_equals_refits(spark, monkeypatch, tiers_seen):
    rng = np.random.default_rng(11)
    x = np.hstack([rng.normal(size=(600, 3)), np.zeros((600, 2))])
    x[:, 3], x[7, 4] = x[:, 0] + x[:, 1], 1.0  # a sum of others, and a column that one row alone fills
    names = np.array(["Flop", "Moderate", "Hit", "Blockbuster"])
    at = np.clip((x[:, 0] + rng.normal(size=600) * 0.7 + 1).astype(int), 0, tiers_seen - 1)
    table = pd.DataFrame(x, columns=list("abcde")).assign(app_id=range(600), tier=names[at])
    if tiers_seen == 2:
        table.loc[3, "tier"] = "Hit"  # the only one of its class
    df, columns = spark.createDataFrame(table), ("app_id", list("abcde"), "tier")
    want = {r.app_id: r.predicted_tier for r in outcomes.loo_classify(df, *columns).collect()}
    monkeypatch.setattr(outcomes, "MOST_LEFT_OUT", 100)
    got = {r.app_id: r.predicted_tier for r in outcomes.loo_classify(df, *columns, any_size=True).collect()}
    assert got == want and len(got) == 600


def labelled_vectors(spark, dense, y):
    rows = [(float(t), 1.0, Vectors.sparse(dense.shape[1], [int(i) for i in np.flatnonzero(r)], r[r != 0].tolist())) for t, r in zip(y, dense)]
    return spark.createDataFrame(rows, ["positive", "weight", "features"])


def test_boosters_fit_all_rows_of_a_large_table(spark):
    n = 21_000
    dense = (np.arange(n)[:, None] % [2, 3] == 0).astype(float)
    y = (np.arange(n) % 7 < 3) | (np.arange(n) % 2 == 0)
    df = labelled_vectors(spark, dense, y)
    shape = boosting.Shape(trees=1, rows=1.0, columns=1.0, leaves=2, penalty=0.0)
    for most in (boosting.MOST_ENTRIES, 1000):
        trees = json.loads(boosting.BoostedClassifier(shape, "positive", 0, most).fit(df).getOrDefault("trees"))
        assert trees[0]["feature"][0] == 0
        for side, own in (("left", dense[:, 0] == 0), ("right", dense[:, 0] == 1)):
            want = 0.1 * (y[own] - 0.5).sum() / (0.25 * own.sum())
            assert trees[0]["value"][trees[0][side][0]] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("name", ["GradientBoosting", "GradientBoosting31"])
def test_trees_by_feature_equal_those_of_one_task(spark, monkeypatch, name):
    monkeypatch.setattr(by_feature, "GROUP_ENTRIES", 2000)
    monkeypatch.setattr(by_feature, "ROUND", 8)
    rng = np.random.default_rng(6)
    dense = np.ceil(rng.random((900, 12)) * 64) / 64 * (rng.random((900, 12)) < 0.3)
    y = ((dense[:, 0] > 0.5) ^ (dense[:, 1] > 0) ^ (rng.random(900) < 0.05)).astype(float)
    # Enough rows a leaf that no two splits are equally good.
    shape = dataclasses.replace(boosting.SHAPES[name], trees=2, leaves=7, least_rows=30)
    x = sparse_of(dense)
    want = boosting.boost(x, y, np.ones(900), shape, 1)
    found = boosting.BoostedClassifier(shape, "positive", 1, 100).fit(labelled_vectors(spark, dense, y).coalesce(1))
    found = [boosting.Tree(**t) for t in json.loads(found.getOrDefault("trees"))]
    assert [t.feature for t in found] == [t.feature for t in want] and [t.least for t in found] == [t.least for t in want]
    assert np.allclose(boosting.margins(found, x), boosting.margins(want, x))
    assert len(want[0].feature) == 13


def test_few_rows_of_separated_classes_are_left_open(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.hstack([rng.normal(size=(4000, 2)) * 3, (rng.random((4000, 2)) < 0.01).astype(float)])
    y = np.digitize(x[:, 0] + 0.3 * rng.normal(size=4000), [-2, 0, 2])

    def summed(rows, make, combine=np.add):
        return combine.reduce([make(x[s : s + 500], y[s : s + 500], None) for s in range(0, 4000, 500)])

    monkeypatch.setattr(left_out, "_summed", summed)
    counts = SimpleNamespace(collect=lambda: [{"_y": k, "count": int((y == k).sum())} for k in range(4)])
    whole = left_out.Whole(SimpleNamespace(groupBy=lambda c: SimpleNamespace(count=lambda: counts)), 4)
    farthest, softest = whole.reach(left_out._scaled(x, whole.mean, whole.scale)).max(), np.linalg.eigvalsh(whole.bend)[0]
    first, proven = left_out._own_models(whole, x, y, farthest, softest)
    assert (~proven).sum() < 100
    second, again = left_out._own_models(whole, x, y, farthest, softest, left_out.Bounds.of(None, whole))
    assert (~again).sum() < (~proven).sum()
    for k in [*np.flatnonzero(again & ~proven)[:15], *np.flatnonzero(proven)[:5]]:
        rest = np.arange(4000) != k
        assert held_out.fit(x[rest], y[rest]).predict(x[k : k + 1])[0] == (second if again[k] else first)[k]


def test_solvers_get_few_tasks_and_long_texts_small_parts():
    assert [runner._partitions(n, 6) for n in (0, 900, 20_000, 1_200_000)] == [1, 1, 4, 60]
    words = pa.array([["a"] * n for n in (250_000, 100_000, 10, 10, 400_000)] + [None, []])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), words], ["k", "words"])
    parts = [part.column(0).to_pylist() for part in features._slices([batch], 1)]
    assert parts == [[0], [1, 2, 3], [4], [5, 6]]
