"""Queries over folds, text features, classifiers, outcome prediction and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..learning import bayes, outcomes, scoring
from ..learning.classifiers import MODELS
from ..learning.features import tfidf_table
from ..learning.folds import class_weights, stratified_folds
from ..learning.runner import run_cv
from ..operators import metrics, relational
from ..session import scratch_folder
from ..streaming import reviews as streams
from .queries_aggregates import _BINARY, _COUNTS, _SCORE, _TOTAL, GAME_DOUBLES, game_table_sql, scored, stored_matrix
from .queries_tables import CLEAN
from .registry import HELPERS, query


HELPERS["scored_long_reviews"] = _SCORE.format(total=_TOTAL.format(c="cleaned_text"), source="long_reviews")


def labelled(t):
    """The built reviews a model can learn from."""
    return relational.distinct_reviews(t.reviews, labelled=True)


def built(t):
    return relational.distinct_reviews(t.reviews)


# --- Text features ------------------------------------------------------------------------------


@query(
    "stratified_folds",
    """SELECT row_id, positive, CAST((row_number() OVER (PARTITION BY positive ORDER BY md5('7:' || row_id), row_id) - 1) % 5 AS INT) AS fold
       FROM labelled_reviews""",
)
def folds(t):
    return stratified_folds(t.labelled_reviews.select("row_id", "positive"), "row_id", "positive", 5, 7)


@query(
    "class_weights",
    """SELECT positive, count(*) AS n, sum(count(*)) OVER () / (2 * count(*)) AS balanced_weight,
              (sum(count(*)) OVER () - count(*)) / count(*) AS ratio_weight FROM labelled_reviews GROUP BY positive""",
    "balanced_weight ratio_weight",
)
def weights(t):
    return class_weights(t.labelled_reviews, "positive")


@query(
    "tfidf",
    r"""WITH w AS (SELECT row_id, regexp_extract_all(cleaned_text, '\w\w+') AS w FROM built_reviews),
          terms AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
          counts AS (SELECT row_id, term, count(*) AS tf FROM terms GROUP BY row_id, term),
          vocabulary AS (SELECT term, count(*) AS df FROM counts GROUP BY term
                         HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM built_reviews)
                         ORDER BY sum(tf) DESC, term LIMIT 10000),
          weighted AS (SELECT row_id, term, tf, df,
                              (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM built_reviews)) / (1 + df)) + 1) AS x
                       FROM counts JOIN vocabulary USING (term))
       SELECT row_id, term, tf, df, x / sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS weight FROM weighted""",
    "weight",
)
def tfidf(t):
    return tfidf_table(built(t).select("row_id", "cleaned_text"), "row_id", "cleaned_text")


# --- Classifiers: every query trains on all labelled reviews ------------------------------------


def _cv(t, models, k=5, **options):
    path = scratch_folder(t.spark, "results")
    results = run_cv(labelled(t), path, models, seeds=(0,), k=k, parallelism=k, **options)
    return results.select("model", "seed", "fold", "f1_score", "accuracy", "precision", "recall", "tp", "tn", "fp", "fn")


@query("lr_cv")
def lr_cv(t):
    return _cv(t, ("LogisticRegression",))


@query("nb_cv")
def nb_cv(t):
    return _cv(t, ("NaiveBayes",))


@query(
    "nb_folds",
    rf"""WITH r AS (SELECT row_id, positive, cleaned_text FROM built_reviews WHERE positive IS NOT NULL),
          f AS (SELECT *, CAST((row_number() OVER (PARTITION BY positive ORDER BY md5('0:' || row_id), row_id) - 1) % 5 AS INT) AS fold FROM r),
          w AS (SELECT row_id, positive, fold, regexp_extract_all(cleaned_text, '\w\w+') AS w FROM f),
          terms AS (SELECT row_id, positive, fold,
                           unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
          counts AS (SELECT row_id, positive, fold, term, count(*) AS tf FROM terms GROUP BY ALL),
          models AS (SELECT m.fold AS model, count(*) AS n, count(*) FILTER (WHERE positive = 1) AS n1
                     FROM f JOIN (SELECT DISTINCT fold FROM f) m ON f.fold <> m.fold GROUP BY m.fold),
          sums AS (SELECT model, term, sum(tf) AS tf, count(*) AS df FROM counts JOIN models ON fold <> model GROUP BY model, term),
          vocabulary AS (SELECT model, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM sums JOIN models USING (model)
                         WHERE df >= 2 AND df <= 0.95 * n
                         QUALIFY row_number() OVER (PARTITION BY model ORDER BY tf DESC, term) <= 10000),
          raw AS (SELECT model, row_id, positive, fold, term, (1 + ln(tf)) * idf AS x FROM counts JOIN vocabulary USING (term)),
          weighted AS (SELECT * REPLACE (x / sqrt(sum(x * x) OVER (PARTITION BY model, row_id)) AS x) FROM raw),
          classes AS (SELECT v.model, v.term, coalesce(sum(x) FILTER (WHERE positive = 0), 0) AS s0, coalesce(sum(x) FILTER (WHERE positive = 1), 0) AS s1
                      FROM vocabulary v LEFT JOIN weighted t ON t.model = v.model AND t.term = v.term AND t.fold <> v.model GROUP BY v.model, v.term),
          odds AS (SELECT model, term, ln((s1 + 1) / (sum(s1) OVER p + count(*) OVER p)) - ln((s0 + 1) / (sum(s0) OVER p + count(*) OVER p)) AS odds
                   FROM classes WINDOW p AS (PARTITION BY model)),
          told AS (SELECT row_id, sum(x * odds) AS told FROM weighted JOIN odds USING (model, term) WHERE fold = model GROUP BY row_id),
          scored AS (SELECT fold, positive, CAST(ln(n1) - ln(n - n1) + coalesce(told, 0) > 0 AS INT) AS predicted
                     FROM f JOIN models ON fold = model LEFT JOIN told USING (row_id))
       SELECT fold, tp, tn, fp, fn, (tp + tn) / n AS accuracy, (p0 + p1) / 2 AS precision, (r0 + r1) / 2 AS recall, (f0 + f1) / 2 AS f1_score
       FROM ({_BINARY.format(source=f"SELECT fold, {_COUNTS} FROM scored GROUP BY fold")})""",
    "accuracy precision recall f1_score",
)
def nb_folds(t):
    return bayes.fold_results(labelled(t), "row_id", "positive", "cleaned_text")


@query("saved_model", "SELECT count(*) AS n_rows, count(*) AS n_equal FROM built_reviews")
def saved_model(t):
    """A model saved, found by its name and loaded scores every row as it did before."""
    path, models = scratch_folder(t.spark, "results"), scratch_folder(t.spark, "models")
    rows = labelled(t).select("row_id", "cleaned_text", "positive")
    run_cv(rows, path, ("LogisticRegression",), seeds=(0,), k=2, models_path=models)
    loaded = [scoring.load_predictor(t.spark, models, fold=fold) for fold in (0, 1)]
    again = f"{models}-again"
    scoring.save_predictor(loaded[0], again, "LogisticRegression", 0, 0)
    both = built(t).select("row_id", "cleaned_text")
    for name, model in (("first", loaded[0]), ("second", scoring.load_predictor(t.spark, again))):
        both = scoring.score(model, both).withColumnsRenamed({"probability": f"{name}_p", "predicted": name})
    same = (F.col("first_p") == F.col("second_p")) & (F.col("first") == F.col("second")) & F.col("first_p").between(0, 1)
    return both.agg(F.count("*").alias("n_rows"), F.count_if(same).alias("n_equal"))


@query("svm_cv")
def svm_cv(t):
    return _cv(t, ("SVM",))


@query("gbt_cv")
def gbt_cv(t):
    return _cv(t, ("GradientBoosting",))


@query("gbt2_cv")
def gbt2_cv(t):
    return _cv(t, ("GradientBoosting31",))


@query("cv_results")
def cv_results(t):
    """All models over two seeds and all folds, summarised as the comparison reads them."""
    path = scratch_folder(t.spark, "results")
    results = run_cv(labelled(t), path, MODELS, seeds=(0, 1), k=5, parallelism=5)
    return metrics.checkpoint_summary(results).drop("avg_train_time")


# --- Outcomes -----------------------------------------------------------------------------------


@query("tier_cv")
def tier_cv(t):
    m = stored_matrix(t)
    return outcomes.loo_classify(m, "app_id", outcomes.feature_columns("steam", m), folds=10)


@query("tier_loo")
def tier_loo(t):
    """Leave-one-out: one model for every game."""
    m = stored_matrix(t)
    return outcomes.loo_classify(m, "app_id", outcomes.feature_columns("steam", m), any_size=True)


@query("loo_ridge")
def loo_ridge(t):
    m = stored_matrix(t)
    return outcomes.loo_ridge(m, "app_id", outcomes.feature_columns("combined", m), "estimated_revenue_usd")


@query(
    "loo_ridge_one",
    """WITH r AS (SELECT app_id, CAST(ea_mean_review_length AS DOUBLE) AS x, ln(1 + estimated_revenue_usd) AS y
                  FROM matrix WHERE estimated_revenue_usd > 0 AND ea_mean_review_length IS NOT NULL),
            c AS (SELECT app_id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, avg(y) OVER () AS level FROM r),
            s AS (SELECT count(*) - 1 AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM c),
            one AS (SELECT c.*, m, (sx - x) / m AS mx, (sy - y) / m AS my, sxx - x * x AS xx, sxy - x * y AS xy FROM c CROSS JOIN s)
       SELECT app_id, level + y AS actual_log,
              level + my + (xy - m * mx * my) * m / ((xx - m * mx * mx) * (m + 1)) * (x - mx) AS predicted_log FROM one""",
    "actual_log predicted_log",
)
def loo_ridge_one(t):
    """One feature, where leaving out a row has a closed form."""
    found = outcomes.loo_ridge(stored_matrix(t), "app_id", ["ea_mean_review_length"], "estimated_revenue_usd")
    return found.select("app_id", "actual_log", "predicted_log")


@query("predict_new")
def predict_new(t):
    """Fit on the games with video comments, predict the others."""
    m = stored_matrix(t)
    train, new = m.where("yt_comment_count IS NOT NULL"), m.where("yt_comment_count IS NULL")
    return outcomes.predict_new(train, new.select(*t.game_features.columns))


@query("ablation")
def ablation(t):
    return outcomes.ablation(stored_matrix(t))


# --- Streams, compared with the batch result over the same tables -------------------------------


def _documents(t, **options):
    return streams.table_stream(t.spark, f"{t.folder}/documents.parquet", t.documents.schema, **options)


@query(
    "stream_ingest",
    f"""SELECT * FROM (SELECT doc_id AS row_id, {CLEAN.format(c="text")} AS cleaned_text FROM documents WHERE text IS NOT NULL)
        WHERE length(cleaned_text) > 10""",
)
def stream_ingest(t):
    output, checkpoint = scratch_folder(t.spark, "ingest"), scratch_folder(t.spark, "ingest-checkpoint")
    stream = _documents(t).select(F.col("doc_id").alias("row_id"), F.col("text").alias("review_text"))
    streams.ingest(stream, output, checkpoint).awaitTermination()
    schema = "row_id bigint, review_text string, cleaned_text string"
    return t.spark.read.schema(schema).parquet(output).select("row_id", "cleaned_text")


@query("stream_dedup", "SELECT DISTINCT lang AS app_id, sha256(text) AS text_digest FROM documents")
def stream_dedup(t):
    """Copies are dropped however far apart they arrive."""
    output, checkpoint = scratch_folder(t.spark, "dedup"), scratch_folder(t.spark, "dedup-checkpoint")
    stream = _documents(t).select(F.col("lang").alias("app_id"), F.col("text").alias("review_text"))
    streams.first_arrivals(stream, output, checkpoint, ["app_id"], "review_text").awaitTermination()
    return streams.read_arrivals(t.spark, output, "app_id string, text_digest string")


@query(
    "stream_sentiment",
    game_table_sql("scored_long_reviews"),
    GAME_DOUBLES,
)
def stream_sentiment(t):
    state, checkpoint = scratch_folder(t.spark, "state"), scratch_folder(t.spark, "state-checkpoint")
    labels = t.labels.select("doc_id", F.col("quality").alias("positive"))
    early = F.floor(F.col("doc_id") / 20) % 2 == 0
    stream = (
        _documents(t)
        .join(labels, "doc_id", "left")
        .select(
            F.col("source").alias("game_name"),
            F.when(early, "early_access").otherwise("post_release").alias("review_type"),
            F.col("text").alias("review_text"),
            "positive",
            F.col("doc_id").alias("row_id"),
            F.substring("source", 4, 9).cast("bigint").alias("app_id"),
        )
    )
    cleaned = relational.clean_reviews(stream)
    streams.maintain_sentiment(scored(cleaned), state, checkpoint).awaitTermination()
    return streams.current_sentiment(t.spark, state)
