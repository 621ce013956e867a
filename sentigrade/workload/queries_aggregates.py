"""Queries over sentiment features, distributions, run tables and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import TIERS
from ..learning.outcomes import METADATA_FEATURES
from ..learning.scoring import score_linear
from ..operators import aggregates, correlation, metrics, nonparametric, relational
from ..operators.ordering import average_rank
from ..session import materialize
from .queries_tables import CLEAN, WORDS, matrix, success_metrics
from .registry import HELPERS, query
from .views import MODELS

# Fixed word weights of the example scorer, in quarters so that sums are exact.
WORD_WEIGHTS = {
    "the": 0.5, "of": -0.75, "and": 0.25, "to": 0.75, "in": -0.5, "is": -0.25, "that": 0.5, "de": -0.5,
    "la": 0.75, "que": -0.25, "le": 0.25, "en": -0.5, "der": 0.75, "die": -0.5, "und": 0.25, "er": -0.75,
}
BIAS = 0.25


def scored(df, text="cleaned_text"):
    return score_linear(df, text, WORD_WEIGHTS, BIAS)


def scored_labelled(t):
    return scored_reviews(t).where("positive IS NOT NULL")


def scored_reviews(t):
    return scored(relational.distinct_reviews(t.reviews))


_CASES = " ".join(f"WHEN '{w}' THEN {v}e0" for w, v in WORD_WEIGHTS.items())
_TOTAL = (
    r"coalesce(list_sum(list_transform(string_split_regex({c}, '[ .,!?]+'), lambda w: CASE w "
    + _CASES
    + " ELSE 0e0 END)), 0e0) + 0.25e0"
)
_SCORE = (
    "SELECT * EXCLUDE (total), 1 / (1 + exp(-total)) AS probability, CAST(1 / (1 + exp(-total)) > 0.5 AS INT) AS predicted "
    "FROM (SELECT *, {total} AS total FROM {source})"
)
HELPERS["built_reviews"] = """
    SELECT * EXCLUDE (place) FROM (
      SELECT *, row_number() OVER (PARTITION BY app_id, review_text ORDER BY source_file, row_id) AS place FROM long_reviews)
    WHERE place = 1"""
HELPERS["scored_reviews"] = _SCORE.format(total=_TOTAL.format(c="cleaned_text"), source="built_reviews")
HELPERS["scored_comments"] = _SCORE.format(
    total=_TOTAL.format(c="cleaned_text"),
    source=f"(SELECT *, {CLEAN.format(c='text')} AS cleaned_text FROM comments WHERE text IS NOT NULL) WHERE length(cleaned_text) > 10",
)

_EARLY = "review_type = 'early_access'"


def _features_sql(prefix: str, noun: str, count: str, early: str) -> str:
    on = f"FILTER (WHERE {early})"
    pos, neg = (f"coalesce(avg(w) FILTER (WHERE {early} AND predicted = {v}), 0e0)" for v in (1, 0))
    return f"""count(*) {on} AS {prefix}_{count}, avg(predicted) {on} AS {prefix}_predicted_positive_ratio,
        avg(probability) {on} AS {prefix}_avg_positive_probability, stddev_pop(probability) {on} AS {prefix}_sentiment_std,
        avg(w) {on} AS {prefix}_mean_{noun}_length, stddev_pop(w) {on} AS {prefix}_std_{noun}_length,
        avg(CAST(w > 50 AS INT)) {on} AS {prefix}_long_{noun}_ratio,
        {pos} AS {prefix}_mean_pos_{noun}_length, {neg} AS {prefix}_mean_neg_{noun}_length"""


def game_table_sql(scored: str) -> str:
    return f"""
    SELECT *, CASE WHEN ea_mean_pos_review_length > 0 THEN ea_mean_neg_review_length / ea_mean_pos_review_length ELSE 0e0 END
                AS ea_neg_pos_length_ratio FROM (
      SELECT game_name, arg_min(app_id, row_id) FILTER (WHERE {_EARLY}) AS app_id, {_features_sql("ea", "review", "review_count", _EARLY)},
             avg(positive) FILTER (WHERE {_EARLY}) AS ea_actual_positive_ratio,
             count(*) FILTER (WHERE review_type = 'post_release') AS pr_review_count,
             avg(positive) FILTER (WHERE review_type = 'post_release') AS pr_actual_positive_ratio
      FROM (SELECT *, {WORDS.format(c="review_text")} AS w FROM {scored}) GROUP BY game_name) WHERE ea_review_count > 0"""


HELPERS["game_table"] = game_table_sql("scored_reviews")

GAME_DOUBLES = (
    "ea_predicted_positive_ratio ea_avg_positive_probability ea_sentiment_std ea_mean_review_length "
    "ea_std_review_length ea_long_review_ratio ea_mean_pos_review_length ea_mean_neg_review_length "
    "ea_neg_pos_length_ratio ea_actual_positive_ratio pr_actual_positive_ratio"
)


@query("score_linear", "SELECT row_id, probability, predicted FROM scored_reviews", "probability")
def score_linear_query(t):
    return scored_reviews(t).select("row_id", "probability", "predicted")


@query("game_sentiment", "SELECT * FROM game_table", GAME_DOUBLES)
def game_sentiment(t):
    games = aggregates.game_sentiment(scored_reviews(t))
    return games.orderBy(F.col("ea_predicted_positive_ratio").desc(), "game_name")


@query(
    "text_sentiment",
    f"""SELECT * FROM (SELECT app_id, app_name, {_features_sql("yt", "comment", "comment_count", "true")}
        FROM (SELECT *, {WORDS.format(c="text")} AS w FROM scored_comments) GROUP BY app_id, app_name) WHERE yt_comment_count >= 10""",
    "yt_predicted_positive_ratio yt_avg_positive_probability yt_sentiment_std yt_mean_comment_length "
    "yt_std_comment_length yt_long_comment_ratio yt_mean_pos_comment_length yt_mean_neg_comment_length",
)
def text_sentiment(t):
    return aggregates.text_sentiment(scored(relational.clean_reviews(t.comments, "text")))


@query(
    "class_balance",
    """SELECT review_type, is_total, n_positive + n_negative AS n, n_positive, n_negative,
              n_positive / (n_positive + n_negative) * 100 AS positive_pct, n_positive / nullif(n_negative, 0) AS pos_neg_ratio
       FROM (SELECT review_type, CAST(grouping(review_type) AS INT) AS is_total, count(*) FILTER (WHERE positive = 1) AS n_positive,
                    count(*) FILTER (WHERE positive = 0) AS n_negative FROM labelled_reviews GROUP BY GROUPING SETS ((), (review_type)))""",
    "positive_pct pos_neg_ratio",
)
def class_balance(t):
    return aggregates.class_balance(t.labelled_reviews)


@query(
    "crosstab_pct",
    """SELECT review_type, count(*) FILTER (WHERE positive = 0) / count(*) * 100 AS pct_0,
              count(*) FILTER (WHERE positive = 1) / count(*) * 100 AS pct_1 FROM labelled_reviews GROUP BY review_type""",
    "pct_0 pct_1",
)
def crosstab_pct(t):
    return aggregates.crosstab_pct(t.labelled_reviews, "review_type", "positive", [0, 1])


@query("value_counts", "SELECT game_name, review_type, count(*) AS n FROM reviews GROUP BY ALL")
def value_counts(t):
    return aggregates.value_counts(t.reviews, "game_name", "review_type")


@query(
    "length_histogram",
    """SELECT bin, low + bin * width AS bin_low, low + bin * width + width AS bin_high, count(*) AS n FROM (
         SELECT low, width, CAST(least(floor((x - low) / width), 49) AS INT) AS bin FROM (
           SELECT length(text)::DOUBLE AS x, min(length(text)) OVER ()::DOUBLE AS low,
                  (max(length(text)) OVER () - min(length(text)) OVER ()) / 50.0e0 AS width FROM documents))
       GROUP BY bin, low, width""",
    "bin_low bin_high",
)
def length_histogram(t):
    lengths = t.documents.select(F.char_length("text").alias("text_length"))
    return aggregates.histogram(lengths, "text_length", 50)


@query(
    "length_stats",
    """SELECT avg(length(text)) AS mean_length, median(length(text)) AS median_length,
              CAST(min(length(text)) AS INT) AS min_length, CAST(max(length(text)) AS INT) AS max_length FROM documents""",
    "mean_length median_length",
)
def length_stats(t):
    return aggregates.length_stats(t.documents, "text")


@query(
    "box_summary",
    """WITH q AS (SELECT model, quantile_cont(f1_score, 0.25) AS q1, quantile_cont(f1_score, 0.5) AS median,
                         quantile_cont(f1_score, 0.75) AS q3 FROM training_results GROUP BY model)
       SELECT model, q1, median, q3,
              min(f1_score) FILTER (WHERE f1_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
              max(f1_score) FILTER (WHERE f1_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
              count(*) FILTER (WHERE f1_score NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
       FROM training_results JOIN q USING (model) GROUP BY model, q1, median, q3""",
    "q1 median q3 whisker_low whisker_high",
)
def box_summary(t):
    return aggregates.box_summary(t.training_results, "model", "f1_score")


def _entropy(cell: str, mass: str) -> str:
    return f"CASE WHEN {cell} > 0 THEN -({cell} / {mass}) * log2({cell} / {mass}) ELSE 0e0 END"


def _mcen_sql(tp: str, tn: str, fp: str, fn: str) -> str:
    parts = [
        f"coalesce(({h} + {fp} + {fn}) / nullif(2 * ({tp} + {tn} + {fp} + {fn}), 0), 0e0) * "
        f"({_entropy(fp, f'({h} + {fp} + {fn})')} + {_entropy(fn, f'({h} + {fp} + {fn})')})"
        for h in (tp, tn)
    ]
    return f"least(greatest({' + '.join(parts)}, 0e0), 1e0)"


_METRICS = ("f1_score", "accuracy", "precision", "recall")


@query(
    "model_summary",
    f"""SELECT * EXCLUDE (a_tp, a_tn, a_fp, a_fn), CAST(row_number() OVER (ORDER BY f1_score_mean DESC, model) AS INT) AS position,
          {", ".join(f"1.959963984540054e0 * {m}_std / sqrt(n_runs) AS {m}_moe" for m in _METRICS)},
          CASE WHEN a_tp IS NOT NULL THEN {_mcen_sql("a_tp", "a_tn", "a_fp", "a_fn")} END AS mcen_aggregated,
          0.95e0 AS confidence_level, 1.959963984540054e0 AS z_score FROM (
        SELECT model, type, count(*) AS n_runs,
          {", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in _METRICS)},
          avg(train_time) AS train_time_mean, avg(inference_time_ms) AS inference_time_ms_mean,
          avg(e) AS mcen_mean, stddev_pop(e) AS mcen_std,
          {", ".join(f"round_even(avg({c}), 0) AS a_{c}" for c in ("tp", "tn", "fp", "fn"))}
        FROM (SELECT *, CASE WHEN tp IS NOT NULL THEN {_mcen_sql("tp", "tn", "fp", "fn")} END AS e FROM training_results)
        GROUP BY model, type)""",
    " ".join(f"{m}_mean {m}_std {m}_moe" for m in _METRICS)
    + " train_time_mean inference_time_ms_mean mcen_mean mcen_std mcen_aggregated z_score",
)
def model_summary(t):
    return metrics.model_summary(t.training_results)


@query(
    "checkpoint_summary",
    """SELECT model, type, avg(f1_score) AS avg_f1, stddev_samp(f1_score) AS std_f1, min(f1_score) AS min_f1, max(f1_score) AS max_f1,
              avg(accuracy) AS avg_accuracy, avg(precision) AS avg_precision, avg(recall) AS avg_recall, avg(train_time) AS avg_train_time
       FROM training_results GROUP BY model, type""",
    "avg_f1 std_f1 min_f1 max_f1 avg_accuracy avg_precision avg_recall avg_train_time",
)
def checkpoint_summary(t):
    return metrics.checkpoint_summary(t.training_results)


@query(
    "mcen",
    f"""SELECT model, seed, fold, {_mcen_sql("tp", "tn", "fp", "fn")} AS mcen FROM training_results WHERE tp IS NOT NULL""",
    "mcen",
)
def mcen(t):
    runs = t.training_results.where(F.col("tp").isNotNull())
    value = metrics.mcen(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    return runs.select("model", "seed", "fold", value.alias("mcen"))


@query(
    "progress",
    """SELECT m.model, count(r.model) AS completed, CAST(600 AS INT) AS expected, least(100e0, count(r.model) * 100 / 600) AS pct,
              count(r.model) >= 600 AS is_done
       FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'absent']) AS model) m
       LEFT JOIN training_results_gaps r ON r.model = m.model GROUP BY m.model""",
    "pct",
)
def progress(t):
    return metrics.progress(t.training_results_gaps, [*MODELS, "absent"], 600)


@query(
    "confusion",
    """SELECT CAST(a.v AS INT) AS actual, CAST(p.v AS INT) AS predicted, count(s.row_id) AS n
       FROM (SELECT unnest([0, 1]) AS v) a CROSS JOIN (SELECT unnest([0, 1]) AS v) p
       LEFT JOIN scored_reviews s ON s.positive = a.v AND s.predicted = p.v GROUP BY ALL""",
)
def confusion(t):
    return metrics.confusion(scored_labelled(t), "positive", "predicted", [0, 1])


_BINARY = """
    SELECT *, coalesce(tp / nullif(tp + fp, 0), 0e0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0e0) AS r1,
           coalesce(tn / nullif(tn + fn, 0), 0e0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0e0) AS r0,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0e0) AS f0,
           tp + tn + fp + fn AS n FROM ({source})"""
_COUNTS = """count(*) FILTER (WHERE positive = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE positive = 0 AND predicted = 0) AS tn,
             count(*) FILTER (WHERE positive = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE positive = 1 AND predicted = 0) AS fn"""


@query(
    "binary_metrics",
    f"""SELECT review_type, tp, tn, fp, fn, (tp + tn) / n AS accuracy, (p0 + p1) / 2 AS precision, (r0 + r1) / 2 AS recall, (f0 + f1) / 2 AS f1_score
        FROM ({_BINARY.format(source=f"SELECT review_type, {_COUNTS} FROM scored_reviews WHERE positive IS NOT NULL GROUP BY review_type")})""",
    "accuracy precision recall f1_score",
)
def binary_metrics(t):
    return metrics.binary_metrics(scored_labelled(t), "positive", "predicted", ["review_type"])


@query(
    "accuracy_by_game",
    f"""WITH games AS (SELECT game_name, {_COUNTS} FROM scored_reviews WHERE {_EARLY} AND positive IS NOT NULL GROUP BY game_name),
          errors AS (SELECT *, abs((tp + fp) / (tp + tn + fp + fn) - (tp + fn) / (tp + tn + fp + fn)) AS err FROM games),
          rolled AS (SELECT game_name, CAST(grouping(game_name) AS INT) AS is_pooled, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn,
                            CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(err) AS absolute_error
                     FROM errors GROUP BY GROUPING SETS ((), (game_name)))
        SELECT game_name, is_pooled, n AS n_reviews, (tp + fp) / n AS predicted_positive_ratio, (tp + fn) / n AS actual_positive_ratio,
               absolute_error, (tp + tn) / n AS accuracy, (f1 * (tp + fn) + f0 * (tn + fp)) / n AS weighted_f1
        FROM ({_BINARY.format(source="SELECT * FROM rolled")})""",
    "predicted_positive_ratio actual_positive_ratio absolute_error accuracy weighted_f1",
)
def accuracy_by_game(t):
    return metrics.accuracy_by_game(scored_labelled(t).where(F.col("review_type") == "early_access"))


HELPERS["tier_guess"] = """
    SELECT *, CASE WHEN steamspy_positive >= 14 THEN 'Blockbuster' WHEN steamspy_positive >= 11 THEN 'Hit'
                   WHEN steamspy_positive >= 9 THEN 'Moderate' ELSE 'Flop' END AS guess
    FROM success_metrics WHERE success_tier IS NOT NULL"""


def tier_guess(t):
    """Tiers and a guess at them from the count of positive reviews."""
    positive = F.col("steamspy_positive")
    guess = (
        F.when(positive >= 14, "Blockbuster").when(positive >= 11, "Hit").when(positive >= 9, "Moderate").otherwise("Flop")
    )
    return success_metrics(t).na.drop(subset=["success_tier"]).withColumn("guess", guess)


_TIER_VALUES = ", ".join(f"'{tier}'" for tier in TIERS)


@query(
    "class_report",
    f"""WITH c AS (SELECT k AS class, count(*) FILTER (WHERE success_tier = k AND guess = k) AS tp, count(*) FILTER (WHERE guess = k) AS called,
                          count(*) FILTER (WHERE success_tier = k) AS support
                   FROM (SELECT unnest([{_TIER_VALUES}]) AS k) CROSS JOIN tier_guess GROUP BY k),
          s AS (SELECT *, coalesce(tp / nullif(called, 0), 0e0) AS precision, coalesce(tp / nullif(support, 0), 0e0) AS recall FROM c),
          f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0e0) AS f1 FROM s)
        SELECT class, precision, recall, f1, support FROM f
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f""",
    "precision recall f1",
)
def class_report(t):
    return metrics.class_report(tier_guess(t), "success_tier", "guess", TIERS)


@query(
    "outcome_summary",
    f"""SELECT count(*) AS n_games, count(*) FILTER (WHERE data_complete) AS n_complete, count(steam_metacritic_score) AS n_critic_score,
               count(steamspy_owners_min) AS n_owners, count(estimated_revenue_usd) AS n_revenue,
               {", ".join(f"count(*) FILTER (WHERE success_tier = '{tier}') AS n_{tier.lower()}" for tier in TIERS)} FROM success_metrics""",
)
def outcome_summary(t):
    return aggregates.outcome_summary(success_metrics(t))


def complete_matrix(t, source="training_results"):
    """Run matrix of all models over runs that have every one, with the kept models."""
    results = getattr(t, source)
    complete, kept, _ = metrics.apply_policy(metrics.run_matrix(results, MODELS), MODELS)
    return complete, kept


_PIVOT = ", ".join(f"max(f1_score) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS)
HELPERS["run_matrix_all"] = f"SELECT seed || '_' || fold AS run_id, {_PIVOT} FROM training_results GROUP BY seed, fold"
HELPERS["run_matrix_gaps"] = f"SELECT seed || '_' || fold AS run_id, {_PIVOT} FROM training_results_gaps GROUP BY seed, fold"
# 'error' has fewer than half of the runs and is left out; the others need complete runs.
HELPERS["long_complete"] = """
    SELECT run_id, m.model, m.value FROM (
      SELECT run_id, unnest([{'model': 'click', 'value': click}, {'model': 'purchase', 'value': purchase},
                             {'model': 'signup', 'value': signup}, {'model': 'view', 'value': view}]) AS m
      FROM run_matrix_gaps WHERE click IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL)"""
HELPERS["block_ranks"] = """
    SELECT *, rank() OVER (PARTITION BY run_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY run_id, value) - 1) / 2.0e0 AS r,
           count(*) OVER (PARTITION BY run_id, value) AS same FROM long_complete"""


@query("run_matrix", "SELECT * FROM run_matrix_gaps")
def run_matrix(t):
    return metrics.run_matrix(t.training_results_gaps, MODELS)


@query(
    "incomplete_policy",
    """SELECT run_id, click, purchase, signup, view FROM run_matrix_gaps
       WHERE click IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL""",
)
def incomplete_policy(t):
    return complete_matrix(t, "training_results_gaps")[0]


@query(
    "regression_metrics",
    """SELECT count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
              1 - sum((ln(1 + y) - ln(1 + p)) ** 2) / (var_pop(ln(1 + y)) * count(*)) AS r2
       FROM (SELECT steamspy_owners_max::DOUBLE AS y, steamspy_avg_playtime * 60.0e0 AS p FROM outcomes)""",
    "mae rmse r2",
    digits=4,
)
def regression_metrics(t):
    df = t.outcomes.select(
        F.col("steamspy_owners_max").cast("double").alias("y"), (F.col("steamspy_avg_playtime") * 60.0).alias("p")
    )
    return metrics.regression_metrics(df, "y", "p")


@query(
    "imbalance",
    """SELECT arg_max(success_tier, n) AS majority, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_classes, max(n) / sum(n) AS majority_share,
              count(*) > 1 AND max(n) / sum(n) > 0.8 AS is_imbalanced
       FROM (SELECT success_tier, count(*) AS n FROM success_metrics WHERE success_tier IS NOT NULL GROUP BY success_tier)""",
    "majority_share",
)
def imbalance(t):
    return aggregates.imbalance(success_metrics(t), "success_tier")


@query("distinct_games", "SELECT count(DISTINCT game_name) AS n_games FROM reviews")
def distinct_games(t):
    return aggregates.distinct_games(t.reviews)


@query(
    "avg_rank",
    """SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value)
              + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0e0 AS value_rank FROM events""",
)
def avg_rank(t):
    ranked = average_rank(t.events, ["event_type"], "value", "value_rank")
    return ranked.select("event_id", "event_type", "value_rank")


# --- Tests between models -----------------------------------------------------------------------


@query(
    "friedman",
    """SELECT chi2, n_samples, n_models, chi2 / (n_samples * 3) AS kendall_w FROM (
         SELECT n_samples, CAST(4 AS INT) AS n_models,
                (12e0 / (n_samples * 20) * squares - 15 * n_samples) / (1 - ties / (n_samples * 60)) AS chi2
         FROM (SELECT sum(s * s) AS squares, max(n) AS n_samples, sum(t) AS ties FROM (
                 SELECT model, sum(5 - r) AS s, count(*) AS n, sum(same * same - 1) AS t FROM block_ranks GROUP BY model)))""",
    "chi2 kendall_w",
)
def friedman(t):
    complete, kept = complete_matrix(t, "training_results_gaps")
    return nonparametric.friedman(complete, kept).select("chi2", "n_samples", "n_models", "kendall_w")


@query(
    "average_ranks",
    """SELECT model, average_rank, rank_std, n_runs, CASE WHEN max(rank_std) OVER () = 0 THEN 'perfect'
              WHEN max(rank_std) OVER () < 0.5 THEN 'high' ELSE 'varied' END AS consistency
       FROM (SELECT model, avg(r) AS average_rank, stddev_samp(r) AS rank_std, count(*) AS n_runs FROM block_ranks GROUP BY model)""",
    "average_rank rank_std",
)
def average_ranks(t):
    complete, kept = complete_matrix(t, "training_results_gaps")
    return nonparametric.average_ranks(complete, kept)


@query(
    "nemenyi",
    """WITH a AS (SELECT model, avg(r) AS r, count(*) AS n FROM block_ranks GROUP BY model)
       SELECT x.model AS model_1, y.model AS model_2, abs(x.r - y.r) / sqrt(20 / (6 * x.n)) AS q FROM a x CROSS JOIN a y""",
    "q",
)
def nemenyi(t):
    complete, kept = complete_matrix(t, "training_results_gaps")
    return nonparametric.nemenyi(complete, kept).drop("p_value")


@query(
    "wilcoxon_pairs",
    """WITH p AS (SELECT a.model AS model_1, b.model AS model_2, a.value AS x, b.value AS y, a.value - b.value AS d
                  FROM long_complete a JOIN long_complete b ON a.run_id = b.run_id AND a.model < b.model),
            k AS (SELECT model_1, model_2, d, rank() OVER (PARTITION BY model_1, model_2 ORDER BY abs(d))
                         + (count(*) OVER (PARTITION BY model_1, model_2, abs(d)) - 1) / 2.0e0 AS r,
                         count(*) OVER (PARTITION BY model_1, model_2, abs(d)) AS same FROM p WHERE d <> 0),
            w AS (SELECT model_1, model_2, count(*) AS n_nonzero, CAST(sum(same * same - 1) AS BIGINT) AS tie_term,
                         least(coalesce(sum(r) FILTER (WHERE d > 0), 0e0), coalesce(sum(r) FILTER (WHERE d < 0), 0e0)) AS statistic
                  FROM k GROUP BY model_1, model_2),
            s AS (SELECT model_1, model_2, count(*) AS n_samples, avg(x) - avg(y) AS mean_diff,
                         sqrt((var_samp(x) + var_samp(y)) / 2) AS pooled FROM p GROUP BY model_1, model_2)
       SELECT model_1, model_2, n_samples, n_nonzero, tie_term, statistic,
              1 - 2 * statistic / (n_samples * (n_samples + 1) / 2) AS effect_size_r,
              coalesce(mean_diff / nullif(pooled, 0), 0e0) AS cohens_d, mean_diff FROM s JOIN w USING (model_1, model_2)""",
    "statistic effect_size_r cohens_d mean_diff",
)
def wilcoxon_pairs(t):
    complete, kept = complete_matrix(t, "training_results_gaps")
    return nonparametric.wilcoxon_pairs(complete, kept).drop("p_value", "significant")


@query(
    "describe_matrix",
    """SELECT model, count(*) AS n, avg(f1_score) AS mean, stddev_samp(f1_score) AS std, min(f1_score) AS minimum, max(f1_score) AS maximum,
              quantile_cont(f1_score, 0.25) AS q1, quantile_cont(f1_score, 0.5) AS median, quantile_cont(f1_score, 0.75) AS q3
       FROM training_results GROUP BY model""",
    "mean std minimum maximum q1 median q3",
)
def describe_matrix(t):
    return metrics.describe_matrix(t.training_results, "model", "f1_score")


# --- Correlations -------------------------------------------------------------------------------

HELPERS["pairs_sf"] = " UNION ALL ".join(
    f"SELECT app_id, '{f}' AS feature, '{o}' AS outcome, CAST({f} AS DOUBLE) AS x, CAST({o} AS DOUBLE) AS y, "
    f"log_ea_review_count AS z FROM matrix WHERE {f} IS NOT NULL AND {o} IS NOT NULL"
    for f in correlation.SENTIMENT_FEATURES
    for o in correlation.OUTCOMES
)


def _ranked(source: str) -> str:
    def rank(c):
        return (
            f"rank() OVER (PARTITION BY feature, outcome ORDER BY {c}) "
            f"+ (count(*) OVER (PARTITION BY feature, outcome, {c}) - 1) / 2.0e0 AS r{c}"
        )

    return f"SELECT *, {rank('x')}, {rank('y')}, {rank('z')} FROM ({source})"


def _correlation_sql(source: str) -> str:
    """Both correlations and the partial one of long pairs (feature, outcome, x, y, z)."""
    controlled = ", ".join(f"'{o}'" for o in correlation.CONTROLLED_OUTCOMES)
    effect = (
        "CASE WHEN spearman_r IS NULL THEN NULL WHEN abs(spearman_r) < 0.1 THEN 'Negligible' WHEN abs(spearman_r) < 0.3 THEN 'Small' "
        "WHEN abs(spearman_r) < 0.5 THEN 'Medium' ELSE 'Large' END"
    )
    return f"""
        SELECT feature, outcome, n_samples, spearman_r, pearson_r, CASE WHEN ctl THEN partial_r END AS partial_r,
               CASE WHEN ctl THEN n_samples END AS partial_n, CASE WHEN ctl AND partial_r IS NOT NULL THEN '{correlation.CONTROL}' END AS control_var,
               {effect} AS effect_size
        FROM (SELECT feature, outcome, count(*) AS n_samples, corr(rx, ry) AS spearman_r, corr(x, y) AS pearson_r,
                     outcome IN ({controlled}) AND feature <> '{correlation.CONTROL}' AS ctl,
                     (corr(rx, ry) - corr(rx, rz) * corr(ry, rz)) / (sqrt(1 - corr(rx, rz) ** 2) * sqrt(1 - corr(ry, rz) ** 2)) AS partial_r
              FROM ({_ranked(source)}) GROUP BY feature, outcome) WHERE n_samples >= 5"""


@query(
    "pearson",
    "SELECT count(*) AS n_samples, corr(ea_mean_review_length, estimated_revenue_usd) AS pearson_r FROM matrix WHERE estimated_revenue_usd IS NOT NULL",
    "pearson_r",
)
def pearson(t):
    return correlation.pearson(matrix(t), "ea_mean_review_length", "estimated_revenue_usd")


@query(
    "spearman",
    """SELECT count(*) AS n_samples, corr(a, b) AS spearman_r FROM (
         SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS a,
                rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS b
         FROM (SELECT ea_mean_review_length AS x, estimated_revenue_usd AS y FROM matrix WHERE estimated_revenue_usd IS NOT NULL))""",
    "spearman_r",
)
def spearman(t):
    return correlation.spearman(matrix(t), "ea_mean_review_length", "estimated_revenue_usd")


@query(
    "partial_spearman",
    """SELECT count(*) AS n_samples, (corr(a, b) - corr(a, c) * corr(b, c)) / (sqrt(1 - corr(a, c) ** 2) * sqrt(1 - corr(b, c) ** 2)) AS partial_r
       FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS a,
                    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS b,
                    rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0e0 AS c
             FROM (SELECT ea_long_review_ratio AS x, steamspy_avg_playtime AS y, ea_review_count AS z FROM matrix))""",
    "partial_r",
)
def partial_spearman(t):
    return correlation.partial_spearman(
        matrix(t), "ea_long_review_ratio", "steamspy_avg_playtime", "ea_review_count"
    )


@query("feature_outcome_corr", _correlation_sql("SELECT * FROM pairs_sf"), "spearman_r pearson_r partial_r")
def feature_outcome_corr(t):
    return correlation.correlate_features(stored_matrix(t))


def stored_matrix(t):
    """The feature matrix written once, as the flows do before they correlate it."""
    return materialize(matrix(t), "matrix")


def _listed(columns) -> str:
    return ", ".join(f"struct_pack(name := '{c}', v := CAST({c} AS DOUBLE))" for c in columns)


HELPERS["pairs_meta"] = f"""
    SELECT app_id, f.name AS feature, o.name AS outcome, f.v AS x, o.v AS y, z
    FROM (SELECT app_id, z, f, unnest(os) AS o
          FROM (SELECT app_id, log_ea_review_count AS z, unnest([{_listed(METADATA_FEATURES)}]) AS f,
                       [{_listed(correlation.OUTCOMES)}] AS os FROM matrix))
    WHERE f.v IS NOT NULL AND o.v IS NOT NULL"""
HELPERS["metadata_pairs"] = (
    "SELECT * FROM ("
    + _correlation_sql("SELECT * FROM pairs_meta WHERE feature IN (SELECT feature FROM variance_gate WHERE keep)")
    + ") WHERE NOT isnan(spearman_r) AND spearman_r IS NOT NULL"
)


def _significant(r: str, n: str) -> str:
    """p < 0.05 of a correlation: its t beyond the critical value, by the expansion of the t quantile at 0.975."""
    z, df = 1.959963984540054, f"({n} - 2)"
    critical = " + ".join(
        f"{c!r} / {df} ** {k}"
        for k, c in enumerate((
            z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
            (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
        ))
    )
    return f"coalesce(abs({r}) * sqrt({df} / nullif(1 - {r} * {r}, 0)) > {critical}, true)"


@query("metadata_corr", "SELECT * FROM metadata_pairs", "spearman_r pearson_r partial_r")
def metadata_corr(t):
    return correlation.correlate_metadata(stored_matrix(t), METADATA_FEATURES)


@query("metadata_corr_all")
def metadata_corr_all(t):
    """All metadata features, with p."""
    return correlation.with_p_values(correlation.correlate_metadata(stored_matrix(t), METADATA_FEATURES))


@query(
    "correlation_summary",
    f"""SELECT feature, outcome, n_samples, spearman_r, significant
       FROM (SELECT *, {_significant("spearman_r", "n_samples")} AS significant FROM metadata_pairs)
       ORDER BY significant DESC, abs(spearman_r) DESC, feature, outcome LIMIT 15""",
    "spearman_r",
)
def correlation_summary(t):
    table = correlation.correlate_metadata(stored_matrix(t), METADATA_FEATURES)
    return correlation.correlation_summary(correlation.with_p_values(table)).select(
        "feature", "outcome", "n_samples", "spearman_r", "significant"
    )


@query(
    "count_significant",
    f"""SELECT count(*) AS n_pairs, count(*) FILTER (WHERE {_significant("spearman_r", "n_samples")}) AS n_significant
        FROM metadata_pairs""",
)
def count_significant(t):
    table = correlation.correlate_metadata(stored_matrix(t), METADATA_FEATURES)
    return correlation.count_significant(correlation.with_p_values(table))


@query(
    "hypothesis",
    f"""SELECT *, CASE WHEN spearman_r > 0 THEN 'positive' WHEN spearman_r < 0 THEN 'negative' ELSE 'none' END AS direction,
              CASE WHEN NOT {_significant("spearman_r", "n_samples")} THEN 'NOT SUPPORTED'
                   WHEN abs(spearman_r) > 0.3 THEN 'SUPPORTED' ELSE 'PARTIALLY SUPPORTED' END AS verdict
       FROM (SELECT count(*) AS n_samples, corr(x, y) AS pearson_r, corr(rank_x, rank_y) AS spearman_r
       FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS rank_x,
                    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS rank_y
             FROM (SELECT round(ea_predicted_positive_ratio, 9) AS x, round(pr_actual_positive_ratio, 9) AS y FROM game_table
                   WHERE pr_actual_positive_ratio IS NOT NULL)))""",
    "pearson_r spearman_r",
)
def hypothesis(t):
    games = aggregates.game_sentiment(scored_reviews(t))
    ratios = games.withColumns(
        {c: F.round(c, 9) for c in ("ea_predicted_positive_ratio", "pr_actual_positive_ratio")}
    )
    table = correlation.validate_hypothesis(ratios)
    return table.select("n_samples", "pearson_r", "spearman_r", "direction", "verdict")


_SQUARE = ("ea_predicted_positive_ratio", "pr_actual_positive_ratio", "steam_metacritic_score", "owners_midpoint", "review_score")
HELPERS["pairs_square"] = " UNION ALL ".join(
    f"SELECT app_id, '{f}' AS feature, '{o}' AS outcome, CAST({f} AS DOUBLE) AS x, CAST({o} AS DOUBLE) AS y, 0 AS z "
    f"FROM matrix WHERE {f} IS NOT NULL AND {o} IS NOT NULL"
    for f in _SQUARE
    for o in _SQUARE
)


@query(
    "spearman_matrix",
    f"""SELECT feature, outcome, count(*) AS n_samples, corr(rx, ry) AS spearman_r FROM ({_ranked("SELECT * FROM pairs_square")})
        GROUP BY feature, outcome""",
    "spearman_r",
)
def spearman_matrix(t):
    return correlation.spearman_matrix(matrix(t), _SQUARE)


@query(
    "trend_line",
    """SELECT regr_slope(estimated_revenue_usd, ea_mean_review_length) AS slope, regr_intercept(estimated_revenue_usd, ea_mean_review_length) AS intercept,
              CAST(regr_count(estimated_revenue_usd, ea_mean_review_length) AS BIGINT) AS n FROM matrix""",
    "slope intercept",
    digits=2,
)
def trend_line(t):
    return correlation.trend_line(matrix(t), "ea_mean_review_length", "estimated_revenue_usd")


@query(
    "distinct_by_sketch",
    """SELECT review_type, count(DISTINCT review_text) AS n_exact, true AS is_near FROM reviews GROUP BY review_type""",
)
def distinct_by_sketch(t):
    """Sketches of every source file, merged by review type, within four standard errors of the exact count."""
    by_file = aggregates.distinct_sketches(t.reviews, "review_text", ["review_type", "game_name"])
    near = aggregates.merged_distinct(by_file, ["review_type"])
    exact = t.reviews.groupBy("review_type").agg(F.count_distinct("review_text").alias("n_exact"))
    allowed = 4 * 1.04 / 64 * F.col("n_exact") + 1
    return exact.join(near, "review_type").select("review_type", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= allowed).alias("is_near"))
