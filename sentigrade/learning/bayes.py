"""Multinomial naive Bayes over TF-IDF, all folds from one table of term sums."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import binary_metrics
from ..session import store
from .features import MAX_FEATURES, Vocabulary, fold_statistics, word_array
from .folds import stratified_folds


def class_sums(rows: DataFrame, vocabularies: Sequence[Vocabulary]) -> list[np.ndarray]:
    """For each model the summed weights of its terms by class, over the rows of the other folds.

    ``rows``: words, fold, label.  Every task adds up its own rows, so what is shuffled is at most one value for
    each term, class, model and task.
    """
    widths = [len(v.terms) for v in vocabularies]
    starts = np.cumsum([0, *widths]) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1])
        for batch in batches:
            fold, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for model, vocabulary in enumerate(vocabularies):
                own = np.flatnonzero((fold != model) & np.isin(label, (0, 1)))
                row, place, _, x = vocabulary.entries(batch.column(0).take(pa.array(own)), True)
                at = place * 2 + label[own].astype(np.int64)[row]
                total[starts[model] : starts[model + 1]] += np.bincount(at, x, 2 * widths[model])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "x"])

    sums = np.zeros(starts[-1])
    added = rows.select("words", "fold", "label").mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x"))
    for r in added.toLocalIterator():
        sums[r.at] = r.x
    return [sums[starts[m] : starts[m + 1]].reshape(-1, 2) for m in range(len(widths))]


def log_odds(sums: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """What one unit of each term adds to the log-odds of class 1; ``sums`` has a row for each term, a column for each class."""
    shares = np.log((sums + smoothing) / (sums.sum(axis=0) + smoothing * len(sums)))
    return shares[:, 1] - shares[:, 0]


def fold_predictions(
    df: DataFrame, key: str, label: str, text: str, k: int = 5, seed: int = 0, size: int = MAX_FEATURES
) -> DataFrame:
    """key, fold, label, score (log-odds) and predicted of every row by the model that has not seen it.

    Vocabulary, document frequencies, class sums and priors of each fold's model come from the other folds.
    A tie is class 0.  Models are k times ``size`` numbers, sent to every task; weights of terms in rows are made
    again in each pass and never stored.
    """
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), word_array(F.col(text)).alias("words"))
    rows = store(rows, "bayes-words")
    folds = stratified_folds(rows().select("key", "label"), "key", "label", k, seed)
    opened = store(rows().join(folds.select("key", "fold"), "key"), "bayes-rows")
    statistics = store(fold_statistics(opened().withColumn("folds", F.array("fold")), "key", 1, k, "words", True), "bayes-terms")
    counted = opened().groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1")).collect()
    trained = {f: [sum(r[c] for r in counted if r.fold != f) for c in ("n", "n1")] for f in range(k)}
    vocabularies = [Vocabulary.of_fold(statistics(), 0, f, k, trained[f][0], size) for f in range(k)]
    odds = [log_odds(sums) for sums in class_sums(opened(), vocabularies)]
    # Without one of the classes there is no prior, as before.
    priors = [math.log(n1) - math.log(n - n1) if 0 < n1 < n else None for n, n1 in trained.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, told = batch.column(1).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            for model in np.unique(fold).tolist():
                own = np.flatnonzero(fold == model)
                row, place, _, x = vocabularies[model].entries(batch.column(3).take(pa.array(own)), True)
                told[own] = np.bincount(row, x * odds[model][place], len(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(told)], names=[key, "fold", label, "told"])

    kinds = dict(rows().dtypes)
    source = opened().select("key", "fold", "label", "words")
    scored = source.mapInArrow(run, f"{key} {kinds['key']}, fold int, {label} {kinds['label']}, told double")
    prior = F.get(F.array(*(F.lit(p).cast("double") for p in priors)), F.col("fold"))
    return scored.withColumn("score", prior + F.col("told")).drop("told").withColumn("predicted", (F.col("score") > 0).cast("int"))


def fold_results(df: DataFrame, key: str, label: str, text: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Confusion counts and scores of every fold."""
    return binary_metrics(fold_predictions(df, key, label, text, k, seed), label, "predicted", ["fold"])
