"""Probability and class of texts: fixed word weights, fitted models, or any batch predictor."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classifiers import MODELS


def with_class(df: DataFrame, probability: Column) -> DataFrame:
    """Adds probability and class; an exact tie is class 0."""
    return df.withColumn("probability", probability).withColumn(
        "predicted", (F.col("probability") > 0.5).cast("int")
    )


def score_linear(
    df: DataFrame, text: str, weights: Mapping[str, float], bias: float = 0.0
) -> DataFrame:
    """Logistic score of whole cleaned texts: the summed weights of their words.

    One native pass over the words of a row; the weights are a literal of fixed size.
    """
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in (pair[0], float(pair[1]))])
    words = F.filter(F.split(F.col(text), r"[ .,!?]+"), lambda w: w.isin(list(weights)))
    total = F.aggregate(words, F.lit(float(bias)), lambda acc, w: acc + F.try_element_at(table, w))
    return with_class(df, 1 / (1 + F.exp(-total)))


def score(model, df: DataFrame) -> DataFrame:
    """Scores with a fitted model; models without probabilities give 0 or 1."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        value = vector_to_array("probability")[1]
    else:
        value = F.col("prediction").cast("double")
    extra = ["terms", "words", "word_pairs", "term_counts", "damped", "weighted", "features"]
    extra += ["rawPrediction", "prediction"]
    scored = scored.withColumn("_p", value).drop("probability", *extra)
    return with_class(scored, F.col("_p")).drop("_p")


def score_with(
    make_predictor: Callable[[], Callable], df: DataFrame, text: str, batch_size: int = 64
) -> DataFrame:
    """Scores with any predictor of positive probabilities, called on batches of texts.

    ``make_predictor`` runs once per Python worker, so a model is loaded once and not per batch.
    """
    predict = predict_batch_udf(make_predictor, return_type=T.DoubleType(), batch_size=batch_size)
    return with_class(df, predict(F.col(text)))


def model_path(root: str, name: str, seed: int, fold: int) -> str:
    return f"{root.rstrip('/')}/{name}_seed{seed}_fold{fold}"


def save_predictor(model: PipelineModel, root: str, name: str, seed: int, fold: int) -> None:
    model.write().overwrite().save(model_path(root, name, seed, fold))


def find_predictor(
    spark: SparkSession, root: str, names: Sequence[str] = MODELS, seed: int | None = None, fold: int = 0
) -> str | None:
    """Path of the first saved model in the order of ``names``; by path where no seed is given.

    Saved models are found by their metadata files, on any file system Spark reads.
    """
    for name in names:
        if name not in MODELS:
            raise ValueError(f"unknown model {name!r}; available: {', '.join(MODELS)}")
        wanted = model_path(root, name, "*" if seed is None else seed, fold)
        try:
            files = spark.read.text(f"{wanted}/metadata")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        first = files.agg(F.min("_metadata.file_path")).first()[0]
        if first:
            return first.rsplit("/metadata", 1)[0]
    return None


def load_predictor(
    spark: SparkSession, root: str, name: str | None = None, seed: int | None = None, fold: int = 0
) -> PipelineModel:
    path = find_predictor(spark, root, MODELS if name is None else (name,), seed, fold)
    if path is None:
        raise FileNotFoundError(f"no saved model in {root}")
    return PipelineModel.load(path)
