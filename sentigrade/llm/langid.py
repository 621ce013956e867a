"""Language identification in two levels: family first, then languages of that family.

Every duel, between two families or between two languages of one family, is a linear support
vector machine over hashed letter bigrams and trigrams of the whole text.  It is trained by dual
coordinate descent on a bounded sample, ``per_language`` different rows expected of each language, drawn by
a hash of key and text; each duel is one task.  As weights grow with the square of the languages, the
``most_languages`` with most rows are learned: 780 duels or 200 MB of weights at the most.  Prediction reads
whole texts in Arrow batches.

Only text is an input of a prediction.  Null texts and texts without a letter are ``und`` with score
0; so is everything when no language could be learned.  With one learned language every text with a
letter gets it, with score 1.  Rows with a null key are held out.  Repeated rows are predicted alike.  Key,
text and lang are read by name; other columns stay as they are, but for old ``lang_pred`` and ``score``.  An empty
table teaches no language and gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BITS = 16
SCALE = 10.0  # of the mean feature vector, so that margins of about one need no huge weights

# Family of each language code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "hellenic": "el",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id jv mg ms su tl",
    "austroasiatic": "km vi",
    "kradai": "lo th",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    """The family of a code; codes outside the table are families of their own."""
    return _FAMILY_OF.get(language.lower().replace("_", "-").split("-")[0], language)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter its text's number and the hashed bigram and trigram around it."""
    lowered = [text.lower() for text in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    at = np.flatnonzero(letter)
    ends = np.cumsum([len(text) + 1 for text in lowered]) if lowered else np.zeros(0)
    owner = np.searchsorted(ends, at, side="left")
    symbol = np.where(letter, points, 32).astype(np.uint64)
    middle, right = symbol[at], symbol[at + 1]
    pair = (middle * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F))
    triple = pair ^ (symbol[at - 1] * np.uint64(0x165667B19E3779F9))
    shift = np.uint64(64 - BITS + 1)
    bigram = (pair * np.uint64(0xD6E8FEB86659FD93)) >> shift
    trigram = ((triple * np.uint64(0xD6E8FEB86659FD93)) >> shift) + np.uint64(1 << (BITS - 1))
    return owner, bigram.astype(np.int64), trigram.astype(np.int64)


def pieces_of(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """All texts in portions of about ``most`` characters; longer texts come in several pieces."""
    numbers, pieces, size = [], [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(len(text), 1), most):
            numbers.append(number)
            pieces.append(text[start : start + most])
            size += len(pieces[-1])
            if size >= most:
                yield numbers, pieces
                numbers, pieces, size = [], [], 0
    if pieces:
        yield numbers, pieces


def train_duel(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float, passes: int):
    """Weights and bias of a linear support vector machine (dual coordinate descent, hinge loss)."""
    weights = np.zeros(1 << BITS)
    bias = 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(values @ values) + 1.0 for _, values in rows])
    upper = np.where(signs > 0, *(cost * len(signs) / (2 * max(1, (signs == s).sum())) for s in (1, -1)))
    order = np.random.default_rng(5)
    for _ in range(passes):
        largest = 0.0
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            gradient = signs[i] * (weights[at] @ values + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[at] += step * values
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-4:
            break
    return weights, bias


@dataclass
class Model:
    """Learned languages and the duels: sides (a wins above zero), weights and biases."""

    languages: list[str]
    families: list[tuple[str, str]] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS), dtype=np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its margin in each duel."""
        letters = np.zeros(len(texts))
        totals = np.zeros((len(self.biases), len(texts)))
        for numbers, pieces in pieces_of(texts):
            owner, bigram, trigram = letter_grams(pieces)
            np.add.at(letters, numbers, np.bincount(owner, minlength=len(pieces)))
            for k, weights in enumerate(self.weights):
                np.add.at(totals[k], numbers, np.bincount(owner, weights[bigram] + weights[trigram], minlength=len(pieces)))
        return letters, SCALE * totals / np.maximum(letters, 1) + self.biases[:, None]

    @staticmethod
    def champion(names: list[str], duels: dict[tuple[str, str], np.ndarray], size: int):
        """Winner of most duels among ``names`` (ties: larger sum of margins) and its smallest margin."""
        if len(names) == 1:
            return np.zeros(size, dtype=np.int64), np.full(size, np.inf)
        votes, sums = np.zeros((len(names), size)), np.zeros((len(names), size))
        least = np.full((len(names), size), np.inf)
        place = {name: k for k, name in enumerate(names)}
        for (a, b), margin in duels.items():
            for name, own in ((a, margin), (b, -margin)):
                votes[place[name]] += own > 0
                sums[place[name]] += np.tanh(own)
                least[place[name]] = np.minimum(least[place[name]], own)
        best = np.argmax(votes + sums / (2 * len(names)), axis=0)
        return best, least[best, np.arange(size)]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        letters, margins = self.margins(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        duels = dict(zip(self.families + self.pairs, margins))
        families = sorted({family_of(x) for x in self.languages})
        family, least = self.champion(families, {p: duels[p] for p in self.families}, len(texts))
        names = np.empty(len(texts), dtype=object)
        for k, name in enumerate(families):
            own = sorted(x for x in self.languages if family_of(x) == name)
            mine = np.flatnonzero(family == k)
            inner = {p: duels[p][mine] for p in self.pairs if p[0] in own and p[1] in own}
            best, closest = self.champion(own, inner, len(mine))
            names[mine] = np.array(own, dtype=object)[best]
            least[mine] = np.minimum(least[mine], closest)
        score = 1 / (1 + np.exp(-2 * np.clip(least, -50, 50)))
        names[letters == 0] = UNKNOWN
        score[letters == 0] = 0.0
        return names.tolist(), score


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether the row is kept from learning: crc32 of the key's text is divisible by ``folds``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sparse_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of the mean feature vector of one text."""
    counts, letters = np.zeros(1 << BITS), 0
    for _, pieces in pieces_of([text]):
        owner, bigram, trigram = letter_grams(pieces)
        letters += len(owner)
        counts += np.bincount(np.concatenate([bigram, trigram]), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (SCALE * counts[at] / max(letters, 1)).astype(np.float32)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [sparse_vector(text) for text in batch.column(2).to_pylist()]
        columns = [pa.array([part.tobytes() for part in parts], pa.binary()) for parts in zip(*vectors)]
        if vectors:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "lang", "at", "x"])


def learn(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    most_languages: int = 40,
    cost: float = 1.0,
    passes: int = 40,
) -> Model:
    """Trains all duels on a sample of the rows that are not held out and have a language and a text."""
    rows = documents.select(
        F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~held_out(F.col("key")))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = sorted(counts)
    families = sorted({family_of(x) for x in languages})
    model = Model(languages, list(itertools.combinations(families, 2)))
    model.pairs = [
        pair for f in families for pair in itertools.combinations([x for x in languages if family_of(x) == f], 2)
    ]
    duels = model.families + model.pairs
    if not duels:
        return model
    million = 1_000_000
    share = F.create_map(*itertools.chain.from_iterable(
        (F.lit(x), F.lit(min(million, -(-per_language * million // n)))) for x, n in counts.items()
    ))
    # Id and text together, so that an id on many rows is neither drawn whole nor left whole; copies count once.
    rows = rows.withColumns({"text": F.col("text").cast("string"), "hash": F.xxhash64(F.col("text").cast("string"))})
    drawn = F.pmod(F.xxhash64(F.lit("learn"), "key", "hash"), F.lit(million)) < F.coalesce(share[F.col("lang")], F.lit(0))
    sample = rows.where(drawn & F.col("text").isNotNull()).dropDuplicates(["key", "lang", "hash"]).select("key", "lang", "text")
    features = sample.mapInArrow(_sparse, "key string, lang string, at binary, x binary")
    part = {
        x: [d for d, (a, b) in enumerate(duels) if (family_of(x) if d < len(model.families) else x) in (a, b)]
        for x in languages
    }
    table = F.create_map(*itertools.chain.from_iterable(
        (F.lit(x), F.array(*map(F.lit, ds))) for x, ds in part.items() if ds
    ))
    entries = features.withColumn("duel", F.explode(table[F.col("lang")]))
    first_families = len(model.families)

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "lang", "at"], kind="stable")
        duel = int(frame["duel"].iloc[0])
        side = duels[duel][0]
        signs = np.array([1 if (family_of(x) if duel < first_families else x) == side else -1 for x in frame["lang"]])
        vectors = [
            (np.frombuffer(at, dtype=np.int32), np.frombuffer(x, dtype=np.float32).astype(np.float64))
            for at, x in zip(frame["at"], frame["x"])
        ]
        weights, bias = train_duel(vectors, signs, cost, passes)
        return pd.DataFrame({"duel": [duel], "w": [weights.astype(np.float32).tobytes()], "b": [bias]})

    trained = {r.duel: r for r in entries.groupBy("duel").applyInPandas(train, "duel int, w binary, b double").collect()}
    blank = np.zeros(1 << BITS, dtype=np.float32)
    model.weights = np.stack(
        [np.frombuffer(trained[d].w, dtype=np.float32) if d in trained else blank for d in range(len(duels))]
    )
    model.biases = np.array([trained[d].b if d in trained else 0.0 for d in range(len(duels))])
    return model


def guess(model: Model, text: Column) -> Column:
    """Struct of language and score."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict([t if isinstance(t, str) else "" for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text.cast("string"))


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    found = documents.withColumn("_guess", guess(model, F.col(text)))
    return found.withColumns({"lang_pred": F.col("_guess.lang_pred"), "score": F.col("_guess.score")}).drop("_guess")


def keep_known(documents: DataFrame, model: Model, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Rows whose language is known and wins its duels; columns stay as they are."""
    found = documents.select(F.struct("*").alias("_doc"), guess(model, F.col(text)).alias("_guess"))
    known = (F.col("_guess.lang_pred") != UNKNOWN) & (F.col("_guess.score") >= min_score)
    return found.where(known).select(*(F.col("_doc")[c].alias(c) for c in documents.columns))
