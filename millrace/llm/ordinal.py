"""Operator 9: a quality classifier by ordinal cumulative-link regression.

A document's grade is one of 0 < 1 < ... < K-1. One weight for each hashed feature gives a score, and
P(grade >= k) = sigmoid(score - threshold_k) with ordered thresholds; so all grades share the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import U64, WordHasher, by_bytes, keep, mix, small_batches, utf8

#: Hashed features: words and their beginnings go to the first BUCKETS, text statistics to the rest.
BUCKETS = 1 << 18
#: Labelled rows that a fit uses at most; beyond it, those with the smallest hashes of their ids.
FIT_ROWS = 6_000
EPOCHS = 100
#: Log ratios up to this, and so many standard errors more, are taken for chance.
LEAST_RATIO, ERRORS = 1.2, 1.0
#: Fitted features occur in at least so many labelled texts.
LEAST_TEXTS = 8
#: Words are features whole and by their first bytes, as inflected and compound words share those.
PREFIXES = (4, 5)
_STEPS = 12
#: Upper edges of the levels into which each statistic is cut; a level is a feature.
_LEVELS = np.array([0.005, 0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8])
_STATISTICS = 5
DIMENSIONS = BUCKETS + _STATISTICS * _STEPS

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True
#: Punctuation parts words, so that a word is the same before a comma.
_BARE = np.arange(256, dtype=np.uint8)
_BARE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


class Features:
    """Binary features of a batch of texts: row and column of each. A word counts once in a text, however long or repetitive that is."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        bare, rows, columns = _BARE[data], [], []
        for first_bytes in (None, *PREFIXES):
            _, _, row, word = self.hasher.words(bare, offsets, first_bytes)
            if first_bytes:
                word = mix(word + U64(first_bytes))
            _, once = np.unique(mix(word ^ (row.astype(U64) * U64(0x9E3779B97F4A7C15))), return_index=True)
            rows.append(row[once])
            columns.append((word[once] % U64(BUCKETS)).astype(np.int64))
        words, distinct = np.bincount(row, minlength=n), np.bincount(rows[0], minlength=n)
        size = np.maximum(np.diff(offsets), 1)

        def share(table: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(table[data])]
            return total[offsets[1:]] - total[offsets[:-1]]

        letters = np.maximum(share(_LETTER), 1)
        statistics = [share(_UPPER) / letters, share(_SIGN) / size, distinct / np.maximum(words, 1), 1 - letters / size, np.minimum(1, words / 2000)]
        for i, x in enumerate(statistics):
            rows.append(np.arange(n))
            columns.append(BUCKETS + i * _STEPS + np.searchsorted(_LEVELS, x))
        return np.concatenate(rows), np.concatenate(columns)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) for k = 1 ... K-1, one row for each text."""
        score = np.bincount(rows, self.weights[columns], n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def telling(within: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How far each feature enters a fit, 0 for not at all: the largest log ratio of its shares in two grades, less what chance gives. within: texts of each grade with the feature; counts: all of them."""
    ratios = []
    for a in range(len(counts)):
        for b in range(a):
            share_a, share_b = ((within[g] + 1) / (counts[g] + 2) for g in (a, b))
            error = np.sqrt(1 / (within[a] + 1) + 1 / (within[b] + 1))
            ratios.append(np.abs(np.log(share_a / share_b)) - ERRORS * error)
    often = within.sum(0) >= min(LEAST_TEXTS, max(1, int(counts.sum()) // 50))
    return np.where(often, np.maximum(np.max(ratios, axis=0) - LEAST_RATIO, 0), 0)


def gradient(parameters: np.ndarray, rows: np.ndarray, column: np.ndarray, scale: np.ndarray, grade: np.ndarray, weight: np.ndarray, decay: float) -> np.ndarray:
    """Of the weighted mean negative log likelihood plus decay/2 times the squared weights. parameters: weights, the first threshold, logs of the steps to the next ones."""
    n, n_used = len(grade), len(scale)
    w, t0, gaps = parameters[:n_used], parameters[n_used], np.exp(parameters[n_used + 1 :])
    thresholds = t0 + np.r_[0, np.cumsum(gaps)]
    score = np.bincount(rows, (w * scale).astype(np.float32)[column], n)
    tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -30, 30)))
    upper = np.c_[np.ones(n), tail][np.arange(n), grade]
    lower = np.c_[tail, np.zeros(n)][np.arange(n), grade]
    p = np.maximum(upper - lower, 1e-9)
    d_score = -weight * (upper * (1 - upper) - lower * (1 - lower)) / p / n
    d_threshold = np.zeros(len(thresholds))
    for k in range(len(thresholds)):
        slope = tail[:, k] * (1 - tail[:, k]) * weight / p / n
        d_threshold[k] = slope[grade == k + 1].sum() - slope[grade == k].sum()
    above = np.cumsum(d_threshold[::-1])[::-1]
    return np.r_[scale * np.bincount(column, d_score.astype(np.float32)[rows], n_used) + decay * w, above[0], above[1:] * gaps]


def fit_features(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, n_grades: int, scale: np.ndarray, decay: float = 5e-3, rate: float = 0.05) -> Model:
    """Maximum likelihood with weight decay by Adam; thresholds are the first plus positive steps, so they stay ordered.

    rows and columns: features of the texts (32-bit). A feature enters with its ``scale`` (see ``telling``), so that the decay holds
    down what says little about the grades. The same rows give the same model.
    """
    used = np.flatnonzero(scale > 0)
    place = np.full(len(scale), -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    column = place[columns]
    rows, column = rows[column >= 0], column[column >= 0]
    counts = np.bincount(grade, minlength=n_grades).astype(float)
    weight = (len(grade) / (n_grades * np.maximum(counts, 1)))[grade]  # each grade matters alike
    parameters = np.zeros(len(used) + n_grades - 1)
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, EPOCHS + 1):
        slope = gradient(parameters, rows, column, scale[used], grade, weight, decay)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        parameters -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = parameters[: len(used)] * scale[used]
    return Model(weights, parameters[len(used)] + np.r_[0, np.cumsum(np.exp(parameters[len(used) + 1 :]))])


def fit(texts: list[str | None], grades: list[int], n_grades: int) -> Model:
    """The model of a few texts at hand; tables are fitted by ``fit_on``."""
    row, column = Features()(*utf8(pa.array(texts, pa.large_string())))
    grade = np.asarray(grades)
    within = np.array([np.bincount(column[grade[row] == g], minlength=DIMENSIONS) for g in range(n_grades)])
    return fit_features(row.astype(np.int32), column.astype(np.int32), grade, n_grades, telling(within, np.bincount(grade, minlength=n_grades)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        for part in by_bytes(batch, "text", 1 << 20):
            row, column = features(*utf8(part.column("text")))
            order = np.argsort(row, kind="stable")
            starts = np.searchsorted(row[order], np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(column[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), lists], ["doc_id", "grade", "features"])


def fit_on(documents: DataFrame, labels: DataFrame, grade: Column, n_grades: int, most: int = FIT_ROWS) -> Model | None:
    """Fit on at most ``most`` labelled documents, those with the smallest hashed ids; None if there is no labelled text.

    Of documents or labels that repeat an id, the smallest text and the highest grade count. Tasks turn texts into features and count them; the driver gets the counts, of
    at most DIMENSIONS features, and then the telling features of each chosen document.
    """
    graded = labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = small_batches(documents).select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"))
    featured = keep(rows.mapInArrow(_featured, "doc_id bigint, grade int, features array<int>"))
    counts = np.zeros(n_grades, np.int64)
    for r in featured.groupBy("grade").count().collect():
        counts[r[0]] = r[1]
    if not counts.sum():
        return None
    of_grade = [F.count_if(F.col("grade") == g).cast("int").alias(f"g{g}") for g in range(n_grades)]
    found = featured.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(*of_grade).toArrow()
    within = np.zeros((n_grades, DIMENSIONS), np.int32)
    for g in range(n_grades):
        within[g, found["feature"].to_numpy()] = found[f"g{g}"].to_numpy()
    scale = telling(within, counts)
    tells = scale > 0

    def chosen_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
            kept = tells[values]
            ends = np.r_[0, np.cumsum(kept)][starts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[kept]))], ["doc_id", "grade", "features"])

    table = featured.mapInArrow(chosen_features, featured.schema).toArrow().sort_by("doc_id").combine_chunks()
    lists = table["features"].combine_chunks()
    rows_of = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    return fit_features(rows_of, lists.flatten().to_numpy(), table["grade"].to_numpy(), n_grades, scale)


def score(df: DataFrame, model: Model | None, n_grades: int, carry: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``carry`` of every row with ``expected_grade`` (0 to K-1) and ``top_probability`` (of the highest grade), over the whole text.

    A null text scores as an empty one; null and repeated ids keep a row each; other columns are not read. Carried columns with
    the names of the two results give way to them. Without a model (no labelled text) every document gets the highest grade. No shuffle.
    """
    results = ["expected_grade", "top_probability"]
    carry = [c for c in carry if c not in results]
    source = small_batches(df).select(*carry, F.col(text_column).alias("_scored_text"))
    schema = StructType([*source.schema.fields[: len(carry)], *(StructField(c, DoubleType()) for c in results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            at = batch.num_columns - 1
            for part in by_bytes(batch, at, 1 << 20):
                n = part.num_rows
                tails = model.tails(*features(*utf8(part.column(at))), n) if model else np.ones((n, n_grades - 1))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(tails.sum(1)), pa.array(np.ascontiguousarray(tails[:, -1]))], [*carry, *results])

    return source.mapInArrow(run, schema)
