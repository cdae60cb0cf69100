"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts the n-grams of labelled texts by language and bucket; ``predict`` sends the matrix of log
probabilities to all tasks and scores whole Arrow batches as a sparse product in numpy.

Letters are lower-cased, every other character counts as a blank, and an n-gram counts when it has a letter.
The matrix has ``BUCKETS`` entries for each language, of which there may be ``MOST_LANGUAGES``, so what
is sent out has a fixed bound whatever the size of the corpus.

Defined results: a null text, an empty text or one without a letter is ``und`` with score 0; so is every text
when nothing could be learned. Rows whose text or label is null teach nothing. Equal scores go to the language
that comes first by code point. Repeated rows count as often as they occur. A column that already has the name
of a result column is replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm import flat
from muster.llm.tables import bounded_batches, kept
from muster.operators.sizing import sent_out

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MOST_LANGUAGES = 256
#: About so many labelled texts are learned from; of more, a part chosen by the hash of the text.
TRAINING_TEXTS = 500_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Bound of the likelihood of a language, in distances of its quartiles, and how many texts it takes to set one.
REACH, LEAST_TEXTS = 10, 30
_STEP = 1 << 19

_is_letter: list[np.ndarray] = []


class Model(NamedTuple):
    """Languages by code point, their log priors, and log probabilities by language and bucket."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray


def _letters() -> np.ndarray:
    if not _is_letter:
        table = np.zeros(0x110000, dtype=bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _is_letter.append(table)
    return _is_letter[0]


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of a slice, in steps of bounded size."""
    points, offsets = flat.code_points(pc.utf8_lower(texts))
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    for start in range(0, len(points), _STEP):
        for order in ORDERS:
            stop = min(start + _STEP, len(points) - order + 1)
            if stop <= start:
                continue
            mix = np.full(stop - start, order, dtype=np.uint64)
            real = np.zeros(stop - start, dtype=bool)
            with np.errstate(over="ignore"):
                for k in range(order):
                    mix = (mix + points[start + k : stop + k]) * np.uint64(0x9E3779B97F4A7C15)
                    mix ^= mix >> np.uint64(29)
                    real |= letter[start + k : stop + k]
            if order > 1:
                real &= rows[start:stop] == rows[start + order - 1 : stop + order - 1]
            yield rows[start:stop][real], ((mix * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48))[real].astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language and bucket of a task; the first bucket -1 holds the number of texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), dtype=object)
        for first, part in flat.slices(batch.column(0)):
            own = labels[first : first + len(part)]
            for label in set(own.tolist()):
                sums = counts.setdefault(label, np.zeros(BUCKETS + 1, dtype=np.int64))
                mine = own == label
                sums[BUCKETS] += int(mine.sum())
                for _, buckets in _grams(part.filter(pa.array(mine))):
                    sums[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
    for label, sums in counts.items():
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())],
            names=["label", "bucket", "n"],
        )


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", training_texts: int = TRAINING_TEXTS) -> Model:
    """Learn from the rows with text and label. The part beyond ``training_texts`` is left out by hash."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    bounded_batches(labelled.sparkSession)
    n = rows.count()
    if n > training_texts:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(training_texts / n * (1 << 30)))
    sums = rows.mapInArrow(_counted, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = sums.where(F.col("bucket") == BUCKETS).orderBy("label").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    languages = [r["label"] for r in found]
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    # at most BUCKETS + 1 numbers for each of at most MOST_LANGUAGES languages come to the driver
    table = sums.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).toPandas()
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    for name, cells in zip(table["label"], table["cells"]):
        at = languages.index(name)
        for cell in cells:
            if cell["bucket"] < BUCKETS:
                counts[cell["bucket"], at] += cell["n"]
    texts = np.array([r["n"] for r in found], dtype=np.float64)
    return Model(languages, np.log(texts / texts.sum()), np.ascontiguousarray(np.log(counts / counts.sum(axis=0)).T))


def scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each text, -1 for none, and its posterior probability."""
    return _scored(texts, model)[:2]


def _scored(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``scores``, with the mean log probability of a text's n-grams, each in the language that knows it best, and how many they are."""
    n = len(texts)
    best, score, likelihood, grams = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    if not model.languages:
        return best, score, likelihood, grams
    known = model.weights.max(axis=0)
    for first, part in flat.slices(texts):
        sums = np.tile(model.prior, (len(part), 1))
        seen = np.zeros(len(part), dtype=bool)
        total = np.zeros(len(part))
        for rows, buckets in _grams(part):
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            seen[rows[starts]] = True
            grams[first + rows[starts]] += np.diff(np.append(starts, len(rows)))
            total[rows[starts]] += np.add.reduceat(known.take(buckets), starts)
            # the n-grams of a step by row and bucket are the sparse matrix; its product with a column of the
            # weights is a sum of their entries by row
            for at, column in enumerate(model.weights):
                sums[rows[starts], at] += np.add.reduceat(column.take(buckets), starts)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        top = sums.argmax(axis=1)
        span = slice(first, first + len(part))
        best[span] = np.where(seen, top, -1)
        score[span] = np.where(seen, odds.max(axis=1) / odds.sum(axis=1), 0.0)
        likelihood[span] = total / np.maximum(grams[span], 1)
    return best, score, likelihood, grams


def predicted(model: Model, spark, text: Column) -> Column:
    """A struct (lang_pred, score, likelihood, grams) for a text column; the model is sent to the executors once."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, likelihood: double, grams: bigint>")
    def predict_batch(texts: pa.Array) -> pa.Array:
        own = sent.value
        best, *numbers = _scored(texts, own)
        flat.give_back()
        names = pa.array([*own.languages, UNKNOWN], pa.string())
        return pa.StructArray.from_arrays(
            [names.take(pa.array(best % len(names))), *map(pa.array, numbers)], names=["lang_pred", "score", "likelihood", "grams"]
        )

    return predict_batch(text)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df`` with ``lang_pred`` and ``score``."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    told = df.select(*own, predicted(model, df.sparkSession, F.col(text)).alias("_told"))
    return told.select(*[c for c in told.columns if c != "_told"], "_told.lang_pred", "_told.score")


def known_texts(df: DataFrame, model: Model, text: str = "text", label: str = "lang") -> DataFrame:
    """The rows whose text reads like the language it is told to be: all columns of ``df`` with ``lang_pred`` and ``score``.

    A text of noise or of a language that nobody labelled still gets the language that fits least badly, with a score
    near 1, as the probabilities of many n-grams are multiplied. Its mean log probability of an n-gram is low, though, in whatever
    language knows the n-gram best, so that a text in two known languages is no noise. The lower bound of a language lies below the lower quartile of its rightly told, labelled texts by ``REACH`` times the distance of the
    quartiles; for a text with fewer n-grams than their median that distance grows as the mean of few numbers varies. Equal
    texts count once. A language with under ``LEAST_TEXTS`` such texts has no bound. Rows with ``und`` go, as do even votes.

    The texts are read twice, for the bounds and for the rows, so that no second copy of the table lies on disk.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    judged = predicted(model, df.sparkSession, F.col(text)).alias("_told")  # goes by the text alone: both passes tell the same
    right = df.select(F.col(label).alias("_label"), judged).where("_label = _told.lang_pred AND _told.grams > 0")
    right = right.select("_told.lang_pred", "_told.likelihood", "_told.grams").distinct()
    bounds = right.groupBy(F.col("lang_pred").alias("_of")).agg(
        F.percentile_approx("likelihood", [0.25, 0.75], 10_000).alias("_q"), F.percentile_approx("grams", 0.5).alias("_n"), F.count(F.lit(1)).alias("_texts")
    )
    wider = F.greatest(F.lit(1.0), F.sqrt(F.col("_n") / F.col("_told.grams")))
    least = F.col("_q")[0] - REACH * (F.col("_q")[1] - F.col("_q")[0]) * wider
    fits = (F.coalesce("_texts", F.lit(0)) < LEAST_TEXTS) | (F.col("_told.likelihood") >= least)
    found = df.select(*own, judged).join(sent_out(kept(bounds, "bounds")), F.col("_told.lang_pred") == F.col("_of"), "left")
    # one condition that needs both sides: a part of it alone would be pushed below the join and judge the texts once more
    found = found.where(F.when((F.col("_told.lang_pred") != UNKNOWN) & (F.col("_told.score") > 0.5), fits).otherwise(F.lit(False)))
    return found.select(*own, "_told.lang_pred", "_told.score")
