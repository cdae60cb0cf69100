"""Packing by length: optimal buckets from the global histogram, token-budget batches inside each bucket.

Sequences longer than ``MAX_LENGTH`` tokens are cut into pieces of that many, so the histogram of lengths has at
most ``MAX_LENGTH + 1`` rows whatever the corpus holds, and only this histogram comes to the driver. Dynamic
programming over it finds the bucket bounds with the least padding in all. Each bucket is then dealt into
batches of ``budget // bound`` sequences in order of a hash; the numbering splits every bucket into parts, so
a bucket with most of the rows is no single task.

Defined results: a document without words (or null) is one piece of 0 tokens in the first bucket. Repeated rows are sequences of their own.
With no more distinct lengths than buckets nothing is padded. An empty table gives an empty result. Only the
id and the length are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.tables import n_words
from muster.operators.ordering import ranked

MAX_LENGTH = 2048
BUCKETS = 16
BUDGET = 65_536
#: Every bucket is numbered in so many parts.
PARTS = 256


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds that minimise the padding of ``counts`` sequences of the given rising lengths.

    ``cost[j]`` is the least padding of the first j lengths with the buckets used so far; one more bucket that
    holds lengths i to j - 1 pads them to the last of them. All j of a round are computed at once for each i.
    """
    m = len(lengths)
    if m == 0:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    words = np.concatenate(([0], np.cumsum(counts * lengths)))
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    came = []
    for _ in range(min(buckets, m)):
        best, origin = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        best[0] = 0.0
        for i in range(m):
            if np.isinf(cost[i]):
                continue
            total = cost[i] + lengths[i:] * (rows[i + 1 :] - rows[i]) - (words[i + 1 :] - words[i])
            less = total < best[i + 1 :]
            best[i + 1 :][less] = total[less]
            origin[i + 1 :][less] = i
        came.append(origin)
        cost = best
    bounds, j = [], m
    for origin in reversed(came):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(origin[j])
    return sorted(bounds)


def pieces(docs: DataFrame, doc_id: str, length: Column, most: int = MAX_LENGTH) -> DataFrame:
    """(id, piece, start, n_tokens): every sequence whole, in pieces of at most ``most`` tokens."""
    slim = docs.select(F.col(doc_id).alias(doc_id), length.alias("_length"))
    last = F.greatest(F.expr(f"(_length - 1) div {most}"), F.lit(0)).cast("int")
    cut = slim.select(doc_id, "_length", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return cut.select(
        doc_id, "piece", (F.col("piece").cast("bigint") * most).alias("start"),
        F.least(F.col("_length") - F.col("piece").cast("bigint") * most, F.lit(most)).cast("bigint").alias("n_tokens"),
    )


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None,
    max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """(id, piece, start, n_tokens, bucket_len, batch, slot) of every piece of every document.

    ``length`` is the number of tokens, by default of words. ``batch`` numbers the batches of a bucket from 0,
    ``slot`` the sequences of a batch from 0; a batch padded to its ``bucket_len`` has at most ``budget`` tokens.
    """
    if budget < max_length:
        raise ValueError("the budget is below the longest sequence")
    parts = pieces(docs, doc_id, n_words(text) if length is None else length, max_length)
    histogram = parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("n_tokens")
    bounds = best_bounds(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    bounds = [max(b, 1) for b in bounds] or [1]
    bound = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]).cast("bigint")
    sized = parts.withColumn("bucket_len", bound)
    order = [F.xxhash64(doc_id, "piece"), F.col(doc_id), F.col("piece")]
    numbered = ranked(sized, ["bucket_len"], [F.pmod(F.xxhash64(doc_id, "piece"), F.lit(PARTS))], order, "_place")
    room = F.expr(f"{budget} div bucket_len")
    place = F.col("_place") - 1
    return numbered.select(
        doc_id, "piece", "start", "n_tokens", "bucket_len",
        F.floor(place / room).cast("bigint").alias("batch"), F.pmod(place, room).cast("bigint").alias("slot"),
    )
