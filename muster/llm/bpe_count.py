"""Token counts of byte-pair encoding by heap and linked list, without making any identifiers.

A text is cut where no merge can reach across, at the begin of each run of blanks and around characters that
no longer piece holds. The symbols of a part are linked to their neighbours, and all adjacent pairs that are
pieces stand in a heap by rank and place. The least pair is popped, merged and its new neighbours are pushed,
until the heap is empty; the count is the number of symbols less the merges, and a symbol that is no piece
counts its UTF-8 bytes (byte fallback). Parts repeat, so each worker keeps the counts of those it met, up to
``KEPT_PARTS``; a part over ``LONGEST_KEPT`` characters is counted but not kept.

The vocabulary file is a parameter. It must be a BPE model with byte fallback, identity normalization and a
dummy prefix, without user-defined pieces; anything else raises.

Defined results: null and empty texts have no bytes and no tokens. Special strings in a text are ordinary text.
Every text is counted whole, and repeated rows get the same count each.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT_PARTS = 1_000_000
LONGEST_KEPT = 64
BLANK = "▁"


class Counter(dict):
    """Tokens by part of a text; a part that is not kept yet is merged."""

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        probe = "  a ½　ﬁ  "
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK) or not any(model.is_byte(i) for i in ids):
            raise ValueError(f"{path}: only BPE with a dummy prefix, identity normalization and byte fallback is counted")
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        longer = [p for p in self.rank if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in longer):
            raise ValueError(f"{path}: pieces with a blank after other characters are not counted")
        #: line feeds stand alone when no longer piece holds one
        self.parts = re.compile(
            f"{BLANK}*[^{BLANK}]+|{BLANK}+" if any("\n" in p for p in longer) else f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+"
        )

    def __missing__(self, part: str) -> int:
        n = self.merged(part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= KEPT_PARTS:
                self.clear()
            self[part] = n
        return n

    def merged(self, part: str) -> int:
        """The tokens of one part."""
        rank = self.rank
        text = list(part)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap = []
        for i in range(len(text) - 1):
            pair = text[i] + text[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        count = len(text)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if text[i] is None or j >= len(text) or text[i] + text[j] != pair:
                continue  # one of the two was merged meanwhile
            text[i], text[j] = pair, None
            count -= 1
            after = right[i] = right[j]
            if after < len(text):
                left[after] = i
                joined = pair + text[after]
                if joined in rank:
                    heapq.heappush(heap, (rank[joined], i, joined))
            before = left[i]
            if before >= 0:
                joined = text[before] + pair
                if joined in rank:
                    heapq.heappush(heap, (rank[joined], before, joined))
        return count + sum(len(s.encode("utf-8")) - 1 for s in text if s is not None and len(s) == 1 and s not in rank)

    def tokens(self, text: str) -> int:
        """The tokens of a whole text."""
        if not text:
            return 0
        return sum(map(self.__getitem__, self.parts.findall(BLANK + text.replace(" ", BLANK))))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a vocabulary file, made once in each worker."""
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text column; ``path`` is the vocabulary file, present on every executor."""

    @F.arrow_udf("bigint")
    def count_batch(texts: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([own.tokens(t) for t in pc.fill_null(texts, "").to_pylist()], pa.int64())

    return count_batch(text)
