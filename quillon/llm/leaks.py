"""Held-out passages inside a corpus, by winnowing.

The k-gram hashes of every text are thinned to the smallest of each window of w (the rightmost on ties), so that any
span of w + k - 1 words that two texts share leaves the same fingerprint in both. Corpus and test fingerprints are
joined; each hit is extended to both sides over the words themselves and kept at `least` words or more.

While the test side is below `limit` bytes it is sent to the workers whole and the corpus side is not shuffled at all;
beyond it both sides' fingerprints are joined by shuffle and candidate pairs fetch their texts afterwards.

Defined results: null, empty and short texts give no row, nor do rows without an id; a repeated corpus row gives its own pairs under its id;
equal items are each reported; punctuation, case and spacing never matter; extra columns are ignored; an empty side
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.words import Words, letters_and_digits
from quillon.session import fits

LEAST, K = 12, 8
OUT = "doc_id long, item_id long"


def fingerprints(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen fingerprints of all texts and the word each starts at (counted over the batch)."""
    h, owner = words.grams(k)
    place = words.first[owner] + _rank(owner)
    n = len(h) - w + 1
    if n < 1:
        return h[:0], place[:0]
    best, at = h[w - 1 :].copy(), np.arange(w - 1, len(h))
    for back in range(1, w):
        other = h[w - 1 - back : len(h) - back]
        less = other < best
        best[less], at[less] = other[less], (np.arange(w - 1 - back, len(h) - back))[less]
    whole = owner[:n] == owner[w - 1 :]
    chosen = np.unique(at[whole])
    return h[chosen], place[chosen]


def _rank(owner: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal owners."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    return np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)])) if len(owner) else starts


def shared_span(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Start and end in `a` of the longest run of equal words through a[i] = b[j]."""
    start, end = i, i
    while start > 0 and j - (i - start) > 0 and a[start - 1] == b[j - (i - start) - 1]:
        start -= 1
    while end < len(a) and j + (end - i) < len(b) and a[end] == b[j + (end - i)]:
        end += 1
    return start, end


class _Items:
    """The test side: its words and its sorted fingerprints."""

    def __init__(self, ids: list[int], texts: list[str], k: int, w: int):
        self.ids, words = ids, Words(texts, letters_and_digits())
        self.words = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        prints, place = fingerprints(words, k, w)
        order = np.argsort(prints, kind="stable")
        self.prints, place = prints[order], place[order]
        self.item = np.searchsorted(words.first, place, side="right") - 1
        self.at = place - words.first[self.item]

    def pairs(self, ids: list[int], texts: list[str], k: int, w: int, least: int) -> Iterator[tuple[int, int]]:
        words = Words(texts, letters_and_digits())
        prints, place = fingerprints(words, k, w)
        low = np.searchsorted(self.prints, prints)
        hit = low < len(self.prints)
        hit[hit] = self.prints[low[hit]] == prints[hit]
        docs = np.searchsorted(words.first, place[hit], side="right") - 1
        seen: set[tuple] = set()
        done: dict[tuple, int] = {}  # end of the last run looked at, by document, item and alignment; hits come in order
        for value, doc, p, first in zip(prints[hit], docs, place[hit], low[hit]):
            own = words.hashes[words.first[doc] : words.first[doc + 1]]
            i = int(p - words.first[doc])
            while first < len(self.prints) and self.prints[first] == value:
                item, j = int(self.item[first]), int(self.at[first])
                first += 1
                if (doc, item) in seen or i < done.get((doc, item, i - j), 0):
                    continue
                start, end = shared_span(own, i, self.words[item], j)
                done[doc, item, i - j] = end
                if end - start >= least:
                    seen.add((doc, item))
                    yield ids[doc], self.ids[item]


def find(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "free_text",
    least: int = LEAST, k: int = K, limit: int = 32 << 20,
) -> DataFrame:
    """Every (doc_id, item_id) that share `least` or more consecutive words."""
    w = least - k + 1
    left = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    right = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    if fits(right, limit):
        rows = right.collect()
        sent = docs.sparkSession.sparkContext.broadcast(_Items([r[0] for r in rows], [r[1] for r in rows], k, w))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = list(sent.value.pairs(batch["doc_id"].tolist(), batch["text"].tolist(), k, w, least))
                yield pd.DataFrame(found, columns=["doc_id", "item_id"], dtype="int64")

        return left.mapInPandas(run, OUT)
    return _joined(left, right, k, w, least)


def _joined(left: DataFrame, right: DataFrame, k: int, w: int, least: int, together: int = 64) -> DataFrame:
    """For a long list of items: fingerprints joined by shuffle (frequent ones are split by adaptive skew handling), then texts."""
    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = Words(batch["text"].tolist(), letters_and_digits())
            h, place = fingerprints(words, k, w)
            owner = np.searchsorted(words.first, place, side="right") - 1
            ids = batch.iloc[:, 0].to_numpy()
            yield pd.DataFrame({"id": ids[owner], "h": h.view(np.int64)}).drop_duplicates()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for doc, body, items in batch.itertuples(index=False):
                keep += _Items([i["item_id"] for i in items], [i["text"] for i in items], k, w).pairs([doc], [body], k, w, least)
            yield pd.DataFrame(keep, columns=["doc_id", "item_id"], dtype="int64")

    a = left.mapInPandas(prints, "id long, h long").withColumnRenamed("id", "doc_id")
    b = right.mapInPandas(prints, "id long, h long").withColumnRenamed("id", "item_id")
    pairs = a.join(b, "h").select("doc_id", "item_id").distinct()
    # A document meets at most `together` items at a time, so it travels once for them and no group grows with the data.
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_id"))
    parts = pairs.withColumn("part", F.floor((nth - 1) / together)).join(right, "item_id")
    groups = parts.groupBy("doc_id", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    return groups.join(left, "doc_id").select("doc_id", "text", "items").mapInPandas(check, OUT)
