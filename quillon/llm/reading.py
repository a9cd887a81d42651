"""Reading level of English prose by regularised ordinal regression.

1. Word rarity: how often each word occurs in all documents, counted into a fixed number of hash cells on the workers
   and summed by cell, so the table that is sent back has a fixed size whatever the corpus.
2. Fit: proportional-odds regression with an L2 penalty on sentence features, over at most `max_labelled` labelled
   documents (chosen by hash). A document's grade goes to each of its sentences with a weight: after each round, the
   sentences that the model puts far from the grade (quotations from other texts) count less.
3. Score: every sentence of every gradable document gets a level; the document gets the level of most of its
   sentences, ties going to the level with more letters.

Defined results: null, empty, short (under `least` sentences), list-like and non-English texts are not graded and give no
row, nor do rows without an id; equal texts get equal bands; with no labels at all nothing is graded; extra columns are ignored. Texts are read
whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 18
BANDS = 4
LEAST = 5
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*")
#: Where one sentence ends and another may begin: after a mark, at an empty line, before a bullet.
_BREAK = re.compile(r"(?<=[.!?])\s+|\n(?=\s*\n)|\n(?=[ \t]*[-*•]\s)")

# Function words that tell languages apart, and words that link or open clauses.
ENGLISH = set("the of and to in is was with for on that are by at from be your you this when or an as which were it not have has will".split())
OTHERS = set(
    "der die das und mit ist im eine einen wurde nach bei zu von den dem nicht sind ein auf für wegen seit le la les des une un et est dans du avec "
    "pour par sur au aux que qui pas ses depuis el los las una y en con por para del se al es su tras desde lo".split()
) - {"on"}
CONNECTIVES = set("because although though whereas while when if since unless until before after however therefore consequently nevertheless moreover furthermore notwithstanding considering given thus hence accordingly so but whether".split())
OPENERS = set("which that who whose where whom whereby wherein because although whereas while if when since as".split())
PERSONAL = set("you your i my me we us our she he her his they them".split())

#: Numbers per word: letters, syllables, long (8+), very long (11+), connective, clause opener, personal, number, hyphen.
PER_WORD = 9


def _cell(word: str) -> int:
    return zlib.crc32(word.encode()) % CELLS


def _syllables(word: str) -> int:
    groups = len(re.findall(r"[aeiouyáéíóúäöüàèê]+", word))
    return max(1, groups - (word.endswith("e") and not word.endswith("le") and groups > 1))


def sentences(text: str) -> list[str]:
    """Sentences of at least three words that end in a mark; headings, table lines and fragments are none."""
    return [s for s in (part.strip(" \t\r\n-*•") for part in _BREAK.split(text)) if s[-1:] in (".", "!", "?") and len(s.split()) >= 3]


def count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, words = np.zeros(CELLS, dtype=np.int64), Counter()

    def flush() -> None:
        np.add.at(total, [_cell(w) for w in words], list(words.values()))
        words.clear()

    for batch in batches:
        for text in batch["text"]:
            words.update(_WORD.findall(text.lower()))
            if len(words) > 500_000:
                flush()
    flush()
    used = np.flatnonzero(total)
    yield pd.DataFrame({"cell": used.astype(np.int32), "n": total[used]})


class Features:
    """Sentence features of many texts at a time, with a memory of the words met."""

    def __init__(self, counts: np.ndarray):
        self.rarity = -np.log((counts + 1.0) / (counts.sum() + CELLS))
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, PER_WORD + 3))

    def _row(self, word: str) -> int:
        at = self.known[word] = len(self.known)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        letters = len(word)
        self.table[at] = (
            letters, _syllables(word), letters >= 8, letters >= 11, word in CONNECTIVES, word in OPENERS, word in PERSONAL,
            word[0].isdigit(), "-" in word, self.rarity[_cell(word)], word in ENGLISH, word in OTHERS,
        )
        return at

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(features, letters) of the sentences of each text, or None where it is not gradable."""
        if len(self.known) > 500_000:
            self.known = {}
        known, ids = self.known, []
        sizes, marks, letters, owner = [], [], [], []
        for k, text in enumerate(texts):
            found = sentences(text)
            if len(found) < LEAST:
                continue
            words = [(s, _WORD.findall(s.lower())) for s in found]
            words = [(s, w) for s, w in words if len(w) >= 3]
            if len(words) < LEAST:
                continue
            for s, own in words:
                ids += [known[w] if w in known else self._row(w) for w in own]
                sizes.append(len(own))
                marks.append(s.count(",") + s.count(";") + s.count(":"))
                letters.append(len(s))
                owner.append(k)
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        if not ids:
            return out
        ids, n, owner = np.array(ids), np.array(sizes), np.array(owner)
        end = np.cumsum(n)
        table, sentence = self.table[ids], np.repeat(np.arange(len(n)), n)
        sums = np.add.reduceat(table, end - n, axis=0)
        mean = sums / n[:, None]
        rare = table[np.lexsort((table[:, 9], sentence)), 9]
        distinct = np.bincount(np.unique(sentence * len(self.known) + ids) // len(self.known), minlength=len(n))
        x = np.column_stack([
            np.log(n), mean[:, :4], sums[:, 4], sums[:, 5] + marks, mean[:, 6:10], (rare[end - 1] + rare[end - 2] + rare[end - 3]) / 3,
            distinct / n, np.maximum.reduceat(table[:, 0], end - n),
        ])
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        english, others, total = (np.add.reduceat(v, first) for v in (sums[:, 10], sums[:, 11], n))
        weight = np.array(letters, dtype=np.float64)
        for at, stop, ok in zip(first, np.r_[first[1:], len(n)], (english > others) & (english >= 0.04 * total)):
            if ok:
                out[owner[at]] = x[at:stop], weight[at:stop]
        return out


@dataclass
class Ordinal:
    """Proportional odds: P(level > k) = sigmoid(x.w - cuts[k])."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cuts: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def chances(self, x: np.ndarray) -> np.ndarray:
        above = 1 / (1 + np.exp(-np.clip(self.score(x)[:, None] - self.cuts[None], -40, 40)))
        full = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        return np.maximum(full[:, :-1] - full[:, 1:], 1e-12)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, before: Ordinal | None = None, l2: float = 1e-3, rounds: int = 400, rate: float = 0.05) -> Ordinal:
    """Maximum penalised likelihood by Adam; y in 0..BANDS-1. Goes on from `before`, fitted to the same x, if given."""
    mean, scale = (before.mean, before.scale) if before else (x.mean(axis=0), x.std(axis=0) + 1e-9)
    z = (x - mean) / scale
    total = weight.sum()
    share = np.array([weight[y > k].sum() / total for k in range(BANDS - 1)]).clip(0.01, 0.99)
    p = np.concatenate([np.zeros(x.shape[1]), [-np.log(share[0] / (1 - share[0]))], np.full(BANDS - 2, 0.0)])
    d = x.shape[1]
    if before:
        p = np.concatenate([before.w, before.cuts[:1], np.log(np.maximum(np.diff(before.cuts), 1e-6))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        steps = np.exp(p[d + 1 :])
        cuts = p[d] + np.concatenate([[0.0], np.cumsum(steps)])
        above = 1 / (1 + np.exp(-np.clip(z @ p[:d, None] - cuts[None], -40, 40)))
        full = np.hstack([np.ones((len(z), 1)), above, np.zeros((len(z), 1))])
        slope = full * (1 - full)
        rows = np.arange(len(z))
        chance = np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)
        upper, lower = slope[rows, y] / chance * weight, slope[rows, y + 1] / chance * weight
        g_score = (upper - lower) / total
        g_cut = np.zeros(BANDS - 1)
        np.add.at(g_cut, y[y > 0] - 1, -upper[y > 0] / total)
        np.add.at(g_cut, y[y < BANDS - 1], lower[y < BANDS - 1] / total)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = -np.concatenate([z.T @ g_score, [tail[0]], tail[1:] * steps])
        g[:d] += l2 * p[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Ordinal(mean, scale, p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]))


def fit_sentences(docs: list[tuple[np.ndarray, np.ndarray]], bands: np.ndarray, share: np.ndarray | None = None, rounds: int = 3) -> Ordinal:
    """Sentence model from document grades, each with its share; sentences unlike their document's grade lose weight round
    by round."""
    x = np.vstack([f for f, _ in docs])
    owner = np.repeat(np.arange(len(docs)), [len(f) for f, _ in docs])
    y = bands[owner] - 1
    given = np.ones(len(x)) if share is None else share[owner]
    weight, model = given, None
    for k in range(rounds):
        model = fit(x, y, weight, model, rounds=150 if model else 400)
        weight = given * (model.chances(x)[np.arange(len(x)), y] ** 2 + 1e-3)
    return model


def bands_of(model: Ordinal, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The level of most of the sentences of each text, the longer ones and then the lower level on ties."""
    x, letters = (np.concatenate(v) for v in zip(*docs))
    cell = np.repeat(np.arange(len(docs)), [len(f) for f, _ in docs]) * BANDS + model.chances(x).argmax(axis=1)
    held, size = (np.bincount(cell, w, minlength=len(docs) * BANDS).reshape(-1, BANDS) for w in (None, letters))
    return np.where(held == held.max(axis=1, keepdims=True), size, -1.0).argmax(axis=1) + 1


def grade(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", band: str = "band", max_labelled: int = 20_000,
) -> DataFrame:
    """(doc_id, band) of every gradable document."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = np.zeros(CELLS)
    for cell, n in rows.select("text").mapInPandas(count_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[cell] = n
    graded = (
        labels.where(F.col(band).between(1, BANDS)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.avg(band).alias("band"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    cells = spark.sparkContext.broadcast(counts)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Features(cells.value)
        for batch in batches:
            texts = batch["text"].tolist()
            got = zip(batch["band"], (f for at in range(0, len(texts), 500) for f in own.of(texts[at : at + 500])))
            yield pd.DataFrame([(b, np.asarray(f[0], dtype=np.float64).tobytes(), np.asarray(f[1], dtype=np.float64).tobytes()) for b, f in got if f], columns=["band", "x", "letters"])

    sample = graded.join(rows, "doc_id").select("band", "text").mapInPandas(features, "band double, x binary, letters binary").toPandas().to_dict("records")
    parts = []
    for r in sample:
        x, letters = (np.frombuffer(r[c], dtype=np.float64) for c in ("x", "letters"))
        parts.append((x.reshape(len(letters), -1), letters))
    # A mean between two bands says that one grader was off; such documents count half at the lower and half at the upper one.
    grades = [(k, b, 1 / len(both)) for k, r in enumerate(sample) for both in [sorted({math.floor(r["band"]), math.ceil(r["band"])})] for b in both]
    model = fit_sentences([parts[k] for k, _, _ in grades], np.array([b for _, b, _ in grades], dtype=int), np.array([w for _, _, w in grades])) if parts else None
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Features(cells.value)
        for batch in batches:
            for at in range(0, len(batch) if sent.value is not None else 0, 500):
                part = batch.iloc[at : at + 500]
                got = own.of(part["text"].tolist())
                graded = [k for k, f in enumerate(got) if f]
                if graded:
                    bands = bands_of(sent.value, [got[k] for k in graded])
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[graded], "band": bands})

    return rows.mapInPandas(score, "doc_id long, band int")
