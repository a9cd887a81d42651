"""Personal information in free text: a character-level bidirectional LSTM with a CRF on top, in numpy.

Texts are cut into overlapping windows that are run in large batches through both directions at once; label scores of
overlapping windows are weighted by their distance from the window's edge and summed, and one Viterbi pass over the
whole text reconciles them. Exact checks follow: spans are brought to word limits, titles and labels are taken off,
and a span must have what its kind needs (digits, an @ or its written form, capitals). A number right behind the name of the
other kind of number (a phone behind MRN, an identity number behind Tel.) is of that kind;
a person's name at the head of an address is taken off it.

The weights are made by `pii_train` from generated, labelled text and stand beside this module.

Defined results: null, empty and blank texts have no findings and are returned as they are; rows without an id have no
findings; offsets count characters from
0; equal texts get equal findings; texts of over a million characters are cut at the end of a paragraph,
line or sentence and read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("name", "phone", "email", "id_number", "address")
LABELS = 1 + 2 * len(KINDS)  # 0 outside, 2k + 1 first character, 2k + 2 further ones of kind k
WINDOW, STRIDE = 256, 216
#: Characters tagged at a time; bounds the memory of a worker.
PART = 1 << 20
CHARS = 102


@lru_cache
def char_table() -> np.ndarray:
    """Character numbers of the basic plane; the last stands for everything else."""
    table = np.full(0x10000, 101, dtype=np.int16)
    table[32:127] = np.arange(95)
    table[ord("\n")], table[ord("\r")], table[9], table[0xA0] = 95, 96, 0, 0
    for c in (0xAD, 0xAC, 0x2010, 0x2011):
        table[c] = 97
    for c in range(0xC0, 0x250):
        table[c] = 98 if chr(c).isupper() else 99
    return table


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return char_table()[np.minimum(codes, 0xFFFF)]


class Tagger:
    """Weights: table (2, CHARS, 4H) of input projections, wh (2, H, 4H), wo (2, H, LABELS), bo, trans, start."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, dtype=np.float32) for k, v in weights.items()}
        self.h = self.w["wh"].shape[1]
        # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: with the halving in the weights one tanh serves all four gates.
        for name in ("wh", "table"):
            self.w[name][:, :, : 3 * self.h] *= 0.5

    @classmethod
    def load(cls, path: str | None = None) -> Tagger:
        with np.load(path or Path(__file__).with_name("pii_model.npz")) as held:
            return cls({k: held[k] for k in held.files})

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Label scores (B, T, LABELS) of windows ids (B, T)."""
        b, t = ids.shape
        n, table, wh, wo = self.h, self.w["table"], self.w["wh"], self.w["wo"]
        out = np.zeros((b, t, LABELS), dtype=np.float32) + self.w["bo"]
        h = np.zeros((2, b, self.h), dtype=np.float32)
        c = np.zeros_like(h)
        gates = np.empty((2, b, 4 * n), dtype=np.float32)
        for k in range(t):
            np.matmul(h, wh, out=gates)
            gates[0] += table[0][ids[:, k]]
            gates[1] += table[1][ids[:, t - 1 - k]]
            np.tanh(gates, out=gates)
            gates[:, :, : 3 * n] *= 0.5
            gates[:, :, : 3 * n] += 0.5
            c *= gates[:, :, n : 2 * n]
            c += gates[:, :, :n] * gates[:, :, 3 * n :]
            np.tanh(c, out=h)
            h *= gates[:, :, 2 * n : 3 * n]
            out[:, k] += h[0] @ wo[0]
            out[:, t - 1 - k] += h[1] @ wo[1]
        return out

    def emissions(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Label scores of each whole text, from overlapping windows."""
        place, rows = [], []
        for n, ids in enumerate(texts):
            for at in range(0, max(1, len(ids) - (WINDOW - STRIDE)), STRIDE):
                row = np.zeros(WINDOW, dtype=np.int16)
                piece = ids[at : at + WINDOW]
                row[: len(piece)] = piece
                if len(piece) < WINDOW:
                    row[len(piece) :] = 95
                place.append((n, at, len(piece)))
                rows.append(row)
        edge = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
        total = [np.zeros((len(ids), LABELS), dtype=np.float32) for ids in texts]
        weight = [np.full(len(ids), 1e-6, dtype=np.float32) for ids in texts]
        for first in range(0, len(rows), 1024):
            got = self.scores(np.stack(rows[first : first + 1024]))
            for (n, at, size), score in zip(place[first : first + 1024], got):
                w = edge[:size].copy()
                if at == 0:
                    w[: WINDOW // 2] = WINDOW // 2
                if at + size == len(texts[n]):
                    w[-(WINDOW // 2) :] = np.maximum(w[-(WINDOW // 2) :], WINDOW // 2)
                total[n][at : at + size] += score[:size] * w[:, None]
                weight[n][at : at + size] += w
        return [s / w[:, None] for s, w in zip(total, weight)]

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best label path of each text; texts of like length go together."""
        paths: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(emissions)
        order = sorted((n for n, e in enumerate(emissions) if len(e)), key=lambda n: len(emissions[n]))
        groups: list[list[int]] = []
        trans = self.w["trans"]
        for n in order:  # padded to the longest, a group stays below a fixed number of characters
            if not groups or len(groups[-1]) >= 512 or (len(groups[-1]) + 1) * len(emissions[n]) > PART:
                groups.append([])
            groups[-1].append(n)
        for group in groups:
            longest, size = len(emissions[group[-1]]), len(group)
            # Labels by texts, so that every step works along the texts.
            score = np.zeros((longest, LABELS, size), dtype=np.float32)
            for k, n in enumerate(group):
                score[: len(emissions[n]), :, k] = emissions[n]
                score[len(emissions[n]) :, 1:, k] = -100.0
            back = np.zeros((longest, LABELS, size), dtype=np.int8)
            best = self.w["start"][:, None] + score[0]
            for t in range(1, longest):
                top = best[0] + trans[0][:, None]
                source = back[t]
                for label in range(1, LABELS):
                    other = best[label] + trans[label][:, None]
                    better = other > top
                    np.copyto(source, label, where=better)
                    np.maximum(top, other, out=top)
                best = top + score[t]
            state, path = best.argmax(axis=0), np.zeros((longest, size), dtype=np.int8)
            rows = np.arange(size)
            for t in range(longest - 1, -1, -1):
                path[t] = state
                state = back[t, state, rows]
            for k, n in enumerate(group):
                paths[n] = path[: len(emissions[n]), k]
        return paths

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of every finding in each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        part: list[tuple[int, int, str]] = []
        size = 0
        for n, text in enumerate(texts):
            for at, piece in segments(text):
                if size + len(piece) > PART and part:
                    self._spans(part, out)
                    part, size = [], 0
                part.append((n, at, piece))
                size += len(piece)
        self._spans(part, out)
        return out

    def _spans(self, part: list[tuple[int, int, str]], out: list[list[tuple[int, int, str]]]) -> None:
        paths = self.decode(self.emissions([encode(piece) for _, _, piece in part]))
        for (n, at, piece), path in zip(part, paths):
            out[n] += [(at + a, at + b, kind) for a, b, kind in checked(piece, raw_spans(path))]


def segments(text: str) -> list[tuple[int, str]]:
    """The text whole, or for very long ones in pieces of up to PART characters that end with a paragraph, line or sentence."""
    out, at = [], 0
    while len(text) - at > PART:
        stop = next((p + len(mark) for mark in ("\n\n", "\n", ". ", " ") if (p := text.rfind(mark, at + PART // 2, at + PART)) >= 0), at + PART)
        out.append((at, text[at:stop]))
        at = stop
    return [*out, (at, text[at:])]


def raw_spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one kind in a label path."""
    kind = np.where(path == 0, -1, (path.astype(np.int16) - 1) // 2)
    cuts = np.flatnonzero((np.diff(kind) != 0) | ((path[1:] % 2 == 1) & (kind[1:] >= 0))) + 1
    edges = [0, *cuts.tolist(), len(path)]
    return [(a, b, int(kind[a])) for a, b in zip(edges, edges[1:]) if b > a and kind[a] >= 0]


_TITLE = re.compile(r"(?:(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor|Doctor|Sister|Nurse|Sir|Patient)\b\.?\s*)+")
_LABEL = re.compile(
    r"(?:(?:MRN|SSN|NHS|ID|Tel|Phone|Fax|E-?mail|Passport|Ref|hospital|member|insurance|national|medical|record|social|security|number|licen[sc]e|driver'?s|no)\b[.:#]?\s*)+", re.I
)
#: What stands before a number and says which of two like kinds it is.
_SAYS_PHONE = re.compile(r"\b(?:tel|telephone|phone|mobile|cell|fax|call|ring|dial|pager|bleep|text|hotline|switchboard|landline|line)\b[.:]?(?:\s*(?:no\b\.?|number|on|at|is))?[\s:(#-]*\Z", re.I)
_SAYS_ID = re.compile(r"\b(?:mrn|ssn|nhs|passport|insurance|member|policy|record|chart|licen[sc]e|permit|patient id|hospital)\b[.:]?(?:\s*(?:no\b\.?|number|id|card|is))*[\s:(#-]*\Z", re.I)
#: Words in capitals up to a comma, with a number before the next one: a person before an address.
_PERSON_FIRST = re.compile(r"((?:[^\W\d_][\w.'’-]*\s+){1,3}[^\W\d_][\w'’-]+),\s*(?=[^,]{0,60}\d)")
_UNIT = re.compile(r"(?:flat|unit|apt|apartment|suite|room|floor|house|the|old|new|upper|lower|[^,]*\b(?:street|road|lane|avenue|house|cottage|farm|court|lodge|hall|villa|building))\b", re.I)
_AT = re.compile(r"@|\(at\)|\[at\]|\sat\s", re.I)


def checked(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Spans at word limits, without titles and labels, that have what their kind needs."""
    joined: list[list[int]] = []
    for start, end, kind in found:
        if joined and joined[-1][2] == kind and not text[joined[-1][1] : start].strip(" \r\n,-"):
            gap = text[joined[-1][1] : start]
            if kind != 0 or len(gap) <= 2:
                joined[-1][1] = end
                continue
        joined.append([start, end, kind])
    out = []
    for start, end, kind in joined:
        name = KINDS[kind]
        inner = "@._+-'" if name == "email" else "'-" if name == "name" else "-+(/" if name == "phone" else "-"
        while start > 0 and not text[start].isspace() and (text[start - 1].isalnum() or (text[start - 1] in inner and start > 1 and not text[start - 2].isspace())):
            start -= 1
        if name == "phone":
            while start > 0 and text[start - 1] in "+(" and text[start] not in " \n":
                start -= 1
        while start < end and (text[start].isspace() or text[start] in ",;:.)#" or (text[start] in "([" and name != "phone")):
            start += 1
        if name == "name" and (m := _TITLE.match(text, start, end)):
            start = m.end()
        elif name in ("id_number", "phone", "email") and (m := _LABEL.match(text, start, end)) and m.end() < end:
            start = m.end()
        while end > start and (text[end - 1].isspace() or text[end - 1] in ",;:("):
            end -= 1
        before = text[max(0, start - 30) : start]
        if name == "id_number" and _SAYS_PHONE.search(before):
            name = "phone"
        elif name == "phone" and _SAYS_ID.search(before):
            name = "id_number"
        if name == "address" and (m := _PERSON_FIRST.match(text, start, end)) and not _UNIT.match(m[1]):
            at = t.end() if (t := _TITLE.match(text, start, m.end(1))) else start
            out.append((at, m.end(1), "name"))
            start = m.end()
        held = text[start:end]
        digits = sum(c.isdigit() for c in held)
        fits = {
            "name": len(held) >= 3 and any(c.isupper() for c in held) and digits <= 1,
            "phone": digits >= 7,
            "email": bool(_AT.search(held)) and len(held) >= 6,
            "id_number": digits >= 5,
            "address": digits >= 1 and len(held) >= 6,
        }[name]
        if fits:
            out.append((start, end, name))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with `[KIND]` in place of each span."""
    out, last = [], 0
    for start, end, kind in sorted(spans):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
            last = end
    return "".join([*out, text[last:]])


def _batches(batch: pd.DataFrame, size: int = 500) -> Iterator[pd.DataFrame]:
    for at in range(0, len(batch), size):
        yield batch.iloc[at : at + size]


def find(df: DataFrame, row_id: str, text: str, model: str | None = None) -> DataFrame:
    """(row_id, kind, start_at, end_at) of every finding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load(model)
        for batch in batches:
            for part in _batches(batch):
                got = tagger.spans(part["text"].tolist())
                rows = [(i, kind, a, b) for i, spans in zip(part["row_id"], got) for a, b, kind in spans]
                yield pd.DataFrame(rows, columns=["row_id", "kind", "start_at", "end_at"])

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")).where(F.col("row_id").isNotNull() & F.col("text").rlike(r"\S"))
    return rows.mapInPandas(run, "row_id long, kind string, start_at int, end_at int")


def redact(df: DataFrame, row_id: str, text: str, model: str | None = None) -> DataFrame:
    """(row_id, text) of every row, with typed placeholders in place of the findings."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger.load(model)
        for batch in batches:
            clean: list = []
            for at in range(0, len(batch), 500):
                texts = batch.iloc[at : at + 500].tolist()
                clean += [None if t is None else redacted(t, s) for t, s in zip(texts, tagger.spans([t or "" for t in texts]))]
            yield pd.Series(clean, index=batch.index, dtype=object)

    return df.select(F.col(row_id).cast("long").alias("row_id"), run(F.col(text)).alias("text"))
