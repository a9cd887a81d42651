"""Concept annotation of text against a lexicon (concept_id, label, term), offline in place of a remote annotator.

Whole words, longest match only, numeric terms excluded. A lexicon of up to `limit` bytes is sent to the
workers as one automaton and texts are not shuffled; a longer one meets them in parts. Three policies on the hits: all, first location, longest per concept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut, fits

HITS = "row_id long, concept_id string, label string, matched_text string, start_at int, end_at int"


class _Machine:
    """Whole-word matches of many terms in one pass over a text."""

    def __init__(self, terms):
        import ahocorasick

        self.any = bool(terms)
        self.machine = ahocorasick.Automaton()
        for term in terms:
            self.machine.add_word(term, term)
        if self.any:
            self.machine.make_automaton()

    def matches(self, body: str | None) -> list[tuple[int, int, str]]:
        """(start, end, term) of every match, overlapping ones too."""
        if not self.any or not body:
            return []
        low = body.lower()
        if len(low) != len(body):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in body)
        found = []
        for last, term in self.machine.iter(low):
            first = last - len(term) + 1
            if (first == 0 or not low[first - 1].isalnum()) and (last + 1 == len(low) or not low[last + 1].isalnum()):
                found.append((first, last + 1, term))
        return found


def _longest(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches (start, end, ...) the first, of those that begin alike the longest."""
    kept, end = [], -1
    for match in sorted(found, key=lambda x: (x[0], -x[1])):
        if match[1] > end:
            end = match[1]
            kept.append(match)
    return kept


def annotate(df: DataFrame, row_id: str, text: str, lexicon: DataFrame, limit: int = 64 << 20, block: int = 5000) -> DataFrame:
    """One row per hit. Null and blank texts have none, rows without an id are left out; equal terms of several concepts give a hit each.

    A lexicon of more than `limit` bytes is not sent: its parts meet blocks of about `block` texts by shuffle, and the longest
    matches are chosen per text from what all parts found. Row ids must then be unique."""
    entries = lexicon.select("concept_id", "label", F.lower(F.trim("term")).alias("term")).where(F.col("term").rlike(r"\D") & F.col("term").rlike(r"\S"))
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")).where("row_id is not null")
    if not fits(entries, limit):
        return _by_parts(rows, entries, limit, block)
    terms: dict[str, list] = {}
    for r in entries.collect():
        terms.setdefault(r["term"], []).append((r["concept_id"], r["label"]))
    sent = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _Machine(sent.value)
        for batch in batches:
            out = []
            for key, body in zip(batch["row_id"], batch["text"]):
                for first, stop, term in _longest(machine.matches(body)):
                    out += [(key, c, label, body[first:stop], first, stop) for c, label in sent.value[term]]
            yield pd.DataFrame(out, columns=["row_id", "concept_id", "label", "matched_text", "start_at", "end_at"])

    return rows.mapInPandas(run, HITS)


def _by_parts(rows: DataFrame, entries: DataFrame, limit: int, block: int) -> DataFrame:
    entries = cut(entries)
    size, count = entries.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0, rows.count()
    parts, blocks = max(1, int(-(-size // max(1, limit)))), max(1, -(-count // block))
    words = entries.select("term").distinct().select("term", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    texts = rows.select("row_id", "text", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def find(own: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        machine = _Machine(terms["term"].tolist())
        out = [(key, term, body[first:stop], first, stop) for key, body in zip(own["row_id"], own["text"]) for first, stop, term in machine.matches(body)]
        return pd.DataFrame(out, columns=["row_id", "term", "matched_text", "start_at", "end_at"])

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates()
        kept = _longest(list(zip(own["start_at"], own["end_at"], range(len(own)))))
        return own.iloc[[k for _, _, k in kept]]

    schema = "row_id long, term string, matched_text string, start_at int, end_at int"
    found = texts.groupBy("part", "block").cogroup(words.groupBy("part", "block")).applyInPandas(find, schema)
    chosen = found.groupBy("row_id").applyInPandas(choose, schema)
    return chosen.join(entries, "term").select("row_id", "concept_id", "label", "matched_text", "start_at", "end_at")


def first_location(hits: DataFrame) -> DataFrame:
    """The first hit of each concept in each text."""
    return hits.groupBy("row_id", "concept_id").agg(F.min_by(F.struct("label", "matched_text"), F.struct("start_at", "end_at")).alias("x")).select("row_id", "concept_id", "x.*")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One row per concept and matched text, the first."""
    return hits.groupBy("row_id", "concept_id", "matched_text").agg(F.min("start_at").alias("start_at"))


def longest_per_concept(hits: DataFrame) -> DataFrame:
    """The longest matched text of each concept in each text, the first on ties."""
    best = F.struct((-F.length("matched_text")).alias("a"), F.col("start_at").alias("b"))
    return hits.groupBy("row_id", "concept_id").agg(F.min_by("matched_text", best).alias("matched_text"))
