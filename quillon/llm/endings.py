"""Texts cut off by a field limit or in transfer.

Two kinds of evidence are combined for each value (a raw output, or a note text inside it):

- Length. Per source and kind the lengths follow a log-normal law; a share of the values passes fields that cut at a limit c,
  so a value of length c is either a cut longer one (mass share * S(c)) or a whole one (density f(c)). Candidate limits are
  lengths with more unfinished values than the lengths around give them; law and shares are fitted together by EM on the
  right-censored likelihood. The fit gives each value its censoring posterior at its length, which is the prior of:
- Ending. Brackets, strings or code fences left open and cut marks show a cut, closed structures a whole value, whatever
  the length. Running text that stops with or without the end of a sentence is soft evidence: how much it says is learnt per source
  and kind, by EM over the histogram of lengths and endings, from what values at limits and away from them end with. A
  source that leaves out full stops as a rule is thus judged by its limits alone, and a raw output that ends with a full
  stop just at a limit counts as cut where the limit explains it better. A note that ends with a sentence is never a case.

Values away from limits are cut in transfer with a share learnt with it, held to at most `MOST_CUT` of the running texts:
where more than half of a source's texts end without a stop, this is taken as its way of writing.

A row is a case when the posterior of its raw value, or of a note text inside it, is above one half. Each text is read
once; lengths and endings are kept, and all else works on these.

Defined results: null, empty and blank values, bare JSON literals, and whole values followed by remarks or blank space
are no cases; rows without an id give no row; malformed but closed structures are no cases; equal values get equal answers;
a source with under `FEWEST` values of a kind has no limits of its own; its endings count as in the priors.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

#: Marks that some writers leave where they cut.
_MARK = re.compile(r"(?:\s*(?:\.\.\.|…|�|\[(?:cut|truncated|\.\.\.|…|snip)\]|<(?:cut|truncated)>|\((?:cut|truncated)\)))+\s*\Z", re.I)
_END = re.compile(r"(?:\(end\)|-+\s*end of [a-z ]+-+|\*+\s*end of [a-z ]+\*+|\[end\])\s*\Z", re.I)
_STOP = re.compile(r"""[.!?]["'”’)\]]*\Z""")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}\[\]]', re.S)
_NOTE = re.compile(r'\\*"?free_text\\*+"?+\s*+:?+\s*+(?:\\"((?:(?!\\").|\\\\\\")*?)\\"|"((?:[^"\\]|\\.)*)")', re.S)
#: Endings, and the log-likelihood ratios of those that structure alone decides.
OPEN, MARKED, MIDDLE, DONE, CLOSED = range(5)
SHOWN = {OPEN: 12.0, MARKED: 9.0, CLOSED: -20.0}
#: Share of running texts without a final stop among cut and whole ones, before any are seen, and the number of texts that this counts for.
MIDDLE_IF_CUT, MIDDLE_IF_WHOLE, WEIGHT = 0.98, 0.002, 20.0
#: Largest share of a source's running texts that can be cut away from limits; values that a source needs to have limits.
MOST_CUT, FEWEST = 0.25, 50
#: A limit shorter than this is none: no field is that short.
SHORTEST = 16


#: Characters at the end in which marks and full stops are looked for.
_TAIL = 160


def unmarked(text: str) -> str:
    """The text without a cut mark at its end."""
    return text[:-_TAIL] + _MARK.sub("", text[-_TAIL:])


def open_at_end(text: str) -> tuple[bool, int]:
    """Whether a bracket or string is left open, and where the last closed structure ends (0: there is none)."""
    first = min((p for p in (text.find("{"), text.find("[")) if p >= 0), default=-1)
    if first < 0:
        return False, 0
    depth = end = 0
    unclosed = False
    for m in _TOKEN.finditer(text, first):
        token = m.group()
        if token in "{[":
            depth += 1
        elif token in "}]":
            depth = max(0, depth - 1)
            if depth == 0:
                end = m.end()
        elif depth:
            unclosed = m.end() == len(text) and (len(token) == 1 or not token.endswith('"') or token.endswith('\\"'))
    return depth > 0 or unclosed, end


def _tail(text: str) -> int:
    """Whether running text ends with a sentence."""
    last = text[-_TAIL:]
    return DONE if _END.search(last) or _STOP.search(last) else MIDDLE


def raw_ending(value: str) -> int:
    """How a raw output ends."""
    text = value.strip()
    if not text:
        return CLOSED
    try:
        json.loads(text)
        return CLOSED
    except (ValueError, RecursionError):
        pass
    bare = unmarked(text)
    marked = bare != text
    unclosed, end = open_at_end(bare)
    if unclosed:
        return OPEN
    if marked:
        return MARKED
    rest = bare[end:].strip() if end else bare
    if bare.count("```") % 2:
        return OPEN
    rest = rest.strip("`").strip(" \t\r\n,;")
    if not rest:
        return CLOSED
    ending = _tail(rest)
    # A finished remark after a closed structure, or blank space after a full stop, is no place for a limit to fall.
    return CLOSED if ending == DONE and (end or value[-1].isspace()) else ending


def notes_in(value: str) -> list[str]:
    """All closed note texts inside a raw output, decoded."""
    found = []
    for m in _NOTE.finditer(value):
        body = m.group(2) if m.group(2) is not None else m.group(1).replace("\\\\", "\\")
        try:
            found.append(json.loads(f'"{body}"', strict=False))
        except ValueError:
            found.append(body)
    return found


def note_ending(note: str) -> int:
    text = note.strip()
    if not text:
        return CLOSED
    return MARKED if unmarked(text) != text else _tail(text)


def fit_limits(lengths: np.ndarray, counts: np.ndarray, unfinished: np.ndarray, least: int = 12, rounds: int = 40) -> dict[int, float]:
    """Candidate limits of one source with the log odds that an unfinished value of just that length was cut there.
    `counts` are all values of a length, `unfinished` those whose structure is not closed."""
    keep = lengths > 0
    lengths, counts, unfinished = lengths[keep], counts[keep].astype(float), unfinished[keep].astype(float)
    if counts.sum() < FEWEST:
        return {}
    x, total = np.log(lengths), counts.sum()
    # Local level: the mean count of the lengths nearby, taken with the empty ones.
    sums = np.concatenate([[0.0], np.cumsum(np.bincount(lengths.astype(int), weights=unfinished, minlength=int(lengths.max()) + 102))])
    at = lengths.astype(int)
    near = (sums[at + 51] - sums[np.maximum(1, at - 50)] - unfinished) / 100
    limit = (unfinished >= least) & (unfinished > 8 * (near + 0.5)) & (lengths >= SHORTEST)
    if not limit.any():
        return {}
    mu, sigma = float(np.average(x, weights=counts)), float(np.sqrt(np.cov(x, aweights=counts)) + 1e-3)
    share = np.where(limit, 0.05, 0.0)
    above = np.array([counts[x >= v].sum() for v in x[limit]])
    for _ in range(rounds):
        z = (x - mu) / sigma
        density = np.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi) * lengths)
        beyond = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        cut = np.where(limit, share * beyond / np.maximum(share * beyond + (1 - share) * density, 1e-300), 0.0) * unfinished / counts
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(beyond, 1e-12)
        mean = mu + sigma * hazard
        square = mean * mean + sigma * sigma * (1 + z * hazard - hazard * hazard)
        ex, ex2 = cut * mean + (1 - cut) * x, cut * square + (1 - cut) * x * x
        mu = float((counts * ex).sum() / total)
        sigma = float(np.sqrt(max((counts * ex2).sum() / total - mu * mu, 1e-6)))
        share[limit] = np.clip((counts * cut)[limit] / np.maximum(above, 1.0), 1e-6, 1 - 1e-6)
    odds = share * beyond / np.maximum((1 - share) * np.maximum(density, near / total), 1e-300)
    return {int(c): float(np.log(max(o, 1e-12))) for c, o in zip(lengths[limit], odds[limit])}


def fit_endings(lengths: np.ndarray, middle: np.ndarray, done: np.ndarray, limits: dict[int, float], rounds: int = 200) -> tuple[float, float, float]:
    """(log odds of a cut away from limits, log-likelihood ratio of MIDDLE, that of DONE) of one source and kind, by EM over
    its running texts: `middle` and `done` are how many of each length end without and with a stop."""
    prior = np.array([limits.get(int(c), np.nan) for c in lengths])
    free = np.isnan(prior)
    n, away = (middle + done).sum(), (middle + done)[free].sum()
    share, if_cut, if_whole = 0.01, MIDDLE_IF_CUT, MIDDLE_IF_WHOLE
    for _ in range(rounds):
        odds = np.where(free, math.log(share / (1 - share)), prior)
        says = math.log(if_cut / if_whole), math.log((1 - if_cut) / (1 - if_whole))
        cut_middle, cut_done = (1 / (1 + np.exp(-np.clip(odds + s, -30, 30))) for s in says)
        m, d = (middle * cut_middle).sum(), (done * cut_done).sum()
        share = min(MOST_CUT, ((middle * cut_middle + done * cut_done)[free].sum() + 0.01 * WEIGHT) / (away + WEIGHT))
        if_cut = (m + MIDDLE_IF_CUT * WEIGHT) / (m + d + WEIGHT)
        if_whole = (middle.sum() - m + MIDDLE_IF_WHOLE * WEIGHT) / (n - m - d + WEIGHT)
    return math.log(share / (1 - share)), math.log(if_cut / if_whole), math.log((1 - if_cut) / (1 - if_whole))


def fit_source(part: pd.DataFrame, with_limits: bool = True) -> pd.DataFrame:
    """What a histogram (source, kind, length, ending, n) of one source says: rows (source, kind, length, odds) for limits;
    length -1, -2 and -3 hold what `fit_endings` gives."""
    rows = []
    for kind, own in part.groupby("kind"):
        wide = own.pivot_table(index="length", columns="ending", values="n", aggfunc="sum", fill_value=0).reindex(columns=range(5), fill_value=0)
        lengths, n = wide.index.to_numpy(), wide.to_numpy()
        limits = fit_limits(lengths, n.sum(axis=1), n[:, [OPEN, MARKED, MIDDLE, DONE]].sum(axis=1)) if with_limits else {}
        fitted = fit_endings(lengths, n[:, MIDDLE].astype(float), n[:, DONE].astype(float), limits)
        rows += [(own["source"].iloc[0], kind, c, o) for c, o in [*limits.items(), *zip((-1, -2, -3), fitted)]]
    return pd.DataFrame(rows, columns=["source", "kind", "length", "odds"])


def judge(df: DataFrame, row_id: str, source: str, value: str, max_sent: int = 100_000, salts: int = 32, with_limits: bool = True) -> DataFrame:
    """Per value of the input: row_id, source, cut (boolean) and posterior. The values are read once; only histograms and
    what is fitted to them are shuffled."""
    rows = df.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(value).alias("value"))
    rows = rows.where(F.col("value").isNotNull() & F.col("row_id").isNotNull())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[(0, len(text), raw_ending(text)), *((1, len(n), note_ending(n)) for n in notes_in(text))] for text in batch["value"]]
            columns = {c: [[p[k] for p in row] for row in parts] for k, c in enumerate(("kinds", "lengths", "endings"))}
            yield pd.DataFrame({"row_id": batch["row_id"], "source": batch["source"], **columns})

    seen = cut(rows.mapInPandas(read, "row_id long, source string, kinds array<int>, lengths array<int>, endings array<int>"))
    parts = seen.select("source", F.explode(F.arrays_zip("kinds", "lengths", "endings")).alias("p"))
    parts = parts.select("source", F.col("p.kinds").alias("kind"), F.col("p.lengths").alias("length"), F.col("p.endings").alias("ending"))
    histogram = parts.groupBy("source", "kind", "length", "ending").agg(F.count("*").alias("n"))
    found = cut(histogram.groupBy("source").applyInPandas(lambda part: fit_source(part, with_limits), "source string, kind int, length int, odds double"))
    few = found.count() <= max_sent
    per_source = found.groupBy("source").agg(F.collect_list(F.struct("kind", "length", "odds")).alias("known"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fitted: dict[str, dict] = {}
            best = []
            for src, known, *row in zip(batch["source"], batch["known"], batch["kinds"], batch["lengths"], batch["endings"]):
                if src not in fitted:
                    fitted[src] = {(k["kind"], k["length"]): k["odds"] for k in known}
                of = fitted[src]
                says = []
                for kind, length, ending in zip(*row):
                    # A note is a case only if it stops amid a word or sentence.
                    ratio = SHOWN.get(CLOSED if kind and ending == DONE else ending)
                    says.append(of.get((kind, length), of[kind, -1]) + (of[kind, -2 if ending == MIDDLE else -3] if ratio is None else ratio))
                best.append(max(says))
            best = np.array(best)
            yield pd.DataFrame({"row_id": batch["row_id"], "source": batch["source"], "cut": best > 0, "posterior": 1 / (1 + np.exp(-np.clip(best, -30, 30)))})

    if few:
        joined = seen.join(F.broadcast(per_source), "source")
    else:  # many sources: by shuffle, each source's rows spread over `salts` tasks
        spread = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = seen.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).join(spread, ["source", "salt"]).drop("salt")
    return joined.mapInPandas(decide, "row_id long, source string, cut boolean, posterior double")
