"""Repair of text from scanned pages.

Lines are labelled by a hidden Markov model over layout features (states: body, heading, furniture, blank): whether the line
is or ends in a page number, its length against the page's width, its capitals, its last character, whether it interrupts a
sentence, and how often the same line (numbers aside) occurs in the text and in all texts. The model starts from a prior and
is refined by EM over all texts, whose expected counts are summed on the workers; corpus counts of lines and words cover all
texts.

Words are repaired against the words of all texts. A word broken at a line end (furniture between its halves is skipped) is
joined with or without the hyphen, whichever the texts use more; a word that is itself rare and turns into a far more
frequent one by undoing one to three confusions of similar-looking characters is a misread.

Defined results: null, empty and blank texts give no findings and stay as they are; rows without an id give no findings; texts without line breaks can only have
misread words; offsets count characters of the text as given, CR included; equal texts get equal findings; extra columns are
ignored; texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import cut

CELLS = 1 << 20
BODY, HEADING, FURNITURE, BLANK = range(4)
HYPHENS = "-‐‑¬­"

# What a character or pair is misread as, by what was printed.
CONFUSIONS = {
    "e": ("c",), "i": ("!", "1", "l", "|"), "a": ("o",), "o": ("0",), "t": ("f",), "l": ("1", "|", "I"), "n": ("ri",), "s": ("5",), "d": ("cl",),
    "u": ("ii",), "m": ("rn", "nn"), "h": ("li", "b"), "b": ("6",), "g": ("9", "q"), "w": ("vv",), "fi": ("ﬁ",), "fl": ("ﬂ",), "cl": ("d",),
    "rn": ("m",), "z": ("2",), "c": ("e",), "li": ("h",),
}
_UNDO = sorted(((wrong, right) for right, all_ in CONFUSIONS.items() for wrong in all_), key=lambda x: -len(x[0]))

_NUMBER = r"(?:pages?\.?|pg\.?|p\.)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*(?:of|/)\s*\d{1,4}|\d{1,4}"
_PAGE = re.compile(rf"\s*[-\[(–—]*\s*(?:{_NUMBER})\s*[-\])–—]*\s*\Z", re.I)
_PAGE_TAIL = re.compile(rf"(?:\s{{2,}}|\t)[-\[(–—]*\s*(?:{_NUMBER})\s*[-\])–—]*\s*\Z", re.I)
_TOKEN = re.compile(r"\S+")
_OPENING, _CLOSING = "([{\"'“‘«", ".,;:?)]}\"'”’»"


def without_page(line: str) -> str:
    """A line without a page number at its end."""
    return line[:-80] + _PAGE_TAIL.sub("", line[-80:])


def line_key(line: str) -> str:
    """A line without its page number, digits alike, one space, lower case."""
    return " ".join(re.sub(r"\d", "9", without_page(line)).split()).lower()


def _cell(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % CELLS


def lines_of(text: str) -> list[tuple[int, str]]:
    """(offset, line without its line end)."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line.rstrip("\r")))
        at += len(line) + 1
    return out


#: Features with the number of their values.
SIZES = (3, 3, 3, 3, 2, 3, 2)
# Prior chances of the feature values by state (body, heading, furniture).
PRIOR = (
    ((0.9989, 0.0001, 0.001), (0.9989, 0.0001, 0.001), (0.30, 0.40, 0.30)),  # no page number, whole line, after a gap
    ((0.08, 0.17, 0.75), (0.70, 0.28, 0.02), (0.48, 0.47, 0.05)),  # short, middle, full width
    ((0.97, 0.028, 0.002), (0.10, 0.30, 0.60), (0.35, 0.30, 0.35)),  # running text, title case, capitals
    ((0.60, 0.39, 0.01), (0.015, 0.002, 0.983), (0.99, 0.005, 0.005)),  # no mark, full stop, colon at the end
    ((0.94, 0.06), (0.97, 0.03), (0.35, 0.65)),  # interrupts a sentence
    ((0.94, 0.05, 0.01), (0.02, 0.08, 0.90), (0.10, 0.20, 0.70)),  # rare, known, common line in all texts
    ((0.97, 0.03), (0.75, 0.25), (0.55, 0.45)),  # repeated in this text
)
TRANSITION = ((0.80, 0.06, 0.06, 0.08), (0.70, 0.02, 0.05, 0.23), (0.80, 0.05, 0.10, 0.05), (0.50, 0.38, 0.10, 0.02))
START = (0.60, 0.30, 0.05, 0.05)


@dataclass
class Model:
    emit: list[np.ndarray]
    step: np.ndarray
    start: np.ndarray

    @classmethod
    def prior(cls) -> Model:
        return cls([np.log(np.array(p)) for p in PRIOR], np.log(np.array(TRANSITION)), np.log(np.array(START)))

    def scores(self, lines: np.ndarray) -> np.ndarray:
        """Log chance of each line of (texts, lines, features) under each state; blank lines have feature -1."""
        out = np.full((*lines.shape[:2], 4), -50.0)
        out[..., :3] = sum(table.T[lines[..., k]] for k, table in enumerate(self.emit))
        blank = lines[..., 0] < 0
        out[blank] = -50.0
        out[blank, BLANK] = 0.0
        return out

    def label(self, pages: list[list[tuple | None]]) -> list[list[int]]:
        """The most probable states of the lines of every text."""
        found: list[list[int]] = [[]] * len(pages)
        for group in _alike(pages):
            lines, sizes = packed([pages[n] for n in group])
            own = self.scores(lines)
            best = np.empty_like(own)
            back = np.zeros(own.shape, dtype=np.int8)
            best[:, 0] = self.start + own[:, 0]
            for k in range(1, own.shape[1]):
                through = best[:, k - 1, :, None] + self.step
                back[:, k] = through.argmax(axis=1)
                best[:, k] = through.max(axis=1) + own[:, k]
            path = np.zeros(own.shape[:2], dtype=np.int8)
            state = np.zeros(len(group), dtype=np.int64)
            every = np.arange(len(group))
            for k in range(own.shape[1] - 1, -1, -1):
                state = np.where(sizes - 1 == k, best[:, k].argmax(axis=1), state)
                path[:, k] = state
                state = np.where(k < sizes, back[every, k, state], state)
            for row, n in enumerate(group):
                found[n] = path[row, : sizes[row]].tolist()
        return found

    def expected(self, lines: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Expected counts of feature values by state, of steps and of first states, by forward and backward sums."""
        own = self.scores(lines)
        n = own.shape[1]
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[:, 0] = self.start + own[:, 0]
        for k in range(1, n):
            ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + self.step, axis=1) + own[:, k]
        for k in range(n - 2, -1, -1):
            on = np.logaddexp.reduce(self.step + (own[:, k + 1] + behind[:, k + 1])[:, None], axis=2)
            behind[:, k] = np.where((k + 1 < sizes)[:, None], on, 0.0)
        total = np.logaddexp.reduce(ahead[np.arange(len(sizes)), sizes - 1], axis=1)
        inside = np.arange(n) < sizes[:, None]
        state = np.where(inside[..., None], np.exp(ahead + behind - total[:, None, None]), 0.0)
        both = np.exp(np.minimum(ahead[:, :-1, :, None] + self.step + (own[:, 1:] + behind[:, 1:])[:, :, None] - total[:, None, None, None], 0.0))
        both = (both * inside[:, 1:, None, None]).sum(axis=(0, 1))
        written = inside & (lines[..., 0] >= 0)
        held, values = state[written][:, :3], lines[written]
        counts = [np.stack([np.bincount(values[:, k], weights=held[:, s], minlength=size) for s in range(3)]) for k, size in enumerate(SIZES)]
        return [*counts, both, state[:, 0].sum(axis=0)]


def _alike(pages: list[list[tuple | None]], at_once: int = 256) -> Iterator[list[int]]:
    """Numbers of texts with lines, those of like length together."""
    order = sorted((n for n, rows in enumerate(pages) if rows), key=lambda n: len(pages[n]))
    group: list[int] = []
    for n in order:
        if group and (len(group) == at_once or len(pages[n]) > 2 * len(pages[group[0]]) + 8 or (len(group) + 1) * len(pages[n]) > 1 << 16):
            yield group
            group = []
        group.append(n)
    if group:
        yield group


def packed(pages: list[list[tuple | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts as one array (texts, lines, features), filled up with blank lines, and the number of lines of each."""
    sizes = np.array([len(rows) for rows in pages])
    out = np.full((len(pages), sizes.max(), len(SIZES)), -1, dtype=np.int8)
    for own, rows in zip(out, pages):
        own[: len(rows)] = [row or (-1,) * len(SIZES) for row in rows]
    return out, sizes


#: Shapes of the expected counts, in order.
_SHAPES = [*((3, size) for size in SIZES), (4, 4), (4,)]


def _flat(counts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([c.ravel() for c in counts])


def updated(flat: np.ndarray, share: float, least: float) -> Model:
    """The model of summed expected counts, with the prior as pseudo-counts: `share` of the lines counted, so that data of
    any size weigh alike against it, and at least `least`."""
    cuts = np.cumsum([int(np.prod(s)) for s in _SHAPES])[:-1]
    counts = [c.reshape(s) for c, s in zip(np.split(flat, cuts), _SHAPES)]
    strength = max(least, share * counts[-2].sum())
    counts = [c + np.array(p) * strength for c, p in zip(counts, [*PRIOR, TRANSITION, START])]
    log = [np.log(c / c.sum(axis=-1, keepdims=True)) for c in counts]
    return Model(log[:-2], log[-2], log[-1])


def refine(rows: DataFrame, often_of, rounds: int = 3, share: float = 1 / 6, least: float = 20_000.0) -> Model:
    """EM over all texts of `rows`: features are written once, each round sums the expected counts on the workers."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = often_of()
        for batch in batches:
            pages = [features([x for _, x in lines_of(t)], look) for t in batch["text"]]
            pages = [p for p in pages if len(p) > 1]
            groups = list(_alike(pages))
            boxes = [packed([pages[n] for n in group]) for group in groups]
            if boxes:
                yield pd.DataFrame({"lines": [x.tobytes() for x, _ in boxes], "sizes": [s.tolist() for _, s in boxes]})

    held = cut(rows.select("text").mapInPandas(pack, "lines binary, sizes array<long>"))
    model = Model.prior()
    for _ in range(rounds):
        sent = model

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros(sum(int(np.prod(s)) for s in _SHAPES))
            for batch in batches:
                for lines, sizes in zip(batch["lines"], batch["sizes"]):
                    sizes = np.asarray(sizes)
                    box = np.frombuffer(lines, dtype=np.int8).reshape(len(sizes), -1, len(SIZES))
                    total += _flat(sent.expected(box, sizes))
            yield pd.DataFrame({"place": np.arange(len(total)), "n": total})

        sums = held.mapInPandas(count, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").toPandas()
        if not len(sums):
            break
        model = updated(sums["n"].to_numpy(), share, least)
    return model


def features(lines: list[str], often) -> list[tuple | None]:
    """Layout features of each line; `often(key)` gives 0, 1 or 2 for how common a line is in all texts."""
    full = sorted((len(x.strip()) for x in lines if x.strip()), reverse=True)
    width = max(20, full[len(full) // 4] if full else 20)
    keys = [line_key(x) for x in lines]
    own = Counter(k for k in keys if k)
    filled = [k for k, x in enumerate(lines) if x.strip()]
    before, after = dict(zip(filled[1:], filled[:-1])), dict(zip(filled[:-1], filled[1:]))
    out: list[tuple | None] = []
    for k, line in enumerate(lines):
        text = line.strip()
        if not text:
            out.append(None)
            continue
        bare = without_page(text)
        page = 1 if _PAGE.match(text) else 2 if bare != text else 0
        size = 0 if len(text) < 0.4 * width else 1 if len(text) < 0.8 * width else 2
        words = re.findall(r"[^\W\d_]+", bare)
        capital = 2 if words and all(w.isupper() for w in words) else 1 if words and sum(w[0].isupper() for w in words) >= 0.6 * len(words) else 0
        end = 2 if text.endswith(":") else 1 if text[-1] in ".!?" else 0
        last = lines[before[k]].strip() if k in before else "."
        then = lines[after[k]].strip() if k in after else ""
        breaks = int(last[-1] not in ".:!?" and bool(then) and (then[0].islower() or last[-1] in HYPHENS) and end != 1 and not text[0].islower())
        out.append((page, size, capital, end, breaks, 1 if page == 1 else often(keys[k]), int(own[keys[k]] > 1)))
    return out


def core(token: str) -> tuple[int, str]:
    """A token without adjoining punctuation, and where it starts in it."""
    start = 0
    while start < len(token) and token[start] in _OPENING:
        start += 1
    stop = len(token)
    while stop > start and token[stop - 1] in _CLOSING + "!":
        stop -= 1
    return start, token[start:stop]


def wordlike(low: str) -> bool:
    """Whether a token can be a misread word at all: mostly letters, no address or path."""
    letters = sum(c.isalpha() for c in low)
    return letters >= 1 and len(low) >= 2 and letters >= 0.5 * len(low) and not any(c in low for c in "@/_")


class Speller:
    """Repairs words against word counts."""

    def __init__(self, counts: dict[str, int], better: dict[str, str] | None = None, ratio: float = 20.0):
        self.counts, self.better, self.ratio = counts, better, ratio
        self.known: dict[str, str | None] = {}
        self.tokens: dict[str, tuple[int, str | None]] = {}

    def _variants(self, word: str, depth: int) -> Iterator[str]:
        """The word with one to `depth` confusions undone."""
        level = {word}
        for _ in range(depth):
            new = set()
            for w in level:
                for wrong, right in _UNDO:
                    at = w.find(wrong)
                    while at >= 0:
                        new.add(w[:at] + right + w[at + len(wrong) :])
                        at = w.find(wrong, at + 1)
            level = new
            yield from sorted(new)

    def _better(self, word: str) -> str | None:
        own = self.counts.get(word, 0)
        top, best = max(self.ratio * own, 3.0), None
        odd = sum(not c.isalpha() or c in "ﬁﬂ" for c in word)
        for depth in (1, 2, 3) if odd > 1 or len(word) > 7 else (1, 2):
            for other in self._variants(word, depth) if len(word) < 24 else ():
                if self.counts.get(other, 0) > top and len(other) >= 2 and other.isalpha():
                    top, best = self.counts[other], other
            if best:
                return best
        return None

    def repaired(self, word: str) -> str | None:
        """The word as it should read if it is a misread one."""
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self._repair(word, False)
        return self.known[word]

    def of(self, token: str) -> tuple[int, str | None]:
        """Where the word of a token starts in it, and what it should read if it is misread."""
        if token not in self.tokens:
            if len(self.tokens) > 200_000:
                self.tokens.clear()
            lead, word = core(token)
            fixed = self._repair(word, True) if word else None
            if fixed is None and token[lead:] != word:  # a mark at the end may be a misread letter
                longer = token[lead:].rstrip(".,;:?)]}\"'”’»")
                fixed = self.repaired(longer) if longer != word and longer[-1:] in "!|" else None
            self.tokens[token] = lead, fixed
        return self.tokens[token]

    def _repair(self, word: str, counted: bool) -> str | None:
        """`counted`: the word is one of the texts, for which `better` says everything."""
        low = word.lower()
        if not wordlike(low):
            return None
        if any(x in HYPHENS for x in low):
            parts = re.split(f"([{re.escape(HYPHENS)}])", word)
            fixed = [self.repaired(p) or p for p in parts]
            return "".join(fixed) if fixed != parts else None
        # Codes: capitals with digits, letters before digits.
        if re.fullmatch(r"[A-Z]+\d+[A-Z]?|[a-z]{1,2}\d+|\d+[a-z]{1,2}", word) and low not in self.counts and not re.fullmatch(r"[a-z]\d", word):
            return None
        if word.isupper() and len(word) <= 4:
            return None
        best = self.better.get(low) if counted and self.better is not None else self._better(low)
        if best is None:
            return None
        if word.isupper() and sum(c.isalpha() for c in low) > 1:
            return best.upper()
        return best.capitalize() if word[0].isupper() else best

    def joined(self, first: str, second: str) -> str | None:
        """A broken word as it should read; None if the parts are no word."""
        if not first or not second or not any(c.isalpha() for c in first + second):
            return None
        plain, hyphened = first + second, f"{first}-{second}"
        counts = self.counts
        n_plain, n_hyphen = counts.get(plain.lower(), 0), counts.get(hyphened.lower(), 0)
        if max(n_plain, n_hyphen) > 2:
            return plain if n_plain >= n_hyphen else hyphened
        if not (first[-1].isalpha() and second[0].isalpha()) or "@" in plain or "." in plain.strip("."):
            return None
        for whole in (plain, hyphened):
            if fixed := self.repaired(whole):
                return fixed
        # A compound broken inside one of its parts, or at its own hyphen.
        tail = plain.rsplit("-", 1)[-1].lower()
        if "-" in plain and counts.get(tail, 0) > 2:
            return plain
        if counts.get(first.lower(), 0) > 2 and counts.get(second.lower(), 0) > 2:
            return hyphened
        return plain


def findings(text: str, labels: list[int], speller: Speller) -> list[tuple[str, int, str]]:
    """(kind, start, fixed) of everything to repair in a text whose lines are labelled."""
    lines = lines_of(text)
    out: list[tuple[str, int, str]] = [("furniture", at + len(x) - len(x.lstrip()), "") for (at, x), s in zip(lines, labels) if s == FURNITURE]
    kept = [(at, x) for (at, x), s in zip(lines, labels) if s not in (FURNITURE, BLANK)]
    skip: set[int] = set()
    for k, (at, line) in enumerate(kept):
        tokens = [(at + m.start(), m.group()) for m in _TOKEN.finditer(line)]
        for n, (start, token) in enumerate(tokens):
            if start in skip:
                continue
            lead, fixed = speller.of(token)
            if n == len(tokens) - 1 and token[-1] in HYPHENS and len(token) > 1 and k + 1 < len(kept):
                follow = _TOKEN.search(kept[k + 1][1])
                if follow:
                    shift, second = core(follow.group())
                    first = token[lead:-1]
                    whole = speller.joined(first, second) if shift == 0 else None
                    if whole:
                        out.append(("hyphenation", start + lead, whole))
                        skip.add(kept[k + 1][0] + follow.start())
                        continue
            if fixed:
                out.append(("misread", start + lead, fixed))
    return out


def repair(text: str, labels: list[int], speller: Speller) -> str:
    """The text without furniture, words whole, a paragraph per line."""
    fixes = {start: (kind, fixed) for kind, start, fixed in findings(text, labels, speller)}
    paragraphs: list[str] = []
    words: list[str] = []
    swallow = False
    for (at, line), state in zip(lines_of(text), labels):
        if state == FURNITURE:
            continue
        if state in (BLANK, HEADING) and words:
            paragraphs.append(" ".join(words))
            words = []
        for m in _TOKEN.finditer(line):
            token = m.group()
            lead, word = core(token)
            if swallow:
                words[-1] += token[len(word) :]
                swallow = False
                continue
            kind, fixed = fixes.get(at + m.start() + lead, (None, None))
            words.append(token[:lead] + fixed + (token[lead + len(word) :] if kind == "misread" else "") if kind else token)
            swallow = kind == "hyphenation"
        if state == HEADING:
            paragraphs.append(" ".join(words))
            words = []
    return "\n".join([*paragraphs, " ".join(words)] if words else paragraphs)


class Corpus:
    """Counts over all texts and the fitted line model, ready to be sent to the workers."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens: Counter = Counter()
            cells: Counter = Counter()
            n = 0

            def words() -> pd.DataFrame:
                held: Counter = Counter()
                for token, many in tokens.items():
                    if (w := core(token)[1]) and w[-1] not in HYPHENS:
                        held[w] += many
                tokens.clear()
                return pd.DataFrame({"word": list(held), "n": list(held.values())})

            for batch in batches:
                for text in batch["text"]:
                    n += 1
                    cells.update({_cell(key) for _, line in lines_of(text) if (key := line_key(line))})
                    tokens.update(text.lower().split())
                if len(tokens) > 500_000:
                    yield words()
            yield words()
            # A line cell is written as a word that no text holds: a space and its number.
            yield pd.DataFrame({"word": [f" {c}" for c in cells] + [" n"], "n": [*cells.values(), n]})

        counted = cut(rows.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
        # Nothing asks for a word of two occurrences or less; all others are sent, however many there are.
        got = counted.where((F.col("n") > 2) | F.col("word").startswith(" ")).toPandas()
        line = got["word"].str.startswith(" ")
        self.counts = dict(zip(got["word"][~line], got["n"][~line].tolist()))
        texts = max(1, int(got["n"][got["word"] == " n"].sum()))
        held = got[line & (got["word"] != " n")]
        self.cells = np.zeros(CELLS, dtype=np.int8)
        self.cells[held["word"].astype(np.int64).to_numpy()] = [commonness(n, texts) for n in held["n"]]
        self.better = self._better(counted, spark.sparkContext.broadcast(self.counts))
        cells = spark.sparkContext.broadcast(self.cells)
        self.model = refine(rows, lambda: lambda key: often(cells.value, key))
        self.sent = spark.sparkContext.broadcast((self.counts, self.better, self.cells, self.model))

    @staticmethod
    def _better(counted: DataFrame, counts) -> dict[str, str]:
        """What misread words should read: every word of the texts is looked at once, on the workers."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            speller = Speller(counts.value)
            for batch in batches:
                rows = [(w, b) for w in batch["word"] if wordlike(w) and not any(c in HYPHENS for c in w) and (b := speller._better(w))]
                yield pd.DataFrame(rows, columns=["word", "better"], dtype=object)

        words = counted.select("word").where(~F.col("word").startswith(" "))
        tasks = 2 * counted.sparkSession.sparkContext.defaultParallelism
        got = words.repartition(tasks, "word").mapInPandas(run, "word string, better string").toPandas()
        return dict(zip(got["word"], got["better"]))

    def often(self, key: str) -> int:
        return often(self.cells, key)


def commonness(n: int, texts: int) -> int:
    """0, 1 or 2 for a line that n texts hold."""
    return 2 if n >= max(5, 2e-3 * texts) else 1 if n >= max(3, 5e-4 * texts) else 0


def often(cells: np.ndarray, key: str) -> int:
    return int(cells[_cell(key)])


def _labelled(texts: list[str], cells: np.ndarray, model: Model) -> list[list[int]]:
    return model.label([features([x for _, x in lines_of(t)], lambda key: often(cells, key)) for t in texts])


def _rows(df: DataFrame, row_id: str, text: str) -> DataFrame:
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    return rows.where(F.col("row_id").isNotNull() & F.col("text").rlike(r"\S"))


def find(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, kind, start_at, fixed) of every broken word, misread word and line of furniture."""
    rows = _rows(df, row_id, text)
    sent = Corpus(rows).sent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, better, cells, model = sent.value
        speller = Speller(counts, better)
        for batch in batches:
            texts = batch["text"].tolist()
            got = [(i, *f) for i, t, own in zip(batch["row_id"], texts, _labelled(texts, cells, model)) for f in findings(t, own, speller)]
            yield pd.DataFrame(got, columns=["row_id", "kind", "start_at", "fixed"])

    return rows.mapInPandas(run, "row_id long, kind string, start_at int, fixed string")


def repaired(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, text) of every row, texts repaired."""
    sent = Corpus(_rows(df, row_id, text)).sent

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts, better, cells, model = sent.value
        speller = Speller(counts, better)
        for batch in batches:
            labels = iter(_labelled([t for t in batch if t and t.strip()], cells, model))
            yield batch.map(lambda t: repair(t, next(labels), speller) if t and t.strip() else t)

    return df.select(F.col(row_id).cast("long").alias("row_id"), run(F.col(text)).alias("text"))
