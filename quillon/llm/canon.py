"""Free-typed values to the entries of a reference list.

Values are made distinct before anything else, normalised, and scored against the list through an inverted index of
character n-grams: the cosine of idf-weighted n-gram vectors, so that what all entries share counts little. A value is
accepted when the best entry scores at least `threshold` and leads the next by `margin`; others are `UNMATCHED`.
A list of up to `limit` bytes is sent to the workers; a longer one is joined by shuffle, with the same entries found (the score
of an unmatched value is then that of its best candidate near the threshold, 0 without one).

Defined results: null and blank values give no row; equal values always get the same entry; ties between two
entries are unmatched; an empty list leaves every value unmatched; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut, fits

UNMATCHED = "UNMATCHED"

# Short forms of words in histology names.
SHORT = {
    "ca": "carcinoma", "carc": "carcinoma", "adenoca": "adenocarcinoma", "adenocarc": "adenocarcinoma", "adeno": "adenocarcinoma",
    "squam": "squamous", "sq": "squamous", "inv": "invasive", "muc": "mucinous", "kerat": "keratinizing", "min": "minimally",
    "pap": "papillary", "neuroendo": "neuroendocrine", "ne": "neuroendocrine", "pulm": "pulmonary", "tumour": "tumor",
}
# Words on site, side, grade or evidence.
ASIDE = set(
    "lung lungs pulmonary bronchus bronchial hilar pleural right left bilateral upper lower middle lobe lobes primary secondary of the in an a with and "
    "nos grade g1 g2 g3 low high well moderately poorly differentiated undifferentiated 1 2 3 4 i ii iii biopsy proven confirmed histologically cytology "
    "consistent probable suspected favor favour favored likely dx diagnosis necrosis focal type on from at site origin".split()
) - {"in"}


def fold(value: str) -> str:
    """Lower case, no accents, separators and punctuation as single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    return " ".join(re.findall(r"[a-z0-9?]+", plain))


def histology_forms(value: str) -> list[str]:
    """The normalised value, with and without its words on site, side, grade and evidence; parts around a comma in
    either order come out alike, as n-grams are counted per word."""
    text = re.sub(r"\badeno ca\b", "adenocarcinoma", fold(value))
    words = [SHORT.get(w, w) for w in text.split()]
    kept = [w for w in words if w not in ASIDE]
    return [" ".join(words), " ".join(kept)] if kept else []


_NUMBER = {"one": "i", "two": "ii", "three": "iii", "four": "iv", "1": "i", "2": "ii", "3": "iii", "4": "iv"}
_STAGE_WORDS = r"\b(?:clinical|pathologic|pathological|stagge|stage|stag|stg|st|disease|ajcc\s*\d+|ed|edition)\b"


# Words on evidence beside a stage; words on grade or site stay, as their numbers are no stages.
_STAGE_ASIDE = set("group biopsy proven confirmed histologically cytology consistent with probable suspected favor favour favored likely dx diagnosis nos".split())


def _beside_stage(word: str) -> bool:
    """Whether a word is on evidence or edition, or is the word stage with a prefix or a typing error."""
    bare = word[1:] if word[0] in "cpy" else word
    return word in _STAGE_ASIDE or bool(re.fullmatch(r"\d+th", word)) or any(len(w) >= 4 and edits(w, "stage", 1) <= 1 for w in (word, bare))


def stage_forms(value: str) -> list[str]:
    """A stage group in roman numerals and its letter; `l` or `1` among capital I's is an I."""
    text = re.sub(r"(?<![A-Za-z])([Il|]{1,3}|[Il|]V)([ABC]?)(?![a-z])", lambda m: m[1].replace("l", "I").replace("|", "I") + m[2], value.strip())
    text = re.sub(_STAGE_WORDS, " ", fold(text).replace("ajcc", " ajcc"))
    kept = " ".join(w for w in text.split() if not _beside_stage(w))
    words = [_NUMBER.get(w, w) for w in re.sub(r"([0-9])([a-c])\b", r"\1 \2", kept).split()]
    joined = re.sub(r"^[cpy]+(?=[iv])", "", "".join(words))
    return [joined] if re.fullmatch(r"(?:i{1,3}|iv)[abc]?", joined) else [" ".join(words)]


def _grams(text: str) -> Counter:
    found: Counter = Counter()
    for word in text.split():
        padded = f"^{word}$"
        for n in (2, 3):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
        found[padded] += 1
    return found


def _pairs(word: str) -> list[str]:
    """Pairs of neighbouring letters, each with its number of earlier occurrences."""
    padded, seen, out = f"^{word}$", Counter(), []
    for i in range(len(padded) - 1):
        pair = padded[i : i + 2]
        out.append(f"{pair}{seen[pair]}")
        seen[pair] += 1
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return min(last[-1], most + 1)


class Index:
    """The reference list as postings of weighted n-grams. Words of a value that are no words of the list are spelt
    as the nearest word of the list within one edit (two from seven letters on) before they are scored."""

    def __init__(self, entries: list[tuple[str, list[str]]], forms: Callable[[str], list[str]]):
        self.forms = forms
        texts = sorted({(form, code) for code, names in entries for name in names if name for form in forms(name)[:1]})
        seen: Counter = Counter(g for text, _ in texts for g in _grams(text))
        self.idf = {g: 1 + math.log(len(texts) / n) for g, n in seen.items()}
        self.rare = 1 + math.log(len(texts) + 1) if texts else 1.0
        self.codes = [code for _, code in texts]
        self.exact = defaultdict(set)
        self.vocabulary = sorted({w for text, _ in texts for w in text.split()})
        self.spelt: dict[str, str] = {w: w for w in self.vocabulary}
        self.holding: dict[str, list[str]] = defaultdict(list)
        for w in self.vocabulary:
            for pair in _pairs(w):
                self.holding[pair].append(w)
        self.postings: dict[str, list] = defaultdict(list)
        for k, (text, code) in enumerate(texts):
            self.exact[text].add(code)
            weights = self._weights(text)
            for gram, weight in weights.items():
                self.postings[gram].append((k, weight))

    def _weights(self, text: str) -> dict[str, float]:
        raw = {g: (1 + math.log(n)) * self.idf.get(g, self.rare) for g, n in _grams(text).items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {g: w / norm for g, w in raw.items()}

    def spell(self, word: str) -> str:
        if word not in self.spelt:
            if len(self.spelt) > 1_000_000:
                self.spelt = {w: w for w in self.vocabulary}
            self.spelt[word] = self._nearest(word)
        return self.spelt[word]

    def _nearest(self, word: str) -> str:
        most = _most_edits(word)
        if not most:
            return word
        shared: Counter = Counter()
        for pair in _pairs(word):
            shared.update(self.holding.get(pair, ()))
        # An edit changes at most three pairs of neighbouring letters (a swap does), so words within `most` share the others.
        needed = len(word) + 1 - 3 * most
        near = min(((edits(word, w, most), w) for w, n in shared.items() if n >= needed and len(w) >= 4), default=(most + 1, word))
        return near[1] if near[0] <= most else word

    def scores(self, value: str) -> list[tuple[float, str]]:
        """Entries by their best score over the forms of the value, best first."""
        best: dict[str, float] = defaultdict(float)
        for typed in self.forms(value):
            form = " ".join(map(self.spell, typed.split()))
            if form in self.exact:
                for code in self.exact[form]:
                    best[code] = 1.0
            found: dict[int, float] = defaultdict(float)
            for gram, weight in self._weights(form).items():
                for k, own in self.postings.get(gram, ()):
                    found[k] += weight * own
            for k, score in found.items():
                best[self.codes[k]] = max(best[self.codes[k]], score)
        return sorted(((s, c) for c, s in best.items()), reverse=True)

    def match(self, value: str, threshold: float, margin: float) -> tuple[str, float]:
        ranked = self.scores(value)
        if not ranked or ranked[0][0] < threshold or (len(ranked) > 1 and ranked[0][0] - ranked[1][0] < margin):
            return UNMATCHED, ranked[0][0] if ranked else 0.0
        return ranked[0][1], ranked[0][0]


def _by_shuffle(values: DataFrame, listed: DataFrame, forms: Callable[[str], list[str]], threshold: float, margin: float) -> DataFrame:
    """What `Index` finds, for lists of any size: spelling and scoring as joins on deletions and n-grams. `listed` has the code
    first. Forms are joined on their rarest n-grams only, as many as one of which an entry within `margin` of `threshold`
    must share, so that common n-grams bring no candidates together."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r[0], f) for r in batch.itertuples(index=False) for name in r[1:] if name for f in forms(name)[:1]]
            yield pd.DataFrame(rows, columns=["code", "text"])

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(v, k, f.split()) for v in batch["value"] for k, f in enumerate(forms(v))], columns=["value", "k", "words"])

    def deletions(most: Callable[[str], int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(w, d) for w in batch["word"] for d in _deletions(w, most(w))]
                yield pd.DataFrame(rows, columns=["word", "left"])

        return run

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(t, g, n) for t in batch["text"] for g, n in _grams(t).items()], columns=["text", "g", "n"])

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y, _most_edits(x)) - _most_edits(x) for x, y in zip(a, b)], dtype="int32")

    texts = cut(listed.toDF("code", *[f"name{k}" for k in range(len(listed.columns) - 1)]).mapInPandas(entries, "code string, text string").distinct())
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    forms_of = cut(values.mapInPandas(typed, "value string, k int, words array<string>"))
    unknown = forms_of.select(F.explode("words").alias("word")).distinct().join(words, "word", "left_anti")
    asked = unknown.mapInPandas(deletions(_most_edits), "word string, left string")
    held = words.where(F.length("word") >= 4).mapInPandas(deletions(lambda w: 2), "word string, left string").withColumnRenamed("word", "near")
    pairs = asked.join(held, "left").select("word", "near").distinct().withColumn("over", apart("word", "near")).where("over <= 0")
    spelt = pairs.groupBy("word").agg(F.min(F.struct("over", "near"))["near"].alias("near"))
    placed = forms_of.select("value", "k", F.posexplode("words").alias("at", "word")).join(spelt, "word", "left").select("value", "k", "at", F.coalesce("near", "word").alias("word"))
    spelled = placed.groupBy("value", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    spelled = cut(spelled.select("value", "text").distinct())

    own = texts.select("text").distinct().mapInPandas(grams, "text string, g string, n int")
    # As in `Index`, an entry counts once for each of its texts.
    seen = texts.mapInPandas(lambda it: (b[["text"]] for b in it), "text string").mapInPandas(grams, "text string, g string, n int").groupBy("g").agg(F.count("*").alias("df"))
    many = texts.count()
    rare = 1 + math.log(many + 1) if many else 1.0
    idf = cut(seen.select("g", (1 + F.log(F.lit(float(many)) / F.col("df"))).alias("idf")))

    def weighted(counts: DataFrame) -> DataFrame:
        raw = counts.join(idf, "g", "left").select("text", "g", ((1 + F.log("n")) * F.coalesce("idf", F.lit(rare))).alias("w"))
        return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("text"))))

    entry = cut(weighted(own).select(F.col("text").alias("entry"), "g", F.col("w").alias("v")))
    form = cut(weighted(spelled.select("text").distinct().mapInPandas(grams, "text string, g string, n int")))
    # What the n-grams from here on could add: where it is too little, an earlier one must be shared.
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("text").orderBy("w", "g").rowsBetween(Window.unboundedPreceding, 0)))
    keys = form.withColumn("rest", rest).where(F.col("rest") >= threshold - margin - 1e-9).select("text", "g")
    near = keys.join(entry, "g").select("text", "entry").distinct()
    scored = near.join(form, "text").join(entry, ["entry", "g"]).groupBy("text", "entry").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    scored = scored.withColumn("score", F.when(F.col("text") == F.col("entry"), F.lit(1.0)).otherwise(F.col("score")))
    coded = spelled.join(scored, "text").join(texts.withColumnRenamed("text", "entry"), "entry").groupBy("value", "code").agg(F.max("score").alias("score"))
    two = F.slice(F.sort_array(F.collect_list(F.struct("score", "code")), asc=False), 1, 2)
    best = coded.groupBy("value").agg(two.alias("two"))
    top, second = F.col("two")[0], F.coalesce(F.get("two", F.lit(1))["score"], F.lit(-1.0))
    sure = (top["score"] >= threshold) & (top["score"] - second >= margin)
    return values.join(best, "value", "left").select("value", F.when(sure, top["code"]).otherwise(F.lit(UNMATCHED)).alias("ref_code"), F.coalesce(top["score"], F.lit(0.0)).alias("score"))


def _most_edits(word: str) -> int:
    """Edits within which a word is spelt like one of the list."""
    return 0 if word in ASIDE else 2 if len(word) >= 7 else 1 if len(word) >= 4 else 0


def _deletions(word: str, most: int) -> set[str]:
    """The word without up to `most` of its letters; two words within so many edits have one of these in common."""
    found = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def map_values(
    rows: DataFrame, id_col: str, value: str, entries: DataFrame, names: list[str], forms: Callable[[str], list[str]],
    code: str = "ref_code", threshold: float = 0.66, margin: float = 0.03, limit: int = 16 << 20,
) -> DataFrame:
    """(id, value, ref_code, score) of every value that is neither null nor blank."""
    listed = entries.select(code, *names)
    kept = rows.select(F.col(id_col).alias("id"), F.col(value).alias("value")).where(F.col("value").rlike(r"(?U)\S"))
    if not fits(listed, limit):
        mapped = _by_shuffle(cut(kept.select("value").distinct()), listed, forms, threshold, margin)
        return kept.join(mapped, "value").select("id", "value", "ref_code", "score")
    index = Index([(r[0], list(r[1:])) for r in listed.collect()], forms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(v, *index.match(v, threshold, margin)) for v in batch["value"]]
            yield pd.DataFrame(got, columns=["value", "ref_code", "score"])

    # A given number of partitions, as adaptive execution would put few but costly values into one task.
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    mapped = kept.select("value").distinct().repartition(tasks, "value").mapInPandas(run, "value string, ref_code string, score double")
    return kept.join(mapped, "value").select("id", "value", "ref_code", "score")
