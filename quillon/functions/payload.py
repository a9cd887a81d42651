"""Model output to JSON: strict parse, salvage of the last balanced object, and typed access to payloads."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _finite(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return value


#: What decides about nesting: a backslash with the character it escapes (inside and outside quotes), quotes and braces.
_MARKS = re.compile(r'\\.|["{}]', re.S)


def _braces(text: str) -> Iterator[tuple[int, int]]:
    """(place, step) of the braces outside quotes, 1 for an opening and -1 for a closing one. Quotes count everywhere, so a
    stray one hides the braces up to its partner."""
    quoted = False
    for m in _MARKS.finditer(text):
        mark = m.group()
        if mark == '"':
            quoted = not quoted
        elif not quoted and len(mark) == 1:
            yield m.start(), 1 if mark == "{" else -1


def balanced_objects(text: str) -> list[str]:
    """Top-level brace groups in order; closing braces without an opening one are passed over."""
    found, depth, start = [], 0, 0
    for k, step in _braces(text):
        if step > 0:
            start = k if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                found.append(text[start : k + 1])
    return found


def parse(text: str | None):
    """(valid, value): the whole text as JSON, else the last balanced object that parses."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        pass
    for part in reversed(balanced_objects(text)):
        try:
            return True, json.loads(part)
        except (ValueError, RecursionError):
            continue
    return False, None


def _canonical(text) -> str | None:
    valid, value = parse(text if isinstance(text, str) else None)
    return json.dumps(_finite(value), ensure_ascii=False) if valid else None


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Canonical JSON text of a model output, null where nothing could be parsed or salvaged. `null` stays `null`."""
    return raw.map(_canonical)


def _first_close(text) -> str | None:
    """Up to where a close that leaves nothing open, a stray one included, and an opening brace have both been seen."""
    if not isinstance(text, str) or "{" not in text:
        return None
    depth = 0
    for k, step in _braces(text):
        depth += step
        if step < 0 and depth <= 0:
            return text[: max(k, text.index("{")) + 1]
    return None


@F.pandas_udf(T.StringType())
def until_first_close(raw: pd.Series) -> pd.Series:
    """The text up to the first balanced close, null while a generation should go on."""
    return raw.map(_first_close)


def braces_slice(raw: Column) -> Column:
    """From the first `{` to the last `}`; empty if there is none."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def variant(text: Column) -> Column:
    return F.try_parse_json(text)


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def has_first_note(v: Column) -> Column:
    """`notes` is a list with at least one element."""
    return get(v, "$.notes[0]", "variant").isNotNull()


def first_note(v: Column, path: str) -> Column:
    return get(v, f"$.notes[0].{path}")


def _strict(text) -> str | None:
    try:
        return json.dumps(_finite(json.loads(text)), ensure_ascii=False) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def strict_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of a text that is JSON as a whole; null otherwise."""
    return text.map(_strict)


def label_or(note: Column, path: str, missing: str = "Unknown") -> Column:
    """Upper-case text at a path: a missing key gives the default, an explicit null reads NONE."""
    raw = F.try_variant_get(note, path, "variant")
    text = F.upper(F.coalesce(F.try_variant_get(note, path, "string"), F.lit("")))
    return F.when(raw.isNull(), F.lit(missing.upper())).when(F.is_variant_null(raw), F.lit("NONE")).otherwise(text)


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _words(v: Column, *paths: str) -> Column:
    """The given values of an object in one line; null and blank ones are left out."""
    parts = F.array(*[F.regexp_replace(F.try_variant_get(v, p, "string"), r"^\s+|\s+$", "") for p in paths])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def _lines(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def _item_line(lead: Column, columns: tuple[str, ...]):
    """Makes the line of a list element behind `lead`; elements that are no objects have none."""

    def line(x: Column) -> Column:
        both = F.filter(F.array(lead, _words(x, *columns)), lambda w: w != "")
        return F.when(F.schema_of_variant(x).startswith("OBJECT"), F.array_join(both, " "))

    return line


#: Sections of a note in the order of its text: single lines, and lists with their columns.
NOTE_SECTIONS = (
    (None, ("$.staging.prefix", "$.staging.T", "$.staging.N", "$.staging.M", "$.staging.stage_group")),
    (None, ("$.histology.name", "$.histology.icdo3", "$.histology.snomed")),
    ("$.molecular.drivers", ("$.gene", "$.result", "$.variant", "$.snomed_qualifier")),
    ("$.imaging", ("$.modality", "$.finding", "$.snomed")),
    ("$.treatment.modalities", ("$.type", "$.snomed")),
    ("$.equity.factors", ("$.issue", "$.snomed")),
    (None, ("$.demographics.age", "$.demographics.sex", "$.demographics['race/ethnicity']")),
)


def note_text(v: Column) -> Column:
    """All notes of a payload as lines of text for coding; empty without a list of notes."""

    def of(note: Column) -> Column:
        parts = []
        for path, columns in NOTE_SECTIONS:
            if path is None:
                parts.append(F.array(_words(note, *columns)))
                continue
            lead = _words(note, "$.treatment.intent") if "treatment" in path else F.lit("")
            parts.append(F.transform(_items(note, path), _item_line(lead, columns)))
        raw = F.try_variant_get(note, "$.free_text", "variant")
        text = F.when(F.schema_of_variant(raw) == "STRING", F.regexp_replace(F.try_variant_get(note, "$.free_text", "string"), r"^\s+|\s+$", ""))
        return F.concat(*parts, F.array(text))

    notes = F.filter(_items(v, "$.notes"), lambda n: F.schema_of_variant(n).startswith("OBJECT"))
    return _lines(F.flatten(F.transform(notes, of)))


def timeline_text(v: Column) -> Column:
    """A timeline payload as lines of text for coding: the seed case's sections, then each visit with its therapies, cycles,
    events and labs. A missing value is empty, an explicit null reads None."""

    def value(x: Column, path: str) -> Column:
        raw = F.try_variant_get(x, path, "variant")
        return F.when(raw.isNull(), F.lit("")).when(F.is_variant_null(raw), F.lit("None")).otherwise(F.coalesce(F.try_variant_get(x, path, "string"), F.lit("")))

    def row(x: Column, *paths: str) -> Column:
        return F.concat_ws(" ", *[F.concat(F.lit(p[0]), value(x, p[1])) if isinstance(p, tuple) else value(x, p) for p in paths])

    def objects(x: Column, path: str) -> Column:
        return F.filter(_items(x, path), lambda y: F.schema_of_variant(y).startswith("OBJECT"))

    def visit(x: Column) -> Column:
        therapies = F.flatten(F.transform(objects(x, "$.therapies"), lambda t: F.concat(
            F.array(row(t, "$.type", "$.regimen", "$.intent", ("line:", "$.line"))), F.transform(objects(t, "$.cycles"), lambda c: row(c, ("cycle ", "$.cycle"), "$.date", "$.dose_mod")),
        )))
        return F.concat(
            F.array(row(x, "$.staging.T", "$.staging.N", "$.staging.M", "$.staging.stage_group"), row(x, "$.imaging.modality", "$.imaging.findings")), therapies,
            F.transform(objects(x, "$.adverse_events"), lambda a: row(a, "$.name", ("grade ", "$.grade"), "$.action")),
            F.transform(objects(x, "$.labs"), lambda b: row(b, "$.name", "$.value", "$.unit", "$.trend")), F.array(value(x, "$.assessment"), value(x, "$.plan")),
        )

    seed = F.array(*[F.to_json(F.try_variant_get(v, f"$.seed_case.{k}", "variant")) for k in ("staging", "histology", "molecular", "demographics")])
    return _lines(F.concat(seed, F.flatten(F.transform(objects(v, "$.timeline"), visit))))
