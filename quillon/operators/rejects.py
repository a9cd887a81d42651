"""Typed loading of CSV records with a reason for each one that does not load.

Each record is one row of the input. On the workers every batch goes through two steps:

1. Quoting is decided by the grammar of the format, per record, before anything is written: a file reader
   resynchronises only at a line end, so one open quote would swallow the records after it, and DuckDB's reader
   takes a quote inside an unquoted field for text.
2. All well-quoted records of the batch are written to one CSV file in a temporary folder of the worker, which lives as
   long as the batch (line breaks inside records become characters that the batch does not hold, so that a record is a
   line; a guard column closes each line, as the reader forgives one empty column at the end), and are read by DuckDB
   with typed columns and reject tables. Its errors by line are joined back to the records and give the reason by their
   type; the rows it accepts are the typed output. Where its types are more lenient or stricter than the format (UUIDs
   without dashes or in capitals, `yes` as a boolean, dates with a space, time zones), the exact patterns decide.

Reasons, the first that applies: `quoting`, `column_count`, `bad_value`. Null and white-space records are neither
valid nor damaged and give no row. A trailing CR belongs to the record end. Equal records each get their row, as do
records without an id. Extra columns are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("run_id", "timestamp", "layer", "model", "prompt_type", "parsed_json_valid", "validation_errors", "raw_output")
_FIELD = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*+\Z", re.S)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_STAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?:Z|[+-]\d\d:?\d\d)?")
LAYERS = ("exploratory", "controlled", "longitudinal")
#: Types by which DuckDB reads, where they are not text.
TYPES = {"run_id": "UUID", "timestamp": "TIMESTAMP", "parsed_json_valid": "BOOLEAN"}
#: Reasons by the reader's error types.
REASONS = {"UNQUOTED VALUE": "quoting", "MISSING COLUMNS": "column_count", "TOO MANY COLUMNS": "column_count", "CAST": "bad_value"}
_FIELDS = re.compile(rf"({_FIELD})(?:,|\Z)", re.S)

OUT = (
    "line_id string, reason string, detail string, run_id string, timestamp timestamp, layer string, model string, prompt_type string, "
    "parsed_json_valid boolean, validation_errors array<string>, raw_output string"
)


def _stamp(text: str):
    if not _STAMP.fullmatch(text):
        return None
    try:
        got = datetime.fromisoformat(text.replace(",", "."))
    except ValueError:
        return None
    return got if got.tzinfo is None else got.astimezone(timezone.utc).replace(tzinfo=None)


def _errors(text: str):
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, list) and all(isinstance(x, str) for x in got) else None


def typed(values: tuple) -> tuple[str | None, tuple]:
    """The first field that holds no valid value, and the typed record."""
    run, stamp, layer, model, prompt, valid, errors, raw = ("" if v is None else v for v in values)
    at, found = _stamp(stamp), _errors(errors)
    flag = {"true": True, "false": False}.get(valid.lower())
    for name, bad in (
        ("run_id", not _UUID.fullmatch(run)),
        ("timestamp", at is None),
        ("layer", layer not in LAYERS),
        ("parsed_json_valid", flag is None),
        ("validation_errors", found is None),
    ):
        if bad:
            return name, ()
    return None, (run, at, layer, model, prompt, flag, found, raw)


def fields_of(record: str) -> tuple[str, ...]:
    """The fields of a well-quoted record."""
    found, at = [], 0
    while True:
        m = _FIELDS.match(record, at)
        text = m.group(1)
        found.append(text[1:-1].replace('""', '"') if text.startswith('"') else text)
        if m.end() == m.end(1):
            return tuple(found)
        at = m.end()


def _hidden(records: list[str]) -> dict[str, str]:
    """Private-use characters that no record holds, to stand for line breaks and NULs in a file."""
    held = set().union(*map(set, records))
    free = (chr(c) for area in ((0xE000, 0xF900), (0xF0000, 0xFFFFE), (0x100000, 0x10FFFE)) for c in range(*area) if chr(c) not in held)
    return {c: next(free) for c in "\n\r\0"}


def read_with_rejects(folder: str, records: list[str]) -> tuple[dict[int, tuple], dict[int, list[tuple[str, str]]]]:
    """Typed rows by record number, and the reader's errors (type, column) by record number from its reject table."""
    import duckdb

    path = os.path.join(folder, "records.csv")
    hide = _hidden(records)
    show = str.maketrans({v: k for k, v in hide.items()})
    table = str.maketrans(hide)
    with open(path, "w", encoding="utf-8", newline="") as out:
        for number, record in enumerate(records):
            out.write(f"{number},{record.translate(table)},.\n")
    names = ", ".join(f"'{c}': '{TYPES.get(c, 'VARCHAR')}'" for c in COLUMNS)
    longest = 4 * max(map(len, records)) + 1024
    con = duckdb.connect()
    con.execute("SET threads = 1")
    rows = con.execute(
        f"""SELECT * FROM read_csv('{path}', header = false, auto_detect = false, delim = ',', quote = '"', escape = '"',
        columns = {{'number': 'BIGINT', {names}, 'guard': 'VARCHAR'}}, store_rejects = true, rejects_limit = 0, new_line = '\\n',
        max_line_size = {max(longest, 2097152)}, buffer_size = {max(8 * longest, 33554432)})"""
    ).fetchall()
    wrong: dict[int, list[tuple[str, str]]] = {}
    for kind, column, line in con.execute("SELECT error_type, column_name, csv_line FROM reject_errors").fetchall():
        number = (line or "").split(",", 1)[0]
        if number.isdigit():
            wrong.setdefault(int(number), []).append((kind, column or ""))
    con.close()
    return {r[0]: tuple(v.translate(show) if isinstance(v, str) else v for v in r[1:-1]) for r in rows}, wrong


def judged(record: str, got: tuple | None, errors: list[tuple[str, str]]) -> tuple[str | None, str | None, tuple]:
    """(reason, detail, typed values) of a well-quoted record, from the reader's row or errors and the exact patterns."""
    by_reason = {}
    for kind, column in errors:
        by_reason.setdefault(REASONS.get(kind, kind), (kind, column))
    for reason in ("quoting", "column_count"):
        if reason in by_reason:
            return reason, by_reason[reason][0], ()
    fields = fields_of(record)
    if len(fields) != len(COLUMNS):
        return "column_count", "fields", ()
    bad, values = typed(fields)
    if bad:
        cast = next((f"{kind} " for kind, column in errors if column == bad), "")
        return "bad_value", cast + bad, ()
    if got is None or got[1] != values[1] or got[5] != values[5]:
        return None, None, values
    return None, None, (str(got[0]), *got[1:6], values[6], "" if got[7] is None else got[7])


def _load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, out = [], []
        for key, line in zip(batch["line_id"], batch["line"]):
            if line is None or not line.strip():
                continue
            record = line[:-1] if line.endswith("\r") else line
            if _RECORD.match(record):
                kept.append((key, record))
            else:
                out.append((key, "quoting", "grammar", *[None] * 8))
        if kept:
            with tempfile.TemporaryDirectory() as folder:
                rows, wrong = read_with_rejects(folder, [r for _, r in kept])
            for number, (key, record) in enumerate(kept):
                reason, detail, values = judged(record, rows.get(number), wrong.get(number, []))
                out.append((key, reason, detail, *[None] * 8) if reason else (key, None, None, *values))
        frame = pd.DataFrame(out, columns=["line_id", "reason", "detail", *COLUMNS], dtype=object)
        frame["timestamp"] = pd.to_datetime(frame["timestamp"])
        yield frame


def load_records(df: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """Every record that is not blank: typed columns where `reason` is null, the reason otherwise; `detail` names
    the reader's error and the offending field, or only the field where a pattern alone refused it. No shuffle: the work is per record."""
    # Ids travel as text: a null among them would turn a column of longs into floats on the way.
    rows = df.select(F.col(line_id).cast("string").alias("line_id"), F.col(line).alias("line")).mapInPandas(_load, OUT)
    return rows.withColumn("line_id", F.col("line_id").cast("long"))
