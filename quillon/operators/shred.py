"""Nested JSON records to related flat tables by shared inlining.

1. `schema_graph` reads every record once and returns the graph of object paths: how often each occurs, whether
   it repeats under one parent, and a signature of its keys. Arrays add no level of their own.
2. `plan_relations` decides on the driver, from the graph alone (bounded by `max_paths`), which paths become
   tables: the root, everything repeated, everything shared by several parents (same key, same child keys) and
   everything recursive. All other descendants are inlined into their nearest table.
3. `shred` walks every record once more along that plan and emits one row per object of a table, with its
   position under each repeated ancestor (the foreign key: a child's positions extend its parent's).

Defined results: a null, blank or unparsable record gives no row, as does a record that is no object or has no id. A lone object
where an array is expected is its element 0. Text that itself holds an array or object counts as what it holds.
Elements that are not objects keep their position and give no row. Keys may clash with column names of the
input: they live in the map `fields`, never beside the input's columns. Equal records give equal rows under
their own ids. An empty input gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

SEP = "\x1f"


def decode(value):
    """What a text holds, if that is an array or object; else the value itself."""
    if isinstance(value, str):
        text = value.lstrip()
        if text[:1] in ("{", "["):
            try:
                held = json.loads(text)
            except (ValueError, RecursionError):
                return value
            return held if isinstance(held, (dict, list)) else value
    return value


def _parse(text):
    if not isinstance(text, str) or not text.strip():
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _fold(path: tuple[str, ...], key: str) -> tuple[str, ...]:
    """A key that already stands on its own path is the same, recursive element."""
    return path[: path.index(key) + 1] if key in path else (*path, key)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial graph of one task: path, parent, occurrences, arrays, most objects under one parent, leaf keys."""
    seen: dict[tuple, list] = {}
    keys = 0

    def frame() -> pd.DataFrame:
        nonlocal keys
        keys = 0
        rows = [(SEP.join(p), SEP.join(q), e[0], e[1], e[2], e[3], sorted(e[4])) for (p, q), e in seen.items()]
        seen.clear()
        return pd.DataFrame(rows, columns=["path", "parent", "n", "arrays", "most", "recursive", "keys"]).astype({"keys": object})

    def note(parent, path, count, listed, recursive):
        entry = seen.setdefault((path, parent), [0, 0, 0, 0, set()])
        entry[0] += count
        entry[1] += listed
        entry[2] = max(entry[2], count)
        entry[3] += recursive
        return entry

    for batch in batches:
        for text in batch["doc"]:
            top = decode(_parse(text))
            if not isinstance(top, dict):
                continue
            stack = [(top, ())]
            note((), (), 1, 0, 0)
            while stack:
                node, path = stack.pop()
                for key, raw in node.items():
                    value = decode(raw)
                    if not isinstance(value, (dict, list)):
                        if (path, path[:-1]) in seen:
                            seen[path, path[:-1]][4].add(key)
                            keys += 1
                        continue
                    below = _fold(path, key)
                    listed = isinstance(value, list)
                    objects = [x for x in map(decode, value) if isinstance(x, dict)] if listed else [value]
                    if listed and value and not objects:
                        continue
                    note(path, below, len(objects), int(listed), int(len(below) <= len(path)))
                    stack.extend((x, below) for x in objects)
            if len(seen) > 100_000 or keys > 1_000_000:
                yield frame()
    yield frame()


def schema_graph(df: DataFrame, doc: Column | str) -> DataFrame:
    """One row per (path, parent path) over all records; partial graphs are made on the workers, so the shuffle
    carries paths, not records."""
    scanned = cut(df.select(F.col(doc) if isinstance(doc, str) else doc).toDF("doc").mapInPandas(
        _scan, "path string, parent string, n long, arrays long, most long, recursive long, keys array<string>"
    ))
    # The keys of a path are compared as a whole, so their number and the sum of their hashes do; no list of them is made.
    distinct = scanned.select("path", F.explode("keys").alias("key")).distinct()
    signed = distinct.groupBy("path").agg(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64("key").cast("decimal(38,0)"))).alias("keys"))
    paths = scanned.groupBy("path", "parent").agg(*[F.sum(c).alias(c) for c in ("n", "arrays")], F.max("most").alias("most"), F.sum("recursive").alias("recursive"))
    return paths.join(signed, "path", "left")


@dataclass
class Plan:
    """Which paths are tables (`tables`: path to table name) and which are inlined (`inner`)."""

    tables: dict[tuple[str, ...], str] = field(default_factory=dict)
    inner: set[tuple[str, ...]] = field(default_factory=set)


def plan_relations(graph: DataFrame, repeated: tuple[str, ...] = (), root: str = "root", max_paths: int = 20_000) -> Plan:
    """The tables of a graph. `repeated` lists dotted paths to be tables whether or not the data repeat them.

    A graph of more than `max_paths` paths (keys used as data) raises ValueError rather than being cut short."""
    rows = graph.limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"over {max_paths} object paths; such keys are data, model them as a map first")
    plan = Plan({(): root})
    kinds: dict[tuple, list] = {}
    for r in rows:
        if r["path"]:
            path = tuple(r["path"].split(SEP))
            got = kinds.setdefault(path, [False, r["keys"]])
            got[0] |= r["arrays"] > 0 or r["most"] > 1 or r["recursive"] > 0
    for dotted in repeated:
        path = tuple(dotted.split("."))
        for k in range(1, len(path)):
            kinds.setdefault(path[:k], [False, None])
        kinds.setdefault(path, [False, None])[0] = True
    alike: dict[tuple, list] = {}
    for path, (_, keys) in kinds.items():
        if keys:
            alike.setdefault((path[-1], keys), []).append(path)
    shared = {path for paths in alike.values() if len(paths) > 1 for path in paths}
    for path in sorted(kinds):
        if kinds[path][0] or path in shared:
            plan.tables[path] = path[-1] if path in shared and not kinds[path][0] else ".".join(path)
        else:
            plan.inner.add(path)
    return plan


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _walker(plan: Plan, with_fields: bool):
    tables, inner = plan.tables, plan.inner

    def inline(node: dict, path: tuple, prefix: str, fields: dict, below: list, pos: tuple) -> None:
        for key, raw in node.items():
            to = _fold(path, key)
            if to in tables:
                below.append((to, raw, pos))
            elif to in inner and isinstance(value := decode(raw), dict):
                inline(value, to, f"{prefix}{key}.", fields, below, pos)
            elif with_fields:
                fields[prefix + key] = _scalar(raw)

    def walk(top: dict):
        stack = [((), top, (), None)]
        while stack:
            path, raw, pos, parent = stack.pop()
            value = decode(raw)
            if path == ():
                objects = [(value, pos)]
            elif isinstance(value, list):
                objects = [(decode(x), (*pos, i)) for i, x in enumerate(value)]
            else:
                objects = [(value, (*pos, 0))]
            for node, at in objects:
                if isinstance(node, dict):
                    fields: dict = {}
                    below: list = []
                    inline(node, path, "", fields, below, at)
                    yield tables[path], parent, at, fields
                    stack.extend((to, x, p, tables[path]) for to, x, p in below)

    return walk


def shred(df: DataFrame, rec_id: str, doc: str, plan: Plan, with_fields: bool = True) -> DataFrame:
    """One row per object of every table: rec_id, relation, parent relation, pos (positions under the repeated
    ancestors and its own) and fields (inlined scalars by dotted name; arrays of scalars as JSON text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _walker(plan, with_fields)
        for batch in batches:
            ids, rel, par, pos, fields = [], [], [], [], []
            for key, text in zip(batch["rec_id"], batch["doc"]):
                top = decode(_parse(text))
                if isinstance(top, dict):
                    for table, parent, at, values in walk(top):
                        ids.append(key)
                        rel.append(table)
                        par.append(parent)
                        pos.append(list(at))
                        fields.append(values)
            out = {"relation": rel, "parent": par, "pos": pos} | ({"fields": fields} if with_fields else {})
            yield pd.DataFrame({"rec_id": pd.Series(ids, dtype="int64")} | {k: pd.Series(v, dtype=object) for k, v in out.items()})

    kind = "rec_id long, relation string, parent string, pos array<int>" + ", fields map<string,string>" * with_fields
    rows = df.where(F.col(rec_id).isNotNull() & F.col(doc).isNotNull())
    return rows.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(doc).alias("doc")).mapInPandas(run, kind)


def relation(shredded: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """One flat table out of `shred`: key columns and the chosen fields under the given column names."""
    return shredded.where(F.col("relation") == name).select(
        "rec_id",
        F.col("pos").alias("key"),
        F.slice("pos", 1, F.greatest(F.size("pos") - 1, F.lit(0))).alias("parent_key"),
        *[F.col("fields")[source].alias(target) for target, source in columns.items()],
    )
