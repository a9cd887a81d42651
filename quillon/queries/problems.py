"""The queries of problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import rejects, shred
from quillon.session import table

#: Table paths and the names of the entities they hold.
NOTE_ENTITIES = {
    "notes": "note",
    "notes.molecular.drivers": "driver",
    "notes.imaging": "imaging",
    "notes.treatment.modalities": "modality",
    "notes.equity.factors": "factor",
}
TIMELINE_ENTITIES = {
    "timeline": "visit",
    "timeline.therapies": "therapy",
    "timeline.therapies.cycles": "cycle",
    "timeline.adverse_events": "adverse_event",
    "timeline.labs": "lab",
}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = rejects.load_records(table(spark, sf_dir, "result_lines"))
    return loaded.where(F.col("reason").isNotNull()).select("line_id", "reason")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records, typed."""
    loaded = rejects.load_records(table(spark, sf_dir, "result_lines"))
    return loaded.where(F.col("reason").isNull()).drop("reason", "detail")


def _entities(df: DataFrame, rec_id: str, doc: str, src: str, names: dict[str, str]) -> DataFrame:
    plan = shred.plan_relations(shred.schema_graph(df, doc), tuple(names))
    rows = shred.shred(df, rec_id, doc, plan, with_fields=False)
    entity = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    at = lambda k: F.coalesce(F.get("pos", F.lit(k)), F.lit(-1)).cast("int")
    return rows.where(F.col("relation").isin(*names)).select(
        F.lit(src).alias("src"), "rec_id", entity[F.col("relation")].alias("entity"),
        at(0).alias("pos_a"), at(1).alias("pos_b"), at(2).alias("pos_c"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "master_results")
    timelines = table(spark, sf_dir, "timeline_results")
    return _entities(runs, "line_no", "parsed_json", "master_results", NOTE_ENTITIES).unionByName(
        _entities(timelines, "timeline_id", "payload", "timeline_results", TIMELINE_ENTITIES)
    )


def p3_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the flat tables: molecular drivers with the link to their note."""
    runs = table(spark, sf_dir, "master_results")
    plan = shred.plan_relations(shred.schema_graph(runs, "parsed_json"), tuple(NOTE_ENTITIES))
    rows = shred.shred(runs, "line_no", "parsed_json", plan)
    return shred.relation(rows, "notes.molecular.drivers", {"gene": "gene", "result": "result", "variant": "variant"})


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records by plain values, for comparison."""
    loaded = p2_loaded(spark, sf_dir)
    return loaded.select(
        "line_id", "run_id", F.unix_micros("timestamp").alias("stamp"), "layer", "model", "prompt_type", "parsed_json_valid",
        F.array_join("validation_errors", "|").alias("problems"), F.md5("raw_output").alias("raw"),
    )


def p3_driver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drivers with their links as columns, for comparison."""
    return p3_drivers(spark, sf_dir).select("rec_id", F.col("parent_key")[0].cast("int").alias("note"), F.col("key")[1].cast("int").alias("driver"), "gene", "result", "variant")


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p2_values": p2_values, "p3_found": p3_found, "p3_drivers": p3_drivers, "p3_driver_rows": p3_driver_rows}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_SQL_RECORDS = rf"""r as (select line_id, regexp_replace(line,'\r$','') rec from result_lines where regexp_matches(line,'\S')),
 q as (select line_id, rec, regexp_full_match(rec,'(?s){_FIELD}(?:,{_FIELD})*') ok from r),
 f as (select line_id, ok, case when ok then list_transform(regexp_extract_all(rec||',','(?s)({_FIELD}),',1), lambda x: case when starts_with(x,'"') then replace(substr(x,2,length(x)-2),'""','"') else x end) end v from q),
 c as (select line_id, case when not ok then 'quoting' when len(v)<>8 then 'column_count'
  when not regexp_full_match(v[1],'[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') or not regexp_full_match(v[2],'\d{{4}}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?') or try_cast(v[2] as timestamp) is null
   or v[3] not in ('exploratory','controlled','longitudinal') or lower(v[6]) not in ('true','false') or not json_valid(v[7])
   or coalesce(json_type(case when json_valid(v[7]) then v[7] end),'')<>'ARRAY' or len(list_filter(json_extract(case when json_valid(v[7]) then v[7] end,'$[*]'), lambda e: json_type(e)<>'VARCHAR'))>0 then 'bad_value' end reason, v from f)"""


def _sql_items(x: str) -> str:
    """The elements of an array, of a lone object, or of what a text holds."""
    held = f"json_extract_string({x},'$')"
    v = f"(case when json_type({x})='VARCHAR' and json_valid({held}) then cast({held} as json) else {x} end)"
    return f"(case json_type({v}) when 'ARRAY' then json_extract({v},'$[*]') when 'OBJECT' then [{v}] else [] end)"


def _sql_child(name: str, parent: str, path: str, keys: str) -> str:
    items = _sql_items(f"json_extract(o,'$.{path}')")
    return f"{name}_l as (select {keys}, {items} l from {parent}), {name} as (select * from (select {keys}, unnest(l) o, generate_subscripts(l,1)-1 pos_{name} from {name}_l) where json_type(o)='OBJECT')"


_SQL_NOTE = ", ".join(
    ["top as (select line_no rec, cast(parsed_json as json) o from master_results where json_valid(parsed_json))", _sql_child("note", "top", "notes", "rec")]
    + [_sql_child(n, "note", path.removeprefix("notes."), "rec, pos_note") for path, n in NOTE_ENTITIES.items() if n != "note"]
)
_SQL_TIMELINE = ", ".join(
    ["ttop as (select timeline_id rec, cast(payload as json) o from timeline_results where json_valid(payload))", _sql_child("visit", "ttop", "timeline", "rec")]
    + [_sql_child(n, "visit", n_path, "rec, pos_visit") for n, n_path in (("therapy", "therapies"), ("adverse_event", "adverse_events"), ("lab", "labs"))]
    + [_sql_child("cycle", "therapy", "cycles", "rec, pos_visit, pos_therapy")]
)


def _sql_rows(src: str, name: str, *pos: str) -> str:
    at = [*pos, *["-1"] * (3 - len(pos))]
    return f"select '{src}' src, rec rec_id, '{name}' entity, {at[0]}::int pos_a, {at[1]}::int pos_b, {at[2]}::int pos_c from {name}"


ORACLES: dict[str, str] = {
    "p2_found": f"with {_SQL_RECORDS} select line_id, reason from c where reason is not null",
    "p2_values": f"""with {_SQL_RECORDS} select line_id, v[1] run_id, epoch_us(v[2]::timestamp) stamp, v[3] layer, v[4] model, v[5] prompt_type, lower(v[6]) = 'true' parsed_json_valid,
 array_to_string(json_extract_string(v[7], '$[*]'), '|') problems, md5(v[8]) raw from c where reason is null""",
    "p3_driver_rows": f"with {_SQL_NOTE} select rec rec_id, pos_note::int note, pos_driver::int driver, {', '.join(f"json_extract_string(o, '$.{k}') {k}" for k in ('gene', 'result', 'variant'))} from driver",
    "p3_found": f"with {_SQL_NOTE}, {_SQL_TIMELINE} "
    + " union all ".join(
        [_sql_rows("master_results", "note", "pos_note")]
        + [_sql_rows("master_results", n, "pos_note", f"pos_{n}") for n in NOTE_ENTITIES.values() if n != "note"]
        + [_sql_rows("timeline_results", "visit", "pos_visit")]
        + [_sql_rows("timeline_results", n, "pos_visit", f"pos_{n}") for n in ("therapy", "adverse_event", "lab")]
        + [_sql_rows("timeline_results", "cycle", "pos_visit", "pos_therapy", "pos_cycle")]
    ),
}
