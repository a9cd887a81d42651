"""Registered queries of the corpus-quality operators on the run-log tables, each with its oracle where SQL has one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import labels as L
from quillon.functions import payload as P
from quillon.operators import annotate, audit, gates, metrics, prepare, split, stats, vector
from quillon.plans import runs as plans
from quillon.session import ensure_checkpoint_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, big: str = ""):
    """Registers a query; `big` names counts that the oracle's engine would give a wider type."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            casts = ", ".join(f"cast({c} as bigint) as {c}" for c in big.split())
            ORACLES[name] = f"select * replace ({casts}) from ({sql})" if big else sql
        return f

    return add


# --- pieces of oracle SQL -------------------------------------------------------------------------------------------


def _clean(x: str) -> str:
    return rf"upper(regexp_replace(coalesce({x},''),'^\s+|\s+$','','g'))"


def _cut(x: str, p: str) -> str:
    return f"(case when starts_with({x},'{p}') then substr({x},2) else {x} end)"


def sql_a(x: str, p: str) -> str:
    t = _clean(x)
    f = f"regexp_extract({_cut(f"regexp_replace({t},'^[PC]','')", p)},'^(IS|X|[0-4])',1)"
    return f"(case when {t} in ('','NONE','NULL','NAN','UNKNOWN') or {f}='' then '{p}UNKNOWN' else '{p}'||{f} end)"


def sql_b(x: str, p: str, sn: str = "", nan: str = "'NAN',") -> str:
    t = _clean(x)
    r = _cut(t, p)
    f = rf"regexp_extract({r},'^(\d+|IS|X{sn})',1)"
    return f"(case when {t} in ('','NONE','NULL',{nan}'UNKNOWN') then 'UNKNOWN' when {f}='' then '{p}'||{r} else '{p}'||{f} end)"


def sql_d(x: str, p: str) -> str:
    f = f"regexp_extract(coalesce({x},''),'^(?i){p}(is|x|[0-4])',1)"
    return f"(case when {f}<>'' then '{p}'||upper({f}) end)"


def sql_note(path: str) -> str:
    return f"json_extract_string(parsed_json,'$.notes[0].{path}')"


def sql_words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(coalesce({x},''),'\s+'), lambda w: w<>''))"


SQL_NOTES = "json_extract(parsed_json,'$.notes[0]') is not null"
SQL_GOLDEN = f"""golden as (select line_no, run_id, layer, model, {", ".join(f"{sql_a(sql_note(f'staging.{s}'), s)} {s.lower()}" for s in "TNM")},
 upper(coalesce({sql_note("staging.stage_group")},'Unknown')) stage_group from master_results
 where layer in ('controlled','longitudinal') and parsed_json_valid and len(validation_errors)=0 and {SQL_NOTES})"""


def sql_entropy(counts: str, keys: str) -> str:
    """Entropy from counts n by keys."""
    return f"select {keys}, cast(sum(n) as bigint) total, count(*) classes, round(case when count(*)>1 then ln(sum(n))-sum(n*ln(n))/sum(n) else 0.0 end,6) entropy from {counts} group by {keys}"


# --- frames ---------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "master_results")


def golden(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of golden runs: controlled or longitudinal, parsed, no validation errors, with a first note."""
    rows = _runs(spark, sf).where(F.col("layer").isin("controlled", "longitudinal") & F.col("parsed_json_valid") & (F.size("validation_errors") == 0))
    v = P.variant(F.col("parsed_json"))
    rows = rows.select("line_no", "run_id", "layer", "model", v.alias("v")).where(P.has_first_note(F.col("v")))
    return rows.select(
        "line_no", "run_id", "layer", "model", *[L.norm_a(P.first_note(F.col("v"), f"staging.{s}"), s).alias(s.lower()) for s in "TNM"],
        F.upper(F.coalesce(P.first_note(F.col("v"), "staging.stage_group"), F.lit("Unknown"))).alias("stage_group"),
    )


def exploratory(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).where((F.col("layer") == "exploratory") & F.col("parsed_json_valid"))
    rows = rows.select("line_no", "model", P.variant(F.col("parsed_json")).alias("v")).where(P.has_first_note(F.col("v")))
    return rows.select(
        "line_no", "model", *[L.norm_a(P.first_note(F.col("v"), f"staging.{s}"), s).alias(s.lower()) for s in "TNM"],
        P.first_note(F.col("v"), "histology.name").alias("histology"), P.first_note(F.col("v"), "demographics.sex").alias("sex"),
    )


def _params(spark: SparkSession, sf: str) -> DataFrame:
    v = P.variant(F.col("params"))
    rows = _runs(spark, sf).select("line_no", "model", "layer", "parsed_json_valid", F.get_json_object("params", "$.temperature").alias("temperature"), v.alias("v"))
    flag = lambda k: F.coalesce(P.get(F.col("v"), f"$.{k}", "boolean"), F.lit(True))
    return rows.select(
        "line_no", "model", "layer", "parsed_json_valid", F.coalesce("temperature", F.lit("N/A")).alias("temperature"),
        flag("use_chat_template").alias("use_chat_template"), flag("strict_json").alias("strict_json"),
    )


SQL_PARAMS = """p as (select line_no, model, layer, parsed_json_valid, coalesce(json_extract_string(params,'$.temperature'),'N/A') temperature,
 coalesce(try_cast(json_extract_string(params,'$.use_chat_template') as boolean),true) use_chat_template, coalesce(try_cast(json_extract_string(params,'$.strict_json') as boolean),true) strict_json from master_results)"""


def _shifted(target: str, key: str, classes: tuple) -> Column:
    """A stand-in prediction: the target, or the next class for three of sixteen keys."""
    nxt = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, classes[(k + 1) % len(classes)])])
    return F.when(F.substring(F.md5(key), 1, 1).isin("0", "1", "2"), F.coalesce(nxt[F.col(target)], F.col(target))).otherwise(F.col(target))


def _sql_shifted(target: str, key: str, classes: tuple) -> str:
    cases = " ".join(f"when {target}='{c}' then '{classes[(k + 1) % len(classes)]}'" for k, c in enumerate(classes))
    return f"(case when substr(md5({key}),1,1) in ('0','1','2') then (case {cases} else {target} end) else {target} end)"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "train_split").select("split_id", "run_id", "split_name", "model", "word_count", "free_text", *[F.col(f"{s}_target") for s in "tnm"])
    return rows.select("*", *[_shifted(f"{s.lower()}_target", "run_id", L.CLASSES[s]).alias(f"{s.lower()}_pred") for s in "TNM"])


SQL_PRED = f"""pr as (select split_id, run_id, split_name, model, word_count, t_target, n_target, m_target, {", ".join(f"{_sql_shifted(f'{s.lower()}_target', 'run_id', L.CLASSES[s])} {s.lower()}_pred" for s in "TNM")} from train_split)"""

# --- scans, projections, filters ----------------------------------------------------------------------------------


@query("flatten_golden", f"with {SQL_GOLDEN} select * from golden")
def _(spark, sf):
    return golden(spark, sf)


@query(
    "flatten_exploratory",
    f"""select line_no, model, {", ".join(f"{sql_a(sql_note(f'staging.{s}'), s)} {s.lower()}" for s in "TNM")}, {sql_note("histology.name")} histology, {sql_note("demographics.sex")} sex
 from master_results where layer='exploratory' and parsed_json_valid and {SQL_NOTES}""",
)
def _(spark, sf):
    return exploratory(spark, sf)


@query("param_projection", f"with {SQL_PARAMS} select * from p")
def _(spark, sf):
    return _params(spark, sf)


@query(
    "salvage_json",
    """select line_no, parsed_json_valid valid, json_extract_string(parsed_json,'$."$schema_version"') schema_version, json_type(parsed_json)='OBJECT' is_object from master_results where parsed_json is not null
 union all select line_no, parsed_json_valid, null, null from master_results where parsed_json is null""",
)
def salvage(spark, sf):
    """Parse-or-salvage from the raw outputs; the oracle reads the fields that are known."""
    rows = _runs(spark, sf).select("line_no", P.canonical_json("raw_output").alias("j"))
    v = P.variant(F.col("j"))
    return rows.select("line_no", F.col("j").isNotNull().alias("valid"), P.get(v, "$['$schema_version']").alias("schema_version"), F.when(F.col("j") != "null", F.col("j").startswith("{")).alias("is_object"))


_SQL_STOP = r"""with t as (select line_no, raw_output, regexp_extract_all(raw_output, '(?s)[^\\"{}]*(?:\\.|["{}])') segs from master_results where raw_output like '%{%'),
 u as (select line_no, unnest(segs) seg, generate_subscripts(segs, 1) i from t),
 v as (select line_no, i, sum(length(seg)) over w pos, case when seg[-2:-2] = chr(92) then '' else seg[-1:] end c from u window w as (partition by line_no order by i)),
 q as (select *, sum((c = '"')::int) over (partition by line_no order by i) % 2 quoted from v),
 d as (select *, sum(case when quoted = 1 then 0 when c = '{' then 1 when c = '}' then -1 else 0 end) over (partition by line_no order by i) depth from q),
 f as (select line_no, min(pos) pos from d where quoted = 0 and c = '}' and depth <= 0 group by line_no)
 select m.line_no, case when f.pos is not null then greatest(f.pos, instr(m.raw_output, '{'))::int end stop_at from master_results m left join f using (line_no)"""


@query("stop_criterion", _SQL_STOP)
def _(spark, sf):
    """Length of each output up to its first balanced close, null while there is none."""
    return _runs(spark, sf).select("line_no", F.length(P.until_first_close("raw_output")).alias("stop_at"))


@query(
    "braces_slice_valid",
    r"""select line_no, length(regexp_extract(coalesce(raw_output,''),'(?s)\{.*\}',0)) slice_len from master_results""",
)
def _(spark, sf):
    return _runs(spark, sf).select("line_no", F.length(P.braces_slice(F.coalesce("raw_output", F.lit("")))).cast("long").alias("slice_len"))


@query(
    "clean_records",
    r"""select line_no, case when layer='exploratory' then 'raw' when len(validation_errors)=0 then 'golden' else 'rejected' end tier from master_results
 where parsed_json_valid and length(regexp_replace(coalesce(json_extract_string(parsed_json,'$.notes[0].free_text'),''),'\s','','g'))>0""",
)
def _(spark, sf):
    """Records with a usable first note text, and their tier."""
    rows = _runs(spark, sf).where("parsed_json_valid").select("line_no", "layer", "validation_errors", P.first_note(P.variant(F.col("parsed_json")), "free_text").alias("x"))
    tier = F.when(F.col("layer") == "exploratory", "raw").when(F.size("validation_errors") == 0, "golden").otherwise("rejected")
    return rows.where(F.length(F.regexp_replace(F.coalesce("x", F.lit("")), r"\s", "")) > 0).select("line_no", tier.alias("tier"))


def _norms(name: str, column, sql) -> None:
    parts = " union all ".join(f"select '{s}' dim, {sql(s.lower(), s)} label from flat_labels" for s in "TNM")

    @query(f"normalize_{name}", f"select dim, label, count(*) n from ({parts}) group by all")
    def _(spark, sf):
        rows = table(spark, sf, "flat_labels")
        pairs = F.array(*[F.struct(F.lit(s).alias("dim"), column(F.col(s.lower()), s).alias("label")) for s in "TNM"])
        return rows.select(F.explode(pairs).alias("x")).groupBy("x.dim", "x.label").agg(F.count("*").alias("n"))


_norms("a", L.norm_a, sql_a)
_norms("b", L.norm_b, sql_b)
_norms("c", L.norm_c, lambda x, p: sql_b(x, p, "|SN", ""))
_norms("d", L.norm_d, sql_d)

_GROUPS = " ".join(f"when t='{t}' and n='N{k}' then '{g}'" for t, gs in L.STAGE_RULE.items() for k, g in enumerate(gs))


@query(
    "stage_rule",
    f"""select t, n, m, case when m='M1' then 'IV' {_GROUPS} else 'Unknown' end stage_group, count(*) c from
 (select {", ".join(f"{sql_a(s.lower(), s)} {s.lower()}" for s in "TNM")} from flat_labels) group by all""",
)
def _(spark, sf):
    rows = table(spark, sf, "flat_labels").select(*[L.norm_a(F.col(s.lower()), s).alias(s.lower()) for s in "TNM"])
    return rows.groupBy("t", "n", "m").agg(F.count("*").alias("c")).withColumn("stage_group", L.stage_group(F.col("t"), F.col("n"), F.col("m")))


@query(
    "valid_ground_truth",
    """select split_name, count(*) n, count_if(not coalesce(contains(upper(t_target),'UNKNOWN'),false)) t_valid,
 count_if(not coalesce(contains(upper(n_target),'UNKNOWN'),false) and not coalesce(contains(upper(m_target),'UNKNOWN'),false)) nm_valid,
 case when count_if(not coalesce(contains(upper(n_target),'UNKNOWN'),false) and not coalesce(contains(upper(m_target),'UNKNOWN'),false)) < 0.3*count(*) then 'sparse_unknown' else 'reliable' end quality
 from train_split group by split_name""", big="t_valid nm_valid")
def _(spark, sf):
    known = lambda c: ~F.coalesce(F.contains(F.upper(c), F.lit("UNKNOWN")), F.lit(False))
    nm = known("n_target") & known("m_target")
    out = table(spark, sf, "train_split").groupBy("split_name").agg(F.count("*").alias("n"), F.count_if(known("t_target")).alias("t_valid"), F.count_if(nm).alias("nm_valid"))
    return out.withColumn("quality", F.when(F.col("nm_valid") < 0.3 * F.col("n"), "sparse_unknown").otherwise("reliable"))


@query("t_known_sample", "select split_id, t_target from train_split where not coalesce(contains(upper(t_target),'UNKNOWN'),false) order by md5(split_id||'|42'), split_id limit 100")
def _(spark, sf):
    """The capped sample of the second benchmark, by hash order."""
    rows = table(spark, sf, "train_split").where(~F.coalesce(F.contains(F.upper("t_target"), F.lit("UNKNOWN")), F.lit(False)))
    return split.sample_k(rows.select("split_id", "t_target"), "split_id", 100)


@query("layer_selector", f"select layer, model, count(*) n from master_results where parsed_json_valid and layer in ('controlled','longitudinal') and {SQL_NOTES} group by all")
def _(spark, sf):
    rows = _runs(spark, sf).where(F.col("parsed_json_valid") & F.col("layer").isin("controlled", "longitudinal"))
    return rows.where(P.has_first_note(P.variant(F.col("parsed_json")))).groupBy("layer", "model").agg(F.count("*").alias("n"))


# --- gates ----------------------------------------------------------------------------------------------------------

_PRESENT = " and ".join(f"coalesce({sql_note(f'staging.{f}')} not in ('','Unknown','unknown'),false)" for f in ("T", "N", "M", "stage_group"))


def _sql_label(f: str) -> str:
    return f"(case when json_type(note,'$.staging.{f}') is null then '' when json_type(note,'$.staging.{f}')='NULL' then 'NONE' else upper(json_extract_string(note,'$.staging.{f}')) end)"


SQL_GATES = f"""notes as (select line_no, unnest(json_extract(parsed_json,'$.notes[*]')) note, generate_subscripts(json_extract(parsed_json,'$.notes[*]'),1)-1 i from master_results where json_type(parsed_json,'$.notes')='ARRAY'),
 l as (select line_no, i, {_sql_label("T")} t, {_sql_label("N")} n, {_sql_label("M")} m, {_sql_label("stage_group")} g from notes),
 v as (select line_no, i, contains(m,'M1') and not contains(g,'IV') early, g, t<>'' and n<>'' and m<>'' and g='' bare from l),
 s as (select line_no, sum(early::int + bare::int) k from v group by line_no),
 gate as (select r.line_no, r.model, {_PRESENT} schema_ok, coalesce(len(snomed_codes),0)>0 ontology_ok, case when json_type(parsed_json,'$.notes') is null then 1 else coalesce(k,0) end::int violations from master_results r left join s using (line_no))"""
_SQL_LEVEL = "case when schema_ok and ontology_ok and violations=0 then 'C3_full' when schema_ok and ontology_ok then 'C2_schema_onto' when schema_ok then 'C1_schema' else 'C0_none' end"


def gated(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).select("line_no", "model", "snomed_codes", P.variant(F.col("parsed_json")).alias("v"))
    broken = gates.violations(F.col("v"))
    return rows.select("line_no", "model", gates.schema_ok(F.col("v")).alias("schema_ok"), gates.ontology_ok(F.col("snomed_codes")).alias("ontology_ok"), F.size(broken).alias("violations"))


@query("gate_eval", f"with {SQL_GATES} select line_no, model, schema_ok, ontology_ok, violations, {_SQL_LEVEL} gate_label from gate")
def gate_eval(spark, sf):
    return gated(spark, sf).withColumn("gate_label", gates.level(F.col("schema_ok"), F.col("ontology_ok"), F.col("violations") == 0))


@query("gate_levels", f"with {SQL_GATES} select model, {_SQL_LEVEL} gate_label, count(*) n, case {_SQL_LEVEL} when 'C3_full' then 'adapter_D_full_norag' when 'C2_schema_onto' then 'adapter_C_schema_onto' when 'C1_schema' then 'adapter_B_schema' else 'adapter_A_ungated' end adapter from gate group by all")
def _(spark, sf):
    return gate_eval(spark, sf).groupBy("model", "gate_label").agg(F.count("*").alias("n")).withColumn("adapter", gates.adapter(F.col("gate_label")))


@query("gate_decomposition", f"with {SQL_GATES} select model, count(*) total, count_if(schema_ok) c1, count_if(schema_ok and ontology_ok) c2, count_if(schema_ok and ontology_ok and violations=0) c3 from gate group by model", big="c1 c2 c3")
def _(spark, sf):
    """Runs that pass one gate after the other."""
    s, o, ok = F.col("schema_ok"), F.col("ontology_ok"), F.col("violations") == 0
    return gated(spark, sf).groupBy("model").agg(F.count("*").alias("total"), F.count_if(s).alias("c1"), F.count_if(s & o).alias("c2"), F.count_if(s & o & ok).alias("c3"))


@query(
    "logic_violations",
    f"""with {SQL_GATES} select line_no, 'visit_'||i||':M1_without_StageIV (group='''||g||''')' violation from v where early union all select line_no, 'visit_'||i||':missing_stage_group' from v where bare
 union all select line_no, 'missing_notes_key' from master_results where json_type(parsed_json,'$.notes') is null""",
)
def _(spark, sf):
    return _runs(spark, sf).select("line_no", F.explode(gates.violations(P.variant(F.col("parsed_json")))).alias("violation"))


@query("cardinality_check", "select line_no, coalesce(json_array_length(parsed_json,'$.notes'),0)::int found from master_results where layer='longitudinal' and parsed_json_valid and coalesce(json_array_length(parsed_json,'$.notes'),0)<>3")
def _(spark, sf):
    rows = _runs(spark, sf).where((F.col("layer") == "longitudinal") & F.col("parsed_json_valid")).select("line_no", P.variant(F.col("parsed_json")).alias("v"))
    return rows.where(gates.notes_missing(F.col("v"), 3)).select("line_no", F.coalesce(F.size(F.try_variant_get("v", "$.notes", "array<variant>")), F.lit(0)).alias("found"))


@query(
    "anchor_check",
    "select timeline_id, json_array_length(payload,'$.anchors')::int anchors, coalesce(json_array_length(payload,'$.timeline'),0)::int visits, json_array_length(payload,'$.anchors')=coalesce(json_array_length(payload,'$.timeline'),0) ok from timeline_results where json_array_length(payload,'$.anchors') is not null",
)
def _(spark, sf):
    v = P.variant(F.col("payload"))
    rows = table(spark, sf, "timeline_results").select("timeline_id", F.size(P.get(v, "$.anchors", "array<variant>")).alias("anchors"), F.coalesce(F.size(P.get(v, "$.timeline", "array<variant>")), F.lit(0)).alias("visits"))
    return rows.where(F.col("anchors") >= 0).withColumn("ok", F.col("anchors") == F.col("visits"))


# --- audit ----------------------------------------------------------------------------------------------------------

_FLOOR = "case dim when 't' then 1.109 when 'n' then 1.109 when 'm' then 0.554 else 0.0 end"
_LONG = " union all ".join(f"select model, '{d}' dim, {d} label from golden" for d in ("t", "n", "m", "stage_group"))


@query(
    "entropy_audit",
    f"""with {SQL_GOLDEN}, long as ({_LONG}), c as (select dim, label, model, count(*) n from long group by all), b as (select * from c union all select dim, label, 'ALL', sum(n) from c group by dim, label),
 e as ({sql_entropy("b", "dim, model")}) select *, {_FLOOR}::double as floor, entropy >= {_FLOOR} passed from e""",
)
def _(spark, sf):
    return audit.entropy_audit(golden(spark, sf), "model", ["t", "n", "m", "stage_group"])


@query("entropy_of_documents", f"with c as (select lang, count(*) n from documents where lang is not null group by lang), k as (select 1 one, * from c) select total, classes, entropy from ({sql_entropy('k', 'one')})")
def _(spark, sf):
    counts = audit.distribution(table(spark, sf, "documents").withColumn("one", F.lit(1)), ["one"], "lang")
    return audit.entropy(counts, ["one"]).drop("one")


@query("validity_rate", "select model, layer, count(parsed_json_valid) total, count_if(parsed_json_valid) valid, round_even(100.0*count_if(parsed_json_valid)/count(parsed_json_valid),1) pct from master_results where model is not null and layer is not null group by model, layer", big="valid")
def _(spark, sf):
    return audit.rate(_runs(spark, sf), ["model", "layer"], F.col("parsed_json_valid"))


@query("compliance_rate", f"with {SQL_PARAMS} select model, temperature, use_chat_template, strict_json, count(*) total, count_if(parsed_json_valid) valid, round_even(100.0*count_if(parsed_json_valid)/count(*),1) pct from p where model is not null group by all", big="valid")
def _(spark, sf):
    return audit.rate(_params(spark, sf), ["model", "temperature", "use_chat_template", "strict_json"], F.col("parsed_json_valid"))


@query("error_rate", "select model, count(*) total, count_if(len(validation_errors)>0) valid, round_even(100.0*count_if(len(validation_errors)>0)/count(*),1) pct from master_results where layer='longitudinal' and model is not null group by model", big="valid")
def _(spark, sf):
    return audit.rate(_runs(spark, sf).where(F.col("layer") == "longitudinal"), ["model"], F.size("validation_errors") > 0)


@query("label_distribution", f"with {SQL_GOLDEN}, long as ({_LONG}) select dim, label, count(*) n from long where label is not null group by all")
def _(spark, sf):
    rows = golden(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("label")) for d in ("t", "n", "m", "stage_group")])).alias("x")).select("x.*")
    return audit.distribution(rows, ["dim"], "label")


@query(
    "missing_scarce",
    f"with {SQL_GOLDEN}, e as (select unnest(['T1','T2','T3','T4']) label), c as (select t, count(*) n from golden group by t), z as (select count(t) total from golden) select label, coalesce(n,0) n, coalesce(n,0)=0 missing, coalesce(n,0)>0 and coalesce(n,0)<total/8.0 scarce from e left join c on t=label, z",
)
def _(spark, sf):
    return audit.missing_and_scarce(golden(spark, sf), "t", "T")


@query(
    "density_summary",
    f"""with d as (select model, layer, coalesce(len(snomed_codes),0) h, {sql_words("raw_output")} w from master_results where model is not null and layer is not null)
 select model, layer, round(avg(h),6) avg_terms, round(avg(w),6) avg_words, round(avg(100.0*h/greatest(w,1)),6) avg_density from d group by all""",
)
def _(spark, sf):
    return audit.density_summary(_runs(spark, sf), ["model", "layer"], F.coalesce(F.size("snomed_codes"), F.lit(0)), L.word_count(F.col("raw_output")))


@query(
    "density_by_flag",
    f"with d as (select parsed_json_valid flag, 100.0*coalesce(len(snomed_codes),0)/greatest({sql_words('raw_output')},1) d from master_results where parsed_json_valid is not null) select flag, round(avg(d),6) mean, round(median(d),6) median, count(*) n from d group by flag",
)
def _(spark, sf):
    d = L.density(L.word_count(F.col("raw_output")), F.coalesce(F.size("snomed_codes"), F.lit(0)))
    rows = _runs(spark, sf).where(F.col("parsed_json_valid").isNotNull()).select(F.col("parsed_json_valid").alias("flag"), d.alias("d"))
    return rows.groupBy("flag").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.median("d"), 6).alias("median"), F.count("*").alias("n"))


@query("crosstab_layer_valid", "select layer, count_if(parsed_json_valid)::bigint \"true\", count_if(not parsed_json_valid)::bigint \"false\" from master_results group by layer")
def _(spark, sf):
    return audit.crosstab(_runs(spark, sf), "layer", "parsed_json_valid", [True, False])


_MAJORITY = "with c as (select cancer_type, t_target, count(*) n from tcga_lung_gold where t_target is not null group by all)"


@query("majority_share", f"{_MAJORITY}, r as (select *, sum(n) over (partition by cancer_type) total, row_number() over (partition by cancer_type order by n desc, t_target) k from c) select cancer_type, total::bigint total, t_target majority, round_even(n/total,3) share from r where k=1")
def _(spark, sf):
    return audit.majority(table(spark, sf, "tcga_lung_gold"), ["cancer_type"], "t_target")


# --- statistics -----------------------------------------------------------------------------------------------------


@query("chi2_uniform", f"with x as (select model, {sql_note('demographics.sex')} sex from master_results where layer='exploratory' and parsed_json_valid and {SQL_NOTES}), c as (select model, sex, count(*) c from x where sex is not null group by all) select model, sum(c)::bigint n, count(*) k, round(count(*)*sum(c*c)/sum(c)-sum(c),6) chi2, count(*)-1 df from c group by model")
def chi2_uniform(spark, sf):
    return stats.chi2_uniform(exploratory(spark, sf), ["model"], "sex")


@query("chi2_uniform_p")
def _(spark, sf):
    """With p-values and the bias flag."""
    out = chi2_uniform(spark, sf).withColumn("p", F.round(stats.chi2_p(F.col("chi2"), F.col("df").cast("double")), 6))
    return out.withColumn("biased", F.col("p") < 0.05)


@query(
    "chi2_yates",
    f"""with {SQL_PARAMS}, q as (select model, count_if(strict_json and parsed_json_valid) a, count_if(strict_json and not parsed_json_valid) b, count_if(not strict_json and parsed_json_valid) c, count_if(not strict_json and not parsed_json_valid) d from p where layer='controlled' group by model),
 f as (select *, (a+b+c+d)::double s from q), e as (select *, (a+b)*(a+c)/s e1, (a+b)*(b+d)/s e2, (c+d)*(a+c)/s e3, (c+d)*(b+d)/s e4 from f),
 z as (select *, case when a+b>0 and c+d>0 and a+c>0 and b+d>0 then power(abs(a-e1)-least(0.5,abs(a-e1)),2)/e1+power(abs(b-e2)-least(0.5,abs(b-e2)),2)/e2+power(abs(c-e3)-least(0.5,abs(c-e3)),2)/e3+power(abs(d-e4)-least(0.5,abs(d-e4)),2)/e4 end x from e)
 select model, a, b, c, d, round(x,6) chi2, round(coalesce(sqrt(x/s),0),6) cramers_v from z""", big="a b c d")
def _(spark, sf):
    return stats.two_by_two(_params(spark, sf).where(F.col("layer") == "controlled"), ["model"], F.col("strict_json"), F.col("parsed_json_valid"))


@query("point_biserial", f"with {SQL_PRED} select split_name, count(*) n, round(corr(word_count::double, (coalesce(t_target=t_pred and n_target=n_pred and m_target=m_pred,false))::int::double),6) r from pr where word_count is not null group by split_name")
def point_biserial(spark, sf):
    return stats.point_biserial(predictions(spark, sf), ["split_name"], F.col("word_count"), metrics.all_three())


@query("point_biserial_p")
def _(spark, sf):
    out = point_biserial(spark, sf)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return out.withColumn("p", F.round(stats.t_p(t, (F.col("n") - 2).cast("double")), 6))


@query(
    "mann_whitney",
    f"""with x as (select word_count v, split_name='train_tier3_golden' g from train_split where word_count is not null), r as (select g, rank() over (order by v) + (count(*) over (partition by v)-1)/2.0 k from x), t as (select sum(power(c,3)-c) ties from (select count(*) c from x group by v)),
 a as (select sum(k) filter (g) r1, count_if(g)::double n1, count_if(not g)::double n2, count(*)::double n from r)
 select n1::bigint n1, n2::bigint n2, round(r1-n1*(n1+1)/2,3) u, round((r1-n1*(n1+1)/2-n1*n2/2)/sqrt(n1*n2/12*((n+1)-ties/(n*(n-1)))),6) z from a, t""",
)
def _(spark, sf):
    return stats.mann_whitney(table(spark, sf, "train_split"), F.col("word_count"), F.col("split_name") == "train_tier3_golden")


@query(
    "wilson_ci",
    f"""with {SQL_PRED}, s as (select model, count(*)::double n, count_if(t_target=t_pred)/count(*)::double p from pr where t_target is not null group by model)
 select model, n::bigint n, round(p,6) accuracy, round(greatest((p+1.96*1.96/(2*n))/(1+1.96*1.96/n)-1.96*sqrt(p*(1-p)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n),0),6) low,
 round(least((p+1.96*1.96/(2*n))/(1+1.96*1.96/n)+1.96*sqrt(p*(1-p)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n),1),6) high from s""",
)
def _(spark, sf):
    out = _hits(spark, sf)
    low, high = stats.wilson(F.col("ok"), F.col("n"))
    return out.select("model", "n", F.round(F.col("ok") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _hits(spark, sf):
    return predictions(spark, sf).where(F.col("t_target").isNotNull()).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("t_target") == F.col("t_pred")).alias("ok"))


@query("bootstrap_ci")
def _(spark, sf):
    out = _hits(spark, sf).withColumn("ci", stats.bootstrap_ci(F.col("ok").cast("double"), F.col("n").cast("double")))
    return out.select("model", "n", F.col("ci.low").alias("low"), F.col("ci.high").alias("high"))


# --- metrics --------------------------------------------------------------------------------------------------------

_STAGES = " union all ".join(
    f"select model, '{s}' stage, {s.lower()}_target target, {s.lower()}_pred pred from pr where {given}"
    for s, given in (("T", "not coalesce(contains(upper(t_target),'UNKNOWN'),false)"), *((x, "not coalesce(contains(upper(n_target),'UNKNOWN'),false) and not coalesce(contains(upper(m_target),'UNKNOWN'),false)") for x in "NM"))
)
_LABELS = f"""with {SQL_PRED}, st as ({_STAGES}), c as (select stage, target t, pred p, count(*) n from st where target is not null and pred is not null group by all),
 s as (select stage, t label, n support, 0 predicted, case when t=p then n else 0 end hits from c union all select stage, p, 0, n, 0 from c),
 l as (select stage, label, sum(support)::bigint support, sum(predicted)::bigint predicted, sum(hits)::bigint hits from s group by all),
 k as (select *, case when predicted>0 then hits/predicted else 0.0 end pr, case when support>0 then hits/support else 0.0 end rc from l),
 f as (select *, case when pr+rc>0 then 2*pr*rc/(pr+rc) else 0.0 end f1 from k)"""


def _confusion(spark, sf):
    return metrics.confusion(metrics.stages(predictions(spark, sf), ["model"]), ["stage"], "target", "pred")


@query("metrics_per_class", _LABELS + " select stage, label, support, predicted, hits, round(pr,6) \"precision\", round(rc,6) recall, round(f1,6) f1 from f")
def _(spark, sf):
    out = metrics.per_label(_confusion(spark, sf), ["stage"])
    return out.select("stage", "label", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_SCORES = """, g as (select stage, sum(support)::bigint n, sum(hits) ok, max(support) top, count(distinct case when support>0 and not contains(upper(label),'UNKNOWN') then label end) classes, avg(pr) mp, avg(rc) mr, avg(f1) mf, sum(f1*support) wf from f group by stage)"""


@query(
    "metrics_by_stage",
    _LABELS + _SCORES + """ select stage, n, round(ok/n,6) accuracy, round(top/n,6) constant_acc, case when classes>1 then round(mp,6) end macro_precision, case when classes>1 then round(mr,6) end macro_recall,
 case when classes>1 then round(mf,6) end macro_f1, case when classes>1 then round(wf/n,6) end weighted_f1, case when classes>1 then '' else 'single_class_gt' end note from g""",
)
def metrics_by_stage(spark, sf):
    return metrics.scores(_confusion(spark, sf), ["stage"])


@query("metrics_with_missing_stages")
def _(spark, sf):
    return metrics.with_missing_stages(metrics_by_stage(spark, sf), ["T", "N", "M"])


# --- joins, sets, splits --------------------------------------------------------------------------------------------


@query("checkpoint_antijoin", "select run_id, count(*) n from master_results where run_id not in (select run_id from train_split where run_id is not null) group by run_id")
def _(spark, sf):
    left = split.without_done(_runs(spark, sf).select("run_id"), table(spark, sf, "train_split"), "run_id")
    return left.groupBy("run_id").agg(F.count("*").alias("n"))


@query("membership_semijoin", "select model, count(*) n from master_results where line_no in (select line_no from flat_labels) group by model")
def _(spark, sf):
    return _runs(spark, sf).join(table(spark, sf, "flat_labels").select("line_no"), "line_no", "left_semi").groupBy("model").agg(F.count("*").alias("n"))


@query("distinct_on_first", "select run_id, min(line_no) line_no, arg_min(model, line_no) model from master_results group by run_id")
def _(spark, sf):
    return split.first_per_key(_runs(spark, sf).select("run_id", "line_no", "model"), ["run_id"], ["line_no"])


@query("unique_texts", "select split_name, count(free_text) total, count(distinct free_text) distinct_texts from train_split group by split_name")
def _(spark, sf):
    return table(spark, sf, "train_split").groupBy("split_name").agg(F.count("free_text").alias("total"), F.count_distinct("free_text").alias("distinct_texts"))


@query("union_all", "select 'flat' src, model, count(*) n from flat_labels group by model union all select 'split', model, count(*) from train_split group by model")
def _(spark, sf):
    both = table(spark, sf, "flat_labels").select(F.lit("flat").alias("src"), "model", "line_no").unionByName(table(spark, sf, "train_split").select(F.lit("split").alias("src"), "model", "split_id"), allowMissingColumns=True)
    return both.groupBy("src", "model").agg(F.count("*").alias("n"))


@query("class_difference", "select distinct upper(stage_group) label from flat_labels where stage_group is not null and upper(stage_group) not in (select stage_group from stage_ref)")
def _(spark, sf):
    seen = table(spark, sf, "flat_labels").where(F.col("stage_group").isNotNull()).select(F.upper("stage_group").alias("label")).distinct()
    return seen.join(F.broadcast(table(spark, sf, "stage_ref").select(F.col("stage_group").alias("label"))), "label", "left_anti")


_HITS = "h as (select line_no, unnest(snomed_codes) c, generate_subscripts(snomed_codes,1) k from master_results)"


def _codes(spark, sf):
    return _runs(spark, sf).select("line_no", F.posexplode("snomed_codes").alias("k", "c")).select("line_no", "k", "c.*")


@query("hit_dedup", f"with {_HITS} select line_no, c.snomed_id snomed_id, c.matched_text matched_text, min(k)-1 \"first\" from h group by all")
def _(spark, sf):
    return _codes(spark, sf).groupBy("line_no", "snomed_id", "matched_text").agg(F.min("k").cast("long").alias("first"))


@query("longest_match", f"with {_HITS}, r as (select line_no, c.snomed_id snomed_id, c.matched_text matched_text, row_number() over (partition by line_no, c.snomed_id order by length(c.matched_text) desc, k) z from h) select line_no, snomed_id, matched_text from r where z=1")
def _(spark, sf):
    hits = _codes(spark, sf).select(F.col("line_no").alias("row_id"), F.col("snomed_id").alias("concept_id"), "matched_text", F.col("k").alias("start_at"))
    return annotate.longest_per_concept(hits).select(F.col("row_id").alias("line_no"), F.col("concept_id").alias("snomed_id"), "matched_text")


_RANK = "r as (select split_id, t_target, n_target, m_target, row_number() over (order by md5(split_id||'|42'), split_id) k, count(*) over () n from train_split)"


@query("split_80_20", f"with {_RANK} select split_id, k::bigint rank, case when k<=floor(n*0.8) then 'train' else 'heldout' end split from r")
def _(spark, sf):
    return split.train_heldout(table(spark, sf, "train_split").select("split_id"), "split_id")


_MOVED = f"{_RANK}, d as (select a.split_id, a.t_target, a.n_target, a.m_target, b.t_target t_target_new, b.n_target n_target_new, b.m_target m_target_new from r a join r b on b.k = a.k % a.n + 1)"


@query("derangement", f"with {_MOVED} select * from d")
def derangement(spark, sf):
    return split.derangement(table(spark, sf, "train_split"), "split_id", ["t_target", "n_target", "m_target"])


@query("retained_triples", f"with {_MOVED} select count(*) n, count_if(t_target=t_target_new and n_target=n_target_new and m_target=m_target_new) retained from d", big="retained")
def _(spark, sf):
    same = [F.col(f"{s}_target") == F.col(f"{s}_target_new") for s in "tnm"]
    return derangement(spark, sf).agg(F.count("*").alias("n"), F.count_if(same[0] & same[1] & same[2]).alias("retained"))


@query("permutation_entropy", f"with {_MOVED}, a as (select 'before' side, t_target label, count(*) n from d where t_target is not null group by 2 union all select 'after', t_target_new, count(*) from d where t_target_new is not null group by 2) {sql_entropy('a', 'side')}")
def _(spark, sf):
    rows = derangement(spark, sf)
    both = rows.select(F.lit("before").alias("side"), F.col("t_target").alias("label")).unionByName(rows.select(F.lit("after").alias("side"), F.col("t_target_new").alias("label")))
    return audit.entropy(audit.distribution(both, ["side"], "label"), ["side"])


def _label_sides(spark, sf):
    rows = table(spark, sf, "tcga_lung_gold").where(F.col("case_submitter_id").isNotNull())
    sides = [rows.select("case_submitter_id", F.lower(f"{s}_label").alias(f"ajcc_pathologic_{s}"), *(["project_id"] if s == "t" else [])) for s in "tnm"]
    reports = rows.select(F.concat_ws(".", "case_submitter_id", F.lpad(F.col("gold_id").cast("string"), 12, "0")).alias("patient_filename"), F.col("free_text").alias("text"))
    return reports, prepare.label_table(*sides)


_NORM = ", ".join(f"{sql_d(f'min_{s.lower()}', s)} {s.lower()}_target" for s in "TNM")


@query(
    "gold_join",
    f"""with l as (select case_submitter_id, min(lower(t_label)) min_t, min(lower(n_label)) min_n, min(lower(m_label)) min_m from tcga_lung_gold where case_submitter_id is not null group by 1),
 r as (select case_submitter_id, arg_min(coalesce(free_text,''), gold_id) free_text from tcga_lung_gold where case_submitter_id is not null group by 1),
 g as (select case_submitter_id, free_text, {_NORM} from r join l using (case_submitter_id)) select case_submitter_id, length(free_text) chars, t_target, n_target, m_target from g where t_target in ('T1','T2','T3','T4') and n_target in ('N0','N1','N2','N3') and m_target in ('M0','M1')""",
)
def _(spark, sf):
    got = prepare.gold(*_label_sides(spark, sf))
    return got.select("case_submitter_id", F.length(F.coalesce("free_text", F.lit(""))).cast("long").alias("chars"), "t_target", "n_target", "m_target")


@query("lung_vs_cross", "select case when coalesce(project_id in ('TCGA-LUAD','TCGA-LUSC'),false) then 'lung' else 'cross' end cohort, replace(project_id,'TCGA-','') cancer_type, count(*) n from tcga_lung_gold group by all")
def _(spark, sf):
    rows = table(spark, sf, "tcga_lung_gold").select(F.when(prepare.is_lung(), "lung").otherwise("cross").alias("cohort"), L.cancer_type(F.col("project_id")).alias("cancer_type"))
    return rows.groupBy("cohort", "cancer_type").agg(F.count("*").alias("n"))


# --- vectors --------------------------------------------------------------------------------------------------------

_SIM = "s as (select q.vec_id query_id, c.vec_id vec_id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) sim from embeddings q, embeddings c where {})"


@query("topk_neighbors", f"with {_SIM.format('q.vec_id % 100 = 0')}, r as (select *, row_number() over (partition by query_id order by round(sim,9) desc, vec_id) k from s) select query_id, vec_id, round(sim,6) similarity, k::int rank from r where k<=3")
def _(spark, sf):
    corpus = table(spark, sf, "embeddings")
    hits = vector.top_k(corpus, corpus.where(F.col("vec_id") % 100 == 0), 3)
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("diversity", f"with {_SIM.format('q.vec_id <> c.vec_id')}, d as (select query_id, 1-max(sim) d from s group by 1) select count(*) n, round(avg(d),6) mean, round(stddev_pop(d),6) sd, round(quantile_cont(d,0.05),6) p5, round(quantile_cont(d,0.95),6) p95, round(min(d),6) least, min(d)<0.01 collapsed from d")
def _(spark, sf):
    return vector.diversity(vector.nearest_distance(table(spark, sf, "embeddings")))


# --- annotation -----------------------------------------------------------------------------------------------------


def _lexicon(spark, sf):
    codes = _runs(spark, sf).select(F.explode("snomed_codes").alias("c")).select(F.col("c.snomed_id").alias("concept_id"), F.col("c.pref_label").alias("label"))
    return codes.distinct().withColumn("term", F.lower("label"))


@query("annotate_lexicon")
def annotated(spark, sf):
    """Hits of the run log's concepts in all split texts; tested against brute force."""
    return annotate.annotate(table(spark, sf, "train_split"), "split_id", "free_text", _lexicon(spark, sf))


@query("annotate_first_location")
def _(spark, sf):
    return annotate.first_location(annotated(spark, sf))


@query(
    "ontology_block",
    "select line_no, md5(raw_output || case when coalesce(len(snomed_codes),0)>0 then '\n\n[Ontology Grounding]\n' || array_to_string(list_transform(snomed_codes, lambda c: '- '||c.pref_label||': '||c.snomed_id),'\n') else '' end) block from master_results",
)
def _(spark, sf):
    return _runs(spark, sf).select("line_no", F.md5(L.ontology_block(F.col("raw_output"), F.col("snomed_codes"))).alias("block"))


@query("lung_concepts", r"select histology_name label, count(*) n from flat_labels where regexp_matches(histology_name,'(?i)\b(lung|pulmon|bronch|adenocarcinoma|squamous|neoplasm|staging|carcinoma|metastasis)\b') group by 1")
def _(spark, sf):
    rows = table(spark, sf, "flat_labels").select(F.col("histology_name").alias("label"))
    return rows.where(L.lung_concept(F.col("label"))).groupBy("label").agg(F.count("*").alias("n"))


# --- plans and texts ------------------------------------------------------------------------------------------------


@query("grid_32", f"with g as (select i::int idx, 'T'||(1+i//8) t, 'N'||((i%8)//2) n, 'M'||(i%2) m from range(32) x(i)) select *, case when m='M1' then 'IV' {_GROUPS} else 'Unknown' end stage_group from g")
def _(spark, sf):
    return plans.grid(spark)


def _models(spark, sf):
    return _runs(spark, sf).where(F.col("model").isNotNull()).select("model").distinct()


_SQL_FACTORIAL = "select i::int idx, case when i&16=0 then 128 else 512 end max_length, case when i&8=0 then 0.3 else 1.0 end::double temperature, case when i&4=0 then 0.8 else 1.0 end::double top_p, case when i&2=0 then 10 else 100 end top_k from range(32) x(i)"
_SQL_OFAT = "select * from (values (0,128,0.7::double,0.95::double,50),(1,512,0.7,0.95,50),(2,256,0.3,0.95,50),(3,256,1.0,0.95,50),(4,256,0.7,0.8,50),(5,256,0.7,1.0,50),(6,256,0.7,0.95,10),(7,256,0.7,0.95,100),(8,256,0.7,0.95,50),(9,256,0.7,0.95,50)) v(idx,max_length,temperature,top_p,top_k)"


@query(
    "controlled_plan",
    f"""with m as (select distinct model from master_results where model is not null), d as (select 'ofat' f, * from ({_SQL_OFAT}) union all select 'factorial', * from ({_SQL_FACTORIAL}))
 select model, idx, model||'::controlled::'||f||'::'||idx run_key, 'T'||(1+idx//8) t, 'N'||((idx%8)//2) n, 'M'||(idx%2) m, max_length, temperature, top_p, top_k from m, d""",
)
def controlled_plan(spark, sf):
    models = _models(spark, sf)
    return plans.controlled(models, plans.one_factor_at_a_time(spark), "ofat").unionByName(plans.controlled(models, plans.full_factorial(spark), "factorial"))


@query("plan_counts", "with m as (select count(distinct model) k from master_results) select 'exploratory' layer, 5*k n from m union all select 'controlled', 42*k from m union all select 'longitudinal', 5*k from m union all select 'sweep', 42*6*k from m")
def _(spark, sf):
    models = _models(spark, sf)
    designs = plans.one_factor_at_a_time(spark).unionByName(plans.full_factorial(spark))
    made = {"exploratory": plans.exploratory(models), "controlled": controlled_plan(spark, sf), "longitudinal": plans.longitudinal(models), "sweep": plans.sweep(designs, models)}
    out = None
    for name, frame in made.items():
        row = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("run_prompts")
def _(spark, sf):
    """Seed case, context and chat markup of every controlled run."""
    runs = controlled_plan(spark, sf)
    case = plans.case_text(F.col("run_key"), F.col("t"), F.col("n"), F.col("m"))
    context = plans.keyword_context(F.col("t"), F.col("n"), F.col("m"))
    body = plans.prompt(F.lit(plans.template("zero_shot")), case, context)
    return runs.select("run_key", plans.chat(F.col("model"), F.lit(plans.SYSTEM), body).alias("prompt"))


@query(
    "training_text",
    """select split_id, md5('<|user|>
Read the note and answer with JSON of the form {"T": "..", "N": "..", "M": ".."}.

Note:
'||free_text||'

Answer:
<|assistant|>
{"T": "'||t_target||'", "N": "'||n_target||'", "M": "'||m_target||'"}') text from train_split where t_target is not null and n_target is not null and m_target is not null""",
)
def _(spark, sf):
    rows = table(spark, sf, "train_split").where(F.col("t_target").isNotNull() & F.col("n_target").isNotNull() & F.col("m_target").isNotNull())
    return rows.select("split_id", F.md5(plans.training_text(F.col("free_text"), *[F.col(f"{s}_target") for s in "tnm"])).alias("text"))


@query("word_counts", f"select split_id, {sql_words('free_text')}::int words from train_split")
def _(spark, sf):
    return table(spark, sf, "train_split").select("split_id", L.word_count(F.col("free_text")).alias("words"))


def _sql_line(x: str, *paths: str) -> str:
    parts = ", ".join(rf"regexp_replace(json_extract_string({x},'{p.replace("'", "").replace("[race/ethnicity]", '."race/ethnicity"')}'),'^\s+|\s+$','','g')" for p in paths)
    return f"array_to_string(list_filter([{parts}], lambda w: w is not null and w<>''),' ')"


def _sql_sections() -> str:
    out = []
    for path, columns in P.NOTE_SECTIONS:
        if path is None:
            out.append(f"[{_sql_line('o', *columns)}]")
        else:
            lead = _sql_line("o", "$.treatment.intent") if "treatment" in path else "''"
            items = f"case when json_type(o,'{path}')='ARRAY' then json_extract(o,'{path}[*]') else [] end"
            out.append(f"list_transform({items}, lambda x: case when json_type(x)='OBJECT' then array_to_string(list_filter([{lead}, {_sql_line('x', *columns)}], lambda w: w<>''),' ') end)")
    out.append(r"[case when json_type(o,'$.free_text')='VARCHAR' then regexp_replace(json_extract_string(o,'$.free_text'),'^\s+|\s+$','','g') end]")
    return " || ".join(out)


@query(
    "note_text",
    f"""with n as (select line_no, unnest(json_extract(parsed_json,'$.notes[*]')) o, generate_subscripts(json_extract(parsed_json,'$.notes[*]'),1) k from master_results where json_type(parsed_json,'$.notes')='ARRAY'),
 t as (select line_no, k, {_sql_sections()} l from n where json_type(o)='OBJECT'), g as (select line_no, flatten(list(l order by k)) l from t group by line_no)
 select r.line_no, md5(coalesce(array_to_string(list_filter(l, lambda w: w is not null and w<>''),chr(10)),'')) text from master_results r left join g using (line_no)""",
)
def _(spark, sf):
    """Payloads flattened to the text that is sent to an annotator."""
    return _runs(spark, sf).select("line_no", F.md5(F.coalesce(P.note_text(P.variant(F.col("parsed_json"))), F.lit(""))).alias("text"))


@query("timeline_text")
def _(spark, sf):
    return table(spark, sf, "timeline_results").select("timeline_id", P.timeline_text(P.variant(F.col("payload"))).alias("text"))


def _sql_known(f: str) -> str:
    at = f"$.notes[0].staging.{f}"
    return f"(case when json_type(parsed_json,'{at}') is null then 'UNKNOWN' when json_type(parsed_json,'{at}')='NULL' then 'NONE' else upper(json_extract_string(parsed_json,'{at}')) end)"


@query(
    "gated_records",
    f"""with {SQL_GATES} select r.line_no, {", ".join(f"{_sql_known(f)} {f.lower()}" for f in ("T", "N", "M", "stage_group"))}, length(coalesce(json_extract_string(parsed_json,'$.notes[0].free_text'),'')) chars,
 round(100.0*coalesce(len(snomed_codes),0)/greatest({sql_words("raw_output")},1),6) density, schema_ok, ontology_ok, violations=0 logic_ok, schema_ok and ontology_ok and violations=0 passed, {_SQL_LEVEL} gate_label from master_results r join gate using (line_no)""",
)
def _(spark, sf):
    """Records as they are stored after the gates: labels as given, density, gate flags and label."""
    rows = _runs(spark, sf).select("line_no", "snomed_codes", "raw_output", P.variant(F.col("parsed_json")).alias("v"))
    hits = F.coalesce(F.size("snomed_codes"), F.lit(0))
    made = rows.select(
        "line_no", *[P.label_or(F.col("v"), f"$.notes[0].staging.{f}").alias(f.lower()) for f in ("T", "N", "M", "stage_group")], F.length(F.coalesce(P.first_note(F.col("v"), "free_text"), F.lit(""))).cast("long").alias("chars"),
        F.round(L.density(L.word_count(F.col("raw_output")), hits), 6).alias("density"), gates.schema_ok(F.col("v")).alias("schema_ok"), gates.ontology_ok(F.col("snomed_codes")).alias("ontology_ok"), (F.size(gates.violations(F.col("v"))) == 0).alias("logic_ok"),
    )
    return made.withColumn("passed", F.col("schema_ok") & F.col("ontology_ok") & F.col("logic_ok")).withColumn("gate_label", gates.level(F.col("schema_ok"), F.col("ontology_ok"), F.col("logic_ok")))


@query(
    "extraction_parse",
    r"""with s as (select line_no, regexp_extract(coalesce(raw_output,''),'(?s)\{.*\}',0) j from master_results), w as (select line_no, j, json_valid(j) and not regexp_matches(j,',\s*[}\]]') ok from s), v as (select line_no, ok, case when ok then j end j from w)
 select line_no, ok parsed, coalesce(upper(json_extract_string(j,'$.notes[0].staging.T')),'UNKNOWN') t_pred from v""",
)
def _(spark, sf):
    """Predictions read from between the first and the last brace; what does not parse is unknown."""
    rows = _runs(spark, sf).select("line_no", P.strict_json(P.braces_slice(F.coalesce("raw_output", F.lit("")))).alias("j"))
    t = F.upper(P.first_note(P.variant(F.col("j")), "staging.T"))
    return rows.select("line_no", F.col("j").isNotNull().alias("parsed"), F.coalesce(t, F.lit("UNKNOWN")).alias("t_pred"))


# --- streaming ------------------------------------------------------------------------------------------------------


@query(
    "stream_label_counts",
    f"""with r as (select run_id, any_value(model) model, any_value(parsed_json) parsed_json from master_results where run_id is not null group by run_id), x as (select model, {", ".join(f"{sql_a(sql_note(f'staging.{s}'), s)} {s.lower()}" for s in "TNM")} from r),
 long as (select model, 't' dim, t label from x union all select model, 'n', n from x union all select model, 'm', m from x) select model, dim, label, count(*) n from long group by all""",
)
def _(spark, sf):
    """The run log read as a stream: deduplicated by run key, label counts in complete mode. The state holds each run key
    once, as a key may come again at any time; a log without end wants `dropDuplicatesWithinWatermark` on its time instead."""
    source = table(spark, sf, "master_results")
    # A streaming source wants a folder; a table kept as one file is picked out of its parent.
    single = any(f.endswith("/master_results.parquet") for f in source.inputFiles())
    reader = spark.readStream.schema(source.schema)
    stream = reader.option("pathGlobFilter", "master_results.parquet").parquet(sf) if single else reader.parquet(f"{sf}/master_results.parquet")
    rows = stream.where(F.col("run_id").isNotNull()).dropDuplicates(["run_id"]).select("model", P.variant(F.col("parsed_json")).alias("v"))
    long = rows.select("model", F.explode(F.array(*[F.struct(F.lit(s.lower()).alias("dim"), L.norm_a(P.first_note(F.col("v"), f"staging.{s}"), s).alias("label")) for s in "TNM"])).alias("x"))
    counts = long.select("model", "x.dim", "x.label").groupBy("model", "dim", "label").agg(F.count("*").alias("n"))
    # Results go to files in the shared folder, a folder per batch; the last one is the whole result (complete mode).
    out = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        done.append(number)

    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/{max(done)}") if done else spark.createDataFrame([], counts.schema)
