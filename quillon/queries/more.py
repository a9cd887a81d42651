"""Further registered queries: sources and sinks written and read back, run plans and prompts row by row, text functions,
warnings, combined metrics and p-values, each with its oracle."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions import labels as L
from quillon.functions import payload as P
from quillon.operators import audit, metrics, prepare, vector
from quillon.plans import runs as plans
from quillon.queries import reference as base
from quillon.queries.reference import query
from quillon.session import ensure_checkpoint_dir, table
from quillon.sources import io as sources


#: What `query` registers goes to the tables of the first module.
QUERIES, ORACLES = base.QUERIES, base.ORACLES


def _folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/exchange-{uuid.uuid4().hex}"


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query(
    "jsonl_roundtrip",
    """select layer, count(*) n, count_if(parsed_json_valid)::bigint valid, sum(length(raw_output))::bigint chars from master_results group by layer
 union all select '(broken line)', 3, 0, null""",
)
def _(spark, sf):
    """The run log appended as JSON lines, with blank and broken lines among them, and read by its schema."""
    path = _folder(spark)
    rows = table(spark, sf, "master_results").select("line_no", "layer", "parsed_json_valid", "raw_output")
    sources.append_jsonl(rows, path)
    spark.createDataFrame([('{"line_no": 1, "lay',), ("",), ("  ",), ("{",), ('"x": 2}',)], "value string").coalesce(1).write.mode("append").text(path)
    got = sources.jsonl(spark, path, rows.schema)
    layer = F.when(F.col("_corrupt_record").isNotNull(), "(broken line)").otherwise(F.col("layer"))
    return got.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"), F.count_if("parsed_json_valid").alias("valid"), F.sum(F.length("raw_output")).alias("chars"))


@query("jsonl_variant_roundtrip", "select model, count(*) n, sum(length(parsed_json))::bigint chars from master_results where parsed_json is not null group by model")
def _(spark, sf):
    """Parsed objects, a line each, read without a schema."""
    path = _folder(spark)
    sources.append_jsonl(table(spark, sf, "master_results").where("parsed_json is not null").select("model", "parsed_json"), path)
    got = sources.jsonl_variant(spark, path).select(P.get(F.col("v"), "$.model").alias("model"), F.length(P.get(F.col("v"), "$.parsed_json")).alias("chars"))
    return got.groupBy("model").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("missing_sources", "select 0::bigint jsonl, 0::bigint keys, 0::bigint records")
def _(spark, sf):
    """What is not there reads as empty."""
    path = _folder(spark)
    counts = [sources.jsonl(spark, path, table(spark, sf, "result_lines").schema).count(), sources.checkpoint_keys(spark, path).count(), sources.record_count(spark, path)]
    return spark.createDataFrame([counts], "jsonl long, keys long, records long")


@query("codes_export", "select c.snomed_id snomed_id, c.pref_label pref_label, count(*) n from (select unnest(snomed_codes) c from master_results) group by all")
def _(spark, sf):
    """Annotation codes, a line each instead of a file each, and read back."""
    path = _folder(spark)
    codes = table(spark, sf, "master_results").select("run_id", F.explode("snomed_codes").alias("c")).select("run_id", "c.snomed_id", "c.pref_label")
    sources.append_jsonl(codes, path)
    return sources.jsonl(spark, path, codes.schema).groupBy("snomed_id", "pref_label").agg(F.count("*").alias("n"))


@query("checkpoint_roundtrip", "select count(distinct run_id) keys, count(run_id) + 2 records from master_results where layer = 'controlled'")
def _(spark, sf):
    """Run keys appended to a checkpoint in two goes, with blank lines, and read as a set."""
    path = _folder(spark)
    rows = table(spark, sf, "master_results").where("layer = 'controlled' and run_id is not null")
    sources.append_keys(rows.where("parsed_json_valid"), "run_id", path)
    sources.append_keys(rows.where("not coalesce(parsed_json_valid, false)"), "run_id", path)
    first = rows.agg(F.min("run_id")).first()[0]
    spark.createDataFrame([(f"  {first} ",), ("",), ("   ",), (first,)], "value string").coalesce(1).write.mode("append").text(path)
    return sources.checkpoint_keys(spark, path).agg(F.count("*").alias("keys")).withColumn("records", F.lit(sources.record_count(spark, path)).cast("long"))


@query("csv_roundtrip", "select histology_name label, count(*) n from flat_labels where histology_name is not null and histology_name <> '' group by 1")
def _(spark, sf):
    """A report with typed labels as one CSV file, group key first, and read back."""
    path = _folder(spark)
    report = table(spark, sf, "flat_labels").where("histology_name <> ''").groupBy(F.col("histology_name").alias("label")).agg(F.count("*").alias("n"))
    sources.export_csv(report.select("n", "label"), path, lead=["label"])
    return sources.csv(spark, path, "label string, n long")


@query("results_append", "select split_name, count(*) n, sum(word_count)::bigint words from train_split group by split_name")
def _(spark, sf):
    """Result rows appended to a CSV store with headers, split by split."""
    path = _folder(spark)
    rows = table(spark, sf, "train_split").select("split_id", "split_name", "word_count")
    for part in (F.col("split_name") == "train_tier3_golden", ~F.coalesce(F.col("split_name") == "train_tier3_golden", F.lit(False))):
        rows.where(part).write.mode("append").csv(path, header=True, escape='"')
    return sources.csv(spark, path, "split_id long, split_name string, word_count int").groupBy("split_name").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))


@query("zipped_csv_roundtrip", "select ref_code, histology_name, short_form from histology_ref")
def _(spark, sf):
    """The list of histologies (of fixed size) as a CSV member of an archive, read on the workers."""
    folder, box = _folder(spark), io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("readme.txt", "no table")
        z.writestr("list.csv", table(spark, sf, "histology_ref").select("ref_code", "histology_name", "short_form").toPandas().to_csv(index=False))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/list.zip")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(box.getvalue()))
    stream.close()
    return sources.zipped_csv(spark, f"{folder}/list.zip", ["ref_code", "histology_name", "short_form"])


@query("line_store", "select row_number() over (order by line_no) - 1 as line_no, trim(coalesce(model, '')) || '/' || line_no as text from master_results")
def _(spark, sf):
    """A line-aligned store: numbers follow the lines of the one file."""
    path = _folder(spark)
    rows = table(spark, sf, "master_results").select("line_no", F.concat(F.lit("  "), F.coalesce("model", F.lit("")), F.lit("/"), F.col("line_no"), F.lit(" ")).alias("value"))
    rows.orderBy("line_no").select("value").coalesce(1).write.text(path)
    return sources.line_store(spark, path)


@query("cohort_export", "select case when coalesce(project_id in ('TCGA-LUAD','TCGA-LUSC'),false) then 'lung' else 'cross' end cohort, count(*) n, count(t_label) labelled from tcga_lung_gold group by 1")
def _(spark, sf):
    """Two cohorts written as partitions and read back."""
    path = _folder(spark)
    sources.export_cohorts(table(spark, sf, "tcga_lung_gold").select("gold_id", "project_id", "t_label"), path, prepare.is_lung())
    return spark.read.parquet(path).groupBy("cohort").agg(F.count("*").alias("n"), F.count("t_label").alias("labelled"))


@query("model_boundary", "select line_no, case when raw_output is null then '' else upper(raw_output[:1]) end answer, raw_output is null failed from master_results")
def _(spark, sf):
    """An external function over every run; batches that fail say so."""

    def answer(prompts: list) -> list[str]:
        return [p[:1].upper() for p in prompts]

    rows = table(spark, sf, "master_results").select(F.col("line_no").cast("string").alias("id"), "raw_output")
    got = sources.map_model(rows, "id", "raw_output", answer, at_once=1)
    return got.select(F.col("row_id").cast("long").alias("line_no"), F.col("raw_output").alias("answer"), F.col("error").isNotNull().alias("failed"))


# --- run plans and prompts ------------------------------------------------------------------------------------------


def _sql_hash(*parts: str) -> str:
    return f"('0x'||substr(md5({"||'|'||".join(parts)}),1,7))::bigint"


def _sql_choice(key: str, salt: str, values: tuple) -> str:
    return f"([{', '.join(map(q, values))}])[{_sql_hash(key, q(salt))} % {len(values)} + 1]"


def _sql_phrase(column: str, texts: dict[str, str]) -> str:
    return f"(case {column} {' '.join(f'when {q(k)} then {q(v)}' for k, v in texts.items())} end)"


_CASE = (
    f"'A '||({plans.AGES[0]} + {_sql_hash('run_key', q('age'))} % {plans.AGES[1] - plans.AGES[0] + 1})||'-year-old '||{_sql_choice('run_key', 'group', plans.GROUPS)}||' '||{_sql_choice('run_key', 'sex', plans.SEXES)}"
    f"||' patient with '||{_sql_choice('run_key', 'histology', plans.HISTOLOGIES)}||': '||{_sql_phrase('t', plans.SIZE_TEXT)}||', '||{_sql_phrase('n', plans.NODE_TEXT)}||', '||{_sql_phrase('m', plans.SPREAD_TEXT)}||'.'"
)
_CONTEXT = f"'Staging facts: '||t||' means '||{_sql_phrase('t', plans.SIZE_TEXT)}||'; '||n||' means '||{_sql_phrase('n', plans.NODE_TEXT)}||'; '||m||' means '||{_sql_phrase('m', plans.SPREAD_TEXT)}||'.'"
_MODELS = "m as (select distinct model from master_results where model is not null)"
_CELLS = "'T'||(1+cell//8) t, 'N'||((cell%8)//2) n, 'M'||(cell%2) m"


def _sql_chat(system: str, body: str) -> str:
    return (
        f"case when contains(lower(model),'llama') then '<|system|>'||chr(10)||{q(system)}||chr(10)||'<|user|>'||chr(10)||{body}||chr(10)||'<|assistant|>'||chr(10)"
        f" when contains(lower(model),'mistral') then '[INST] '||{q(system)}||chr(10)||{body}||' [/INST]' else {q(system)}||chr(10)||chr(10)||{body} end"
    )


@query("exploratory_plan", f"with {_MODELS}, r as (select model, i idx, {_sql_hash('i', q('cell'))} % 32 cell from m, range(5) x(i)) select model, idx, idx + 42 seed, model||'::exploratory::'||idx run_key, {_CELLS} from r")
def _(spark, sf):
    return plans.exploratory(base._models(spark, sf))


@query("longitudinal_plan", f"with {_MODELS}, r as (select model, i idx from m, range(5) x(i)) select model, idx, idx + 100 seed, 0.4::double temperature, model||'::longitudinal::'||idx run_key, '0,6,12' as months from r")
def _(spark, sf):
    rows = plans.longitudinal(base._models(spark, sf))
    return rows.select("model", "idx", "seed", F.col("temperature").cast("double").alias("temperature"), "run_key", F.array_join(F.transform("months", lambda x: x.cast("string")), ",").alias("months"))


_DESIGNS = f"d as (select 'ofat' f, * from ({base._SQL_OFAT}) union all select 'factorial', * from ({base._SQL_FACTORIAL}))"
_MODE_ROWS = " union all ".join(f"select {q(mode)} \"mode\", {q(plans.template(mode))} template" for mode in plans.MODES)


@query(
    "sweep_prompts",
    f"""with {_MODELS}, {_DESIGNS}, o as ({_MODE_ROWS}), r as (select model, f, idx, "mode", template, idx cell, max_length, temperature from m, d, o),
 k as (select *, model||'::sweep::'||f||'::'||"mode"||'::'||idx run_key, {_CELLS} from r), p as (select *, replace(template, '{{case}}', {_CASE}) body from k)
 select run_key, model, "mode", idx, max_length, temperature, md5({_sql_chat(plans.SYSTEM, "body")}) prompt from p""",
)
def _(spark, sf):
    """Every design row in every mode for every model, with its finished prompt."""
    designs = plans.one_factor_at_a_time(spark).withColumn("f", F.lit("ofat")).unionByName(plans.full_factorial(spark).withColumn("f", F.lit("factorial")))
    rows = plans.sweep(designs, base._models(spark, sf))
    keyed = rows.withColumn("run_key", plans.run_key(F.col("model"), "sweep", F.col("f"), F.col("mode"), F.col("idx")))
    cells = keyed.select("*", *[L.cell(F.col("idx"), s).alias(s.lower()) for s in "TNM"])
    body = plans.prompt(F.col("template"), plans.case_text(F.col("run_key"), F.col("t"), F.col("n"), F.col("m")))
    return cells.select("run_key", "model", "mode", "idx", "max_length", "temperature", F.md5(plans.chat(F.col("model"), F.lit(plans.SYSTEM), body)).alias("prompt"))


@query("timeline_prompts", f"select timeline_id, md5({q(plans.timeline_prompt(()))}||coalesce(array_to_string(list_transform(json_extract_string(payload,'$.anchors[*]'), lambda a: '- '||a), chr(10)), '')) prompt from timeline_results")
def _(spark, sf):
    """The timeline prompt for the anchors of each stored timeline."""
    anchors = F.coalesce(P.get(P.variant(F.col("payload")), "$.anchors", "array<string>"), F.array().cast("array<string>"))
    return table(spark, sf, "timeline_results").select("timeline_id", F.md5(plans.timeline_prompt_of(anchors)).alias("prompt"))


ORACLES["run_prompts"] = f"with c as ({ORACLES['controlled_plan']}), b as (select *, 'Context:'||chr(10)||{_CONTEXT}||chr(10)||chr(10)||replace({q(plans.template('zero_shot'))}, '{{case}}', {_CASE}) body from c) select run_key, {_sql_chat(plans.SYSTEM, 'body')} prompt from b"


# --- anchors and warnings -------------------------------------------------------------------------------------------

_ANCHORS = f"[{', '.join(map(q, plans.ANCHORS))}]"


@query("anchor_echo", f"select timeline_id, n_anchors, json_extract_string(payload,'$.anchors[*]') = {_ANCHORS}[1:n_anchors] echoed from timeline_results where payload is not null")
def anchor_echo(spark, sf):
    """Whether the anchors asked for came back, all of them and in order."""
    got = P.get(P.variant(F.col("payload")), "$.anchors", "array<string>")
    rows = table(spark, sf, "timeline_results").where("payload is not null")
    asked = F.slice(F.array(*map(F.lit, plans.ANCHORS)), F.lit(1), F.col("n_anchors"))
    return rows.select("timeline_id", "n_anchors", F.coalesce(got == asked, F.lit(False)).alias("echoed"))


@query(
    "warnings",
    f"""with a as (select timeline_id, n_anchors, json_extract_string(payload,'$.anchors[*]') = {_ANCHORS}[1:n_anchors] ok, coalesce(json_array_length(payload,'$.timeline'),0) visits from timeline_results where payload is not null)
 select 'timeline_results' src, timeline_id rec_id, 'anchors' kind, 'anchors differ from those asked for' message from a where not ok
 union all select 'timeline_results', timeline_id, 'visits', 'expected '||n_anchors||' visits, got '||visits from a where visits <> n_anchors
 union all select 'master_results', line_no, 'notes', 'expected 3 notes, got '||coalesce(json_array_length(parsed_json,'$.notes'),0) from master_results where layer='longitudinal' and parsed_json_valid and coalesce(json_array_length(parsed_json,'$.notes'),0)<>3""",
)
def _(spark, sf):
    """Everything a session would have logged as a warning, a row each."""
    visits = F.coalesce(F.size(P.get(P.variant(F.col("payload")), "$.timeline", "array<variant>")), F.lit(0))
    lines = table(spark, sf, "timeline_results").where("payload is not null").select("timeline_id", visits.alias("visits")).join(anchor_echo(spark, sf), "timeline_id")
    row = lambda df, src, key, kind, text: df.select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), F.lit(kind).alias("kind"), text.alias("message"))
    notes = QUERIES["cardinality_check"](spark, sf)
    out = row(lines.where("not echoed"), "timeline_results", "timeline_id", "anchors", F.lit("anchors differ from those asked for"))
    out = out.unionByName(row(lines.where("visits <> n_anchors"), "timeline_results", "timeline_id", "visits", F.concat(F.lit("expected "), F.col("n_anchors"), F.lit(" visits, got "), F.col("visits"))))
    return out.unionByName(row(notes, "master_results", "line_no", "notes", F.concat(F.lit("expected 3 notes, got "), F.col("found"))))


# --- text functions -------------------------------------------------------------------------------------------------

_SEXES = {"m": "male", "f": "female", "man": "male", "woman": "female"}


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x},'^\s+|\s+$','','g')"


@query(
    "label_texts",
    f"""select line_no, replace(lower(replace(histology_name,' ','_')),'/','_') slug, array_to_string(list_filter([{', '.join(_sql_strip(c) for c in 'tnm')}], lambda p: p is not null and p <> ''),' ') joined,
 coalesce(case lower({_sql_strip('sex')}) {' '.join(f'when {q(k)} then {q(v)}' for k, v in _SEXES.items())} end, {_sql_strip('sex')}) sex from flat_labels""",
)
def _(spark, sf):
    """Slug, joined labels and canonical sex of every typed record."""
    return table(spark, sf, "flat_labels").select("line_no", L.slug(F.col("histology_name")).alias("slug"), L.join_filled(F.array("t", "n", "m")).alias("joined"), L.alias(F.col("sex"), _SEXES).alias("sex"))


@query("file_keys", "select gold_id, split_part(case_submitter_id||'.'||gold_id||'.txt','.',1) patient, replace(project_id,'TCGA-','') cancer from tcga_lung_gold")
def _(spark, sf):
    name = F.concat_ws(".", "case_submitter_id", F.col("gold_id").cast("string"), F.lit("txt"))
    return table(spark, sf, "tcga_lung_gold").select("gold_id", F.when(F.col("case_submitter_id").isNotNull(), L.patient_key(name)).alias("patient"), L.cancer_type(F.col("project_id")).alias("cancer"))


@query("concept_iris", "select c.snomed_id tail, count(*) n from (select unnest(snomed_codes) c from master_results) group by 1")
def _(spark, sf):
    """Concept ids taken back from their addresses."""
    iris = table(spark, sf, "master_results").select(F.explode("snomed_codes").alias("c")).select(F.concat(F.lit("http://example.org/ontology/SNOMEDCT/"), F.col("c.snomed_id")).alias("iri"))
    return iris.groupBy(L.iri_tail(F.col("iri")).alias("tail")).agg(F.count("*").alias("n"))


@query("flags_and_budgets", "select timeline_id, greatest(n_anchors,1)*260+350 visit_budget, greatest(n_anchors,1)*320+250 note_budget from timeline_results")
def _(spark, sf):
    return table(spark, sf, "timeline_results").select("timeline_id", L.token_budget(F.col("n_anchors"), 260, 350).alias("visit_budget"), L.token_budget(F.col("n_anchors")).alias("note_budget"))


@query("strict_flags", "select line_no, coalesce(lower(json_extract_string(params,'$.strict_json')) in ('true','1','yes'), true) strict from master_results")
def _(spark, sf):
    return table(spark, sf, "master_results").select("line_no", L.truthy(F.get_json_object("params", "$.strict_json")).alias("strict"))


# --- aggregates, metrics, statistics --------------------------------------------------------------------------------


@query(
    "density_by_rag",
    f"with d as (select coalesce(try_cast(json_extract_string(params,'$.rag_used') as boolean), false) flag, 100.0*coalesce(len(snomed_codes),0)/greatest({base.sql_words('raw_output')},1) d from master_results) select flag, round(avg(d),6) mean, round(median(d),6) median, count(*) n from d group by flag",
)
def _(spark, sf):
    """Term density by whether retrieval was used; a run that does not say so counts as without."""
    d = L.density(L.word_count(F.col("raw_output")), F.coalesce(F.size("snomed_codes"), F.lit(0)))
    rows = table(spark, sf, "master_results").select(P.get(P.variant(F.col("params")), "$.rag_used", "boolean").alias("rag_used"), d.alias("density"))
    return audit.density_by(rows, "rag_used", "density")


def _keyed(sql: str) -> str:
    """The per-stage metrics SQL with model and data set as further keys."""
    keys = "model, split_name, stage"
    return (
        sql.replace(base._STAGES, base._STAGES.replace("select model,", "select model, split_name,"))
        .replace("select stage, target t", f"select {keys}, target t").replace("select stage, t label", f"select {keys}, t label").replace("union all select stage, p", f"union all select {keys}, p")
        .replace("select stage, label, sum(support)", f"select {keys}, label, sum(support)").replace("g as (select stage,", f"g as (select {keys},").replace("from f group by stage)", f"from f group by {keys})")
    )


@query("metrics_by_model_and_dataset", _keyed(base._LABELS + base._SCORES) + " select model, split_name, stage, n, round(ok/n,6) accuracy, round(top/n,6) constant_acc, case when classes>1 then round(mf,6) end macro_f1 from g")
def _(spark, sf):
    """All models on all data sets in one grouped result."""
    keys = ["model", "split_name", "stage"]
    counts = metrics.confusion(metrics.stages(base.predictions(spark, sf), keys[:2]), keys, "target", "pred")
    return metrics.scores(counts, keys).select(*keys, "n", "accuracy", "constant_acc", "macro_f1")


ORACLES["metrics_with_missing_stages"] = (
    f"with found as ({ORACLES['metrics_by_stage']}) select e.stage, coalesce(n,0)::bigint n, accuracy, constant_acc, macro_precision, macro_recall, macro_f1, weighted_f1, case when n is null then 'no_valid_gt' else note end note"
    " from (select unnest(['T','N','M']) stage) e left join found on found.stage = e.stage"
)


def _simpson(f: str, top: str, panels: int = 4000) -> str:
    """The integral of f (an expression in u) from 0 to `top`."""
    u = f.replace("u_", f"(({top})*i/{panels})")
    return f"(({top})/{3 * panels}*list_sum(list_transform(range(0,{panels + 1}), lambda i: (case when i in (0,{panels}) then 1 when i%2=1 then 4 else 2 end)*{u})))"


_GAMMA = _simpson("2*power(u_,df-1)*exp(-u_*u_)/exp(lgamma(df/2.0))", "sqrt(chi2/2)")
ORACLES["chi2_uniform_p"] = f"with c as ({ORACLES['chi2_uniform']}), p as (select *, case when df > 0 then round(1-{_GAMMA},6) end p from c) select *, p < 0.05 biased from p"
_STUDENT = _simpson("exp(lgamma((n-1)/2.0)-lgamma((n-2)/2.0))/sqrt(pi()*(n-2))*power(1+u_*u_/(n-2),-(n-1)/2.0)", "t")
ORACLES["point_biserial_p"] = f"with c as ({ORACLES['point_biserial']}), s as (select *, abs(r)*sqrt((n-2)/(1-r*r)) t from c) select split_name, n, r, round(1-2*{_STUDENT},6) p from s"
ORACLES["bootstrap_ci"] = f"""with {base.SQL_PRED}, s as (select model, count(*) n, count_if(t_target=t_pred)/count(*)::double p from pr where t_target is not null group by model),
 k as (select *, unnest(range(0,n+1)) k from s), c as (select *, sum(exp(lgamma(n+1)-lgamma(k+1)-lgamma(n-k+1)+case when k=0 then 0 else k*ln(p) end+case when k=n then 0 else (n-k)*ln(1-p) end)) over (partition by model order by k) c from k where p>0 and p<1),
 b as (select model, min(k) filter (c>=0.025) low, min(k) filter (c>=0.975) high from c group by model)
 select model, n, case when p<=0 then 0 when p>=1 then 1 else low/n::double end low, case when p<=0 then 0 when p>=1 then 1 else high/n::double end high from s left join b using (model)"""


@query(
    "neighbour_texts",
    f"with t as ({ORACLES['topk_neighbors']}) select query_id, md5(string_agg(d.text, chr(10)||chr(10) order by t.rank)) context from t join documents d on d.doc_id = t.vec_id where d.text is not null group by query_id",
)
def _(spark, sf):
    """Texts of the nearest documents of every hundredth document, best first."""
    corpus = table(spark, sf, "embeddings")
    hits = vector.top_k(corpus, corpus.where(F.col("vec_id") % 100 == 0), 3)
    texts = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("vec_id"), "text")
    return vector.texts_of(hits, texts).select("query_id", F.md5("context").alias("context"))
