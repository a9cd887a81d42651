"""Generated work: label grids, run plans, prompts and training text, as DataFrames built by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.labels import STAGE_RULE, cell, completion, stage_group

SEXES, AGES = ("male", "female"), (45, 80)
HISTOLOGIES = ("adenocarcinoma", "squamous cell carcinoma", "large cell carcinoma", "small cell carcinoma")
GROUPS = ("White", "Black", "Asian", "Hispanic", "other")
SIZE_TEXT = {"T1": "a tumor of up to 3 cm", "T2": "a tumor between 3 and 5 cm", "T3": "a tumor between 5 and 7 cm", "T4": "a tumor over 7 cm"}
NODE_TEXT = {"N0": "no involved nodes", "N1": "hilar nodes on the same side", "N2": "mediastinal nodes on the same side", "N3": "nodes on the other side"}
SPREAD_TEXT = {"M0": "no distant spread", "M1": "distant spread"}
DESIGN = T.StructType(
    [T.StructField("max_length", T.IntegerType()), T.StructField("temperature", T.DoubleType()), T.StructField("top_p", T.DoubleType()), T.StructField("top_k", T.IntegerType()), T.StructField("do_sample", T.BooleanType())]
)


def grid(spark: SparkSession) -> DataFrame:
    """The 32 cells with their stage group, M fastest."""
    rows = spark.range(32).select(F.col("id").cast("int").alias("idx"), *[cell(F.col("id"), s).alias(s.lower()) for s in "TNM"])
    return rows.withColumn("stage_group", stage_group(F.col("t"), F.col("n"), F.col("m")))


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """A design matrix from CSV; both spellings of booleans and CRLF line ends are understood."""
    return spark.read.csv(path, header=True, schema=DESIGN)


# Low and high level of each factor, and the centre they leave one at a time.
LEVELS = {"max_length": (128, 512), "temperature": (0.3, 1.0), "top_p": (0.8, 1.0), "top_k": (10, 100), "do_sample": (True, False)}
CENTRE = {"max_length": 256, "temperature": 0.7, "top_p": 0.95, "top_k": 50, "do_sample": True}


def full_factorial(spark: SparkSession) -> DataFrame:
    """All combinations of the levels (idx from 0), the last factor fastest."""
    rows = spark.range(2 ** len(LEVELS)).select(F.col("id").cast("int").alias("idx"))
    bits = {name: 2 ** k for k, name in enumerate(reversed(LEVELS))}
    return rows.select("idx", *[F.when(F.col("idx").bitwiseAND(bits[n]) == 0, F.lit(low)).otherwise(F.lit(high)).alias(n) for n, (low, high) in LEVELS.items()])


def one_factor_at_a_time(spark: SparkSession) -> DataFrame:
    """Each numeric factor at its low and high level with the others at the centre, then the centre with and without sampling."""
    settings = [CENTRE | {n: level} for n, levels in LEVELS.items() if n != "do_sample" for level in levels] + [CENTRE | {"do_sample": x} for x in LEVELS["do_sample"]]
    return spark.createDataFrame([(k, *s.values()) for k, s in enumerate(settings)], "idx int, max_length int, temperature double, top_p double, top_k int, do_sample boolean")


def hashed(*parts: Column) -> Column:
    """A number under 2**28 that the parts fix, in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("long")


def choice(key: Column, salt: str, values: tuple) -> Column:
    """One of the values, fixed by the key."""
    return F.element_at(F.array(*map(F.lit, values)), (hashed(key, F.lit(salt)) % len(values) + 1).cast("int"))


def phrase(label: Column, texts: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[label]


def case_text(key: Column, t: Column, n: Column, m: Column) -> Column:
    """A seed case for a cell; age, sex, histology and group are fixed by the run key."""
    age = AGES[0] + hashed(key, F.lit("age")) % (AGES[1] - AGES[0] + 1)
    return F.format_string(
        "A %d-year-old %s %s patient with %s: %s, %s, %s.", age, choice(key, "group", GROUPS), choice(key, "sex", SEXES), choice(key, "histology", HISTOLOGIES),
        phrase(t, SIZE_TEXT), phrase(n, NODE_TEXT), phrase(m, SPREAD_TEXT),
    )


def run_key(model: Column, layer: str, *more: Column) -> Column:
    return F.concat_ws("::", model, F.lit(layer), *[x.cast("string") for x in more])


def exploratory(models: DataFrame, runs: int = 5, seed: int = 42) -> DataFrame:
    rows = models.crossJoin(models.sparkSession.range(runs).withColumnRenamed("id", "idx"))
    at = hashed(F.col("idx"), F.lit("cell")) % 32
    return rows.select("model", "idx", (F.col("idx") + seed).alias("seed"), run_key(F.col("model"), "exploratory", F.col("idx")).alias("run_key"), *[cell(at, s).alias(s.lower()) for s in "TNM"])


def controlled(models: DataFrame, design: DataFrame, name: str) -> DataFrame:
    """One run per design row and model, cells in turn; missing settings get 1000, 0.7, 0.9, 50. `design` has idx."""
    rows = models.crossJoin(F.broadcast(design))
    return rows.select(
        "model", "idx", run_key(F.col("model"), "controlled", F.lit(name), F.col("idx")).alias("run_key"), *[cell(F.col("idx"), s).alias(s.lower()) for s in "TNM"],
        F.coalesce("max_length", F.lit(1000)).alias("max_length"), F.coalesce("temperature", F.lit(0.7)).alias("temperature"), F.coalesce("top_p", F.lit(0.9)).alias("top_p"), F.coalesce("top_k", F.lit(50)).alias("top_k"),
    )


def longitudinal(models: DataFrame, runs: int = 5, seed: int = 100) -> DataFrame:
    rows = models.crossJoin(models.sparkSession.range(runs).withColumnRenamed("id", "idx"))
    months = F.array(*[F.lit(m) for m in (0, 6, 12)])
    return rows.select("model", "idx", (F.col("idx") + seed).alias("seed"), F.lit(0.4).alias("temperature"), run_key(F.col("model"), "longitudinal", F.col("idx")).alias("run_key"), months.alias("months"))


SYSTEM = "You write clinical notes."
#: What is wrapped around a task by the kind of answer; `{task}` is the task.
WRAPPERS = {
    "json": "{task}\n\nAnswer with one JSON object with the key notes and nothing else.",
    "text": "{task}\n\nAnswer in plain prose, without JSON.",
    "timeline": "{task}\n\nAnswer with one JSON object with the keys seed_case, anchors and timeline: one visit for each anchor, in the order given, and the anchors as given.",
}
#: Prompt modes as (wrapper, task, cells of the examples); `{case}` is the seed case, `{examples}` the examples.
MODES = {
    "zero_shot": ("json", "Write a clinical note for this case. {case}", ()),
    "one_shot": ("json", "Here is one example.\n{examples}\nWrite a note of that form for this case. {case}", (9,)),
    "few_shot": ("json", "Here are some examples.\n{examples}\nWrite a note of that form for this case. {case}", (0, 13, 30)),
    "terminology": ("json", "Use standard terms only. Write a clinical note for this case. {case}", ()),
    "bias_check": ("text", "Describe the patient without assumptions. {case}", ()),
    "step_by_step": ("json", "Think through the staging step by step before you write the note. {case}", ()),
}
# The anchors of a timeline, in order.
ANCHORS = ("t0:Diagnosis/Start", "t1:First-line therapy", "t2:Restaging scan", "t3:Maintenance/Adjuvant", "t4:Surveillance/Follow-up")


def example(idx: int) -> str:
    """A short note for a cell of the grid, with its stage group by the rule."""
    t, n, m = f"T{1 + idx // 8}", f"N{idx % 8 // 2}", f"M{idx % 2}"
    group = "IV" if m == "M1" else STAGE_RULE[t][int(n[1])]
    return f'{{"notes": [{{"staging": {{"T": "{t}", "N": "{n}", "M": "{m}", "stage_group": "{group}"}}, "free_text": "Imaging shows {SIZE_TEXT[t]} with {NODE_TEXT[n]} and {SPREAD_TEXT[m]}."}}]}}'


def template(mode: str) -> str:
    """The finished template of a mode, in which only the case is open."""
    wrapper, task, cells = MODES[mode]
    return WRAPPERS[wrapper].replace("{task}", task.replace("{examples}", "\n".join(map(example, cells))))


def timeline_prompt(anchors: tuple[str, ...] = ANCHORS) -> str:
    """The prompt for a timeline of an invented patient with a visit at every anchor."""
    task = "Write the course of an invented lung cancer patient."
    return WRAPPERS["timeline"].replace("{task}", task) + "\nAnchors:\n" + "\n".join(f"- {a}" for a in anchors)


def timeline_prompt_of(anchors: Column) -> Column:
    """The same for a column with lists of anchors."""
    return F.concat(F.lit(timeline_prompt(())), F.array_join(F.transform(anchors, lambda a: F.concat(F.lit("- "), a)), "\n"))


def sweep(designs: DataFrame, models: DataFrame, modes: tuple[str, ...] = tuple(MODES)) -> DataFrame:
    """Design rows by modes by models."""
    names = designs.sparkSession.createDataFrame([(m, template(m)) for m in modes], "mode string, template string")
    return designs.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(models))


def prompt(template: Column, case: Column, context: Column | None = None) -> Column:
    """The case in its template, behind the retrieved context if there is any."""
    body = F.replace(template, F.lit("{case}"), case)
    if context is None:
        return body
    return F.when(F.length(F.coalesce(context, F.lit(""))) > 0, F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), body)).otherwise(body)


def keyword_context(t: Column, n: Column, m: Column) -> Column:
    """Context without a retriever, from the labels alone."""
    return F.format_string("Staging facts: %s means %s; %s means %s; %s means %s.", t, phrase(t, SIZE_TEXT), n, phrase(n, NODE_TEXT), m, phrase(m, SPREAD_TEXT))


def chat(model: Column, system: Column, user: Column) -> Column:
    """Markup by model family; plain text for others."""
    family = F.lower(model)
    return (
        F.when(family.contains("llama"), F.concat(F.lit("<|system|>\n"), system, F.lit("\n<|user|>\n"), user, F.lit("\n<|assistant|>\n")))
        .when(family.contains("mistral"), F.concat(F.lit("[INST] "), system, F.lit("\n"), user, F.lit(" [/INST]")))
        .otherwise(F.concat(system, F.lit("\n\n"), user))
    )


def extraction_prompt(note: Column) -> Column:
    return F.concat(F.lit('Read the note and answer with JSON of the form {"T": "..", "N": "..", "M": ".."}.\n\nNote:\n'), note, F.lit("\n\nAnswer:"))


def training_text(note: Column, t: Column, n: Column, m: Column) -> Column:
    """Prompt and expected answer as one text."""
    return F.concat(F.lit("<|user|>\n"), extraction_prompt(note), F.lit("\n<|assistant|>\n"), completion(t, n, m))
