import random
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import annotate, audit, metrics, prepare, rejects, shred, split, stats, vector
from quillon.plans import runs as plans
from quillon.sources import io
from quillon.streaming import ingest

UUID = "0aa1b2c3-0000-4000-8000-00000000000a"


def record(**change):
    good = {"run": UUID, "ts": "2025-01-06T00:03:24.608161", "layer": "controlled", "model": "m", "prompt": "p", "valid": "True", "errors": '"[""e""]"', "raw": '"a, ""b""\nc"'}
    return ",".join((good | change).values())


@pytest.mark.parametrize(
    "line, reason",
    [
        (record(), None), (record() + "\r", None), (record(raw=""), None), (record(valid="FALSE"), None), (record(model=""), None), (record(errors="[]"), None),
        (record(raw='"open'), "quoting"), (record(raw='"x"y'), "quoting"), (record(model='a"b'), "quoting"), (record(errors='"[]" '), "quoting"),
        (record() + ",", "column_count"), (record() + ",x", "column_count"), ("a,b", "column_count"), (record(raw='"open') + ",x,y", "quoting"),
        (record(run="run-1"), "bad_value"), (record(run=UUID.upper()), "bad_value"), (record(ts="2025-02-30T00:00:00"), "bad_value"), (record(ts="2025-01-06 00:00:00"), "bad_value"), (record(ts=""), "bad_value"),
        (record(layer="other"), "bad_value"), (record(valid="yes"), "bad_value"), (record(valid=""), "bad_value"), (record(errors="[1]"), "bad_value"), (record(errors="x"), "bad_value"), (record(errors=""), "bad_value"),
    ],
)
def test_rejects_one_record(spark, line, reason):
    got = rejects.load_records(spark.createDataFrame([(1, line, "clash")], "line_id long, line string, reason string")).collect()
    assert [r["reason"] for r in got] == [reason]
    if reason is None and '"a,' in line:
        assert got[0]["raw_output"] == 'a, "b"\nc' and got[0]["validation_errors"] == ([] if ",[]," in line else ["e"]) and got[0]["parsed_json_valid"] in (True, False)


def test_rejects_keep_every_character_and_name_the_error(spark):
    good = "00000000-0000-4000-8000-000000000000,2024-01-02T03:04:05,controlled,m,p,true,[],"
    raws = ["\ue00a\ue00d\ue000", "\"a\nb\r\nc\ue001\"", "x\x00y", ""]
    lines = [(k, good + r) for k, r in enumerate(raws)]
    lines += [(10, good + "a,b"), (11, "x,y"), (12, good.replace("05,", "65,")), (13, good.replace("0000-4", "000-4")), (14, good.replace("[]", "[1]")), (15, good + '"a" b'), (16, good.replace("true", "yes"))]
    got = {r["line_id"]: r for r in rejects.load_records(spark.createDataFrame(lines, "line_id long, line string").coalesce(1)).collect()}
    assert [got[k]["raw_output"] for k in range(4)] == ["\ue00a\ue00d\ue000", "a\nb\r\nc\ue001", "x\x00y", ""]
    assert {k: (got[k]["reason"], got[k]["detail"]) for k in range(10, 17)} == {
        10: ("column_count", "TOO MANY COLUMNS"), 11: ("column_count", "MISSING COLUMNS"), 12: ("bad_value", "CAST timestamp"), 13: ("bad_value", "CAST run_id"),
        14: ("bad_value", "validation_errors"), 15: ("quoting", "grammar"), 16: ("bad_value", "parsed_json_valid"),
    }


def test_rejects_blank_null_empty_and_neighbours(spark):
    lines = [(1, None), (2, ""), (3, " \t\r"), (4, record(raw='"open')), (5, record()), (5, record()), (6, record(raw="x" * 3_000_000))]
    got = sorted((r["line_id"], r["reason"]) for r in rejects.load_records(spark.createDataFrame(lines, "line_id long, line string").coalesce(1)).collect())
    assert got == sorted([(4, "quoting"), (5, None), (5, None), (6, None)], key=str) or got == [(4, "quoting"), (5, None), (5, None), (6, None)]
    assert rejects.load_records(spark.createDataFrame([], "line_id long, line string")).count() == 0


def shredded(spark, docs, repeated=()):
    df = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d), 0) for i, d in enumerate(docs)], "id long, doc string, pos int")
    plan = shred.plan_relations(shred.schema_graph(df, "doc"), repeated)
    return plan, shred.shred(df, "id", "doc", plan)


def test_shred_links_and_inlines(spark):
    docs = [
        {"a": {"b": 1, "c": {"d": "x"}}, "items": [{"n": 1, "subs": [{"k": 1}, 5, {"k": 2}]}, None, {"n": 2}]}, {"items": {"n": 9, "subs": "[{\"k\": 3}]"}}, None, "", "no", [1], {"items": "[{\"n\": 7}]"},
    ]
    plan, rows = shredded(spark, docs)
    got = {(r.rec_id, r.relation, tuple(r.pos)): dict(r.fields) for r in rows.collect()}
    assert got[0, "root", ()] == {"a.b": "1", "a.c.d": "x"}
    assert got[0, "items", (2,)] == {"n": "2"} and (0, "items", (1,)) not in got
    assert got[0, "items.subs", (0, 2)] == {"k": "2"} and got[1, "items.subs", (0, 0)] == {"k": "3"} and got[6, "items", (0,)] == {"n": "7"}
    assert {k[0] for k in got} == {0, 1, 6}
    flat = shred.relation(rows, "items.subs", {"k": "k"}).collect()
    assert {(r.rec_id, tuple(r.parent_key), tuple(r.key), r.k) for r in flat} == {(0, (0,), (0, 0), "1"), (0, (0,), (0, 2), "2"), (1, (0,), (0, 0), "3")}


def test_shred_recursion_and_sharing(spark):
    tree = {"part": {"id": 1, "part": {"id": 2, "part": {"id": 3}}}, "x": {"addr": {"city": "a"}}, "y": {"addr": {"city": "b"}}}
    plan, rows = shredded(spark, [tree])
    got = [(r.relation, tuple(r.pos), r.fields.get("id") or r.fields.get("city")) for r in rows.collect() if r.relation != "root"]
    assert sorted(got) == sorted([("part", (0,), "1"), ("part", (0, 0), "2"), ("part", (0, 0, 0), "3"), ("addr", (0,), "a"), ("addr", (0,), "b")])


def test_shred_refuses_keys_that_are_data(spark):
    df = spark.createDataFrame([(json.dumps({f"k{i}": {"a": 1} for i in range(60)}),)], "doc string")
    with pytest.raises(ValueError):
        shred.plan_relations(shred.schema_graph(df, "doc"), max_paths=20)


def test_split_sizes_and_order(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    got = split.train_heldout(df, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 82, "heldout": 21}
    again = split.train_heldout(df.repartition(7), "k")
    assert sorted(map(tuple, split.train_heldout(df, "k").collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64])
def test_derangement(spark, n):
    df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("string").alias("t"))
    got = split.derangement(df, "k", ["t"]).collect()
    assert len(got) == n and sorted(r["t"] for r in got) == sorted(r["t_new"] for r in got)
    assert n < 2 or all(r["t"] != r["t_new"] for r in got)


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None), (None, 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in split.first_per_key(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", None), (None, "z")}


def test_entropy(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 4 + [(None,)], "x string").withColumn("one", F.lit(1))
    got = audit.entropy(audit.distribution(df, ["one"], "x"), ["one"]).first()
    assert got["entropy"] == round(math.log(2), 6) and got["total"] == 8
    with pytest.raises(ValueError):
        audit.abort_below_floor(spark.createDataFrame([("t", False)], "dim string, passed boolean"))


def test_metrics_hand_case(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), (None, "a")], "t string, p string")
    got = metrics.scores(metrics.confusion(df, [], "t", "p"), []).first()
    # labels a, b, c: precision 1, 1/2, 0; recall 1/2, 1/2, 0; f1 2/3, 1/2, 0
    assert got["n"] == 4 and got["accuracy"] == 0.5 and got["macro_precision"] == 0.5 and got["macro_f1"] == round((2 / 3 + 1 / 2) / 3, 6)
    one = metrics.scores(metrics.confusion(spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string"), [], "t", "p"), []).first()
    assert one["note"] == "single_class_gt" and one["macro_f1"] is None


def test_mann_whitney_against_ranks(spark):
    rng = np.random.default_rng(0)
    v, g = rng.integers(0, 30, 300), rng.random(300) < 0.4
    df = spark.createDataFrame(pd.DataFrame({"v": v, "g": g}))
    rank = pd.Series(v).rank()
    u = rank[g].sum() - g.sum() * (g.sum() + 1) / 2
    assert stats.mann_whitney(df, F.col("v"), F.col("g")).first()["u"] == u


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    got = vector.top_k(df, df.where("vec_id % 20 = 0"), 4, block=4)
    for q, part in got.toPandas().groupby("query_id"):
        assert part.sort_values("rank")["vec_id"].tolist() == np.argsort(-sim[q])[:4].tolist()


def test_annotate_whole_words_and_longest(spark):
    lexicon = spark.createDataFrame([("1", "Pain", "pain"), ("2", "Bone pain", "bone pain"), ("3", "n", "12")], "concept_id string, label string, term string")
    docs = spark.createDataFrame([(1, "Bone pain and PAIN; painful 12"), (2, ""), (3, None)], "id long, text string")
    hits = annotate.annotate(docs, "id", "text", lexicon)
    assert {(r.concept_id, r.matched_text, r.start_at) for r in hits.collect()} == {("2", "Bone pain", 0), ("1", "PAIN", 14)}
    assert annotate.annotate(docs, "id", "text", lexicon.limit(0)).count() == 0


def test_gold_reduces_duplicates(spark):
    reports = spark.createDataFrame([("c1.b", "second"), ("c1.a", "first"), ("c2.a", "x"), ("c3.a", "y")], "patient_filename string, text string")
    t = spark.createDataFrame([("c1", "TCGA-LUAD", "T2a"), ("c1", "TCGA-LUAD", "T2a"), ("c2", "TCGA-BRCA", "TX"), ("c3", "TCGA-BRCA", "T1")], "case_submitter_id string, project_id string, ajcc_pathologic_t string")
    n = spark.createDataFrame([("c1", "N0"), ("c1", "N0"), ("c3", "N1")], "case_submitter_id string, ajcc_pathologic_n string")
    m = spark.createDataFrame([("c1", "M0"), ("c3", "M0")], "case_submitter_id string, ajcc_pathologic_m string")
    got = prepare.gold(reports, prepare.label_table(t, n, m)).orderBy("case_submitter_id").collect()
    assert [(r.case_submitter_id, r.free_text, r.t_target, r.cancer_type) for r in got] == [("c1", "first", "T2", "LUAD"), ("c3", "y", "T1", "BRCA")]


def test_plans(spark):
    cells = plans.grid(spark).collect()
    assert len({(r.t, r.n, r.m) for r in cells}) == 32 and [r.m for r in cells[:2]] == ["M0", "M1"]


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "a.jsonl").write_text('{"run_id": "1"}\n\n{"run_id": \n{"run_id": "2"}\n')
    got = io.jsonl(spark, str(tmp_path / "a.jsonl"), spark.createDataFrame([], "run_id string").schema).collect()
    assert sorted((r.run_id or "") for r in got) == ["", "1", "2"] and sum(r._corrupt_record is not None for r in got) == 1
    assert io.jsonl(spark, str(tmp_path / "none"), spark.createDataFrame([], "run_id string").schema).count() == 0
    assert io.jsonl_variant(spark, str(tmp_path / "a.jsonl")).where("v is not null").count() == 2
    (tmp_path / "s.txt").write_text("x\n\n y \n")
    assert [tuple(r) for r in io.line_store(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()] == [(0, "x"), (1, ""), (2, "y")]
    assert {r.run_key for r in io.checkpoint_keys(spark, str(tmp_path / "s.txt")).collect()} == {"x", "y"} and io.record_count(spark, str(tmp_path / "s.txt")) == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("r.csv", 'patient_filename,text\nc1.a,"x\ny"\n')
    assert [tuple(r) for r in io.zipped_csv(spark, str(tmp_path / "z.zip"), ["patient_filename", "text"]).collect()] == [("c1.a", "x\ny")]
    (tmp_path / "d.csv").write_text("max_length,temperature,top_p,top_k,do_sample\r\n128,0.3,0.8,10,TRUE\r\n256,1.0,0.8,10,False\r\n")
    assert [r.do_sample for r in plans.read_design(spark, str(tmp_path / "d.csv")).orderBy("max_length").collect()] == [True, False]
    frame = spark.createDataFrame([("k", 'a "q"\nb')], "k string, t string")
    io.export_csv(frame, str(tmp_path / "out"), ["k"])
    assert io.csv(spark, str(tmp_path / "out"), "k string, t string").first()["t"] == 'a "q"\nb'
    io.append_jsonl(frame, str(tmp_path / "j"))
    io.append_jsonl(frame, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert io.map_model(frame, "k", "t", lambda xs: [x.upper() for x in xs]).first()["raw_output"].startswith("A ")


def test_stream_adds_each_run_once(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "table", "ck"))
    run = lambda i: json.dumps({"run_id": i, "layer": "controlled", "model": "m", "parsed_json": {"notes": [{"staging": {"T": "T1", "N": "N0", "M": "M0"}}]}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text(f"{run('a')}\n\n{run('b')}\nbroken\n")
    ingest.append_new(spark, folder, out, ck).awaitTermination()
    (tmp_path / "in" / "2.jsonl").write_text(f"{run('b')}\n{run('c')}\n{run('c')}\n")
    ingest.append_new(spark, folder, out, ck).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r.run_id for r in rows.collect()) == ["a", "b", "c"]
    batch = ingest.label_counts(spark.read.text(folder))
    assert {(r.dim, r.label, r.n) for r in batch.collect()} == {("t", "T1", 3), ("n", "N0", 3), ("m", "M0", 3)}


def test_designs(spark):
    full = plans.full_factorial(spark).orderBy("idx").collect()
    assert len({tuple(r)[1:] for r in full}) == 32 and tuple(full[0]) == (0, 128, 0.3, 0.8, 10, True) and tuple(full[1]) == (1, 128, 0.3, 0.8, 10, False) and tuple(full[31]) == (31, 512, 1.0, 1.0, 100, False)
    one = plans.one_factor_at_a_time(spark).orderBy("idx").collect()
    assert len(one) == 10 and tuple(one[3])[1:] == (256, 1.0, 0.95, 50, True) and tuple(one[9])[1:] == (256, 0.7, 0.95, 50, False)


def test_annotate_in_parts_equals_annotate_at_once(spark):
    rng = random.Random(3)
    words = ["ab", "cd ef", "ef", "abc", "x1", "cd", "12", "ß a", "longer term here", "term"]
    lexicon = spark.createDataFrame([(f"c{k % 7}", w.upper(), f" {w} ") for k, w in enumerate(words)] + [("c9", "AB", "ab")], "concept_id string, label string, term string")
    texts = [" ".join(rng.choice([*words, "zz", "Cd", "ABC,", "e"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, " "])] + [(None, "ab")], "id long, text string")
    once, parts = (sorted(map(tuple, annotate.annotate(df, "id", "text", lexicon, limit=n, block=7).collect())) for n in (64 << 20, 100))
    assert once == parts and len(once) > 100


def test_bootstrap_interval_of_many_rows_takes_few_steps(spark):
    got = spark.range(1).select(stats.bootstrap_ci(F.lit(6e8), F.lit(1e9)).alias("x")).first()["x"]
    half = 1.959964 * (0.24 / 1e9) ** 0.5
    assert abs(got["low"] - (0.6 - half)) < 1e-8 and abs(got["high"] - (0.6 + half)) < 1e-8


def test_density_by_a_flag_that_may_be_null_or_missing(spark):
    df = spark.createDataFrame([(True, 1.0), (None, 2.0), (False, 4.0)], "rag_used boolean, d double")
    assert sorted(map(tuple, audit.density_by(df, "rag_used", "d").collect())) == [(False, 3.0, 3.0, 2), (True, 1.0, 1.0, 1)]
    assert audit.density_by(df, "rag_grounded", "d").count() == 0
