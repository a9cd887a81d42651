import json
import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import labels as L
from quillon.functions import payload as P
from quillon.operators import gates, stats

EDGE = ["pT1", "cN2", "T2a", "3", "T12", "Tis", "TX", "ypT2", "T5", "CIS", "", "nan", "None", " \tT3\n", None]


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column.alias("y")).collect()]


def test_norm_a(spark):
    u = "TUNKNOWN"
    assert values(spark, EDGE, L.norm_a(F.col("x"), "T")) == ["T1", u, "T2", "T3", "T1", "TIS", "TX", u, u, "TIS", u, u, u, "T3", u]


def test_norm_b_and_c(spark):
    b = values(spark, EDGE, L.norm_b(F.col("x"), "T"))
    assert b[:4] == ["TPT1", "TCN2", "T2", "T3"] and b[4] == "T12" and b[10:13] == ["UNKNOWN"] * 3 and b[14] == "UNKNOWN"
    assert values(spark, ["nan", "TSN"], L.norm_c(F.col("x"), "T")) == ["TNAN", "TSN"]


def test_norm_d(spark):
    assert values(spark, ["t2", "Tis", "2", "TX", None, "pT1"], L.norm_d(F.col("x"), "T")) == ["T2", "TIS", None, "TX", None, None]


def test_small_text_functions(spark):
    assert values(spark, ["a b", " a\t b ", "", None], L.word_count(F.col("x"))) == [2, 2, 0, 0]
    assert values(spark, ["http://x/y/12", "", None], L.iri_tail(F.col("x"))) == ["12", "", ""]
    assert values(spark, ["TRUE", "yes", "0", None], L.truthy(F.col("x"))) == [True, True, False, True]
    assert values(spark, ["A B/c"], L.slug(F.col("x"))) == ["a_b_c"]
    assert values(spark, ["x"], L.join_filled(F.array(F.lit(" a "), F.lit(""), F.lit(None).cast("string"), F.lit("b")))) == ["a b"]
    assert values(spark, [" GPT ", "Z"], L.alias(F.col("x"), {"gpt": "g"})) == ["g", "Z"]


@pytest.mark.parametrize(
    "text, valid, value",
    [
        ('{"a": 1}', True, {"a": 1}), ('see {"a": 1} and', True, {"a": 1}), ('{"a": 1} {"b": 2}', True, {"b": 2}), ('{"a": 1} {"b": }', True, {"a": 1}),
        ('{"a": 1', False, None), ('say "{ {"a": 1}', False, None), ('{"a": "}"}x', True, {"a": "}"}), ("[1]", True, [1]), ("12", True, 12), ("null", True, None),
        ('{"a": 1, "a": 2}', True, {"a": 2}), ("", False, None), (None, False, None), ('{"a": "q\\"}"} z', True, {"a": 'q"}'}),
    ],
)
def test_salvage(text, valid, value):
    assert P.parse(text) == (valid, value)


def test_salvage_column(spark):
    got = values(spark, ['{"a": NaN}', "no", 'x {"a": "é"}'], P.canonical_json("x"))
    assert got == ['{"a": null}', None, '{"a": "é"}']


def test_first_close_counts_escapes_everywhere_and_stray_closes(spark):
    texts = ['} {"a":', r'say \"hi {"a": 1} x', r'\{ {"a": 1} x', '{"a": "}"', "}", None, "", r'{"a": "\"}"} x', "x} y {"]
    assert values(spark, texts, P.until_first_close("x")) == ["} {", r'say \"hi {"a": 1}', r'\{ {"a": 1}', None, None, None, None, r'{"a": "\"}"}', "x} y {"]


def test_salvage_counts_escapes_outside_quotes():
    assert P.parse(r'say \"hi {"a": 1}') == (True, {"a": 1})
    assert P.parse(r'say "hi {"a": 1}') == (False, None)
    assert P.parse(r'\{"a": 1} {"b": 2}') == (True, {"b": 2})
    assert P.parse('} {"a": 1}') == (True, {"a": 1})


def test_first_close(spark):
    assert values(spark, ['a {"b": {"c": "}"}} more', "none", "{ open"], P.until_first_close("x")) == ['a {"b": {"c": "}"}}', None, None]


def note(**staging):
    return {"staging": staging}


FULL = {"T": "T1", "N": "N0", "M": "M0", "stage_group": "IA"}


@pytest.mark.parametrize(
    "payload, ok, broken",
    [
        ({"notes": [note(**FULL)]}, True, []), ({"notes": [note(**(FULL | {"M": "M1"}))]}, True, ["visit_0:M1_without_StageIV (group='IA')"]), ({"notes": [note(**(FULL | {"M": "M1", "stage_group": "IVA"}))]}, True, []),
        ({"notes": [note(**(FULL | {"T": "Unknown"}))]}, False, []), ({"notes": [note(**(FULL | {"T": "UNKNOWN"}))]}, True, []), ({"notes": [note(**(FULL | {"T": 0}))]}, True, []),
        ({"notes": [note(T="T1", N="N0", M="M0")]}, False, ["visit_0:missing_stage_group"]), ({"notes": [note(T="T1", N="N0", M="M0", stage_group=None)]}, False, []), ({"notes": []}, False, []), ({}, False, ["missing_notes_key"]),
        ({"notes": [note(**FULL), note(T="T1", N="N0", M="M1a", stage_group="IIIA")]}, True, ["visit_1:M1_without_StageIV (group='IIIA')"]), ({"notes": ["x"]}, False, []), ({"notes": note(**FULL)}, False, []),
    ],
)
def test_gates(spark, payload, ok, broken):
    rows = spark.createDataFrame([(json.dumps(payload),)], "x string").select(P.variant(F.col("x")).alias("v"))
    got = rows.select(gates.schema_ok(F.col("v")), gates.violations(F.col("v"))).first()
    assert (got[0], got[1]) == (ok, broken)


def test_gate_level_truth_table(spark):
    rows = spark.range(8).select(*[(F.col("id").bitwiseAND(b) > 0).alias(n) for b, n in ((1, "s"), (2, "o"), (4, "l"))])
    got = {(r.s, r.o, r.l): r.g for r in rows.withColumn("g", gates.level(F.col("s"), F.col("o"), F.col("l"))).collect()}
    assert got[True, True, True] == "C3_full" and got[True, True, False] == "C2_schema_onto" and got[True, False, True] == "C1_schema" and got[False, True, True] == "C0_none"


def test_yates_and_p_values(spark):
    one = spark.range(1)
    assert round(one.select(stats.yates(*[F.lit(float(x)) for x in (10, 20, 20, 10)])).first()[0], 6) == 5.4
    assert one.select(stats.yates(*[F.lit(float(x)) for x in (0, 0, 2, 1)])).first()[0] is None
    assert math.isclose(one.select(stats.chi2_p(F.lit(3.841459), F.lit(1.0))).first()[0], 0.05, rel_tol=1e-5)
    assert math.isclose(one.select(stats.t_p(F.lit(2.228139), F.lit(10.0))).first()[0], 0.05, rel_tol=1e-5)
    assert one.select(stats.chi2_p(F.lit(0.0), F.lit(0.0))).first()[0] is None


def test_intervals(spark):
    one = spark.range(1)
    low, high = stats.wilson(F.lit(0.0), F.lit(0.0))
    assert one.select(low, high).first() == (None, None)
    low, high = one.select(stats.bootstrap_ci(F.lit(50.0), F.lit(100.0)).alias("c")).select("c.*").first()
    assert (low, high) == (0.4, 0.6)


def test_timeline_text(spark):
    payload = {"seed_case": {"staging": {"T": "T1"}}, "timeline": [{"staging": {"T": "T2", "N": None}, "imaging": {}, "therapies": [{"type": "chemo", "line": 1, "cycles": [{"cycle": 2, "date": "2021-01"}]}, None], "labs": [{"name": "CEA", "value": 1.5}], "plan": "wait"}, 7]}
    rows = spark.createDataFrame([(json.dumps(payload),), (None,)], "x string").select(P.timeline_text(P.variant(F.col("x"))).alias("y")).collect()
    assert rows[0].y.split("\n") == ['{"T":"T1"}', "T2 None  ", " ", "chemo   line:1", "cycle 2 2021-01 ", "CEA 1.5  ", "wait"] and not rows[1].y


def test_config(monkeypatch):
    from quillon.config import Config

    monkeypatch.setenv("QUILLON_SEED", "7")
    monkeypatch.setenv("QUILLON_KEEP_NONCORE", "Yes")
    got = Config.load(sample_cap=5)
    assert (got.seed, got.keep_noncore, got.sample_cap, got.heldout_share) == (7, True, 5, 0.2)
