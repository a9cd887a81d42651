"""Structural, ontology and consistency gates over payloads; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import payload
from quillon.functions.labels import ADAPTER_WITH_CONTEXT, ADAPTERS


def schema_ok(v: Column) -> Column:
    """The first note has T, N, M and a stage group that are given. Case matters: UNKNOWN passes, Unknown does not."""
    def given(field: str) -> Column:
        value = payload.first_note(v, f"staging.{field}")
        return value.isNotNull() & ~value.isin("", "Unknown", "unknown")

    return F.coalesce(given("T") & given("N") & given("M") & given("stage_group"), F.lit(False))


def ontology_ok(codes: Column) -> Column:
    return F.coalesce(F.size(codes), F.lit(0)) > 0


def _label(note: Column, field: str) -> Column:
    """Upper-case text of a label; an explicit null reads NONE and counts as present, a missing key is empty."""
    raw = F.try_variant_get(note, f"$.staging.{field}", "variant")
    text = F.try_variant_get(note, f"$.staging.{field}", "string")
    return F.when(raw.isNull(), F.lit("")).when(F.is_variant_null(raw), F.lit("NONE")).otherwise(F.upper(F.coalesce(text, F.lit(""))))


def violations(v: Column) -> Column:
    """Rule breaks of every note, by its number. Without the key `notes` the payload itself breaks the rule; notes that are no
    list hold no note that could."""
    notes = F.try_variant_get(v, "$.notes", "array<variant>")

    def of(note: Column, i: Column) -> Column:
        t, n, m, group = (_label(note, f) for f in ("T", "N", "M", "stage_group"))
        early = m.contains("M1") & ~group.contains("IV")
        bare = (t != "") & (n != "") & (m != "") & (group == "")
        visit = F.concat(F.lit("visit_"), i.cast("string"))
        return F.concat(
            F.when(early, F.array(F.concat(visit, F.lit(":M1_without_StageIV (group='"), group, F.lit("')")))).otherwise(F.array().cast("array<string>")),
            F.when(bare, F.array(F.concat(visit, F.lit(":missing_stage_group")))).otherwise(F.array().cast("array<string>")),
        )

    absent = F.try_variant_get(v, "$.notes", "variant").isNull()
    found = F.flatten(F.transform(F.coalesce(notes, F.array().cast("array<variant>")), of))
    return F.when(absent, F.array(F.lit("missing_notes_key"))).otherwise(found)


def level(schema: Column, ontology: Column, logic: Column) -> Column:
    """First match of full, schema and ontology, schema; anything else is none."""
    return (
        F.when(schema & ontology & logic, F.lit("C3_full"))
        .when(schema & ontology, F.lit("C2_schema_onto"))
        .when(schema, F.lit("C1_schema"))
        .otherwise(F.lit("C0_none"))
    )


def adapter(label: Column, with_context: bool = False) -> Column:
    """The adapter trained on runs of a gate label; the ungated one for unknown labels."""
    names = ADAPTERS | ({"C3_full": ADAPTER_WITH_CONTEXT} if with_context else {})
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[label], F.lit(ADAPTERS["C0_none"]))


def notes_missing(v: Column, expected: int) -> Column:
    """True where the number of notes differs from what was asked for."""
    return F.coalesce(F.size(F.try_variant_get(v, "$.notes", "array<variant>")), F.lit(0)) != expected
