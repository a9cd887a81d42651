"""Label normalisers, scalar text functions and domain rules as native expressions.

Four normalisers exist on purpose; they treat missing values, prefixes and phantom classes differently and are never merged.
Null input is a missing value everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cells of the stage rule by T row and N column; M1 is IV whatever T and N.
STAGE_RULE = {
    "T1": ("IA", "IIA", "IIIA", "IIIB"),
    "T2": ("IB", "IIB", "IIIA", "IIIB"),
    "T3": ("IIB", "IIIA", "IIIB", "IIIC"),
    "T4": ("IIIA", "IIIA", "IIIB", "IIIC"),
}
CLASSES = {"T": ("T1", "T2", "T3", "T4"), "N": ("N0", "N1", "N2", "N3"), "M": ("M0", "M1")}
# Entropy floors in nats, by origin.
FLOORS = {
    "core": {"T": 1.109, "N": 1.109, "M": 0.554},
    "generation": {"T": 0.80 * 1.386, "N": 0.80 * 1.386, "M": 0.80 * 0.693},
    "audit": {"T": 1.11, "N": 1.11, "M": 0.55},
}
LUNG_PROJECTS = ("TCGA-LUAD", "TCGA-LUSC")
# Adapter names by gate label; fully gated runs with retrieved context have their own.
ADAPTERS = {"C0_none": "adapter_A_ungated", "C1_schema": "adapter_B_schema", "C2_schema_onto": "adapter_C_schema_onto", "C3_full": "adapter_D_full_norag"}
ADAPTER_WITH_CONTEXT = "adapter_E_full_rag"


def strip(x: Column) -> Column:
    """Leading and trailing white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|(?U)\s+$", "")


def _clean(x: Column) -> Column:
    return F.upper(strip(F.coalesce(x, F.lit(""))))


def _without_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, 2, 1_000_000)).otherwise(x)


def norm_a(x: Column, prefix: str) -> Column:
    """One leading P or C goes, the prefix goes; IS, X or a digit 0-4 at the start decides; all else is `<P>UNKNOWN`."""
    text = _clean(x)
    rest = _without_prefix(F.regexp_replace(text, "^[PC]", ""), prefix)
    found = F.regexp_extract(rest, "^(IS|X|[0-4])", 1)
    missing = text.isin("", "NONE", "NULL", "NAN", "UNKNOWN")
    return F.when(missing | (found == ""), F.lit(f"{prefix}UNKNOWN")).otherwise(F.concat(F.lit(prefix), found))


def norm_b(x: Column, prefix: str) -> Column:
    """Missing is bare `UNKNOWN`; digits, IS or X decide; all else keeps its text behind the prefix."""
    text = _clean(x)
    rest = _without_prefix(text, prefix)
    found = F.regexp_extract(rest, r"^(\d+|IS|X)", 1)
    return F.when(text.isin("", "NONE", "NULL", "NAN", "UNKNOWN"), F.lit("UNKNOWN")).otherwise(F.concat(F.lit(prefix), F.when(found == "", rest).otherwise(found)))


def norm_c(x: Column, prefix: str) -> Column:
    """As b, but NAN is text and SN a class."""
    text = _clean(x)
    rest = _without_prefix(text, prefix)
    found = F.regexp_extract(rest, r"^(\d+|IS|X|SN)", 1)
    return F.when(text.isin("", "NONE", "NULL", "UNKNOWN"), F.lit("UNKNOWN")).otherwise(F.concat(F.lit(prefix), F.when(found == "", rest).otherwise(found)))


def norm_d(x: Column, prefix: str) -> Column:
    """The prefix is required, in either case; anything without a class is null."""
    found = F.regexp_extract(F.coalesce(x, F.lit("")), f"^(?i){prefix}(is|x|[0-4])", 1)
    return F.when(found != "", F.concat(F.lit(prefix), F.upper(found)))


def stage_group(t: Column, n: Column, m: Column) -> Column:
    """The stage rule; combinations outside it are `Unknown`."""
    out = F.when(m == "M1", F.lit("IV"))
    for row, groups in STAGE_RULE.items():
        for k, group in enumerate(groups):
            out = out.when((t == row) & (n == f"N{k}"), F.lit(group))
    return out.otherwise(F.lit("Unknown"))


def cell(index: Column, dim: str) -> Column:
    """Label of the 32-cell grid for a running index; M varies fastest."""
    i = F.pmod(index, F.lit(32))
    part = {"T": 1 + F.floor(i / 8), "N": F.floor(F.pmod(i, F.lit(8)) / 2), "M": F.pmod(i, F.lit(2))}[dim]
    return F.concat(F.lit(dim), part.cast("string"))


def word_count(x: Column) -> Column:
    """Words between white space; null and empty have none."""
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def density(words: Column, hits: Column) -> Column:
    """Hits per 100 words, at least one word assumed."""
    return 100.0 * hits / F.greatest(words, F.lit(1))


def truthy(x: Column) -> Column:
    """true, 1 and yes in any case; null counts as true."""
    return F.coalesce(F.lower(strip(x)).isin("true", "1", "yes"), F.lit(True))


def iri_tail(x: Column) -> Column:
    return F.coalesce(F.substring_index(x, "/", -1), F.lit(""))


def patient_key(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


def cancer_type(project: Column) -> Column:
    return F.replace(project, F.lit("TCGA-"), F.lit(""))


def slug(x: Column) -> Column:
    return F.replace(F.lower(F.replace(x, F.lit(" "), F.lit("_"))), F.lit("/"), F.lit("_"))


def join_filled(parts: Column, sep: str = " ") -> Column:
    """Parts that are not blank, stripped and joined."""
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), sep)


def alias(x: Column, names: dict[str, str]) -> Column:
    """A canonical name by lower-case key, else the stripped input."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(table[F.lower(strip(x))], strip(x))


def token_budget(notes: Column, per_note: int = 320, fixed: int = 250) -> Column:
    return F.greatest(notes, F.lit(1)) * per_note + fixed


def completion(t: Column, n: Column, m: Column) -> Column:
    """The expected answer, byte by byte as a model is trained to give it."""
    return F.format_string('{"T": "%s", "N": "%s", "M": "%s"}', t, n, m)


# Words that make a label a lung-cancer concept.
CONCEPT_WORDS = ("lung", "pulmon", "bronch", "adenocarcinoma", "squamous", "neoplasm", "staging", "carcinoma", "metastasis")
CONCEPT = rf"(?i)\b({'|'.join(CONCEPT_WORDS)})\b"


def lung_concept(label: Column) -> Column:
    """Labels with a whole word of the concept list; stems match as whole words only."""
    return F.coalesce(label.rlike(CONCEPT), F.lit(False))


def ontology_block(text: Column, codes: Column) -> Column:
    """The text followed by a heading and a line per code; unchanged without codes."""
    lines = F.transform(codes, lambda c: F.concat(F.lit("- "), c["pref_label"], F.lit(": "), c["snomed_id"]))
    return F.when(F.size(F.coalesce(codes, F.array())) > 0, F.concat(text, F.lit("\n\n[Ontology Grounding]\n"), F.array_join(lines, "\n"))).otherwise(text)
