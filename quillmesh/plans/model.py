"""Data model: vocabularies, schemas, identity rules and the edge cost as column expressions."""

from pyspark.sql import functions as F


SCHEMA_VERSION = "6.0.0"

# Fixed vocabularies of the graph format.
NODE_TYPES = ("file", "dir", "function", "class", "method", "heading", "media_text", "transcript_chunk", "concept")
EDGE_TYPES = ("contains", "references", "defines", "imports", "calls", "section_of", "mentions", "related_to", "implements", "depends_on")
PROVENANCE = ("extracted", "inferred")
CONCEPT_KINDS = ("domain_term", "library", "other")
HEADING_SOURCES = ("markdown", "txt", "rst", "pdf")
CODE_TYPES = ("function", "class", "method")

# Fixed base costs of edge types; any other type costs OTHER_COST.
BASE_COST = {
    "implements": 1.0,
    "depends_on": 1.0,
    "calls": 1.0,
    "imports": 1.0,
    "mentions": 1.25,
    "references": 1.25,
    "related_to": 1.25,
    "defines": 1.25,
    "section_of": 1.5,
    "contains": 2.0,
}
OTHER_COST = 1.5

META = (
    "name string, text string, file string, language string, path string, kind string, source string, qualified_name string,"
    " start_line int, end_line int, page int, end_page int, level int, ordinal int, start_sec double, end_sec double,"
    " size_bytes bigint, skipped string, symlink boolean, engine string, aliases array<string>, metadata_json string"
)
LINKS = "source string, target string, type string, provenance string, confidence double, evidence string, reason string, ord bigint"


def slug(name, empty: str = "untitled"):
    """Lower case, runs of other characters to '-', trimmed."""
    made = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", F.lit(empty)).otherwise(made)


def code_id(file, kind, name, start_line):
    return F.concat_ws("::", file, kind, name, start_line.cast("string"))


def heading_id(file, name, locator):
    return F.concat_ws("::", file, F.lit("heading"), slug(name), locator.cast("string"))


def concept_id(name):
    return F.concat(F.lit("concept::"), slug(name))


def edge_cost(default: float = 0.5, floor: float = 0.35, inferred: float = 1.75):
    """Base by type, times ``inferred`` unless extracted, over the confidence (``default`` if
    absent, ``floor`` at least)."""
    base = F.lit(OTHER_COST)
    for kind, cost in BASE_COST.items():
        base = F.when(F.col("type") == kind, F.lit(cost)).otherwise(base)
    factor = F.when(F.col("provenance") == "extracted", F.lit(1.0)).otherwise(F.lit(float(inferred)))
    return base * factor / F.greatest(F.coalesce(F.col("confidence"), F.lit(float(default))), F.lit(float(floor)))
