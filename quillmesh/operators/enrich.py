"""Concepts and inferred edges from the replies of a model, as joins.

A reply is applied as if items came one after another: entities before relations, files by name. All
that depends on this order is when a concept first stands, so each concept carries the place of its
first item and a relation sees those up to its own place; nothing iterates.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import CODE_TYPES, CONCEPT_KINDS, concept_id
from .edges import first_edge_wins
from .expand import settle

RELATIONS = ("implements", "depends_on", "mentions")
PLACE = ("file", "stage", "pos")
CHUNK_CHARS = 12_000  # fixed: how much of a file a model sees
# Fixed suffixes of files that a model is asked about, beside those without one.
ASKED = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".sql", ".md", ".txt", ".rst", ".json", ".yaml", ".yml", ".toml",
    ".sh", ".bash", ".zsh", ".pdf", "",
)
TASK = (
    "Find the domain terms and libraries that a piece of a source file speaks of, and how its code relates to them. Reply in JSON alone: entities (name, kind, evidence, "
    "confidence) and relations (type, subject, object, evidence, confidence), where type is implements, depends_on or mentions. Evidence is copied word for word from "
    "the piece; confidence lies between 0 and 1."
)
_ITEM = {"evidence": {"type": "string"}, "confidence": {"type": "number"}}


def reply_schema() -> dict:
    """JSON schema of a reply."""
    text, of = {"type": "string"}, lambda fields: {"type": "array", "items": {"type": "object", "properties": fields, "required": list(fields)}}
    entity = {"name": text, "kind": {"type": "string", "enum": list(CONCEPT_KINDS)}} | _ITEM
    relation = {"type": {"type": "string", "enum": list(RELATIONS)}, "subject": text, "object": text} | _ITEM
    return {"type": "object", "properties": {"entities": of(entity), "relations": of(relation)}, "required": ["entities", "relations"]}


def ask_files(files: DataFrame, chat, most: int = CHUNK_CHARS) -> DataFrame:
    """files (id, content) to replies (file, payload, chunk, error): one call of ``chat(system, user)``, which
    must be picklable, for each file whose first ``most`` characters are not blank. It gives JSON text or
    what JSON makes of it; one that raises leaves an error and no payload. Calls cost more than anything
    else here, so the replies are settled at once; a lost task asks again."""

    def ask(batches):
        import json

        import pandas as pd

        for batch in batches:
            rows = []
            for file, data in zip(batch["id"], batch["content"]):
                chunk = bytes(data).decode("utf-8", "replace")[:most]
                if not chunk.strip():
                    continue
                try:
                    said = chat(TASK, f"{file}\n\n{chunk}")
                    rows.append((file, said if isinstance(said, str) else json.dumps(said), chunk, None))
                except Exception as e:  # a file never stops the others
                    rows.append((file, None, chunk, str(e)))
            yield pd.DataFrame(rows, columns=["file", "payload", "chunk", "error"])

    base = F.regexp_extract("id", "[^/]+$", 0)
    wanted = files.where(F.lower(F.regexp_extract(base, r".(\.[^.]+)$", 1)).isin(*ASKED))
    return settle(wanted.select("id", "content").mapInPandas(ask, "file string, payload string, chunk string, error string"))


def enrich(nodes: DataFrame, links: DataFrame, files: DataFrame, chat, threshold: float = 0.5, most: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, links, counts) with what ``chat`` finds in ``files``; ``counts`` adds failed calls."""
    replies = ask_files(files, chat, most)
    n, e, counts = apply_replies(nodes, links, replies.where("error is null").drop("error"), threshold)
    return n, e, counts | {"failed": replies.where("error is not null").count()}


def _strip(column):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def _text(field: str):
    """A field of the item if it is a JSON string."""
    held = f"try_variant_get(item, '$.{field}', 'variant')"
    return F.expr(f"if(schema_of_variant({held}) = 'STRING', try_variant_get(item, '$.{field}', 'string'), null)")


def payload_items(replies: DataFrame, threshold: float = 0.5, clip: int = 240) -> DataFrame:
    """replies (file, payload as JSON text, chunk; one row a file) to one row an item: file, stage
    (0 entity, 1 relation), pos, name, kind, type, subject, object, confidence, evidence, sound.

    ``sound``: an object with all texts its stage needs, a confidence from ``threshold`` to 1, and
    evidence that stands in the chunk, as it is or with white space collapsed. Evidence is clipped
    first. Broken JSON and fields that are no lists give no items."""
    parsed = replies.select("file", F.coalesce("chunk", F.lit("")).alias("chunk"), F.try_parse_json("payload").alias("v"))
    stages = [
        parsed.select("file", "chunk", F.lit(k).alias("stage"), F.posexplode(F.expr(f"try_variant_get(v, '$.{field}', 'array<variant>')")).alias("pos", "item"))
        for k, field in enumerate(("entities", "relations"))
    ]
    rows = stages[0].unionByName(stages[1]).select(
        *PLACE, "chunk",
        _strip(_text("name")).alias("name"), _text("kind").alias("kind"), _text("type").alias("type"),
        _strip(_text("subject")).alias("subject"), _strip(_text("object")).alias("object"),
        F.expr("try_variant_get(item, '$.confidence', 'double')").alias("confidence"),
        F.substring(_strip(F.expr("try_variant_get(item, '$.evidence', 'string')")), 1, clip).alias("evidence"),
    )
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    stands = (F.col("evidence") != "") & (F.contains("chunk", "evidence") | F.contains(flat(F.col("chunk")), flat(F.col("evidence"))))
    whole = F.when(F.col("stage") == 0, F.col("name") != "").otherwise(
        F.col("type").isin(*RELATIONS) & F.col("subject").isNotNull() & F.col("object").isNotNull()
    )
    sound = whole & F.col("confidence").between(threshold, 1.0) & stands
    return rows.withColumn("sound", F.coalesce(sound, F.lit(False))).drop("chunk")


def apply_replies(nodes: DataFrame, links: DataFrame, replies: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, links, counts of added edges and dropped items) with what the replies hold.

    Entities become concepts that the file mentions. A relation goes from its subject to the concept
    of its object: the subject is a node id, a concept, the one code symbol of that name in the
    file, or the file by id or name; mentions fall back on the file, ``implements`` starts at code
    alone. A concept keeps its first name and kind; an ordered pair keeps its first edge, and pairs
    that ``links`` has stay as they are."""
    items = settle(payload_items(replies, threshold))
    place = F.struct(*PLACE)
    sound = items.where("sound").withColumn("place", place)
    named = F.when(F.col("stage") == 0, F.col("name")).otherwise(F.nullif("object", F.lit("")))
    kind = F.when(F.col("stage") == 0, F.when(F.col("kind").isin(*CONCEPT_KINDS), F.col("kind"))).otherwise(
        F.when(F.col("type") == "depends_on", "library").otherwise("domain_term")
    )
    sound = settle(sound.withColumn("label", named).withColumn("label_kind", kind).withColumn("concept", concept_id(F.col("label"))))
    made = sound.where("label is not null").groupBy("concept").agg(F.min(F.struct("place", "label", "label_kind")).alias("c"))
    made = made.select(F.col("concept").alias("id"), F.col("c.place").alias("since"), F.col("c.label").alias("name"), F.col("c.label_kind").alias("kind"))
    fresh = settle(made.join(nodes.select("id"), "id", "left_anti"))
    held = nodes.groupBy("id").agg(F.min("type").alias("type"))
    ids = held.select("id", "type", F.lit(None).cast(fresh.schema["since"].dataType).alias("since")).unionByName(
        fresh.select("id", F.lit("concept").alias("type"), "since")
    )

    def known(rows, key, name):
        """Adds ``name``: (id, type) of the node that ``key`` is, if it stands at the row's place."""
        other = ids.select(F.col("id").alias(key), F.struct("id", "type").alias(name), F.col("since").alias("_since"))
        joined = rows.join(other, key, "left")
        return joined.withColumn(name, F.when(F.col("_since").isNull() | (F.col("_since") <= F.col("place")), F.col(name))).drop("_since")

    asked = sound.where("stage = 1 and label is not null").withColumn("_slug", F.when(F.col("subject") != "", concept_id(F.col("subject"))))
    asked = known(known(asked, "subject", "by_id"), "_slug", "by_concept")
    columns = set(nodes.columns)
    if {"file", "name"} <= columns:
        code = nodes.where(F.col("type").isin(*CODE_TYPES)).groupBy("file", F.col("name").alias("subject"))
        one = code.agg(F.min(F.struct("id", "type")).alias("by_symbol"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        asked = asked.join(one, ["file", "subject"], "left")
    else:
        asked = asked.withColumn("by_symbol", F.lit(None).cast("struct<id:string,type:string>"))
    files = held.select(F.col("id").alias("file"), F.struct("id", "type").alias("own"))
    asked = asked.join(files, "file", "left")
    is_file = F.col("subject").isin(F.col("file"), F.regexp_extract("file", "[^/]+$", 0)) | (F.col("type") == "mentions")
    asked = asked.withColumn("from", F.coalesce("by_id", "by_concept", "by_symbol", F.when(is_file, F.col("own"))))
    placed = settle(asked.where(F.col("from").isNotNull() & ((F.col("type") != "implements") | F.col("from.type").isin(*CODE_TYPES))))

    mentions = sound.where("stage = 0").select(F.col("file").alias("source"), F.lit("mentions").alias("type"), "concept", "place", "confidence", "evidence")
    both = mentions.unionByName(placed.select(F.col("from.id").alias("source"), "type", "concept", "place", "confidence", "evidence"))
    candidates = both.select(
        "source", F.col("concept").alias("target"), F.lit(0).alias("phase"), F.col("place").alias("seq"), "type",
        F.when(F.col("type") == "mentions", "extracted").otherwise("inferred").alias("provenance"), "confidence", "evidence",
    )
    new = first_edge_wins(candidates.join(links.select("source", "target"), ["source", "target"], "left_anti"), ids)
    new = settle(new)
    total, fine = items.count(), sound.where("stage = 0").count() + placed.count()
    concepts = fresh.select("id", F.lit("concept").alias("type"), "name", "kind")
    return (
        nodes.unionByName(concepts, allowMissingColumns=True),
        links.unionByName(new, allowMissingColumns=True),
        {"added": new.count(), "dropped": total - fine},
    )
