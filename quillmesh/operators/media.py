"""Nodes from PDF files, images and speech. What reads them is the caller's: a function of (file id,
bytes) that runs on the executors, so it must be picklable. One that raises skips its file."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import slug
from . import links as L
from .expand import settle

# Fixed suffixes: what each reader gets, and the code and documents that media may be linked to.
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".tif", ".tiff", ".bmp")
SOUNDS = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac", ".mp4", ".mov", ".mkv", ".webm")
TEXTS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".sql", ".md", ".markdown", ".txt", ".rst", ".rest", ".pdf",
)
FACTS = "file string, fact string, k int, level int, name string, page int, text string, start_sec double, end_sec double"
TITLE_CHARS = 120  # fixed: of a page without an outline


def suffix(path):
    """Suffix in lower case; names that start with their only dot have none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, "[^/]+$", 0), r".(\.[^.]+)$", 1))


def outline_of_pages(pages: list[str]) -> list[tuple[int, str, int]]:
    """A section a page, by its first line that is not blank."""
    firsts = (next((line.strip() for line in (text or "").splitlines() if line.strip()), "") for text in pages)
    return [(1, first[:TITLE_CHARS] or f"Page {n}", n) for n, first in enumerate(firsts, 1)]


def read_media(files: DataFrame, pdf=None, ocr=None, speech=None) -> DataFrame:
    """files (id, content) to facts: sections, texts, segments and, with the error as text, skips.

    ``pdf`` gives (outline, pages): [(level, title, page)], used if not empty, and the pages' texts;
    ``ocr`` a text; ``speech`` [(start, end, text)]. Kinds of files without a reader give nothing."""

    def facts(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for file, data in zip(batch["id"], batch["content"]):
                end = "." + file.rpartition(".")[2].lower()
                try:
                    if end == ".pdf" and pdf is not None:
                        told, pages = pdf(file, bytes(data))
                        told = [(max(1, int(v)), (t or "").strip() or "untitled", max(1, int(p))) for v, t, p in told or ()] or outline_of_pages(pages)
                        rows += [(file, "section", k, v, t, p, None, None, None) for k, (v, t, p) in enumerate(told)]
                    elif end in IMAGES and ocr is not None:
                        rows.append((file, "text", 1, None, None, None, (ocr(file, bytes(data)) or "").strip(), None, None))
                    elif end in SOUNDS and speech is not None:
                        said = list(speech(file, bytes(data)))
                        rows += [(file, "segment", k, None, None, None, t, float(a), float(b)) for k, (a, b, t) in enumerate(said)]
                except Exception as e:  # a file never stops the others
                    rows.append((file, "skip", None, None, None, None, str(e), None, None))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])
            yield frame.astype({c: "Int32" for c in ("k", "level", "page")})

    wanted = (*((".pdf",) if pdf else ()), *(IMAGES if ocr else ()), *(SOUNDS if speech else ()))
    return files.where(suffix(F.col("id")).isin(*wanted)).mapInPandas(facts, FACTS)


def sections(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headings, section_of candidates) of PDF sections: file, slug and page make the id, and a section
    lies in the nearest earlier one of a lower level, else in the file."""
    base = facts.where("fact = 'section'").withColumn("base", F.concat(F.col("file"), F.lit("::heading::"), slug(F.col("name")), F.lit("::p"), F.col("page").cast("string")))
    ranked = L.with_suffix(base, "base", "k", "id")
    made = settle(L.outline(ranked.withColumn("depth", F.least("level", F.lit(32))), "file", "k", "depth", 32))
    up = made.select("file", F.col("k").alias("parent"), F.col("id").alias("up"))
    edges = made.join(up, ["file", "parent"], "left").select(
        F.col("id").alias("source"), F.coalesce("up", "file").alias("target"), F.lit(7).alias("phase"), F.format_string("%08d", "k").alias("seq"), F.lit("section_of").alias("type")
    )
    return made.select("id", F.lit("heading").alias("type"), "name", "file", F.lit("pdf").alias("source"), "page", "level"), edges


def texts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media_text and transcript_chunk nodes, section_of candidates): a node an image with text, and one
    for each chunk that segments merge into."""
    seen = facts.where("fact = 'text' and text <> ''").select("file", F.lit("media_text").alias("type"), F.lit(1).alias("ordinal"), "text", F.lit("ocr").alias("source"), F.lit("tesseract").alias("engine"))
    chunks = L.merge_segments(facts.where("fact = 'segment'").select("file", "start_sec", "end_sec", "text"), "file")
    spoken = chunks.select("file", F.lit("transcript_chunk").alias("type"), (F.col("ordinal") + 1).alias("ordinal"), "text", F.lit("whisper").alias("source"), "start_sec", "end_sec")
    nodes = seen.unionByName(spoken, allowMissingColumns=True)
    nodes = settle(nodes.withColumn("id", F.concat_ws("::", "file", "type", F.col("ordinal").cast("string"))))
    edges = nodes.select(F.col("id").alias("source"), F.col("file").alias("target"), F.lit(8).alias("phase"), F.format_string("%08d", "ordinal").alias("seq"), F.lit("section_of").alias("type"))
    return nodes, edges


def related(nodes: DataFrame) -> DataFrame:
    """related_to candidates with their reason: media files to the one code file or document of their
    stem, media texts to the one heading, symbol or file that shares three words."""
    ends = suffix(F.col("id"))
    files = nodes.where("type = 'file'").select("id")
    known = files.where(ends.isin(*TEXTS))
    by_name = L.same_stem(files.where(ends.isin(*IMAGES, *SOUNDS)), known)
    said = F.concat_ws(" ", *[F.col(c) for c in ("text", "name", "qualified_name") if c in nodes.columns])
    media = nodes.where("type in ('media_text', 'transcript_chunk')").select("id", said.alias("text"))
    stem = F.regexp_replace(F.regexp_extract("id", r"([^/]+?)(\.[^./]*)?$", 1), "[_-]", " ")
    others = nodes.where("type in ('heading', 'function', 'class', 'method')").select("id", said.alias("text")).unionByName(known.select("id", stem.alias("text")))
    by_text = L.token_overlap(media, others)
    of = lambda df, phase, why: df.select("source", "target", F.lit(phase).alias("phase"), F.lit("").alias("seq"), F.lit("related_to").alias("type"), F.lit(why).alias("reason"))
    return of(by_name, 9, "filename").unionByName(of(by_text, 10, "content"))


def add_media(files: DataFrame, nodes: DataFrame, pdf=None, ocr=None, speech=None) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(new nodes, edge candidates, skipped (id, error)). Media are linked only where they are read."""
    facts = settle(read_media(files, pdf, ocr, speech))
    made, edges = sections(facts)
    candidates = [edges]
    if ocr is not None or speech is not None:
        seen, inside = texts(facts)
        made = made.unionByName(seen, allowMissingColumns=True)
        candidates += [inside, related(nodes.unionByName(made, allowMissingColumns=True))]
    return made, candidates, facts.where("fact = 'skip'").select(F.col("file").alias("id"), F.col("text").alias("error"))
