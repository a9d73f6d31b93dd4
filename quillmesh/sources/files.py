"""Project files: discovery with ignore rules, and capped reads."""

import os
import re
from fnmatch import translate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, type string, size_bytes bigint, symlink boolean, skipped string"

# Fixed table: suffixes of the supported languages.
LANGUAGES = {
    "python": (".py", ".pyw"),
    "javascript": (".js", ".mjs", ".cjs", ".jsx"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "go": (".go",),
    "rust": (".rs",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".h"),
    "sql": (".sql",),
}


def ignore_rules(lines: list[str]) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern, only directories, negated) of ignore-file lines, in order."""
    rules = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[negated:]
        only_dirs, body = body.endswith("/"), body.rstrip("/")
        anchored, body = "/" in body, body.lstrip("/")
        pieces = []
        for piece in body.split("/"):
            pieces.append(".*" if piece == "**" else translate(piece)[4:-3].replace(".*", "[^/]*") if piece else "")
        text = "/".join(pieces).replace(".*/", "(?:.*/)?").replace("/.*", "(?:/.*)?") if "**" in body else "/".join(pieces)
        rules.append((re.compile(("" if anchored else "(?:.*/)?") + text + r"\Z", re.S), only_dirs, negated))
    return rules


def is_ignored(path: str, is_dir: bool, rules) -> bool:
    """The last rule that matches the path or a directory above it decides."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        prefix, directory = "/".join(parts[:k]), k < len(parts) or is_dir
        verdict = None
        for pattern, only_dirs, negated in rules:
            if (directory or not only_dirs) and pattern.match(prefix):
                verdict = not negated
        if verdict:
            return True
    return False


def discover(root: str, patterns: list[str] = ()) -> list[tuple]:
    """(id, type, size, symlink) of a project, directories first, then files, by id. `.git` and
    ignored directories are not entered; links are files that are not followed."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    rules = [ignore_rules(list(patterns))]
    if os.path.isfile(f"{root}/.gitignore"):
        with open(f"{root}/.gitignore", encoding="utf-8", errors="replace") as f:
            rules.append(ignore_rules(f.readlines()))
    ignored = lambda p, d: any(is_ignored(p, d, r) for r in rules)
    out, todo = [], [""]
    while todo:
        at = todo.pop()
        for entry in os.scandir(os.path.join(root, at)):
            path = f"{at}/{entry.name}" if at else entry.name
            link, directory = entry.is_symlink(), entry.is_dir(follow_symlinks=False)
            if entry.name == ".git" or ignored(path, directory):
                continue
            if directory and not link:
                out.append((path, "dir", None, False))
                todo.append(path)
            elif link or entry.is_file(follow_symlinks=False):
                out.append((path, "file", entry.stat(follow_symlinks=False).st_size, link))
    return sorted(out, key=lambda r: (r[1] != "dir", r[0]))


def inventory(spark, root: str, patterns: list[str] = (), max_size: int = 10_485_760) -> DataFrame:
    """Files and directories as nodes, the root as '.'; oversize files are marked, not dropped."""
    rows = [(".", "dir", None, False, None)]
    rows += [(i, t, n, link, "oversize" if n is not None and n > max_size else None) for i, t, n, link in discover(root, patterns)]
    return spark.createDataFrame(rows, SCHEMA)


def contents(spark, root: str, files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """id, content (binary) of plain, readable files, read on the executors."""
    names = files.where("type = 'file' and not symlink and skipped is null").select("id")
    base = os.path.abspath(root).rstrip("/")
    # The inventory was listed by this driver; only its files are opened.
    paths = [f"{base}/" + re.sub(r"([\\*?\[\]{}])", r"\\\1", r.id) for r in names.toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "id string, content binary")
    raw = spark.read.format("binaryFile").load(paths)
    path = F.url_decode(F.regexp_replace(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B")), "^" + re.escape(base) + "/", ""))
    content = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    return raw.select(path.alias("id"), content.alias("content")).join(names, "id", "left_semi")


def language(path):
    """Language by suffix; names that start with their only dot have none."""
    suffix = F.regexp_extract(F.regexp_extract(path, "[^/]+$", 0), r".(\.[^.]+)$", 1)
    out = F.lit(None).cast("string")
    for name, suffixes in LANGUAGES.items():
        out = F.when(suffix.isin(*suffixes), F.lit(name)).otherwise(out)
    return out
