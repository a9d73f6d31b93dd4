"""Settings: one table of names, defaults and accepted values; a YAML file replaces defaults, calls replace both."""

import json
import os
from pathlib import Path
from types import SimpleNamespace
from warnings import warn

from .sources.files import LANGUAGES

USER_FILE = Path.home() / ".quillmesh" / "config.yaml"


class ConfigError(ValueError):
    pass


def _whole(low: int, high: float = float("inf")):
    def accept(value):
        n = int(value)
        if not low <= n <= high:
            raise ValueError(f"must be {low} or more" if high == float("inf") else f"must be from {low} to {high}")
        return n

    return accept


def _share(value):
    x = float(value)
    if not 0 <= x <= 1:
        raise ValueError("must be from 0 to 1")
    return x


def _above_zero(accept):
    def checked(value):
        x = accept(value)
        if not x > 0:
            raise ValueError("must be above 0")
        return x

    return checked


def _flag(value):
    if not isinstance(value, bool):
        raise ValueError("must be true or false")
    return value


def _text(value):
    if not isinstance(value, str) or not value.strip():
        raise ValueError("must be a text that is not blank")
    return value.strip()


def _texts(value):
    if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
        raise ValueError("must be a list of texts")
    return tuple(value)


def _languages(value):
    names = tuple(dict.fromkeys(n.strip().lower() for n in _texts(value)))
    unknown = [n for n in names if n not in LANGUAGES]
    if unknown or not names:
        raise ValueError(f"must be some of {', '.join(LANGUAGES)}")
    return names


def _model(value):
    return "" if value == "" else _text(value)


def _policy(value):
    policy = _text(value).lower()
    if policy not in ("reject", "allow"):
        raise ValueError("must be reject or allow")
    return policy


# Names and defaults of the settings, and the ignore patterns.
SETTINGS = {
    "output": ("graph.json", _text),
    "log_level": ("INFO", _text),
    "languages": (tuple(LANGUAGES), _languages),
    "llm_model": ("", _model),
    "llm_base_url": ("http://localhost:11434", _text),
    "llm_confidence_threshold": (0.5, _share),
    "embedding_model": ("", _model),
    "compress": (False, _flag),
    "versioned": (False, _flag),
    "explain_hops": (2, _whole(1, 2)),
    "explain_top_n": (3, _whole(1)),
    "explain_match_threshold": (0.55, _share),
    "explain_node_cap": (500, _whole(1)),
    "path_match_threshold": (0.55, _share),
    "path_max_hops": (32, _whole(0)),
    "path_confidence_default": (0.5, _share),
    "path_confidence_floor": (0.35, _share),
    "path_provenance_inferred_factor": (1.75, _above_zero(float)),
    "query_k": (20, _whole(1, 200)),
    "query_hops": (1, _whole(1, 2)),
    "query_match_threshold": (0.40, _share),
    "query_node_cap": (500, _whole(1)),
    "ignored_patterns": ((".venv/", "venv/", "node_modules/", "__pycache__/", ".git/", "*.pyc", ".DS_Store"), _texts),
    "max_file_size": (10_485_760, _whole(1)),
    "cache_dir": (str(USER_FILE.parent / "cache"), _text),
    "code_only": (False, _flag),
    "include_generated_docs": (False, _flag),
    "max_reference_scan_bytes": (262_144, _whole(1)),
    "max_reference_scan_ops": (5_000_000, _whole(1)),
    "max_non_code_share": (0.85, _above_zero(_share)),
    "max_total_bytes": (838_860_800, _whole(1)),
    "max_file_count": (20_000, _whole(1)),
    "timeout_seconds": (0, _whole(0)),
    "large_repo_policy": ("reject", _policy),
}
CODE_ONLY_IGNORES = ("docs/", "docs/dyn/", "**/docs/dyn/", "discovery_cache/", "**/discovery_cache/")


def _read(path: Path) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise ConfigError(f"{path}: reading settings needs a YAML library") from e
    try:
        found = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if found is not None and not isinstance(found, dict):
        raise ConfigError(f"{path}: must hold names and values")
    return found or {}


def _accept(values: dict, where) -> dict:
    out = {}
    for name, value in values.items():
        if name not in SETTINGS:
            warn(f"{where}: no setting is called {name!r}", stacklevel=3)
            continue
        try:
            out[name] = SETTINGS[name][1](value)
        except (TypeError, ValueError) as e:
            raise ConfigError(f"{where}: {name} {e}") from e
    return out


def load(path: str | os.PathLike | None = None, user_file: str | os.PathLike = USER_FILE, **given) -> SimpleNamespace:
    """Defaults, then one file, then ``given`` (None counts as not given). A named file must exist
    and stands in for the user's own file, which may be missing. Unknown names warn. A file that
    sets only llm_model sets embedding_model too."""
    values = {name: default for name, (default, _) in SETTINGS.items()}
    file = Path(path or user_file).expanduser()
    if path is not None or file.exists():
        found = _accept(_read(file), file)
        if "llm_model" in found:
            found.setdefault("embedding_model", found["llm_model"])
        values |= found
    values |= _accept({k: v for k, v in given.items() if v is not None}, "call")
    return SimpleNamespace(**values)


def ignores(settings) -> list[str]:
    """The ignore patterns in force, each once: code-only runs leave generated documents out too."""
    more = CODE_ONLY_IGNORES if settings.code_only and not settings.include_generated_docs else ()
    return list(dict.fromkeys([*settings.ignored_patterns, *more]))


def limits(settings) -> dict:
    return {
        "scan_ops": settings.max_reference_scan_ops, "non_code_share": settings.max_non_code_share,
        "total_bytes": settings.max_total_bytes, "n_files": settings.max_file_count,
    }


def template() -> str:
    """A starter file: every setting with its default, as comments."""
    return "# Settings; remove the mark before a line to change it.\n" + "".join(f"# {n}: {json.dumps(d)}\n" for n, (d, _) in SETTINGS.items())


def write_template(path: str | os.PathLike, force: bool = False) -> Path:
    file = Path(path).expanduser()
    if file.exists() and not force:
        raise ConfigError(f"{file} exists")
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(template(), encoding="utf-8")
    return file
