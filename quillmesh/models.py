"""A model served on this machine, over the public Ollama HTTP interface. Nothing here is called unless
a caller asks for it; every function may be replaced by one of the caller's."""

import json
from functools import partial
from urllib import error, request

ENDPOINT = "http://localhost:11434"


class ModelError(Exception):
    """The model cannot be reached, or its reply cannot be used."""


def _call(base_url: str, path: str, body: dict | None = None, timeout: float = 120.0) -> dict:
    data = None if body is None else json.dumps(body).encode("utf-8")
    asked = request.Request(base_url.rstrip("/") + path, data, {"Accept": "application/json", "Content-Type": "application/json"})
    try:
        with request.urlopen(asked, timeout=timeout) as reply:
            found = json.loads(reply.read() or b"{}")
    except (error.URLError, TimeoutError, OSError, ValueError) as e:
        raise ModelError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ModelError(f"{path}: the reply is no object")
    return found


def list_models(base_url: str = ENDPOINT, timeout: float = 10.0) -> list[str]:
    held = _call(base_url, "/api/tags", timeout=timeout).get("models")
    names = [m.get("name") or m.get("model") for m in held if isinstance(m, dict)] if isinstance(held, list) else []
    return [n.strip() for n in names if isinstance(n, str) and n.strip()]


def is_there(model: str, names: list[str]) -> bool:
    """By whole name, or by what stands before the tag."""
    bare = lambda n: n.partition(":")[0]
    return any(n == model or bare(n) == bare(model) for n in names)


def ready(model: str, base_url: str = ENDPOINT, names=None) -> tuple[bool, str]:
    """(whether the model can be asked, why not). ``names``: a function of the address."""
    try:
        found = (names or list_models)(base_url)
    except Exception as e:
        return False, f"no list of models at {base_url}: {e}"
    return (True, "") if is_there(model, found) else (False, f"{base_url} has no model {model}; it has {', '.join(found[:20]) or 'none'}")


def chat(system: str, user: str, model: str, base_url: str = ENDPOINT, schema: dict | None = None, timeout: float = 120.0) -> str:
    """The model's text; with ``schema``, JSON text that follows it."""
    said = ([{"role": "system", "content": system}] if system.strip() else []) + [{"role": "user", "content": user}]
    body = {"model": model, "stream": False, "messages": said} | ({"format": schema} if schema else {})
    message = _call(base_url, "/api/chat", body, timeout).get("message")
    text = message.get("content") if isinstance(message, dict) else None
    if not isinstance(text, str) or not text.strip():
        raise ModelError("/api/chat: the model said nothing")
    return text.strip()


def embed(texts: list[str], model: str, base_url: str = ENDPOINT, timeout: float = 120.0) -> list[list[float]]:
    """A vector a text, one request each."""
    out = []
    for text in texts:
        vector = _call(base_url, "/api/embeddings", {"model": model, "prompt": text}, timeout).get("embedding")
        if not isinstance(vector, list) or not vector:
            raise ModelError("/api/embeddings: no vector")
        try:
            out.append([float(x) for x in vector])
        except (TypeError, ValueError) as e:
            raise ModelError(f"/api/embeddings: {e}") from e
    return out


def functions(settings) -> dict:
    """The functions that answers and enrichment take, for the models that the settings name."""
    at = settings.llm_base_url
    out = {"list_models": partial(list_models, at)} if settings.llm_model else {}
    out |= {"chat": partial(chat, model=settings.llm_model, base_url=at)} if settings.llm_model else {}
    return out | ({"embed": partial(embed, model=settings.embedding_model, base_url=at)} if settings.embedding_model else {})
