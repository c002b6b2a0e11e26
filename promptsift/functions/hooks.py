"""Model hooks: embedders and language models as column functions, with fallbacks.

A hook is any callable; nothing here opens a connection by itself. ``ollama`` and ``azure``
build hooks from a ``post(url, payload, headers)`` function, so that tests can give their own.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

Embedder = Callable[[list[str]], list[list[float]]]
Llm = Callable[[str], str]
Post = Callable[[str, dict, Mapping[str, str]], dict]
Get = Callable[[str], dict]

#: Texts and characters that go to an embedder in one call; a longer text goes alone.
CALL_TEXTS, CALL_CHARS = 64, 100_000
#: Seconds that a server has to show that it is there.
PING_SECONDS = 2.0


def http_post(url: str, payload: dict, headers: Mapping[str, str], timeout: float = 30.0) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def http_get(url: str, timeout: float = PING_SECONDS) -> dict:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return json.load(answer)


def reachable(call: Callable[[], object]) -> bool:
    """Whether the call answers."""
    try:
        call()
    except Exception:  # noqa: BLE001  any failure of a remote model
        return False
    return True


def with_fallback(hook: Callable, otherwise: Callable) -> Callable:
    """hook, or what otherwise gives when it fails."""

    def run(x):
        try:
            return hook(x)
        except Exception:  # noqa: BLE001  any failure of a remote model
            return otherwise(x)

    return run


def safe_embedder(embedder: Embedder) -> Embedder:
    return with_fallback(embedder, lambda texts: [[0.0] for _ in texts])


def safe_llm(llm: Llm) -> Llm:
    return with_fallback(llm, lambda _: "")


def calls(texts: list[str], most: int = CALL_TEXTS, chars: int = CALL_CHARS) -> Iterator[list[str]]:
    """The texts in order, in as many calls as the two bounds ask for."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and (len(held) == most or size + len(text) > chars):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def embedded(embedder: Embedder, most: int = CALL_TEXTS) -> Callable[[Column], Column]:
    """A column function that embeds texts, a bounded number with each call, so that one call's failure leaves the others' vectors."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [v for call in calls([t or "" for t in texts.to_pylist()], most) for v in embedder(call)]
            yield pa.array(found, pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<double>")


def answered(llm: Llm) -> Callable[[Column], Column]:
    """A column function: prompts to answers; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in batches:
            yield pa.array([None if p is None else llm(p) for p in prompts.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "string")


def tried(llm: Llm) -> Callable[[Column], Column]:
    """A column function: prompts to (answer, error), of which one is null."""

    def ask(prompt: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if prompt is None else llm(prompt)), None
        except Exception as e:  # noqa: BLE001  a case's failure is its result
            return None, f"{e}"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in batches:
            found = [ask(p) for p in prompts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["answer", "error"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "answer string, error string")


def ollama(host: str, embed_model: str, llm_model: str, post: Post = http_post, stable: bool = False) -> tuple[Embedder, Llm]:
    """Hooks of an Ollama server; stable asks for temperature 0."""
    options = {"options": {"temperature": 0}} if stable else {}

    def embed(texts: list[str]) -> list[list[float]]:
        return [post(f"{host}/api/embeddings", {"model": embed_model, "prompt": t}, {})["embedding"] for t in texts]

    def ask(prompt: str) -> str:
        return post(f"{host}/api/generate", {"model": llm_model, "prompt": prompt, "stream": False, **options}, {})["response"]

    return safe_embedder(embed), safe_llm(ask)


def azure(endpoint: str, key: str, embed_model: str, llm_model: str, version: str = "2024-10-21", post: Post = http_post, stable: bool = False) -> tuple[Embedder, Llm]:
    """Hooks of an Azure OpenAI resource: one call for several texts, answers put in order by index."""
    base, headers = f"{endpoint.rstrip('/')}/openai/deployments", {"api-key": key}
    options = {"temperature": 0} if stable else {}

    def embed(texts: list[str]) -> list[list[float]]:
        data = post(f"{base}/{embed_model}/embeddings?api-version={version}", {"input": texts}, headers)["data"]
        return [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]

    def ask(prompt: str) -> str:
        payload = {"messages": [{"role": "user", "content": prompt}], **options}
        return post(f"{base}/{llm_model}/chat/completions?api-version={version}", payload, headers)["choices"][0]["message"]["content"]

    return safe_embedder(embed), safe_llm(ask)


def azure_ping(endpoint: str, key: str, model: str, version: str, post: Post = http_post) -> bool:
    """Whether the deployment answers a message of one token."""
    url = f"{endpoint.rstrip('/')}/openai/deployments/{model}/chat/completions?api-version={version}"
    return reachable(lambda: post(url, {"messages": [{"role": "user", "content": "ping"}], "max_tokens": 1}, {"api-key": key}))


def ollama_ping(host: str, get: Get = http_get) -> bool:
    """Whether a server lists its models there."""
    return reachable(lambda: get(f"{host.rstrip('/')}/api/tags"))


def hooks_from_env(env: Mapping[str, str] | None = None, post: Post = http_post, get: Get = http_get) -> tuple[Embedder | None, Llm | None]:
    """Hooks of the backend that the environment names and that answers: forced, else Azure, else Ollama, else none.

    Azure needs an endpoint, a key and at least one deployment; a hook without its deployment
    is None.
    """
    env = os.environ if env is None else env
    forced = env.get("PROMPTSIFT_BACKEND", "").lower()
    stable = env.get("PROMPTSIFT_CACHE_STABLE", "").strip().lower() in ("on", "1", "yes", "true", "enabled")
    endpoint, key = env.get("AZURE_OPENAI_ENDPOINT"), env.get("AZURE_OPENAI_API_KEY")
    embed, llm = env.get("AZURE_OPENAI_EMBED_DEPLOYMENT"), env.get("AZURE_OPENAI_LLM_DEPLOYMENT")
    if forced in ("", "azure") and endpoint and key and (embed or llm):
        version = env.get("AZURE_OPENAI_API_VERSION", "2024-10-21")
        if not llm or azure_ping(endpoint, key, llm, version, post):
            hooks = azure(endpoint, key, embed or "", llm or "", version, post, stable)
            return hooks[0] if embed else None, hooks[1] if llm else None
    if forced in ("", "ollama"):
        host = env.get("OLLAMA_HOST", "http://localhost:11434")
        if ollama_ping(host, get):
            return ollama(host, env.get("PROMPTSIFT_EMBED_MODEL", "nomic-embed-text"), env.get("PROMPTSIFT_LLM_MODEL", "llama3.2:3b"), post, stable)
    return None, None
