"""Other engines for comparison: a registry of how each is asked and how its answer is read.

An engine has a name and a label, a request (a POST by default) and two columns over the body of its answer:
text, and words per page on a scale of 0 to 1000. ``analyze`` asks and reads with any mix of engines in one
plan; ``register`` adds one.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources import documents

WORDS = "array<array<struct<content: string, polygon: array<double>, confidence: double>>>"
_WORD = "struct<content: string, polygon: array<double>, confidence: double>"
_PEER = f"struct<text: string, layout: array<struct<word_polys: array<{_WORD}>>>, analyzeResult: struct<pages: array<struct<words: array<{_WORD}>>>>>"


@dataclass
class Request:
    url: str
    data: bytes
    headers: dict[str, str] = field(default_factory=dict)
    method: str = "POST"


@dataclass
class Engine:
    """``ask`` makes a request of a configuration, an image and its type; ``text`` and ``words`` read the answer's body."""

    name: str
    label: str
    ask: Callable[[dict, bytes, str], Request]
    text: Callable[[Column, dict], Column]
    words: Callable[[Column], Column]
    needs: tuple[str, ...] = ()


def _none(body: Column) -> Column:
    return F.array().cast(WORDS)


def _result(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.analyzeResult"), body)


def _paged(config: dict, image: bytes, kind: str) -> Request:
    return Request(f"{config['endpoint'].rstrip('/')}/formrecognizer/documentModels/prebuilt-read:analyze?api-version=2022-08-31", image, {"Ocp-Apim-Subscription-Key": config["key"], "Content-Type": kind})


def _annotated(config: dict, image: bytes, kind: str) -> Request:
    body = {"requests": [{"image": {"content": base64.b64encode(image).decode()}, "features": [{"type": "DOCUMENT_TEXT_DETECTION"}]}]}
    return Request(f"{config.get('url') or 'https://vision.googleapis.com/v1/images:annotate'}?{urlencode({'key': config['api_key']})}", json.dumps(body).encode(), {"Content-Type": "application/json"})


def _peer(config: dict, image: bytes, kind: str) -> Request:
    """A form with the image and the fields of a plain reading with layout."""
    mark = "quillspark-form-boundary"
    fields = {"mode": "plain", "task": "ocr_text", "expert_enable_layout": "true"} | {k: config[k] for k in ("backend", "model") if config.get(k)}
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="upload.bin"\r\nContent-Type: {kind}\r\n\r\n'.encode()
    return Request(f"{config['base_url'].rstrip('/')}/api/ocr", b"".join([*parts, head, image, f"\r\n--{mark}--\r\n".encode()]), {"Content-Type": f"multipart/form-data; boundary={mark}"})


def _plain(config: dict, image: bytes, kind: str) -> Request:
    own = {config["auth_header"]: config["auth_value"]} if config.get("auth_header") and config.get("auth_value") else {}
    return Request(config["url"], image, {"Content-Type": kind, "Accept": "application/json, text/plain;q=0.9, */*;q=0.5", **own}, config.get("method") or "POST")


def _peer_words(body: Column) -> Column:
    own = F.from_json(body, _PEER)
    rows = lambda pages, field: F.transform(pages, lambda p: F.coalesce(p[field], F.array().cast(f"array<{_WORD}>")))
    return F.when(F.size(own["layout"]) > 0, rows(own["layout"], "word_polys")).otherwise(rows(own["analyzeResult"]["pages"], "words"))


# Names and labels of the engines, and the fields of their configuration without which they can't be asked.
_KNOWN = (
    Engine("azure", "Azure Form Recognizer", _paged, lambda b, c: F.get_json_object(_result(b), "$.content"), lambda b: documents.paged_words(_result(b)), ("endpoint", "key")),
    Engine("self_peer", "docread (anderer Endpunkt)", _peer, lambda b, c: F.get_json_object(b, "$.text"), _peer_words, ("base_url",)),
    Engine("google_vision", "Google Cloud Vision", _annotated, lambda b, c: F.get_json_object(b, "$.responses[0].fullTextAnnotation.text"), documents.annotated_words, ("api_key",)),
    Engine("plain_text", "Plain-Text-Endpunkt", _plain, lambda b, c: documents.plain_text(b, c.get("text_field") or "text"), _none, ("url",)),
)
_registry: dict[str, Engine] = {e.name: e for e in _KNOWN}


def register(engine: Engine) -> None:
    _registry[engine.name] = engine


def available() -> list[tuple[str, str]]:
    """(name, label) of the engines there are."""
    return [(e.name, e.label) for e in _registry.values()]


def engine(name: str | None) -> Engine:
    """The engine of a name as users write it; none names the first."""
    own = (name or _KNOWN[0].name).strip().lower()
    if own not in _registry:
        raise ValueError(f"unknown engine: {name!r}")
    return _registry[own]


def checked(configs: dict[str, dict]) -> dict[str, tuple[Engine, dict]]:
    """Engines and configurations by name as given; one that lacks a field it needs is an error."""
    out = {}
    for name, config in configs.items():
        own, config = engine(name), {k: v.strip() if isinstance(v, str) else v for k, v in config.items()}
        if missing := [k for k in own.needs if not config.get(k)]:
            raise ValueError(f"{own.name} needs {', '.join(missing)}")
        out[name] = own, config
    return out


def read(answers: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """``answers`` (engine, body) with text and words per page, each by its engine's reader; empty without a body."""
    text, words = F.lit(None).cast("string"), F.lit(None).cast(WORDS)
    for name, config in configs.items():
        own, mine = engine(name), F.col("engine") == name
        text, words = F.when(mine, own.text(F.col("body"), config)).otherwise(text), F.when(mine, own.words(F.col("body")).cast(WORDS)).otherwise(words)
    return answers.withColumns({"text": T.text(text), "words": F.coalesce(words, F.array().cast(WORDS))})


def analyze(images: DataFrame, configs: dict[str, dict], timeout: float = 120.0) -> DataFrame:
    """The columns of ``images`` (engine, content, content_type, others) but content, with body, error, text, words; an engine that fails has an error."""
    known = checked(configs)
    rest = [c for c in images.columns if c != "content"]

    def ask(name: str, content: bytes, kind: str | None) -> tuple[str | None, str | None]:
        if name not in known:
            return None, f"unknown engine: {name!r}"
        own, config = known[name]
        try:
            r = own.ask(config, content, kind or "application/octet-stream")
            with urllib.request.urlopen(urllib.request.Request(r.url, r.data, r.headers, method=r.method), timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace"), None
        except (OSError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(*x) for x in zip(b["engine"], b["content"], b["content_type"])]
            yield b[rest].assign(body=[g[0] for g in got], error=[g[1] for g in got])

    kinds = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in rest)
    return read(images.mapInPandas(run, f"{kinds}, body string, error string"), configs)
