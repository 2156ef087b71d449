"""Model providers over HTTP, their registry, and whether a model sees images.

Clients use the standard library only, are picklable, and serve as factories' products in
``operators.inference``: each task makes one and feeds it its rows. Whether a model sees images is asked
once per process, server and model.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from dataclasses import dataclass, field
from urllib import error, request

from quillspark.functions import text as T
from quillspark.operators import inference


class ProviderError(RuntimeError):
    pass


def _ask(url: str, body: dict | None = None, key: str = "", timeout: float = 120.0) -> tuple[int, str]:
    """(status, body); refused connections and time-outs are errors, refusing answers aren't."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with request.urlopen(request.Request(url, None if body is None else json.dumps(body).encode(), head), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except OSError as e:
        raise ProviderError(f"{url}: {e}") from e


def _good(url: str, body: dict | None = None, key: str = "", timeout: float = 120.0) -> dict:
    status, text = _ask(url, body, key, timeout)
    if status >= 400:
        raise ProviderError(f"{url}: {status}")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ProviderError(f"{url}: no JSON") from e
    return found if isinstance(found, dict) else {}


def _content(message) -> str:
    text = message.get("content") if isinstance(message, dict) else None
    if not isinstance(text, str) or not text.strip():
        raise ProviderError("empty answer")
    return text


def pixel() -> bytes:
    """A PNG of one white pixel."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\xff\xff\xff")) + chunk(b"IEND", b"")


_seen: dict[tuple[str, str], bool] = {}


def _named(model: str) -> bool | None:
    """As ``text.vision_by_name``, of one name."""
    name = model.strip()
    return False if re.search(T.NO_VISION_NAMES, name) else True if re.search(T.VISION_NAMES, name) else None


@dataclass
class LocalServer:
    """A server that lists models under /api/tags, tells their capabilities and chats with images."""

    base_url: str
    timeout: float = 120.0

    def list_models(self) -> list[str]:
        return [m["name"] for m in _good(f"{self.base_url.rstrip('/')}/api/tags", timeout=self.timeout).get("models") or [] if m.get("name")]

    def supports_vision(self, model: str) -> bool:
        return "vision" in (_good(f"{self.base_url.rstrip('/')}/api/show", {"model": model}, timeout=self.timeout).get("capabilities") or [])

    def run(self, image: bytes, prompt: str, model: str, max_tokens: int | None = None) -> str:
        message = {"role": "user", "content": prompt, "images": [base64.b64encode(image).decode()]}
        options = {"temperature": 0} | ({} if max_tokens is None else {"num_ctx": max_tokens})
        return _content(_good(f"{self.base_url.rstrip('/')}/api/chat", {"model": model, "stream": False, "options": options, "messages": [message]}, timeout=self.timeout).get("message"))


@dataclass
class ChatServer:
    """A server of chat completions. What sees images: the list given, else by name, else by trial, else all."""

    base_url: str
    timeout: float = 120.0
    api_key: str = field(default="", repr=False)
    vision_models: tuple[str, ...] = ()
    probe: bool = True

    def _url(self, path: str) -> str:
        return f"{self.base_url.rstrip('/')}/{path}"

    def _body(self, image: bytes, prompt: str, model: str, max_tokens: int | None) -> dict:
        parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{base64.b64encode(image).decode()}"}}]
        return {"model": model, "temperature": 0, "messages": [{"role": "user", "content": parts}]} | ({} if max_tokens is None else {"max_tokens": max_tokens})

    def list_models(self) -> list[str]:
        found = _good(self._url("models"), None, self.api_key, self.timeout).get("data")
        return [m["id"] for m in found if isinstance(m, dict) and isinstance(m.get("id"), str) and m["id"]] if isinstance(found, list) else []

    def supports_vision(self, model: str) -> bool:
        if self.vision_models:
            return model in self.vision_models
        at = (self.base_url.rstrip("/"), model.strip())
        if at not in _seen:
            named = _named(model)
            if named is None and not self.probe:
                return True
            _seen[at] = self._tried(model) if named is None else named
        return _seen[at]

    def _tried(self, model: str) -> bool:
        """A pixel is shown: an answer with text, or a refusal that isn't about images, means yes."""
        try:
            status, text = _ask(self._url("chat/completions"), self._body(pixel(), "Reply with the single character x.", model, 16), self.api_key, self.timeout)
        except ProviderError:
            return False
        if status >= 400:
            return not (status in T.NO_VISION_STATUS and any(m in text.lower() for m in T.NO_VISION_MARKERS))
        try:
            return bool(self._answer(json.loads(text)))
        except (ProviderError, ValueError):
            return False

    def _answer(self, found) -> str:
        choices = found.get("choices") if isinstance(found, dict) else None
        if not isinstance(choices, list) or not choices or not isinstance(choices[0], dict):
            raise ProviderError("no choices")
        return _content(choices[0].get("message"))

    def run(self, image: bytes, prompt: str, model: str, max_tokens: int | None = None) -> str:
        return self._answer(_good(self._url("chat/completions"), self._body(image, prompt, model, max_tokens), self.api_key, self.timeout))


#: Kinds of provider by id; others can be added.
KINDS = {"ollama": LocalServer, "openai_compatible": ChatServer}


@dataclass
class Registry:
    """Clients by provider id, with a default provider and model."""

    clients: dict[str, inference.Client]
    default_provider: str
    default_model: str

    @classmethod
    def of(cls, settings: dict[str, dict], default_provider: str, default_model: str) -> Registry:
        """From the arguments of each provider's client; ``kind`` names its class where the id doesn't."""
        clients = {}
        for name, own in settings.items():
            kind = own.get("kind", name)
            if kind not in KINDS:
                raise ValueError(f"unknown provider: {kind}")
            clients[name] = KINDS[kind](**{k: v for k, v in own.items() if k != "kind"})
        return cls(clients, default_provider, default_model)

    def get(self, provider: str) -> inference.Client:
        if provider not in self.clients:
            raise ValueError(f"provider {provider} isn't configured, only {', '.join(sorted(self.clients))}")
        return self.clients[provider]

    def resolve(self, model: str | None = None, provider: str | None = None) -> tuple[str, str, inference.Client]:
        """(provider, model, client): of provider/model, else of the provider given, else of the defaults."""
        whole = (model or "").strip()
        head, slash, tail = whole.partition("/")
        if slash and tail and head.lower() in self.clients:
            chosen, name = head.lower(), tail
        else:
            chosen, name = (provider or "").strip().lower() or self.default_provider, whole
        return chosen, name or self.default_model, self.get(chosen)

    def describe(self) -> list[tuple[str, bool]]:
        return [(name, name == self.default_provider) for name in sorted(self.clients)]
