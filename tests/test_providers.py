import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.functions import structured
from quillspark.operators import inference, layout, prompts, providers
from quillspark.sources import documents


@pytest.fixture(scope="module")
def server():
    class Answers(BaseHTTPRequestHandler):
        calls: list = []

        def answer(self, status, body):
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "image/png; x=1" if isinstance(body, bytes) else "application/json")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.answer(*{"/api/tags": (200, {"models": [{"name": "a"}, {"name": ""}, {}]}), "/v1/models": (200, {"data": [{"id": "b"}, 3, {"id": None}]}), "/file.png": (200, b"\x89PNG\r\n\x1a\n1"), "/none": (200, b"")}.get(self.path, (404, {})))

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.calls.append((self.path, body, self.headers.get("Authorization")))
            model = body["model"]
            if self.path == "/api/show":
                return self.answer(200, {"capabilities": ["completion", *(["vision"] if model == "a" else [])]})
            if model == "blind":
                return self.answer(400, {"error": "Invalid Type: image url"})
            if model == "busy":
                return self.answer(500, {"error": "vision"})
            text = "" if model == "mute" else f"seen by {model}"
            self.answer(200, {"message": {"content": text}} if self.path == "/api/chat" else {"choices": [{"message": {"content": text}}]})

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", Answers.calls
    http.shutdown()


def test_clients(server):
    url, calls = server
    local, chat = providers.LocalServer(url + "/"), providers.ChatServer(f"{url}/v1", api_key="k")
    assert local.list_models() == ["a"] and chat.list_models() == ["b"]
    assert local.supports_vision("a") and not local.supports_vision("z")
    assert local.run(b"img", "say", "a", 9) == "seen by a"
    path, body, _ = calls[-1]
    assert path == "/api/chat" and body["options"] == {"temperature": 0, "num_ctx": 9} and not body["stream"]
    assert body["messages"] == [{"role": "user", "content": "say", "images": [base64.b64encode(b"img").decode()]}]
    assert chat.run(b"img", "say", "b", 9) == "seen by b"
    path, body, key = calls[-1]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["max_tokens"] == 9 and body["temperature"] == 0
    for client in (local, chat):
        for model in ("mute", "busy"):
            with pytest.raises(providers.ProviderError):
                client.run(b"img", "say", model)
    with pytest.raises(providers.ProviderError):
        providers.LocalServer("http://127.0.0.1:1", 0.5).list_models()


def test_what_sees_images(server):
    url, calls = server
    chat = providers.ChatServer(f"{url}/v1/")
    n = len(calls)
    assert chat.supports_vision("llava") and not chat.supports_vision("bge-m3") and len(calls) == n
    assert [chat.supports_vision(m) for m in ("some", "blind", "mute", "busy")] == [True, False, False, True]
    assert len(calls) == n + 4 and base64.b64decode(calls[-1][1]["messages"][0]["content"][1]["image_url"]["url"].split(",")[1]).startswith(b"\x89PNG")
    assert chat.supports_vision("some") and len(calls) == n + 4  # remembered
    assert providers.ChatServer(url, probe=False).supports_vision("other") and not providers.ChatServer(url, vision_models=("x",)).supports_vision("llava")
    assert not providers.ChatServer("http://127.0.0.1:1", 0.5).supports_vision("other")


def test_registry(server):
    url, _ = server
    r = providers.Registry.of({"ollama": {"base_url": url}, "extra": {"kind": "openai_compatible", "base_url": f"{url}/v1"}}, "ollama", "m")
    name = lambda *a: r.resolve(*a)[:2]
    assert name() == ("ollama", "m") and name("Extra/x/y") == ("extra", "x/y") and name("hub/x") == ("ollama", "hub/x")
    assert name("x", " EXTRA ") == ("extra", "x") and name("extra/") == ("ollama", "extra/")
    assert isinstance(r.resolve("x", "extra")[2], providers.ChatServer) and r.describe() == [("extra", False), ("ollama", True)]
    with pytest.raises(ValueError):
        r.resolve("x", "none")
    with pytest.raises(ValueError):
        providers.Registry.of({"none": {}}, "none", "m")


def test_rows_through_a_client(spark, server):
    url, _ = server
    rows = spark.createDataFrame([(1, bytearray(b"i"), "say", "a", 5), (2, bytearray(b"i"), "say", "mute", 5)], "id int, content binary, prompt string, model string, max_tokens int")
    got = {r.id: r for r in inference.complete(rows, lambda: providers.LocalServer(url)).collect()}
    assert got[1].output == "seen by a" and got[1].error is None and got[2].output is None and "empty answer" in got[2].error


def test_urls_and_examples(spark, server):
    url, _ = server
    rows = spark.createDataFrame([(f" {url}/file.png",), (f"{url}/none",), (f"{url}/gone",), ("file:///etc/hostname",), (None,)], "url string")
    got = [(bytes(r.content) if r.content is not None else None, r.declared, r.error and r.error.split(":")[0]) for r in documents.fetch(rows.coalesce(1)).collect()]
    assert got == [(b"\x89PNG\r\n\x1a\n1", "image/png; x=1", None), (b"", "image/png; x=1", "empty"), (None, None, "HTTPError"), (None, None, "no URL"), (None, None, "no URL")]
    assert documents.example_files([("A", "/x/a.png"), ("", "/x/b.png"), ("C", " ")]) == [("A", "/x/a.png"), ("b.png", "/x/b.png")]
    with pytest.raises(ValueError):
        documents.example_files([("", f"/{i}") for i in range(4)])


def test_prompts():
    assert set(prompts.RETRIES) == set(inference.TASKS) == {*prompts.PROMPTS, "ocr_text"} and all(len(x) == 2 for x in prompts.RETRIES.values())
    assert prompts.prompt("ocr_text", "Lies.") == "Lies." and prompts.prompt("describe_image", "Lies.", " own ") == "own" and prompts.prompt("describe_image", "Lies.", " ") == prompts.PROMPTS["describe_image"]
    got = prompts.structured("receipt_basic", "{schema_name}|{field_names}|{schema_json}")
    assert got.startswith("receipt_basic|merchant, date, total, tax, currency|{\n") and json.loads(got.split("|")[2]) == structured.SCHEMAS["receipt_basic"]
    assert all(f"- {n}: " in prompts.schema_selection() for n in structured.SCHEMAS)
    for bad in (lambda: prompts.prompt("none", "x"), lambda: prompts.structured("none", "x")):
        with pytest.raises(ValueError):
            bad()


def test_region_counts_and_polygons(spark):
    pages = spark.createDataFrame([(1, ["a", "b"]), (1, None), (2, [])], "doc_id int, regions array<string>")
    assert {r.doc_id: (r.regions, r.pages, r.warning) for r in layout.region_count(pages).collect()} == {1: (2, 2, "Document layout: 2 regions detected on 2 page(s)."), 2: (0, 1, "Document layout: 0 regions detected on 1 page(s).")}
    boxes = F.array(*(F.array(*map(F.lit, map(float, b))) for b in ((0, 0, 9, 9), (10, 10, 20, 20), (10.5, 10, 20, 20))))
    polygons = F.array(*(F.array(*(F.lit(float(i)) for _ in range(8))) for i in range(3)))
    near = lambda *b: layout.original_polygon(F.array(*map(F.lit, map(float, b))), boxes, polygons)
    got = spark.range(1).select(near(10.9, 9.5, 20, 20.9), near(50, 50, 60, 70)).first()
    assert got[0] == [1.0] * 8 and got[1] == [50.0, 50.0, 60.0, 50.0, 60.0, 70.0, 50.0, 70.0]
