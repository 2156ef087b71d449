import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.operators import engines, matching

WORD = {"content": "a", "polygon": [0, 0, 500, 0, 500, 500, 0, 500], "confidence": 0.5}
ANSWERS = {
    "/formrecognizer/": {"status": "succeeded", "analyzeResult": {"content": "from pages", "pages": [{"width": 1000, "height": 500, "words": [WORD]}]}},
    "/annotate": {"responses": [{"fullTextAnnotation": {"text": "annotated", "pages": [{"width": 10, "height": 10, "blocks": [{"paragraphs": [{"words": [{"symbols": [{"text": "x"}, {"text": "y"}]}]}]}]}]}}]},
    "/api/ocr": {"text": "a peer's", "layout": [{"word_polys": [WORD]}, {}], "analyzeResult": {"pages": [{"words": []}]}},
    "/plain": {"result": "plain"},
}


@pytest.fixture
def server():
    seen: list = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, dict(self.headers), body))
            found = next((v for k, v in ANSWERS.items() if self.path.startswith(k)), None)
            self.send_response(200 if found else 500)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_engines_are_asked_and_read(spark, server):
    uri, seen = server
    configs = {"azure": {"endpoint": f"{uri}/", "key": "k"}, "google_vision": {"api_key": "g", "url": f"{uri}/annotate"}, "self_peer": {"base_url": uri, "model": "m"}, " Plain_Text": {"url": f"{uri}/plain", "text_field": "result", "auth_header": "X-Key", "auth_value": "s"}}
    rows = [(i, n, bytearray(b"img"), "image/png") for i, n in enumerate([*configs, "azure", "other"])]
    got = {r.id: r for r in engines.analyze(spark.createDataFrame(rows, "id int, engine string, content binary, content_type string"), configs).collect()}
    assert [got[i].text for i in range(6)] == ["from pages", "annotated", "a peer's", "plain", "from pages", ""]
    assert got[0]["words"][0][0].polygon == [0, 0, 500, 0, 500, 1000, 0, 1000] and got[1]["words"][0][0].content == "xy"
    assert [len(p) for p in got[2]["words"]] == [1, 0] and got[3]["words"] == [] and "unknown engine" in got[5].error and got[0].error is None
    heads = {p.split("?")[0]: (h, b) for p, h, b in seen}
    assert heads["/plain"][0]["X-Key"] == "s" and b'name="model"\r\n\r\nm' in heads["/api/ocr"][1] and b"img" in heads["/api/ocr"][1]
    failed = engines.analyze(spark.createDataFrame([("plain_text", bytearray(b""), None)], "engine string, content binary, content_type string"), {"plain_text": {"url": f"{uri}/gone"}}).first()
    assert failed.error.startswith("HTTPError") and failed.text == ""


def test_the_registry(spark):
    assert [n for n, _ in engines.available()][:2] == ["azure", "self_peer"] and engines.engine(None).name == "azure" and engines.engine(" AZURE ").name == "azure"
    with pytest.raises(ValueError, match="unknown"):
        engines.engine("none")
    with pytest.raises(ValueError, match="endpoint, key"):
        engines.checked({"azure": {"endpoint": " "}})
    engines.register(engines.Engine("upper", "Capitals", None, lambda b, c: F.upper(b), engines._none))
    got = engines.read(spark.createDataFrame([("upper", "abc"), ("upper", None), ("?", "x")], "engine string, body string").coalesce(1), {"upper": {}}).collect()
    assert [r.text for r in got] == ["ABC", "", ""] and ("upper", "Capitals") in engines.available()
    del engines._registry["upper"]


def test_polygons_of_mixed_input(spark):
    rows = ["[0,0,1,0,1.5,1,0,1]", "[[0,0],[1,0],[1,1],[0,1]]", "[0,0,1,0,1,1,0]", "[[0,0],[1,0],[1,1]]", "[[0,0],[1],[1,1],[0,1]]", "[0,[1,2],3,4,5,6,7,8]", '["0",0,1,0,1,1,0,1]', "null", "{}", "x", None, "[]", "[0,0,1,0,null,1,0,1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = [r.q for r in df.select("i", G.polygon(F.col("p")).alias("q")).orderBy("i").collect()]
    assert got == [[0, 0, 1, 0, 1.5, 1, 0, 1], [0, 0, 1, 0, 1, 1, 0, 1], *[None] * 11]


def test_tokens_and_polygons_against_loops(spark):
    """Both greedy choices as they are written: in order, the unused one most like it, if by 70 or more."""
    from quillspark.functions.editdist import ratio

    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    words = [(p, i, i % 2, rng.choice([word(), word(), ""])) for p in range(4) for i in range(25)]
    regions = [(p, r, " ".join(word() for _ in range(15))) for p in range(4) for r in range(2)]

    def best(text, tokens, used):
        score, at = max(((ratio(text.lower(), t.lower()), -i) for i, t in enumerate(tokens) if i not in used and t), default=(0, 0))
        return -at if score >= 70 else None

    want = {}
    for p, r, content in regions:
        tokens, used = content.split(), set()
        for _, i, _, c in [w for w in words if w[0] == p and w[2] == r]:
            at = best(c, tokens, used) if c else next((k for k in range(len(tokens)) if k not in used), None)
            used |= {at} - {None}
            want[p, i] = c if at is None else tokens[at]
    got = matching.adopt_tokens(spark.createDataFrame(words, "page_id long, word_idx int, region_idx int, content string"), spark.createDataFrame(regions, "page_id long, region_idx int, content string"))
    assert {(r.page_id, r.word_idx): r.content for r in got.collect()} == want
