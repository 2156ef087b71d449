import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import editdist as E
from quillspark.functions import geometry as G
from quillspark.functions import structured as S
from quillspark.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def dynamic(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_distances_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abäß\U0001f600") for _ in range(rng.randint(0, 90))) for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randint(0, len(a))] + b[:3] + a[5:]
        assert E.distance(a, b) == dynamic(a, b)
        assert E.common(a, b) == subsequence(a, b)
        assert E.distance(a.split("a"), b.split("a")) == dynamic(a.split("a"), b.split("a"))
    assert E.ratio("", "") == 100 and E.ratio("a", "") == 0


def test_word_diff_rebuilds_both_sides():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        ops = E.word_diff(a, b)
        assert [w for o, w in ops if o != "ins"] == a and [w for o, w in ops if o != "del"] == b
        assert sum(o == "eq" for o, _ in ops) == subsequence(a, b)


def test_error_rates(spark):
    rows = [("abc", "abd"), ("", ""), ("", "x"), (None, "x"), ("a", "abcd"), ("ein Wort\tmehr", "ein wort mehr")]
    got = values(spark, rows, "r string, h string", E.cer(F.col("r"), F.col("h")), E.wer(F.col("r"), F.col("h")), E.normalised(F.col("r"), F.col("h")))
    assert got[0] == pytest.approx((1 / 3, 1.0, 1 / 3))
    assert got[1] == (0, 0, 0) and got[2] == (1, 1, 1) and got[3] == (1, 1, 1)
    assert got[4] == pytest.approx((3.0, 1.0, 0.75)) and got[5][1] == pytest.approx(1 / 3)


def test_tokens_words_lines(spark):
    t = "Müller_2 don't x\n\n  zwei drei  \r\n"
    got = values(spark, [(t,)], "t string", T.tokens(F.col("t")), T.words(F.col("t")), T.lines(F.col("t")), T.strip(F.col("t")))[0]
    assert got[0] == re.findall(r"\w+", t) and got[1] == t.split() and got[2] == [x.strip() for x in t.splitlines() if x.strip()] and got[3] == t.strip()


def test_fences_keys_paragraphs_wrap(spark):
    c = F.col("t")
    fence = [("```json\n{}\n```",), ("  ```\n```",), ("a ```x``` b",), (" plain ",)]
    assert values(spark, fence, "t string", T.unwrap_fence(c), T.is_empty_fence(c)) == [("{}", False), ("", True), ("a ```x``` b", False), ("plain", False)]
    assert values(spark, [(" „Hallo“-Welt! ",), ("",)], "t string", T.diff_key(c)) == [("hallowelt",), ("",)]
    got = values(spark, [("a\n\nb\n \n\nc",), ("x\ny",), ("\n".join(map(str, range(13))),), (" ",)], "t string", T.paragraphs(c))
    assert [len(g[0]) for g in got] == [3, 2, 1, 0]
    assert values(spark, [("aaa bbb cc d",), ("abcdefgh i",), ("",)], "t string", T.wrap(c, 7)) == [(["aaa bbb", "cc d"],), (["abcdefgh", "i"],), ([],)]
    assert values(spark, [("a\x00b\n",), ("",)], "t string", T.garbage_ratio(c)) == [(0.4,), (0.0,)]
    assert values(spark, [("a\U0001f600",)], "t string", T.unit_length(c), T.unit_length(c, "utf16CodeUnit")) == [(2, 3)]
    assert values(spark, [("<td>a&amp;b</td>\n<b> c</b>",)], "t string", T.strip_markup(c)) == [("a&b\nc",)]


def test_output_predicates(spark):
    prompt = "Extrahiere sichtbaren Text exakt mit Zeilenumbrüchen. Bild nicht beschreiben."
    rows = [(prompt, prompt.upper()), (prompt, "Extrahiere sichtbaren Text"), (prompt, "Rechnung 4711 vom 3. Mai"), (prompt, ""), (prompt, "task rules output"), (prompt, "please: plain text only, dear")]
    assert [r[0] for r in values(spark, rows, "p string, o string", T.prompt_echo(F.col("p"), F.col("o")))] == [True, True, False, False, True, True]
    c = F.col("t")
    assert [r[0] for r in values(spark, [("Das  Bild\nzeigt Katzen",), ("Katzen",)], "t string", T.image_description(c))] == [True, False]
    assert [r[0] for r in values(spark, [("",), ("Kein sichtbarer Text.",), ("Text",)], "t string", T.no_visible_text(c))] == [True, True, False]
    rows = [("Nr: 1\nTotal: 2\nSumme = 3",), ("one line",), ("This is a long sentence that goes on and on.\nAnd so does this one here, really.",), ("RECHNUNG\nKUNDE 12",), ("a: 1\nb 2",)]
    assert [r[0] for r in values(spark, rows, "t string", T.ocr_transcript(c))] == [True, False, False, True, True]


def test_names_and_specs(spark):
    c = F.col("t")
    got = values(spark, [("ollama/llava:7b",), ("org/model",), (" m ",)], "t string", T.model_ref(c, F.lit(None).cast("string"), F.lit("ollama"), ("ollama", "openai")))
    assert [tuple(g[0]) for g in got] == [("ollama", "llava:7b"), ("ollama", "org/model"), ("ollama", "m")]
    got = values(spark, [("m::expert",), ("m::direct",), ("m",)], "t string", T.runner_spec(c, F.lit("direct")))
    assert [tuple(g[0]) for g in got] == [("m", "expert", "m (Layout)"), ("m", "direct", "m (Plain)"), ("m", "direct", "m")]
    assert [r[0] for r in values(spark, [("1,3-5",), ("",), ("2, 2",)], "t string", T.pages_spec(c))] == [[1, 3, 4, 5], None, [2]]
    for bad in ("0", "5-3", "x", "1,,-"):
        with pytest.raises(Exception):
            values(spark, [(bad,)], "t string", T.pages_spec(c))
    assert [r[0] for r in values(spark, [("fr-CH, en;q=0.9",), (" DE_de",), ("fr",), (None,)], "t string", T.locale(c))] == ["en", "de", "en", "en"]
    assert [r[0] for r in values(spark, [("de",), ("",), (None,)], "t string", T.locale(F.lit("en"), F.lit("de-AT"), F.when(c == "de", "en").otherwise(c)))] == ["en", "de", "de"]
    names = {"bge-m3": False, "guard-3": False, "asr-large": False, "text-only-vision": False, "gpt-4o": None, "cogvlm": True, "fuyu-8b": True, "a/vl-7b": True, "x-vl": True, "vlx": None, " ": None}
    assert [r[0] for r in values(spark, [(n,) for n in names], "t string", T.vision_by_name(c))] == list(names.values())
    bodies = ("invalid type", "Content Type", "vision", "unsupported", "does not support", "image url", "other")
    assert [r[0] for r in values(spark, [(n,) for n in bodies], "t string", T.lacks_vision(F.lit(400), c))] == [True] * 6 + [False]
    assert [r[0] for r in values(spark, [("ab\x7f\x85",), ("a\x01\ue000b",)], "t string", T.garbage_ratio(c))] == [0.0, 0.5]
    assert [r[0] for r in values(spark, [("qwen2.5-vl",), ("nomic-embed-vision",), ("mistral",)], "t string", T.vision_by_name(c))] == [True, False, None]
    m = F.create_map(F.lit("n"), F.lit("3"))
    assert values(spark, [("page {n}",)], "t string", T.translate(c, m), T.page_prefix(c, F.lit(2), F.lit(3)), T.page_prefix(c, F.lit(1), F.lit(1))) == [("page 3", "Seite 2: page {n}", "page {n}")]


def test_structured(spark):
    rows = [('```json\n{"a": "x", "b": null, "z": 1}\n```',), ('so {"a": [1, {"c": "}"}], "b": "y"} ok',), ("{broken",), ('{"a": }',), ("nothing",), (None,)]
    got = [r[0] for r in values(spark, rows, "t string", S.parse(F.col("t"), ["a", "b"]))]
    assert got[0]["data"] == {"a": '"x"', "b": None} and got[0]["warnings"] == [S.MISSING + "b", S.EXTRA + "z"]
    assert got[1]["data"] == {"a": '[1,{"c":"}"}]', "b": '"y"'} and got[1]["warnings"] == []
    assert [g["warnings"] for g in got[2:]] == [[S.NO_OBJECT], [S.BAD_JSON], [S.NO_OBJECT], [S.NO_OBJECT]] and all(g["data"] is None for g in got[2:])
    pages = [[{"t": '""', "r": '["a","b"]'}, {"t": '"x"', "r": '"c"'}, {"t": '"y"', "r": '["a"]'}]]
    got = values(spark, [(pages[0],)], "p array<map<string,string>>", S.merge(F.col("p"), {"t": "string", "r": "array<string>"}))[0][0]
    assert got["data"] == {"t": '"x"', "r": '["a","b","c"]'} and len(got["warnings"]) == 1 and "Seite 3" in got["warnings"][0]
    assert [r[0] for r in values(spark, [("`receipt_basic`!",), ("I say table_basic",), ("?",)], "t string", S.choose_schema(F.col("t")))] == ["receipt_basic", "table_basic", None]
    assert values(spark, [({"a": " X ", "b": None}, {"a": "x"}), ({}, {"a": "x"})], "r map<string,string>, p map<string,string>", S.field_accuracy(F.col("r"), F.col("p"))) == [(1.0,), (1.0,)]


def test_geometry(spark):
    box = [([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0])]
    a, b = F.col("a"), F.col("b")
    got = values(spark, box, "a array<double>, b array<double>", G.iou(a, b), G.iou(b, a), G.iou_pixels(a, b), G.contained(a, b), G.intersection(a, b), G.distance(a, b), G.unclip(a, 2.0, 1.0))[0]
    assert got[0] == got[1] == pytest.approx(25 / 175) and got[2] == pytest.approx(36 / (121 + 121 - 36))
    assert got[3] is False and got[4] == [5, 5, 10, 10] and got[5] == pytest.approx(50**0.5) and got[6] == [-5, 0, 15, 10]
    tilted = [([48.0, 12.0, 50.0, 50.0, 12.0, 48.0, 10.0, 10.0],)]
    q = values(spark, tilted, "p array<double>", G.quad(F.col("p")), G.bounds(F.col("p")))[0]
    assert [tuple(q[0][k]) for k in ("tl", "tr", "br", "bl")] == [(10, 10), (48, 12), (50, 50), (12, 48)] and q[1] == [10, 10, 50, 50]
    got = values(spark, [("0.5",), ("nan",), ("1.5",), ("x",), (None,)], "t string", G.confidence(F.col("t")))
    assert [g[0] for g in got] == [0.5, None, None, None, None]
    got = values(spark, [(10, 3), (3, 5), (10, 1), (0, 4)], "n int, k int", G.sample_indices(F.col("n"), F.col("k")))
    assert [g[0] for g in got] == [[0, 4, 9], [0, 1, 2], [0], []]
    assert values(spark, [(7200, 10)], "w int, h int", G.dims_within(F.col("w"), F.col("h"), 3600))[0][0].asDict() == {"width": 3600, "height": 5}
    assert values(spark, [(0.5,)], "x double", G.per_mille(F.lit(333.9), F.lit(1000)))[0][0] == 333
