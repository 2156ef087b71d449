"""Text functions and output predicates as native columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and templates that results must contain or recognise.
INSTRUCTION_MARKERS = ("task", "rules", "output", "regeln", "gib", "extrahiere", "beschreibe", "do not")
INSTRUCTION_FRAGMENTS = (
    "nur klartext", "klartext zurueckgeben", "klartext zurückgeben", "only plain text", "plain text only", "antworte auf deutsch",
    "answer in german", "das bild nicht beschreiben", "wenn kein text sichtbar ist", "gib exakt aus", "exactly ausgeben",
)
DESCRIPTION_MARKERS = (
    "das bild zeigt", "auf dem bild", "im bild ist", "im bild sind", "this image shows", "the image shows", "in the image", "a photo of", "an image of",
)
NO_TEXT_MARKERS = ("kein sichtbarer text", "kein text sichtbar", "no visible text", "no text visible")
EMPTY_OUTPUT_TEXTS = {
    "ocr_text": "Kein verwertbarer OCR-Text erkannt.",
    "describe_image": "Keine verwertbare Bildbeschreibung erzeugt.",
    "read_scene_text": "No visible text.",
    "table_markdown": "No table detected.",
    "summarize_document": "Kein lesbarer Inhalt.",
}
# What names of models and answers of providers say about images.
VISION_NAMES = r"(?i)(vision|[-_/]vl[-_/]|[-_]vl$|^vl[-_/]|llava|glm-ocr|qwen[-_]?\d*[-_]?vl|internvl|minicpm[-_]?v|pixtral|moondream|bakllava|cogvlm|idefics|fuyu|llama[-_]?3\.2[-_]vision|gemma[-_]?3.*vision)"
NO_VISION_NAMES = r"(?i)(embed|embedding|whisper|rerank|guard|moderation|text[-_]?only|speech|tts|asr|bge-|e5-|nomic-embed)"
NO_VISION_STATUS = (400, 404, 422)
NO_VISION_MARKERS = ("multimodal", "image_url", "image url", "vision", "does not support", "not support", "unsupported", "invalid type", "content type")
# The languages of messages; any other falls back to the first.
LOCALES = ("en", "de")
# Letters and numbers of Unicode 14 and 15, which the JVM's tables (13 under Java 17) don't have, unlike those of Python and DuckDB.
_NEWER = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a "
    "1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 "
    "1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 "
    "1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb "
    "1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
_NEWER = re.sub("[0-9a-f]+", lambda m: rf"\x{{{m[0]}}}", _NEWER).replace(" ", "")
_WORD = r"[\p{L}\p{N}_[\x{870}-\x{323af}&&[" + _NEWER + "]]]+"  # the outer range spares other characters the list
_SPACE = r"[\s\u0085\u001c-\u001f\p{Z}]"
#: White space of SQL's regular expressions.
SQL_SPACE = r"[\t\n\f\r ]"
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
_FENCE = r"(?s)^```[\p{L}\p{N}_.+-]*(.*)```\z"
_DIFF_PUNCTUATION = r"[\s ​\.,;:!?\"'`´‘’“”„‚()\[\]{}<>/\\|_*-]+"
_GARBAGE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}\x{100000}-\x{10fffd}]"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def given(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip_of(c: Column, space: str) -> Column:
    """Without characters of the class ``space`` at both ends."""
    return F.regexp_replace(c, rf"^{space}+|{space}+\z", "")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return strip_of(c, _SPACE)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, the ends none."""
    return strip(F.regexp_replace(c, f"{_SPACE}+", " "))


def tokens(c: Column) -> Column:
    """Unicode word tokens, case kept."""
    return F.regexp_extract_all(c, F.lit(f"({_WORD})"), F.lit(1))


def words(c: Column) -> Column:
    """Pieces between white space."""
    return F.regexp_extract_all(c, F.lit(r"([^\s\u0085\u001c-\u001f\p{Z}]+)"), F.lit(1))


def lines(c: Column, blank: bool = False) -> Column:
    """Stripped lines, those without text left out unless ``blank``."""
    parts = F.transform(F.split(c, _LINE), strip)
    return parts if blank else F.filter(parts, lambda x: x != "")


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, (c.contains(p) for p in phrases))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def unwrap_fence(c: Column, space: str = _SPACE) -> Column:
    """Model output without a fence around all of it."""
    whole = strip_of(c, space)
    return F.when(whole.rlike(_FENCE), strip_of(F.regexp_extract(whole, _FENCE, 1), space)).otherwise(whole)


def is_empty_fence(c: Column, space: str = _SPACE) -> Column:
    whole = strip_of(c, space)
    return (whole != "") & whole.rlike(_FENCE) & (strip_of(F.regexp_extract(whole, _FENCE, 1), space) == "")


def diff_key(c: Column) -> Column:
    """Lower case, punctuation and white space deleted."""
    return F.regexp_replace(strip(F.lower(c)), _DIFF_PUNCTUATION, "")


def garbage_ratio(c: Column) -> Column:
    """Share of control and private-use characters; 0 of an empty text."""
    return safe_div(F.regexp_count(c, F.lit(_GARBAGE)).cast("double"), F.length(c).cast("double"))


def unit_length(c: Column, unit: str = "textElements") -> Column:
    """Length in code points or, for utf16CodeUnit, in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int") if unit == "utf16CodeUnit" else F.length(c)


def prompt_echo(prompt: Column, output: Column) -> Column:
    """Whether a model gave back its instructions: equality, prefixes, containment, markers, fragments, overlap."""
    plain = lambda c: squeeze(F.regexp_replace(F.lower(strip(c)), "[^0-9a-zA-ZäöüÄÖÜß]+", " "))
    long = lambda c: F.filter(F.split(c, " "), lambda t: F.length(t) >= 3)

    def overlap(mine: Column, theirs: Column) -> Column:
        shared = F.size(F.filter(mine, lambda t: F.array_contains(theirs, t)))
        return (F.size(theirs) > 0) & (safe_div(shared.cast("double"), F.size(mine).cast("double")) >= 0.72)

    def echoes(p: Column, o: Column) -> Column:
        np, no = F.length(p), F.length(o)
        enough = F.greatest(F.lit(12), F.floor(np * 0.35).cast("int"))
        hits = reduce(lambda a, b: a + b, (o.contains(m).cast("int") for m in INSTRUCTION_MARKERS))
        rules = [
            o == p,
            (no >= 12) & p.startswith(o),
            (np >= 12) & o.startswith(p),
            (no >= enough) & p.contains(o),
            (np >= enough) & o.contains(p),
            (hits >= 2) & (F.size(F.split(o, " ")) <= 34),
            contains_any(o, INSTRUCTION_FRAGMENTS),
            given(long(o), lambda mine: F.size(mine).between(1, 24) & given(F.array_distinct(long(p)), lambda theirs: overlap(mine, theirs))),
        ]
        return (p != "") & (o != "") & reduce(or_, rules)

    return given(plain(prompt), lambda p: given(plain(output), lambda o: echoes(p, o)))


def image_description(output: Column) -> Column:
    return contains_any(squeeze(F.lower(output)), DESCRIPTION_MARKERS)


def no_visible_text(output: Column) -> Column:
    plain = squeeze(F.lower(output))
    return (plain == "") | contains_any(plain, NO_TEXT_MARKERS)


def ocr_transcript(output: Column) -> Column:
    """Whether an output looks like transcribed lines: short lines with figures, fields or capitals."""
    is_upper = lambda x: (F.length(x) >= 6) & (F.regexp_count(x, F.lit(r"\p{Lu}")) > 0.6 * F.greatest(F.lit(1), F.regexp_count(x, F.lit(r"\p{L}"))))
    tests = {"short": lambda x: F.size(words(x)) <= 5, "numeric": lambda x: x.rlike(r"\p{Nd}"), "fields": lambda x: x.rlike(r"[:#=/|]"), "upper": is_upper}

    def transcribed(c: Column) -> Column:
        n, short, numeric, fields, upper = (c[x] for x in ("n", *tests))
        rules = [
            (short >= F.greatest(F.lit(3), F.floor(n * 0.6).cast("int"))) & ((numeric >= 2) | (fields >= 2)),
            (n == 2) & (numeric >= 1) & (fields >= 1) & (short == 2),
            (numeric >= 3) & (fields >= 1),
            (upper >= 2) & (numeric >= 1),
        ]
        return reduce(or_, rules)

    counts = lambda all_: F.struct(F.size(all_).alias("n"), *(F.size(F.filter(all_, test)).alias(name) for name, test in tests.items()))
    return given(lines(output), lambda all_: (F.size(all_) >= 2) & given(counts(all_), transcribed))


def empty_output_text(task: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EMPTY_OUTPUT_TEXTS.items() for x in kv)), task), F.lit(""))


def page_prefix(warning: Column, page: Column, pages: Column) -> Column:
    return F.when(pages > 1, F.concat(F.lit("Seite "), page.cast("string"), F.lit(": "), warning)).otherwise(warning)


def wrap(c: Column, width: Column | int) -> Column:
    """Greedy word wrap: an array of lines of about ``width`` characters."""
    width = F.lit(width) if isinstance(width, int) else width
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        fits = (acc["line"] == "") | (F.length(acc["line"]) + 1 + F.length(w) <= width)
        return F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line"))).when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["line"], w).alias("line"))).otherwise(F.struct(F.array_append(acc["done"], acc["line"]).alias("done"), w.alias("line")))

    return F.aggregate(words(c), start, add, lambda a: F.filter(F.array_append(a["done"], a["line"]), lambda x: x != ""))


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines if there are several; else 2 to 12 lines; else the whole."""
    blocks = lambda whole: F.filter(F.transform(F.split(whole, "\n\n"), strip), lambda x: x != "")
    by_line = lambda whole: given(lines(whole), lambda rows: F.when(F.size(rows).between(2, 12), rows).otherwise(F.array(whole)))
    by_block = lambda whole: given(blocks(whole), lambda own: F.when(F.size(own) > 1, own).otherwise(by_line(whole)))
    return given(strip(c), lambda whole: F.when(whole == "", F.array().cast("array<string>")).otherwise(by_block(whole)))


def page_content(regions: Column) -> Column:
    """Contents of regions that have any, one under the other."""
    own = F.filter(F.transform(regions, lambda r: strip(text(r["content"]))), lambda x: x != "")
    return F.coalesce(strip(F.array_join(own, "\n")), F.lit(""))


def strip_markup(c: Column) -> Column:
    """Tags become spaces, entities characters; blank lines go."""
    plain = unescape(F.regexp_replace(c, "<[^>]+>", " "))
    own = F.transform(F.split(plain, _LINE), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(own, lambda x: x != ""), "\n")


def unescape(c: Column) -> Column:
    """The common named character references and none other; ``&amp;`` last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " "), ("auml", "ä"), ("ouml", "ö"), ("uuml", "ü"), ("szlig", "ß"), ("euro", "€"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def model_ref(model: Column, provider: Column, default: Column, providers: tuple[str, ...]) -> Column:
    """struct(provider, model): ``provider/model`` where the first part is a known provider, else the given or default one."""
    whole = strip(text(model))
    head, tail = F.lower(F.split_part(whole, F.lit("/"), F.lit(1))), F.regexp_replace(whole, "^[^/]*/", "")
    qualified = whole.contains("/") & head.isin(*providers) & (tail != "")
    given = F.nullif(F.lower(strip(text(provider))), F.lit(""))
    return F.struct(F.when(qualified, head).otherwise(F.coalesce(given, default)).alias("provider"), F.when(qualified, tail).otherwise(whole).alias("model"))


def format_model_ref(provider: Column, model: Column) -> Column:
    return F.concat_ws("/", provider, model)


def runner_spec(spec: Column, default_backend: Column) -> Column:
    """struct(model, backend, label) of ``name::backend``; the label names the backend as Layout or Plain."""
    name, back = F.split_part(spec, F.lit("::"), F.lit(1)), F.lower(F.split_part(spec, F.lit("::"), F.lit(2)))
    chosen = back.isin("direct", "expert")
    backend = F.when(chosen, back).otherwise(default_backend)
    label = F.when(chosen, F.concat(name, F.lit(" ("), F.when(back == "expert", "Layout").otherwise("Plain"), F.lit(")"))).otherwise(name)
    return F.struct(name.alias("model"), backend.alias("backend"), label.alias("label"))


def locale(setting: Column, cookie: Column | None = None, query: Column | None = None) -> Column:
    """The language of the query, else of the cookie, else of the setting: the first of these that isn't empty, as a known one."""
    given = F.coalesce(*(F.nullif(c, F.lit("")) for c in (query, cookie) if c is not None), text(setting))
    own = F.lower(strip(given))
    return F.coalesce(*(F.when(own.startswith(x), x) for x in LOCALES[1:]), F.lit(LOCALES[0]))


def translate(message: Column, arguments: Column) -> Column:
    """A message with each ``{name}`` replaced by the map's value."""
    return F.aggregate(F.map_entries(arguments), message, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def pages_spec(spec: Column) -> Column:
    """The sorted page numbers of ``1,3-5``; null for an empty spec (all pages); a bad spec raises an error."""
    parts = F.filter(F.transform(F.split(text(spec), ","), strip), lambda x: x != "")
    edge = lambda x, i: F.regexp_extract(x, r"^(\d+)(?:\s*-\s*(\d+))?$", i)
    first = lambda x: edge(x, 1).try_cast("int")
    last = lambda x: F.coalesce(F.nullif(edge(x, 2), F.lit("")).try_cast("int"), first(x))
    good = F.forall(parts, lambda x: F.coalesce((first(x) >= 1) & (last(x) >= first(x)), F.lit(False)))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: F.sequence(first(x), last(x))))))
    return F.when(strip(text(spec)) == "", F.lit(None).cast("array<int>")).when(good & (F.size(parts) > 0), found).otherwise(F.raise_error(F.concat(F.lit("invalid pages: "), spec)).cast("array<int>"))


def vision_by_name(model: Column, deny: str = NO_VISION_NAMES, allow: str = VISION_NAMES) -> Column:
    """True, false or, where neither pattern is found, null; the denying pattern goes first."""
    name = strip(text(model))
    return F.when(name.rlike(deny), False).when(name.rlike(allow), True)


def lacks_vision(status: Column, body: Column, markers: tuple[str, ...] = NO_VISION_MARKERS) -> Column:
    return status.isin(*NO_VISION_STATUS) & contains_any(F.lower(text(body)), markers)
