"""Document sources: typing by magic bytes, ZIP expansion, manifests, and readers of other engines' JSON."""

from __future__ import annotations

import contextlib
import io
import urllib.request
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import text as T

# Magic bytes of the formats, the formats allowed, and the limits.
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MAGIC = (
    ("image/png", ("89504E470D0A1A0A",)),
    ("image/jpeg", ("FFD8FF",)),
    ("image/gif", ("474946383761", "474946383961")),
    ("image/tiff", ("49492A00", "4D4D002A", "49492B00", "4D4D002B")),
    ("application/pdf", ("255044462D",)),
    ("application/msword", ("D0CF11E0A1B11AE1",)),
)
ALLOWED = ("image/png", "image/jpeg", "image/gif", "image/tiff", "image/webp", "application/pdf", "application/msword", DOCX)
ZIP_TYPES = ("application/zip", "application/x-zip-compressed", "application/x-zip")
MAX_BYTES, MAX_FILES, MAX_RUNNERS, MAX_TOKENS, MAX_FRAMES = 8 << 20, 50, 5, 128_000, 32
MANIFEST = "sample string, mode string, schema_name string, text string, structured map<string,string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content of all files below ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def sniff(content: Column) -> Column:
    """The type by the first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 16))
    out = F
    for kind, starts in MAGIC:
        out = out.when(reduce(or_, (head.startswith(s) for s in starts)), kind)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    word = head.startswith("504B0304") & F.hex(F.substring(content, 1, 2000)).rlike("^(..)*776F72642F")
    return out.when(webp, "image/webp").when(word, DOCX)


def normalize_type(declared: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1)))), F.lit(""))


def effective_type(declared: Column, content: Column) -> Column:
    """struct(content_type, error): an allowed declared type, else by magic bytes where none or octet-stream is declared."""
    own = normalize_type(declared)
    open_ = own.isNull() | (own == "application/octet-stream")
    kind = F.when(own.isin(*ALLOWED), own).when(open_, sniff(content))
    error = F.when(kind.isNotNull(), F.lit(None).cast("string")).when(open_, "unknown content").otherwise(F.concat(F.lit("unsupported type: "), own))
    return F.struct(kind.alias("content_type"), error.alias("error"))


def is_zip(declared: Column, content: Column) -> Column:
    return F.coalesce(normalize_type(declared).isin(*ZIP_TYPES), F.lit(False)) | (F.hex(F.substring(content, 1, 4)).startswith("504B0304") & sniff(content).isNull())


def check_limits(df: DataFrame) -> DataFrame:
    """Adds error of rows with content: empty, or larger than allowed."""
    n = F.octet_length("content")
    return df.withColumn("error", F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > MAX_BYTES, "too large"))


def expand_zip(archives: DataFrame) -> DataFrame:
    """archive, file_name, content, content_type, reference: the supported files of each archive in order of name.

    archives: archive, content. The reference is the text file of the same stem: in the same folder, else at the top.
    Archives and entries that can't be read, for damage or a password, are left out.
    """
    broken = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, ValueError, EOFError, OSError)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive, content in zip(batch["archive"], batch["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content or b""))
                except broken:
                    continue
                with z:
                    for name in sorted(n for n in z.namelist() if not n.startswith("__MACOSX") and not n.endswith("/")):
                        with contextlib.suppress(*broken):
                            rows.append((archive, name, z.read(name)))
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return with_text_references(archives.select("archive", "content").mapInPandas(run, "archive string, path string, content binary"))


def with_text_references(files: DataFrame) -> DataFrame:
    """archive, file_name, content, content_type, reference of entries (archive, path, content); see ``expand_zip``."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    texts = files.filter(F.lower("path").endswith(".txt")).select("archive", stem.alias("stem"), T.strip(F.decode("content", "UTF-8")).alias("text"))
    typed = files.filter(~F.lower("path").endswith(".txt")).withColumn("content_type", sniff(F.col("content"))).filter(F.col("content_type").isin(*ALLOWED))
    typed = typed.withColumns({"stem": stem, "base": F.element_at(F.split(stem, "/"), -1), "file_name": F.element_at(F.split("path", "/"), -1)})
    whole = texts.select("archive", "stem", F.col("text").alias("near"))
    top = texts.select("archive", F.col("stem").alias("base"), F.col("text").alias("far"))
    out = typed.join(whole, ["archive", "stem"], "left").join(top, ["archive", "base"], "left")
    return out.select("archive", "file_name", "content", "content_type", F.coalesce("near", "far", F.lit("")).alias("reference"))


def fetch(requests: DataFrame, timeout: float = 120.0, schemes: tuple[str, ...] = ("http", "https")) -> DataFrame:
    """The columns of ``requests`` (with url) and content, declared, error: what each URL holds, at most ``MAX_BYTES``.

    Off unless called; of other schemes, files among them, nothing is read. A URL that fails has an error.
    """

    def get(url: str | None) -> tuple[bytes | None, str | None, str | None]:
        own = (url or "").strip()
        if own.partition("://")[0].lower() not in schemes:
            return None, None, "no URL"
        try:
            with urllib.request.urlopen(own, timeout=timeout) as r:
                content = r.read(MAX_BYTES + 1)
                return (None, None, "too large") if len(content) > MAX_BYTES else (content, r.headers.get("Content-Type"), None if content else "empty")
        except (OSError, ValueError) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**dict(zip(("content", "declared", "error"), map(list, zip(*map(get, batch["url"]))) if len(batch) else ([], [], []))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{schema}, content binary, declared string, error string")


def example_files(slots: list[tuple[str, str]], most: int = 3) -> list[tuple[str, str]]:
    """(label, path) of the slots in use: those with a path, ``most`` at most; a label defaults to the file's name."""
    used = [(label.strip() or PurePosixPath(path).name, path.strip()) for label, path in slots if path and path.strip()]
    if len(used) > most:
        raise ValueError(f"more than {most} examples")
    return used


def stem_of(name: str) -> str:
    return str(PurePosixPath(name).with_suffix(""))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON list (.json) or of JSON lines; blank lines are skipped."""
    return spark.read.schema(MANIFEST).option("multiLine", path.endswith(".json")).json(path)


_WORD = "struct<content: string, polygon: array<double>, confidence: double>"
PAGED = f"struct<pages: array<struct<width: double, height: double, words: array<{_WORD}>>>>"
ANNOTATED = "struct<responses: array<struct<fullTextAnnotation: struct<text: string, pages: array<struct<width: double, height: double, blocks: array<struct<paragraphs: array<struct<words: array<struct<confidence: double, symbols: array<struct<text: string>>, boundingBox: struct<vertices: array<struct<x: double, y: double>>>>>>>>>>>>>>>"


def _word(content: Column, polygon: Column, confidence: Column) -> Column:
    return F.struct(content.alias("content"), polygon.alias("polygon"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def paged_words(json: Column) -> Column:
    """Words per page of a response with pages of words, on a scale of 0 to 1000.

    Polygons within 1000 on a page larger than that are on the scale already; shorter than four points they are empty.
    """
    none = F.array().cast("array<double>")

    def page(p: Column) -> Column:
        w, h = F.coalesce(F.nullif(p["width"], F.lit(0.0)), F.lit(1000.0)), F.coalesce(F.nullif(p["height"], F.lit(0.0)), F.lit(1000.0))

        def word(x: Column) -> Column:
            scaled = (F.array_max(F.transform(x["polygon"], F.abs)) <= 1000) & ((w > 1000) | (h > 1000))
            polygon = F.when(F.coalesce(F.size(x["polygon"]), F.lit(0)) < 8, none).when(scaled, x["polygon"]).otherwise(G.scale_polygon(x["polygon"], w, h))
            return _word(T.text(x["content"]), polygon, x["confidence"])

        return F.transform(F.coalesce(p["words"], F.array().cast(f"array<{_WORD}>")), word)

    return F.transform(F.from_json(json, PAGED)["pages"], page)


def annotated_words(json: Column) -> Column:
    """Words per page of a response of annotated pages: a word joins its symbols; a polygon needs four vertices."""
    none = F.array().cast("array<double>")

    def page(p: Column) -> Column:
        w, h = F.coalesce(p["width"], F.lit(1000.0)), F.coalesce(p["height"], F.lit(1000.0))
        words = F.flatten(F.transform(F.flatten(F.transform(p["blocks"], lambda b: b["paragraphs"])), lambda g: g["words"]))
        corners = lambda v: F.flatten(F.transform(F.slice(v, 1, 4), lambda q: F.array(F.coalesce(q["x"], F.lit(0.0)) / w * 1000, F.coalesce(q["y"], F.lit(0.0)) / h * 1000)))
        return F.transform(words, lambda x: _word(F.array_join(F.transform(x["symbols"], lambda s: T.text(s["text"])), ""), F.when(F.size(x["boundingBox"]["vertices"]) >= 4, corners(x["boundingBox"]["vertices"])).otherwise(none), x["confidence"]))

    return F.transform(F.from_json(json, ANNOTATED)["responses"][0]["fullTextAnnotation"]["pages"], page)


def peer_words(layout: Column, pages: Column) -> Column:
    """Words per page of this engine's own kind of response: detector words of the layout, else words of the pages."""
    of = lambda rows, field: F.transform(rows, lambda r: F.coalesce(r[field], F.array().cast(f"array<{_WORD}>")))
    found = of(layout, "word_polys")
    return F.when(F.exists(found, lambda w: F.size(w) > 0), found).otherwise(of(pages, "words"))


def plain_text(body: Column, field: str = "text") -> Column:
    """The field of a JSON object, a JSON string, or the body as it is."""
    whole = T.strip(T.text(body))
    quoted = whole.rlike(r'(?s)^".*"$') & F.try_parse_json(whole).isNotNull()
    return F.coalesce(F.get_json_object(body, f"$.{field}"), F.when(quoted, F.from_json(F.concat(F.lit('{"v":'), whole, F.lit("}")), "struct<v: string>")["v"]), body)
