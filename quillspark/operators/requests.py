"""Validation of requests as columns, model catalogues, and answers to polling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources import documents as sources

# What requests may name.
MODEL_IDS = ("prebuilt-read", "prebuilt-layout")
API_VERSION = "2022-08-31"
INDEX_TYPES = ("textElements", "unicodeCodePoint", "utf16CodeUnit")
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
RETRY_AFTER = 1


def _result(value: Column, bad: Column, name: str) -> Column:
    return F.struct(value.alias("value"), F.when(bad, F.lit(f"invalid {name}")).alias("error"))


def number(form: Column, query: Column, name: str, kind: str = "int") -> Column:
    """struct(value, error): the form's value, else the query's; both are strings."""
    own = T.strip(F.coalesce(form.try_cast(kind).cast("string"), query))
    value = own.try_cast(kind)
    return _result(value, own.isNotNull() & value.isNull(), name)


def flag(form: Column, query: Column, name: str) -> Column:
    """struct(value, error) of a boolean form value, else of a query's word."""
    low = F.lower(T.strip(query))
    word = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return _result(F.coalesce(form, word), form.isNull() & query.isNotNull() & word.isNull(), name)


def errors(requests: DataFrame) -> DataFrame:
    """Adds errors: every rule a request breaks. Columns that are missing aren't tested."""
    rules = {
        "model_id": ~F.col("model_id").isin(*MODEL_IDS),
        "api_version": F.col("api_version") != API_VERSION,
        "string_index_type": ~F.col("string_index_type").isin(*INDEX_TYPES),
        "token_limit": ~F.col("token_limit").between(1, sources.MAX_TOKENS),
        "gif_max_frames": ~F.col("gif_max_frames").between(1, sources.MAX_FRAMES),
        "n_files": F.col("n_files") > sources.MAX_FILES,
        "n_runners": F.col("n_runners") > sources.MAX_RUNNERS,
        "content": F.octet_length("content").between(1, sources.MAX_BYTES) == F.lit(False),
    }
    tests = [F.when(F.coalesce(bad, F.lit(False)), F.lit(f"invalid {c}")) for c, bad in rules.items() if c in requests.columns]
    return requests.withColumn("errors", F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>"))


def models(catalogs: DataFrame) -> DataFrame:
    """provider, model of catalogue answers (provider, body): names of ``models`` or ids of ``data``."""
    named = F.from_json("body", "struct<models: array<struct<name: string>>, data: array<struct<id: string>>>")
    found = catalogs.withColumn("c", named)
    names = F.coalesce(F.transform("c.models", lambda m: m["name"]), F.transform("c.data", lambda m: m["id"]))
    return found.select("provider", F.explode(names).alias("model"))


def vision_models(catalog: DataFrame, known: DataFrame) -> DataFrame:
    """Models that see images: what is known of (provider, model, supports_vision), else by name; unknown is no."""
    own = catalog.join(known, ["provider", "model"], "left")
    return own.filter(F.coalesce("supports_vision", T.vision_by_name(F.col("model")), F.lit(False))).select("provider", "model")


def peer_models(bodies: DataFrame) -> DataFrame:
    """model of a peer's list answers (body)."""
    return bodies.select(F.explode(F.from_json("body", "struct<models: array<string>>")["models"]).alias("model"))


def poll(states: DataFrame) -> DataFrame:
    """Adds http_status, retry_after, body: an operation that runs is to be asked for again, one that ended has its result."""
    ended = F.col("status").isin("succeeded", "failed")
    body = F.to_json(F.struct("status", F.col("created_at").alias("createdDateTime"), F.col("updated_at").alias("lastUpdatedDateTime"), "payload", "error"))
    return states.withColumns({"http_status": F.lit(200), "retry_after": F.when(~ended, F.lit(RETRY_AFTER)), "body": body})


def error_code(status: Column) -> Column:
    """The code of a failed operation: refused requests, or anything else."""
    return F.when(status.between(400, 499), "AnalyzeFailed").otherwise("InternalServerError")


def operations(spark: SparkSession, path: str) -> DataFrame:
    """All states written to ``path``; ``streaming.jobs.latest`` gives the current ones."""
    return spark.read.schema("id string, model_id string, status string, created_at timestamp, updated_at timestamp, request_id string, payload string, error struct<code: string, message: string>").json(path)
