"""Structured fields out of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

# The extraction schemas (field names and types) and the messages results carry.
SCHEMAS: dict[str, dict[str, str]] = {
    "invoice_basic": {"vendor": "string", "invoice_number": "string", "invoice_date": "string", "due_date": "string", "total": "string", "currency": "string"},
    "receipt_basic": {"merchant": "string", "date": "string", "total": "string", "tax": "string", "currency": "string"},
    "table_basic": {"title": "string", "columns": "array<string>", "rows": "array<array<string>>", "notes": "string"},
    "business_card_basic": {"full_name": "string", "role_title": "string", "company": "string", "email": "string", "phone": "string", "website": "string", "address": "string"},
}
NO_OBJECT = "Im Modell-Output wurde kein JSON-Objekt gefunden."
BAD_JSON = "Modell hat fehlerhaftes JSON zurückgegeben."
MISSING = "Erwartetes Feld fehlt: "
EXTRA = "Zusätzliche Felder ignoriert: "


def json_candidate(raw: Column) -> Column:
    """An object in a fence, else from the first opening to the last closing brace; null if there is none."""
    fence = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
    first, back = F.locate("{", raw), F.locate("}", F.reverse(raw))
    last = F.length(raw) - back + 1
    return F.when(raw.rlike(fence), F.regexp_extract(raw, fence, 1)).when((first > 0) & (back > 0) & (last > first), F.substring(raw, first, last - first + 1))


def parse(raw: Column, fields: list[str]) -> Column:
    """struct(data map<field, JSON>, warnings): expected fields only, JSON null for missing ones; data is null for no object."""
    candidate = json_candidate(T.strip(T.text(raw)))
    value = F.try_parse_json(candidate)
    have = F.coalesce(F.json_object_keys(candidate), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, fields)).cast("array<string>")
    got = {f: F.nullif(F.to_json(F.try_variant_get(value, f"$['{f}']", "variant")), F.lit("null")) for f in fields}
    data = F.map_from_arrays(wanted, F.array(*got.values()).cast("array<string>")) if fields else F.create_map().cast("map<string,string>")
    missing = F.filter(F.array(*(F.when(v.isNull(), F.lit(MISSING + f)) for f, v in got.items())), lambda x: x.isNotNull()).cast("array<string>")
    extra = F.array_except(have, wanted)
    warnings = F.concat(missing, F.when(F.size(extra) > 0, F.array(F.concat(F.lit(EXTRA), F.array_join(extra, ", ")))).otherwise(F.array().cast("array<string>")))
    none = F.lit(None).cast("map<string,string>")
    result = lambda d, w: F.struct(d.alias("data"), w.alias("warnings"))
    return F.when(candidate.isNull(), result(none, F.array(F.lit(NO_OBJECT)))).when(value.isNull(), result(none, F.array(F.lit(BAD_JSON)))).otherwise(result(data, warnings))


def is_missing(json: Column) -> Column:
    """Of a JSON value: null, a blank string or an empty list."""
    return json.isNull() | json.rlike(r'^\s*(null|"\s*"|\[\s*\])\s*$')


def merge(pages: Column, schema: dict[str, str]) -> Column:
    """struct(data, warnings) of an array of maps, one per page in order.

    A field takes its first value that isn't missing, and each later page that differs gives a warning;
    an array field takes all items once, in order.
    """
    values: dict[str, Column] = {}
    warnings = []
    for field, kind in schema.items():
        own = F.filter(F.transform(pages, lambda p, i: F.struct(i.alias("i"), F.try_element_at(p, F.lit(field)).alias("v"))), lambda x: ~is_missing(x["v"]))
        if kind.startswith("array"):
            # Items as JSON texts; a single value is a list of one.
            lists = F.transform(own, lambda x: F.coalesce(F.transform(F.from_json(x["v"], "array<variant>"), lambda e: F.to_json(e)), F.array(x["v"])))
            values[field] = F.concat(F.lit("["), F.array_join(F.array_distinct(F.flatten(lists)), ","), F.lit("]"))
        else:
            first = F.get(own, F.lit(0))["v"]
            values[field] = first
            note = lambda x: F.concat(F.lit(f"Konflikt bei Feld '{field}' zwischen Seiten; Wert von Seite 1 wird beibehalten (abweichend auf Seite "), (x["i"] + 1).cast("string"), F.lit(")."))  # noqa: B023,E731
            warnings.append(F.transform(F.filter(own, lambda x: x["v"] != first), note))  # noqa: B023
    data = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    return F.struct(data.alias("data"), (F.concat(*warnings) if warnings else F.array().cast("array<string>")).alias("warnings"))


def empty(schema: dict[str, str]) -> Column:
    """The payload without values: empty lists for array fields, null for others."""
    return F.map_from_arrays(F.array(*map(F.lit, schema)), F.array(*(F.lit("[]" if k.startswith("array") else None).cast("string") for k in schema.values())))


def choose_schema(answer: Column, names: tuple[str, ...] = tuple(SCHEMAS)) -> Column:
    """The schema a classifier's answer names: by start first, then anywhere, in registry order; null if none."""
    plain = F.replace(F.lower(T.strip(T.text(answer))), F.lit("`"), F.lit(""))
    tests = [(plain.startswith(n), n) for n in names] + [(plain.contains(n), n) for n in names]
    return F.coalesce(*(F.when(t, F.lit(n)) for t, n in tests))


def field_accuracy(reference: Column, predicted: Column) -> Column:
    """Share of the reference's keys whose values agree, trimmed and lower-cased; 1 without keys."""
    plain = lambda v: F.lower(T.strip(T.text(v)))
    keys = F.map_keys(reference)
    right = F.size(F.filter(keys, lambda k: plain(F.element_at(reference, k)) == plain(F.try_element_at(predicted, k))))
    return F.when(F.size(keys) == 0, 1.0).otherwise(right / F.size(keys))
