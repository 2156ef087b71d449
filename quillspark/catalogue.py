"""More of the query catalogue: column functions and small operators over whole tables, each with its SQL.

Inputs that the tables don't have (answers of models, boxes, responses) are made from their keys, the same
way in both languages; the SQL states the expected result by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import structured as S
from quillspark.functions import text as T
from quillspark.operators import layout, matching, metrics, projection, requests, tables
from quillspark.plans import benchmark
from quillspark.queries import query, table
from quillspark.sources import documents as sources
from quillspark.sources import sinks


def _pick(k: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").withColumn("k", F.col("p_partkey"))


@query("""
WITH m AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'ollama/' || p_name WHEN 1 THEN ' OpenAI/' || p_type || '/x ' WHEN 2 THEN 'hub/' || p_name WHEN 3 THEN p_name WHEN 4 THEN 'ollama/' ELSE '' END AS m, CASE WHEN p_partkey % 4 = 0 THEN ' OPENAI ' WHEN p_partkey % 4 = 1 THEN ' ' END AS p FROM part),
r AS (SELECT *, trim(m) AS t, coalesce(nullif(lower(trim(p)), ''), 'ollama') AS given FROM m),
q AS (SELECT *, lower(split_part(t, '/', 1)) IN ('ollama', 'openai') AND strpos(t, '/') > 0 AND substr(t, strpos(t, '/') + 1) <> '' AS named FROM r)
SELECT k, CASE WHEN named THEN lower(split_part(t, '/', 1)) ELSE given END AS provider, CASE WHEN named THEN substr(t, strpos(t, '/') + 1) ELSE t END AS model,
  CASE WHEN named THEN lower(split_part(t, '/', 1)) ELSE given END || '/' || CASE WHEN named THEN substr(t, strpos(t, '/') + 1) ELSE t END AS ref FROM q""")
def model_references(spark, d):
    """provider and model of a reference, and the reference written again."""
    k = F.col("k")
    made = F.when(k % 6 == 0, F.concat(F.lit("ollama/"), "p_name")).when(k % 6 == 1, F.concat(F.lit(" OpenAI/"), "p_type", F.lit("/x "))).when(k % 6 == 2, F.concat(F.lit("hub/"), "p_name")).when(k % 6 == 3, F.col("p_name")).when(k % 6 == 4, "ollama/").otherwise("")
    given = F.when(k % 4 == 0, " OPENAI ").when(k % 4 == 1, " ")
    r = _parts(spark, d).select("k", T.model_ref(made, given, F.lit("ollama"), ("ollama", "openai")).alias("r"))
    return r.select("k", "r.provider", "r.model", T.format_model_ref(F.col("r.provider"), F.col("r.model")).alias("ref"))


@query("""
SELECT p_partkey AS k, p_name AS model, ['expert', 'direct', 'expert', 'direct', 'expert'][p_partkey % 5 + 1] AS backend,
  p_name || ['', ' (Plain)', ' (Layout)', '', ''][p_partkey % 5 + 1] AS label FROM (SELECT *, p_partkey % 5 AS i FROM part) WHERE i IN (0, 1, 2, 4)
UNION ALL SELECT p_partkey, p_name, 'expert', p_name FROM part WHERE p_partkey % 5 = 3""")
def runner_specs(spark, d):
    """name::backend."""
    spec = F.concat("p_name", _pick(F.col("k"), ["", "::direct", "::EXPERT", "::other", "::"]))
    return _parts(spark, d).select("k", T.runner_spec(spec, F.lit("expert")).alias("s")).select("k", "s.model", "s.backend", "s.label")


_TASKS = [*T.EMPTY_OUTPUT_TEXTS, "unknown"]


@query(f"""
SELECT p_partkey AS k, CASE WHEN p_size > 9 THEN 'Seite ' || (p_partkey % 9 + 1) || ': ' || p_name ELSE p_name END AS warning, {_sql_list([*T.EMPTY_OUTPUT_TEXTS.values(), ''])}[p_partkey % {len(_TASKS)} + 1] AS fallback FROM part""")
def page_warnings(spark, d):
    """F21, F22."""
    k = F.col("k")
    return _parts(spark, d).select("k", T.page_prefix(F.col("p_name"), (k % 9 + 1), F.when(F.col("p_size") > 9, 9).otherwise(1)).alias("warning"), T.empty_output_text(_pick(k, _TASKS)).alias("fallback"))


@query(r"""
WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM conversations)
SELECT conv_id, turn, text, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(x) <= 30 THEN a || ' ' || x ELSE a || chr(10) || x END) END AS wrapped FROM w""")
def text_wrap(spark, d):
    """every turn in lines of 30 characters."""
    return table(spark, d, "conversations").select("conv_id", "turn", "text", F.array_join(T.wrap(T.text("text"), 30), "\n").alias("wrapped"))


@query("""
SELECT o_orderkey AS k, array_to_string(list_filter([o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN 'x y' END], lambda x: x <> ''), chr(10)) AS content FROM orders""")
def region_contents(spark, d):
    """contents of regions, blank ones left out."""
    k = F.col("o_orderkey")
    contents = [F.concat(F.lit(" "), "o_orderstatus"), F.when(k % 2 == 0, F.concat("o_orderpriority", F.lit("\n"))).otherwise("  "), F.when(k % 3 == 0, "x y")]
    regions = F.array(*(F.struct(c.alias("content")) for c in contents))
    return table(spark, d, "orders").select(k.alias("k"), T.page_content(regions).alias("content"))


def _boxed(spark, d) -> DataFrame:
    """k and two boxes, a and b, as in ``_BOXED``."""
    k = F.col("k")
    one = lambda k, w, h: F.array(*((x).cast("double") for x in (k * 37 % 90, k * 53 % 90, k * 37 % 90 + 10 + k % w, k * 53 % 90 + 10 + k % h)))
    return _parts(spark, d).select("k", one(k, 60, 25).alias("a"), one(k + 1, 70, 35).alias("b"))


_BOXED = """b AS (SELECT p_partkey AS k, [(k * 37 % 90)::DOUBLE, k * 53 % 90, k * 37 % 90 + 10 + k % 60, k * 53 % 90 + 10 + k % 25] AS a,
  [((k + 1) * 37 % 90)::DOUBLE, (k + 1) * 53 % 90, (k + 1) * 37 % 90 + 10 + (k + 1) % 70, (k + 1) * 53 % 90 + 10 + (k + 1) % 35] AS b FROM part)"""


@query(f"""
WITH {_BOXED}, s AS (SELECT *, greatest(a[1], b[1]) AS x1, greatest(a[2], b[2]) AS y1, least(a[3], b[3]) AS x2, least(a[4], b[4]) AS y2 FROM b)
SELECT k, CASE WHEN x2 > x1 AND y2 > y1 THEN [x1, y1, x2, y2] END AS shared, round(greatest(0, x2 - x1) * greatest(0, y2 - y1) / ((a[3] - a[1]) * (a[4] - a[2])), 9) AS ratio,
  (a[1] + a[3]) / 2 BETWEEN b[1] AND b[3] AND (a[2] + a[4]) / 2 BETWEEN b[2] AND b[4] AS centered, round(sqrt(((a[1] + a[3] - b[1] - b[3]) / 2) ^ 2 + ((a[2] + a[4] - b[2] - b[4]) / 2) ^ 2), 9) AS distance FROM s""")
def box_relations(spark, d):
    """F36, F44."""
    a, b = F.col("a"), F.col("b")
    centered = G.center_in((a[0] + a[2]) / 2, (a[1] + a[3]) / 2, b)
    return _boxed(spark, d).select("k", G.intersection(a, b).alias("shared"), F.round(G.overlap_ratio(a, b), 9).alias("ratio"), centered.alias("centered"), F.round(G.distance(a, b), 9).alias("distance"))


@query(f"""
WITH {_BOXED}
SELECT k, [a[1], a[2], a[3], a[2], a[3], a[4], a[1], a[4]] AS polygon, a AS bounds, [(a[1] + a[3]) / 2 - (a[3] - a[1]), (a[2] + a[4]) / 2 - (a[4] - a[2]) * 0.75, (a[1] + a[3]) / 2 + (a[3] - a[1]), (a[2] + a[4]) / 2 + (a[4] - a[2]) * 0.75] AS unclipped,
  CASE WHEN k % 4 = 0 THEN a ELSE list_transform([a[1], a[2] + (a[4] - a[2]) * (k % 2) / (k % 4 + 1), a[3], a[2] + (a[4] - a[2]) * (k % 2 + 1) / (k % 4 + 1)], lambda x: round(x, 9)) END AS line, [trunc(a[1] / 200 * 1000)::INT, trunc(a[2] / 300 * 1000)::INT] AS per_mille,
  list_transform([a[1] / 10, a[2] / 10, (a[3] - a[1]) / 10, (a[4] - a[2]) / 10], lambda x: round(x, 9)) AS percent FROM b""")
def box_shapes(spark, d):
    """F35, F39, F40, F41, F45."""
    a, k = F.col("a"), F.col("k")
    nine = lambda c: F.transform(c, lambda x: F.round(x, 9))
    return _boxed(spark, d).select(
        "k", G.polygon_of(a).alias("polygon"), G.bounds(G.polygon_of(a)).alias("bounds"), G.unclip(a, 2.0, 1.5).alias("unclipped"),
        nine(G.line_strip(a, k % 2, k % 4 + 1)).alias("line"), F.array(G.per_mille(a[0], F.lit(200)), G.per_mille(a[1], F.lit(300))).alias("per_mille"), nine(G.percent_box(a)).alias("percent"),
    )


@query(f"""
WITH {_BOXED}, p AS (SELECT k, a, [a[1] + 1, a[2], a[3], a[2] + 1, a[3] - 1, a[4], a[1], a[4] - 1] AS p FROM b)
SELECT k, [p[1], p[2]] AS tl, [p[3], p[4]] AS tr, [p[5], p[6]] AS br, [p[7], p[8]] AS bl,
  list_transform([(p[1] + p[3] + p[5] + p[7]) / 4, (p[2] + p[4] + p[6] + p[8]) / 4], lambda x: round(x, 9)) AS center,
  list_transform([100 + p[1] / 1000 * 300, 50 + p[2] / 1000 * 200], lambda x: round(x, 9)) AS on_page, list_transform([p[1] / 500 * 1000, p[2] / 250 * 1000], lambda x: round(x, 9)) AS scaled FROM p""")
def quad_cells(spark, d):
    """corners of a slanted quad whose points come in any order, its middle, and changes of scale."""
    a, k = F.col("a"), F.col("k")
    points = F.array(F.array(a[0] + 1, a[1]), F.array(a[2], a[1] + 1), F.array(a[2] - 1, a[3]), F.array(a[0], a[3] - 1))
    turned = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(points, ((i + k) % 4).cast("int")))
    nine = lambda c: F.transform(c, lambda x: F.round(x, 9))
    names, half, one = ("tl", "tr", "br", "bl"), F.lit(0.5), F.lit(1.0)
    middle = lambda q: nine(F.slice(G.cell_in_quad(q, half, one, half, one), 1, 2)).alias("center")
    whole = lambda q: F.struct(*(F.array(q[c]["x"], q[c]["y"]).alias(c) for c in names), middle(q))
    quad = T.given(G.flat(turned), lambda p: T.given(G.quad(p), whole))
    df = _boxed(spark, d).select("k", G.flat(points).alias("p"), F.inline(F.array(quad)))
    page = F.array(*map(F.lit, (100.0, 50.0, 400.0, 250.0)))
    return df.select("k", *names, "center", nine(F.slice(G.to_page(F.col("p"), page), 1, 2)).alias("on_page"), nine(F.slice(G.scale_polygon(F.col("p"), F.lit(500), F.lit(250)), 1, 2)).alias("scaled"))


_ANSWERS = ["invoice_basic", " `Receipt_Basic` fits", "it is TABLE_BASIC", "invoice_basic or receipt_basic", "none", "", "business_card_basic\n"]
_CHOSEN = ["invoice_basic", "receipt_basic", "table_basic", "invoice_basic", None, None, "business_card_basic"]


@query(f"SELECT p_partkey AS k, {_sql_list(_CHOSEN)}[p_partkey % {len(_CHOSEN)} + 1] AS chosen, NULL::VARCHAR AS title, '[]' AS columns FROM part")
def schema_choice(spark, d):
    """F30, F31."""
    none = S.empty(S.SCHEMAS["table_basic"])
    return _parts(spark, d).select("k", S.choose_schema(_pick(F.col("k"), _ANSWERS)).alias("chosen"), none["title"].alias("title"), none["columns"].alias("columns"))


_VALUES = ['"x"', '" "', "null", "[]", "[ ]", '["a"]', "0", "{}", '""']
_MISSING = [False, True, True, True, True, False, False, False, True]


@query(f"SELECT p_partkey AS k, {_sql_list([str(x).lower() for x in _MISSING])}[p_partkey % {len(_MISSING)} + 1]::BOOLEAN AS missing FROM part")
def missing_values(spark, d):
    """P8."""
    return _parts(spark, d).select("k", S.is_missing(_pick(F.col("k"), _VALUES)).alias("missing"))


_NUMBERS = [("5", None, 5, False), (None, " 7 ", 7, False), ("x", "8", 8, False), (None, "y", None, True), (None, None, None, False), ("-3", "9", -3, False)]
_FLAGS = [(None, "YES", True, False), (None, "off", False, False), (None, "maybe", None, True), (True, "no", True, False), (None, None, None, False)]


@query(f"""
SELECT p_partkey AS k, {_sql_list([x[2] for x in _NUMBERS])}[p_partkey % {len(_NUMBERS)} + 1]::INT AS n, CASE WHEN {_sql_list([int(x[3]) for x in _NUMBERS])}[p_partkey % {len(_NUMBERS)} + 1] = 1 THEN 'invalid n' END AS n_error,
  {_sql_list([None if x[2] is None else int(x[2]) for x in _FLAGS])}[p_partkey % {len(_FLAGS)} + 1] = 1 AS b, CASE WHEN {_sql_list([int(x[3]) for x in _FLAGS])}[p_partkey % {len(_FLAGS)} + 1] = 1 THEN 'invalid b' END AS b_error FROM part""")
def request_values(spark, d):
    """P24."""
    k = F.col("k")
    n = requests.number(_pick(k, [x[0] for x in _NUMBERS]), _pick(k, [x[1] for x in _NUMBERS]), "n")
    b = requests.flag(_pick(k, [x[0] for x in _FLAGS]).cast("boolean"), _pick(k, [x[1] for x in _FLAGS]), "b")
    return _parts(spark, d).select("k", n.alias("n"), b.alias("b")).select("k", F.col("n.value").alias("n"), F.col("n.error").alias("n_error"), F.col("b.value").alias("b"), F.col("b.error").alias("b_error"))


@query("""
SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 2 THEN 'invalid model_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid api_version' END, CASE WHEN o_orderkey % 4 = 3 THEN 'invalid string_index_type' END,
  CASE WHEN o_orderkey % 200000 NOT BETWEEN 1 AND 128000 THEN 'invalid token_limit' END, CASE WHEN o_orderkey % 40 NOT BETWEEN 1 AND 32 THEN 'invalid gif_max_frames' END, CASE WHEN o_orderkey % 60 > 50 THEN 'invalid n_files' END, CASE WHEN o_orderkey % 7 > 5 THEN 'invalid n_runners' END], lambda x: x IS NOT NULL), ';') AS errors FROM orders""")
def request_errors(spark, d):
    """P23, P25."""
    k = F.col("o_orderkey")
    asked = {
        "model_id": _pick(k, [*requests.MODEL_IDS, "other"]), "api_version": F.when(k % 5 == 0, "2020-01-01").otherwise(requests.API_VERSION), "string_index_type": _pick(k, [*requests.INDEX_TYPES, "bytes"]),
        "token_limit": k % 200000, "gif_max_frames": k % 40, "n_files": k % 60, "n_runners": k % 7,
    }
    return requests.errors(table(spark, d, "orders").select(k.alias("k"), *(c.alias(n) for n, c in asked.items()))).select("k", F.array_join("errors", ";").alias("errors"))


_NAMES = {"bge-m3": 0, "llama-guard-3": 0, "asr-large": 0, "gpt-4o": None, "text-only-vision": 0, "cogvlm": 1, "fuyu-8b": 1, "qwen2.5-vl": 1, "qwen2.5vl:7b": None, "nomic-embed-vision": 0, "mistral": None, "llava:13b": 1, "minicpm-v": 1, "e5-large": 0, "Pixtral-12B": 1, "vl-small": 1, "": None}
_BODIES = {"Invalid Type": 1, "unsupported": 1, "bad content type": 1, "no image_url": 1, "image url?": 1, "vision": 1, "quota": 0, "": 0}


@query(f"""
SELECT p_partkey AS k, {_sql_list(list(_NAMES.values()))}[p_partkey % {len(_NAMES)} + 1] = 1 AS sees, {_sql_list(list(_BODIES.values()))}[p_partkey % {len(_BODIES)} + 1] = 1 AND [400, 404, 422, 500, 200][p_partkey % 5 + 1] IN (400, 404, 422) AS refuses FROM part""")
def vision_guess(spark, d):
    """P20, P21."""
    k = F.col("k")
    return _parts(spark, d).select("k", T.vision_by_name(_pick(k, list(_NAMES))).alias("sees"), T.lacks_vision(_pick(k, [400, 404, 422, 500, 200]), _pick(k, list(_BODIES))).alias("refuses"))


@query("""
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ollama' ELSE 'openai' END AS provider, unnest([p_name, p_brand || ':' || p_partkey]) AS model FROM part
UNION ALL SELECT 'peer', unnest([p_name, p_type]) FROM part""")
def model_catalogs(spark, d):
    """Names in answers of both kinds, and a peer's list."""
    both = [F.col("p_name"), F.concat_ws(":", "p_brand", "k")]
    named = lambda f: F.array(*(F.struct(c.alias(f)) for c in both))
    body = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(named("name").alias("models")))).otherwise(F.to_json(F.struct(named("id").alias("data"))))
    own = requests.models(_parts(spark, d).select(F.when(F.col("k") % 2 == 0, "ollama").otherwise("openai").alias("provider"), body.alias("body")))
    peer = requests.peer_models(_parts(spark, d).select(F.to_json(F.struct(F.array("p_name", "p_type").alias("models"))).alias("body")))
    return own.unionByName(peer.select(F.lit("peer").alias("provider"), "model"))


@query("""
SELECT p_partkey AS k, p_name AS model FROM part WHERE CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE p_name LIKE '%vision%' END""")
def vision_filter(spark, d):
    """What is known of a model goes before its name."""
    p = _parts(spark, d).select("k", F.concat_ws("/", "k", "p_name").alias("model"), F.lit("x").alias("provider"))
    known = p.filter("k % 3 <> 2").select("provider", "model", (F.col("k") % 3 == 0).alias("supports_vision"))
    seen = requests.vision_models(p.select("provider", "model"), known)
    return seen.select(F.split_part("model", F.lit("/"), F.lit(1)).cast("int").alias("k"), F.split_part("model", F.lit("/"), F.lit(2)).alias("model"))


@query("""
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 1 END::INT AS retry_after, ['running', 'succeeded', 'failed'][event_id % 3 + 1] AS status FROM events""")
def poll_states(spark, d):
    """Operations that run are to be asked for again."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), _pick(F.col("event_id"), ["running", "succeeded", "failed"]).alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit("{}").alias("payload"), F.lit(None).cast("string").alias("error"))
    p = requests.poll(e)
    return p.select("id", "retry_after", F.get_json_object("body", "$.status").alias("status"))


@query("""
WITH w AS (SELECT o_orderkey AS k, o_orderstatus AS content, CASE WHEN o_orderkey % 2 = 0 THEN 2000 ELSE 500 END AS w, CASE WHEN o_orderkey % 2 = 0 THEN 1500 ELSE 800 END AS h, [o_orderkey % 90, 5, o_orderkey % 90 + 30, 5, o_orderkey % 90 + 30, 25, o_orderkey % 90, 25]::DOUBLE[] AS p, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.0 END AS confidence FROM orders)
SELECT k, content, CASE WHEN k % 5 = 0 THEN [] WHEN w > 1000 THEN p ELSE list_transform(p, lambda v, i: round(v / (CASE WHEN i % 2 = 1 THEN w ELSE h END) * 1000, 9)) END::DOUBLE[] AS polygon, confidence::DOUBLE AS confidence FROM w""")
def paged_words(spark, d):
    """Words of pages on a scale of 0 to 1000."""
    k = F.col("o_orderkey")
    x = (k % 90).cast("double")
    whole = F.array(x, F.lit(5.0), x + 30, F.lit(5.0), x + 30, F.lit(25.0), x, F.lit(25.0))
    word = F.struct(F.col("o_orderstatus").alias("content"), F.when(k % 5 == 0, F.slice(whole, 1, 4)).otherwise(whole).alias("polygon"), F.when(k % 3 == 0, 0.5).alias("confidence"))
    page = F.struct(F.when(k % 2 == 0, 2000.0).otherwise(500.0).alias("width"), F.when(k % 2 == 0, 1500.0).otherwise(800.0).alias("height"), F.array(word).alias("words"))
    got = table(spark, d, "orders").select(k.alias("k"), F.inline(F.flatten(sources.paged_words(F.to_json(F.struct(F.array(page).alias("pages")))))))
    return got.select("k", "content", F.transform("polygon", lambda v: F.round(v, 9)).alias("polygon"), "confidence")


@query("""
SELECT o_orderkey AS k, o_orderstatus || 'x' AS content, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE list_transform([o_orderkey % 90, 5, o_orderkey % 90 + 30, 5, o_orderkey % 90 + 30, 25, 0, 25]::DOUBLE[], lambda v, i: round(v / (CASE WHEN i % 2 = 1 THEN 400 ELSE 200 END) * 1000, 9)) END::DOUBLE[] AS polygon, (o_orderkey % 10) / 10.0::DOUBLE AS confidence FROM orders""")
def annotated_words(spark, d):
    """Words of symbols; a missing coordinate is 0, fewer than four vertices are none."""
    k = F.col("o_orderkey")
    x = (k % 90).cast("double")
    corner = lambda a, b: F.struct((F.lit(None).cast("double") if a is None else a).alias("x"), F.lit(b).alias("y"))
    vertices = F.array(corner(x, 5.0), corner(x + 30, 5.0), corner(x + 30, 25.0), corner(None, 25.0))
    word = F.struct((k % 10 / 10).alias("confidence"), F.array(F.struct(F.col("o_orderstatus").alias("text")), F.struct(F.lit("x").alias("text"))).alias("symbols"), F.struct(F.when(k % 4 == 0, F.slice(vertices, 1, 3)).otherwise(vertices).alias("vertices")).alias("boundingBox"))
    page = F.struct(F.lit(400.0).alias("width"), F.lit(200.0).alias("height"), F.array(F.struct(F.array(F.struct(F.array(word).alias("words"))).alias("paragraphs"))).alias("blocks"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("").alias("text"), F.array(page).alias("pages")).alias("fullTextAnnotation"))).alias("responses")))
    got = table(spark, d, "orders").select(k.alias("k"), F.inline(F.flatten(sources.annotated_words(body))))
    return got.select("k", "content", F.transform("polygon", lambda v: F.round(v, 9)).alias("polygon"), "confidence")


@query("""
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' "q"' WHEN 2 THEN p_name ELSE '{"other": 1}' END AS plain FROM part""")
def plain_text_bodies(spark, d):
    """A field, a JSON string, a bare text, an object without the field."""
    k = F.col("k")
    body = F.when(k % 4 == 0, F.to_json(F.struct(F.col("p_name").alias("text")))).when(k % 4 == 1, F.concat(F.lit('"'), "p_name", F.lit(' \\"q\\""'))).when(k % 4 == 2, F.col("p_name")).otherwise('{"other": 1}')
    return _parts(spark, d).select("k", sources.plain_text(body).alias("plain"))


@query("""
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS content FROM part""")
def peer_words(spark, d):
    """The detector's words of the layout, if any page has them, else the pages' words."""
    word = lambda c: F.array(F.struct(F.col(c).alias("content"), F.array().cast("array<double>").alias("polygon"), F.lit(1.0).alias("confidence")))
    none = F.array().cast("array<struct<content: string, polygon: array<double>, confidence: double>>")
    found = F.array(F.struct(F.when(F.col("k") % 3 == 0, word("p_name")).when(F.col("k") % 3 == 1, none).alias("word_polys")))
    pages = F.array(F.struct(word("p_type").alias("words")))
    return _parts(spark, d).select("k", F.explode(F.flatten(sources.peer_words(found, pages))).alias("w")).select("k", "w.content")


_DECLARED = [" Image/PNG; q=1", None, "application/octet-stream", "text/plain", "application/zip", "", "APPLICATION/PDF"]
_BYTES = ["89504E470D0A1A0A", "255044462D31", "00", "504B030400", "504B0304776F72642F"]


@query(f"""
WITH x AS (SELECT p_partkey AS k, {_sql_list(_DECLARED)}[p_partkey % {len(_DECLARED)} + 1] AS t, p_partkey % {len(_BYTES)} AS b FROM part),
n AS (SELECT *, nullif(lower(trim(split_part(t, ';', 1))), '') AS own, ['image/png', 'application/pdf', NULL, NULL, '{sources.DOCX}'][b + 1] AS seen FROM x),
e AS (SELECT *, CASE WHEN own IN ('image/png', 'application/pdf') THEN own WHEN own IS NULL OR own = 'application/octet-stream' THEN seen END AS kind FROM n)
SELECT k, own, kind, CASE WHEN kind IS NOT NULL THEN NULL WHEN own IS NULL OR own = 'application/octet-stream' THEN 'unknown content' ELSE 'unsupported type: ' || own END AS error,
  coalesce(own = 'application/zip', FALSE) OR b = 3 AS zipped FROM e""")
def content_types(spark, d):
    """S4, S5, S6."""
    declared, content = _pick(F.col("k"), _DECLARED), F.unhex(_pick(F.col("k"), _BYTES))
    out = _parts(spark, d).select("k", sources.normalize_type(declared).alias("own"), sources.effective_type(declared, content).alias("e"), sources.is_zip(declared, content).alias("zipped"))
    return out.select("k", "own", F.col("e.content_type").alias("kind"), F.col("e.error").alias("error"), "zipped")


@query("""
SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS reference FROM part""")
def file_references(spark, d):
    """References by stem, empty where there is none."""
    p = _parts(spark, d)
    files = p.select("k", F.concat("k", F.lit(".v1.png")).alias("file_name"))
    return benchmark.with_references(files, p.filter("k % 2 = 0").select(F.concat("k", F.lit(".v1.txt")).alias("file_name"), F.col("p_name").alias("text"))).select("k", "reference")


@query("""
SELECT p_partkey AS k, p_name AS name, p_type AS kind, p_size AS size FROM part WHERE p_partkey % 6 <> 1
UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE FALSE""".replace("p_name AS name", "CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name").replace("p_type AS kind", "CASE WHEN p_partkey % 3 = 0 THEN p_type END AS kind").replace("p_size AS size", "CASE WHEN p_partkey % 6 > 3 THEN p_size END AS size").replace("p_partkey % 6 <> 1", "p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 6 > 3"))
def zipped_pages(spark, d):
    """Infos, texts and layouts by position, whatever is longest."""
    p = _parts(spark, d)
    of = lambda test, c, n: p.filter(test).select((F.col("k") % 10).alias("doc_id"), F.col("k").alias("page_number"), F.col(c).alias(n))
    return projection.zip_pages(of("k % 2 = 0", "p_name", "name"), of("k % 3 = 0", "p_type", "kind"), of("k % 6 > 3", "p_size", "size")).select(F.col("page_number").alias("k"), "name", "kind", "size")


@query("SELECT conv_id AS doc_id, turn AS page_number, text FROM conversations WHERE turn IN (0, 2, 3)")
def result_pages(spark, d):
    """P2."""
    return projection.filter_pages(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text"), [0, 2, 3])


def _box_rows(spark, d) -> DataFrame:
    """page_id, boxes of an order's lines: i, label, score, bbox_2d, order_seq."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("i"), "l_returnflag", "l_discount")
    x = ((F.col("page_id") * 13 + F.col("i") * 17) % 150 - 30).cast("double")
    label = F.when(F.col("l_returnflag") == "R", "image").otherwise(F.col("l_returnflag"))
    box = F.struct("i", label.alias("label"), F.col("l_discount").alias("score"), F.array(x, x, x + F.col("i") * 30, x + 95).alias("bbox_2d"), (-F.col("i")).alias("order_seq"))
    return li.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


_LINES = "l AS (SELECT l_orderkey AS page_id, l_linenumber AS i, CASE WHEN l_returnflag = 'R' THEN 'image' ELSE l_returnflag END AS label, l_discount AS score, ((l_orderkey * 13 + l_linenumber * 17) % 150 - 30)::DOUBLE AS x1, x1 AS y1, x1 + l_linenumber * 30 AS x2, x1 + 95 AS y2 FROM lineitem)"


def _kept(df: DataFrame, boxes: Column) -> DataFrame:
    return df.select("page_id", F.explode(boxes).alias("b")).select("page_id", F.col("b.i").alias("i"))


@query(f"WITH {_LINES} SELECT page_id, i FROM l WHERE score >= CASE label WHEN 'image' THEN 0.05 WHEN 'A' THEN 0.08 ELSE 0.02 END")
def box_thresholds(spark, d):
    """P12."""
    df = _box_rows(spark, d)
    return _kept(df, layout.above_threshold(F.col("boxes"), F.create_map(F.lit("image"), F.lit(0.05), F.lit("A"), F.lit(0.08)), 0.02))


@query(f"""
WITH {_LINES}, s AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, label = 'image' AND (least(x2, 120) - greatest(x1, 0)) * (least(y2, 100) - greatest(y1, 0)) > 0.82 * 120 * 100 AS big FROM l),
t AS (SELECT *, count(*) FILTER (WHERE NOT big) OVER (PARTITION BY page_id) AS rest FROM s)
SELECT page_id, i FROM t WHERE n = 1 OR rest = 0 OR NOT big""")
def oversized_images(spark, d):
    """P13 on a landscape page."""
    df = _box_rows(spark, d)
    return _kept(df, layout.drop_oversized(F.col("boxes"), F.lit(120.0), F.lit(100.0)))


@query(f"""
WITH {_LINES}, c AS (SELECT page_id, i, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least(x2, 100) AS x2, least(y2, 100) AS y2 FROM l)
SELECT page_id, i, x1, y1, x2, y2, x2 - x1 >= 5 AND y2 - y1 >= 5 AS large FROM c WHERE x1 < x2 AND y1 < y2""")
def clipped_boxes(spark, d):
    """P14, P16."""
    df = _box_rows(spark, d).select("page_id", F.explode(layout.clip(F.col("boxes"), F.lit(100.0), F.lit(100.0))).alias("b"))
    b = F.col("b.bbox_2d")
    return df.select("page_id", F.col("b.i").alias("i"), *(b[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), layout.large_enough(b).alias("large"))


@query(f"WITH {_LINES} SELECT page_id, i, CASE label WHEN 'image' THEN 'skip' WHEN 'A' THEN 'text' ELSE 'skip' END AS task_type, row_number() OVER (PARTITION BY page_id ORDER BY i DESC, label, score)::INT AS place FROM l WHERE label <> 'N'")
def box_tasks(spark, d):
    """Tasks by label, ``abandon`` dropped, in the model's order."""
    made = layout.by_model_order(layout.with_task(F.col("boxes"), F.create_map(F.lit("A"), F.lit("text"), F.lit("N"), F.lit("abandon"))))
    out = _box_rows(spark, d).select("page_id", F.posexplode(made).alias("p", "b"))
    return out.select("page_id", F.col("b.i").alias("i"), F.col("b.task_type").alias("task_type"), (F.col("p") + 1).alias("place"))


@query("""
WITH k AS (SELECT ['table', 'formula', 'text'][p_partkey % 3 + 1] AS task, p_partkey, [p_type || ' Table', p_brand || ' equation', p_type][p_partkey % 3 + 1] AS label FROM part)
SELECT task, list(label ORDER BY p_partkey) AS labels FROM k GROUP BY 1""")
def tasks_of_labels(spark, d):
    """P10."""
    k = F.col("k")
    label = F.when(k % 3 == 0, F.concat("p_type", F.lit(" Table"))).when(k % 3 == 1, F.concat("p_brand", F.lit(" equation"))).otherwise(F.col("p_type"))
    return layout.label_tasks(_parts(spark, d).select(k.alias("id"), label.alias("label")))


_LABELS = ["Doc Title", "FIGURE  caption", "text!", "unheard-of", "", None]


@query(f"SELECT p_partkey AS k, {_sql_list(['title', 'caption', 'text', 'other', 'other', 'other'])}[p_partkey % {len(_LABELS)} + 1] AS kind FROM part")
def region_kinds(spark, d):
    """P11 with a table of aliases."""
    aliases = F.create_map(*map(F.lit, ("doc_title", "title", "figure_caption", "caption", "text", "text")))
    return _parts(spark, d).select("k", layout.region_kind(_pick(F.col("k"), _LABELS), aliases).alias("kind"))


_NATIONS = "n AS (SELECT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, n_nationkey::VARCHAR AS a, n_name AS b FROM nation)"


def _matrix(spark, d) -> DataFrame:
    """r, rows: the nations of a region, the second of each without its name."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = table(spark, d, "nation").withColumn("i", F.row_number().over(w))
    key = F.col("n_nationkey").cast("string")
    return n.groupBy(F.col("n_regionkey").alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("i") == 2, F.array(key)).otherwise(F.array(key, "n_name")).alias("row")))), lambda x: x["row"]).alias("rows"))


@query(f"""
WITH {_NATIONS}, c AS (SELECT r, i, a, CASE WHEN i = 2 THEN '' ELSE b END AS b FROM n)
SELECT r, string_agg('"' || a || '","' || b || '"', chr(10) ORDER BY i) AS csv, string_agg('| ' || a || ' | ' || b || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i) AS markdown FROM c GROUP BY r""")
def table_exports(spark, d):
    """K2, K3."""
    return _matrix(spark, d).select("r", tables.to_csv(F.col("rows")).alias("csv"), tables.to_markdown(F.col("rows")).alias("markdown"))


@query(f"""
WITH {_NATIONS}
SELECT r, "row", "column", content FROM (
  SELECT r, (i - 1)::INT AS "row", 0 AS "column", a AS content FROM n UNION ALL SELECT r, (i - 1)::INT, 1, CASE WHEN i = 2 THEN '' ELSE b END FROM n)""")
def markdown_tables(spark, d):
    """The tables written as Markdown, between prose, read again."""
    text = F.concat(F.lit("before | it\n\n"), tables.to_markdown(F.col("rows")), F.lit("\n\nafter\n"))
    rows = _matrix(spark, d).select("r", F.posexplode(tables.markdown_rows(text)).alias("row", "cells"))
    return rows.select("r", "row", F.posexplode("cells").alias("column", "content"))


@query(f"""
WITH {_NATIONS}
SELECT r, (i - 1)::INT AS row, list_filter([a, CASE WHEN i <> 2 THEN b || chr(10) || 'x' END], lambda x: x IS NOT NULL) AS cells FROM n""")
def html_tables(spark, d):
    """T4: tables of a page of HTML; empty rows and tables go."""
    row = lambda r: F.concat(F.lit("<tr><td> "), F.get(r, F.lit(0)), F.lit("</td>"), F.coalesce(F.concat(F.lit("<th>"), F.get(r, F.lit(1)), F.lit("<br>x</th>")), F.lit("")), F.lit("</tr>"))
    html = F.concat(F.lit("<p>a</p><table><tr></tr></table><TABLE>"), F.array_join(F.transform("rows", row), "\n"), F.lit("<tr></tr></TABLE>"))
    return _matrix(spark, d).select("r", F.posexplode(F.get(tables.html_tables(html), F.lit(0))).alias("row", "cells"))


@query(f"""
WITH {_NATIONS}, h AS (SELECT r, 0 AS row, CASE WHEN r % 2 = 0 THEN ['key', 'name', 'note'] ELSE ['col_1', 'col_2'] END AS cells FROM n GROUP BY r)
SELECT r, row, cells FROM h UNION ALL SELECT r, i::INT, [a, CASE WHEN i = 2 THEN '' ELSE b END] || CASE WHEN r % 2 = 0 THEN [''] ELSE [] END FROM n""")
def structured_tables(spark, d):
    """T5: rows under their header or numbered columns."""
    header = F.when(F.col("r") % 2 == 0, F.array(*map(F.lit, ("key", "name", "note")))).otherwise(F.array().cast("array<string>"))
    return _matrix(spark, d).select("r", F.posexplode(tables.structured_rows(header, F.col("rows"))).alias("row", "cells"))


@query("""
SELECT o_orderkey AS table_id, (2 + o_orderkey % 3)::INT AS row_count, 3 AS column_count, (2 + o_orderkey % 3)::INT AS n_cells, 1 AS n_headers FROM orders""")
def table_results(spark, d):
    """A header over three columns, then one cell a row, of which one spans and covers another."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"))
    n = (F.col("table_id") % 3 + 1).cast("int")
    cell = lambda row, column, header, col_span, root: F.struct(row.cast("int").alias("row"), F.lit(column).alias("column"), F.lit(header).alias("is_header"), F.lit(1).alias("row_span"), F.lit(col_span).alias("col_span"), F.lit(root).alias("span_root"), F.array(*map(F.lit, (0.0, 0.0, 9.0, 9.0))).alias("bbox_2d"))
    cells = F.concat(F.array(cell(F.lit(0), 0, True, 3, True), cell(F.lit(0), 1, False, 1, False)), F.transform(F.sequence(F.lit(1), n), lambda i: cell(i, 0, False, 1, True)))
    r = tables.result(o.select("table_id", F.inline(cells)))
    return r.select("table_id", "row_count", "column_count", F.size("cells").alias("n_cells"), F.size(F.filter("cells", lambda c: c["kind"] == "columnHeader")).alias("n_headers"))


@query("SELECT p_type AS label, count(*)::BIGINT AS count FROM part GROUP BY 1")
def structure_counts(spark, d):
    """A9."""
    return tables.element_counts(_parts(spark, d).select(F.col("p_type").alias("label")))


@query("""
SELECT round(avg(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END), 9) AS mean_cer, round(avg(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END), 9) AS mean_wer, round(avg(CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 3) / 2.0 END), 9) AS mean_field_accuracy FROM orders""")
def eval_means(spark, d):
    """A2."""
    k = F.col("o_orderkey")
    plain = k % 2 == 0
    out = metrics.evaluation(table(spark, d, "orders").select(F.when(plain, k % 7).alias("cer"), F.when(plain, k % 5).alias("wer"), F.when(~plain, k % 3 / 2).alias("field_accuracy")))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("SELECT l_orderkey AS image, round(var_pop(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def skew_statistic(spark, d):
    """A13."""
    v = metrics.skew_variance(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_quantity").alias("row_sum")), ["image"])
    return v.select("image", F.round("variance", 6).alias("variance"))


@query("""
SELECT l_orderkey AS doc_id, count(*)::INT AS word_box_count, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 9) AS avg_confidence FROM lineitem GROUP BY 1""")
def intrinsic_words(spark, d):
    """Words and mean confidence, words without one left out."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("content"), F.col("l_discount").alias("confidence"))).alias("words"))
    m = li.select("doc_id", metrics.intrinsic(F.lit("a b"), F.col("words"), F.lit(1)).alias("m"))
    return m.select("doc_id", "m.word_box_count", F.round("m.avg_confidence", 9).alias("avg_confidence"))


@query(r"""
WITH m AS (SELECT o_orderpriority AS run, count(*)::DOUBLE AS doc_count, avg(o_orderkey % 9) AS mean_cer FROM orders GROUP BY 1),
s AS (SELECT coalesce(nullif(trim(regexp_replace(run, '[^\p{L}\p{N}]', '_', 'g'), '_'), ''), 'runner') AS run, doc_count, mean_cer FROM m)
SELECT run, 'doc_count' AS metric, doc_count AS value FROM s UNION ALL SELECT run, 'mean_cer', round(mean_cer, 9) FROM s""")
def metric_rows(spark, d):
    """K5's rows, K6: an aggregate in long form."""
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("runner_label")).agg(F.count(F.lit(1)).alias("doc_count"), F.avg(F.col("o_orderkey") % 9).alias("mean_cer"))
    return sinks.metric_rows(a).withColumn("value", F.round("value", 9))


@query("""
SELECT p_partkey AS k, [['en', 'de', 'en', 'de'], ['de', 'en', 'en', 'en']][(p_partkey // 4) % 2 + 1][p_partkey % 4 + 1] AS locale,
  'Seite ' || p_size || ' von ' || p_name || ': {left}' AS message FROM part""")
def locales(spark, d):
    """the query goes before the cookie, the cookie before the setting; unknown languages are English."""
    k = F.col("k")
    second = F.floor(k / 4) % 2 == 1
    asked = F.when(second, _pick(k, ["de-AT", "fr", " ", "EN"])).otherwise(_pick(k, ["en", "", None, "De_de"]))
    got = T.locale(F.lit("en"), F.when(k % 4 == 1, "de"), asked)
    message = T.translate(F.lit("Seite {n} von {name}: {left}"), F.create_map(F.lit("n"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name")))
    return _parts(spark, d).select("k", got.alias("locale"), message.alias("message"))


@query("""
SELECT p_partkey AS k, greatest(1, trunc(w * r))::INT AS width, greatest(1, trunc(h * r))::INT AS height FROM (SELECT *, p_size * 200 AS w, 3 + p_partkey % 4000 AS h, least(1.0, 3600.0::DOUBLE / greatest(p_size * 200, 3 + p_partkey % 4000)) AS r FROM part)""")
def image_dimensions(spark, d):
    """D3: sides scaled down to a longest one of 3600."""
    return _parts(spark, d).select("k", G.dims_within((F.col("p_size") * 200), (F.col("k") % 4000 + 3), 3600).alias("s")).select("k", "s.width", "s.height")


@query("""
WITH w AS (SELECT p_partkey AS k, p_partkey % 50 AS page_id, [(p_partkey * 7 % 90) / 100.0::DOUBLE, (p_partkey * 3 % 90) / 100.0::DOUBLE, (p_partkey * 7 % 90) / 100.0::DOUBLE + 0.05, (p_partkey * 3 % 90) / 100.0::DOUBLE + 0.02] AS w FROM part),
r AS (SELECT page_id, i, [[0.0, 0.0, 0.5, 0.5], [0.25, 0.25, 0.45, 0.85]][i + 1] AS r FROM (SELECT unnest(range(50)) AS page_id), (SELECT unnest([0, 1]) AS i)),
j AS (SELECT k, i, least(w[3], r[3]) - greatest(w[1], r[1]) AS dx, least(w[4], r[4]) - greatest(w[2], r[2]) AS dy, (r[3] - r[1]) * (r[4] - r[2]) AS area, (w[3] - w[1]) * (w[4] - w[2]) AS own FROM w JOIN r USING (page_id)),
b AS (SELECT k, arg_min(i, area) AS i FROM j WHERE dx > 0 AND dy > 0 AND dx * dy / greatest(1e-6, own) > 0.1 GROUP BY k)
SELECT w.k AS word_idx, coalesce(['Title', 'Body'][b.i + 1], 'Unbekannt') AS label, coalesce(['title', 'text'][b.i + 1], 'other') AS kind FROM w LEFT JOIN b ON w.k = b.k""")
def labelled_words(spark, d):
    """Words on a scale of 0 to 1 with the label of their region."""
    k = F.col("k")
    x, y = k * 7 % 90 / 100, k * 3 % 90 / 100
    words = _parts(spark, d).select((k % 50).alias("page_id"), k.alias("word_idx"), F.array(x, y, x + 0.05, y + 0.02).alias("bbox_2d"))
    region = lambda i, label, kind, *b: F.struct(F.lit(i).alias("region_idx"), F.array(*map(F.lit, b)).alias("bbox_2d"), F.lit(label).alias("label"), F.lit(kind).alias("kind"))
    pages = words.select("page_id").distinct().select("page_id", F.inline(F.array(region(0, "Title", "title", 0.0, 0.0, 0.5, 0.5), region(1, "Body", "text", 0.25, 0.25, 0.45, 0.85))))
    return matching.label_words(words, pages).select("word_idx", "label", "kind")
