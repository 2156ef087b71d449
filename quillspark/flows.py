"""Queries of whole flows: pages asked of a model, calls left out by a cache, archives read back, jobs in waves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import text as T
from quillspark.operators import calls, matching
from quillspark.plans import jobs, pages
from quillspark.queries import query, table
from quillspark.session import shared_dir
from quillspark.sources import zips


@query("""
WITH p AS (SELECT page_id, page_id // 4 AS doc_id, page_id % 4 + 1 AS page_number, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
s AS (SELECT *, CASE WHEN n > 0 THEN 100 ELSE 0 END AS w, (n + 99) // 100 AS h FROM p),
c AS (SELECT *, least(w, CAST(floor((page_id * 37 % 500) / 1000.0::DOUBLE * w) AS INT)) AS ax1, least(w, CAST(floor((500 + page_id % 500) / 1000.0::DOUBLE * w) AS INT)) AS ax2, least(h, CAST(floor(600 / 1000.0::DOUBLE * h) AS INT)) AS ay2,
  CAST(floor(500 / 1000.0::DOUBLE * h) AS INT) AS by1, page_id % 3 = 0 AS skipped FROM s),
t AS (SELECT *, CASE WHEN n > 0 AND ax2 - ax1 >= 5 AND ay2 >= 5 THEN (ax2 - ax1) || 'x' || ay2 END AS a, CASE WHEN n > 0 AND NOT skipped AND h - by1 >= 5 THEN w || 'x' || (h - by1) END AS b, CASE WHEN n > 0 THEN w || 'x' || h ELSE '' END AS whole FROM c),
g AS (SELECT doc_id, page_number, coalesce(nullif(concat_ws(chr(10) || chr(10), a, b), ''), whole) AS text FROM t)
SELECT doc_id, CASE WHEN count(*) > 1 THEN string_agg('--- Seite ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) ELSE string_agg(text, '') END AS text,
  'Document layout: ' || 2 * count(*) || ' regions detected on ' || count(*) || ' page(s).' AS warning FROM g GROUP BY 1""")
def page_flow(spark, d):
    """The bytes of pages as grey pictures 100 wide, two regions each, one of them skipped now and then; the model tells a picture's size."""
    p = table(spark, d, "pages")
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    n, k = F.octet_length(raw), F.col("page_id")
    high = F.ceil(n / 100).cast("int")
    region = lambda x1, y1, x2, y2, task: F.struct(F.lit("text").alias("label"), F.lit(0.5).alias("score"), F.array(x1, y1, x2, y2).cast("array<int>").alias("bbox_2d"), F.array(x1, y1, x2, y1, x2, y2, x1, y2).cast("array<int>").alias("polygon"), task.alias("task_type"))
    lit = F.lit
    regions = F.array(region(lit(0), lit(500), lit(1000), lit(1000), F.when(k % 3 == 0, "skip").otherwise("text")), region(k * 37 % 500, lit(0), 500 + k % 500, lit(600), lit("text")))
    grey = p.select(F.floor(k / 4).cast("long").alias("doc_id"), (k % 4 + 1).cast("int").alias("page_number"), F.when(n > 0, 100).otherwise(0).alias("width"), high.alias("height"), F.rpad(raw, (high * 100).cast("int"), lit(b" ")).alias("pixels"), regions.alias("regions"))
    out = pages.process(grey, calls.Digest, "read", "m", uuid.uuid4().hex, anchor=False, from_regions=True)
    return out.select("doc_id", "text", F.element_at("warnings", -1).alias("warning"))


@query("""
WITH c AS (SELECT conv_id, sha256(concat_ws(chr(10), sha256(coalesce(text, '')), sha256(coalesce(role, '')), sha256('m'), sha256('64'))) AS key FROM conversations)
SELECT key, count(*)::BIGINT AS n FROM c WHERE key NOT IN (SELECT key FROM c WHERE conv_id % 2 = 0) GROUP BY 1""")
def cache_misses(spark, d):
    """Of all turns as calls, those that a run over the even conversations hasn't answered, and how many turns ask each."""
    turns = table(spark, d, "conversations").select("conv_id", calls.key(F.col("text"), F.col("role"), F.lit("m"), F.lit(64)).alias("key"))
    left = calls.misses(turns.select("key"), turns.filter("conv_id % 2 = 0"))
    return turns.join(left, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT 'site' || page_id % 7 || '/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.html' END AS path, coalesce(html, '') AS html FROM pages)
SELECT path, octet_length(encode(html))::BIGINT AS size, sha256(html) AS digest FROM p WHERE path LIKE 'site3/%' OR (path LIKE '%.txt' AND NOT path LIKE 'site0/%')""")
def archive_entries(spark, d):
    """Pages written to archives and read back by name, the entries of one folder and the texts of others."""
    k = F.col("page_id")
    path = F.concat(F.lit("site"), (k % 7).cast("string"), F.lit("/"), k.cast("string"), F.when(k % 3 == 0, ".txt").otherwise(".html"))
    at = f"{shared_dir(spark)}/zips-{uuid.uuid4().hex}"
    zips.write(table(spark, d, "pages").select(path.alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content")), at)
    own = lambda: zips.read(spark, at, partitionbytes=1 << 20)
    some = own().filter(F.col("path").startswith("site3/")).unionByName(own().filter(F.col("path").endswith(".txt")).filter(~F.col("path").startswith("site0/") & ~F.col("path").startswith("site3/")))
    return some.select("path", "size", F.sha2("content", 256).alias("digest"))


@query(r"""
WITH f AS (SELECT item_id, item_id AS file_index, coalesce(text, '') AS r FROM benchmark),
h AS (SELECT *, unnest(['plain', 'short']) AS runner_label FROM f)
SELECT runner_label, count(*)::BIGINT AS doc_count, (count(*) FILTER (WHERE NOT (runner_label = 'short' AND file_index % 5 = 0)))::BIGINT AS success_count,
  round(avg(length(CASE WHEN runner_label = 'plain' THEN r ELSE substr(r, 1, 40) END)) FILTER (WHERE NOT (runner_label = 'short' AND file_index % 5 = 0)), 6) AS mean_chars FROM h GROUP BY 1""")
def benchmark_waves(spark, d):
    """J1, R4's job without its cancellation: the benchmark's texts as files by two runners, in four waves."""
    b = table(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("file_name"), F.col("item_id").alias("file_index"), F.coalesce("text", F.lit("")).alias("text"))
    runners = spark.createDataFrame([("plain",), ("short",)], "runner_label string")

    def run(rows):
        made = F.when(F.col("runner_label") == "plain", F.col("reference")).otherwise(F.substring("reference", 1, 40))
        failed = (F.col("runner_label") == "short") & (F.col("file_index") % 5 == 0)
        return rows.withColumns({"hypothesis": F.when(~failed, made), "error": F.when(failed, "no answer"), "latency_ms": F.lit(1)})

    job = jobs.job(b.drop("text"), b.select("file_name", "text"), runners, run, f"{shared_dir(spark)}/job-{uuid.uuid4().hex}", 4)
    if job.start().wait() != jobs.DONE:
        raise RuntimeError(job.error)
    return job.rows().groupBy("runner_label").agg(F.count(F.lit(1)).alias("doc_count"), F.count_if(F.col("status") == "done").alias("success_count"), F.round(F.avg("text_chars"), 6).alias("mean_chars"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS i, p_size AS s FROM part)
SELECT k, CASE WHEN i IN (0, 1) THEN list_transform(range(0, 2 * (2 + s % 5)), lambda v: (v * s)::DOUBLE / 4) END AS polygon FROM p WHERE NOT (i IN (0, 1) AND s % 5 < 2)
UNION ALL SELECT k, NULL FROM p WHERE i IN (0, 1) AND s % 5 < 2""")
def polygon_inputs(spark, d):
    """Flat lists, lists of points, and what is neither; of two to six points."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    flat = F.transform(F.sequence(F.lit(0), 2 * (2 + F.col("s") % 5) - 1), lambda v: v * F.col("s") / 4)
    points = F.transform(F.sequence(F.lit(0), 1 + F.col("s") % 5), lambda v: F.array(2 * v * F.col("s") / 4, (2 * v + 1) * F.col("s") / 4))
    i = F.col("k") % 7
    odd = F.when(i == 2, F.to_json(F.slice(flat, 2, 7))).when(i == 3, F.lit('[[0,0],[1],[1,1],[0,1]]')).when(i == 4, F.lit('["0",0,1,0,1,1,0,1]')).when(i == 5, F.lit("{}"))
    return p.select("k", G.polygon(F.when(i == 0, F.to_json(flat)).when(i == 1, F.to_json(points)).otherwise(odd)).alias("polygon"))


@query()
def adopted_tokens(spark, d):
    """The words of every turn, some misread or empty, with the tokens of the turn as its region; tested against a loop, as each choice depends on those before."""
    turns = _turns(spark, d)
    words = turns.select("page_id", F.posexplode(T.words(T.text("text"))).alias("word_idx", "w"))
    words = words.select("page_id", "word_idx", F.lit(0).alias("region_idx"), F.when(F.col("word_idx") % 9 == 0, "").when(F.col("word_idx") % 4 == 0, F.translate("w", "eo", "co")).otherwise(F.col("w")).alias("content"))
    return matching.adopt_tokens(words, turns.select("page_id", F.lit(0).alias("region_idx"), F.col("text").alias("content"))).select("page_id", "word_idx", "content")


@query()
def placed_tokens(spark, d):
    """Every turn's tokens with the polygons of words that a detector read a little differently; tested on worked examples."""
    turns = _turns(spark, d)
    boxes = turns.select("page_id", F.posexplode(T.words(T.text("text"))).alias("idx", "w")).filter("idx % 7 <> 0")
    x = (F.col("idx") * 10).cast("double")
    boxes = boxes.select("page_id", "idx", F.upper("w").alias("content"), F.array(x, F.lit(0.0), x + 9, F.lit(0.0), x + 9, F.lit(5.0), x, F.lit(5.0)).alias("polygon"), F.lit(0.5).alias("confidence"))
    return matching.words_of_text(turns.select("page_id", "text"), boxes).select("page_id", "idx", "content", F.size("polygon").alias("sides"), "confidence")


@query()
def anchored_lines(spark, d):
    """The first lines of every document, misread, found again in the whole; tested against comparing all lines."""
    docs = table(spark, d, "documents").select("doc_id", T.text("text").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    read = F.translate(F.array_join(F.slice(lines, 2, 3), "\n"), "eo", "c0")
    return docs.select("doc_id", F.sha2(matching.source_text(read, F.col("text")), 256).alias("digest"))


def _turns(spark, d):
    """page_id, text of every turn."""
    return table(spark, d, "conversations").select(F.xxhash64("conv_id", "turn", "role", "text").alias("page_id"), "text").dropDuplicates(["page_id"])
