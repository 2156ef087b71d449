"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

1. ``targets``: sources weigh 1, 2, 3, repeating, and share all words; none is given more than three
   times its own, the excess going to the others by weight. With sources in the order of cap / weight
   this has a closed form: one water level over running sums, instead of repeated resharing.
2. Schedule: slot i of N takes the golden-ratio point frac(i * phi), as an exact 62-bit integer, and
   falls to the source in whose stretch of the cumulative targets it lies. Slots are ranked per source
   through counts of fixed-size chunks.
3. Blocks: a source's documents, shuffled by hash, follow one another (and again from the start, up to
   three times) as a stream of words up to its target, cut into blocks of one size for all sources; only a
   source's last one may be shorter. Block k joins the source's slot k. Slots beyond a source's last block
   stay empty; blocks for which the N points gave no slot, one or two a source, follow at the end.

Running sums go by fixed-width digits of the key, so no task ever holds more than one digit's rows of
a source, however hot it is.

Defined cases: null text has no words and is never taken; null source is a source of its own, last in
order; rows with equal doc_id are separate documents; with no words at all every target is 0; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, text_of

WORDS_PER_BLOCK = 4096
CAP = 3
#: floor(2**62 / golden ratio): the step of the point sequence modulo 2**62.
STEP = 2850178573120402645
_SPAN = 1 << 62
#: A table of copies of more rows is joined by shuffle.
BROADCAST_ROWS = 500_000
_DIGIT = 10


def sizes(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size, key, mark: mark is a hash of the text, key (32 bits of a digest of doc_id) gives the shuffled order."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), key.alias("key"), F.xxhash64("text").alias("mark"),
    ).withColumn("row", F.monotonically_increasing_id())


def targets(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target, take (whole words), low, high: its stretch of [0, 2**62). One row per source."""
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = own.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    by_ratio = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(up_to), F.lit(0))) / F.sum("weight").over(onward)
    leveled = ordered.withColumn("level", level).withColumn("capped", F.col("source_size") * cap <= F.col("level") * F.col("weight"))
    settled = leveled.withColumn("water", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") * cap / F.col("weight"), "level"))).over(everything)["level"])
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("water") * F.col("weight"))
    out = settled.select("source", "source_size", target.alias("target")).withColumn("take", F.least(F.round("target").cast("long"), F.col("source_size") * cap))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    to = F.sum("take").over(by_source.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("take").over(everything)
    out = out.withColumn("high", (F.coalesce(to, F.lit(0.0)) * float(_SPAN)).cast("long"))
    return out.withColumn("low", F.coalesce(F.lag("high").over(by_source), F.lit(0).cast("long")))


def running(rows: DataFrame, group: list[str], key: Column, top: int, value: str, tie: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the group with a smaller (key, tie).

    The key's digits of ``_DIGIT`` bits below bit ``top`` make the levels. Each level's window runs over
    the sums of one digit; only the last level's runs over rows, those whose key agrees in all digits but
    the lowest.
    """
    shifts = list(range(_DIGIT, top, _DIGIT))
    leveled = rows.withColumns({f"_k{s}": F.shiftright(key, s) for s in shifts}).withColumn("_key", key)
    inner = Window.partitionBy(*group, f"_k{shifts[0]}").orderBy("_key", *tie).rowsBetween(Window.unboundedPreceding, -1)
    out = leveled.withColumn("before", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    sums = leveled.groupBy(*group, *(f"_k{s}" for s in shifts)).agg(F.sum(value).alias("_sum"))
    for i, s in enumerate(shifts):
        above = [f"_k{x}" for x in shifts[i + 1 :]]
        w = Window.partitionBy(*group, *above[:1]).orderBy(f"_k{s}").rowsBetween(Window.unboundedPreceding, -1)
        off = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col(f"_k{s}").alias("_at"), "_before")
        same = F.col("_at") == F.col(f"_k{s}")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        out = out.join(off, same).withColumn("before", F.col("before") + F.col("_before")).drop("_at", "_before", *(f"_g_{g}" for g in group))
        sums = sums.groupBy(*group, *above).agg(F.sum("_sum").alias("_sum")) if above else sums
    return out.drop("_key", *(f"_k{s}" for s in shifts))


def schedule(shares: DataFrame, n_slots: int) -> DataFrame:
    """slot, source, block: the golden-ratio schedule, ranked per source. ``shares``: as from ``targets``."""
    spark = shares.sparkSession
    # slot * STEP modulo 2**62 in longs: the product of a low and a high half wraps as it should.
    point = F.col("slot").cast("long").bitwiseAND((1 << 31) - 1)
    high = F.shiftright("slot", 31)
    lo, hi = STEP & ((1 << 31) - 1), STEP >> 31
    mask31 = (1 << 31) - 1
    cross = (point * hi % (1 << 31) + high.bitwiseAND(mask31) * lo % (1 << 31)) % (1 << 31)
    point = (point * lo + cross * (1 << 31)).bitwiseAND(_SPAN - 1)
    points = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", point)
    # One row per source, cut so that each stretch lies in one cell of a fixed grid: an equi-join on the cell.
    cell = 52
    grid = shares.filter("high > low").select("source", "low", "high", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))).alias("cell"))
    last = F.when(F.col("u") >= F.col("high"), F.lit(False)).otherwise(F.col("u") >= F.col("low"))
    slots = points.withColumn("cell", F.shiftright("u", cell)).join(F.broadcast(grid) if _few(shares) else grid, "cell").filter(last).select("slot", "source", F.lit(1).alias("one"))
    ranked = running(slots, ["source"], F.col("slot"), max(2 * _DIGIT, n_slots.bit_length() + _DIGIT), "one", [])
    return ranked.select("slot", "source", F.col("before").cast("long").alias("block"))


def _few(shares: DataFrame, rows: int = 10_000) -> bool:
    return shares.limit(rows + 1).count() <= rows


def mix(docs: DataFrame, words_per_block: int = WORDS_PER_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slices, documents, sources).

    slices: slot, source, block, row, doc_id, first_word, last_word (exclusive): what each slot of the mix
    takes, whole words of whole texts. documents: row, doc_id, source, size, source_size, target, before.
    """
    rows = materialize(sizes(docs), "sizes")
    shares = materialize(targets(rows), "shares")
    placed = running(rows.filter("size > 0"), ["source"], F.col("key"), 32, "size", ["doc_id", "row"])
    total = shares.agg(F.sum("take")).first()[0] or 0
    points = -(-total // words_per_block)
    blocks = shares.withColumn("n", F.expr(f"(take + {words_per_block - 1}) div {words_per_block}"))
    blocks = F.broadcast(blocks) if _few(shares) else blocks
    won = schedule(shares, points).withColumnRenamed("source", "_s").join(blocks.select("source", "n"), F.col("source").eqNullSafe(F.col("_s"))).filter("block < n").select("slot", "source", "block")
    won = materialize(won, "slots")
    have = won.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("have"))
    counts = materialize(blocks.join(have, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))), "counts")
    rest = counts.filter("have < n").select("source", F.explode(F.expr("sequence(have, n - 1)")).alias("block"))
    rest = rest.withColumn("slot", F.row_number().over(Window.orderBy("block", F.col("source").asc_nulls_last())) - 1 + F.lit(points)).select(F.col("slot").cast("long").alias("slot"), "source", "block")
    slots = won.unionByName(rest)
    info = counts.select(F.col("source").alias("_s"), "source_size", "target", "take", "n")
    documents = rows.join(placed.select("row", "before"), "row", "left").join(F.broadcast(info) if _few(shares) else info, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # A document covers [pass * source_size + before, + size) of its source's stream, up to ``take``.
    passes = documents.filter("size > 0 and take > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))))
    passes = passes.withColumn("a", F.col("turn") * F.col("source_size") + F.col("before")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("take"))).filter("a < b")
    cut = passes.withColumn("block", F.explode(F.expr(f"sequence(a div {words_per_block}, (b - 1) div {words_per_block})")))
    cut = cut.withColumn("from", F.expr(f"greatest(a, block * {words_per_block})")).withColumn("to", F.expr(f"least(b, (block + 1) * {words_per_block})"))
    taken = cut.select("source", "block", "row", "doc_id", (F.col("from") - F.col("a")).alias("first_word"), (F.col("to") - F.col("a")).alias("last_word"))
    slices = slots.join(taken.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    return slices, documents, counts


def taken_words(docs: DataFrame, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """One row per document: row, doc_id, mark, source, size, source_size, target, taken, slots (its source's), first_slot (null: not taken)."""
    slices, documents, _ = mix(docs, words_per_block)
    documents = documents.select("row", "doc_id", "mark", "source", "size", "source_size", "target", F.col("n").alias("slots"))
    none = F.lit(0).cast("long")
    parts = slices.select("row", "slot", (F.col("last_word") - F.col("first_word")).alias("taken"))
    taken = parts.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    return documents.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", none))


def mixed(docs: DataFrame, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """The documents of the mix, all columns of ``docs``: each as often as the mix takes its words, to the nearest whole copy.

    Documents without words stay as they are. Rows with one doc_id, source and text share their copies.
    """
    taken = taken_words(docs, words_per_block).filter("size > 0")
    copies = taken.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("mark").alias("_m")).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("_n"))
    copies = materialize(copies, "copies").filter("_n <> 1")
    few = _few(copies, BROADCAST_ROWS)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.xxhash64("text") == F.col("_m"))
    out = docs.join(F.broadcast(copies) if few else copies, same, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return out.filter("_n > 0").withColumn("_k", F.explode(F.expr("sequence(1, _n)"))).select(*docs.columns)
