import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import editdist as E
from quillspark.functions import geometry as G
from quillspark.functions import text as T
from quillspark.operators import matching


def test_equal_boxes_are_looked_up_once(spark):
    n = 20_000  # in pairs 400 million
    box = F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0)))
    words = spark.range(n).select(F.lit(1).alias("page_id"), F.col("id").alias("word_idx"), box.alias("bbox_2d"))
    regions = spark.range(n).select(F.lit(1).alias("page_id"), (F.col("id") + 5).alias("region_idx"), box.alias("bbox_2d"))
    got = matching.words_to_regions(words, regions)
    assert got.agg(F.count_distinct("word_idx"), F.count(F.lit(1)), F.min("region_idx"), F.max("region_idx")).first() == (n, n, 5, 5)


def test_equal_pairs_are_measured_once(spark, monkeypatch):
    measured, own = [], E.distances
    monkeypatch.setattr(E, "distances", lambda pairs: measured.append(len(pairs)) or own(pairs))
    column = []
    monkeypatch.setattr(E.F, "pandas_udf", lambda kind: lambda f: column.append(f) or f)
    got = E._udf("chars")(pd.Series(["ab", "x", "ab", None, ""]), pd.Series(["ac", "", "ac", "q", "q"]))
    assert got.values.tolist() == [[1, 2, 2], [1, 1, 0], [1, 2, 2], [1, 0, 1], [1, 0, 1]]
    assert measured == [4]


def test_texts_are_worked_on_once(spark):
    for made in (T.paragraphs(F.col("own_text")), T.ocr_transcript(F.col("own_text")), T.prompt_echo(F.lit("read"), F.col("own_text"))):
        assert str(made).count("own_text") == 1


def test_corners_are_picked_without_functions_of_higher_order(spark):
    got = str(G.quad(F.col("own_polygon")))
    assert "lambda" not in got
    points = spark.createDataFrame([([5.0, 6.0, 0.0, 0.0, 6.0, 0.0, 0.0, 5.0],), ([1.0, 1.0] * 4,), ([1.0, 2.0],)], "p array<double>")
    rows = [r.q for r in points.select(G.quad(F.col("p")).alias("q")).collect()]
    assert [tuple(map(tuple, (rows[0].tl, rows[0].tr, rows[0].br, rows[0].bl)))] == [((0.0, 0.0), (6.0, 0.0), (5.0, 6.0), (0.0, 5.0))]
    assert tuple(rows[1].tl) == (1.0, 1.0) and rows[2] is None
