from pyspark.sql import functions as F

from quillspark.functions import editdist as E
from quillspark.functions.batches import ROWS, by_row


def _counted():
    """A function of a row that returns how many of its answers are alive."""
    alive = [0]

    class Answer(list):
        def __init__(self, own):
            super().__init__(own)
            alive[0] += 1

        def __del__(self):
            alive[0] -= 1

    return lambda x, y: Answer([alive[0], x, len(y or "")])


def test_few_rows_are_python_objects_at_once(spark):
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("a"), (F.col("id") % 7).cast("int"))).alias("s"))
    got = rows.select("id", by_row(_counted(), "array<long>")(F.col("id"), F.col("s")).alias("x")).collect()
    assert [(r.x[1], r.x[2]) for r in got] == [(i, i % 7) for i in range(3000)]
    assert max(r.x[0] for r in got) <= 2 * ROWS


def test_steps_of_two_columns_and_of_one_twice(spark):
    df = spark.createDataFrame([("a b", "a c"), (None, "x"), ("", None)], "a string, b string")
    got = df.select(E.diff_words(F.col("a"), F.col("b")).alias("x"), E.diff_words(F.col("a"), F.col("a")).alias("y")).collect()
    assert [[tuple(s) for s in r.x] for r in got] == [[("eq", "a"), ("del", "b"), ("ins", "c")], [("ins", "x")], []]
    assert [[s["op"] for s in r.y] for r in got] == [["eq", "eq"], [], []]
