import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import queries
from quillspark.functions import text as T

BLANK = [None, "", "  ", chr(0x3000) + " " + chr(0xA0), "\n", " \t\n", *map(chr, (0x0B, 0x2028, 0x85))]
TEXTS = ["ein Wort, mehr.", "zwei en Worte", "!?", *BLANK]


@pytest.fixture()
def same(spark, tmp_path):
    """Whether a query over documents with these texts gives the rows of its SQL."""

    def check(name, texts):
        rows = list(enumerate(texts))
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
            wanted = con.execute(queries.ORACLE_SQL[name]).fetchall()
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
        return sorted(got, key=repr) == sorted(wanted, key=repr)

    return check


def test_blank_texts_and_new_letters_in_token_scores(same):
    assert same("bench_token_aggregate", TEXTS)
    assert same("bench_token_aggregate", ["a b", "", "  "])
    assert same("bench_token_aggregate", ["a b en", "\n"])
    new = [f"{c}en b{c} c" for c in map(chr, (0x870, 0xA7C0, 0x10570, 0x1E4D0, 0x31350))]  # letters of Unicode 14 and 15
    assert same("bench_token_aggregate", new) and same("token_jaccard", new)


def test_blank_texts_and_other_white_space_in_fences(same):
    odd = ["\x0bx y\x0b", "\xa0x" + chr(0x2003), "x \x85", "x \n", " x \x1c", "```", "``````", "x\n```", "```py\nx\n```", "x\n\x0b\n", "\r\n x \f", "-x"]
    assert same("fenced_unwrap", [*TEXTS, *odd])
    assert same("fenced_unwrap", ["", "a"])


def test_fences_as_in_the_reference(spark):
    """Against the reference's expression, with Python's white space."""
    fence = re.compile(r"^```(?:[\w.+-]+)?\s*(?:\r?\n)?(.*?)\s*```$", re.DOTALL)
    rng = random.Random(3)
    parts = ["```", "`", "py", "x", " ", "\n", "\r\n", "\x0b", "\xa0", "\x85", chr(0x2028), "é", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)] + ["```" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) + "```" for _ in range(2000)]
    found = [fence.fullmatch(t.strip()) for t in texts]
    wanted = [(m[1].strip(), not m[1].strip()) if m else (t.strip(), False) for t, m in zip(texts, found)]
    c = F.col("t")
    assert [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.unwrap_fence(c), T.is_empty_fence(c)).collect()] == wanted
