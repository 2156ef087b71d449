import gzip
import hashlib

from pyspark.sql import functions as F

from quillspark.llm import warc

PAGES = "page_id long, url string, html string"


def pages(spark):
    long = "<p>" + "x" * 200 + "中</p>"
    rows = [(i, f"http://e.org/{i}", f"<p>page {i}</p>" * (i % 9)) for i in range(60)] + [(100 + i, "http://same.org/", long) for i in range(20)]
    rows += [(5, "http://again.org/", "<p>page 5</p>" * 5), (200, None, None), (201, "http://x/\r\nWARC-Type: evil", "a\r\n\r\nWARC/1.1"), (None, "u", long), (202, "u", "z" * 99), (203, "u", "z" * 99), (300, "u", "r" * 5_000_000)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(3)


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/a"
    warc.write(df, path)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h in first and i != first[h]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    got = [tuple(r) for r in warc.sums(warc.read(spark, path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    archive = warc.read(spark, path)
    assert archive.filter("record_type = 'revisit'").count() == sum(w[3] == "revisit" for w in want)
    assert archive.filter(F.col("page_id").isin(7, 8)).count() == 2
    assert [r.payload for r in warc.read(spark, path, payload=False).limit(3).collect()] == [None] * 3


def test_filters_are_taken_before_payloads():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", ("revisit",))]


def test_other_archives(spark, tmp_path):
    row = lambda i: {"page_id": i, "url": "http://e.org/", "payload": b"p" * i, "payload_digest": "0", "record_type": "response", "refers_to": None}
    (tmp_path / "a.warc").write_bytes(b"".join(warc.record(row(i)) for i in (1, 9000, 3)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(row(i))) for i in (4, 90000, 6)))
    got = {r.page_id: len(r.payload) for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert got == {i: i for i in (1, 9000, 3, 4, 90000, 6)}


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0


def test_records_are_added_or_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    some = lambda ids: spark.createDataFrame([(i, f"http://e.org/{i}", f"page {i}") for i in ids], PAGES)
    warc.write(some(range(5)), path)
    warc.write(some(range(5, 8)), path)
    assert {r.page_id: bytes(r.payload) for r in warc.read(spark, path).collect()} == {i: f"page {i}".encode() for i in range(8)}
    warc.write(some([9]), path, mode="overwrite")
    assert [r.page_id for r in warc.read(spark, path).collect()] == [9]
    warc.write(some([10]).withColumn("payload", F.lit("another")).withColumn("record_type", F.lit(1)), path)
    assert {r.page_id for r in warc.read(spark, path).collect()} == {9, 10}
