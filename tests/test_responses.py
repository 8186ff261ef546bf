import gzip
import random

import pytest

from lexmill.scratch import fresh_path
from lexmill.sources import responses
from lexmill.streaming import keyed

COLUMNS = "url string, status int, media string, body string"


def rows_of(df):
    return sorted(((r["url"], r["status"], r["media"], r["body"]) for r in df.collect()), key=repr)


def test_framing_survives_any_block_size():
    rng = random.Random(3)
    rows = [(None, None, None, None), ("", 0, "", ""), ("https://h/ä b%41\r\n", 404, "text/html", "a\r\n\r\nHTTP/1.1 200\r\n"), ("u", 200, None, "đ" * 5000), ("v", None, "x/y", None)] * 3
    data = b"".join(responses.stored(*r) for r in rows)
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, len(data)), 12))
        blocks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        assert list(responses.responses(iter(blocks))) == rows
    assert list(responses.responses(iter([data[i : i + 1] for i in range(400)] + [data[400:]]))) == rows
    with pytest.raises(ValueError, match="ends within"):
        list(responses.responses(iter([data[:-1]])))
    with pytest.raises(ValueError, match="another length"):
        list(responses.responses(iter([responses.stored("u", 1, None, "abc").replace(b": 3", b": 2")])))
    assert list(responses.responses(iter([]))) == []


def test_bodies_are_decoded():
    text = "Điều 1"
    assert responses.decoded({"content-type": "text/html; charset=utf-16", "content-length": "1"}, text.encode("utf-16")) == ("text/html", text)
    assert responses.decoded({"content-encoding": "gzip", "content-length": "1"}, gzip.compress(text.encode())) == (None, text)
    assert responses.decoded({"content-type": "a/b; charset=none-such", "content-length": "2"}, b"a\xff") == ("a/b", "a�")
    assert responses.decoded({"content-length": "1"}, b"\xff") == (None, "�")


def test_portions_keep_order_and_size():
    found = [(i, f"s{i}", size) for i, size in enumerate([5, 6, 100, 1, 1, 9])]
    assert [[n for n, _ in p.segments] for p in responses.portions(found, 11)] == [[0, 1], [2], [3, 4, 5]]
    assert [p.segments for p in responses.portions([])] == [[]]


def test_batch_and_stream_agree(spark):
    fmt, path = responses.register(spark), fresh_path(spark, "store")
    assert spark.read.format(fmt).load(path).count() == 0
    rows = [(f"https://h/{i}", 200 + i % 3, "text/html", "x" * (i % 50) + "\r\n" if i % 7 else None) for i in range(300)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{COLUMNS}, extra int").repartition(4)
    df.filter("status <> 201 or status is null").write.format(fmt).mode("append").save(path)
    stream, folder = spark.readStream.format(fmt).load(path), fresh_path(spark, "taken")
    first = rows_of(keyed.run_into(stream, folder))
    assert first == rows_of(spark.read.format(fmt).load(path)) and 0 < len(first) < len(rows)
    df.filter("status = 201").write.format(fmt).mode("append").save(path)
    df.filter("false").write.format(fmt).mode("append").save(path)
    both = keyed.run_into(spark.readStream.format(fmt).load(path), folder)
    assert rows_of(both) == rows_of(spark.read.format(fmt).load(path)) == sorted(rows, key=repr)
    assert both.select("segment", "position").distinct().count() == len(rows)
    assert both.select("batch").distinct().count() == 2
    numbers = [n for n, _, _ in responses.segments(path)]
    assert numbers == list(range(len(numbers)))
    with pytest.raises(Exception, match="only appended"):
        df.write.format(fmt).mode("overwrite").save(path)


def test_failed_writes_leave_nothing(spark):
    from pyspark.sql import functions as F

    fmt, path = responses.register(spark), fresh_path(spark, "store")
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") < 90, "u").otherwise(F.raise_error(F.lit("stop"))).alias("url"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format(fmt).mode("append").save(path)
    assert responses.segments(path) == [] and spark.read.format(fmt).load(path).count() == 0
