"""CSV and JSON scans and lazy plans."""

import csv as plain_csv
import io
import json as plain_json
import random
import threading
import time

import pytest

from cairnframe import CancelToken, FrameError, ScanOptions, col, count, scan_csv, scan_json, sum_
from cairnframe.errors import Cancelled


@pytest.fixture
def csv(tmp_path, spark):
    def make(text, **options):
        p = tmp_path / "t.csv"
        p.write_text(text)
        return scan_csv(spark, str(p), ScanOptions(**options))

    return make


@pytest.fixture
def json(tmp_path, spark):
    def make(text):
        p = tmp_path / "t.json"
        p.write_text(text)
        return scan_json(spark, str(p))

    return make


def kinds(frame):
    return [str(f.dtype) for f in frame.schema.fields]


def test_csv_nulls_and_types(csv):
    f = csv("n,f,b,s,x\nNULL,1,true, 1,1d\nnull,2.5,F,2,2\n").collect()
    assert kinds(f) == ["int64", "float64", "bool", "utf8", "utf8"]
    assert f.collect() == [(None, 1.0, True, " 1", "1d"), (None, 2.5, False, "2", "2")]
    assert kinds(csv("a,b\n").collect()) == ["int64", "int64"]
    assert kinds(csv("a\n9223372036854775808\n").collect()) == ["float64"]


def test_csv_control_characters(csv):
    cells = ["\x01", "\x00", 'a\x00"b', "\x1f"]
    assert csv(as_csv([(i, c) for i, c in enumerate(cells)], ("i", "s"))).collect().collect() == list(enumerate(cells))


def stations(n, seed=5):
    """Generated rows: an id, a level that may be missing, a reading, a flag and a remark with anything in it."""
    dice = random.Random(seed)
    remarks = ["", "NULL", "dry", 'said "wet"', "two\nlines", "a,b", "\u00e9t\u00e9", " kept "]
    return [(i * 7 - 40, dice.choice([None, dice.randrange(-9, 9)]), dice.random() * 100, dice.random() < 0.5, dice.choice(remarks)) for i in range(n)]


def as_csv(rows, header=("station", "level", "reading", "flag", "remark")):
    out = io.StringIO()
    writer = plain_csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows([["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in r] for r in rows])
    return out.getvalue()


def read(rows):
    """What a scan makes of them: empty cells and NULL are null."""
    return [(*r[:4], None if r[4] in ("", "NULL") else r[4]) for r in rows]


def test_csv_generated_rows(csv):
    rows = stations(300)
    f = csv(as_csv(rows)).collect()
    assert kinds(f) == ["int64", "int64", "float64", "bool", "utf8"] and f.collect() == read(rows)
    even = csv(as_csv(rows)).filter(col("station").even()).select("station", "remark").collect()
    assert even.collect() == [(r[0], r[4]) for r in read(rows) if r[0] % 2 == 0]


def test_csv_generated_order_and_groups(csv):
    rows = read(stations(200, seed=6))
    scan = csv(as_csv(stations(200, seed=6)))
    by_level = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0))
    assert scan.sort("level").collect().collect() == by_level
    falling = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0)))
    assert scan.sort("level", descending=True).collect().collect() == falling
    seen = {}
    for r in rows:
        seen.setdefault(r[1], []).append(r[0])
    assert scan.group_by("level").agg(sum_("station").alias("total"), count()).collect().collect() == [(k, sum(v), len(v)) for k, v in seen.items()]
    large = [(sum(v),) for v in seen.values() if sum(v) > 500]
    assert scan.group_by("level").agg(sum_("station").alias("total")).filter(col("total").gt(500)).sort("total").select("total").collect().collect() == sorted(large)


def test_csv_options_and_quotes(csv):
    f = csv('a;b\nNA;"x ""q"" y"\n"NULL";"two\nlines"\n;\n', delimiter=";", null_values=("NA",)).collect()
    assert f.collect() == [(None, 'x "q" y'), ("NULL", "two\nlines"), ("", "")]


def test_csv_errors(csv, spark):
    for text in ("", "a,a\n1,2\n", "a,b\n1\n", "a,b\n1,2,3\n"):
        with pytest.raises(Exception):
            csv(text).collect().collect()
    long = "a\n" + "1\n" * 9000 + "x\n"
    with pytest.raises(Exception, match="can't parse value"):
        csv(long).collect().collect()
    with pytest.raises(FrameError):
        csv("a\n1\n").select("q").collect()
    with pytest.raises(FrameError):
        scan_csv(spark, "/no/such/file").collect()


def test_csv_reads_what_is_selected(csv):
    scan = csv(as_csv(stations(4)))
    with pytest.raises(FrameError, match="filter unknown column flag"):
        scan.select("station", "level").filter(col("flag").eq(True)).collect()
    with pytest.raises(FrameError, match="sort unknown column flag"):
        scan.select("station", "level").sort("flag").collect()
    with pytest.raises(FrameError, match="unknown column .flag"):
        scan.select("station", "level").group_by("level").agg(sum_("flag")).collect()


def test_explain(csv, json):
    f = csv("id,val,c\n2,a,1\n", delimiter=",", null_values=("NA", ""))
    text = f.filter(col("id").even()).sort("c", descending=True).filter(col("c").gt(0)).select("val").explain()
    path = f.path
    assert text == f"Source: csv\nPath: {path}\nDelimiter: ,\nNullValues: NA,\nScan: projection=[c,id,val] filter_even=id\nOps:\n- sort(c,desc)\n- filter(cols=[c])\n- select(val)\n"
    assert "Scan: projection=* (all)\n" in f.explain()
    with pytest.raises(FrameError) as wrong:
        f.select("id").sort("c").explain()
    assert wrong.value.explained == f"Source: csv\nPath: {path}\nDelimiter: ,\nNullValues: NA,\nPlanningError: sort unknown column c\n"
    assert "- groupby(keys=[id] aggs=[?,t])" in f.group_by("id").agg(count(), sum_("c").alias("t")).explain()
    assert "Scan" in f.explain(physical=True)
    assert json('[{"a":1}]').sort("a").explain().endswith("Ops:\n- sort(a,asc)\n")


def test_json_rows(json):
    dice = random.Random(7)
    rows = [{k: dice.randrange(99) for k in dice.sample(["wind", "rain", "sun"], dice.randrange(1, 4))} for _ in range(60)]
    f = json(plain_json.dumps(rows)).collect()
    assert f.columns == ["rain", "sun", "wind"] and kinds(f) == ["int64"] * 3
    assert f.collect() == [(r.get("rain"), r.get("sun"), r.get("wind")) for r in rows]
    assert json('{"tasks":[{"x":1},{"x":2}],"y":0}').collect().collect() == [(1,), (2,)]
    assert json('{"x":"q"}').collect().collect() == [("q",)]
    assert json('[1,{"a":2}]').collect().collect() == [(None, 1), (2, None)]
    for bad in ("7", "[]", "[{}]", '{"a":1}{"a":2}', '{"a":1}\n{"a":2}', "[1,2", ""):
        with pytest.raises(FrameError):
            json(bad).collect()


def test_json_types(json):
    f = json('[{"a":1,"b":1.0,"c":"1.0","d":true,"e":1,"f":"","g":null,"h":{"z":1},"a.b":9007199254740993},{"a":"2","c":2,"d":"false","e":true,"h":[1,2]}]').collect()
    assert dict(zip(f.columns, kinds(f))) == {"a": "int64", "a.b": "int64", "b": "int64", "c": "float64", "d": "bool", "e": "utf8", "f": "int64", "g": "int64", "h": "utf8"}
    rows = [dict(zip(f.columns, r)) for r in f.collect()]
    assert rows[0] == {"a": 1, "a.b": 9007199254740993, "b": 1, "c": 1.0, "d": True, "e": "1", "f": None, "g": None, "h": '{"z":1}'}
    assert rows[1]["a"] == 2 and rows[1]["d"] is False and rows[1]["e"] == "true" and rows[1]["h"] == "[1,2]"


def test_cancelling(csv, json, spark):
    token = CancelToken()
    token.cancel()
    for scan in (csv(as_csv(stations(3))), json('{"tasks":[{"rain":5}]}')):
        with pytest.raises(Cancelled):
            scan.collect(token)
    assert csv(as_csv(stations(3))).collect(CancelToken()).collect() == read(stations(3))
    token = CancelToken()

    def slow():
        spark.range(2 * 10**10).selectExpr("sum(hash(id) % 7)").collect()

    threading.Timer(1.0, token.cancel).start()
    began = time.time()
    with pytest.raises(Cancelled):
        token.run(spark, slow)
    assert time.time() - began < 15


def test_streams(spark, tmp_path, sf):
    from cairnframe.streaming import filter_stream, group_stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{sf}/events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = group_stream(filter_stream(stream, col("user_id").even()), "event_type", count()).writeStream.outputMode("complete").format("memory").queryName("grouped").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 2 = 0").groupBy("event_type").count()
    assert sorted(map(tuple, spark.table("grouped").collect())) == sorted(map(tuple, want.collect()))
