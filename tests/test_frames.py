"""Shape, rows, sorting and groups."""

import dataclasses

import pytest

from cairnframe import Frame, FrameBuilder, FrameError, bool_column, col, count, float64_column, frame_of, from_map, from_records, int64_column, max_, mean, min_, rows_json, projection_checksum, scan_parquet, sum_, table, TableOptions, utf8_column, column_of


@pytest.fixture(scope="module")
def abc(spark):
    return frame_of(spark, int64_column("a", [1, 2, 3]), utf8_column("b", ["x", "y", "z"]))


def test_builder(spark):
    assert FrameBuilder(spark).add("a", [1, 2, 3]).add(" b ", ["x", "y", "z"]).build().shape == (3, 2)
    assert FrameBuilder(spark).add("a", [1]).add("a", [2.5]).build().collect() == [(2.5,)]
    with pytest.raises(FrameError):
        FrameBuilder(spark).add("a", [1, 2]).add("b", ["x"]).build()
    with pytest.raises(FrameError, match="multiple errors:\n- .*\n- "):
        FrameBuilder(spark).add("", [1]).add("x", [1, "a"]).build()
    assert from_map(spark, {"b": [1], "a": [2]}).columns == ["a", "b"]
    with pytest.raises(FrameError):
        from_map(spark, {})


def test_columns():
    for make, values in ((int64_column, [1, 2]), (float64_column, [1.0, 2.0]), (bool_column, [True, False]), (utf8_column, ["a", "b"])):
        with pytest.raises(FrameError):
            make("c", values, [True])
    c = int64_column("x", [10, 20, 30])
    c.values[0] = 99
    assert c.values == [10, 20, 30]
    with pytest.raises(FrameError):
        int64_column("x", [2**63])
    assert column_of("x", [1, 2.5, None]).values == [1.0, 2.5, None]


def test_records(spark):
    @dataclasses.dataclass
    class Row:
        A: int
        B: str | None
        C: bool = dataclasses.field(metadata={"name": "flag"})
        D: str
        skipped: list
        E: int = dataclasses.field(metadata={"name": "-"}, default=0)
        user: int = dataclasses.field(metadata={"json": "user_id,omitempty"}, default=7)

    rows = [Row(1, "x", True, "hello", []), Row(2, None, False, "", []), None]
    f = from_records(spark, rows)
    assert f.columns == ["A", "B", "flag", "D", "user"]
    assert f.collect() == [(1, "x", True, "hello", 7), (2, None, False, "", 7), (0, None, False, "", 0)]
    assert "user_id" in from_records(spark, rows, use_json=True).columns
    with pytest.raises(FrameError):
        from_records(spark, [])


def test_rows_and_shape(spark, abc):
    assert abc.head(2).collect() == [(1, "x"), (2, "y")]
    assert abc.head(9).height == 3
    assert abc.tail(1).collect() == [(3, "z")]
    assert abc.slice(1, 2).collect() == [(2, "y"), (3, "z")]
    assert abc.slice(5, 2).collect() == [] and abc.slice(5, 2).columns == ["a", "b"]
    assert abc.drop("b").columns == ["a"]
    assert abc.rename("a", "x").columns == ["x", "b"]
    assert abc.with_columns(int64_column("a", [9, 9, 9]), bool_column("c", [True, None, False])).collect() == [(9, "x", True), (9, "y", None), (9, "z", False)]
    assert abc.with_columns(abc.sort("a", descending=True).column("b").frame.rename("b", "r").column("r")).collect() == [(1, "x", "z"), (2, "y", "y"), (3, "z", "x")]
    assert abc.with_columns() is abc and abc.drop() is abc and abc.rename("a", "a") is abc
    for bad in (lambda: abc.select(), lambda: abc.select("a", "a"), lambda: abc.select("q"), lambda: abc.drop("q"), lambda: abc.drop("a", "b"), lambda: abc.rename("q", "z"), lambda: abc.rename("a", "b"), lambda: abc.rename("a", ""), lambda: abc.head(-1), lambda: abc.slice(-1, 2), lambda: abc.tail(-1), lambda: abc.with_columns(int64_column("c", [1])), lambda: frame_of(spark), lambda: frame_of(spark, int64_column("", [1]))):
        with pytest.raises(FrameError):
            bad()
    with pytest.raises(FrameError):
        abc.select("A")


def test_series(abc):
    s = abc.column("a")
    assert (s.name, str(s.dtype), len(s), s.values()) == ("a", "int64", 3, [1, 2, 3])
    assert s.int64() is s and s.utf8() is None
    assert s.value_string(1) == "2" and not s.is_null(0)
    with pytest.raises(FrameError):
        abc.column("q")


def test_rows_far_from_both_ends(spark, monkeypatch):
    n, asked = 20_000, []
    df = spark.range(n, numPartitions=5).selectExpr("id * 7919 % 20000 k", "concat('t', id * 7919 % 20000) t")
    for name in ("limit", "offset"):
        monkeypatch.setattr(type(df), name, lambda self, m, f=getattr(type(df), name): asked.append(m) or f(self, m))
    f = Frame(df, df.columns).sort("k", descending=True)
    s = f.column("t")
    for i in (0, 7, 9_000, n // 2, n - 5_000, n - 1, -1, -9_000, -n):
        assert s.value_string(i) == f"t{n - 1 - i % n}"
    for i in (n, n + 9, -n - 1):
        with pytest.raises(IndexError):
            s.value(i)
    k = f.select("k")
    assert k.slice(9_000, 3).collect() == [(10_999,), (10_998,), (10_997,)]
    assert k.slice(n - 2, 5_000).collect() == [(1,), (0,)] and k.slice(n, 5).collect() == []
    assert k.head(6_000).collect() == [(n - 1 - i,) for i in range(6_000)]
    assert k.tail(6_000).collect() == [(5_999 - i,) for i in range(6_000)] and k.tail(n + 1).height == n
    assert max(asked) <= 4_096


def test_sorting(spark):
    f = frame_of(spark, utf8_column("id", list("ABCD")), int64_column("k", [1, 1, 0, 1]))
    assert [r[0] for r in f.sort("k").collect()] == list("CABD")
    assert [r[0] for r in f.sort("k", descending=True).collect()] == list("ABDC")
    n = frame_of(spark, int64_column("v", [2, None, 1]), bool_column("b", [True, None, False]), utf8_column("u", ["é", "z", None]))
    assert n.sort("v").column("v").values() == [1, 2, None]
    assert n.sort("v", True).column("v").values() == [2, 1, None]
    assert n.sort("b").column("b").values() == [False, True, None]
    assert n.sort("u").column("u").values() == ["z", "é", None]
    t = frame_of(spark, int64_column("a", [1, 1, 0, 0]), int64_column("b", [2, 1, 2, 1]))
    assert t.sort("b").sort("a").collect() == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert t.sort("b").select("a").collect() == [(1,), (0,), (1,), (0,)]
    assert t.sort("b", True).rename("b", "a2").tail(2).collect() == [(1, 1), (0, 1)]


def test_groups(spark):
    f = frame_of(spark, int64_column("k", [1, 1, 2, None, 2]), int64_column("v", [10, None, 1, 5, 3]), utf8_column("s", list("abcde")))
    assert f.group_by("k").count().collect() == [(1, 2), (2, 2), (None, 1)]
    out = f.group_by("k").agg(count(), sum_("v"), mean("v"), min_("v"), max_("v").alias("top"))
    assert out.columns == ["k", "count", "v_sum", "v_mean", "v_min", "top"]
    assert out.collect() == [(1, 2, 10, 10.0, 10, 10), (2, 2, 4, 2.0, 1, 3), (None, 1, 5, 5.0, 5, 5)]
    assert f.sort("v", True).group_by("k").count().column("k").values() == [1, None, 2]
    assert f.filter(col("v").gt(99)).group_by("k").count().collect() == []
    g = frame_of(spark, utf8_column("k", ["a", "a", "b", "b"]), float64_column("v", [1.0, 2.0, 3.0, None]))
    assert g.group_by("k").agg(mean("v")).collect() == [("a", 1.5), ("b", 3.0)]
    b = frame_of(spark, bool_column("b", [True]), int64_column("v", [1]))
    for bad in (lambda: f.group_by(), lambda: f.group_by("k", "v").count(), lambda: f.group_by("k").agg(), lambda: f.group_by("k").agg(sum_("s")), lambda: f.group_by("k").agg(sum_("q")), lambda: f.group_by("k").agg(sum_("")), lambda: f.group_by("k").agg(count(), count()), lambda: f.group_by("k").agg(count().alias("k")), lambda: b.group_by("b").count()):
        with pytest.raises(FrameError):
            bad()


def test_text_forms(spark):
    import hashlib

    f = frame_of(spark, int64_column("a", [1, None]), utf8_column("b", ['x"\\\n\x01é', ""]), bool_column("c", [True, None]), float64_column("d", [1e6, 0.0001]))
    assert rows_json(f) == '[{"a":1,"b":"x\\"\\\\\\n\\u0001é","c":true,"d":1e+06},{"a":null,"b":"","c":null,"d":0.0001}]'
    assert projection_checksum(f, 1) == projection_checksum(f, 0) == hashlib.sha256(b"1\n\n").hexdigest()
    assert projection_checksum(f, 99) == hashlib.sha256('1\x1fx"\\\n\x01é\x1ftrue\x1f1e+06\n\x1f\x1f\x1f0.0001\n'.encode()).hexdigest()
    assert projection_checksum(f.select("b", "c"), 2) == hashlib.sha256('x"\\\n\x01é\x1ftrue\n\x1f\n'.encode()).hexdigest()
    with pytest.raises(FrameError):
        rows_json(frame_of(spark, float64_column("x", [float("nan")])))


def test_table(spark):
    f = frame_of(spark, int64_column("a", range(7)), utf8_column("b", ["q", "", *"vwxyz"]))
    text = table(f)
    for part in ("DataFrame shape: (7, 2)", "| idx ", "| 0 ", "| 6 ", '""', "- a: int64  nulls=0/7 min=0 max=6 mean=3", "- b: utf8  nulls=0/7 len=[0,1]"):
        assert part in text
    wide = frame_of(spark, *(utf8_column(f"column{i}", ["a long text that is cut somewhere"] * 30) for i in range(20)))
    text = table(wide, TableOptions(max_table_width=100))
    assert "Preview columns: 9 of 20" in text and "| ... " in text and all(len(x) <= 100 for x in text.split("\n"))
    assert "stats: first 3 rows" in table(f, TableOptions(stats_rows=3)) and "Columns" not in table(f, TableOptions(stats_rows=0))
    assert str(frame_of(spark, int64_column("a", []))).startswith("DataFrame shape: (0, 1)")


def test_parquet_order_and_types(spark, sf):
    f = scan_parquet(spark, f"{sf}/orders.parquet")
    assert str(f.schema.lookup("o_orderdate").dtype).startswith("datetime[us")
    top = f.sort("o_totalprice", descending=True).head(3)
    assert "TakeOrderedAndProject" in top.explain()
    with pytest.raises(FrameError):
        f.sort("o_orderdate")
    with pytest.raises(FrameError):
        scan_parquet(spark, f"{sf}/orders.parquet", ordered=False).head(1)
