"""Predicates against an independent null-strict model."""

import math
import random

import pytest

from cairnframe import FrameError, and_, bool_column, col, float64_column, frame_of, int64_column, not_, or_, utf8_column

ROWS = [
    (i, f, b, u)
    for i in (None, -3, 0, 2, 7)
    for f in (None, 2.5, -2.7, float("nan"), 1e20)
    for b in (None, True, False)
    for u in (None, "", "ab", "é", "10")
]


@pytest.fixture(scope="module")
def frame(spark):
    i, f, b, u = zip(*ROWS)
    return frame_of(spark, int64_column("i", i), float64_column("f", f), bool_column("b", b), utf8_column("u", u), int64_column("row", range(len(ROWS))))


OPS = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def leaf(rng):
    """A predicate and its model: row -> True, False or None."""
    kind = rng.choice(["cmp", "cmp", "even", "null", "in"])
    at, name = rng.choice(list(enumerate("ifbu")))
    if kind == "null":
        want = rng.random() < 0.5
        return (col(name).is_null() if want else col(name).is_not_null()), lambda r: (r[at] is None) == want
    if kind == "even":
        def even(r):
            v = r[at]
            if v is None:
                return None
            if name == "b":
                return not v
            if name == "u":
                return len(v.encode()) % 2 == 0
            return math.isfinite(v) and -(2**63) <= v < 2**63 and math.trunc(v) % 2 == 0
        return col(name).even(), even
    if kind == "in" and name != "f":
        values = rng.choice([(), {"i": (2, "7", 0.9), "b": (True,), "u": (10, "ab", True)}[name]])
        held = {"i": {2, 7, 0}, "b": {True}, "u": {"10", "ab", "true"}}[name] if values else set()
        return col(name).is_in(*values), lambda r: None if r[at] is None else r[at] in held
    op = rng.choice(list(OPS))
    literal, means = rng.choice({"i": [(2, 2), (2.7, 2), ("7", 7), (-0.5, 0)], "f": [(2.5, 2.5), ("2.5", 2.5), (1, 1.0), (float("nan"), float("nan"))], "b": [(True, True), (False, False)], "u": [("ab", "ab"), (10, "10"), ("", "")]}[name])

    def compare(r):
        v = r[at]
        if v is None:
            return None
        if name == "b" and op not in ("eq", "neq"):
            return False
        return OPS[op](v.encode(), means.encode()) if name == "u" else OPS[op](v, means)

    return getattr(col(name), op)(literal), compare


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return leaf(rng)
    a, ma = tree(rng, depth - 1)
    if rng.random() < 0.3:
        return not_(a), lambda r: None if ma(r) is None else not ma(r)
    b, mb = tree(rng, depth - 1)
    both = rng.random() < 0.5

    def model(r):
        x, y = ma(r), mb(r)
        return None if x is None or y is None else (x and y) if both else (x or y)

    return (and_ if both else or_)(a, b), model


def test_strict_logic_matches_the_model(frame):
    rng = random.Random(7)
    trees = [tree(rng, 3) for _ in range(60)]
    from pyspark.sql import functions as F

    kept = frame._df.select("row", *(e.keep(frame.schema).alias(f"k{n}") for n, (e, _) in enumerate(trees))).collect()
    for r in kept:
        for n, (e, model) in enumerate(trees):
            assert r[f"k{n}"] == (model(ROWS[r["row"]]) is True), (ROWS[r["row"]], e)
    assert F is not None


@pytest.mark.parametrize("bad", [lambda: col("i").eq(True), lambda: col("i").eq(None), lambda: col("i").eq("x"), lambda: col("f").eq("x"), lambda: col("b").eq(1), lambda: col("f").is_in(1.0), lambda: col("nope").eq(1), lambda: col("i").eq(float("nan"))])
def test_literals_that_do_not_fit(frame, bad):
    with pytest.raises(FrameError):
        frame.filter(bad())


def test_filter_reaches_the_scan(spark, sf):
    from cairnframe import scan_parquet

    f = scan_parquet(spark, f"{sf}/lineitem.parquet").filter(or_(col("l_linenumber").gt(2), col("l_quantity").lt(3))).select("l_orderkey")
    plan = f.explain()
    assert "PushedFilters: [IsNotNull" in plan and "Or(" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_not_a_predicate(frame):
    with pytest.raises(FrameError):
        frame.filter(None)
    with pytest.raises(FrameError):
        and_(col("i").eq(1), None)
    assert and_(col("a").eq(1), or_(col("b").even(), col("a").is_null())).columns() == ["a", "b"]
