"""The interval algebra in columns against the driver's class, and that class against points."""

from __future__ import annotations

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import intervals as iv
from tessella.functions.intervals import ANYTIME, NEVER, Interval, IntervalSet

BOUND = st.one_of(st.none(), st.integers(-6, 6), st.sampled_from([Fraction(1, 3), Fraction(2, 3), 0.1, Fraction(-7, 2)]))
ONE = st.builds(Interval.of, st.sampled_from("ab"), BOUND, BOUND, st.booleans(), st.booleans())
SETS = st.one_of(st.just(ANYTIME), st.lists(ONE, max_size=4).map(IntervalSet))
POINTS = [Fraction(n, 12) for n in range(-84, 85)]


def points(s: IntervalSet, axis: str) -> set:
    return {p for p in POINTS if s.at(axis, p)}


@settings(max_examples=150, deadline=None)
@given(SETS, SETS)
def test_class_against_points(a, b):
    for axis in "ab":
        assert points(a.intersect(b), axis) == points(a, axis) & points(b, axis)
        assert points(a.union(b), axis) == points(a, axis) | points(b, axis)
        whole = a.within("ab")
        assert points(whole.subtract(b), axis) == points(whole, axis) - points(b, axis)
    assert a.union(a) == a and a.intersect(ANYTIME) == a


def test_touching():
    assert IntervalSet([Interval.of("a", 1, 2), Interval.of("a", 2, 3, False)]).ivs == (Interval.of("a", 1, 3),)
    assert len(IntervalSet([Interval.of("a", 1, 2, True, False), Interval.of("a", 2, 3, False)]).ivs) == 2
    assert len(IntervalSet([Interval.of("a", 1, 2), Interval.of("a", 3, 4)]).ivs) == 2
    assert repr(NEVER) == "Empty" and repr(ANYTIME) == "Anytime" and repr(IntervalSet([Interval.of("a", 1, 2, True, False)])) == "a: [1, 2)"


def test_columns_against_class(spark):
    import random

    rng = random.Random(7)
    pool = [None, *range(-4, 5), Fraction(1, 3), Fraction(2, 3), 0.1]

    def some():
        if rng.random() < 0.15:
            return ANYTIME
        return IntervalSet(Interval.of(rng.choice("ab"), rng.choice(pool), rng.choice(pool), rng.random() < 0.5, rng.random() < 0.5) for _ in range(rng.randrange(4)))

    pairs = [(some(), some()) for _ in range(60)]
    df = None
    for i, (a, b) in enumerate(pairs):
        one = spark.range(1).selectExpr(f"{i} AS k", f"{a.sql()} AS a", f"{b.sql()} AS b")
        df = one if df is None else df.unionByName(one)
    df.createOrReplaceTempView("pairs_of_sets")
    got = spark.sql(
        f"""SELECT k, {iv.intersect_sql('a', 'b')} AS i, {iv.union_sql('a', 'b')} AS u, {iv.subtract_sql('a', 'b', 'ab')} AS s,
        {iv.contains_sql('a', 'b')} AS c, {iv.some_sql('a')} AS e, {iv.display_sql('a')} AS d FROM pairs_of_sets"""
    ).collect()

    def read(r):
        cut = lambda c: (c["w"], c["f"], c["s"])
        return r["universal"], [(x["axis"], cut(x["lo"]), cut(x["hi"])) for x in r["ivs"]]

    def want(s):
        from decimal import Decimal, getcontext

        getcontext().prec = 80

        def cut(c):
            w = c.at.numerator // c.at.denominator
            f = c.at - w
            return w, Decimal(f.numerator * 10**37 // f.denominator).scaleb(-37), c.side

        return s.universal, [(x.axis, cut(x.lo), cut(x.hi)) for x in s.ivs]

    for r in got:
        a, b = pairs[r["k"]]
        assert read(r["i"]) == want(a.intersect(b))
        assert read(r["u"]) == want(a.union(b))
        assert read(r["s"]) == want(a if a.universal and not b else a.within("ab").subtract(b))
        assert r["c"] == a.contains(b) and r["e"] == bool(a)
        assert r["d"] == repr(a)


def test_many_intervals(spark):
    """Hundreds of intervals of one owner, in a row that is merged in two levels."""
    import random

    rng = random.Random(5)
    for n, width in ((70, 3), (400, 2), (1500, 40), (3000, 1)):
        sets = [IntervalSet([Interval.of(rng.choice("ab"), lo := rng.randrange(4 * n), lo + rng.randrange(width + 1), rng.random() < 0.5, rng.random() < 0.5)]) for _ in range(n)]
        rows = [(i.axis, i.lo.at.numerator, i.lo.side, i.hi.at.numerator, i.hi.side) for s in sets for i in s.ivs]
        cut = lambda w, s: f"named_struct('w', {w}, 'f', CAST(0 AS DECIMAL(38,37)), 's', CAST({s} AS INT))"
        df = spark.createDataFrame(rows, "axis string, lw long, ls long, hw long, hs long").selectExpr(f"CAST(named_struct('axis', axis, 'lo', {cut('lw', 'ls')}, 'hi', {cut('hw', 'hs')}) AS {iv.INTERVAL}) AS i")
        got = df.groupBy().agg({"i": "collect_list"}).toDF("ivs").selectExpr(f"{iv.normalise_sql('ivs')} AS u").first()["u"]
        want = IntervalSet(i for s in sets for i in s.ivs).ivs
        assert [(x["axis"], x["lo"]["w"], x["lo"]["s"], x["hi"]["w"], x["hi"]["s"]) for x in got] == [(i.axis, i.lo.at, i.lo.side, i.hi.at, i.hi.side) for i in want]


def _many(n: int, step: int, wide: int, first: int = 0) -> str:
    """A validity of n intervals of which every second one is closed; on two axes."""
    zero = "CAST(0 AS DECIMAL(38,37))"
    cut = lambda w, s: f"named_struct('w', CAST({w} AS BIGINT), 'f', {zero}, 's', CAST({s} AS INT))"
    one = f"named_struct('axis', CASE WHEN i < {n // 2} THEN 'a' ELSE 'b' END, 'lo', {cut(f'i * {step} + {first}', 0)}, 'hi', {cut(f'i * {step} + {first + wide}', 'i % 2')})"
    return f"CAST(named_struct('universal', false, 'ivs', transform(sequence(0, {n - 1}), i -> {one})) AS {iv.VALIDITY})"


def _on_driver(n: int, step: int, wide: int, first: int = 0) -> IntervalSet:
    return IntervalSet(Interval.of("a" if i < n // 2 else "b", i * step + first, i * step + first + wide, True, i % 2 == 1) for i in range(n))


def test_long_sets_take_linear_time(spark):
    """8000 intervals of one owner in under two seconds, and what the driver's class and points say."""
    import time

    spark.sql(f"SELECT {_many(8000, 10, 6)} AS a, {_many(7000, 11, 4, 3)} AS b").write.mode("overwrite").saveAsTable("long_sets")
    try:
        table = spark.table("long_sets")
        a, b = _on_driver(8000, 10, 6), _on_driver(7000, 11, 4, 3)
        for sql, want in ((iv.subtract_sql("a", "b"), a.subtract(b)), (iv.intersect_sql("a", "b"), a.intersect(b)), (iv.subtract_sql("b", "a"), b.subtract(a))):
            table.selectExpr(f"{sql} AS v").collect()
            began = time.perf_counter()
            (row,) = table.selectExpr(f"({sql}).ivs AS v").collect()
            took = time.perf_counter() - began
            assert [(i["axis"], i["lo"]["w"], i["lo"]["s"], i["hi"]["w"], i["hi"]["s"]) for i in row["v"]] == [(i.axis, i.lo.at, i.lo.side, i.hi.at, i.hi.side) for i in want.ivs]
            assert took < 2
        assert table.selectExpr(f"{iv.contains_sql('a', 'b')} AS x", f"{iv.contains_sql('a', 'a')} AS y").first()[:] == (False, True)
    finally:
        spark.sql("DROP TABLE long_sets")


def test_sweep_agrees_with_pairs(spark):
    """Sets on both sides of the size at which the sweep takes over."""
    import random

    rng = random.Random(11)
    some = lambda n: IntervalSet(Interval.of(rng.choice("ab"), x := rng.randrange(120), x + rng.randrange(4), rng.random() < 0.5, rng.random() < 0.5) for _ in range(n))
    pairs = [(some(rng.randrange(40)), some(rng.randrange(40))) for _ in range(25)]
    df = None
    for k, (a, b) in enumerate(pairs):
        one = spark.range(1).selectExpr(f"{k} AS k", f"{a.sql()} AS a", f"{b.sql()} AS b", f"{a.intersect(b).sql()} AS i", f"{a.subtract(b).sql()} AS s", f"{str(b.contains(a)).lower()} AS c", f"{a.intersect(b).sql()} AS d")
        df = one if df is None else df.unionByName(one)
    got = df.selectExpr(f"{iv.intersect_sql('a', 'b')} = i AS i", f"{iv.subtract_sql('a', 'b')} = s AS s", f"{iv.contains_sql('b', 'a')} = c AS c", f"{iv.contains_sql('a', 'd')} AS d").collect()
    assert all(all(r) for r in got)
    for a, b in pairs:
        for axis in "ab":
            at = [Fraction(n, 2) for n in range(-2, 250)]
            on = lambda s: {p for p in at if s.at(axis, p)}  # noqa: E731, B023
            assert on(a.intersect(b)) == on(a) & on(b) and on(a.subtract(b)) == on(a) - on(b)


def test_buckets(spark):
    """The level is the least even power of two over the length, the bucket the begin by it; what a window cannot rule out has neither."""
    day = lambda lo, hi, axis="A": iv.IntervalSet([iv.Interval.of(axis, lo, hi)])
    two = iv.IntervalSet([iv.Interval.of("A", 1, 2), iv.Interval.of("B", 1, 2)])
    sets = [day(5, 5), day(8, 11), day(-3, 13), day(7, None), iv.ANYTIME, iv.NEVER, two, day(5, 5, "~P")]
    got = [tuple(spark.sql(f"SELECT b.* FROM (SELECT {iv.bucket_sql('v', ['~P'])} AS b FROM (SELECT {s.sql()} AS v))").first()) for s in sets]
    none = (None, None, None)
    assert got == [("A", 0, 5), ("A", 2, 2), ("A", 6, -1), none, none, none, none, none]


def test_fallbacks_are_worked_out_once(spark):
    """What is left of a fallback is one expression of the plan, however often it is named; few intervals are met by their gaps."""
    from pyspark.sql import functions as F

    from tessella.operators import graph as ops

    of = lambda *ends: iv.IntervalSet([iv.Interval.of(axis, a, b) for axis, a, b in ends])
    whole = of(("t", 0, 20), ("t", 30, 40), ("u", 0, 9))
    timed = {"none": [], "some": [of(("t", 5, 6), ("u", 2, 3)), of(("t", 15, 35))], "all": [of(("t", -1, 99), ("u", -5, 50))], "edge": [of(("t", 0, 0), ("t", 20, 30), ("u", 9, 9))], "ever": [iv.ANYTIME]}
    rows = [f"SELECT '{o}' AS owner, 'p' AS path, CAST(NULL AS {ops.VALUE}) AS value, {v.sql()} AS valid, {f} AS fallback" for o, vs in timed.items() for v, f in [(whole, "true"), *((v, "false") for v in vs)]]
    out = ops.resolve_fallbacks(spark.sql(" UNION ALL ".join(rows)).repartition(2), ["t", "u"]).where("fallback")
    days = out.select("owner", F.expr("size(valid.ivs)").alias("n")).where("n > 0")
    assert days._jdf.queryExecution().optimizedPlan().toString().count("isnull(_timed") == 1
    want = {}
    for o, vs in timed.items():
        left = whole
        for v in vs:
            left = left.subtract(v)
        if left:
            want[o] = iv.IntervalSet(left.ivs)
    got = {r["owner"]: r["v"] for r in out.selectExpr("owner", f"{iv.display_sql('valid')} AS v").collect()}
    shown = {o: spark.sql(f"SELECT {iv.display_sql('v')} AS v FROM (SELECT {s.sql()} AS v)").first()["v"] for o, s in want.items()}
    assert got == shown and set(got) == {"none", "some", "edge"}
