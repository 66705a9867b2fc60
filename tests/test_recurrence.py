"""Yearly patterns, periods and coordinate systems: queries against days counted with datetime; maps, conversion, comparison."""

from __future__ import annotations

import datetime
import random
from fractions import Fraction

import pytest

from tessella.functions import calendar, temporal
from tessella.functions.temporal import Mapping, Segment
from tessella.operators.graph import Timeline
from tessella.plans.planner import run
from tessella.sources import markdown

ONE = datetime.timedelta(days=1)
#: Fairs by the day on which they open and the day on which they close.
FAIRS = {"wool": ("03-19", "04-02"), "lamp": ("11-28", "01-09"), "eel": ("02-29", None), "salt": ("09-30", None), "long": ("02-10", "02-29")}


@pytest.fixture(scope="module")
def fairs(spark):
    rows = [
        ("c.md", "---\nid: Almanac\nkind: Timeline\ncoordinate: gregorian\n---\n"),
        ("d.md", "---\nid: Feast\nkind: Timeline\nsameAxisAs: Almanac\ncoordinate:\n  kind: calendar-pattern\n  fields: [month, day]\n  repeatsEvery: year\n---\n"),
        ("k.md", "---\nid: Fair\nkind: NodeType\n---\n"),
    ]
    for ident, (lo, hi) in FAIRS.items():
        to = f", to: {hi}" if hi else ""
        rows.append((f"{ident}.md", f"---\nid: {ident}\ntype: Fair\nvalidTime: [{{timeline: Feast, from: {lo}{to}}}]\n---\n"))
    return markdown.load(spark.createDataFrame(rows, "path string, text string"))[0]


def days(lo: str, hi: str | None, first: datetime.date, after: datetime.date) -> set:
    """The days from each start to the next end within 371 days, in [first, after)."""
    out, at = set(), datetime.date(first.year - 2, 1, 1)
    while at < after:
        if at.strftime("%m-%d") == lo:
            end = next((at + k * ONE for k in range(372) if (at + k * ONE).strftime("%m-%d") == (hi or lo)), None)
            out |= {at + k * ONE for k in range((end - at).days + 1)} if end else set()
        at += ONE
    return {d for d in out if first <= d < after}


def test_fairs_against_days(fairs):
    rng = random.Random(12)
    for _ in range(10):
        first = datetime.date(rng.randrange(1890, 2030), rng.randrange(1, 13), rng.randrange(1, 28))
        after = first + rng.randrange(200, 900) * ONE
        some = datetime.date(2001, 1, 1) + rng.randrange(365) * ONE
        lo, hi = some.strftime("%m-%d"), (some + rng.randrange(1, 40) * ONE).strftime("%m-%d")
        within = f'WITHIN ["{first}", "{after}")'
        held = {f: days(*ends, first, after) for f, ends in FAIRS.items()}
        for clause, fits in (
            (f'AT "{lo}"', lambda d: d & days(lo, None, first, after)),  # noqa: B023
            (f'OVERLAPS ["{lo}", "{hi}"]', lambda d: d & days(lo, hi, first, after)),  # noqa: B023
            ("ANYTIME", lambda d: d),
        ):
            r = run(fairs, f"MATCH (f:Fair) VALID ON Feast {clause} {within} RETURN ID(f) AS id")
            assert not r.diagnostics and {x[0] for x in r.rows.collect()} == {f for f, d in held.items() if fits(d)}


def test_months_and_quarters_recur(spark):
    """A month and a fiscal quarter of every year, against days counted with datetime."""
    spec = "kind: calendar-pattern\n  repeatsEvery: year\n  fields: [{}]"
    rows = [
        ("c.md", "---\nid: Almanac\nkind: Timeline\ncoordinate: gregorian\n---\n"),
        ("m.md", f"---\nid: Moon\nkind: Timeline\nsameAxisAs: Almanac\ncoordinate:\n  {spec.format('month')}\n---\n"),
        ("q.md", f"---\nid: Rent\nkind: Timeline\nsameAxisAs: Almanac\ncoordinate:\n  {spec.format('quarter')}\n  quarterStartMonth: 12\n---\n"),
        ("k.md", "---\nid: Due\nkind: NodeType\n---\n"),
        ("a.md", "---\nid: feb\ntype: Due\nvalidTime: [{timeline: Moon, from: '02'}]\n---\n"), ("b.md", "---\nid: autumn\ntype: Due\nvalidTime: [{timeline: Moon, from: '09', to: '11'}]\n---\n"),
        ("d.md", "---\nid: winter\ntype: Due\nvalidTime: [{timeline: Rent, from: Q1}]\n---\n"),
    ]
    g, problems = markdown.load(spark.createDataFrame(rows, "path string, text string"))
    assert problems.count() == 0
    months = {"feb": {2}, "autumn": {9, 10, 11}, "winter": {12, 1, 2}}
    for first, after in ((datetime.date(2023, 2, 28), datetime.date(2024, 2, 29)), (datetime.date(2023, 12, 31), datetime.date(2024, 2, 1)), (datetime.date(2024, 3, 1), datetime.date(2024, 12, 1))):
        inside = [first + k * ONE for k in range((after - first).days)]
        for line_, clause, fits in (("Moon", 'AT "02"', {2}), ("Rent", 'AT "Q1"', {12, 1, 2}), ("Moon", 'OVERLAPS ["10", "12"]', {10, 11, 12})):
            r = run(g, f'MATCH (d:Due) VALID ON {line_} {clause} WITHIN ["{first}", "{after}") RETURN ID(d) AS id')
            want = {n for n, ms in months.items() if any(d.month in ms & fits for d in inside)}
            assert not r.diagnostics and {x[0] for x in r.rows.collect()} == want


@pytest.mark.parametrize(
    ("clause", "code"),
    [
        ('AT "11-30"', "GMQL4004"), ('AT "11-30" WITHIN ["1999-03-01", "2000-03-01"]', "GMQL4005"), ('AT "11-30" WITHIN ["1999-03-01", +INF)', "GMQL4005"),
        ('AT "11-30" WITHIN ["0007-01-01", "20007-01-01")', "GMQL4005"), ('AT "06-31" WITHIN ["1999-03-01", "2000-03-01")', "GMQL4003"),
        ('OVERLAPS ["11-30", "12-03") WITHIN ["1999-03-01", "2000-03-01")', "GMQL3002"),
    ],
)
def test_codes(fairs, clause, code):
    assert [d.code for d in run(fairs, f"MATCH (f:Fair) VALID ON Feast {clause} RETURN ID(f)").diagnostics] == [code]


def ordinal(d: datetime.date) -> int:
    return d.toordinal() + 1721425


def line(system: str, **spec) -> Timeline:
    import json

    return Timeline("T", "T", system, spec=json.dumps(spec))


def test_dates_against_datetime():
    rng = random.Random(3)
    for _ in range(300):
        d = datetime.date(1, 1, 1) + rng.randrange(3_000_000) * ONE
        assert calendar.gregorian_day(d.year, d.month, d.day) == ordinal(d) == temporal.system_of(line("gregorian")).point(f"{d.year:04d}-{d.month:02d}-{d.day:02d}")
        assert temporal.system_of(line("gregorian")).name(Fraction(ordinal(d))) == f"{d.year:04d}-{d.month:02d}-{d.day:02d}"
        year, week, _ = d.isocalendar()
        s = temporal.span(line("dates", fields=["weekYear", "week"]), f"{year:04d}-W{week:02d}")
        assert s.lo <= ordinal(d) < s.hi and s.hi - s.lo == 7 and not s.point
        month = temporal.span(line("dates", fields=["year", "month"]), f"{d.year:04d}-{d.month:02d}")
        assert (month.lo, month.hi) == (ordinal(d.replace(day=1)), ordinal((d.replace(day=1) + 31 * ONE).replace(day=1)) if d.year < 9999 or d.month < 12 else month.hi)
        fiscal = line("dates", fields=["year", "quarter"], quarterStartMonth=4, quarterYearLabel="end")
        q, named = (d.month - 4) % 12 // 3 + 1, d.year + (d.month >= 4)
        s = temporal.span(fiscal, f"{named:04d}-Q{q}")
        assert s.lo <= ordinal(d) < s.hi
    julian = temporal.system_of(line("julian"))
    assert julian.point("1582-10-05") == ordinal(datetime.date(1582, 10, 15)) and julian.name(Fraction(ordinal(datetime.date(1900, 3, 13)))) == "1900-02-29"


def test_year_numbers():
    common, astronomical = (temporal.system_of(line("gregorian", numbering=n)) for n in ("common-era", "astronomical"))
    assert common.point("-1-03-01") == astronomical.point("0-03-01") and common.name(common.point("-44-03-15")) == "-0044-03-15"
    with pytest.raises(temporal.QueryError):
        common.point("0-03-01")
    shifted = temporal.system_of(line("gregorian", numbering={"offset": 543, "yearZero": True}))
    assert shifted.point("2567-01-01") == ordinal(datetime.date(2024, 1, 1)) and shifted.name(Fraction(ordinal(datetime.date(2024, 1, 1)))) == "2567-01-01"


def test_patterns_have_forms():
    p = temporal.system_of(line("dates", fields=["year", "month", "day"], format="{day:2}.{month:2}.{year:4}"))
    x = p.point("07.09.1968")
    assert x == ordinal(datetime.date(1968, 9, 7)) and p.name(x) == "07.09.1968"
    for bad in ("7.9.1968", "31.02.1968", "1968-09-07"):
        with pytest.raises(temporal.QueryError):
            p.point(bad)
    with pytest.raises(temporal.QueryError):
        temporal.span(line("dates", fields=["weekYear", "week"]), "2021-W53")


def test_timecodes_label_by_label():
    """Labels counted one by one, dropped ones left out."""
    for nominal, drop in ((30, True), (60, True), (25, False)):
        t, n = temporal.Timecode(nominal, drop, wrap=1), 0
        for minute in range(23):
            for second in (0, 1, 59) if minute % 7 else range(60):
                for f in range(nominal):
                    if drop and second == 0 and minute % 10 and f < nominal // 15:
                        with pytest.raises(temporal.QueryError):
                            t.point(f"00:{minute:02d}:00:{f:02d}")
                        continue
                    x = t.point(f"00:{minute:02d}:{second:02d}:{f:02d}")
                    assert x >= n and t.point(t.name(x)) == x
                    n = x
        whole = sum(not (drop and s == 0 and m % 10 and f < nominal // 15) for m in range(12) for s in range(60) for f in range(nominal))
        assert t.point("00:12:00:05") == whole + 5 - (0 if not drop else nominal // 15)


def test_eras():
    era = temporal.system_of(line("era", periods=[{"name": "Oak", "since": "1803-06-01"}, {"name": "Elm", "aliases": ["E"], "since": "1820-02-11", "firstYear": 0}]))
    d = lambda y, m, day: ordinal(datetime.date(y, m, day))
    assert era.point("Oak 1-06-01") == d(1803, 6, 1) and era.point("E 3-02-01") == d(1823, 2, 1)
    assert era.name(Fraction(d(1820, 2, 10))) == "Oak 18-02-10" and era.name(Fraction(d(1820, 2, 11))) == "Elm 0-02-11"
    for bad in ("Oak 1-05-31", "Oak 18-02-11", "Fir 1-01-01", "Elm 1-13-01"):
        with pytest.raises(temporal.QueryError):
            era.point(bad)


A, B, C, D = (Timeline(x, x) for x in "ABCD")


def test_conversion_kinds():
    q = Fraction
    twice = Mapping("A", "B", q(2), q(5))
    assert temporal.convert(4, A, B, [twice]).values == ("13",) and temporal.convert("9", B, A, [twice]).values == ("2",)
    about = Mapping("B", "C", precision="approximate", error=q(1, 2))
    out = temporal.convert(4, A, C, [twice, about])
    assert (out.kind, out.values, out.error) == ("approximate", ("13",), q(1, 2))
    unsure = Mapping("B", "C", precision="uncertain", error=q(3))
    assert temporal.convert(4, A, C, [twice, unsure]).values == ("10", "16")
    assert temporal.convert(4, A, C, [twice, unsure, about]).kind == "approximate"  # the more precise of two ways
    fork = Mapping("A", "B", pairs=((q(1), (q(10), q(20))), (q(2), (q(20),))))
    assert temporal.convert(1, A, B, [fork]).values == ("10", "20") and temporal.convert(20, B, A, [fork]).kind == "alternatives"
    assert temporal.convert(3, A, B, [fork]).reason == "no map applies here" and temporal.convert(3, A, D, [fork]).reason == "no path between the axes"
    gap = Mapping("A", "B", segments=(Segment((q(0), q(6)), (q(0), q(3))), Segment((q(10), q(14)), (q(3), q(11)))))
    assert temporal.convert(4, A, B, [gap]).values == ("2",) and temporal.convert(11, A, B, [gap]).values == ("5",) and temporal.convert(8, A, B, [gap]).kind == "unmappable"
    assert temporal.convert(1, A, B, [Mapping("A", "B", context=("port",))]).kind == "unmappable" and temporal.convert(1, A, B, [Mapping("A", "B", context=("port",))], ["port"]).kind == "exact"
    assert temporal.convert("2024-05-01", line("gregorian"), line("frame"), []).kind == "exact" and temporal.convert("x", A, B, [twice]).kind == "unmappable"


def test_comparison_kinds():
    q = Fraction
    twice = Mapping("A", "B", q(2))
    assert temporal.compare(3, A, 7, B, [twice]) == temporal.Order("ordered", (-1,)) and temporal.compare(7, B, 3, A, [twice]).signs == (1,)
    assert temporal.compare(3, A, 6, B, [twice]).signs == (0,) and temporal.compare(1, A, 1, D, [twice]).kind == "unrelated"
    unsure = Mapping("A", "B", precision="uncertain", error=q(2))
    assert temporal.compare(5, A, 6, B, [unsure]).kind == "overlapping" and temporal.compare(5, A, 9, B, [unsure]).signs == (-1,)
    fork = Mapping("A", "B", pairs=((q(1), (q(10), q(20))),))
    assert temporal.compare(15, B, 1, A, [fork]).kind == "ambiguous" and temporal.compare(5, B, 1, A, [fork]) == temporal.Order("ordered", (-1,))
    assert temporal.compare(5, A, 6, B, [Mapping("A", "B", precision="approximate", error=q(1))]).kind == "approximate"
    assert temporal.compare(99, A, 99, B, [fork]).kind == "unmappable"


def test_traits():
    q = Fraction
    assert Mapping("A", "B").shape().total and Mapping("A", "B", q(-1)).shape().order == "falling" and not Mapping("A", "B", q(0)).shape().invertible
    falling = Mapping("A", "B", segments=(Segment((q(0), q(1)), (q(5), q(4))), Segment((q(2), q(3)), (q(3), q(1)))))
    assert (falling.shape().order, falling.shape().form, falling.shape().total) == ("falling", "piecewise", False)
    weaker = Mapping("A", "B", said=(("order", "monotonic"), ("total", False)))
    assert weaker.traits() == (temporal.Traits((False, False), False, "monotonic", True, "continuous"), [])
    stronger = Mapping("A", "B", q(-1), said=(("order", "strict"),))
    assert stronger.traits()[1] == ["order"] and not stronger.safe(False, False)
    for m in (weaker, falling, Mapping("A", "B", pairs=((q(1), (q(10), q(1, 3))),), error=q(1, 7), precision="uncertain", context=("c",))):
        import json

        assert temporal.of_json(json.loads(json.dumps(temporal.to_json(m)))) == m


def test_offsets():
    q = Fraction
    known, unlike = temporal.offsets([("A", "B", q(3)), ("B", "C", q(4)), ("C", "A", q(-7)), ("C", "D", q(1))])
    assert known["A"] == {"B": 3, "C": 7, "D": 8} and known["D"]["A"] == -8 and unlike == []
    assert ("A", "B") in temporal.offsets([("A", "B", q(3)), ("B", "A", q(-2))])[1]


def test_windows_cross_axes(spark):
    rows = [
        ("a.md", "---\nid: Tape\nkind: Timeline\n---\n"), ("b.md", "---\nid: Reel\nkind: Timeline\nmapsTo: {timeline: Tape, offset: -500}\n---\n"),
        ("c.md", "---\nid: Cut\nkind: Timeline\nmapsTo: [{timeline: Tape, scale: 1/25, offset: 60, range: {from: 0, to: 2000}}]\n---\n"),
        ("d.md", "---\nid: Back\nkind: Timeline\nmapsTo: [{timeline: Tape, scale: -1}]\n---\n"),
        ("e.md", "---\nid: Scene\nkind: Timeline\nmapsTo: [{timeline: Tape, segments: [{source: {from: 0, to: 4}, target: {from: 60, to: 64}}, {source: {from: 10, to: 12}, target: {from: 70, to: 72}}]}]\n---\n"),
        ("f.md", "---\nid: Code\nkind: Timeline\ncoordinate: {kind: timecode, actualFps: 25, nominalFps: 25}\nmapsTo: [{timeline: Tape, scale: 1/25}]\n---\n"),
        ("g.md", "---\nid: Later\nkind: Timeline\nderivedFrom: {timeline: Tape, scale: 2, offset: 1}\n---\n"),
        ("t.md", "---\nid: Shot\nkind: NodeType\n---\n"), ("n.md", "---\nid: shot\ntype: Shot\nvalidTime: [{timeline: Tape, from: 60, to: 61}]\n---\n"),
    ]
    g, problems = markdown.load(spark.createDataFrame(rows, "path string, text string"))
    assert problems.count() == 0
    hit = lambda clause: [r[0] for r in run(g, f"MATCH (n:Shot) VALID {clause} RETURN ID(n)").rows.collect()]
    assert hit("ON Reel AT 560") == ["shot"] and hit("ON Reel AT 562") == [] and hit("ON Reel OVERLAPS [561, 700]") == ["shot"]
    assert hit("ON Cut AT 25") == ["shot"] and hit("ON Cut AT 26") == [] and hit("ON Cut OVERLAPS [0, 25]") == []
    assert hit("ON Back AT -60") == []  # a search follows maps in order alone
    assert hit("ON Scene AT 1") == ["shot"] and hit("ON Scene AT 3") == [] and hit("ON Scene OVERLAPS [0, 1]") == []
    assert hit('ON Code AT "00:01:00:24"') == ["shot"] and hit('ON Code AT "00:01:01:01"') == []
    assert hit("ON Later AT 122") == ["shot"] and hit("ON Later AT 124") == []


def test_weeks_of_every_year():
    """Occurrences of days of weeks against datetime; the 53rd week only where a year has one."""
    for week, day in ((1, 1), (9, 7), (52, 4), (53, 1), (53, 7)):
        want = []
        for year in range(1995, 2030):
            try:
                want.append(datetime.date.fromisocalendar(year, week, day).toordinal() + 1721425)
            except ValueError:
                continue
        assert calendar.occurrences(*divmod(2000 + 10 * week + day, 100), 1995, 2029) == want
