"""Exact interval sets, as a class for the driver and as SQL expressions over columns.

A bound is a *cut* between coordinates: the place before a coordinate x is (x, 0), the place after it (x, 1). An interval
is everything from one cut up to another, so inclusive and exclusive ends need no cases: [1, 2) runs from (1, 0) to (2, 0),
[1, 2] from (1, 0) to (2, 1), and two intervals join if the cut where one ends is not before the cut where the other begins.

In columns a cut is struct<w, f, s>: the floor of the coordinate, its fraction with 37 decimals, and the side. Two fractions
with denominators below 10^18 differ by more than 10^-36, so the decimals order coordinates exactly, and structs compare
field by field. Unbounded ends have the least and greatest long. A validity is struct<universal, ivs>, where ivs is
sorted by axis and cut, and disjoint; universal (valid at any time) differs from an empty set and from NULL.

Two sets meet in a sweep over their cuts in order. In a set begins and ends alternate, so of an event that is the k-th of
its own set and stands at place p of all, k says whether its own set holds from there on, and p - k, the number of the
other set's events before it, whether the other one does. Nothing is carried from event to event: the cost is that of
sorting. Small sets are compared pair by pair, which gives the same.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction

LOW, HIGH = -(2**63), 2**63 - 1
CUT = "struct<w:bigint,f:decimal(38,37),s:int>"
INTERVAL = f"struct<axis:string,lo:{CUT},hi:{CUT}>"
VALIDITY = f"struct<universal:boolean,ivs:array<{INTERVAL}>>"


@dataclass(frozen=True, order=True)
class Cut:
    """A place between coordinates; side 0 is before `at`, 1 after it. at is None for an unbounded end (side tells which)."""

    at: Fraction
    side: int

    def sql(self) -> str:
        w = self.at.numerator // self.at.denominator
        f = self.at - w
        digits = f.numerator * 10**37 // f.denominator
        low = "-9223372036854775807L - 1" if w == LOW else f"{w}L"
        return f"named_struct('w', {low}, 'f', CAST('{digits // 10**37}.{digits % 10**37:037d}' AS DECIMAL(38,37)), 's', {self.side})"


MINUS, PLUS = Cut(Fraction(LOW), 0), Cut(Fraction(HIGH), 1)


def coordinate(x: int | float | str | Fraction) -> Fraction:
    """Doubles convert through their decimal text, so 0.1 is exactly 1/10."""
    return Fraction(repr(x)) if isinstance(x, float) else Fraction(x)


@dataclass(frozen=True, order=True)
class Interval:
    axis: str
    lo: Cut
    hi: Cut

    @staticmethod
    def of(axis: str, lo=None, hi=None, lo_inc: bool = True, hi_inc: bool = True) -> Interval:
        return Interval(axis, MINUS if lo is None else Cut(coordinate(lo), 0 if lo_inc else 1), PLUS if hi is None else Cut(coordinate(hi), 1 if hi_inc else 0))

    def __str__(self) -> str:
        lo = "(-INF" if self.lo == MINUS else f"{'[' if self.lo.side == 0 else '('}{self.lo.at}"
        hi = "+INF)" if self.hi == PLUS else f"{self.hi.at}{']' if self.hi.side == 1 else ')'}"
        return f"{self.axis}: {lo}, {hi}"


class IntervalSet:
    """A validity on the driver; every operation gives a canonical set."""

    def __init__(self, ivs: Iterable[Interval] = (), universal: bool = False):
        self.universal = universal
        out: list[Interval] = []
        for x in sorted(i for i in ivs if i.lo < i.hi):
            if out and out[-1].axis == x.axis and x.lo <= out[-1].hi:
                out[-1] = Interval(x.axis, out[-1].lo, max(out[-1].hi, x.hi))
            else:
                out.append(x)
        self.ivs = () if universal else tuple(out)

    def __eq__(self, other) -> bool:
        return isinstance(other, IntervalSet) and (self.universal, self.ivs) == (other.universal, other.ivs)

    def __hash__(self) -> int:
        return hash((self.universal, self.ivs))

    def __bool__(self) -> bool:
        return self.universal or bool(self.ivs)

    def __repr__(self) -> str:
        return "Anytime" if self.universal else ", ".join(map(str, self.ivs)) or "Empty"

    def _sweep(self, other: IntervalSet, want) -> IntervalSet:
        """What lies between neighbouring cuts where want(in this, in the other); see the module."""
        events = sorted((i.axis, cut, side, 2 * k + end) for side, s in enumerate((self, other)) for k, i in enumerate(s.ivs) for end, cut in enumerate((i.lo, i.hi)))
        out = []
        for p, (axis, cut, side, k) in enumerate(events[:-1]):
            held = (k % 2 == 0, (p - k) % 2 == 1)
            if want(*(held if side == 0 else held[::-1])):
                out.append(Interval(axis, cut, events[p + 1][1]))
        return IntervalSet(out)

    def intersect(self, other: IntervalSet) -> IntervalSet:
        if self.universal:
            return other
        if other.universal:
            return self
        return self._sweep(other, lambda a, b: a and b)

    def union(self, other: IntervalSet) -> IntervalSet:
        return IntervalSet((*self.ivs, *other.ivs), self.universal or other.universal)

    def subtract(self, other: IntervalSet) -> IntervalSet:
        """Universal less a finite set has no finite answer: name the timelines first (see `within`)."""
        if other.universal:
            return IntervalSet()
        if self.universal:
            if other.ivs:
                raise ValueError("a universal set less a finite one")
            return self
        return self._sweep(other, lambda a, b: a and not b)

    def within(self, axes: Iterable[str]) -> IntervalSet:
        """A universal set as all of the given axes."""
        axes = list(axes)
        return IntervalSet(Interval.of(a) for a in axes) if self.universal and axes else self

    def contains(self, other: IntervalSet) -> bool:
        """Whether each interval of the other lies inside one of this."""
        if self.universal:
            return True
        return not other.universal and not other.subtract(self)

    def at(self, axis: str, x) -> bool:
        return bool(self.intersect(IntervalSet([Interval.of(axis, x, x)])))

    def sql(self) -> str:
        ivs = ", ".join(f"named_struct('axis', '{i.axis}', 'lo', {i.lo.sql()}, 'hi', {i.hi.sql()})" for i in self.ivs)
        return f"CAST(named_struct('universal', {str(self.universal).lower()}, 'ivs', array({ivs})) AS {VALIDITY})"


ANYTIME, NEVER = IntervalSet(universal=True), IntervalSet()

# columns: every function takes and gives SQL text


def cut_sql(value: str, side: int, empty: str) -> str:
    """The cut at a BIGINT expression; `empty` (LOW or HIGH) stands for NULL."""
    end = MINUS.sql() if empty == "LOW" else PLUS.sql()
    return f"CASE WHEN {value} IS NULL THEN {end} ELSE named_struct('w', CAST({value} AS BIGINT), 'f', CAST(0 AS DECIMAL(38,37)), 's', {side}) END"


def interval_sql(axis: str, lo: str, hi: str, lo_inc: bool = True, hi_inc: bool = True) -> str:
    """A validity of one interval between BIGINT expressions; NULL is unbounded. axis: a literal name."""
    i = f"named_struct('axis', '{axis}', 'lo', {cut_sql(lo, 0 if lo_inc else 1, 'LOW')}, 'hi', {cut_sql(hi, 1 if hi_inc else 0, 'HIGH')})"
    return f"CAST(named_struct('universal', false, 'ivs', filter(array({i}), i -> i.lo < i.hi)) AS {VALIDITY})"


def _set(ivs: str) -> str:
    return f"named_struct('universal', false, 'ivs', {ivs})"


_REACH = f"struct<axis:string,hi:{CUT}>"


def normalise_sql(ivs: str) -> str:
    """Sorted and merged intervals of an array of intervals.

    A few are folded. Of many, an interval begins a new one if all before it on its axis end before it; how far these reach
    is carried through blocks of the square root of the number, since an array that grows in a fold is copied at each step.
    """
    none = f"CAST(array() AS array<{INTERVAL}>)"
    few = (
        f"aggregate(p, struct(CAST(NULL AS {INTERVAL}) AS l, {none} AS o), (a, x) -> CASE WHEN a.l IS NULL THEN struct(x AS l, a.o AS o) "
        f"WHEN a.l.axis = x.axis AND x.lo <= a.l.hi THEN struct(named_struct('axis', x.axis, 'lo', a.l.lo, 'hi', greatest(a.l.hi, x.hi)) AS l, a.o AS o) "
        f"ELSE struct(x AS l, array_append(a.o, a.l) AS o) END, a -> array_append(a.o, a.l))"
    )
    blocks = "transform(sequence(0, CAST((size(p) - 1) / k AS INT)), n -> slice(p, n * k + 1, k))"
    reach = "array_max(transform(z, x -> named_struct('axis', x.axis, 'hi', x.hi)))"
    before = f"aggregate(transform(q, z -> {reach}), struct(CAST(NULL AS {_REACH}) AS m, CAST(array() AS array<{_REACH}>) AS o), (a, m) -> struct(greatest(a.m, m) AS m, array_append(a.o, a.m) AS o), a -> a.o)"
    reached = "greatest(a.m, named_struct('axis', x.axis, 'hi', x.hi))"
    step = f"struct({reached} AS m, array_append(a.o, struct(x.axis AS axis, x.lo AS lo, coalesce(a.m.axis <> x.axis OR a.m.hi < x.lo, true) AS first, {reached}.hi AS hi)) AS o)"
    marked = f"flatten(zip_with(q, {before}, (z, c) -> aggregate(z, struct(c AS m, CAST(array() AS array<struct<axis:string,lo:{CUT},first:boolean,hi:{CUT}>>) AS o), (a, x) -> {step}, a -> a.o)))"
    firsts = "filter(transform(e, (y, i) -> CASE WHEN y.first THEN i END), i -> i IS NOT NULL)"
    whole = f"get(transform(array({firsts}), f -> transform(f, (i, n) -> named_struct('axis', get(e, i).axis, 'lo', get(e, i).lo, 'hi', get(e, coalesce(get(f, n + 1), size(e)) - 1).hi))), 0)"
    many = f"get(transform(array(CAST(sqrt(size(p)) AS INT)), k -> get(transform(array({blocks}), q -> get(transform(array({marked}), e -> {whole}), 0)), 0)), 0)"
    return f"get(transform(array(array_sort(filter({ivs}, i -> i.lo < i.hi))), p -> CASE WHEN size(p) < 2 THEN p WHEN size(p) < 64 THEN {few} ELSE {many} END), 0)"


_EVENT = f"struct<axis:string,c:{CUT},o:int,k:int>"
#: Pairs of intervals up to which two sets are compared pair by pair.
_FEW = 64


def _sweep_sql(a: str, b: str, held: str) -> str:
    """The intervals between neighbouring cuts of two arrays of disjoint intervals where `held`, which names the
    conditions {a} and {b} (the first and the second set hold from this cut on)."""
    of = lambda ivs, o: f"flatten(transform({ivs}, (x, i) -> array(named_struct('axis', x.axis, 'c', x.lo, 'o', {o}, 'k', 2 * i), named_struct('axis', x.axis, 'c', x.hi, 'o', {o}, 'k', 2 * i + 1))))"
    events = f"array_sort(CAST(concat({of(a, 0)}, {of(b, 1)}) AS array<{_EVENT}>))"
    own, other = "e.k % 2 = 0", "(n - e.k) % 2 = 1"
    test = held.format(a=f"CASE WHEN e.o = 0 THEN {own} ELSE {other} END", b=f"CASE WHEN e.o = 1 THEN {own} ELSE {other} END")
    pieces = f"transform(q, (e, n) -> CASE WHEN {test} THEN named_struct('axis', e.axis, 'lo', e.c, 'hi', get(q, n + 1).c) END)"
    return f"get(transform(array({events}), q -> filter({pieces}, z -> z.lo < z.hi)), 0)"


def intersect_sql(a: str, b: str) -> str:
    pairs = f"flatten(transform({a}.ivs, x -> transform(filter({b}.ivs, y -> y.axis = x.axis), y -> named_struct('axis', x.axis, 'lo', greatest(x.lo, y.lo), 'hi', least(x.hi, y.hi)))))"
    few = f"filter({pairs}, z -> z.lo < z.hi)"
    met = f"CASE WHEN size({a}.ivs) * size({b}.ivs) <= {_FEW} THEN {few} ELSE {_sweep_sql(f'{a}.ivs', f'{b}.ivs', '{a} AND {b}')} END"
    return f"CASE WHEN {a}.universal THEN {b} WHEN {b}.universal THEN {a} ELSE {_set(met)} END"


def union_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a}.universal OR {b}.universal THEN {ANYTIME.sql()} ELSE {_set(normalise_sql(f'concat({a}.ivs, {b}.ivs)'))} END"


def union_all_sql(sets: str) -> str:
    """The union of an array of validities."""
    return f"CASE WHEN exists({sets}, v -> v.universal) THEN {ANYTIME.sql()} ELSE {_set(normalise_sql(f'flatten(transform({sets}, v -> v.ivs))'))} END"


def subtract_sql(a: str, b: str, axes: Iterable[str] = ()) -> str:
    """a less b; a universal a is all the given axes unless b is empty. Of few intervals of b, the gaps between neighbours are
    met with each of a."""
    whole = IntervalSet(Interval.of(x) for x in axes).sql()
    base = f"CASE WHEN {a}.universal THEN {whole}.ivs ELSE {a}.ivs END"
    gap = "named_struct('axis', x.axis, 'lo', greatest(x.lo, get(u, i - 1).hi), 'hi', least(x.hi, get(u, i).lo))"
    gaps = f"get(transform(array(filter({b}.ivs, y -> y.axis = x.axis)), u -> transform(sequence(0, size(u)), i -> {gap})), 0)"
    cut = f"filter(flatten(transform({base}, x -> {gaps})), z -> z.lo < z.hi)"
    left = f"CASE WHEN size({b}.ivs) = 0 THEN {base} WHEN size({b}.ivs) <= 4 THEN {cut} ELSE get(transform(array({base}), w -> {_sweep_sql('w', f'{b}.ivs', '{a} AND NOT ({b})')}), 0) END"
    return f"CASE WHEN {b}.universal THEN {NEVER.sql()} WHEN {a}.universal AND size({b}.ivs) = 0 THEN {a} ELSE {_set(left)} END"


def within_sql(a: str, axes: Iterable[str]) -> str:
    """A universal validity as all of the axes, if there are any."""
    axes = list(axes)
    return f"CASE WHEN {a}.universal THEN {IntervalSet(Interval.of(x) for x in axes).sql()} ELSE {a} END" if axes else a


def on_axes_sql(a: str, axes: Iterable[str]) -> str:
    """The intervals on the given axes; a universal validity has none."""
    names = ", ".join(f"'{x}'" for x in axes)
    return _set(f"filter({a}.ivs, i -> i.axis IN ({names}))")


def contains_sql(a: str, b: str) -> str:
    few = f"forall({b}.ivs, y -> exists({a}.ivs, x -> x.axis = y.axis AND x.lo <= y.lo AND y.hi <= x.hi))"
    inside = f"CASE WHEN size({a}.ivs) * size({b}.ivs) <= {_FEW} THEN {few} ELSE size({_sweep_sql(f'{b}.ivs', f'{a}.ivs', '{a} AND NOT ({b})')}) = 0 END"
    return f"({a}.universal OR (NOT {b}.universal AND {inside}))"


def some_sql(a: str) -> str:
    """Whether there is any time in it."""
    return f"({a}.universal OR size({a}.ivs) > 0)"


#: Powers of two by which lengths of time are told apart in buckets.
LEVELS = tuple(range(0, 42, 2))
BUCKET = "t_axis string, t_level int, t_bucket bigint"


def bucket_sql(a: str, apart: Iterable[str] = ()) -> str:
    """A struct of the columns of BUCKET: where on its axis a validity lies, by its length and its begin.

    The level is the least of LEVELS whose power of two is over the length, the bucket the begin divided by that power. So
    what begins in bucket b ends before bucket b + 2, and rows sorted by axis, level and bucket lie as their times do,
    the long ones apart from the short. No level stands for what a window cannot rule out: universal times, open ones,
    those on several axes or on one of `apart` (recurring times, which are spelt out on another axis). Ends and level are
    named by lambdas, so that each is worked out once for a row.
    """
    ivs = f"{a}.ivs"
    ends = f"named_struct('lo', array_min(transform({ivs}, i -> i.lo)).w, 'hi', array_max(transform({ivs}, i -> i.hi)).w)"
    off = " OR ".join(f"{ivs}[0].axis = '{x}'" for x in apart) or "false"
    one = f"NOT {a}.universal AND size({ivs}) > 0 AND forall({ivs}, i -> i.axis = {ivs}[0].axis) AND e.lo > {-(2**61)}L AND e.hi < {2**61}L AND NOT ({off})"
    powers = ", ".join(map(str, LEVELS))
    level = f"CASE WHEN {one} THEN array_min(get(transform(array(e.hi - e.lo), d -> filter(array({powers}), l -> shiftright(d, l) = 0)), 0)) END"
    placed = f"get(transform(array({ends}), e -> named_struct('lo', e.lo, 'level', {level})), 0)"
    return f"get(transform(array({placed}), z -> named_struct('t_axis', CASE WHEN z.level IS NOT NULL THEN {ivs}[0].axis END, 't_level', CAST(z.level AS INT), 't_bucket', shiftright(z.lo, z.level))), 0)"


def bucket_test(window: IntervalSet) -> str:
    """A test on the columns of BUCKET that all pass which have a time in common with the window, fit for a scan."""
    hits = []
    for i in window.ivs:
        for level in LEVELS:
            lo = None if i.lo == MINUS else (i.lo.at.numerator // i.lo.at.denominator >> level) - 1
            hi = None if i.hi == PLUS else i.hi.at.numerator // i.hi.at.denominator >> level
            ends = [f"t_bucket >= {lo}L"] * (lo is not None) + [f"t_bucket <= {hi}L"] * (hi is not None)
            hits.append(" AND ".join([f"t_axis = {i.axis!r}", f"t_level = {level}", *ends]))
    return "(t_level IS NULL" + "".join(f" OR ({h})" for h in hits) + ")"


def rows_sql(a: str) -> str:
    """An array with a flat struct for each interval: axis, lo, lo_inc, hi, hi_inc; a universal validity has one of NULLs.

    lo and hi are DOUBLE, NULL where unbounded.
    """
    end = lambda c, s, bound: f"CASE WHEN i.{c}.w = {'-9223372036854775807L - 1' if bound == LOW else f'{HIGH}L'} THEN NULL ELSE CAST(i.{c}.w AS DOUBLE) + CAST(i.{c}.f AS DOUBLE) END"
    row = f"named_struct('axis', i.axis, 'lo', {end('lo', 0, LOW)}, 'lo_inc', i.lo.s = 0, 'hi', {end('hi', 1, HIGH)}, 'hi_inc', i.hi.s = 1)"
    empty = "named_struct('axis', CAST(NULL AS STRING), 'lo', CAST(NULL AS DOUBLE), 'lo_inc', CAST(NULL AS BOOLEAN), 'hi', CAST(NULL AS DOUBLE), 'hi_inc', CAST(NULL AS BOOLEAN))"
    return f"CASE WHEN {a}.universal THEN array({empty}) ELSE transform({a}.ivs, i -> {row}) END"


def display_sql(a: str) -> str:
    """Text as IntervalSet shows it: fractions as p/q, as decimals where q is over 10 000."""
    q = "get(filter(sequence(2, 10000), q -> abs(CAST({c}.f AS DOUBLE) * q - round(CAST({c}.f AS DOUBLE) * q)) < 1e-9), 0)"
    part = f"coalesce(get(transform(array({q}), q -> CASE WHEN q IS NOT NULL THEN concat({{c}}.w * q + CAST(round(CAST({{c}}.f AS DOUBLE) * q) AS BIGINT), '/', q) END), 0), CAST({{c}}.w + CAST({{c}}.f AS DOUBLE) AS STRING))"
    shown = f"CASE WHEN {{c}}.f = 0 THEN CAST({{c}}.w AS STRING) ELSE {part} END"
    lo = f"CASE WHEN i.lo.w = -9223372036854775807L - 1 THEN '(-INF' ELSE concat(CASE WHEN i.lo.s = 0 THEN '[' ELSE '(' END, {shown.format(c='i.lo')}) END"
    hi = f"CASE WHEN i.hi.w = {HIGH}L THEN '+INF)' ELSE concat({shown.format(c='i.hi')}, CASE WHEN i.hi.s = 1 THEN ']' ELSE ')' END) END"
    return f"CASE WHEN {a}.universal THEN 'Anytime' WHEN size({a}.ivs) = 0 THEN 'Empty' ELSE array_join(transform({a}.ivs, i -> concat(i.axis, ': ', {lo}, ', ', {hi})), ', ') END"


def _day_sql(year: str, code: str) -> str:
    """The day number of 100 * month + day in a year, 99 being the month's last; NULL where the year has no such day. From
    2000 on it is 2000 + 10 * week + day of a week, in the year of the week."""
    fourth = lambda y: f"(datediff(make_date({y}, 1, 4), DATE'1970-01-01') + 2440588)"
    monday = lambda y: f"({fourth(y)} - pmod({fourth(y)}, 7))"
    week = f"({monday(year)} + 7 * CAST((({code}) - 2000) DIV 10 - 1 AS INT))"
    weeks = f"WHEN ({code}) >= 2000 THEN CASE WHEN {week} < {monday(f'({year} + 1)')} THEN {week} + CAST(({code}) % 10 AS INT) - 1 END"
    first = f"make_date({year}, CAST(({code}) DIV 100 AS INT), 1)"
    return f"CASE {weeks} WHEN ({code}) % 100 = 99 THEN datediff(last_day({first}), DATE'1970-01-01') + 2440588 WHEN ({code}) % 100 <= day(last_day({first})) THEN datediff(date_add({first}, CAST(({code}) % 100 AS INT) - 1), DATE'1970-01-01') + 2440588 END"


def recur_sql(a: str, pattern: str, real: str, years: tuple[int, int], lo: int, hi: int) -> str:
    """A validity with its intervals on a pattern's axis spelt out on the calendar axis, within days [lo, hi).

    Each start runs through the first end at most 371 days after it; an open end is a single day. Ends of the next year
    stand 10000 higher.
    """
    begin = f"CASE WHEN p.lo.w = {LOW + 1}L - 1 THEN p.hi.w ELSE p.lo.w END"
    end = f"CASE WHEN p.hi.w = {HIGH}L THEN p.lo.w ELSE p.hi.w % 10000 END"
    start = _day_sql("y", begin)
    stop = f"coalesce(CASE WHEN {_day_sql('y', end)} >= {start} THEN {_day_sql('y', end)} END, CASE WHEN {_day_sql('y + 1', end)} <= {start} + 371 THEN {_day_sql('y + 1', end)} END)"
    zero = "CAST(0 AS DECIMAL(38,37))"
    one = (
        f"named_struct('axis', '{real}', 'lo', named_struct('w', CAST(greatest({start}, {lo}) AS BIGINT), 'f', {zero}, 's', 0), "
        f"'hi', named_struct('w', CAST(least({stop} + 1, {hi}) AS BIGINT), 'f', {zero}, 's', 0))"
    )
    each = f"transform(filter(sequence({years[0] - 1}, {years[1] + 1}), y -> {start} IS NOT NULL AND {stop} IS NOT NULL), y -> {one})"
    spelt = f"flatten(transform(filter({a}.ivs, i -> i.axis = '{pattern}'), p -> {each}))"
    return f"CASE WHEN {a}.universal THEN {a} ELSE {_set(normalise_sql(f'concat(filter({a}.ivs, i -> i.axis <> {chr(39)}{pattern}{chr(39)}), {spelt})'))} END"
