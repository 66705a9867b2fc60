"""Coordinate systems, maps between axes, conversion and comparison of coordinates.

A system places a coordinate on its axis, as a point or as a period (a month, a quarter, an ISO week), and names the place
again. Everything is exact. These run on the driver, on the few coordinates of queries and catalogs; documents use them
where they are parsed.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

from tessella.functions.calendar import gregorian_day, julian_day, month_days
from tessella.functions.intervals import MINUS, PLUS, Cut, Interval, IntervalSet
from tessella.functions.intervals import coordinate as exact
from tessella.plans.syntax import QueryError


@dataclass(frozen=True)
class Span:
    """A point, or a period [lo, hi); closed: [lo, hi]."""

    lo: Fraction
    hi: Fraction
    point: bool = True
    closed: bool = False


def wrong(text) -> QueryError:
    return QueryError("GMQL4003", f"{text!r} is no coordinate of this timeline")


class System:
    """How a timeline writes its coordinates."""

    def span(self, value) -> Span:
        x = self.point(value)
        return Span(x, x)

    def point(self, value) -> Fraction:
        raise NotImplementedError

    def name(self, x: Fraction) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Number(System):
    """axis = coordinate * scale + offset."""

    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    def point(self, value) -> Fraction:
        try:
            return exact(value) * self.scale + self.offset
        except ValueError:
            raise wrong(value) from None

    def name(self, x: Fraction) -> str:
        return str((x - self.offset) / self.scale)


@dataclass(frozen=True)
class Numbering:
    """Years as written. zero: there is a year 0; shift: the written year is the common one plus this."""

    shift: int = 0
    zero: bool = False

    def astronomical(self, year: int) -> int | None:
        y = year - self.shift
        return y if self.zero or y > 0 else y + 1 if y < 0 else None

    def written(self, year: int) -> int:
        return (year if self.zero or year > 0 else year - 1) + self.shift

    @staticmethod
    def of(spec) -> Numbering:
        if isinstance(spec, dict):
            return Numbering(int(spec.get("offset", 0)), bool(spec.get("yearZero", False)))
        return Numbering(zero=spec == "astronomical")


@dataclass(frozen=True)
class Days(System):
    """Dates of the Gregorian or Julian calendar, as day numbers."""

    calendar: str = "gregorian"
    years: Numbering = Numbering()

    def day(self, year: int, month: int, day: int, text="") -> int:
        y = self.years.astronomical(year)
        if y is None or not 1 <= month <= 12 or not 1 <= day <= month_days(y, month, self.calendar):
            raise wrong(text or f"{year}-{month}-{day}")
        return (gregorian_day if self.calendar == "gregorian" else julian_day)(y, month, day)

    def point(self, value) -> Fraction:
        m = re.fullmatch(r"\s*([+-]?\d{1,9})-(\d{1,2})-(\d{1,2})\s*", value) if isinstance(value, str) else None
        if not m:
            raise wrong(value)
        return Fraction(self.day(*map(int, m.groups()), text=value))

    def date(self, x: Fraction) -> tuple[int, int, int]:
        """Year, month and day as written; found between the first days of years and months."""
        n = int(x)
        number = gregorian_day if self.calendar == "gregorian" else julian_day
        year = (n - 1721424) * 400 // 146097 + 1
        while number(year, 1, 1) > n:
            year -= 1
        while number(year + 1, 1, 1) <= n:
            year += 1
        month = max(m for m in range(1, 13) if number(year, m, 1) <= n)
        return self.years.written(year), month, n - number(year, month, 1) + 1

    def name(self, x: Fraction) -> str:
        if x.denominator != 1:
            raise wrong(x)
        y, m, d = self.date(x)
        return f"{'-' if y < 0 else ''}{abs(y):04d}-{m:02d}-{d:02d}"


@dataclass(frozen=True)
class Frames(System):
    """Whole frames from a first number on."""

    start: int = 0

    def point(self, value) -> Fraction:
        try:
            x = exact(value)
        except ValueError:
            raise wrong(value) from None
        if x.denominator != 1:
            raise wrong(value)
        return x - self.start

    def name(self, x: Fraction) -> str:
        if x.denominator != 1:
            raise wrong(x)
        return str(x + self.start)


@dataclass(frozen=True)
class Timecode(System):
    """hh:mm:ss:ff as frames. drop: two of 30, four of 60 labels are left out each minute that is not a tenth one."""

    nominal: int = 30
    drop: bool = False
    wrap: int | None = None

    @property
    def _left_out(self) -> int:
        return self.nominal // 15 if self.drop else 0

    def point(self, value) -> Fraction:
        m = re.fullmatch(r"\s*(\d+):(\d{2}):(\d{2})[:;](\d{2,3})\s*", value) if isinstance(value, str) else None
        if not m:
            raise wrong(value)
        h, minute, s, f = map(int, m.groups())
        minutes = 60 * h + minute
        dropped = s == 0 and minute % 10 and f < self._left_out
        if minute > 59 or s > 59 or f >= self.nominal or dropped or self.wrap is not None and h >= self.wrap:
            raise wrong(value)
        return Fraction((minutes * 60 + s) * self.nominal + f - self._left_out * (minutes - minutes // 10))

    def name(self, x: Fraction) -> str:
        if x.denominator != 1 or x < 0:
            raise wrong(x)
        n = int(x)
        if self.drop:
            ten = 600 * self.nominal - 9 * self._left_out
            tens, rest = divmod(n, ten)
            # the first of ten minutes is whole, the nine others are short
            short = max(0, rest - 60 * self.nominal)
            begun = 0 if rest < 60 * self.nominal else 1 + short // (60 * self.nominal - self._left_out)
            n += self._left_out * (9 * tens + begun)
        seconds, f = divmod(n, self.nominal)
        h, rest = divmod(seconds, 3600)
        if self.wrap is not None and h >= self.wrap:
            raise wrong(x)
        return f"{h:02d}:{rest // 60:02d}:{rest % 60:02d}{';' if self.drop else ':'}{f:02d}"


@dataclass(frozen=True)
class Era(System):
    """Years counted anew from named days of a calendar. periods: (name, aliases, first day, first year)."""

    calendar: Days
    periods: tuple[tuple[str, tuple[str, ...], str, int], ...]

    def _since(self, i: int) -> Fraction | None:
        return self.calendar.point(self.periods[i][2]) if i < len(self.periods) else None

    def point(self, value) -> Fraction:
        m = re.fullmatch(r"\s*([^\s:-]+)[\s:-]+(\d+)-(\d{1,2})-(\d{1,2})\s*", value) if isinstance(value, str) else None
        if not m:
            raise wrong(value)
        for i, (name, aliases, since, first) in enumerate(self.periods):
            if m[1] == name or m[1] in aliases:
                begun, after = self._since(i), self._since(i + 1)
                x = Fraction(self.calendar.day(self.calendar.date(begun)[0] + int(m[2]) - first, int(m[3]), int(m[4]), value))
                if x < begun or after is not None and x >= after:
                    raise wrong(value)
                return x
        raise wrong(value)

    def name(self, x: Fraction) -> str:
        begun = [(self._since(i), i) for i in range(len(self.periods))]
        held = [p for p in begun if p[0] <= x]
        if not held or x.denominator != 1:
            raise wrong(x)
        since, i = max(held)
        y, m, d = self.calendar.date(x)
        return f"{self.periods[i][0]} {self.periods[i][3] + y - self.calendar.date(since)[0]}-{m:02d}-{d:02d}"


#: Fields of patterns, with their usual widths and what stands before them.
FIELDS = {"year": (4, ""), "quarter": (1, "Q"), "month": (2, ""), "day": (2, ""), "weekYear": (4, ""), "week": (2, "W")}


@dataclass(frozen=True)
class Pattern(System):
    """Parts of a date: a year, a month, a quarter of a (fiscal) year, an ISO week, a date.

    quarter: the month in which quarters begin; label_end: a fiscal year is named after the year in which it ends.
    """

    calendar: Days
    fields: tuple[str, ...]
    format: str | None = None
    quarter: int = 1
    label_end: bool = False

    @property
    def template(self) -> str:
        if self.format:
            return self.format
        return "-".join(f"{FIELDS[f][1]}{{{f}:{FIELDS[f][0]}}}" for f in FIELDS if f in self.fields)

    def read(self, text: str) -> dict[str, int]:
        """The fields of a text that has the template's form."""
        seen: list[str] = []
        form = ""
        for fixed, name, width in re.findall(r"([^{]*)(?:\{(\w+)(?::(\d+))?\})?", self.template):
            form += re.escape(fixed)
            if name:
                seen.append(name)
                sign = "[+-]?" if name in ("year", "weekYear") else ""
                w = int(width) if width else FIELDS.get(name, (1,))[0]
                form += f"({sign}\\d{{{w},}})" if width or sign else f"(\\d{{{w}}})"
        m = re.fullmatch(form, text.strip()) if isinstance(text, str) else None
        if not m or sorted(seen) != sorted(self.fields):
            raise wrong(text)
        return {f: int(v) for f, v in zip(seen, m.groups(), strict=True)}

    def show(self, values: dict[str, int]) -> str:
        def one(m: re.Match) -> str:
            v, w = values[m[1]], int(m[2]) if m[2] else FIELDS[m[1]][0]
            return ("-" if v < 0 else "") + str(abs(v)).rjust(w, "0")

        return re.sub(r"\{(\w+)(?::(\d+))?\}", one, self.template)

    def _first(self, months: int) -> Fraction:
        """The first day of the month that is so many months after January of the year 0."""
        return Fraction(self.calendar.day(self.calendar.years.written(months // 12), months % 12 + 1, 1))

    def span_of(self, v: dict[str, int]) -> Span:
        c = self.calendar
        if "weekYear" in v:
            year = c.years.astronomical(v["weekYear"])
            if year is None:
                raise wrong(v)
            first, after = iso_year(year), iso_year(year + 1)
            if "week" not in v:
                return Span(first, after, False)
            lo = first + 7 * (v["week"] - 1)
            if not first <= lo < after:
                raise wrong(v)
            return Span(lo, lo + 7, False)
        year = c.years.astronomical(v["year"])
        if year is None:
            raise wrong(v)
        if "day" in v:
            x = Fraction(c.day(v["year"], v["month"], v["day"]))
            return Span(x, x)
        if "quarter" in v:
            if not 1 <= v["quarter"] <= 4:
                raise wrong(v)
            at = 12 * (year - (self.label_end and self.quarter != 1)) + self.quarter - 1 + 3 * (v["quarter"] - 1)
            return Span(self._first(at), self._first(at + 3), False)
        if "month" in v:
            if not 1 <= v["month"] <= 12:
                raise wrong(v)
            return Span(self._first(12 * year + v["month"] - 1), self._first(12 * year + v["month"]), False)
        return Span(self._first(12 * year), self._first(12 * year + 12), False)

    def span(self, value) -> Span:
        return self.span_of(self.read(value))

    def point(self, value) -> Fraction:
        s = self.span(value)
        if not s.point:
            raise wrong(value)
        return s.lo

    def name(self, x: Fraction) -> str:
        if set(self.fields) != {"year", "month", "day"} or x.denominator != 1:
            raise wrong(x)
        return self.show(dict(zip(("year", "month", "day"), self.calendar.date(x), strict=True)))


def iso_year(year: int) -> Fraction:
    """The Monday of the week with 4 January."""
    at = gregorian_day(year, 1, 4)
    return Fraction(at - at % 7)


def _calendar(spec: dict) -> Days:
    return Days(spec.get("calendar", "gregorian"), Numbering.of(spec.get("numbering")))


@functools.lru_cache(maxsize=1000)
def _made(kind: str, spec: str, scale: Fraction, offset: Fraction) -> System:
    d = json.loads(spec)
    if kind in ("gregorian", "julian"):
        return Days(kind, Numbering.of(d.get("numbering")))
    if kind == "frame":
        return Frames(int(d.get("start", 0)))
    if kind == "timecode":
        return Timecode(int(d.get("nominalFps", 30)), bool(d.get("dropFrame", False)), d.get("wrapHours"))
    if kind == "era":
        periods = tuple((str(p["name"]), tuple(map(str, p.get("aliases") or ())), str(p["since"]), int(p.get("firstYear", 1))) for p in d["periods"])
        return Era(_calendar(d.get("of") or {}), periods)
    if kind in ("dates", "pattern"):
        return Pattern(_calendar(d), tuple(d.get("fields") or ("month", "day")), d.get("format"), int(d.get("quarterStartMonth", 1)), d.get("quarterYearLabel") == "end")
    return Number(scale, offset)


def system_of(timeline) -> System:
    """The system of a timeline (see operators.graph.Timeline)."""
    return _made(timeline.system, timeline.spec or "{}", Fraction(timeline.scale), Fraction(timeline.offset))


def span(timeline, value) -> Span:
    """Where on its axis a coordinate of a query or document lies.

    A yearly pattern's days are 100 * month + day on an axis of their own, 99 a month's last; a month or a quarter reaches
    from its first day to its last, which may lie 10000 further, in the next year. Days of weeks are 2000 + 10 * week + day,
    of a week from Monday, 1, to Sunday, 7.
    """
    system = system_of(timeline)
    if timeline.system != "pattern":
        return system.span(value)
    v = system.read(value)
    if "week" in v:
        if not 1 <= v["week"] <= 53:
            raise wrong(value)
        return Span(Fraction(2001 + 10 * v["week"]), Fraction(2007 + 10 * v["week"]), False, True)
    if "day" not in v:
        first = v["month"] if "month" in v else (system.quarter - 1 + 3 * (v["quarter"] - 1)) % 12 + 1
        last = first if "month" in v else first + 2
        if not 1 <= v.get("quarter", 1) <= 4 or not 1 <= first <= 12:
            raise wrong(value)
        return Span(Fraction(100 * first + 1), Fraction(100 * last + 99 if last <= 12 else 10_000 + 100 * (last - 12) + 99), False, True)
    if not 1 <= v["month"] <= 12 or not 1 <= v["day"] <= month_days(2000, v["month"]):
        raise wrong(value)
    x = Fraction(100 * v["month"] + v["day"])
    return Span(x, x)


def interval(axis: str, lo: Span | None, hi: Span | None, lo_inc: bool = True, hi_inc: bool = True) -> Interval:
    """From one coordinate to another; a period counts whole where its end is included, and not at all where it is not."""
    first = MINUS if lo is None else Cut(lo.lo, 0) if lo_inc else Cut(lo.lo, 1) if lo.point else Cut(lo.hi, 0)
    last = PLUS if hi is None else Cut(hi.hi, int(hi.point or hi.closed)) if hi_inc else Cut(hi.lo, 0)
    return Interval(axis, first, last)


def expand_window(window: IntervalSet, mappings: Iterable[Mapping]) -> IntervalSet:
    """A window with its images on every axis that maps fit for a search lead to: exact, without context, in order.

    Points follow maps that have a range or segments; a range needs maps that are total and continuous.
    """
    mappings = tuple(mappings)
    axes = dict.fromkeys(x for m in mappings for x in (m.source, m.target))
    out = list(window.ivs)
    for i in window.ivs:
        point = i.lo not in (MINUS,) and i.hi not in (PLUS,) and i.lo.at == i.hi.at
        for axis in axes:
            if axis == i.axis:
                continue
            ends = []
            for c in (i.lo, i.hi):
                if c in (MINUS, PLUS):
                    # an unbounded end stays one where any place of the axis is mapped
                    found = reach(mappings, i.axis, axis, Fraction(0), usable=lambda m, back: m.safe(back, True))
                    ends.append(c if len(found) == 1 else None)
                    continue
                found = reach(mappings, i.axis, axis, c.at, usable=lambda m, back: m.safe(back, not point))  # noqa: B023
                ends.append(Cut(found[0].at, c.side) if len(found) == 1 else None)
            if None not in ends:
                out.append(Interval(axis, *ends))
    return IntervalSet(out)


# maps between axes

#: How well a map tells, the best first.
PRECISION = ("exact", "approximate", "uncertain")


@dataclass(frozen=True)
class Segment:
    """[a, b] of the source is [c, d] of the target, by a straight line; open ends go by scale and offset."""

    source: tuple[Fraction | None, Fraction | None] = (None, None)
    target: tuple[Fraction | None, Fraction | None] = (None, None)
    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    @property
    def line(self) -> tuple[Fraction, Fraction]:
        (a, b), (c, d) = self.source, self.target
        if None in (a, b, c, d) or a == b:
            return self.scale, self.offset
        k = (d - c) / (b - a)
        return k, c - a * k


def _inside(x: Fraction, ends: tuple[Fraction | None, Fraction | None]) -> bool:
    lo, hi = ends
    if lo is not None and hi is not None and lo > hi:
        lo, hi = hi, lo
    return (lo is None or lo <= x) and (hi is None or x <= hi)


@dataclass(frozen=True)
class Traits:
    """What is known of a map. many: (sources to one target, targets of one source); order: strict, falling, monotonic, none;
    form: continuous, piecewise, discrete."""

    many: tuple[bool, bool]
    total: bool
    order: str
    invertible: bool
    form: str

    @property
    def loss(self) -> int:
        return 2 * any(self.many) + (not self.invertible) + (self.form == "discrete")


#: What an author may say of a map that is so by its shape.
_WEAKER = {
    "order": {"strict": ("strict", "monotonic", "none"), "falling": ("falling", "monotonic", "none"), "monotonic": ("monotonic", "none"), "none": ("none",)},
    "form": {"continuous": ("continuous", "piecewise", "discrete"), "piecewise": ("piecewise", "discrete"), "discrete": ("discrete",)},
}


@dataclass(frozen=True)
class Mapping:
    """A map from one axis to another: pairs, segments, or target = source * scale + offset within [lo, hi] of the source.

    context: names that must be given for it to apply. said: what its author says of it, which may only weaken its shape.
    """

    source: str
    target: str
    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)
    lo: Fraction | None = None
    hi: Fraction | None = None
    precision: str = "exact"
    error: Fraction | None = None
    segments: tuple[Segment, ...] = ()
    pairs: tuple[tuple[Fraction, tuple[Fraction, ...]], ...] = ()
    context: tuple[str, ...] = ()
    said: tuple[tuple[str, object], ...] = ()

    def shape(self) -> Traits:
        """Traits that follow from the map itself."""
        scales = [s.line[0] for s in self.segments] or [self.scale]
        if self.pairs:
            hits: dict[Fraction, int] = {}
            froms = [a for a, _ in self.pairs]
            for _, to in self.pairs:
                for x in to:
                    hits[x] = hits.get(x, 0) + 1
            out = any(len(to) > 1 for _, to in self.pairs) or len(set(froms)) < len(froms)
            into = any(n > 1 for n in hits.values())
        else:
            out, into = False, any(k == 0 for k in scales)
        steps = scales
        ends = [(x, s.line[0] * x + s.line[1]) for s in self.segments for x in s.source if x is not None]
        if len(self.segments) > 1:
            ends.sort()
            whole = len(ends) == 2 * len(self.segments)
            steps = [b[1] - a[1] for a, b in zip(ends, ends[1:], strict=False)] if whole else []
        if self.pairs or not steps:
            order = "none"
        elif all(k > 0 for k in steps):
            order = "strict"
        elif all(k < 0 for k in steps):
            order = "falling"
        else:
            order = "monotonic" if all(k >= 0 for k in steps) or all(k <= 0 for k in steps) else "none"
        total = not (self.pairs or self.segments or self.lo is not None or self.hi is not None)
        form = "discrete" if self.pairs else "piecewise" if self.segments else "continuous"
        return Traits((into, out), total, order, not (into or out) and all(k != 0 for k in scales), form)

    def traits(self) -> tuple[Traits, list[str]]:
        """The traits as the author weakens them, and what was said that would strengthen them, which does not count."""
        t, problems = self.shape(), []
        said = dict(self.said)
        many, total, order, invertible, form = t.many, t.total, t.order, t.invertible, t.form
        if "many" in said:
            if all(b or not a for a, b in zip(t.many, said["many"], strict=True)):
                many = said["many"]
            else:
                problems.append("cardinality")
        for key, now in (("total", total), ("invertible", invertible)):
            if key in said and said[key] != now:
                if now:
                    total, invertible = (said[key], invertible) if key == "total" else (total, said[key])
                else:
                    problems.append(key)
        for key, now in (("order", order), ("form", form)):
            if key in said:
                if said[key] in _WEAKER[key][now]:
                    order, form = (said[key], form) if key == "order" else (order, said[key])
                else:
                    problems.append(key)
        return Traits(many, total, order, invertible, form), problems

    def images(self, x: Fraction, back: bool) -> list[Fraction]:
        if self.pairs:
            return [a for a, to in self.pairs if x in to] if back else [y for a, to in self.pairs if a == x for y in to]
        out = []
        for s in self.segments or (Segment((self.lo, self.hi), (None, None), self.scale, self.offset),):
            k, c = s.line
            if back and (k == 0 or not _inside(x, s.target)):
                continue
            y = (x - c) / k if back else x * k + c
            if _inside(y if back else x, s.source) and _inside(x if back else y, s.target):
                out.append(y)
        return out

    def safe(self, back: bool, whole: bool) -> bool:
        """Whether a search may follow it: exact, without context, one image in order; whole: for ranges, total and continuous."""
        t = self.traits()[0]
        if self.precision != "exact" or self.context or t.order not in ("strict", "monotonic"):
            return False
        if whole and not (t.total and t.form == "continuous"):
            return False
        return not t.many[0 if back else 1]


@dataclass(frozen=True)
class Found:
    at: Fraction
    precision: str = "exact"
    error: Fraction = Fraction(0)
    loss: int = 0
    hops: int = 0


def _edges(mappings: Iterable[Mapping], axis: str) -> Iterator[tuple[Mapping, bool, str]]:
    for m in mappings:
        if m.source == axis:
            yield m, False, m.target
        if m.target == axis:
            yield m, True, m.source


def connected(mappings: Iterable[Mapping], a: str, b: str) -> bool:
    mappings, seen, todo = tuple(mappings), {a}, [a]
    while todo:
        for _, _, to in _edges(mappings, todo.pop()):
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return b in seen


def reach(mappings: Iterable[Mapping], source: str, target: str, x: Fraction, context: Iterable[str] = (), usable=lambda m, back: True) -> list[Found]:
    """The best images of a place: by precision, then by what is lost, then by steps. No path meets an axis twice."""
    mappings, given = tuple(mappings), set(context)
    done: list[Found] = []
    paths = [(source, frozenset((source,)), [Found(x)])]
    while paths:
        grown = []
        for axis, seen, found in paths:
            if axis == target:
                done += found
                continue
            for m, back, to in _edges(mappings, axis):
                if to in seen or not usable(m, back) or not set(m.context) <= given:
                    continue
                loss = m.traits()[0].loss
                out = [
                    Found(y, max(f.precision, m.precision, key=PRECISION.index), f.error + (m.error or 0), f.loss + loss, f.hops + 1)
                    for f in found
                    for y in m.images(f.at, back)
                ]
                if out:
                    grown.append((to, seen | {to}, out))
        paths = grown
    rank = lambda f: (PRECISION.index(f.precision), f.loss, f.hops)
    best = min(map(rank, done), default=None)
    return list({f.at: f for f in reversed([f for f in done if rank(f) == best])}.values())[::-1]


def line(mappings: Iterable[Mapping], source: str, target: str) -> tuple[Fraction, Fraction] | None:
    """(scale, offset) of the one straight map that total maps between two axes add up to, if there is one."""
    whole = lambda m, back: m.shape().total and m.precision == "exact" and not m.context
    a, b = (reach(mappings, source, target, Fraction(x), usable=whole) for x in (0, 1))
    return (b[0].at - a[0].at, a[0].at) if len(a) == len(b) == 1 else None


def line_sql(x: str, mappings: Iterable[Mapping], source: str, target: str) -> str:
    """A DOUBLE column of coordinates of one axis on another; NULL where no straight map leads."""
    found = line(tuple(mappings), source, target)
    return f"({x} * {float(found[0])!r}D + {float(found[1])!r}D)" if found else "CAST(NULL AS DOUBLE)"


def images_sql(x: str, m: Mapping) -> str:
    """The distinct images of a DOUBLE column under a map with segments or a range, as an array; empty in a gap."""
    each = []
    for s in m.segments or (Segment((m.lo, m.hi), (None, None), m.scale, m.offset),):
        k, c = s.line
        y = f"({x} * {float(k)!r}D + {float(c)!r}D)"
        ends = [(v, e) for v, r in ((x, s.source), (y, s.target)) for e in [tuple(sorted(r)) if None not in r else r]]
        tests = [f"{v} {op} {float(q)!r}D" for v, (lo, hi) in ends for op, q in ((">=", lo), ("<=", hi)) if q is not None]
        each.append(f"CASE WHEN {' AND '.join(tests) or 'true'} THEN {y} END")
    return f"array_distinct(filter(array({', '.join(each)}), v -> v IS NOT NULL))"


# conversion and comparison


@dataclass(frozen=True)
class Outcome:
    """kind: exact, alternatives, range, approximate or unmappable; values: coordinates as the target writes them, and at: their places."""

    kind: str
    values: tuple[str, ...] = ()
    at: tuple[Fraction, ...] = ()
    error: Fraction | None = None
    reason: str = ""


def convert(value, source, target, mappings: Iterable[Mapping] = (), context: Iterable[str] = ()) -> Outcome:
    """A coordinate of one timeline as what it is on another."""
    try:
        x = system_of(source).point(value)
    except QueryError:
        return Outcome("unmappable", reason=f"{value!r} is no coordinate of {source.id}")
    found = [Found(x)] if source.axis == target.axis else reach(mappings, source.axis, target.axis, x, context)
    if not found:
        return Outcome("unmappable", reason="no map applies here" if connected(mappings, source.axis, target.axis) else "no path between the axes")
    system = system_of(target)

    def name(at: Fraction) -> str | None:
        try:
            return system.name(at)
        except QueryError:
            return None

    named = list({n: f for f in reversed(found) if (n := name(f.at)) is not None}.items())[::-1]
    if not named:
        return Outcome("unmappable", reason=f"the place has no coordinate of {target.id}")
    if len(named) > 1:
        return Outcome("alternatives", tuple(n for n, _ in named), tuple(f.at for _, f in named))
    (n, f), = named
    error = f.error or None
    if f.precision == "exact":
        return Outcome("exact", (n,), (f.at,))
    if f.precision == "uncertain" and error is not None:
        ends = [(f.at - error, name(f.at - error)), (f.at + error, name(f.at + error))]
        if all(e[1] is not None for e in ends):
            return Outcome("range", tuple(e[1] for e in ends), tuple(e[0] for e in ends), error)
    return Outcome("approximate", (n,), (f.at,), error)


@dataclass(frozen=True)
class Order:
    """kind: ordered, overlapping, ambiguous, approximate, unmappable or unrelated; signs: before is -1, after 1."""

    kind: str
    signs: tuple[int, ...] = ()
    error: Fraction | None = None


def compare(a, left, b, right, mappings: Iterable[Mapping] = (), context: Iterable[str] = ()) -> Order:
    """How the coordinate a of one timeline stands to b of another: b is brought to a's timeline, or else a to b's."""
    mappings = tuple(mappings)
    if left.axis != right.axis and not connected(mappings, left.axis, right.axis):
        return Order("unrelated")
    for x, here, y, there, turn in ((a, left, b, right, 1), (b, right, a, left, -1)):
        out = convert(y, there, here, mappings, context)
        if out.kind == "unmappable":
            continue
        try:
            at = system_of(here).point(x)
        except QueryError:
            return Order("unmappable")
        signs = tuple(dict.fromkeys(turn * ((at > o) - (at < o)) for o in out.at))
        if out.kind == "approximate":
            return Order("approximate", signs, out.error)
        if out.kind == "range" and min(out.at) <= at <= max(out.at):
            return Order("overlapping")
        return Order("ordered" if len(signs) == 1 else "ambiguous", signs)
    return Order("unmappable")


def offsets(edges: Iterable[tuple[str, str, Fraction]]) -> tuple[dict[str, dict[str, Fraction]], list[tuple[str, str]]]:
    """For each timeline the offsets of all that (from, to, offset) edges lead to, either way; and pairs with two of them."""
    near: dict[str, list[tuple[str, Fraction]]] = {}
    for a, b, k in edges:
        near.setdefault(a, []).append((b, k))
        near.setdefault(b, []).append((a, -k))
    out, unlike = {}, []
    for start in near:
        known, todo = {start: Fraction(0)}, [start]
        for here in todo:
            for to, k in near[here]:
                if to not in known:
                    known[to] = known[here] + k
                    todo.append(to)
                elif abs(known[to] - known[here] - k) > Fraction(1, 10**9) and (start, to) not in unlike:
                    unlike.append((start, to))
        out[start] = {t: k for t, k in known.items() if t != start}
    return out, unlike


def to_json(m: Mapping) -> dict:
    """A map as JSON has it, with numbers as text."""

    def plain(x):
        if isinstance(x, Fraction):
            return {"q": str(x)}
        if isinstance(x, Segment):
            return {"segment": [plain(x.source), plain(x.target), plain(x.scale), plain(x.offset)]}
        return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x

    return {k: plain(v) for k, v in m.__dict__.items()}


def of_json(d: dict) -> Mapping:
    def read(x):
        if isinstance(x, dict):
            return Fraction(x["q"]) if "q" in x else Segment(*[read(y) for y in x["segment"]])
        return tuple(read(y) for y in x) if isinstance(x, list) else x

    return Mapping(**{k: read(v) for k, v in d.items()})
