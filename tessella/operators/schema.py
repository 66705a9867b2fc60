"""Property schemas of types: what a type inherits, whether it only narrows that, and values brought to their declared kind."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from tessella.functions.values import canonical

KINDS = ("string", "text", "number", "instant", "duration", "array")


@dataclass(frozen=True)
class Schema:
    """kind: one of KINDS, or None for anything; options: the values of an enumeration as canonical JSON; items: of an array."""

    kind: str | None = None
    required: bool = False
    options: tuple[str, ...] | None = None
    items: Schema | None = None
    timelines: tuple[str, ...] | None = None

    @staticmethod
    def of(raw) -> Schema:
        raw = raw if isinstance(raw, dict) else {"type": raw}
        kind = raw.get("type")
        lines = raw.get("timelines") or ([raw["timeline"]] if raw.get("timeline") else None)
        return Schema(
            str(kind) if kind in KINDS else None, bool(raw.get("required", False)), None if raw.get("enum") is None else tuple(map(canonical, raw["enum"])),
            Schema.of(raw["items"]) if raw.get("items") else None, None if lines is None else tuple(map(str, lines)),
        )

    def narrows(self, other: Schema) -> bool:
        """Whether all that this allows the other allows: the same kind, no more options, timelines and items."""
        within = lambda mine, theirs: theirs is None or mine is not None and set(mine) <= set(theirs)
        if self.kind != other.kind or not within(self.options, other.options) or not within(self.timelines, other.timelines):
            return False
        return self.kind != "array" or other.items is None or self.items is not None and self.items.narrows(other.items)

    def meet(self, other: Schema) -> Schema:
        """What both allow, for two that a type inherits side by side."""
        if self.options is None or other.options is None:
            options = other.options if self.options is None else self.options
        else:
            options = tuple(x for x in self.options if x in other.options)
        items = self.items.meet(other.items) if self.items and other.items else self.items or other.items
        return replace(self, required=self.required and other.required, options=options, items=items)


def resolve(parents: dict[str, tuple[str, ...]], own: dict[str, dict[str, Schema]], above: dict[str, tuple[str, ...]]) -> tuple[dict[str, dict[str, Schema]], list[tuple[str, str]]]:
    """The schemas of each type with what it inherits, and (type, what is wrong).

    above: all ancestors of each type. A type's own schema must narrow each one it inherits; two that meet in a type from
    different parents must narrow one another in one way or the other.
    """
    done: dict[str, dict[str, Schema]] = {}
    problems: list[tuple[str, str]] = []
    for t in sorted(parents, key=lambda t: (len(above.get(t, ())), t)):
        held: dict[str, Schema] = {}
        for p in parents[t]:
            for name, s in done.get(p, {}).items():
                if name not in held or held[name] == s:
                    held[name] = s
                    continue
                if not (s.narrows(held[name]) or held[name].narrows(s)):
                    problems.append((t, f"property {name} is inherited in two ways that do not agree"))
                held[name] = held[name].meet(s)
        for name, s in own.get(t, {}).items():
            if name in held and not s.narrows(held[name]):
                problems.append((t, f"property {name} does not narrow what it inherits"))
            held[name] = s
        done[t] = held
    return done, problems


def lookup(schemas: dict[str, dict[str, Schema]], types: Iterable[str], name: str) -> Schema | None:
    return next((schemas[t][name] for t in types if name in schemas.get(t, ())), None)


def normalise(raw, s: Schema | None, name: str, check: Callable[[str, object], object], problems, stayed: list[int] | None = None):
    """A value as its schema has it, or raw values without one; None and a problem where it is of another kind. problems
    takes them by add(message, path from the value). stayed: gets the places of an array's elements that are left.

    check gives a coordinate of a timeline in its written form, and raises ValueError. Values that are not among the
    options are a problem but stay.
    """
    if s is None or s.kind is None or raw is None:
        return raw

    def among(x, where: str, *path) -> None:
        if s.options is not None and canonical(x) not in s.options:
            problems.add(f"{where} is none of the values of its enumeration", path)

    def fail():
        problems.add(f"{name} must be {s.kind}")

    if s.kind not in ("array", "text"):
        among(raw, name)
    match s.kind:
        case "string":
            return raw if isinstance(raw, str) else fail()
        case "number":
            return float(raw) if isinstance(raw, (int, float)) and not isinstance(raw, bool) else fail()
        case "text":
            if isinstance(raw, str):
                raw = {"default": raw}
            if not isinstance(raw, dict):
                return fail()
            for k, v in raw.items():
                among(v, f"{name}.{k}", k)
            return raw
        case "array":
            if not isinstance(raw, list):
                return fail()
            out = []
            for i, x in enumerate(raw):
                timed = isinstance(x, dict) and "value" in x and set(x) <= {"value", "validTime"}
                value = x["value"] if timed else x
                path = (i, "value") if timed else (i,)
                among(value, f"{name}[]", *path)
                y = normalise(value, s.items, f"{name}[]", check, problems.under(path))
                if y is not None or value is None:
                    out.append({**x, "value": y} if timed else y)
                    if stayed is not None:
                        stayed.append(i)
            return out
        case "instant":
            line, value = (raw.get("timeline"), raw.get("value", raw.get("at"))) if isinstance(raw, dict) else (None, raw)
            line = line or (s.timelines or (None,))[0]
            try:
                return check(str(line), value)
            except ValueError as e:
                problems.add(f"{name}: {e}")
                return None
        case "duration":
            if not isinstance(raw, dict) or "from" not in raw and "to" not in raw:
                return fail()
            line = raw.get("timeline") or (s.timelines or (None,))[0]
            try:
                return [None if raw.get(k) is None else check(str(line), raw[k]) for k in ("from", "to")]
            except ValueError as e:
                problems.add(f"{name}: {e}")
                return None


def times_of(element) -> str | None:
    """What tells the groups of an array's elements apart: the set of times that an element names, in any order; None of
    one that names none."""
    if not isinstance(element, dict) or "validTime" not in element or set(element) != {"value", "validTime"}:
        return None
    times = element["validTime"]
    return json.dumps(sorted({json.dumps(t, sort_keys=True, default=str) for t in times} if isinstance(times, list) else [json.dumps(times, sort_keys=True, default=str)]))


def merge_elements(below: list, above: list, times=times_of) -> list:
    """The elements of two arrays: those of `above` take the place of the elements of `below` with the same times, where the
    first of these stood; times that only one of both has keep their elements, those of `above` in the end. An empty
    `above` leaves no element without times."""
    new: dict = {} if above else {None: []}
    for x in above:
        new.setdefault(times(x), []).append(x)
    out, done = [], set()
    for x in below:
        group = times(x)
        if group not in new:
            out.append(x)
        elif group not in done:
            out += new[group]
            done.add(group)
    return out + [x for group, xs in new.items() if group not in done for x in xs]
