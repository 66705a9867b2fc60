"""The YAML subset of front matter: block maps and lists, flow lists and maps, quoted scalars, comments."""

from __future__ import annotations

import re

from tessella.sources.places import KEY, Places


class YamlError(ValueError):
    """span: where in the text, if that is known."""

    span: tuple[int, int] | None = None


_KEY = re.compile(r"([^\"'\[\]{}:][^\[\]{}:]*):(?=\s|\Z)")
_PLAIN, _PAIR = re.compile(r"[^,\[\]{}]*"), re.compile(r"\s*(\"[^\"]*\"|'[^']*'|[^:,{}\[\]]+?)\s*:(?=\s|$)\s*")
_INT, _NUM = re.compile(r"[-+]?\d+"), re.compile(r"[-+]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][-+]?\d+)?")


def scalar(text: str):
    """null, booleans, integers and decimals are typed; dates, fractions and all else are strings."""
    t = text.strip()
    if t[:1] in "\"'" and t[:1]:
        return unquote(t)
    if t in ("", "null", "~"):
        return None
    if t in ("true", "false"):
        return t == "true"
    if t[0].isalpha():
        return t
    if _INT.fullmatch(t):
        return int(t)
    if _NUM.fullmatch(t):
        return float(t)
    return t


def unquote(t: str) -> str:
    if len(t) < 2 or t[-1] != t[0]:
        raise YamlError(f"unclosed quote in {t}")
    if t[0] == "'":
        return t[1:-1].replace("''", "'")
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1] if m[1] in '\\"' else m[0]), t[1:-1])


def strip_comment(line: str) -> str:
    if "#" not in line:
        return line.rstrip()
    quote = ""
    for i, c in enumerate(line):
        if quote:
            if c == quote and not (quote == '"' and line[i - 1] == "\\"):
                quote = ""
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def split_key(text: str) -> tuple[str, str] | None:
    """`key: rest` outside quotes and brackets; the colon is followed by white space or the end."""
    if plain := _KEY.match(text):
        return plain[1].strip(), text[plain.end() :].strip()
    quote, depth = "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and i == 0:
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == ":" and depth == 0 and (i + 1 == len(text) or text[i + 1].isspace()):
            return str(scalar(text[:i]) if text[0] in "\"'" else text[:i].strip()), text[i + 1 :].strip()
    return None


class _Flow:
    def __init__(self, text: str, places: Places | None = None, base: int = 0):
        self.t, self.i, self.places, self.base = text, 0, places, base

    def put(self, path: tuple, start: int, end: int) -> None:
        if self.places is not None:
            self.places.put(path, self.base + start, self.base + end)

    def space(self):
        while self.t[self.i : self.i + 1].isspace():
            self.i += 1

    def value(self, path: tuple = ()):
        self.space()
        start = self.i
        c = self.t[self.i : self.i + 1]
        if c == "[":
            out = self.many("]", lambda held: held.append(self.value((*path, len(held)))), [])
        elif c == "{":
            out = self.many("}", lambda held: self.pair(held, path), {})
        elif c in ('"', "'") and c:
            end = self.i + 1
            while end < len(self.t) and not (self.t[end] == c and not (c == '"' and self.t[end - 1] == "\\")):
                end += 1
            raw, self.i = self.t[self.i : end + 1], end + 1
            out = unquote(raw)
        else:
            m = _PLAIN.match(self.t, self.i)
            self.i = m.end()
            self.put(path, start, start + len(m[0].rstrip()))
            return scalar(m[0])
        self.put(path, start, self.i)
        return out

    def pair(self, out: dict, path: tuple):
        self.space()
        m = _PAIR.match(self.t, self.i)
        if not m:
            raise YamlError(f"a key is needed in {self.t}")
        self.i = m.end()
        key = str(scalar(m[1])) if m[1][0] in "\"'" else m[1]
        self.put((*path, key, KEY), *m.span(1))
        out[key] = self.value((*path, key))

    def many(self, close: str, one, out):
        self.i += 1
        while True:
            self.space()
            if self.t[self.i : self.i + 1] == close:
                self.i += 1
                return out
            if self.i >= len(self.t):
                raise YamlError(f"unclosed {self.t}")
            one(out)
            self.space()
            if self.t[self.i : self.i + 1] == ",":
                self.i += 1


def flow(text: str, path: tuple = (), places: Places | None = None, base: int = 0):
    f = _Flow(text, places, base)
    out = f.value(path)
    f.space()
    if f.i < len(text):
        raise YamlError(f"unexpected text after {text[: f.i]}")
    return out


def parse(text: str, places: Places | None = None, base: int = 0):
    """The value of a text; places gets where its parts stand, text[0] standing at base."""
    lines, at = [], base
    for raw in text.split("\n"):
        s = strip_comment(raw)
        if said := s.lstrip():
            lines.append((len(s) - len(s.lstrip(" ")), said, at + len(s) - len(said)))
        at += len(raw) + 1
    if not lines:
        return {}
    reader = _Reader(lines, places)
    out, rest = reader.block(0, lines[0][0], ())
    if rest < len(lines):
        raise reader.wrong(f"unexpected indentation at {lines[rest][1]}", rest)
    return out


class _Reader:
    """Blocks of lines (indentation, text, place)."""

    def __init__(self, lines: list[tuple[int, str, int]], places: Places | None):
        self.lines, self.places = lines, places

    def put(self, path: tuple, start: int, end: int) -> None:
        if self.places is not None:
            self.places.put(path, start, end)

    def wrong(self, message: str, i: int) -> YamlError:
        e = YamlError(message)
        e.span = (self.lines[i][2], self.lines[i][2] + len(self.lines[i][1]))
        return e

    def inline(self, text: str, i: int, path: tuple):
        """What stands at the end of line i."""
        at = self.lines[i][2] + len(self.lines[i][1]) - len(text)
        self.put(path, at, at + len(text))
        try:
            return flow(text, path, self.places, at) if text[:1] in "[{" and text[:1] else scalar(text)
        except YamlError as e:
            e.span = (at, at + len(text))
            raise

    def nested(self, i: int, indent: int, path: tuple):
        """A block that begins at line i, if it is one of the line before."""
        if i < len(self.lines) and (self.lines[i][0] > indent):
            value, rest = self.block(i, self.lines[i][0], path)
            self.put(path, self.lines[i][2], self.lines[rest - 1][2] + len(self.lines[rest - 1][1]))
            return value, rest
        return None, i

    def block(self, i: int, indent: int, path: tuple):
        lines = self.lines
        item = lambda k: lines[k][1].startswith("- ") or lines[k][1] == "-"
        if item(i):
            out: list = []
            while i < len(lines) and lines[i][0] == indent and item(i):
                here = (*path, len(out))
                rest = lines[i][1][1:].strip()
                if not rest:
                    value, i = self.nested(i + 1, indent, here)
                elif rest[0] not in "[{\"'" and split_key(rest):
                    lines[i] = (indent + len(lines[i][1]) - len(rest), rest, lines[i][2] + len(lines[i][1]) - len(rest))
                    value, i = self.nested(i, indent, here)
                else:
                    value, i = self.inline(rest, i, here), i + 1
                out.append(value)
            return out, i
        made: dict = {}
        while i < len(lines) and lines[i][0] == indent:
            pair = split_key(lines[i][1])
            if pair is None:
                raise self.wrong(f"a key is needed at {lines[i][1]}", i)
            key, rest = pair
            self.put((*path, key, KEY), lines[i][2], lines[i][2] + len(lines[i][1][: lines[i][1].rindex(rest) if rest else None].rstrip().removesuffix(":").rstrip()))
            if rest:
                value, i = self.inline(rest, i, (*path, key)), i + 1
            elif i + 1 < len(lines) and lines[i + 1][0] == indent and item(i + 1):
                start = i + 1
                value, i = self.block(start, indent, (*path, key))
                self.put((*path, key), lines[start][2], lines[i - 1][2] + len(lines[i - 1][1]))
            else:
                value, i = self.nested(i + 1, indent, (*path, key))
            made[key] = value
        return made, i
