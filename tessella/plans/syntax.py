"""The pattern language's text: tokens, grammar, syntax tree. Errors carry a code and a place."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: Names that need back-ticks.
RESERVED = frozenset(
    "match where valid on anytime at overlaps contains during return distinct order by asc desc offset limit and or not is null missing in as true false".split()
)
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<param>\$\w+)|(?P<quoted>`[^`]+`)|(?P<name>[^\W\d]\w*)|(?P<sign>->|<=|>=|!=|<>|[-+*/%()\[\]{},.:;=<>])""",
    re.X | re.S,
)


class QueryError(Exception):
    """A mistake of the query's author; plans turn it into a diagnostic."""

    def __init__(self, code: str, message: str, at: int = 0):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.at = code, message, at


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    path: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    x: object


@dataclass(frozen=True)
class Binary:
    op: str
    x: object
    y: object


@dataclass(frozen=True)
class Is:
    x: object
    what: str
    negated: bool


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    type: str | None


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    type: str | None
    direction: str  # out, in, either


@dataclass(frozen=True)
class Range:
    lo: object | None
    hi: object | None
    lo_inc: bool
    hi_inc: bool


@dataclass(frozen=True)
class Valid:
    op: str
    timeline: str | None = None
    at: object = None
    range: Range | None = None
    within: Range | None = None


@dataclass
class Query:
    patterns: list[list] = field(default_factory=list)
    where: object = None
    valid: Valid | None = None
    distinct: bool = False
    returns: list[tuple[object, str]] = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)
    offset: object = None
    limit: object = None


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("GMQL1001", f"unexpected {text[at]!r}", at)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i = tokens(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, want: str):
        raise QueryError("GMQL1001", f"expected {want}, found {self.now.text or 'the end'}", self.now.at)

    def word(self, *words: str) -> bool:
        """Takes the keywords, whatever their case, if they come next."""
        ahead = self.tokens[self.i : self.i + len(words)]
        if [t.text.upper() for t in ahead if t.kind == "name"] == list(words):
            self.i += len(words)
            return True
        return False

    def sign(self, text: str) -> bool:
        if self.now.kind == "sign" and self.now.text == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.sign(text) if not text[0].isalpha() else self.word(text)):
            self.fail(text)

    def name(self) -> str:
        t = self.now
        if t.kind == "quoted":
            self.i += 1
            return t.text[1:-1]
        if t.kind == "name" and t.text.lower() not in RESERVED:
            self.i += 1
            return t.text
        self.fail("a name")

    def optional_name(self) -> str | None:
        t = self.now
        return self.name() if t.kind == "quoted" or t.kind == "name" and t.text.lower() not in RESERVED else None

    def query(self) -> Query:
        q = Query()
        self.need("MATCH")
        while True:
            q.patterns.append(self.pattern())
            if not self.sign(",") and not self.word("MATCH"):
                break
        if self.word("WHERE"):
            q.where = self.expression()
        if self.word("VALID"):
            q.valid = self.valid()
        self.need("RETURN")
        q.distinct = self.word("DISTINCT")
        while True:
            x = self.expression()
            q.returns.append((x, self.name() if self.word("AS") else self.default_name(x, len(q.returns) + 1)))
            if not self.sign(","):
                break
        if self.word("ORDER", "BY"):
            while True:
                x = self.expression()
                down = self.word("DESC")
                if not down:
                    self.word("ASC")
                q.order.append((x, not down))
                if not self.sign(","):
                    break
        if self.word("OFFSET"):
            q.offset = self.expression()
        if self.word("LIMIT"):
            q.limit = self.expression()
        self.sign(";")
        if self.now.kind != "end":
            self.fail("the end")
        return q

    @staticmethod
    def default_name(x, number: int) -> str:
        match x:
            case Var(name):
                return name
            case Prop(_, path):
                return path.rsplit(".", 1)[-1]
            case Call(name, _):
                return name.lower()
        return f"column{number}"

    def pattern(self) -> list:
        out: list = [self.node()]
        while self.now.kind == "sign" and self.now.text in ("-", "<", "<="):
            back = self.sign("<")
            self.need("-")
            self.need("[")
            var = self.optional_name()
            kind = self.name() if self.sign(":") else None
            self.need("]")
            forth = self.sign("->")
            if not forth:
                self.need("-")
            if back and forth:
                self.fail("one direction")
            out += [RelPattern(var, kind, "in" if back else "out" if forth else "either"), self.node()]
        return out

    def node(self) -> NodePattern:
        self.need("(")
        var = self.optional_name()
        kind = self.name() if self.sign(":") else None
        self.need(")")
        return NodePattern(var, kind)

    def valid(self) -> Valid:
        timeline = self.name() if self.word("ON") else None
        if self.word("ANYTIME"):
            v = Valid("ANYTIME", timeline)
        elif self.word("AT"):
            v = Valid("AT", timeline, at=self.expression())
        else:
            for op in ("OVERLAPS", "CONTAINS", "DURING"):
                if self.word(op):
                    v = Valid(op, timeline, range=self.range())
                    break
            else:
                self.fail("ANYTIME, AT, OVERLAPS, CONTAINS or DURING")
        if self.word("WITHIN"):
            v = Valid(v.op, v.timeline, v.at, v.range, self.range())
        return v

    def range(self) -> Range:
        lo_inc = self.sign("[")
        if not lo_inc:
            self.need("(")
        lo = self.bound("-")
        self.need(",")
        hi = self.bound("+")
        hi_inc = self.sign("]")
        if not hi_inc:
            self.need(")")
        return Range(lo, hi, lo_inc, hi_inc)

    def bound(self, sign: str):
        after = self.tokens[self.i + 1]
        if self.now.text == sign and after.kind == "name" and after.text.upper() == "INF":
            self.i += 2
            return None
        return self.expression()

    def expression(self):
        x = self.conjunction()
        while self.word("OR"):
            x = Binary("OR", x, self.conjunction())
        return x

    def conjunction(self):
        x = self.negation()
        while self.word("AND"):
            x = Binary("AND", x, self.negation())
        return x

    def negation(self):
        return Unary("NOT", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self):
        x = self.sum()
        if self.word("IS"):
            negated = self.word("NOT")
            for what in ("NULL", "MISSING"):
                if self.word(what):
                    return Is(x, what, negated)
            self.fail("NULL or MISSING")
        for op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "IN"):
            if self.word(*op.split()):
                return Binary(op, x, self.sum())
        for op in ("<=", ">=", "!=", "<>", "=", "<", ">"):
            if self.sign(op):
                return Binary("!=" if op == "<>" else op, x, self.sum())
        return x

    def sum(self):
        x = self.product()
        while self.now.kind == "sign" and self.now.text in "+-":
            op = self.now.text
            self.i += 1
            x = Binary(op, x, self.product())
        return x

    def product(self):
        x = self.sign_of()
        while self.now.kind == "sign" and self.now.text in "*/%":
            op = self.now.text
            self.i += 1
            x = Binary(op, x, self.sign_of())
        return x

    def sign_of(self):
        for op in "-+":
            if self.sign(op):
                return Unary(op, self.sign_of())
        return self.primary()

    def primary(self):
        t = self.now
        if t.kind == "string":
            self.i += 1
            body = t.text if t.text[0] == '"' else '"' + t.text[1:-1].replace("\\'", "'").replace('"', '\\"') + '"'
            try:
                return Lit(json.loads(body, strict=False))
            except ValueError:
                raise QueryError("GMQL1001", "bad escape in a string", t.at) from None
        if t.kind == "number":
            self.i += 1
            if re.fullmatch(r"\d+", t.text):
                if int(t.text) > 2**63 - 1:
                    raise QueryError("GMQL1001", "integer out of range", t.at)
                return Lit(int(t.text))
            return Lit(float(t.text))
        if t.kind == "param":
            self.i += 1
            return Param(t.text[1:])
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.word(word):
                return Lit(value)
        if self.sign("("):
            x = self.expression()
            self.need(")")
            return x
        name = self.name()
        if self.sign("("):
            args = []
            if not self.sign(")"):
                while True:
                    args.append(self.expression())
                    if not self.sign(","):
                        break
                self.need(")")
            return Call(name.upper(), tuple(args))
        path = []
        while self.sign("."):
            part = self.now
            if part.kind in ("name", "number"):
                self.i += 1
                path += part.text.split(".")
            else:
                path.append(self.name())
        return Prop(name, ".".join(path)) if path else Var(name)


def parse(text: str) -> Query:
    return Parser(text).query()
