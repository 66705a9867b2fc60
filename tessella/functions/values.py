"""Tagged values: what a property holds, told apart by tag, so that NULL is a value and absence is not one.

An array or object has its canonical JSON in `s`, and in `items` its elements, or its keys, as values of their own kind.
"""

from __future__ import annotations

import json

ITEM = "struct<tag:string,s:string,i:bigint,d:double,b:boolean>"
VALUE = f"struct<tag:string,s:string,i:bigint,d:double,b:boolean,items:array<{ITEM}>>"
ENTRY = "struct<v:{v},t:{t}>"
_LANES = {"string": "s", "integer": "i", "number": "d", "boolean": "b", "node": "s", "relation": "s", "type": "s", "reltype": "s"}
_KINDS = {"s": "STRING", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}
NO_VALUE = f"CAST(NULL AS {VALUE})"


def value_sql(tag: str, expr: str = "NULL") -> str:
    """A value of a SQL expression; NULL expressions of any tag are the value NULL.

    Every field has its type by a cast of its own: a cast of the whole would hide a column from filters on it.
    """
    lane = _LANES.get(tag)
    lanes = ", ".join(f"'{k}', CAST({expr if k == lane else 'NULL'} AS {t})" for k, t in _KINDS.items())
    tag = f"CASE WHEN {expr} IS NULL THEN 'null' ELSE '{tag}' END" if lane else "'null'"
    return f"named_struct('tag', {tag}, {lanes}, 'items', CAST(NULL AS ARRAY<{ITEM}>))"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


#: JSON that is equal for equal structures: keys in order, 1 told from 1.0.
canonical = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode
_FIELDS = {bool: ("boolean", "b"), int: ("integer", "i"), float: ("number", "d"), str: ("string", "s"), type(None): ("null", None)}


def fields_of(x) -> dict:
    """The fields of a value on the driver: tag, and s, i, d or b; of arrays and objects also the items."""
    tag, lane = _FIELDS.get(type(x), ("string", "s"))
    if isinstance(x, (dict, list, tuple)):
        items = [fields_of(k) for k in x]
        for i in items:
            i.pop("items", None)
        return {"tag": "object" if isinstance(x, dict) else "array", "s": canonical(x), "items": items}
    return {"tag": tag, lane: x} if lane else {"tag": tag}


def literal_sql(x) -> str:
    if x is None:
        return value_sql("null")
    if isinstance(x, bool):
        return value_sql("boolean", str(x).lower())
    if isinstance(x, int):
        return value_sql("integer", f"CAST({x} AS BIGINT)")
    if isinstance(x, float):
        return value_sql("number", f"{x!r}D")
    if isinstance(x, (dict, list, tuple)):
        return f"from_json({quoted(json.dumps(fields_of(x), ensure_ascii=False))}, '{VALUE}')"
    return value_sql("string", quoted(x))


def _mixed(i: str, d: str) -> str:
    """Compares a long with a double without rounding the long."""
    f = f"CAST(floor({d}) AS BIGINT)"
    return f"CASE WHEN {d} >= 9.223372036854775807E18D THEN -1 WHEN {d} < -9.223372036854775808E18D THEN 1 WHEN {i} < {f} THEN -1 WHEN {i} > {f} THEN 1 WHEN {d} > {f} THEN -1 ELSE 0 END"


def same_sql(x: str, y: str) -> str:
    """Whether two values have one structure: the integer 1 is not the number 1.0."""
    return f"({x}.tag = {y}.tag AND {x}.s <=> {y}.s AND {x}.i <=> {y}.i AND {x}.d <=> {y}.d AND {x}.b <=> {y}.b)"


def compare_sql(x: str, y: str) -> str:
    """-1, 0 or 1; NULL for values that have no order among them."""
    sign = lambda a, b: f"CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 ELSE 0 END"
    return (
        f"CASE WHEN {x}.tag = 'integer' AND {y}.tag = 'integer' THEN {sign(f'{x}.i', f'{y}.i')} "
        f"WHEN {x}.tag = 'number' AND {y}.tag = 'number' THEN {sign(f'{x}.d', f'{y}.d')} "
        f"WHEN {x}.tag = 'integer' AND {y}.tag = 'number' THEN {_mixed(f'{x}.i', f'{y}.d')} "
        f"WHEN {x}.tag = 'number' AND {y}.tag = 'integer' THEN -({_mixed(f'{y}.i', f'{x}.d')}) "
        f"WHEN {x}.tag = 'string' AND {y}.tag = 'string' THEN {sign(f'{x}.s', f'{y}.s')} "
        f"WHEN {x}.tag = 'boolean' AND {y}.tag = 'boolean' THEN {sign(f'{x}.b', f'{y}.b')} "
        f"WHEN {x}.tag IN ('node', 'relation', 'type', 'reltype', 'array', 'object') AND {same_sql(x, y)} THEN 0 END"
    )


def member_sql(x: str, y: str) -> str:
    """Whether x is an element of the array y."""
    return f"({y}.tag = 'array' AND exists({y}.items, m -> {same_sql('m', x)}))"


def test_sql(x: str, op: str, y: str, structured: bool = False) -> str:
    """Whether two values stand in a relation; the value NULL stands in none.

    CONTAINS: a string in a string, or an element in an array. structured: also a key in an object, and a string in a
    member of a text.
    """
    c = compare_sql(x, y)
    both = f"{x}.tag = 'string' AND {y}.tag = 'string'"
    inside = f"CASE WHEN {x}.tag = 'string' THEN {both} AND contains({x}.s, {y}.s) WHEN {x}.tag = 'array' THEN {member_sql(y, x)}"
    if structured:
        member = f"exists(map_values(from_json({x}.s, 'map<string,string>')), t -> contains(t, {y}.s))"
        inside += f" WHEN {x}.tag = 'object' AND {y}.tag = 'string' THEN exists({x}.items, k -> k.s = {y}.s) OR coalesce({member}, false)"
    body = {
        "=": f"coalesce({c} = 0, false)",
        "!=": f"coalesce({c} <> 0, true)",
        "<": f"coalesce({c} < 0, false)",
        "<=": f"coalesce({c} <= 0, false)",
        ">": f"coalesce({c} > 0, false)",
        ">=": f"coalesce({c} >= 0, false)",
        "STARTS WITH": f"({both} AND startswith({x}.s, {y}.s))",
        "ENDS WITH": f"({both} AND endswith({x}.s, {y}.s))",
        "CONTAINS": f"coalesce({inside} ELSE false END, false)",
        "IN": f"coalesce({member_sql(x, y)}, false)",
    }[op]
    return f"({x}.tag <> 'null' AND {y}.tag <> 'null' AND {body})"


def plain_test_sql(x: str, op: str, y) -> str | None:
    """The same for a literal that needs no cases, in terms of the typed fields alone, so that a scan can take it as a
    filter on a column; None where there is no such form."""
    if isinstance(y, str) and op in ("=", "!=", "<", "<=", ">", ">=", "STARTS WITH", "ENDS WITH", "CONTAINS"):
        q = quoted(y)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            if op == "CONTAINS":
                other = f" OR {x}.tag = 'array' AND {member_sql(literal_sql(y), x)}"
            else:
                other = ""
            return f"({x}.tag = 'string' AND {op.replace(' ', '').lower()}({x}.s, {q}){other})"
        if op == "!=":
            return f"({x}.tag = 'string' AND {x}.s <> {q} OR {x}.tag NOT IN ('string', 'null'))"
        return f"({x}.tag = 'string' AND {x}.s {op} {q})"
    if isinstance(y, (int, float)) and not isinstance(y, bool) and abs(y) < 2**53 and op in ("=", "<", "<=", ">", ">="):
        if isinstance(y, int) or y == int(y):
            i = f"{x}.i {op} {int(y)}L"
        elif op == "=":
            i = "false"
        else:  # a whole number is over 2.5 if it is 3 or more
            n = int(y // 1)
            i = f"{x}.i > {n}L" if op in (">", ">=") else f"{x}.i <= {n}L"
        return f"({x}.tag = 'number' AND {x}.d {op} {float(y)!r}D OR {x}.tag = 'integer' AND {i})"
    return None


def arithmetic_sql(x: str, op: str, y: str) -> str:
    """A number, or NULL where there is none: other operands, division and remainder by zero.

    Whole numbers stay whole under + - * and %, and overflow raises; division is of doubles.
    """
    dx, dy = (f"CASE WHEN {v}.tag = 'integer' THEN CAST({v}.i AS DOUBLE) ELSE {v}.d END" for v in (x, y))
    whole = f"{x}.tag = 'integer' AND {y}.tag = 'integer'"
    number = f"{x}.tag IN ('integer', 'number') AND {y}.tag IN ('integer', 'number')"
    if op == "/":
        return f"CASE WHEN {number} AND ({dy}) <> 0 THEN {value_sql('number', f'(({dx}) / ({dy}))')} END"
    if op == "%":
        return f"CASE WHEN {whole} AND {y}.i <> 0 THEN {value_sql('integer', f'({x}.i % {y}.i)')} WHEN {number} AND ({dy}) <> 0 THEN {value_sql('number', f'(({dx}) % ({dy}))')} END"
    return f"CASE WHEN {whole} THEN {value_sql('integer', f'({x}.i {op} {y}.i)')} WHEN {number} THEN {value_sql('number', f'(({dx}) {op} ({dy}))')} END"
