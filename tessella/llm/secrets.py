"""Secret scans: fixed kinds of spans, and character Markov models of random strings against ordinary identifiers.

Everything runs inside the JVM. Spans of a fixed kind come from one expression over the text: what a pattern matches and
what lies between the matches give the places, in code points. Long runs of key characters outside of these are candidates
of the `markov` kind: the sum of the log-likelihood ratios of their character pairs under two first-order models, random and ordinary,
must reach a threshold. The models are fitted by counting character pairs of labelled samples; they are two tables
over an alphabet of 67 signs, which is all that the driver collects. No shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table

#: Patterns of the base kinds, as Java regular expressions, with the group that holds the secret.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Signs of the models; all else counts as the sign before the first.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET) + 1
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

_SPAN = "struct<start:int,ord:int,stop:int,value:int,kind:string>"

#: Words of which ordinary identifiers are made.
WORDS = (
    "account action address admin after agent answer array article async author average backup balance batch before billing "
    "block board body branch browser buffer build button cache calendar callback cancel category channel character check "
    "class client cluster collection column command comment commit company component config connection container content "
    "context control cookie country create current customer data database date debug default delete deploy description "
    "device dialog directory document domain download driver email employee enable engine entity entry error event example "
    "executor export factory failed feature field file filter folder format frame function gateway generator global group "
    "handler header height history host image import index information input insert instance integer internal invoice item "
    "iterator journal kernel key label language layout length level library license limit line list loader local location "
    "logger login manager mapping master matrix member memory message metadata method metric model module monitor name "
    "network node number object offset operation option order output package page parameter parent parser partition path "
    "payment pending percent period person phone pipeline player plugin pointer policy position prefix price priority "
    "process product profile program project property protocol provider public query queue random range record reference "
    "region register release remote render report request resource response result return route runtime sample schedule "
    "schema scope screen search section select sender sequence server service session setting shadow shared signal size "
    "socket source stack standard start state static status storage stream string style subject summary support switch "
    "symbol system table target task template test text thread threshold ticket time title total trace transaction "
    "transfer type unit update upload user utility validator value variable vector vendor version view visible warning "
    "widget width window worker wrapper writer zone "
    "and der die und ist nicht mit von den das sich des auf für einer eine werden verwaltung rechnung gesellschaft straße "
    "que para los las con una por del como más información desarrollo aplicación les des est dans pour qui sur avec "
    "développement gestion utilisateur entreprise"
).split()


def samples(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """Labelled samples (text, random): n strings of each label, made by rule from hashes of their numbers from `first` on.

    Random: hexadecimal digits, base 64, and capital letters and digits. Ordinary: two to five words joined as camel
    case, with underscores, dashes or slashes or plainly, some with a number; and, with the first ones, rules of equal signs.
    """
    ids = spark.range(first, first + n)
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    length = 20 + F.pmod(F.xxhash64("id"), F.lit(24)).cast("int")
    made = F.element_at(F.array(digest, b64, F.upper(b64), F.lower(b64), F.translate(b64, "+/", "-_")), (F.col("id") % 5 + 1).cast("int"))
    random = ids.select(F.substring(made, F.lit(1), length).alias("text"), F.lit(True).alias("random"))
    words = F.split(F.lit(" ".join(WORDS)), " ")

    def word(k: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))

    count = 2 + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4))
    chosen = F.slice(F.array(*[word(k) for k in range(5)]), F.lit(1), count.cast("int"))
    style = F.col("id") % 6
    joined = (
        F.when(style == 0, F.array_join(F.transform(chosen, F.initcap), ""))
        .when(style == 1, F.array_join(chosen, "_"))
        .when(style == 2, F.array_join(chosen, "-"))
        .when(style == 3, F.upper(F.array_join(chosen, "_")))
        .when(style == 4, F.array_join(chosen, "/"))
        .otherwise(F.array_join(chosen, ""))
    )
    number = F.when(F.col("id") % 4 == 0, F.concat(F.lit("_"), (F.col("id") % 2100).cast("string"))).otherwise("")
    ordinary = ids.select(F.concat(joined, number).alias("text"), F.lit(False).alias("random"))
    rules = spark.range(0 if first else 40).select(F.repeat(F.element_at(F.array(*map(F.lit, "=-_+/")), (F.col("id") % 5 + 1).cast("int")), 30).alias("text"), F.lit(False).alias("random"))
    return random.unionByName(ordinary).unionByName(rules)


def _sign(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def fit(labelled: DataFrame, most_rows: int = 100_000) -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, by `first * signs + second`; add-one smoothed.

    Only the first most_rows rows by hash count: the documented bound of the fit. Rows with a null label or fewer than two
    signs add nothing; without rows of a label its model is uniform.
    """
    rows = labelled.where(F.col("random").isNotNull() & (F.length("text") > 1)).orderBy(F.xxhash64("text"), "text", "random").limit(most_rows)
    signs = rows.select("random", F.filter(F.split("text", ""), lambda c: c != "").alias("c"))
    pairs = signs.select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    counts = pairs.groupBy("random", _sign(F.col("p.a")).alias("a"), _sign(F.col("p.b")).alias("b")).count().collect()
    seen = {True: [[1.0] * _N for _ in range(_N)], False: [[1.0] * _N for _ in range(_N)]}
    for r in counts:  # at most 2 * 68 * 68 rows
        seen[r["random"]][r["a"]][r["b"]] += r["count"]
    out = []
    for x, y in zip(seen[True], seen[False], strict=True):
        sx, sy = sum(x), sum(y)
        out += [round(math.log(a / sx) - math.log(b / sy), 6) for a, b in zip(x, y, strict=True)]
    return out


def _literal(values: list[float]) -> str:
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS array<double>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(items: str, zero: str, of: str, join: str, emit: str) -> str:
    """SQL for an array with `emit` of each item y and of t, the fold of `join` over `of` the items before it.

    of: on y; join: on t and s. In two levels, blocks of the square root of the number of items, so that the work is its
    power 1.5 and not its square, although an array that grows is copied at each step.
    """
    blocks = "transform(sequence(0, CAST((size(p) - 1) / k AS INT)), i -> slice(p, i * k + 1, k))"
    more = join.replace("{t}", "a.t")
    whole = f"transform(blocks, x -> aggregate(x, {zero}, (t, y) -> {join.replace('{t}', 't').replace('{s}', of)}))"
    before = f"aggregate({whole}, struct({zero} AS t, slice(array({zero}), 1, 0) AS got), (a, s) -> struct({more.replace('{s}', 's')} AS t, array_append(a.got, a.t) AS got), a -> a.got)"
    step = f"struct({more.replace('{s}', of)} AS t, concat(a.got, array({emit.replace('{t}', 'a.t')})) AS got)"
    empty = emit.replace("{t}", "o").replace("y.", "get(x, 0).")
    inner = f"aggregate(x, struct(o AS t, slice(array({empty}), 1, 0) AS got), (a, y) -> {step}, a -> a.got)"
    made = f"flatten(zip_with(blocks, {before}, (x, o) -> {inner}))"
    sized = f"get(transform(array({blocks}), blocks -> {made}), 0)"
    return f"get(transform(array({items}), p -> get(transform(array(greatest(1, CAST(sqrt(size(p)) AS INT))), k -> {sized}), 0)), 0)"


def _parts(text: str, pattern: str, group: int) -> str:
    """SQL for what stands before each match (g), the match (m) and its group (v); after the last match m is null."""
    p = _quoted(pattern)
    return f"""zip_with(split({text}, {p}, -1), zip_with(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}), (m, v) -> struct(m AS m, v AS v)),
      (g, y) -> struct(g AS g, y.m AS m, y.v AS v))"""


def _spans(text: str, pattern: str, kind: str, order: int, ok: str, group: int = 0) -> str:
    """SQL for the spans of one kind; ok: a condition on x.m (the match) and x.v (the group that holds the secret)."""
    places = _scan(_parts(text, pattern, group), "0", "length(y.g) + coalesce(length(y.m), 0)", "{t} + {s}", "struct({t} + length(y.g) AS start, y.m AS m, y.v AS v)")
    span = f"struct(x.start AS start, {order} AS ord, x.start + length(x.m) AS stop, x.start + length(x.m) - length(x.v) AS value, '{kind}' AS kind)"
    none = f"CAST(array() AS array<{_SPAN}>)"
    return f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN CAST(transform(filter({places}, x -> x.m IS NOT NULL AND {ok}), x -> {span}) AS array<{_SPAN}>) ELSE {none} END"


def _blanked(text: str, pattern: str, spans: str, ok: str, group: int = 0) -> str:
    """SQL for the text with as many blanks for each match."""
    pieces = f"transform({_parts(text, pattern, group)}, x -> concat(x.g, CASE WHEN x.m IS NULL THEN '' WHEN {ok} THEN repeat(' ', length(x.m)) ELSE x.m END))"
    return f"CASE WHEN size({spans}) > 0 THEN array_join({pieces}, '') ELSE {text} END"


def _ratio(text: str, table_sql: str) -> str:
    """SQL for the log-likelihood ratio of a string: its signs, then one look-up for each pair."""
    return f"""aggregate(split({text}, ''), struct(0.0D AS sum, -1 AS last),
      (a, c) -> struct(a.sum + CASE WHEN a.last < 0 OR c = '' THEN 0.0D ELSE get({table_sql}, a.last * {_N} + instr('{ALPHABET}', c)) END AS sum,
                       CASE WHEN c = '' THEN a.last ELSE instr('{ALPHABET}', c) END AS last), a -> a.sum)"""


def find(docs: DataFrame, ratios: list[float], least: float = 10.0) -> DataFrame:
    """docs with `__found_assign`, `__found_access`, `__found_hex` and `__found_markov`: the spans of each kind in whole texts.

    Names that begin with `__found_` are this module's own.

    Null texts have none. Candidates are looked for in what the base spans leave, so of a run that a base span covers in
    part the rest is one; those with a letter whose ratio is `least` or more are taken.
    """
    lits = {"assign": (ASSIGN, 1, "length(x.v) >= 6", 2), "access": (ACCESS, 2, "true", 0), "hex": (HEX, 3, "true", 0)}
    out = docs.withColumns({f"__found_{k}": F.expr(_spans("text", p, k, o, ok, g)) for k, (p, o, ok, g) in lits.items()})
    left = "text"
    for k, (p, _, ok, g) in lits.items():
        out = out.withColumn(f"__found_left_{k}", F.expr(_blanked(left, p, f"__found_{k}", ok, g)))
        left = f"__found_left_{k}"
    ok = f"x.m RLIKE '[A-Za-z]' AND {_ratio('x.m', _literal(ratios))} >= {least!r}D"
    return out.withColumn("__found_markov", F.expr(_spans(left, CANDIDATE, "markov", 4, ok))).drop(*[f"__found_left_{k}" for k in lits])


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', s.kind, s.start, s.stop)), ',')")


def scan(docs: DataFrame, ratios: list[float], least: float = 10.0) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts of the base kinds, the digest of their spans, and all spans.

    Null and empty texts have no spans, so the digest is that of the empty string. Null and repeated doc_ids are rows like
    others; other columns are ignored.
    """
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ratios, least)
    base = "concat(__found_assign, __found_access, __found_hex)"
    return found.select(
        "doc_id",
        F.size("__found_assign").cast("long").alias("n_assign"), F.size("__found_access").cast("long").alias("n_access"), F.size("__found_hex").cast("long").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed("concat(__found_assign, __found_access, __found_hex, __found_markov)").alias("spans"),
        F.size("__found_markov").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, ratios: list[float], least: float = 10.0) -> DataFrame:
    """docs with every secret in `text` replaced by [kind], and `n_chars`, where there is one, set to the new length.

    Of an assignment only the value goes. Texts without secrets, null texts and all other columns stay as they are.
    """
    text = F.col("text")
    found = find(docs, ratios, least)
    ordered = "array_sort(transform(concat(__found_assign, __found_access, __found_hex, __found_markov), s -> named_struct('start', s.value, 'stop', s.stop, 'kind', s.kind)))"
    # a fixed kind without a group of its own has value = its start. A piece of the text comes from blocks of it: from the
    # whole text, Spark counts code points from its beginning for each
    places = _scan(ordered, "0", "y.stop", "greatest({t}, {s})", "struct({t} AS begin, y.start AS start, y.stop AS stop, y.kind AS kind)")
    piece = lambda a, n: f"substring(array_join(slice(b, CAST({a} / 1000 AS INT) + 1, CAST({n} / 1000 AS INT) + 2), ''), {a} % 1000 + 1, {n})"
    pieces = f"transform(s, x -> concat(CASE WHEN x.start > x.begin THEN {piece('x.begin', '(x.start - x.begin)')} ELSE '' END, CASE WHEN x.start >= x.begin THEN concat('[', x.kind, ']') ELSE '' END))"
    tail = piece("array_max(transform(s, x -> x.stop))", "greatest(0, length(text) - array_max(transform(s, x -> x.stop)))")
    cut = f"get(transform(array({places}), s -> get(transform(array(regexp_extract_all(text, '(?s).{{1,1000}}', 0)), b -> concat(array_join({pieces}, ''), {tail})), 0)), 0)"
    new = F.when(F.expr("size(__found_assign) + size(__found_access) + size(__found_hex) + size(__found_markov) > 0"), F.expr(cut)).otherwise(text)
    out = found.withColumn("__found_new", new)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__found_new").alias("text"))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length("__found_new").cast(docs.schema[c].dataType), F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), fit(samples(spark)))
