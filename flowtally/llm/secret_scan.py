"""Secret scan with DataFrame functions only.

Three patterns (assignments, access keys, hex runs) give the base spans.  The
method adds tokens that look random: for every token of 20 or more encoding
characters the encoding is inferred from its characters, and a battery of three
tests is run against "drawn uniformly from that alphabet":

* chi-squared uniformity of the symbol counts (its cube root is close to normal
  even where the expected counts are small),
* runs of symbols in the lower and upper half of the alphabet,
* lag-one serial correlation of the symbol numbers.

Words, names and paths fail at least one of them.  The Bonferroni combination of the three p-values is
then cut by a false-discovery rule that knows the length: among tokens of one
encoding and length class, random tokens must be spread over the p-values in a
known way, which gives their number from the upper half; the cut-off is the
smallest one at which the rest is at most ``fdr`` of what is reported.  Short
classes, where ordinary words pass the tests more often, get a stricter cut-off.
The upper half of a class bounds that number from above, too (a Poisson limit,
which tends to the plain estimate as the class grows and allows a lone token);
from ``DEFAULT_CUT`` on a cut-off may rest on that bound.  The rule is one for
all class sizes, and more tokens in the upper half never raise a cut-off.

Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import free_names, write_table

# The patterns of the base kinds, in order, and the shortest
# match (of the given group) that counts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = ((ASSIGN, 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))
# Cheap tests for texts that can hold a match at all.
MAYBE = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}")
TOKEN = r"[A-Za-z0-9+/_-]{20,}"

ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)
LENGTHS = (20, 28, 40, 56, 80)  # lower ends of the length classes
CUTS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
DEFAULT_CUT = 0.02  # smallest cut-off that may rest on the upper bound of the random tokens
SPAN = "array<struct<start:int,kind:int,end:int>>"
CHUNK = 256  # matches walked before they are appended to the rest
PAGE = 512  # code points of a text that are cut out together


def _spans(text: Column, maybe: str, pattern: str, group: int, least: int, kind: int, keep_text: bool = False) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least``
    characters.  The text between matches and the matches alternate, so adding
    up their lengths gives the positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    steps = F.arrays_zip(F.split(text, pattern, -1), hits, value)
    kind_type = SPAN if not keep_text else "array<struct<start:int,kind:int,end:int,token:string>>"
    none = F.array().cast(kind_type)

    def step(at, x):
        start = at + F.char_length(x["0"])
        end = start + F.coalesce(F.char_length(x["1"]), F.lit(0))
        fields = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")]
        found = F.array(F.struct(*fields, *([x["1"].alias("token")] if keep_text else [])))
        return end, F.when(F.coalesce(F.char_length(x["2"]) >= least, F.lit(False)), found).otherwise(none)

    return F.when(text.rlike(maybe), _walk(steps, kind_type, step, lambda at, out: out)).otherwise(none)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walk(items: Column, kind: str, step, finish) -> Column:
    """Walks over ``items`` with a position: ``step(at, x)`` gives the next
    position and an array of type ``kind``; ``finish(at, all arrays joined)`` is
    the result.  Arrays are appended within chunks and chunks to each other, so
    a text with very many matches is not copied once per match."""
    none = F.array().cast(kind)

    def one(acc, x):
        at, found = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], found).alias("out"))

    def walked(v):
        def chunk(acc, k):
            join = lambda c: F.struct(c["at"].alias("at"), F.concat(acc["out"], F.array(c["out"])).alias("out"))
            return F.aggregate(F.slice(v, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), one, join)

        chunks = F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(chunks, start, chunk, lambda acc: finish(acc["at"], F.flatten(acc["out"])))

    return _bound(items, walked)


# Upper tail of the normal distribution (the usual five-term polynomial, error
# under 1e-7), for z >= 0.
_TAIL = (
    "exp(-0.5D * {z} * {z}) * 0.3989422804D * u * (0.319381530D + u * (-0.356563782D + u * (1.781477937D"
    " + u * (-1.821255978D + u * 1.330274429D))))"
)


def _tail(z: str) -> str:
    poly = _TAIL.replace("u * (", f"(1D / (1D + 0.2316419D * {z})) * (").replace("u * 1.33", f"(1D / (1D + 0.2316419D * {z})) * 1.33")
    return "(" + poly.format(z=z) + ")"


def _battery(tokens: Column) -> Column:
    """``array<struct<start,kind,end,encoding,n,p>>``: the combined p-value of
    each token under its inferred encoding (0: hex, 1: base32, 2: base36 in
    lower case, 3: base64 in either form)."""
    alphabet = "element_at(array({}), x.encoding + 1)".format(", ".join(f"'{a}'" for a in ALPHABETS))
    size = "element_at(array({}), x.encoding + 1)".format(", ".join(f"{len(a)}D" for a in ALPHABETS))

    def then(col: Column, fields: str) -> Column:
        """Next array of structs, from ``x`` of the last one."""
        return F.call_function("transform", col, F.expr(f"x -> struct({fields})"))

    place = "x.start AS start, x.kind AS kind, x.end AS end"
    step = tokens
    stages = (
        f"""{place}, CASE WHEN x.token RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 0 WHEN x.token RLIKE '^[A-Z2-7]+$' THEN 1
            WHEN x.token RLIKE '^[a-z0-9]+$' THEN 2 ELSE 3 END AS encoding, x.token AS token""",
        f"""{place}, x.encoding AS encoding, {size} AS a, transform(split(
            CASE x.encoding WHEN 0 THEN lower(x.token) WHEN 3 THEN translate(x.token, '-_', '+/') ELSE x.token END, ''),
            c -> CAST(instr({alphabet}, c) - 1 AS DOUBLE)) AS v""",
        f"""{place}, x.encoding AS encoding, x.a AS a, CAST(size(x.v) AS DOUBLE) AS n,
            aggregate(array_distinct(x.v), 0D, (s, y) -> s + power(size(filter(x.v, w -> w = y)), 2)) AS squares,
            CAST(size(filter(x.v, w -> w * 2 < x.a)) AS DOUBLE) AS low,
            aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v) - 1),
                (p, q) -> CASE WHEN (p * 2 < x.a) != (q * 2 < x.a) THEN 1D ELSE 0D END), 1D, (s, y) -> s + y) AS runs,
            aggregate(x.v, 0D, (s, y) -> s + y) AS s1, aggregate(x.v, 0D, (s, y) -> s + y * y) AS s2,
            aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v) - 1), (p, q) -> p * q), 0D, (s, y) -> s + y) AS s11""",
        f"""{place}, x.encoding AS encoding, x.n AS n,
            (cbrt((x.a * x.squares / x.n - x.n) / (x.a - 1)) - 1 + 2 / (9 * (x.a - 1))) / sqrt(2 / (9 * (x.a - 1))) AS z1,
            2 * x.low * (x.n - x.low) AS m, x.runs AS runs,
            CASE WHEN x.s2 * x.n > x.s1 * x.s1
                 THEN abs((x.s11 - x.s1 * x.s1 / x.n) / (x.s2 - x.s1 * x.s1 / x.n)) * sqrt(x.n) END AS z3""",
        f"""{place}, x.encoding AS encoding, x.n AS n, x.z1 AS z1, x.z3 AS z3,
            CASE WHEN x.m > x.n THEN greatest(abs(x.runs - x.m / x.n - 1) - 0.5D, 0D) / sqrt(x.m * (x.m - x.n) / (x.n * x.n * (x.n - 1))) END AS z2""",
        f"""{place}, x.encoding AS encoding, CAST(x.n AS INT) AS n, least(1D, 3 * least(
            CASE WHEN x.z1 >= 0 THEN {_tail('x.z1')} ELSE 1 - {_tail('(-x.z1)')} END,
            coalesce(2 * {_tail('x.z2')}, 0D), coalesce(2 * {_tail('x.z3')}, 0D))) AS p""",
    )
    for fields in stages:
        step = then(step, fields)
    return step


def _scan(docs: DataFrame, text_col: str, base_col: str = "__base", tokens_col: str = "__tokens") -> DataFrame:
    """``docs`` with a column of base spans and one of tested tokens."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = [_spans(text, MAYBE[k], *BASE[k], k) for k in range(3)]
    tokens = _spans(text, TOKEN, TOKEN, 0, 20, 3, keep_text=True)
    return docs.withColumns({base_col: F.concat(*base), tokens_col: _battery(tokens)})


def _length_class(n: Column) -> Column:
    return sum(((n >= least).cast("int") for least in LENGTHS), F.lit(0))


def cut_offs(counts: dict[tuple[int, int], dict[int, int]], fdr: float) -> dict[tuple[int, int], float]:
    """Per (encoding, length class) the smallest p reported; ``counts`` has how
    many tokens fall between neighbouring ``CUTS``.  The smallest of three
    independent uniform p-values, times three, is t or more with probability
    (1 - t/3)^3."""
    out = {}
    for group, by_cut in counts.items():
        above = [sum(n for c, n in by_cut.items() if c > i) for i in range(len(CUTS))]
        upper = above[-1]
        for cut, n in zip(CUTS, above):
            if n and (_random(upper, cut) >= (1 - fdr) * n or cut >= DEFAULT_CUT and _random(_poisson_limit(upper), cut) >= (1 - fdr) * n):
                out[group] = cut
                break
    return out


def _random(upper: float, cut: float) -> float:
    """Random tokens of p at ``cut`` or more, if ``upper`` of them are above
    the last cut."""
    return upper * ((1 - cut / 3) / (1 - CUTS[-1] / 3)) ** 3


def _poisson_limit(n: int) -> float:
    """The mean below which a Poisson count of ``n`` or fewer has 5 % or more
    (Wilson and Hilferty's cube)."""
    n += 1
    return n * (1 - 1 / (9 * n) + 1.645 / (3 * n**0.5)) ** 3


def _cut_offs(tokens: DataFrame, fdr: float, tokens_col: str = "__tokens") -> dict[tuple[int, int], float]:
    """From all tokens; at most encodings x length classes x cuts rows come
    back."""
    x = tokens.select(F.explode(tokens_col).alias("x")).select(
        F.col("x.encoding").alias("encoding"),
        _length_class(F.col("x.n")).alias("length"),
        sum(((F.col("x.p") >= cut).cast("int") for cut in CUTS), F.lit(0)).alias("cut"),
    )
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in x.groupBy("encoding", "length", "cut").count().collect():
        counts.setdefault((r.encoding, r.length), {})[r.cut] = r["count"]
    return cut_offs(counts, fdr)


def _reported(cuts: dict[tuple[int, int], float], base_col: str = "__base", tokens_col: str = "__tokens") -> Column:
    """All spans of a row, by start and then kind."""

    def passes(x):
        cut = F.lit(None).cast("double")
        for (encoding, length), p in sorted(cuts.items()):
            cut = F.when((x["encoding"] == encoding) & (_length_class(x["n"]) == length), F.lit(p)).otherwise(cut)
        return F.coalesce(x["p"] >= cut, F.lit(False))

    random = F.transform(F.filter(tokens_col, passes), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.array_sort(F.concat(base_col, random.cast(SPAN)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans``.  Null is an empty text: no spans.  The spans (without
    text) are written once; the cut-offs are counted over all of them."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = write_table(_scan(source, "text").select("doc_id", "__base", "__tokens"), "secrets")
    spans = _reported(_cut_offs(found, fdr))
    count = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.array_sort("__base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def redact_secrets(docs: DataFrame, fdr: float = 0.05, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``
    (overlapping spans by one); other columns and texts without spans, null
    included, are unchanged."""
    base, tokens, spans = free_names(docs, "base", "tokens", "spans")
    # Texts are scanned once: they are written with what was found in them.
    scanned = write_table(_scan(docs, text_col, base, tokens), "secrets")
    cuts = _cut_offs(scanned, fdr, tokens)
    text = F.col(f"`{text_col}`")

    def clean(pages):
        def cut(start, end=None):
            page = lambda at: (at / PAGE).cast("int")
            count = F.size(pages) if end is None else page(end) - page(start) + 1
            near = F.array_join(F.slice(pages, page(start) + 1, count), "")
            return near.substr(start % PAGE + 1, F.char_length(near) if end is None else end - start)

        def step(at, x):
            pieces = F.array(cut(at, x["start"]), F.lit(mark))
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, pieces).otherwise(F.array().cast("array<string>"))

        return _walk(F.col(spans), "array<string>", step, lambda at, out: F.concat(F.array_join(out, ""), cut(at)))

    clean_text = _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)), clean)
    out = scanned.withColumn(spans, _reported(cuts, base, tokens))
    return out.withColumn(text_col, F.when(F.size(spans) > 0, clean_text).otherwise(text)).select(*(f"`{c}`" for c in docs.columns))
