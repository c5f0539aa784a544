"""Secret spans by fixed patterns and by a battery of randomness tests.

All of it is DataFrame expressions. Three pattern kinds give base spans. The
battery looks at every other run of ``TOKEN`` symbols: the smallest of the
``ENCODINGS`` that holds the run is inferred, its symbols become numbers, and

- a chi-squared statistic tests the uniformity of the symbols,
- a Wald-Wolfowitz test counts runs above and below the middle,
- a lag-1 correlation tests for serial dependence.

A token is *random* if none of the three rejects a uniform independent source
(at ``reject`` each, two-sided). It is a *discovery* if ordinary writing would
hardly look as uniform. For encodings of 32 symbols and more, the chi-squared
statistic is held against its distribution for text with the letter repetition
``ORDINARY_REPEAT``. Repetition says little about fewer symbols, so there the
likelihood of the token is compared: uniform symbols against the ``LETTERS`` of the
language that fits best, in hex against words of the first six letters and numbers,
with a change between letter and digit at ``ORDINARY_CHANGE`` of the places (a run
of digits alone is a number). The inverse ratio bounds the p-value, as the ratio
has mean 1 at most in ordinary writing. Benjamini-Hochberg controls the false discovery rate at ``fdr`` within each
length class, over all tokens of the corpus. The p-values are counted in bins
first, so the step sees a bounded table; a bin counts with its upper end.

Positions are code points, ends exclusive. Edge cases: a null text is empty; an
empty text or table has no spans; repeated rows get the same spans and count
in the discovery control as often as they occur; long texts are read whole; a
null id is kept; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import KEY, Tables, quoted, row_keys, split_by_keys, written

# fixed values: the base patterns; hex and access lengths are part of the pattern,
# as a maximal run matches where it is long enough, and nowhere else
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
ASSIGN_LEAST = 6

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Cheap tests that every text with a match of ``ASSIGN`` or ``TOKEN`` passes. Spans of
#: the other two kinds lie within tokens, as they are of at least as many of its symbols.
_MAY_ASSIGN = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
_MAY_TOKEN = r"(?:^|[^A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
_BLOCK = 64
#: Name, test pattern and symbols, smallest first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Chance that two letters of ordinary writing are equal.
ORDINARY_REPEAT = 0.07
#: Occurrences of a to z in ten thousand letters of English, German, French and Spanish; rare ones count as ten.
LETTERS = (
    (820, 150, 280, 430, 1270, 220, 200, 610, 700, 15, 77, 400, 240, 670, 750, 190, 10, 600, 630, 910, 280, 98, 240, 15, 200, 10),
    (650, 190, 270, 510, 1740, 170, 300, 480, 760, 27, 120, 340, 250, 980, 250, 80, 10, 700, 730, 620, 440, 85, 190, 10, 10, 110),
    (760, 90, 330, 370, 1470, 110, 90, 70, 750, 60, 10, 550, 300, 710, 580, 300, 140, 670, 790, 720, 630, 180, 10, 40, 30, 14),
    (1250, 220, 400, 590, 1370, 70, 180, 70, 620, 40, 10, 500, 320, 670, 870, 250, 90, 690, 800, 460, 390, 90, 10, 22, 90, 52),
)
#: Chance that a word ends at a digit or a number at a letter.
ORDINARY_CHANGE = 0.15
FDR, REJECT = 0.01, 0.001
_BINS_A_DECADE, _LAST_BIN = 20, 1200


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for the row."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _running(x: Column, join: Callable[[Column, Column], Column], zero: int = 0, depth: int = 2) -> Column:
    """Each element of an array of ints joined with all before it.

    Arrays grow element by element in blocks of ``_BLOCK`` only, so the time goes
    with the length and not with its square.
    """
    one_block = lambda b: F.aggregate(b, F.array().cast("array<int>"), lambda acc, y: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero)), y))))
    if not depth:
        return one_block(x)

    def whole(y: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(y) - 1) / _BLOCK).cast("int")), lambda k: one_block(F.slice(y, k * _BLOCK + 1, F.lit(_BLOCK))))
        return _let(cut, lambda blocks: _let(_running(F.transform(blocks, lambda b: F.element_at(b, -1)), join, zero, depth - 1), lambda tops: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda v: join(F.coalesce(F.get(tops, k - 1), F.lit(zero)), v))))))

    return F.when(F.size(x) > _BLOCK, _let(x, whole)).otherwise(one_block(x))


def _placed(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    sizes = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), value.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("size"), x["v"].alias("value")))
    # what follows the last match is a gap without one
    sizes = F.filter(sizes, lambda x: x["value"].isNotNull())
    place = lambda rows: F.zip_with(rows, _running(F.transform(rows, lambda x: x["gap"] + x["size"]), operator.add), lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["value"].alias("value")))
    return _let(sizes, place)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (a rational approximation; asymptotic in the tail)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-a * a / 2) / 2.5066282746310002
    tail = F.when(a > 5, density / a * (1 - 1 / (a * a))).otherwise(density * poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _chi_z(stat: Column, mean: Column) -> Column:
    """Wilson-Hilferty: a chi-squared statistic of ``mean`` degrees as a normal score."""
    return (F.pow(stat / mean, 1 / 3) - (1 - 2 / (9 * mean))) / F.sqrt(2 / (9 * mean))


def token_tests(tokens: DataFrame, col: str = "value") -> DataFrame:
    """``tokens`` with encoding, chi_z, runs_z, serial_z and ordinary_p of a column."""
    value = F.col(col)
    pick = lambda f: F.coalesce(*[F.when(value.rlike(p) if p else F.lit(True), F.lit(f(name, symbols))) for name, p, symbols in ENCODINGS])
    out = tokens.withColumn("encoding", pick(lambda name, _: name)).withColumn("_symbols", pick(lambda _, s: s))
    out = out.withColumn("_k", F.length("_symbols").cast("double")).withColumn("_n", F.length(value).cast("double"))
    # symbols are counted in the string; only what depends on their order goes over its characters
    out = out.withColumn("_count", F.transform(F.split("_symbols", ""), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double")))
    total = lambda f: F.aggregate(F.transform("_count", f), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumns({
        "_chi": F.col("_k") / F.col("_n") * total(lambda c, _: c * c) - F.col("_n"),
        "_up": total(lambda c, i: F.when(i >= F.col("_k") / 2, c).otherwise(0.0)),
        "_sum": total(lambda c, i: c * i),
        "_squares": total(lambda c, i: c * i * i),
    }).withColumn("_low", F.col("_n") - F.col("_up"))
    symbol = lambda c: (F.instr(F.col("_symbols"), c) - 1).cast("double")
    state = "struct<last:double,lagged:double,runs:double,turns:double>"

    def step(acc: Column, x: Column) -> Column:
        last, seen = acc["last"], F.coalesce(acc["last"], x)
        half = F.col("_k") / 2
        moved = ((x >= half) != (seen >= half)).cast("double")
        turned = ((x >= 10) != (seen >= 10)).cast("double")
        lagged = acc["lagged"] + F.coalesce(last * x, F.lit(0.0))
        return F.struct(x.alias("last"), lagged.alias("lagged"), (acc["runs"] + moved).alias("runs"), (acc["turns"] + turned).alias("turns"))

    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("lagged"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("turns")).cast(state)
    out = out.withColumn("_walk", F.aggregate(F.split(value, ""), start, lambda acc, c: _let(symbol(c), lambda x: step(acc, x))))
    expected, spread = F.col("_expected"), F.col("_spread")
    first, last = symbol(F.substring(value, 1, 1)), F.col("_walk")["last"]
    out = out.withColumns({"_runs": F.col("_walk")["runs"] + 1.0, "_mean": F.col("_sum") / F.col("_n"), "_expected": 2 * F.col("_up") * F.col("_low") / F.col("_n") + 1})
    out = out.withColumn("_spread", (expected - 1) * (expected - 2) / (F.col("_n") - 1))
    # sums around the mean, from the plain ones
    mean = F.col("_mean")
    out = out.withColumns({
        "_power": F.col("_squares") - F.col("_sum") * mean,
        "_lagged": F.col("_walk")["lagged"] - mean * (2 * F.col("_sum") - first - last) + (F.col("_n") - 1) * mean * mean,
    })
    # log likelihood ratios of uniform symbols to ordinary writing, by symbol
    gains = {26: [[log(sum(row) / (26 * x)) for x in row] for row in LETTERS], 16: [[log(10 / 16)] * 10 + [log(sum(row[:6]) / (16 * x)) for x in row[:6]] for row in LETTERS]}
    sum_of = lambda row: total(lambda c, i: c * F.get(F.array(*map(F.lit, row)), i))
    gain = lambda k: F.least(*map(sum_of, gains[k]))
    turns = F.col("_walk")["turns"]
    stays = F.col("_n") - 1 - F.col("_turns")
    out = out.withColumn("_turns", F.when(F.col("_k") == 16, turns))
    out = out.withColumn("_ratio", F.when(F.col("_k") == 16, gain(16) + log(2) - log(ORDINARY_CHANGE) * F.col("_turns") - log(1 - ORDINARY_CHANGE) * stays).when(F.col("_k") == 26, gain(26)))
    # columns of their own, as the approximations below name them often
    out = out.withColumn("_ordinary", F.greatest(F.col("_n") * (F.col("_k") * ORDINARY_REPEAT - 1), F.lit(0.0)) + F.col("_k") - 1)
    out = out.withColumn("_ordinary_z", _chi_z(F.col("_chi"), F.col("_ordinary")))
    return (
        out.withColumns({
            "chi_z": _chi_z(F.col("_chi"), F.col("_k") - 1),
            "runs_z": F.when(spread > 0, (F.col("_runs") - expected) / F.sqrt(spread)).otherwise(F.lit(9.0)),
            "serial_z": F.when(F.col("_power") > 1e-9, (F.col("_lagged") / F.col("_power") + 1 / F.col("_n")) * F.sqrt("_n")).otherwise(F.lit(9.0)),
            "ordinary_p": F.when(F.col("_ratio").isNotNull(), F.exp(-F.greatest("_ratio", F.lit(0.0)))).when(F.col("_k") * ORDINARY_REPEAT > 1, 1 - _upper_tail(F.col("_ordinary_z"))).otherwise(F.lit(1.0)),
        })
        .drop("_symbols", "_k", "_n", "_count", "_chi", "_up", "_low", "_sum", "_squares", "_walk", "_runs", "_mean", "_expected", "_spread", "_power", "_lagged", "_ordinary", "_ordinary_z", "_turns", "_ratio")
    )


def _discoveries(tests: DataFrame, fdr: float, reject: float) -> DataFrame:
    """Tokens that pass the battery and the discovery control of their length class."""
    p = F.greatest("ordinary_p", F.lit(1e-60))
    tests = tests.withColumn("_class", F.least(F.floor(F.log2(F.col("size") / 5.0)), F.lit(12))).withColumn("_bin", F.least(F.floor(-F.log10(p) * _BINS_A_DECADE), F.lit(_LAST_BIN)))
    counts = tests.groupBy("_class", "_bin").count()
    group = Window.partitionBy("_class")
    steps = counts.withColumn("_rank", F.sum("count").over(group.orderBy(F.desc("_bin")))).withColumn("_m", F.sum("count").over(group))
    passed = steps.where(F.pow(F.lit(10.0), -F.col("_bin") / _BINS_A_DECADE) <= fdr * F.col("_rank") / F.col("_m"))
    limit = passed.groupBy("_class").agg(F.min("_bin").alias("_least"))
    calm = [_upper_tail(F.abs(F.col(c))) * 2 >= reject for c in ("runs_z", "serial_z")] + [_upper_tail(F.abs(F.col("chi_z"))) * 2 >= reject]
    return tests.join(F.broadcast(limit), "_class").where((F.col("_bin") >= F.col("_least")) & calm[0] & calm[1] & calm[2])  # one row a length class


def secret_spans(docs: DataFrame, fdr: float = FDR, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rid, rid2, spans array<struct<kind,start,end>>, by start and kind.

    Kinds are those of ``KINDS``, then ``random`` for what the tests add.
    """
    tables = Tables(docs.sparkSession, "op7")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    text, tokens = F.coalesce(F.col(text_col), F.lit("")), F.col("token")
    found = docs.select(
        F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col),
        F.when(text.rlike(_MAY_ASSIGN), _placed(text, ASSIGN, 1)).otherwise(none).alias("assign"),
        F.when(text.rlike(_MAY_TOKEN), _placed(text, TOKEN)).otherwise(none).alias("token"),
    )

    def inside(pattern: str) -> Column:
        """Matches of a pattern whose symbols are those of tokens."""
        of_one = lambda t: F.transform(_placed(t["value"], pattern), lambda m: F.struct((m["start"] + t["start"]).alias("start"), (m["end"] + t["start"]).alias("end"), m["value"].alias("value")))
        return F.flatten(F.transform(F.filter(tokens, lambda t: t["value"].rlike(pattern)), of_one))

    found = found.withColumns({"assign": F.filter("assign", lambda x: F.length(x["value"]) >= ASSIGN_LEAST), "access": inside(ACCESS), "hex": inside(HEX)})

    def named(n: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    found = found.select("doc_id", *KEY, F.concat(*[named(n, k) for n, k in enumerate(KINDS)]).alias("base"), "token")
    found = tables.write(found.withColumn("token", F.when((F.size("base") > 0) & (F.size("token") > 0), _clear(F.col("token"), F.col("base"))).otherwise(F.col("token"))), "found")
    # rows that repeat count as often as they occur
    tests = token_tests(found.where(F.size("token") > 0).select(*KEY, F.explode("token").alias("t")).select(*KEY, "t.start", "t.end", "t.value"))
    tests = tables.write(tests.withColumn("size", F.length("value")).drop("value", "encoding"), "tests")
    span = F.struct("start", F.lit(len(KINDS)).alias("n"), "end", F.lit("random").alias("kind"))
    more = _discoveries(tests, fdr, reject).groupBy(*KEY).agg(F.collect_set(span).alias("more"))
    both = found.where(F.size("token") > 0).join(more, list(KEY), "left").withColumn("all", F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,n:int,end:int,kind:string>>"))))
    rest = found.where(F.size("token") == 0).withColumn("all", F.col("base"))
    columns = ["doc_id", *KEY, F.transform(F.array_sort("all"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans")]
    return both.select(columns).union(rest.select(columns))


def _clear(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span.

    Base spans by their start and tokens by their end in one order: a token is
    free if no span that starts before its end reaches beyond its start.
    """
    line = lambda at, base, start, end, value: F.struct(at.alias("at"), F.lit(base).alias("base"), start.alias("start"), end.alias("end"), value.alias("value"))
    both = F.concat(F.transform(tokens, lambda t: line(t["end"], 0, t["start"], t["end"], t["value"])), F.transform(base, lambda b: line(b["start"], 1, b["start"], b["end"], F.lit(None).cast("string"))))
    reach = lambda rows: _running(F.transform(rows, lambda x: F.when(x["base"] == 1, x["end"]).otherwise(0)), F.greatest)
    free = lambda rows: F.filter(F.zip_with(rows, reach(rows), lambda x, r: F.when((x["base"] == 0) & (r <= x["start"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))), lambda x: x.isNotNull())
    return _let(F.array_sort(both), free)


def digest(spans: DataFrame) -> DataFrame:
    """The query's columns: counts, the base digest and the joined spans."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "random"), name), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>", fdr: float = FDR, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark``; overlapping spans become one."""
    spans = secret_spans(docs, fdr, reject, id_col, text_col).where(F.size("spans") > 0).select(*KEY, "spans").dropDuplicates(list(KEY))
    spans = written(spans, "op7-spans")
    text = F.col("row").getField(text_col)
    # where the text goes on after each span, and where it begins
    reach = _running(F.transform("spans", lambda x: x["end"]), F.greatest)
    gaps = F.filter(F.zip_with(F.concat(F.array(F.lit(0)), "reach"), F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length(text))), lambda b, e: F.struct(b.alias("b"), e.alias("e"))), lambda g: g["b"] <= g["e"])
    few = F.array_join(F.transform(gaps, lambda g: text.substr(g["b"] + 1, g["e"] - g["b"])), mark)
    # a substring is counted from the first character, so texts of many spans go by characters
    many = _let(F.split(text, ""), lambda chars: F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(chars, g["b"] + 1, g["e"] - g["b"]), "")), mark))
    kept = F.when(F.size("spans") <= 16, few).otherwise(many)
    # texts without a span stay where they are; the rows are structs, so that no name clashes
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), *row_keys(id_col, text_col))
    near, rest = split_by_keys(rows, spans, "rid")
    near = near.join(spans, list(KEY), "left").withColumn("reach", reach)
    clean = F.col("row").withField("`" + text_col + "`", F.when(F.col("spans").isNotNull(), kept).otherwise(text)).alias("row")
    return rest.select("row.*").union(near.select(clean).select("row.*"))
