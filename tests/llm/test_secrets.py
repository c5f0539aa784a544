from __future__ import annotations

import hashlib
import itertools
import math
import operator
import random
import re
import string

from pyspark.sql import functions as F

from colloquy.llm.secrets import ENCODINGS, LETTERS, ORDINARY_CHANGE, ORDINARY_REPEAT, TOKEN, _running, digest, redact, secret_spans

from .corpus import SCHEMA, frame, rows, words

KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(m)]
    return hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()


def mixed():
    rng = random.Random(3)
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    return [
        (1, "password=token: abcdefgh x"), (2, 'é😀 Token = "abc.def" AKIA' + "A" * 20 + " " + "0f" * 12), (3, f"see {run(string.ascii_letters + string.digits + '+/', 44)} end"),
        (4, run(string.ascii_uppercase + "234567", 32)), (5, "einstaueinkeitlichlichenberverkeit"), (6, "internationalization_of_the_world_and-more"), (7, "api_key: kkkkkk"),
        (8, "a" * 30_000), (9, run("0123456789abcdef", 40)), (10, "x API-KEY=1234567 apikey='1234567' api_KEY:12345 AKIAKIA" + "B" * 15), (11, None), (12, ""), (12, ""), (None, "secret = abcdef"),
    ]


def test_base_spans_match_the_patterns(spark):
    data = mixed() + [r[:2] for r in rows()]
    got = digest(secret_spans(spark.createDataFrame(data, "doc_id long, text string")))
    assert sorted((str(r.doc_id), r.base_sha256) for r in got.collect()) == sorted((str(i), brute(t)) for i, t in data)


def test_random_tokens_are_found_and_words_left(spark):
    got = {r.doc_id: r.spans for r in digest(secret_spans(spark.createDataFrame(mixed(), "doc_id long, text string"))).collect()}
    assert got[3] == "random:4:48" and got[4] == "random:0:32"
    assert "random" not in got[5] + got[6] + got[8]


def test_redaction_and_other_columns(spark):
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(mixed(), "doc_id long, text string")).collect()}
    assert got[3] == "see <SECRET> end" and got[2] == 'é😀 <SECRET>" <SECRET> <SECRET>' and got[5] == mixed()[4][1] and got[11] is None
    assert redact(frame(spark)).columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert redact(frame(spark)).count() == len(rows())


def test_empty_table(spark):
    assert secret_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_short_tokens_of_few_symbols_are_found(spark):
    rng = random.Random(11)
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    planted = [run("0123456789ABCDEF", n) for n in (32, 32, 40, 40, 64, 64) for _ in range(10)] + [run("0123456789abcdef", n) for n in (22, 23) for _ in range(30)] + [run(string.ascii_lowercase, n) for n in (22, 24, 26) for _ in range(20)]
    left = ["20240131120000123456789", "31415926535897932384626433832795", "00000000000000000000", "FACADEDECADEACCEDEDBEADED", "DEFACED2024DECADE1999FACADE2001", "abacadabaca2024facade1999", "donaudampfschifffahrtsgesellschaft", "internationalizationofeverything", "ANTICONSTITUTIONNELLEMENTPARLANT", "electroencefalografistasdelmundo"]
    docs = list(enumerate(planted + left))
    got = [bool(r.spans) for r in sorted(digest(secret_spans(spark.createDataFrame(docs, "doc_id long, text string").where("text not rlike '^[0-9a-f]{24,}$'"))).collect())]
    # a run of 24 or more lower-case hex symbols, digits alone among them, is a base span: not asked here
    kept = [(i, t) for i, t in docs if not re.fullmatch("[0-9a-f]{24,}", t)]
    found = {i for (i, _), hit in zip(kept, got) if hit}
    upper, short, lower = (sum(i in found for i in part) / len(part) for part in (range(60), range(60, 120), range(120, 180)))
    assert upper >= 0.9 and short >= 0.7 and lower >= 0.7
    assert not [t for i, t in kept if i >= len(planted) and i in found]


def normal_tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def battery(value):
    """(p of ordinary writing, largest of the three two-sided rejections' complements) in plain Python."""
    symbols = next(s for _, p, s in ENCODINGS if not p or re.search(p, value))
    n, k = len(value), len(symbols)
    x = [symbols.index(c) for c in value]
    chi = k / n * sum(x.count(v) ** 2 for v in set(x)) - n
    z_of = lambda stat, mean: ((stat / mean) ** (1 / 3) - (1 - 2 / (9 * mean))) / math.sqrt(2 / (9 * mean))
    up = sum(v >= k / 2 for v in x)
    runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
    expected = 2 * up * (n - up) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs_z = (runs - expected) / math.sqrt(spread) if spread > 0 else 9
    mean = sum(x) / n
    power = sum((v - mean) ** 2 for v in x)
    serial_z = (sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / power + 1 / n) * math.sqrt(n) if power > 1e-9 else 9
    if k in (16, 26):
        if k == 26:
            ratio = min(sum(math.log(sum(row) / (26 * row[v])) for v in x) for row in LETTERS)
        else:
            turns = sum((a >= 10) != (b >= 10) for a, b in zip(x, x[1:]))
            ratio = min(sum(math.log(10 / 16) if v < 10 else math.log(sum(row[:6]) / (16 * row[v - 10])) for v in x) for row in LETTERS)
            ratio += math.log(2) - math.log(ORDINARY_CHANGE) * turns - math.log(1 - ORDINARY_CHANGE) * (n - 1 - turns)
        p = math.exp(-max(ratio, 0))
    else:
        p = normal_tail(-z_of(chi, max(n * (k * ORDINARY_REPEAT - 1), 0) + k - 1)) if k * ORDINARY_REPEAT > 1 else 1.0
    return p, min(2 * normal_tail(abs(z)) for z in (z_of(chi, k - 1), runs_z, serial_z))


def brute_spans(texts):
    """All spans of each text: base patterns, then the battery under discovery control by length class."""
    out, tokens = [], []
    for i, text in enumerate(texts):
        base = sorted((m.start(), n, m.end(), k) for n, (k, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(m))
        out.append(base)
        for m in re.finditer(TOKEN, text or ""):
            if not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                tokens.append((i, m.start(), m.end(), *battery(m[0])))
    by_class = {}
    for t in tokens:
        by_class.setdefault(min(int(math.log2((t[2] - t[1]) / 5)), 12), []).append((int(-math.log10(max(t[3], 1e-60)) * 20), t))
    for got in by_class.values():
        bins = [b for b, _ in got]
        least = min((b for b in bins if 10 ** (-b / 20) <= 0.01 * sum(c >= b for c in bins) / len(bins)), default=None)
        for b, t in got:
            if least is not None and b >= least and t[4] >= 0.001:
                out[t[0]].append((t[1], len(KINDS), t[2], "random"))
    return [",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(x)) for x in out]


def test_all_spans_against_brute_force(spark):
    rng = random.Random(21)
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alphabets = [s for _, _, s in ENCODINGS] + ["ab", "aeiounrst", "0123456789"]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice([lambda: run(rng.choice(alphabets), rng.randint(15, 90)), lambda: f"token={run('abcXYZ019+', rng.randint(3, 30))}", lambda: "AKIA" + run("ABC123", rng.randint(10, 30)), lambda: words(rng, 8)])())
        texts.append(rng.choice([" ", ".", ""]).join(parts))
    data = list(enumerate(texts)) + [(900, None), (901, "")]
    got = {r.doc_id: r.spans for r in digest(secret_spans(spark.createDataFrame(data, "doc_id long, text string"))).collect()}
    want = brute_spans([t for _, t in data])
    assert [got[i] for i, _ in data] == want and sum("random" in w for w in want) > 50


def test_long_tokens_and_many_spans(spark):
    rng = random.Random(22)
    run = lambda n: "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n))
    many = " ".join(rng.choice([lambda: f"token={run(8)}", lambda: run(30), lambda: "word"])() for _ in range(5000))
    data = [(1, f"{run(300_000)} end"), (2, many), (3, "é" * 70 + many)]
    frame_ = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in digest(secret_spans(frame_)).collect()}
    assert got[1] == "random:0:300000" and got[2].count("assign") == many.count("token=")
    clean = {r.doc_id: r.text for r in redact(frame_).collect()}
    assert clean[1] == "<SECRET> end" and clean[3] == "é" * 70 + clean[2]
    text, at, want = many, 0, []
    for s, e in (map(int, x.split(":")[1:]) for x in got[2].split(",")):
        want.append(text[at:s])
        at = e
    assert clean[2] == "<SECRET>".join([*want, text[at:]])


def test_running_sums_cross_blocks(spark):
    for n in (0, 1, 63, 64, 65, 4096, 4097, 10_000):
        x = [(7 * i) % 11 for i in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(_running(F.col("x"), operator.add).alias("s"), _running(F.col("x"), F.greatest).alias("m")).first()
        assert got.s == list(itertools.accumulate(x)) and got.m == list(itertools.accumulate(x, max))
