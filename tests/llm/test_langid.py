from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

from colloquy.llm._bytes import words
from colloquy.llm.langid import _dominant, _scripts, _viterbi, _viterbi_parts, identify

from .corpus import SCHEMA, frame, rows

PARTS = {"en": ["the", "ing", "ou", "wh", "ea"], "de": ["sch", "ung", "ei", "tz", "ver"], "ru": ["при", "вет", "мир", "ого", "ать"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(5)
    data = [(i, text(rng, lang, 30), lang) for i in range(150) for lang in [list(PARTS)[i % 3]]]
    mixed = text(rng, "en", 25) + " " + text(rng, "de", 15)
    data += [(1000, mixed, None), (1001, "123 !!", "en"), (1002, None, "de"), (None, "", None), (1003, "привет", None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    for i, _, lang in data[:150]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].lang_pred == lang
    assert [(s.lang, s.words) for s in got[1000].spans] == [("en", 25), ("de", 15)]
    assert got[1000].lang_pred == "en" and 0.4 < got[1000].score < 0.9
    assert [got[i].lang_pred for i in (1001, 1002, None)] == ["und"] * 3 and got[1003].lang_pred == "ru"


def test_decoding_matches_enumeration():
    rng = np.random.default_rng(1)
    score = rng.normal(size=(12, 3)).astype(np.float32)
    first = np.array([0, 1, 5, 12])
    got = _viterbi(score, first, 0.8)
    for lo, hi in zip(first[:-1], first[1:]):
        def value(path):
            return sum(score[lo + t, k] for t, k in enumerate(path)) - 0.8 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023
        best = max(np.ndindex(*[3] * (hi - lo)), key=value)
        assert abs(value(best) - value(got[lo:hi])) < 1e-4


def test_odd_rows(spark):
    assert identify(frame(spark)).count() == len(rows())
    assert identify(spark.createDataFrame([], SCHEMA)).collect() == []
    no_lang = spark.createDataFrame([(1, "abc def", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(no_lang).collect()] == ["und"]


def test_letters_of_every_script_count(spark):
    parts = PARTS | {"ka": ["ქართ", "ული", "ენა", "და", "არის"], "km": ["ភាសា", "ខ្មែរ", "និង", "នៅ"], "got": ["𐌰𐌽", "𐌸𐌰𐌹", "𐌲𐌿𐍄"], "aa-first": ["la", "ne", "ro"]}
    rng = random.Random(6)
    data = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(20)), lang) for i in range(210) for lang in [list(parts)[i % 7]]]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert [(i, got[i].lang_pred) for i, _, _ in data] == [(i, lang) for i, _, lang in data] and all(r.score > 0.9 for r in got.values())


def test_scripts_follow_unicode_letters():
    for c in [*range(0x80, 0xD800, 7), *range(0xE000, 0x34000, 61), 0x10FFFF, *map(ord, "aZ5_éµʼΩἀЖქሀខကᠠᎠＡｱ々가𐌰𠀀")]:
        data = np.frombuffer(chr(c).encode(), np.uint8)
        script = _scripts(data)
        assert (script[0] > 0) == (unicodedata.category(chr(c))[0] == "L") and not script[1:].any(), hex(c)


def test_parts_decode_like_the_whole():
    rng = np.random.default_rng(2)
    for n in (1, 2, 255, 256, 257, 4096, 4097, 9000):
        score = np.repeat(rng.normal(size=(-(-n // 7), 3)), 7, axis=0)[:n].astype(np.float32)
        whole = _viterbi(score, np.array([0, n]), 2.0)
        for size in (1, 100, 4096):
            assert (_viterbi_parts((score[i : i + size] for i in range(0, n, size)), 2.0) == whole).all()


def test_spans_cross_4096_words_and_slices(spark):
    rng = random.Random(8)
    data = [(i, text(rng, lang, 30), lang) for i in range(60) for lang in [list(PARTS)[i % 3]]]
    # the second language begins just before, at and after the place
    data += [(1000 + k, f"{text(rng, 'en', n)} {text(rng, 'de', 5)}", None) for k, n in enumerate((4094, 4095, 4096, 4097))] + [(1010, "x" * 5000 + " " + text(rng, "ru", 3000), None)]
    frame_ = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(frame_).collect()}
    for k, n in enumerate((4094, 4095, 4096, 4097)):
        assert [(s.lang, s.first_word, s.words) for s in got[1000 + k].spans] == [("en", 0, n), ("de", n, 5)]
    assert {r.doc_id: r for r in identify(frame_, slice_scores=1500).collect()} == got


def test_many_languages(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(4)) for _ in range(6)] for k in range(300)}
    data = [(i, " ".join(rng.choice(parts[lang]) for _ in range(30)), lang) for i in range(1500) for lang in [f"l{i % 300:03}"]]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(table).collect()}
    assert sum(got[i] == lang for i, _, lang in data) >= 1485
    few = {r.lang_pred for r in identify(table, languages=10).collect()}
    assert len(few) <= 10


def test_a_word_has_the_script_of_most_letters():
    data = np.frombuffer("hello世 世界a ab你 12 é世".encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]))
    bounds = np.stack([start, end], axis=1).ravel()[:-1]
    latin, han = _scripts(np.frombuffer(b"a", np.uint8))[0], _scripts(np.frombuffer("世".encode(), np.uint8))[0]
    assert _dominant(_scripts(data), bounds).tolist() == [latin, han, latin, 0, latin]


def brute(data):
    """Predictions word by word in plain Python; scores in double precision."""
    def grams(word):
        b = [32, *(c + 32 if 65 <= c <= 90 else c for c in word), 32]
        out = []
        for x, y, z in zip(b, b[1:], b[2:]):
            h = (x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) & 0xFFFFFFFF
            h ^= h >> 15
            out.append(((h * 0x27D4EB2F) & 0xFFFFFFFF) >> 17)
        return out

    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    script = lambda c: int(_scripts(np.frombuffer(c.encode(), np.uint8))[0])
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    langs = sorted({lang for i, _, lang in data if lang and not fold(i)})
    count, total, letters = {k: Counter() for k in langs}, Counter(), {k: Counter() for k in langs}
    for i, t, lang in data:
        if lang and not fold(i):
            for w in split(t):
                count[lang].update(grams(w))
            letters[lang].update(s for s in map(script, t or "") if s)
    for k in langs:
        total[k] = sum(count[k].values())
    usable = lambda k, s: letters[k][s] >= 0.005 * max(sum(letters[k].values()), 1)
    out = {}
    for i, t, _ in data:
        best, path, sizes = None, [], []
        for w in split(t):
            own = Counter(s for s in map(script, w.decode()) if s)
            sizes.append(sum(own.values()))
            if own:
                main = min(own, key=lambda s: (-own[s], s))
                able = [k for k in langs if usable(k, main)] or langs
                raw = {k: sum(math.log((count[k][g] + 0.5) / (total[k] + 0.5 * 32768)) for g in grams(w)) for k in able}
                top = max(raw.values())
                norm = top + math.log(sum(math.exp(v - top) for v in raw.values()))
                score = {k: max(raw.get(k, -1e9) - norm, -5.0) for k in langs}
            else:
                score = dict.fromkeys(langs, 0.0)
            if best is None:
                came, now = {}, dict.fromkeys(langs, 0.0)
            else:
                top = max(langs, key=best.get)
                came = {k: k if best[k] >= best[top] - 6 else top for k in langs}
                now = {k: max(best[k], best[top] - 6) for k in langs}
            path.append(came)
            best = {k: now[k] + score[k] for k in langs}
        share, at = Counter(), best and max(langs, key=best.get)
        for came, n in zip(reversed(path), reversed(sizes)):
            share[at] += n
            at = came.get(at)
        if sum(sizes) == 0:
            out[i] = ("und", 0.0)
        else:
            lang = max(langs, key=lambda k: share[k])
            out[i] = (lang, share[lang] / sum(sizes))
    return out


def test_against_brute_force(spark):
    rng = random.Random(10)
    data = [(i, text(rng, lang, rng.randint(1, 12)), lang) for i in range(60) for lang in [list(PARTS)[i % 3]]]
    data += [(100 + i, " ".join(text(rng, rng.choice(list(PARTS)), rng.randint(1, 9)) for _ in range(4)), rng.choice(["en", "de", None])) for i in range(60)]
    data += [(300, "hello世 12 é, Ünï", "en"), (301, "", "de"), (302, None, None), (303, "12 -- !!", "ru"), (None, "the wh ea", "en")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    want = brute(data)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
