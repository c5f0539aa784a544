from __future__ import annotations

import hashlib
import random

import numpy as np

from colloquy.llm.fingerprints import fingerprint_neighbours, likeness, phrase_names, sketches

from .corpus import SCHEMA, frame, rows, words


def test_edited_texts_follow_the_order_of_ids(spark):
    order = sorted([r[:2] for r in rows()], key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprint_neighbours(frame(spark)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text: dict = {}
    for r in got:
        text = next(t for i, t in order if i == r.doc_id) or ""
        by_text.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got if r.n_chars > 400 and r.near_next < 0.2]
    assert np.mean([0.3 < r.near_edited < 0.75 for r in long]) > 0.7


def test_equal_substrings_share_phrases():
    text = np.random.default_rng(1).integers(97, 117, 8000).astype(np.uint8)
    moved = np.concatenate([np.frombuffer(b"some other beginning", np.uint8), text])
    a, b = (set(phrase_names(t, np.array([0, len(t)]))[0].tolist()) for t in (text, moved))
    assert len(a & b) > 0.95 * len(a)


def test_rows_of_a_slice_are_independent():
    texts = [b"", b"a", b"aaaaaaa", b"abcabcabcabc", bytes(range(97, 123)) * 20]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    both = sketches(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, row in zip(texts, both):
        assert (sketches(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] == row).all()


def test_single_and_empty_tables(spark):
    (one,) = fingerprint_neighbours(spark.createDataFrame([(5, "abc def")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and one.near_next == 1
    assert fingerprint_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []


def like(a: bytes, b: bytes) -> float:
    x = sketches(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
    return float(likeness(x[:1], x[1:])[0])


def test_likeness_has_no_step_in_length():
    rng = random.Random(3)
    for n in (60, 126, 127, 128, 129, 255, 256, 1000, 4096, 20_000):
        texts = [words(rng, n).encode()[:n] for _ in range(12)]
        assert np.mean([like(t, t + b"x") for t in texts]) > 0.75, n
        assert np.mean([like(t, t[:-1] + b"#") for t in texts]) > 0.75, n
        assert 0.3 < np.mean([like(t, t[: n - n // 2] + o[: n // 2]) for t, o in zip(texts, texts[1:])]) < 0.75, n
        assert all(like(t, t) == 1 for t in texts)


def test_crowded_ids(spark):
    rng = random.Random(4)
    data = [(7 if i % 3 else None if i % 2 else i, words(rng, 3)) for i in range(300)] + [(7, "same")] * 20
    got = fingerprint_neighbours(spark.createDataFrame(data, "doc_id long, text string").repartition(5))
    out = got.collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted((str(i), len(t)) for i, t in data)
    edited = {}
    for i, t in data:
        for _, other in data:
            edited[hashlib.sha256((t[: len(t) - len(t) // 2] + other[: len(t) // 2]).encode()).hexdigest()] = 1
    assert all(r.edited_sha256 in edited for r in out)
