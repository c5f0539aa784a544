from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm.infilling import EliasFano, fill_in_middle, restore

from .corpus import SCHEMA, frame, null_last, rows


def plain(doc_id, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, t
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(t), "spm" if h[3] % 100 < 20 else "psm", a, b - a, out


@pytest.mark.parametrize("chars", ["a", "é", "中", "😀", "a中", "aé😀 ", "a" * 999 + "😀"])
def test_index_finds_each_boundary(chars):
    text = (chars * (1 + 3000 // len(chars))).encode()
    ends = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
    index = EliasFano(ends, len(text))
    assert [index.select(i) for i in range(len(ends))] == ends.tolist()
    assert index.upper.nbytes + index.lower.nbytes <= 0.6 * len(ends) + 128


def odd():
    marked = [(500 + k, t, None, None, 0, "r", "n", 1, "s") for k, t in enumerate(("a <P> b", "<M>", "x<S", "<P <S M>", "é" * 300 + "<S>"))]
    long = [(600, "long text é " * 90_000, None, None, 0, "r", "n", 1, "s")]
    return rows() + marked + long + [(700 + k, "the same 😀 text of many", None, None, 0, "r", "n", 1, "s") for k in range(400)]


def test_against_plain_cuts(spark):
    cut = fill_in_middle(frame(spark, odd())).withColumn("back", restore(F.col("output"), F.col("form"))).cache()
    got = sorted((tuple(r)[:6] for r in cut.collect()), key=null_last)
    assert got == sorted((plain(*r[:2]) for r in odd()), key=null_last)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    texts = sorted(((r[0], r[1] or "") for r in odd()), key=null_last)
    assert sorted(((r.doc_id, r.back) for r in cut.collect()), key=null_last) == texts


def test_rates_and_text_ids(spark):
    data = [(f"d{k}", "some words here") for k in range(300)]
    cut = fill_in_middle(spark.createDataFrame(data, "doc_id string, text string"), fim_percent=50, spm_percent=100)
    got = {r.doc_id: r.form for r in cut.collect()}
    assert set(got) == {k for k, _ in data} and set(got.values()) == {"plain", "spm"} and 100 < sum(f == "spm" for f in got.values()) < 200


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
