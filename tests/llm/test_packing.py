from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm.packing import Ids, class_lengths, cut, pack

from .corpus import SCHEMA, frame, rows, words


def test_cut_uses_class_lengths_only():
    lengths, counts = class_lengths(2048, 32)
    assert all(n * c <= 2048 for n, c in zip(lengths, counts))
    for n in range(5000):
        got = cut(n, lengths)
        assert sum(got) == n and set(got) <= set(lengths.tolist())


#: White space of all kinds before, between and after words.
ODD = "a  b\t c \td \t e\x1c f \x85g\u00a0 h \u2003i \u3000 j  \n k'll it's  don't 12 34½ … é ß😀 世界 ก  "


def test_chunks_give_the_ids_of_the_whole_text():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, ids = random.Random(5), Ids(None)
    symbols = [*" \t\n\x0b\x1c\x85\u00a0\u1680\u2003\u200b\u3000\ufeff", "  ", "a", "Zz", "'s", "'", "9", "é", "世", "😀", "-", "<|endoftext|>", "\u0301", "ก"]
    for _ in range(300):
        texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 12))) for _ in range(20)]
        for text, got in zip(texts, ids.of(texts)):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_cuts_within_words_give_the_ids_of_the_whole_text():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, ids = random.Random(7), Ids(None)
    symbols = [*" \n\r\t", "the", "The", "'", "''", "s", "ll", "re", "é", "É", "ß", "×", "÷", "ÿ", "ĉ", "7", "42", "½", ",", ".", "(", "-", "_", "\u007f", "\u0085", "\u0301", "ა", "\u1680", "あ", "\u3000", "한", "<|", "endoftext", "|>", "<|endoftext|>"]
    for _ in range(400):
        texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 15))) for _ in range(20)]
        for text, got in zip(texts, ids.of(texts)):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_encoded_once_whatever_follows_them():
    pytest.importorskip("tokenizers")
    ids, read = Ids(None), []
    rng = random.Random(3)
    some = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(8)) for _ in range(200)]

    class Counting:
        def encode_batch_fast(self, parts, **options):
            read.extend(map(len, parts))
            return tokenizer.encode_batch_fast(parts, **options)

    tokenizer, ids.tokenizer = ids.tokenizer, Counting()
    texts = ["".join(f" {w}{end}" for w in some) for end in ["", ",", ".", ";", "!!", ")", ":", ".\n7", "?", "***"]]
    assert len(ids.of(texts)) == len(texts)
    assert sum(read) <= sum(len(w) + 1 for w in some) + 100


@pytest.mark.parametrize("workers", [1, 7])
def test_round_trip(spark, workers):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    rng = random.Random(1)
    data = [(i, words(rng, rng.randint(0, 900))) for i in range(60)] + [(900, "word " * 20_000), (None, None), (901, "<|endoftext|> é"), (902, ""), (902, ""), (903, "hi <|endoftext|> there  <|endoftext|>\n"), (904, "x" * 1_000_000), (905, ODD), (906, " ".join(ODD))]
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    ids = {}
    for i, t in data:
        ids[i] = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] += len(ids[i])
    got = pack(spark.createDataFrame(data, "doc_id long, text string"), workers=workers).collect()
    sums, bins = Counter(), defaultdict(list)
    for r in got:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        sums[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert sums == want
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    padding = [2048 - sum(x[1] for x in p) for p in bins.values()]
    assert sum(padding) <= 2048 + 0.01 * sum(want.values())


def test_odd_rows_and_empty_table(spark):
    assert len({r.doc_id for r in pack(frame(spark)).collect()}) == len({r[0] for r in rows()})
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
