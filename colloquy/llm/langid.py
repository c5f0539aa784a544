"""Language of texts and of the spans of mixed-language texts.

Byte trigrams of lower-cased words, with word borders, are counted for each
learned language over all training documents, in ``BUCKETS`` hashed columns; so
are the scripts of the letters. Every letter of Unicode has a script, from fixed
ranges, or is of one class for the rest. A word's script, that of most of its
letters (of equals the first in the list), leaves the languages of which at least
``SCRIPT_SHARE`` of the letters are in it (all, if there are none). Its score in
each is the log-likelihood of its trigrams, normalised over languages and floored.
Viterbi decoding over all words of a text, with ``PENALTY`` for a change of
language, labels the words; runs of one label are spans. Texts beyond a slice's
size are decoded part by part, with the states and two bytes or so a word carried
on, so that they need little memory; the labels are those of the whole.

The language of a text is the one with the most letters in its spans; the score
is its share of the letters. Texts that are null or have no letter are ``und``
with score 0; without training rows all are ``und``. Repeated rows get equal
results; a null id belongs to the training fold; other columns are ignored; an
empty table gives an empty result. All languages of the training rows are learned, or
the most frequent ones if a number is given, which bounds the model where labels are dirty.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import IS_SPACE, LOWER, slices, utf8_buffers, words
from .quality import held_out

BUCKETS = 1 << 15
PENALTY, FLOOR, SCRIPT_SHARE = 6.0, -5.0, 0.005
_SCORES = 8 << 20  # bytes of text times languages that one slice holds the scores of
_OTHER, _LETTER, _LATIN, _GREEK, _CYRILLIC, _ARMENIAN, _HEBREW, _ARABIC, _INDIC, _SOUTHEAST, _KANA, _HAN, _HANGUL, _GEORGIAN, _ETHIOPIC, _KHMER, _BURMESE, _MONGOLIAN, _CHEROKEE = range(19)
_SCRIPTS = 19

#: Fixed Unicode ranges (first, last) by script. Letters outside them are ``_LETTER``, all else is ``_OTHER``.
_RANGES = (
    (0x41, 0x2FF, _LATIN), (0x370, 0x3FF, _GREEK), (0x400, 0x52F, _CYRILLIC), (0x530, 0x58F, _ARMENIAN), (0x590, 0x5FF, _HEBREW), (0x600, 0x6FF, _ARABIC), (0x750, 0x77F, _ARABIC), (0x870, 0x8FF, _ARABIC),
    (0x900, 0xDFF, _INDIC), (0xE00, 0xFFF, _SOUTHEAST), (0x1000, 0x109F, _BURMESE), (0x10A0, 0x10FF, _GEORGIAN), (0x1100, 0x11FF, _HANGUL), (0x1200, 0x139F, _ETHIOPIC), (0x13A0, 0x13FF, _CHEROKEE),
    (0x1780, 0x17FF, _KHMER), (0x1800, 0x18AF, _MONGOLIAN), (0x1C80, 0x1C8F, _CYRILLIC), (0x1C90, 0x1CBF, _GEORGIAN), (0x1D00, 0x1DBF, _LATIN), (0x1E00, 0x1EFF, _LATIN), (0x1F00, 0x1FFF, _GREEK), (0x2070, 0x214F, _LATIN),
    (0x2C60, 0x2C7F, _LATIN), (0x2D00, 0x2D2F, _GEORGIAN), (0x2D80, 0x2DDF, _ETHIOPIC), (0x2DE0, 0x2DFF, _CYRILLIC), (0x3005, 0x3007, _HAN), (0x3040, 0x30FF, _KANA), (0x3130, 0x318F, _HANGUL), (0x31F0, 0x31FF, _KANA),
    (0x3400, 0x9FFF, _HAN), (0xA640, 0xA69F, _CYRILLIC), (0xA720, 0xA7FF, _LATIN), (0xA960, 0xA97F, _HANGUL), (0xA9E0, 0xA9FF, _BURMESE), (0xAA60, 0xAA7F, _BURMESE), (0xAB00, 0xAB2F, _ETHIOPIC), (0xAB30, 0xAB6F, _LATIN),
    (0xAB70, 0xABBF, _CHEROKEE), (0xAC00, 0xD7FF, _HANGUL), (0xF900, 0xFAFF, _HAN), (0xFB00, 0xFB06, _LATIN), (0xFB13, 0xFB17, _ARMENIAN), (0xFB1D, 0xFB4F, _HEBREW), (0xFB50, 0xFDFF, _ARABIC), (0xFE70, 0xFEFC, _ARABIC),
    (0xFF21, 0xFF5A, _LATIN), (0xFF66, 0xFF9F, _KANA), (0xFFA0, 0xFFDC, _HANGUL), (0x20000, 0x323AF, _HAN),
)
_LAST_LETTER = 0x33FFF


@cache
def _script_table() -> np.ndarray:
    """Script of each code point up to ``_LAST_LETTER``, ``_OTHER`` for those that aren't letters."""
    out = np.full(_LAST_LETTER + 1, _LETTER, np.uint8)
    for lo, hi, script in _RANGES:
        out[lo : hi + 1] = script
    out[[unicodedata.category(chr(c))[0] != "L" for c in range(_LAST_LETTER + 1)]] = _OTHER
    return out


def _scripts(data: np.ndarray) -> np.ndarray:
    """Script of each byte that begins a letter, else 0."""
    table = _script_table()
    out = np.where(data < 0x80, table[data & 0x7F], np.uint8(_OTHER))
    at = np.flatnonzero(data >= 0xC2)
    if len(at):
        pad = np.append(data, np.zeros(3, np.uint8))
        b = [pad[at + k].astype(np.int32) & 0x3F for k in range(4)]
        lead = data[at]
        two = (b[0] & 0x1F) << 6 | b[1]
        three = (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]
        four = (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]
        out[at] = table[np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), _LAST_LETTER)]
    return out


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte; separators and the ends of a text count as one symbol."""
    x = LOWER[data].astype(np.uint32)
    x[IS_SPACE[data]] = 32
    left, right = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    left[1:], right[:-1] = x[:-1], x[1:]
    some = offsets[:-1] < offsets[1:]
    left[offsets[:-1][some]] = 32
    right[offsets[1:][some] - 1] = 32
    code = left * np.uint32(0x9E3779B1) + x * np.uint32(0x85EBCA6B) + right * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int32)


def _learn(langs: list[str]):
    index = {x: k for k, x in enumerate(langs)}

    def run(batches):
        grams = np.zeros(len(langs) * BUCKETS, np.int64)
        scripts = np.zeros(len(langs) * _SCRIPTS, np.int64)
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for i, j in slices(off):
                data, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                at = np.repeat(lang[i:j], np.diff(o))
                code = (at * BUCKETS + _trigrams(data, o))[~IS_SPACE[data]]
                if len(grams) <= 1 << 20:
                    grams += np.bincount(code, minlength=len(grams))
                else:
                    some, n = np.unique(code, return_counts=True)
                    grams[some] += n
                scripts += np.bincount(at * _SCRIPTS + _scripts(data), minlength=len(scripts))
        both = np.concatenate([grams, scripts])
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[some])], names=["feature", "n"])

    return run


def fit(train: DataFrame, languages: int | None = None) -> dict:
    """Model of ``train(text, lang)``; its size goes with the number of languages: all, or the ``languages`` most frequent."""
    counts = train.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    langs = sorted(r[0] for r in (counts if languages is None else counts.limit(languages)).collect())
    both = np.zeros(len(langs) * (BUCKETS + _SCRIPTS), np.float32)
    if langs:
        for k, n in train.where(F.col("lang").isin(langs)).mapInArrow(_learn(langs), "feature long, n long").groupBy("feature").agg(F.sum("n")).toLocalIterator():
            both[k] = n
    grams = both[: len(langs) * BUCKETS].reshape(len(langs), BUCKETS)
    scripts = both[len(langs) * BUCKETS :].reshape(len(langs), _SCRIPTS)
    log_p = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    letters = scripts.copy()
    letters[:, _OTHER] = 0
    usable = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    usable[:, ~usable.any(axis=0)] = True
    return {"langs": langs, "log_p": log_p.astype(np.float32), "usable": usable}


def _dominant(script: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The script of most letters of each word; ``bounds`` has the begin and end of each."""
    most = np.maximum.reduceat(script, bounds)[::2]
    least = np.minimum.reduceat(np.where(script > 0, script, 255), bounds)[::2]
    out = most.astype(np.int64)
    for k in np.flatnonzero((least < most) & (most > 0)):
        lo, hi = bounds[2 * k], bounds[2 * k + 1] if 2 * k + 1 < len(bounds) else len(script)
        count = np.bincount(script[lo:hi], minlength=_SCRIPTS)
        count[_OTHER] = 0
        out[k] = count.argmax()
    return out


def _word_scores(model: dict, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised log scores, letters) of each word."""
    code, script = _trigrams(data, offsets), _scripts(data)
    bounds = np.stack([start, end], axis=1).ravel()
    if bounds[-1] == len(data):
        bounds = bounds[:-1]
    letters = np.add.reduceat((script > 0).astype(np.int32), bounds)[::2]
    usable = model["usable"].T[_dominant(script, bounds)]
    score = np.full((len(start), len(model["langs"])), -1e9, np.float32)
    for k in np.flatnonzero(usable.any(axis=0)):
        score[:, k] = np.where(usable[:, k], np.add.reduceat(model["log_p"][k][code], bounds)[::2], np.float32(-1e9))
    score -= score.max(axis=1, keepdims=True)
    score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
    np.maximum(score, FLOOR, out=score)
    score[letters == 0] = 0
    return score, letters


def _step(best: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Let the states of each row change to its best one; returns that one, and which states change."""
    top = best.argmax(axis=1)
    other = best[np.arange(len(best)), top] - np.float32(penalty)
    change = best < other[:, None]
    np.maximum(best, other[:, None], out=best)
    return top.astype(np.int16), change


def _viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; sequences begin at ``first`` (with the end appended).

    All sequences take their steps together, longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
    label = np.zeros(len(score), np.int16)
    best = np.zeros((len(size), score.shape[1]), np.float32)
    came, switch = [], []
    for t in range(steps):
        n = active[t]
        b = best[:n]
        if t:
            top, change = _step(b, penalty)
            came.append(top)
            switch.append(change)
        b += score[begin[:n] + t]
        if t % 256 == 0:
            best -= best.max(axis=1, keepdims=True)  # keeps the sums small
    at = np.zeros(len(size), np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        done = active[t + 1] if t + 1 < steps else 0
        at[done:n] = best[done:n].argmax(axis=1)
        if done:
            here = np.arange(done)
            moved = switch[t][here, at[:done]]
            at[:done] = np.where(moved, came[t], at[:done])
        label[begin[:n] + t] = at[:n]
    return label


def _viterbi_parts(scores, penalty: float) -> np.ndarray:
    """Labels of one sequence whose scores come part by part, as :func:`_viterbi` gives them."""
    best, kept, t = None, [], 0
    for score in scores:
        came, switch = np.zeros(len(score), np.int16), np.zeros(score.shape, bool)
        for i, row in enumerate(score):
            if best is None:
                best = np.zeros((1, len(row)), np.float32)
            else:
                top, change = _step(best, penalty)
                came[i], switch[i] = top[0], change[0]
            best += row
            if t % 256 == 0:
                best -= best.max(axis=1, keepdims=True)
            t += 1
        kept.append((came, np.packbits(switch, axis=1)))
    out, at = [], int(best.argmax()) if t else 0
    for came, packed in reversed(kept):
        switch, label = np.unpackbits(packed, axis=1), np.zeros(len(came), np.int16)
        for i in range(len(came) - 1, -1, -1):
            label[i] = at
            at = int(came[i]) if switch[i, at] else at
        out.append(label)
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.int16)


def _parts(data: np.ndarray, limit: int):
    """A text in parts of about ``limit`` bytes that end with white space."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data):
            blank = np.flatnonzero(IS_SPACE[data[end : end + limit]])
            end += int(blank[0]) + 1 if len(blank) else min(limit, len(data) - end)
            if len(blank):
                break
        yield data[at:end]
        at = end


def _labels(model: dict, data: np.ndarray, o: np.ndarray, penalty: float, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, letters, row) of the words of a slice; a text above ``limit`` bytes is a slice of its own."""
    if len(data) <= limit:
        start, end, row = words(data, o)
        if not len(start):
            return np.zeros(0, np.int16), np.zeros(0, np.int32), row
        score, letters = _word_scores(model, data, o, start, end)
        first = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        return _viterbi(score, first, penalty), letters, row
    all_letters = []

    def scores():
        for part in _parts(data, limit):
            own = np.array([0, len(part)])
            start, end, _ = words(part, own)
            if len(start):
                score, letters = _word_scores(model, part, own, start, end)
                all_letters.append(letters)
                yield score

    label = _viterbi_parts(scores(), penalty)
    return label, np.concatenate(all_letters) if all_letters else np.zeros(0, np.int32), np.zeros(len(label), np.int64)


def _predict(model, penalty: float, with_spans: bool, scores: int):
    def run(batches):
        m = model.value
        langs = np.array(m["langs"], object)
        limit = max(1, scores // max(len(langs), 1))
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            n = len(off) - 1
            lang, share, spans = np.full(n, "und", object), np.zeros(n), [[] for _ in range(n)]
            has_letter = batch.column("has_letter").to_numpy(zero_copy_only=False)
            for i, j in slices(off, limit) if len(langs) else ():
                label, letter, row = _labels(m, raw[off[i] : off[j]], off[i : j + 1] - off[i], penalty, limit)
                if not len(label):
                    continue
                count = np.bincount(row * len(langs) + label, weights=letter, minlength=(j - i) * len(langs)).reshape(j - i, len(langs))
                some = np.flatnonzero(has_letter[i:j])
                lang[i + some] = langs[count[some].argmax(axis=1)]
                share[i + some] = count[some].max(axis=1) / np.maximum(count[some].sum(axis=1), 1)
                if with_spans:
                    new = np.ones(len(row), bool)
                    new[1:] = row[1:] != row[:-1]
                    head = np.flatnonzero(new)
                    place = np.arange(len(row)) - head[np.cumsum(new) - 1]
                    new[1:] |= label[1:] != label[:-1]
                    cut = np.flatnonzero(new)
                    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(row)]):
                        spans[i + row[s]].append({"lang": langs[label[s]], "first_word": int(place[s]), "words": e - s})
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(share)]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def identify(docs: DataFrame, penalty: float = PENALTY, with_spans: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slice_scores: int = _SCORES, languages: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and its spans of words.

    Learns from the documents with a language whose id is outside fold 0 of 5.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("not held_out and lang is not null").select("text", "lang"), languages))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double" + ", spans array<struct<lang:string,first_word:long,words:long>>" * with_spans
    return rows.select("doc_id", "held_out", "text", F.col("text").rlike(r"\p{L}").alias("has_letter")).mapInArrow(_predict(model, penalty, with_spans, slice_scores), schema)
