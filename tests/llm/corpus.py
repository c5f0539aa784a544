"""Small corpora with copies, edits, shared passages and odd rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, node string, anchor int, spans string"


def words(rng: random.Random, n: int) -> str:
    parts = ["th", "er", "on", "an", "re", "ed", "in", "es", "ou", "ti", "ha", "en"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed: int = 1, n: int = 40) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [words(rng, rng.randint(1, 160)) for _ in range(n)]
    passage = words(rng, 60)
    for i in range(0, 12, 2):
        out[i] = f"{words(rng, 20)} {passage} {words(rng, 20)}"
    base = words(rng, 120)
    for _ in range(6):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [out[20], out[20], out[21].upper(), "ab" * 400, "x" * 199, "y" * 200, "y" * 200, "Of " * 120, None, None, "", " \n\t", "one two", "ONE two", "é😀 ß " * 80]
    return out


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """Rows of ``SCHEMA``: nulls in each column, a repeated row, and columns whose names clash."""
    out = [(i, t, ("en", "de", None)[i % 3], (f"src{i % 4}" if i % 5 else None), len(t or ""), "r", "n", 1, "s") for i, t in enumerate(texts(seed, n))]
    return [*out, out[3], (None, out[5][1], None, None, None, None, None, None, None)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def null_last(row) -> tuple:
    return tuple((x is None, x if x is not None else 0) for x in row)
