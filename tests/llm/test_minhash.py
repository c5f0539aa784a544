from __future__ import annotations

import itertools
import random
import re

from colloquy.llm._components import connected_components
from colloquy.llm.minhash import drop_near_duplicates, near_duplicates

from .corpus import SCHEMA, frame, null_last, rows, words


def brute(pairs, n=5, threshold=75):
    sets = []
    for _, t in pairs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    ids = [p[0] for p in pairs]
    least = {r: min((ids[k] for k in range(len(sets)) if find(k) == r), key=lambda z: (z is None, z)) for r in {find(k) for k in range(len(sets))}}
    return [(ids[k], len(sets[k]), least[find(k)], ids[k] == least[find(k)]) for k in range(len(sets))]


def test_against_all_pairs(spark):
    got = sorted((tuple(r)[:4] for r in near_duplicates(frame(spark)).collect()), key=null_last)
    assert got == sorted(brute([r[:2] for r in rows()]), key=null_last)


def test_group_around_a_hub(spark):
    """Copies close to an original but not to each other still form one group."""
    rng = random.Random(4)
    base = words(rng, 200).split()
    data = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for place in rng.sample(range(0, 200, 8), 5):
            w[place] = f"new{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    got = sorted(tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == sorted(brute(data))
    assert {r[2] for r in got} == {0}


def test_stage_leaves_one_of_each_group(spark):
    kept = drop_near_duplicates(frame(spark))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=null_last)
    assert got == sorted({(i, t) for (i, t, *_), b in zip(rows(), brute([r[:2] for r in rows()])) if b[3]}, key=null_last)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and drop_near_duplicates(empty).collect() == []


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
