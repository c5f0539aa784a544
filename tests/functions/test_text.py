from __future__ import annotations

import random

from pyspark.sql import functions as F

from colloquy.functions import text as T


def test_pages(spark):
    html = "<html><TITLE> A  title </TITLE><script>var x = '<p>';</script><style>p{}</style><body><p>one&nbsp;&amp; two</p><br/>three<noscript>no</noscript><div>\n\n four </div>&lt;five&gt;</body>"
    page = spark.createDataFrame([(html,), ("",), ("plain",)], "h string").select(T.html_title(F.col("h")).alias("title"), T.html_text(F.col("h")).alias("text")).collect()
    assert (page[0].title, page[1].title, page[2].text) == ("A title", "", "plain")
    assert page[0].text.split("\n") == ["A title one & two", "three", "four", "<five>"]


def test_similarity(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("aB c,。é") for _ in range(rng.randint(0, 8))), "".join(rng.choice("aB c,。é") for _ in range(rng.randint(0, 8)))) for _ in range(200)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(T.set_jaccard(T.bigrams(F.col("a")), T.bigrams(F.col("b")))).collect()
    def grams(t):
        bare = [c for c in t.lower() if c not in " ,。"]
        return {"".join(bare[i : i + 2]) for i in range(len(bare) - 1)} or set(bare)

    want = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) and grams(b) else 0.0 for a, b in pairs]
    assert [round(r[0], 12) for r in got] == [round(x, 12) for x in want]


def test_token_estimate(spark):
    got = spark.createDataFrame([("你好ab",), ("",), ("abcdefgh",)], "t string").select(T.token_estimate(F.col("t"))).collect()
    assert [r[0] for r in got] == [1, 0, 2]
