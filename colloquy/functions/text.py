"""Text columns: readable text of pages, similarity, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import squeeze

def html_text(html: Column) -> Column:
    """Readable text: scripts, styles and tags removed, entities of ASCII marks undone."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|canvas)\b.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n"), r"(?s)<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    lines = F.filter(F.transform(F.split(out, "\n"), squeeze), lambda x: x != "")
    return F.array_join(lines, "\n")


def html_title(html: Column) -> Column:
    """Content of the title element."""
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


_IGNORED = r"[\s\p{Z}]+|[，。！？、；：,.!?;:]"


def bigrams(text: Column) -> Column:
    """Distinct bigrams of the lower-cased symbols without blanks and marks; a single one is its own, none gives none."""
    text = F.regexp_replace(F.lower(text), _IGNORED, "")
    n = F.length(text)
    return F.when(n < 1, F.array().cast("array<string>")).when(n < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(text, i, F.lit(2)))))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """Tokens by character class: ideographs at 1.5 to a token, others at 4."""
    han = F.regexp_count(text, F.lit(r"[一-鿿]"))
    return (han / 1.5 + (F.length(text) - han) / 4).cast("int")
