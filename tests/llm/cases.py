"""Texts and tables that every operator must stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("spans string, score double, n long, bands string, kept boolean, anchors string, node long, "
         "`half` int, vslot int, hits string, items string, ids string, stats string, size long, blob string")
LONG = "word " * 30_000 + "x" * 20_000


def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    texts = [None, "", " ", "\n\t ", "a", "same text of a few words here", "same text of a few words here", LONG, LONG,
             "Ünïcode 日本語 😀 x", "a\x00b", "'s 're ''ll  don't", "x" * 5000]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], rows[7], (None, "no id here at all, none", None, None, None),
                   (None, None, None, None, None)]


def clashing(df):
    """The same table with more columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    extra = [c.strip().split(" ")[0].strip("`") for c in CLASH.split(",")]
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
