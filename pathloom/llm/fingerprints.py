"""Document fingerprints from closed syncmers.

A run of ``K`` words is an anchor if, of the ``S``-word runs inside it, one of least hash lies at its beginning or
its end. Whether it is does not depend on anything around it, so equal passages have equal anchors wherever they
stand. A text's fingerprint is all its anchors with their places, so it grows with the text; ``matched`` holds
two of them against each other position by position.

Positions match so: of each hash the i-th anchor of one text is paired with the i-th of the other; a pair counts if
its offset (place in the other text less place in the one) is that of ``AGREE`` pairs or more, or of as many as the
shorter fingerprint has. Sorting both once does that, however often an anchor repeats.

Defined results: a null text is empty and has an empty fingerprint; two empty fingerprints are alike (1), one empty
and one not are not (0); a text with words but no anchor has one anchor, all its words. Documents that share an id
follow each other by a hash of their text. Of several commonest offsets the least is given, none if no pair counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, AGREE = 5, 2, 2


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with ``out``, an array of (pos, hash) of the anchors of column ``text``, in order of place."""
    inner = k - s + 1  # s-word runs in an anchor
    hashed = df.withColumn("__w", F.transform(
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    runs = F.greatest(F.size("__w") - (s - 1), F.lit(0))
    hashed = hashed.withColumn("__s", F.transform(
        F.arrays_zip(*[F.slice("__w", F.lit(i + 1), runs).alias(f"w{i}") for i in range(s)]),
        lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(s)])))
    count = F.greatest(F.size("__s") - (inner - 1), F.lit(0))
    hashed = hashed.withColumn("__k", F.arrays_zip(
        *[F.slice("__s", F.lit(i + 1), count).alias(f"s{i}") for i in range(inner)],
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")).alias("pos")))

    def closed(x: Column) -> Column:
        least = F.least(*[x[f"s{i}"] for i in range(inner)])
        return (x["s0"] == least) | (x[f"s{inner - 1}"] == least)

    hashed = hashed.withColumn("__a", F.transform(
        F.filter("__k", closed), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(
            *[x[f"s{i}"] for i in range(inner)]).alias("hash"))))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64("__w").alias("hash")))
    return hashed.withColumn(out, F.when((F.size("__a") == 0) & (F.size("__w") > 0), whole).otherwise(F.col("__a"))) \
        .drop("__w", "__s", "__k", "__a")


def printed(anchors: Column) -> Column:
    """A fingerprint as text: place and hash (hex) of each anchor."""
    return F.array_join(F.transform(anchors, lambda a: F.concat_ws(":", a["pos"], F.lower(F.hex(a["hash"])))), ",")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _upto(n: Column) -> Column:
    """0, 1, ... below ``n``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _cuts(items: Column, key: Callable[[Column], Column]) -> Column:
    """Where in a sorted array each run of equal keys begins, and the array's size."""
    begins = F.filter(_upto(F.size(items)), lambda i: (i == 0) | (key(F.get(items, i)) != key(F.get(items, i - 1))))
    return F.concat(begins, F.array(F.size(items)))


def _offsets(both: Column, cuts: Column) -> Column:
    """Offsets of the pairs; ``both`` is sorted by hash, text and place, ``cuts`` parts it by hash and text."""
    at = lambda r: F.get(both, F.get(cuts, r))
    pairs = F.filter(_upto(F.size(cuts) - 2), lambda r: (at(r)["side"] == 0) & (at(r)["hash"] == at(r + 1)["hash"]))

    def of_run(r: Column) -> Column:
        a, b, end = F.get(cuts, r), F.get(cuts, r + 1), F.get(cuts, r + 2)
        return F.transform(F.sequence(F.lit(0), F.least(b - a, end - b) - 1),
                           lambda k: F.get(both, b + k)["pos"] - F.get(both, a + k)["pos"])

    return F.sort_array(F.flatten(F.transform(pairs, of_run)))


def matched(a: Column, b: Column, agree: int = AGREE) -> Column:
    """Two arrays of anchors held against each other: (matched, offset, likeness), where ``matched`` counts the pairs
    at consistent offsets, ``offset`` is the commonest of these and ``likeness`` the share of matched anchors."""

    def sided(anchors: Column, side: int) -> Column:
        return F.transform(anchors, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"),
                                                       x["pos"].alias("pos")))

    enough = F.least(F.lit(agree), F.size(a), F.size(b))

    def votes(offsets: Column) -> Column:
        """(-n, offset) of each consistent offset, the commonest first."""
        return _let(_cuts(offsets, lambda x: x), lambda cuts: F.sort_array(F.filter(F.transform(
            _upto(F.size(cuts) - 1), lambda r: F.struct((F.get(cuts, r) - F.get(cuts, r + 1)).alias("less"),
                                                        F.get(offsets, F.get(cuts, r)).alias("offset"))),
            lambda v: v["less"] <= -enough)))

    def result(found: Column) -> Column:
        n = F.aggregate(found, F.lit(0), lambda total, v: total - v["less"])
        all_ = F.size(a) + F.size(b) - n
        return F.struct(n.alias("matched"), F.get(found, F.lit(0))["offset"].alias("offset"),
                        F.when(all_ == 0, F.lit(1.0)).otherwise(n / all_).alias("likeness"))

    offsets = _let(F.sort_array(F.concat(sided(a, 0), sided(b, 1))), lambda both: _let(
        _cuts(both, lambda x: F.struct(x["hash"], x["side"])), lambda cuts: _offsets(both, cuts)))
    return _let(_let(offsets, votes), result)


def with_next(df: DataFrame, id_col: str, carried: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``next_<c>`` of the row that follows by id; the first follows the last.

    Rows are dealt to ranges of ids of near equal counts and ordered inside them; each range also gets the first row
    of the one after it.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)))  # rows without an id come first
    splits = df.approxQuantile(id_col, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = F.array(*[F.lit(int(x)) for x in sorted(set(splits))]).cast("array<bigint>")
    rows = df.withColumn("__key", key).withColumn("__tie", F.xxhash64(*carried)) \
        .withColumn("__part", F.size(F.filter(bounds, lambda b: b <= F.col("__key"))))
    firsts = df.select(key.alias("__key")).withColumn(
        "__part", F.size(F.filter(bounds, lambda b: b <= F.col("__key")))) \
        .groupBy("__part").agg(F.min("__key").alias("__key")).orderBy("__part").collect()  # one row per range
    if not firsts:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    follows = ",".join(f"(CAST({b['__key']} AS BIGINT), {a['__part']}, {str(i + 1 == len(firsts)).lower()})"
                       if b["__key"] > -(1 << 63) else
                       f"(CAST('{b['__key']}' AS BIGINT), {a['__part']}, {str(i + 1 == len(firsts)).lower()})"
                       for i, (a, b) in enumerate(zip(firsts, [*firsts[1:], firsts[0]])))
    seams = spark.sql(f"SELECT * FROM VALUES {follows} AS s(__key, __to, __wraps)")
    guests = rows.join(F.broadcast(seams), "__key").select(  # at most one seam per range
        *[F.col(f"`{c}`") for c in df.columns], "__key", "__tie", F.col("__to").alias("__part"),
        F.col("__wraps").alias("__last"), F.lit(True).alias("__guest"))
    own = rows.select(*[F.col(f"`{c}`") for c in df.columns], "__key", "__tie", "__part",
                      F.lit(False).alias("__last"), F.lit(False).alias("__guest"))
    order = Window.partitionBy("__part").orderBy("__last", "__key", "__tie")
    return (own.unionByName(guests).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
            .where(~F.col("__guest")).drop("__key", "__tie", "__part", "__last", "__guest"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Anchors of each text and of its edited text, both as text too, and how they match those of the edited text and of
    the next document by place (``placed_``); ``near_`` is the likeness of that."""
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = with_next(rows, id_col, ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"),
                      F.expr("substring(next_text, 1, int(floor(char_length(text) / 2)))"))
    both = both.select(id_col, "text", "next_text", n.cast("long").alias("n_chars"), half.alias("half"),
                       edited.alias("edited"))
    # anchors are longer than their text, so those of the next text are computed again rather than dealt with it
    for text, out in (("text", "anchors"), ("edited", "edited_anchors"), ("next_text", "next_anchors")):
        both = with_anchors(both, text, out)
    both = both.select(id_col, "n_chars", "edited", "anchors", "edited_anchors",
                       matched(F.col("anchors"), F.col("edited_anchors")).alias("placed_edited"),
                       matched(F.col("anchors"), F.col("next_anchors")).alias("placed_next"))
    return both.select(id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       printed(F.col("anchors")).alias("fingerprint"),
                       printed(F.col("edited_anchors")).alias("edited_fingerprint"),
                       F.col("placed_edited.likeness").alias("near_edited"),
                       F.col("placed_next.likeness").alias("near_next"),
                       "anchors", "edited_anchors", "placed_edited", "placed_next")
