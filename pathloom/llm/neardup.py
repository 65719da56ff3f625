"""Near-duplicate groups: MinHash minima with banding, verification, and connected components.

Each text is the set of its distinct word shingles, as 64-bit hashes. ``HASHES`` universal hash functions give its
minima; all of them go into bands, each as wide as a miss of ``MISSED`` at the threshold allows: 48 bands of eight at 0.85
(missed 2e-7; a pair at 0.3 shares one with 0.3 %), 64 bands of six at 0.8 (4e-9; 4.6 %). Texts of equal sets are one
class, linked at once; only class representatives go on.

Which pairs of a bucket are verified: every member against the least of the bucket and against its two predecessors
in a slice of the bucket of bounded size. That connects groups of copies without naming all their pairs. Buckets
whose members are still in different components are then searched in full: members outside the bucket's largest
component against all its members, in blocks of bounded size. Candidates must agree in size and in signature (2 bits
of each minimum, at a margin of ``MARGIN`` standard deviations), and a link counts only once the full sets confirm it.
The candidates of the full search are confirmed in cells, some ``CELL`` texts of one component against some ``CELL``
texts near it: a text goes once to each of its cells, not once to each of its pairs.

Components come from alternating large-star and small-star steps until no edge changes. Intermediates are written to
the shared folder.

Defined results: fewer words than a shingle has make one shingle; null and wordless texts have no shingles and are
linked with nothing; rows that share an id are one document with the links of all of them; rows without an id are
linked with nothing and kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import map_texts, parts, staged
from pathloom.llm.words import U64, UNSPACED, Words, mixed

HASHES = 384
FIRST = 128  # minima compared before the rest
MISSED = 1e-6  # probability with which a pair at the threshold may share no band
MARGIN = 4.5
SLICE, BLOCK, QUERY = 512, 512, 2048  # members of a bucket compared together
PACK = 4096  # members of small buckets that share a call
CELL, CALL = 64, 256  # texts on each side of a cell; texts whose cells share a call
SIEVE = 1 << 18  # words of the filter that says which texts are moved at all

_RNG = np.random.default_rng(771)
_MULTIPLY = _RNG.integers(0, 2**64, HASHES, dtype=U64) | U64(1)
_ADD = _RNG.integers(0, 2**64, HASHES, dtype=U64)
_BAND = _RNG.integers(0, 2**64, HASHES, dtype=U64) | U64(1)
_PLACE = _RNG.integers(0, 2**64, 64, dtype=U64) | U64(1)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked from ``percent`` per cent of the union on."""

    words: int = 5
    percent: int = 80

    def band_rows(self) -> int:
        """Minima in a band: as many as the probability of a miss allows."""
        s = self.percent / 100
        fits = [r for r in range(1, 33) if HASHES % r == 0 and (1 - s**r) ** (HASHES // r) <= MISSED]
        return max(fits, default=1)

    def least_equal(self, hashes: int) -> int:
        """Of so many pairs of signature bits, how many a similar pair has in common, but for ``MARGIN`` deviations. Different
        minima agree in two bits one time in four."""
        s = self.percent / 100
        s += (1 - s) / 4
        return int(hashes * max(0.0, s - MARGIN * (s * (1 - s) / hashes) ** 0.5))


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow string array."""
    words = Words(texts, UNSPACED)
    sums = np.zeros(max(0, len(words.hash) - width + 1), U64)
    for j in range(width):
        sums += words.hash[j:j + len(sums)] * _PLACE[j]
    sums = mixed(sums)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(sums[a:b - width + 1]))
        elif b > a:
            sets.append(mixed((words.hash[a:b] * _PLACE[:b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of a set under each hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(shingles), 512):  # in parts that stay in the processor's cache
        least = np.minimum(least, (shingles[at:at + 512, None] * _MULTIPLY + _ADD).min(axis=0))
    return least >> U64(32)


def packed(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, four minima a byte."""
    low = (minima & U64(3)).astype(np.uint8).reshape(len(minima), -1, 4)
    return low[:, :, 0] | low[:, :, 1] << 2 | low[:, :, 2] << 4 | low[:, :, 3] << 6


def unpacked(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(signatures), U64).reshape(-1, HASHES // 32)


def in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their pairs of bits two signatures, or rows of them, have in common."""
    differ = a ^ b
    differ = (differ | differ >> U64(1)) & U64(0x5555555555555555)
    return differ.shape[-1] * 32 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def signed(docs: DataFrame, rule: Rule, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """Size and identity of each text's set, its band keys and its signature bytes."""

    def make():
        import pyarrow as pa

        def run(texts):
            sets = shingle_sets(texts, rule.words)
            some = np.array([len(s) > 0 for s in sets])
            minima = np.stack([signature(s) for s in sets]) if len(sets) else np.zeros((0, HASHES), U64)
            bands = HASHES // rule.band_rows()
            keys = mixed((minima * _BAND).reshape(-1, bands, HASHES // bands).sum(axis=2, dtype=U64)
                         + np.arange(bands, dtype=U64)).view(np.int64)
            low = packed(minima)
            one = np.array([s.sum(dtype=U64) for s in sets], U64).view(np.int64)
            two = np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], U64).view(np.int64)
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two),
                    pa.array([k if f else [] for k, f in zip(keys, some)], pa.list_(pa.int64())),
                    pa.array([b.tobytes() for b in low], pa.binary())]

        return run

    return map_texts(docs, text_col, "n long, ka long, kb long, bands array<long>, sig binary", make, keep)


def resembling(pairs: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    one = known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b").where(
        100 * F.least("na", "nb") >= rule.percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sa, sb = (unpacked(batch.column(i).to_pylist()) for i in (2, 3))
            mask = pa.array(in_common(sa, sb) >= rule.least_equal(HASHES))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows whose ``node`` is in ``ids`` and a few others, without moving any.

    Every task gets a Bloom filter: three bits an id in one of so many 64-bit words, four ids a word and ``SIEVE`` words at
    most. More ids let more others pass.
    """
    words = min(SIEVE, 1 + ids.count() // 4)

    def place(salt: str, n: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(n))

    bits = reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), place(f"bit{i}", 64).cast("int"))
                                     for i in range(3)])
    sieve = ids.groupBy(place("word", words).alias("word")).agg(F.bit_or(bits).alias("filled"))
    met = rows.join(F.broadcast(sieve), place("word", words) == F.col("word"))
    return met.where(F.col("filled").bitwiseAND(bits) == bits).select(*rows.columns)


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the documents in ``ids`` (node, each once), equal texts of one id once; written to the shared folder."""
    ids = staged(ids, "dup_ids")
    # no semi join, which the optimiser would do before the sieve
    texts = sieved(docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")), ids).join(ids, "node")
    return staged(texts.groupBy("node", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
                  .select("node", "text"), "dup_texts")


def similar(s: np.ndarray, t: np.ndarray, rule: Rule) -> bool:
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return len(s) > 0 and 100 * shared >= rule.percent * (len(s) + len(t) - shared)


def confirmed(pairs: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Pairs whose full sets are similar. Only texts of candidates move, and only once by their own id."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(ids, docs, id_col, text_col)
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                keep = [similar(s, t, rule)
                        for s, t in zip(*(shingle_sets(part.column(i), rule.words) for i in (2, 3)))]
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)],
                                                 names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def confirmed_in_cells(cells: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Pairs whose full sets are similar among the candidates of ``cells`` (as ``unsettled`` returns them)."""
    packs = 1 + (cells.agg(F.sum(F.size("nodes"))).first()[0] or 0) // CALL
    cells = cells.withColumn("pack", F.pmod(F.xxhash64("component", "cell", "part"), F.lit(packs)))
    wanted = cells.select("pack", F.explode("nodes").alias("node")).distinct()
    texts = texts_of(wanted.select("node").distinct(), docs, id_col, text_col)

    def run(asked, held):
        import pyarrow as pa

        sets: dict[int, list[np.ndarray]] = {}
        for batch in held.select(["node", "text"]).to_batches():
            for part in parts(batch):
                for node, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), rule.words)):
                    sets.setdefault(node, []).append(s)
        pairs = {pair for row in asked.column("asks").to_pylist() for lists in row
                 for pair in zip(lists["left"], lists["right"])}  # several buckets may name a pair
        links = [(a, b) for a, b in pairs if any(similar(s, t, rule) for s in sets[a] for t in sets[b])]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()),
                         "b": pa.array([b for _, b in links], pa.int64())})

    held = wanted.join(texts, "node").select("pack", "node", "text").toDF("pack", "node", "text")
    return cells.select("pack", "asks").groupBy("pack").cogroup(held.groupBy("pack")).applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node reachable, by large-star and small-star."""
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
                   .distinct(), "stars")
    state = None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
    raise RuntimeError(f"components did not settle in {limit} rounds")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``."""
    sets = staged(signed(docs, rule, (id_col,), text_col).withColumnRenamed(id_col, "node"), "dup_sets")
    some = sets.where("n > 0 AND node IS NOT NULL")
    key = ["ka", "kb", "n"]
    classes = staged(some.groupBy(*key).agg(F.min("node").alias("node"), F.first("bands").alias("bands"),
                                            F.first("sig").alias("sig")), "dup_classes")
    known = classes.select("node", "n", "sig")
    # dealt out by band once, for the sizes of the buckets and for the join with them
    members = classes.select("node", F.explode("bands").alias("band")).repartition("band")
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")) \
        .where("size > 1")
    members = staged(members.join(buckets, "band"), "dup_members")

    # every member against the least of its bucket and two predecessors in its slice
    sliced = Window.partitionBy("band", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SLICE))).orderBy("node")
    near = members.select("node", "least", F.lag("node", 1).over(sliced).alias("one"),
                          F.lag("node", 2).over(sliced).alias("two")) \
        .select("node", F.explode(F.array_distinct(F.array("least", "one", "two"))).alias("other"))
    pairs = near.where("other IS NOT NULL AND other != node") \
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    tried = staged(resembling(pairs, known, rule), "dup_tried")
    # rows with one id but different texts are one document: their classes are linked through it
    held = some.join(classes.select(*key, F.col("node").alias("rep")), key).select("node", "rep").distinct()
    several = held.groupBy("node").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    shared = staged(held.join(several, "node", "left_semi").select(F.col("rep").alias("a"), F.col("node").alias("b")),
                    "dup_shared")
    links = staged(confirmed(tried, docs, rule, id_col, text_col), "dup_links")
    root = components(links.unionByName(shared))

    cells = staged(unsettled(members, known, root, rule), "dup_cells")
    if not cells.isEmpty():
        fresh = confirmed_in_cells(cells, docs, rule, id_col, text_col)
        root = components(root.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh))
    rep = sets.join(classes.select(*key, F.col("node").alias("rep")), key, "left")
    named = rep.join(root.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep", "node")).otherwise(F.col("node"))
    return named.select(F.col("node").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")) \
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def unsettled(members: DataFrame, known: DataFrame, root: DataFrame, rule: Rule) -> DataFrame:
    """Candidates across components inside a bucket, one row per cell: lists of pairs, and all texts of the cell.

    A component is dealt into cells by its size, the texts that ask about it into parts by their number."""
    widths = root.groupBy("component").agg(F.ceil((F.count(F.lit(1)) + 1) / CELL).alias("cells"))
    place = F.pmod(F.xxhash64("node", F.lit("cell")), F.coalesce("cells", F.lit(1)))
    of = root.join(widths, "component").select("node", "component", place.alias("cell")).unionByName(
        widths.select(F.col("component").alias("node"), "component", "cells")
        .select("node", "component", place.alias("cell")))
    at = members.select("band", "node").join(of, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component"),
        F.coalesce("cell", F.lit(0)).alias("cell"))
    sizes = at.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    split = sizes.groupBy("band").agg(F.max(F.struct("k", "component"))["component"].alias("main"),
                                      F.sum("k").alias("size"), F.count(F.lit(1)).alias("parts"),
                                      F.max("k").alias("most")).where("parts > 1")
    rows = at.join(split, "band").join(known, "node").select(
        "band", "node", "component", "cell", "n", "sig", "main",
        F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("size") - F.col("most")) / QUERY).cast("int").alias("queries"))
    outside = rows.where("component != main").groupBy("main").agg(
        F.ceil(F.countDistinct("node") / CELL).alias("parts"))
    rows = rows.join(outside, "main").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    query = F.pmod(F.xxhash64("node", F.lit("query")), F.col("queries")).cast("int")
    asked = rows.where("component != main").select(
        "band", query.alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), "node", "component",
        "cell", "part", "n", "sig", "main", "blocks", "queries", F.lit(True).alias("asks"))
    held = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("q"), block.alias("p"),
                       "node", "component", "cell", "part", "n", "sig", "main", "blocks",
                       "queries", F.lit(False).alias("asks"))

    def compare(pdf):
        asks = pdf["asks"].to_numpy()
        if asks.all() or not asks.any():
            return np.zeros((0, 5), np.int64)
        (na, ca, sa, wa), (nb, cb, sb, wb) = (
            (side["n"].to_numpy(), side["component"].to_numpy(), unpacked(list(side["sig"])), side["node"].to_numpy())
            for side in (pdf[asks], pdf[~asks]))
        first = np.ascontiguousarray(sb[:, :FIRST // 32])
        main, cell, part = pdf["main"].iloc[0], pdf["cell"].to_numpy()[~asks], pdf["part"].to_numpy()[asks]
        out = [np.zeros((0, 5), np.int64)]
        for at in range(0, len(na), 64):
            some = slice(at, at + 64)
            n, c = na[some, None], ca[some, None]
            # of two texts outside the largest component, one asks the other
            fits = ((cb == main) | (c < cb)) & (cb != c) & (100 * np.minimum(nb, n) >= rule.percent * np.maximum(nb, n))
            if not fits.any():
                continue
            equal = in_common(first[None], sa[some, None, :FIRST // 32])
            i, j = np.nonzero(fits & (equal >= rule.least_equal(FIRST)))
            good = in_common(sa[at + i], sb[j]) >= rule.least_equal(HASHES)
            i, j = i[good], j[good]
            out.append(np.stack([cb[j], cell[j], part[at + i], wa[at + i], wb[j]], axis=1))
        return np.concatenate(out)

    def compare_all(table):
        import pyarrow as pa

        pdf = table.to_pandas()
        rows = np.concatenate([compare(group) for _, group in pdf.groupby(["band", "q", "p"], sort=False)])
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        rows = rows[new]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        begin = np.flatnonzero(new)
        ends = pa.array(np.append(begin, len(rows)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(rows[:, i])) for i in (3, 4)]
        return pa.table([*(pa.array(rows[begin, i]) for i in range(3)), *lists],
                        names=["component", "cell", "part", "left", "right"])

    # most buckets are small: packs of about PACK rows share one call, blocks of large ones have their own
    packs = 1 + members.count() // PACK
    alone = (F.col("blocks") > 1) | (F.col("queries") > 1)
    pack = F.when(alone, F.xxhash64("band", "q", "p")).otherwise(F.pmod(F.xxhash64("band"), F.lit(packs)))
    found = asked.unionByName(held).groupBy(pack.alias("pack")).applyInArrow(
        compare_all, "component long, cell long, part long, left array<long>, right array<long>")
    return found.groupBy("component", "cell", "part").agg(
        F.collect_list(F.struct("left", "right")).alias("asks"),
        F.array_distinct(F.flatten(F.collect_list(F.concat("left", "right")))).alias("nodes"))
