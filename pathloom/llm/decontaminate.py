"""Benchmark decontamination with an FM-index per shard of training text.

Words outside the benchmark's vocabulary cannot be part of a match, so a shard (one Arrow batch of documents) keeps
its runs of known words that are long enough for some window, as one sequence of word ids with a separator after each
run. The FM-index over it is a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and the suffix
positions sampled at run beginnings and at every ``SAMPLE``-th place. All distinct windows of the benchmark are
searched backwards together through rank queries; rows of a match walk to the next sampled suffix for their place.
Matched words are compared with the window's words, byte by byte, and overlapping matches merge into removal spans.

A benchmark is searched in blocks of at most ``BLOCK_BYTES`` of text, so what a task holds is bounded.

Defined results: null and wordless texts have no words and no matches; items without words match nothing; repeated
items count once per item_id; rows of documents come back one for one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import map_texts, staged
from pathloom.llm.words import LETTERS, Words

WINDOW, SAMPLE, BLOCK_BYTES = 13, 16, 32 << 20


class Wavelet:
    """Rank queries over a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low


class FMIndex:
    """Over a sequence of symbols 1..top with the separator 0 at the end of every run."""

    def __init__(self, seq: np.ndarray, top: int):
        n = len(seq)
        stops = seq == 0
        runs = int(stops.sum())
        rank = np.where(stops, np.cumsum(stops) - 1, seq + runs - 1)  # separators differ: no suffix looks past its run
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (n + top + 2) + after
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            step *= 2
            if fresh[-1] == n - 1 or step >= n:
                break
        self.bwt = seq[order - 1]
        self.wavelet = Wavelet(self.bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        sampled = (order % SAMPLE == 0) | (seq[order - 1] == 0)
        self.sampled, self.position = sampled, order[sampled]
        self.nth = np.cumsum(sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase, all of one length."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            high[live] = np.maximum(high[live], low[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each row's suffix."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            there = self.sampled[rows[live]]
            done = live[there]
            out[done] = self.position[self.nth[rows[done]]] + steps[done]
            live = live[~there]
            symbol = self.bwt[rows[live]]
            rows[live] = self.before[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
        return out


class Phrases:
    """The windows of some benchmark items: distinct phrases by length, and the items each belongs to."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        import pyarrow as pa

        words = Words(pa.array([t for _, t in items], pa.string()), LETTERS)
        self.vocabulary, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
        raw = words.data.tobytes()
        self.spelled = [raw[words.begin[i]:words.end[i]] for i in first]
        if any(self.spelled[k] != raw[a:b] for k, a, b in zip(ids, words.begin, words.end)):
            raise ValueError("two words of the benchmark share a 64-bit hash")
        found: dict[tuple[int, ...], set[str]] = {}
        for i, (item, _) in enumerate(items):
            seq = (ids[words.first[i]:words.first[i + 1]] + 1).tolist()
            size = min(window, len(seq))
            for a in range(len(seq) - size + 1 if seq else 0):
                owners = found.setdefault(tuple(seq[a:a + size]), set())
                if item is not None:  # an item without a name makes hits and is not listed
                    owners.add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(p) for p in found}):
            chosen = [p for p in found if len(p) == size]
            self.by_length[size] = np.array(chosen, np.int64), [sorted(found[p]) for p in chosen]
        self.least = min(self.by_length, default=0)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """First word and length of every match, and the items of its phrase."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if not self.by_length or not len(words.hash):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words.hash
        edge = np.ones(len(known), bool)  # a run begins after a foreign word or with a document
        edge[1:] = (words.doc[1:] != words.doc[:-1]) | ~known[:-1]
        run = np.cumsum(edge) - 1
        kept = np.flatnonzero(known & (np.bincount(run, weights=known)[run] >= self.least))
        if not len(kept):
            return none
        ordinal = np.cumsum(np.concatenate([[0], run[kept][1:] != run[kept][:-1]]))
        place = np.arange(len(kept)) + ordinal
        seq = np.zeros(place[-1] + 2, np.int64)
        seq[place] = at[kept] + 1
        word_of = np.zeros(len(seq), np.int64)
        word_of[place] = kept
        index = FMIndex(seq, len(self.vocabulary))
        raw = words.data
        starts, sizes, items = [], [], []
        for size, (phrases, owners) in self.by_length.items():
            low, high = index.search(phrases)
            count = high - low
            which = np.repeat(np.arange(len(phrases)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            for p, w in zip(word_of[index.locate(rows)].tolist(), which.tolist()):
                if all(raw[words.begin[p + j]:words.end[p + j]].tobytes() == self.spelled[s - 1]
                       for j, s in enumerate(phrases[w])):
                    starts.append(p)
                    sizes.append(size)
                    items.append(owners[w])
        return np.array(starts, np.int64), np.array(sizes, np.int64), items


FIELDS = "n_words long, hits array<struct<word:int,start:int,end:int>>, items array<string>"


def _searched(docs: DataFrame, items: list[tuple[str, str]], text_col: str, keep: tuple[str, ...],
              window: int) -> DataFrame:
    """Hit words (index, code points) and items of each text, for one block of the benchmark."""

    def make():
        import pyarrow as pa

        phrases = Phrases(items, window)
        hit = pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

        def run(texts):
            words = Words(texts, LETTERS)
            starts, sizes, owners = phrases.matches(words)
            cover = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + sizes, -1)
            hits = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)]) if len(hits) else np.zeros(1)
            doc = words.doc[hits]
            origin = chars[words.edges[doc]] if len(hits) else np.zeros(0, np.int64)
            columns = (hits - words.first[doc], chars[words.begin[hits]] - origin, chars[words.end[hits]] - origin) \
                if len(hits) else (hits, hits, hits)
            flat = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(hit))
            at = np.searchsorted(doc, np.arange(len(texts) + 1))
            found: dict[int, set[str]] = {}
            for s, o in zip(starts.tolist(), owners):
                found.setdefault(int(words.doc[s]), set()).update(o)
            return [pa.array(np.diff(words.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat),
                    pa.array([sorted(found.get(i, ())) for i in range(len(texts))], pa.list_(pa.string()))]

        return run

    return map_texts(docs, text_col, FIELDS, make, keep)


def merged_spans(hits: list) -> list[tuple[int, int]]:
    """Code point spans to remove: runs of neighbouring hit words."""
    spans: list[list[int]] = []
    for h in hits:
        if spans and spans[-1][2] == h["word"]:
            spans[-1][1:] = [h["end"], h["word"] + 1]
        else:
            spans.append([h["start"], h["end"], h["word"] + 1])
    return [(a, b) for a, b, _ in spans]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def removal_spans(hits: pd.Series) -> pd.Series:
    """Merged spans of an array of hits."""
    return hits.map(lambda h: [{"start": a, "end": b} for a, b in merged_spans(h)])


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",),
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``hits`` (every hit word's index and code points) and ``items`` of each text.

    The size of the benchmark is measured; one block goes out with the search, more blocks are searched one after
    the other and their hits joined by row.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("t")) \
        .where("t IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    if blocks <= 1:
        return _searched(docs, [tuple(r) for r in rows.collect()], text_col, keep, window)  # at most block_bytes
    # rows are told apart by what is kept and by their text; equal ones have equal hits
    row = F.xxhash64(*keep, F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(*keep, text_col, row.alias("__row"))
    parts = None
    for b in range(2 * blocks):  # by hash, so blocks differ in size: twice as many keep them under the bound
        items = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "t"), F.lit(2 * blocks)) == b).collect()]
        part = staged(_searched(own, items, text_col, ("__row",), window).where(F.size("hits") > 0).distinct(), "hits")
        parts = part if parts is None else parts.unionByName(part)
    found = parts.groupBy("__row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = _searched(own, [], text_col, (*keep, "__row"), window).drop("hits", "items")
    none = [F.array().cast(t) for t in ("array<struct<word:int,start:int,end:int>>", "array<string>")]
    return counted.join(found, "__row", "left").select(
        *keep, "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def judged(found: DataFrame) -> DataFrame:
    """``found`` with ``n_hit`` and ``contaminated``: a twentieth of the words or more are hit."""
    hit = F.size("hits").cast("long")
    return found.withColumn("n_hit", hit).withColumn("contaminated", (hit > 0) & (20 * hit >= F.col("n_words")))
