"""Byte-level BPE by the ranks of a vocabulary file, encoded and decoded by DuckDB inside each partition.

A batch of texts is cut into words by the tokenizer's split pattern, worked out on arrays of character classes. Words
not met before go to DuckDB as token-position rows, positions counted on over all words of a block. A recursive query
joins neighbouring rows with the merge table and contracts each word's leftmost pair of lowest rank until no pair is
left in the table; an ordered aggregation over blocks of 4096 ids, whatever lists they stand in, turns ids back into
bytes, which are then dealt out by the lengths of the tokens.

Defined results: a null text is empty and has no tokens; rows come back one for one. Long words are cut first where
two bytes meet that no token holds side by side, as no merge can cross there.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from pathloom.llm.common import map_texts

SLICE = 1 << 20  # characters worked on at a time; longer texts are cut before a space that begins a word
WORDS = 20_000  # words in one recursive query
CACHE = 200_000  # words in each of two generations a worker remembers; of the older one, what recurs moves on
LONG = 48  # bytes from which a word is looked at for places no merge can cross

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the split pattern sees it."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    out = np.full(0x110000, _OTHER, np.uint8)
    for cls, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start():m.end()] = cls
    return out


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where words begin among the code points of texts laid end to end; ``firsts``: where the texts begin.

    The rule of the split pattern: words are runs of letters, of numbers or of other marks, each with one space
    before it; of white space before a word the last character stands alone (or is that space); an apostrophe that
    begins a run takes along the ending after it.
    """
    n = len(points)
    cls = classes()[points]
    space = cls == _SPACE
    begin = np.zeros(n + 1, bool)
    begin[firsts] = True
    edge = begin[:-1].copy()  # first character of a text
    before_other = np.ones(n, bool)
    before_other[1:] = cls[1:] != cls[:-1]
    before_other |= edge
    start = before_other.copy()  # every run begins a word ...
    last = np.zeros(n, bool)  # the last white space before a word in the same text
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:]
    start |= last
    glued = np.zeros(n, bool)  # ... but one behind a space that goes with it
    glued[1:] = (last & (points == 32))[:-1]
    start &= ~glued
    marks = np.flatnonzero((points == 39) & before_other & ~glued)
    if len(marks):
        ends = np.searchsorted(firsts, marks, side="right")
        stop = np.append(firsts, n)[ends]  # of the text
        at = lambda i: np.where(marks + i < stop, points[np.minimum(marks + i, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) \
            | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        took = size > 0
        start[marks[took] + 1] = False
        after = (marks + size)[took & (marks + size < stop)]
        start[after] = True
    return np.flatnonzero(start)


_ENCODE = """
WITH RECURSIVE t(w, pos, tok, nxt, done) AS (
  SELECT w, pos, tok, pos + 1, false FROM start
  UNION ALL
  SELECT a.w, a.pos, CASE WHEN a.pos = h.pos THEN h.id ELSE a.tok END,
         CASE WHEN a.pos = h.pos THEN h.pos + h.len ELSE a.nxt END, h.w IS NULL
  FROM t a LEFT JOIN (
    SELECT w, (best >> 42)::INT id, ((best >> 10) & 4294967295)::INT pos, (best & 1023)::INT len
    FROM (SELECT x.w, min(m.best + (x.pos::BIGINT << 10)) best
          FROM t x JOIN t y ON y.pos = x.nxt JOIN merges m ON m.pair = (x.tok::BIGINT << 32) + y.tok
          WHERE NOT x.done GROUP BY x.w)) h ON h.w = a.w
  WHERE NOT a.done AND (h.w IS NULL OR a.pos <= h.pos OR a.pos >= h.pos + h.len))
SELECT w, tok FROM t WHERE done ORDER BY pos
"""
_DECODE = """
SELECT unhex(string_agg(v.hx, '' ORDER BY x.pos)) AS bytes
FROM coded x JOIN vocab v USING (id) GROUP BY x.pos // 4096 ORDER BY x.pos // 4096
"""


class Coder:
    """One vocabulary in one worker: its merge table in DuckDB and the words met so far."""

    def __init__(self, path: str):
        import duckdb
        import pyarrow as pa

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(map(len, self.ranks)) > 1023:
            raise ValueError("tokens of more than 1023 bytes")
        if len(set(self.ranks.values())) < len(self.ranks):
            raise ValueError("tokens with one rank")
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r, len(t)) for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.meet = np.zeros((256, 256), bool)  # bytes that stand side by side in some token
        for t in self.ranks:
            for i in range(len(t) - 1):
                self.meet[t[i], t[i + 1]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        l, r, i, n = (np.array(c, np.int64) for c in zip(*merges))
        self._table("merges", pa.table({"pair": (l << 32) + r, "best": (i << 42) + n}))
        self._table("vocab", pa.table({"id": pa.array(self.ranks.values(), pa.int32()),
                                       "hx": [t.hex() for t in self.ranks]}))
        self.size = np.zeros(max(self.ranks.values()) + 2, np.int64)  # bytes of each id; the last place: no id
        self.size[list(self.ranks.values())] = [len(t) for t in self.ranks]
        # word -> its ids as int32; with its decoded bytes where these are not the word
        self.young: dict[bytes, bytes | tuple[bytes, bytes]] = {}
        self.old: dict[bytes, bytes | tuple[bytes, bytes]] = {}
        self.unlike = False  # whether a word came that its ids do not decode to

    def _table(self, name: str, data) -> None:
        self.db.register("given", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merged(self, words: list[bytes]):
        """Ids of words by merges alone, in blocks of bounded size: all ids, and how many each word has."""
        import pyarrow as pa

        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        sizes = np.cumsum([0, *map(len, words)], dtype=np.int64)
        at = 0
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + 8 * WORDS, side="right")) - 1)
            stop = min(stop, at + WORDS)
            raw = np.frombuffer(b"".join(words[at:stop]), np.uint8)
            w = np.repeat(np.arange(stop - at, dtype=np.int32), np.diff(sizes[at:stop + 1]))
            pos = np.arange(len(raw), dtype=np.int32) + w  # a place stays free behind each word, so none meets the next
            self.db.register("start", pa.table({"w": w, "pos": pos, "tok": self.byte_id[raw]}))
            got = self.db.sql(_ENCODE).to_arrow_table()
            self.db.unregister("start")
            ids.append(got["tok"].to_numpy())
            counts.append(np.bincount(got["w"].to_numpy(), minlength=stop - at))
            at = stop
        return np.concatenate(ids), np.concatenate(counts)

    def coded(self, words: list[bytes]):
        """Ids of words, as an Arrow list array: whole tokens as they are, others by merges, long ones part by part."""
        import pyarrow as pa

        parts: dict[bytes, int] = {}  # what goes through merges, each once
        whole: list[int] = []  # numbered from -1 downwards
        picks, many = [], []  # numbers of the parts of the words one after another, and how many each word has
        for w in words:
            if (rank := self.ranks.get(w)) is not None:
                whole.append(rank)
                picks.append(-len(whole))
                many.append(1)
            elif len(w) < LONG:
                picks.append(parts.setdefault(w, len(parts)))
                many.append(1)
            else:
                raw = np.frombuffer(w, np.uint8)
                cuts = [0, *(np.flatnonzero(~self.meet[raw[:-1], raw[1:]]) + 1).tolist(), len(w)]
                picks += [parts.setdefault(w[a:b], len(parts)) for a, b in zip(cuts, cuts[1:])]
                many.append(len(cuts) - 1)
        ids, counts = self.merged(list(parts))
        ids = np.concatenate([ids, np.array(whole[::-1], np.int32)])
        counts = np.concatenate([counts, np.ones(len(whole), np.int64)])
        picks = np.array(picks, np.int64)
        begins, sizes = (np.cumsum(counts) - counts)[picks], counts[picks]
        places = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(many))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[places], pa.int32()))

    def looked_up(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of each word, from memory or from DuckDB."""
        import pyarrow as pa

        out = list(map(self.young.get, words))
        miss = [i for i, got in enumerate(out) if got is None]
        fresh = {words[i]: self.old.get(words[i]) for i in miss}
        if new := [w for w, got in fresh.items() if got is None]:
            ids = self.coded(new)
            begins = ids.offsets.to_numpy().astype(np.int64) * 4
            flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [
                None, pa.py_buffer(begins), ids.values.buffers()[1]]).to_pylist()
            fresh.update(zip(new, flat))
            if (decoded := self.decode(ids).to_pylist()) != new:
                fresh.update((w, (i, d)) for w, i, d in zip(new, flat, decoded) if d != w)
                self.unlike = True
        for i in miss:
            out[i] = fresh[words[i]]
        self.young.update(fresh)
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        if not self.unlike:
            return out, words
        both = [got if isinstance(got, tuple) else (got, w) for w, got in zip(words, out)]
        return [i for i, _ in both], [d for _, d in both]

    def encode(self, texts: list[str]):
        """All ids of the texts, where each text's ids begin, all decoded bytes, and where each text's begin."""
        import pyarrow as pa

        joined = "".join(texts)
        if not joined:
            none = np.zeros(len(texts) + 1, np.int64)
            return np.zeros(0, np.int32), none, np.zeros(0, np.uint8), none
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        firsts = np.unique(np.concatenate([[0], ends[:-1]]))
        firsts = firsts[firsts < len(points)]
        starts = word_starts(points, firsts)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        offsets = np.append(at[starts], at[-1]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())]).dictionary_encode()
        known, decoded = self.looked_up(words.dictionary.to_pylist())
        begins = np.searchsorted(starts, np.concatenate([[0], ends]))

        def spread(parts: list[bytes], dtype):
            """The parts of the words one after another, and where those of each text begin."""
            lengths = np.cumsum([0, *map(len, parts)], dtype=np.int64)
            every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [
                None, pa.py_buffer(lengths), pa.py_buffer(b"".join(parts))]).take(words.indices)
            at = np.frombuffer(every.buffers()[1], np.int64)[:len(every) + 1]
            size = np.dtype(dtype).itemsize
            return np.frombuffer(every.buffers()[2], dtype)[:at[-1] // size], at[begins] // size

        return *spread(known, np.int32), *spread(decoded, np.uint8)

    def decode(self, ids):
        """Bytes of each list of ids in an Arrow list array, as an Arrow array."""
        import pyarrow as pa

        flat = ids.flatten().fill_null(-1)
        self.db.register("coded", pa.table({"pos": np.arange(len(flat)), "id": flat}))
        raw = b"".join(self.db.sql(_DECODE).to_arrow_table()["bytes"].to_pylist())
        self.db.unregister("coded")
        size = self.size[np.clip(flat.to_numpy(), -1, len(self.size) - 1)]  # no bytes for what is no id
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(ids.value_lengths().to_numpy()))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [
            None, pa.py_buffer(ends), pa.py_buffer(raw)])


def cut(text: str, size: int) -> list[str]:
    """The text in parts of about ``size``, cut where a word begins whatever comes after: at a space behind a mark."""
    parts, at = [], 0
    while len(text) - at > size:
        stop = text.find(" ", at + size)
        while stop > 0 and text[stop - 1].isspace():
            stop = text.find(" ", stop + 1)
        if stop < 0:
            break
        parts.append(text[at:stop])
        at = stop
    return [*parts, text[at:]]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _slices(texts):
    """Lists of (row, part) of bounded length in all; a long text is handed on part by part."""
    here, size = [], 0
    for row, t in enumerate(texts):
        for part in cut(t.as_py(), SLICE):
            here.append((row, part))
            size += len(part)
            if size >= SLICE:
                yield here
                here, size = [], 0
    if here:
        yield here


def encode_texts(docs: DataFrame, ranks: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` and ``decoded``, the bytes the ids stand for, of each whole text."""

    def make():
        import pyarrow as pa

        c = coder(ranks)

        def run(texts):
            count, size = np.zeros(len(texts) + 1, np.int32), np.zeros(len(texts) + 1, np.int32)
            ids, raw = [], []
            for part in _slices(texts):
                i, i_at, d, d_at = c.encode([p for _, p in part])
                rows = np.array([row for row, _ in part]) + 1
                np.add.at(count, rows, np.diff(i_at).astype(np.int32))
                np.add.at(size, rows, np.diff(d_at).astype(np.int32))
                ids.append(i)
                raw.append(d)
            ids, raw = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (ids, raw))
            return [pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), pa.array(ids, pa.int32())),
                    pa.BinaryArray.from_buffers(pa.binary(), len(texts), [
                        None, pa.py_buffer(np.cumsum(size, dtype=np.int32)), pa.py_buffer(raw)])]

        return run

    return map_texts(docs, text_col, "ids array<int>, decoded binary", make, keep)


def decode_ids(coded: DataFrame, ranks: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of each row's ids; null ids give no bytes."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    rows = coded.select(*keep, F.coalesce(ids_col, F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        c = coder(ranks)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], c.decode(ids).cast(pa.binary())],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)
