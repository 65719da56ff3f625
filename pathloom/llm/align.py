"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked token ids.

Both encode the text behind one space: the byte-level vocabulary (A) as it is, the piece vocabulary (B) by the space it
adds. Where cumulative byte ends occur in both encodings the token lists are cut: the ends are keys of one dictionary
for each encoding, from end to token index; the sorted common keys slice both id lists into groups, and each slice gives
the link of the A and the B token that end with it.

Texts are cut into units, and a worker keeps the alignment of units it has met (in flat arrays: texts are put together
from them without a step in Python for each word). A unit ends before a single space
between two characters that are neither space nor doubtful as space, and where letters meet digits, signs or a lone line
break. Such a place is a token boundary of both, and nothing crosses it: the byte-level pattern begins a new match there
whatever stands around it, and the piece vocabulary holds no piece with the two characters side by side, so no merge can
reach over it (checked when the model is loaded; otherwise whole texts are the units). Joined encodings of the units
are therefore the encoding of the text. New units are joined to one text for each batch and aligned together.

Counts: links are folded per document and summed per id pair. Pairs with at least 1/HEAVY of all links, at most HEAVY of
them, are broadcast; the rest of the links, none of whose keys is hot, is joined by shuffle.

Defined results: a text that is null or empty, or one of whose encodings does not give back its bytes, has no tokens:
zeros, no groups and no links. Rows come back one for one; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import map_texts, parts, staged

HEAVY = 65_536
UNIT_CHARS = 64  # longer units are not kept
CACHE = 3 << 17  # units a worker keeps from batch to batch
BATCH_BYTES = 2 << 20  # of text put together at a time
JOINED_CHARS = 1 << 14  # of new units encoded at a time
_FIELDS = ("n_a bigint, n_b bigint, n_groups bigint, groups string, "
           "links array<struct<a:int,b:int,n:int>>")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHERS = r"!-&(-@\[-`{-~"  # ASCII without letters, space and the apostrophe, which may join what follows
_FIRM = rf"[{_LETTERS}{_OTHERS}']"  # characters that no version of the Unicode tables counts as space
#: Units of a piece that has no other space than the one before it, and firm ends: runs of letters or of other signs where
#: the next character is of the other class or none, a lone line break, or what is left up to the next space.
_UNITS = re.compile(rf" ?(?:[{_LETTERS}]++(?![^ {_OTHERS}\n])|[{_OTHERS}]++(?![^ {_LETTERS}\n])(?:\n(?=[{_LETTERS}{_OTHERS}]))?"
                    rf"|(?<=[{_LETTERS}])\n(?=[{_LETTERS}{_OTHERS}])|[^ ]+)")
_FIRM_ENDS = re.compile(rf"{_FIRM}(?:.*{_FIRM})?", re.DOTALL)
_SPACE_BETWEEN = re.compile(rf"(?<={_FIRM}) (?={_FIRM})")


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: a printable byte is its own character, the others
    take the characters from 256 on in turn."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def slices(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int]]:
    """Each common end, in order, with how many tokens of A and of B lie before it."""
    index_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    return [(end, index_a[end], index_b[end]) for end in sorted(index_a.keys() & index_b.keys())]


def _spread(starts, sizes):
    """The places start, start + 1, ... of each run, one run after the other."""
    import numpy as np

    ends_of = np.cumsum(sizes)
    total = int(ends_of[-1]) if len(sizes) else 0
    return np.arange(total) + np.repeat(starts - (ends_of - sizes), sizes)


def _lists(values, sizes):
    """Consecutive values as lists of the given sizes."""
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _join(values, sizes, separator: str):
    """Consecutive strings, joined in runs of the given sizes."""
    import pyarrow.compute as pc

    return pc.binary_join(_lists(values, sizes), separator)


class Units:
    """Units and what was found for each, in flat arrays: groups as text, links, numbers of tokens.

    A unit behind a space is known by its own characters, one right behind another by a mark and them.
    """

    MARK = "\ud800"  # in no text

    def __init__(self, limit: int):
        import numpy as np
        import pyarrow as pa

        self.limit, self.index = limit, {}
        self.groups = pa.array([], pa.string())
        self.n_a = self.n_b = self.n_links = self.uses = self.links = np.zeros(0, np.int64)
        self.lost = np.zeros(0, bool)  # whose bytes do not come back

    def add(self, groups, n_a, n_b, n_links, links, lost) -> None:
        """Enter the next units, in the order in which they got their places."""
        import numpy as np
        import pyarrow as pa

        self.groups = pa.concat_arrays([self.groups, groups])
        self.n_a, self.n_b, self.links = (
            np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.links, links)))
        self.n_links, self.lost = np.concatenate([self.n_links, n_links]), np.concatenate([self.lost, lost])
        self.uses = np.concatenate([self.uses, np.zeros(len(n_a), np.int64)])

    def links_of(self, places):
        """Links of units, one unit after the other."""
        import numpy as np

        starts = np.cumsum(self.n_links) - self.n_links
        return self.links[_spread(starts[places], self.n_links[places])]

    def forget(self, places) -> None:
        """Count a batch's units, and keep those used most when there are more than the limit."""
        import numpy as np

        self.uses += np.bincount(places, minlength=len(self.uses))
        if len(self.index) <= self.limit:
            return
        often = np.sort(self.uses)[-self.limit // 2]
        left = [(unit, i) for unit, i in self.index.items() if self.uses[i] > often and len(unit) <= UNIT_CHARS]
        at = np.array([i for _, i in left], dtype=np.int64)
        self.index = {unit: n for n, (unit, _) in enumerate(left)}
        self.links, self.groups = self.links_of(at), self.groups.take(at)
        self.n_a, self.n_b, self.n_links, self.lost, self.uses = (
            own[at] for own in (self.n_a, self.n_b, self.n_links, self.lost, self.uses))


class Aligner:
    """Two loaded vocabularies and the units aligned so far."""

    def __init__(self, byte_level: str, pieces: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        import numpy as np
        import pyarrow as pa
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_of_letter(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [self._bytes_of(i) for i in range(self.b.get_piece_size())]
        held = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())
                if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.by_unit = not any(self._joins(p) for p in held)
        characters = set("".join(held))
        self.wall = next(c for c in map(chr, [10, *range(1, 32)]) if c not in characters)  # no merge reaches over it
        self.head = len(self.b.encode(self.wall))
        self.a_size, self.b_size = (np.array([*map(len, own)]) for own in (self.a_bytes, self.b_bytes))
        self.words = pa.array(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))), pa.string())
        self.units = Units(cache)

    def _bytes_of(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    @staticmethod
    def _joins(piece: str) -> bool:
        """Whether a piece of the vocabulary reaches over a place where units are cut."""
        inner = piece.lstrip("▁")
        return "▁" in inner or "\n" in inner or len(_UNITS.findall(inner)) > 1

    # ---- cutting

    def cut(self, texts):
        """Pieces of all texts, one text after the other, as places in the list of distinct pieces; that list; and the
        number of pieces of each text. A piece is what stands between two spaces, or more where a space is doubtful."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = (pc.split_pattern(texts, " ") if self.by_unit else _lists(texts, np.ones(len(texts), np.int64)))
        sizes, coded = pc.list_value_length(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if not self.by_unit:
            return codes, distinct, sizes
        loose = np.array([not (p.isalpha() or _FIRM_ENDS.fullmatch(p)) for p in distinct], dtype=bool)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        again = np.unique(owner[loose[codes]])
        if len(again):  # texts with a doubtful space are cut only where it is firm
            parts = [_SPACE_BETWEEN.split(texts[int(i)].as_py()) for i in again]
            kept = ~np.isin(owner, again)
            more = pa.array([p for own in parts for p in own], pa.string())
            flat = pa.concat_arrays([pc.cast(coded.dictionary.take(pa.array(codes[kept])), pa.string()), more])
            by = np.concatenate([owner[kept], np.repeat(again, [len(own) for own in parts])])
            order = np.argsort(by, kind="stable")
            coded = flat.take(pa.array(order)).dictionary_encode()
            sizes = np.bincount(by, minlength=len(sizes))
            distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        return codes, distinct, sizes

    def units_of(self, piece: str) -> list[str]:
        if piece.isalpha() or not self.by_unit or " " in piece or not _FIRM_ENDS.fullmatch(piece):
            return [piece]
        first, *rest = _UNITS.findall(" " + piece)
        return [first[1:], *[Units.MARK + unit for unit in rest]]

    # ---- encoding

    def _cuts(self, ids_a, ids_b, raw: bytes):
        """The common ends in bytes and the tokens of A and of B before each, or None if bytes differ."""
        import numpy as np

        joined_a, joined_b = map(self.a_bytes.__getitem__, ids_a), map(self.b_bytes.__getitem__, ids_b)
        if b"".join(joined_a) != raw or b"".join(joined_b) != raw:
            return None
        found = slices(np.cumsum(self.a_size[ids_a]).tolist(), np.cumsum(self.b_size[ids_b]).tolist())
        return np.array(found, dtype=np.int64).T

    def _encode(self, units: list[str], lead: str, between: str) -> list[tuple]:
        """Align units of which each stands behind ``lead``, with ``between`` after each, joined to one text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        text = "".join([f"{lead}{unit}{between}" for unit in units])
        ids_a = self.a.encode(text, add_special_tokens=False).ids
        ids_b = self.b.encode(text[1:]) if lead else self.b.encode(self.wall + text)[self.head:]
        cuts = self._cuts(ids_a, ids_b, text.encode())
        if cuts is None:
            if len(units) > 1:
                return [x for unit in units for x in self._encode([unit], lead, between)]
            zero = np.zeros(1, np.int64)
            return [(pa.array([""], pa.string()), zero, zero, zero, zero[:0], zero == 0)]
        end, to_a, to_b = cuts
        own_a, own_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        ids_a, ids_b = np.array(ids_a), np.array(ids_b)
        groups = pc.binary_join_element_wise(_join(self.words.take(pa.array(ids_a)), own_a, ","),
                                             _join(self.words.take(pa.array(ids_b)), own_b, ","), "|")
        links = ids_a[to_a - 1] << 32 | ids_b[to_b - 1]
        stops = np.cumsum([len(lead) + len(between) + len(unit.encode()) for unit in units])
        last = np.searchsorted(end, stops) + 1  # slices up to the end of each unit and what follows it
        if between:  # what only parts the units is a slice of its own and left out
            kept = np.ones(len(end), bool)
            kept[last - 1] = False
            groups, links, own_a, own_b = groups.filter(pa.array(kept)), links[kept], own_a[kept], own_b[kept]
            last = last - np.arange(1, len(units) + 1)
        n = np.diff(last, prepend=0)
        first = last - n
        n_a, n_b = np.add.reduceat(own_a, first), np.add.reduceat(own_b, first)
        return [(_join(groups, n, ";"), n_a, n_b, n, links, np.zeros(len(units), bool))]

    def learn(self, new: list[str]) -> None:
        """Align units not met before and enter them. Those behind spaces are joined as they are, the others with line
        breaks between them; a unit that begins or ends in a doubtful character is encoded by itself."""
        import numpy as np
        import pyarrow as pa

        bare = len(Units.MARK)
        kinds = {"spaced": [], "bare": [], "alone": []}
        for unit in new:
            marked = unit[:1] == Units.MARK
            ends_firm = self.by_unit and (unit.isalpha() or _FIRM_ENDS.fullmatch(unit, bare * marked))
            kinds["alone" if not ends_firm else "bare" if marked else "spaced"].append(unit)
        found = []
        for kind, units in kinds.items():
            part, size = [], 0
            for n, unit in enumerate(units, 1):
                marked = unit[:1] == Units.MARK
                part.append(unit[bare:] if marked else unit)
                size += len(unit)
                if kind == "alone" or size > JOINED_CHARS or n == len(units):
                    found += self._encode(part, "" if marked else " ", "\n" if kind == "bare" else "")
                    part, size = [], 0
        for unit in chain.from_iterable(kinds.values()):
            self.units.index[unit] = len(self.units.index)
        if found:
            groups, *rest = zip(*found)
            self.units.add(pa.concat_arrays(groups), *map(np.concatenate, rest))

    def texts(self, texts):
        """Of an array of texts: numbers of tokens of A and of B, groups as text, and the links, text after text, with
        their number in each text."""
        import numpy as np
        import pyarrow as pa

        codes, distinct, sizes = self.cut(texts)
        units, index = [self.units_of(p) for p in distinct], self.units.index
        self.learn([*dict.fromkeys(u for own in units for u in own if u not in index)])
        # from pieces to units
        n_units = np.array([*map(len, units)], dtype=np.int64)
        flat = np.fromiter((index[u] for own in units for u in own), dtype=np.int64, count=int(n_units.sum()))
        places = flat[_spread((np.cumsum(n_units) - n_units)[codes], n_units[codes])]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        in_text = np.bincount(owner, weights=n_units[codes], minlength=len(sizes)).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), in_text)
        known = self.units
        # texts that do not come back, and empty ones, have no tokens
        none = np.zeros(len(sizes), bool)
        none[owner[known.lost[places]]] = True
        none |= np.array([not t.as_py() for t in texts], dtype=bool)
        kept = ~none[owner]
        places, owner = places[kept], owner[kept]
        in_text = np.bincount(owner, minlength=len(sizes))

        def total(values):
            return np.bincount(owner, weights=values[places], minlength=len(sizes)).astype(np.int64)

        groups = _join(known.groups.take(pa.array(places)), in_text, ";")
        out = total(known.n_a), total(known.n_b), groups, known.links_of(places), total(known.n_links)
        known.forget(places)
        return out


@lru_cache(maxsize=2)
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def align_texts(docs: DataFrame, byte_level: str, pieces: str, text_col: str = "text",
                keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` as ``a1,a2|b1;a3|b2,b3`` and the distinct ``links``
    of each whole text, each with the number of its occurrences."""

    def make():
        import numpy as np
        import pyarrow as pa

        own = aligner(byte_level, pieces)

        def some(texts):
            n_a, n_b, groups, pairs, sizes = own.texts(texts)
            starts = np.cumsum(sizes) - sizes
            distinct = [np.unique(pairs[i:i + n], return_counts=True) for i, n in zip(starts, sizes)]
            pair = np.concatenate([p for p, _ in distinct])
            rows = pa.StructArray.from_arrays(
                [pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)),
                 pa.array(np.concatenate([n for _, n in distinct]).astype(np.int32))], names=["a", "b", "n"])
            offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in distinct)]).astype(np.int32))
            return [pa.array(n_a), pa.array(n_b), pa.array(sizes), groups,
                    pa.ListArray.from_arrays(offsets, rows)]

        def run(texts):
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            return [*map(pa.concat_arrays, zip(*(some(part.column(0)) for part in parts(batch, BATCH_BYTES))))]

        return run

    return map_texts(docs, text_col, _FIELDS, make, keep)


def _exploded(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.explode("links").alias("link")).select("row", "link.*")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, count, best``: corpus-wide links of each id pair, and whether no other pair of that B id has more."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link.a", "link.b").agg(
        F.sum("link.n").alias("count"))
    counts = staged(counts, "pair_counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, keep: tuple[str, ...] = (), heavy: int = HEAVY) -> DataFrame:
    """Aligned rows with ``n_links``, ``n_best`` (links whose pair is the most frequent of its B id) and ``count_sum``."""
    kept = [c for c in aligned.columns if c != "links"]
    rows = staged(aligned.select(F.monotonically_increasing_id().alias("row"), *aligned.columns), "aligned")
    counts = staged(pair_counts(rows), "pair_best")
    total = counts.agg(F.sum("count")).first()[0] or 0
    # each has 1/heavy of all links at least, so there are heavy of them at most
    hot = F.col("count") * F.lit(heavy) >= F.lit(total)
    often, rare = F.broadcast(counts.where(hot)), counts.where(~hot)
    links = _exploded(rows)
    met = links.join(often, ["a", "b"]).unionByName(
        links.join(often.select("a", "b"), ["a", "b"], "left_anti").join(rare, ["a", "b"]))

    def total_of(value: Column) -> Column:
        return F.sum(F.col("n").cast("long") * value)

    sums = met.groupBy("row").agg(total_of(F.col("best").cast("long")).alias("n_best"),
                                  total_of(F.col("count")).alias("count_sum"))
    return rows.join(sums, "row", "left").select(
        *kept, F.col("n_groups").alias("n_links"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
