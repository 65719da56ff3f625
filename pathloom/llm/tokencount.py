"""Token counts of whole texts, long ones in overlapping chunks.

A text of more than ``CHUNK`` characters is encoded in chunks that overlap. Two neighbours are spliced at a boundary
both encodings share and that is proven stable: no piece of the vocabulary holds the two characters around it side
by side, so no merge can ever cross it and the tokens on either side do not depend on the other. If an overlap holds
no such boundary it is widened, in the end to all that is not yet counted.

Defined results: a null text is empty and has no tokens; rows come back one for one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import map_texts

CHUNK, OVERLAP = 16_384, 512


class Counter:
    """Counts for one model file. Holds the pairs of characters that stand side by side in some piece."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
                  if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        held = set("".join(pieces))
        self.wall = next(c for c in map(chr, [10, *range(1, 32)]) if c not in held)  # no merge reaches over it
        self.head = len(self.model.encode(self.wall))

    def plain(self, text: str) -> bool:
        """Whether the model takes the text character by character, only marking spaces."""
        return self.model.normalize(text).lstrip("▁") == text.replace(" ", "▁").lstrip("▁")

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.plain(text):
            return len(self.model.encode(text))
        return self.spliced(text)

    def begins(self, text: str, start: int, end: int) -> list[int]:
        """Where each token of text[start:end] begins, encoded behind the wall (at 0: as the text's own start)."""
        part = text[:end] if start == 0 else self.wall + text[start:end]
        pieces = self.model.encode(part, return_type="proto").pieces
        skip, shift = (0, 0) if start == 0 else (self.head, start - 1)
        if part.isascii():
            return [shift + p.begin for p in pieces[skip:]]
        raw = np.frombuffer(part.encode(), np.uint8)  # the model counts bytes
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return (chars[[p.begin for p in pieces[skip:]]] + shift).tolist()

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1].replace(" ", "▁") not in self.pairs

    def spliced(self, text: str) -> int:
        """Tokens of a long text. [low, ...) is not yet counted; low is 0 or a stable boundary."""
        n, total, low, end = len(text), 0, 0, min(len(text), self.chunk)
        here = self.begins(text, 0, end)
        while end < n:
            overlap, further = self.overlap, min(n, end + self.chunk)
            while True:
                start = max(low, end - overlap)
                there = self.begins(text, start, further)
                if start == low:  # all that is not counted was encoded anew from a stable boundary
                    here = there
                    break
                common = set(here) & set(there)
                at = next((p for p in sorted(common) if start < p < end and self.stable(text, p)), None)
                if at is not None:
                    total += sum(low <= p < at for p in here)
                    here, low = [p for p in there if p >= at], at
                    break
                overlap *= 2
            end = further
        return total + sum(p >= low for p in here)


@lru_cache(maxsize=4)
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Columns ``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of each whole text."""

    def make():
        import pyarrow as pa

        c = counter(model, chunk, overlap)
        return lambda texts: [pa.array([c.count(t.as_py()) for t in texts], pa.int64())]

    # the length is taken from the stored bytes before the text leaves for Python
    sized = docs.select(*keep, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_texts(sized, text_col, "n_tokens bigint", make, [*keep, "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
