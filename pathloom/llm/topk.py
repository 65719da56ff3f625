"""Exact top-k search by inner product: MaxScore in shards, merged.

Vectors and queries are dealt to a grid of bounded cells: a shard of some ``SHARD_ROWS`` vectors meets a block of some
``BLOCK_ROWS`` queries. Inside a shard every dimension is a posting list of the documents that have a component there.
A query's terms are its dimensions, ordered by the most that a posting can add to a score. Terms whose bounds together
stay below the k-th best score known are non-essential: a document with none of the others cannot enter. The essential
postings are traversed, then the other terms are probed, dearest first, for the documents that are still competitive:
those whose score so far plus the bounds of what is left reaches the k-th best. The first k-th best comes from the
documents at the heads of the dearest postings, scored whole. Each cell returns the k best of its shard for each of its
queries; the merge keeps k of those.

Defined results: components are floor(scale * x) with x taken as double; a vector that is null or holds a null or
non-finite component takes no part, neither as query nor as candidate. Where lengths differ the shorter vector is
filled with zeros; an empty one scores 0 everywhere. A query's own row is no candidate of it, other rows with its id are;
repeated query rows are answered one by one. Ties go to the smaller id, a null id counts as the largest. A score beyond
the range of a long counts as the end of that range. An empty table, or no query, gives no rows; a query with fewer than
k candidates gets all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import staged

SHARD_ROWS, BLOCK_ROWS = 4096, 4096
SCALE = 1024
_FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
_LOW, _HIGH = -2**63, 2**63 - 1


def scaled(values, scale: int):
    """floor(scale * x) of finite doubles as integers, exact: 64 bits where they fit, Python's own where not."""
    import numpy as np

    with np.errstate(over="ignore"):
        raised = np.floor(values * float(scale))
    if not len(values) or np.abs(raised).max() < 2.0**62:
        return raised.astype(np.int64)
    return np.array([math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in values.tolist()],
                    dtype=object)


class Sparse:
    """Rows of a table as nonzero integer components: ``rows[i]`` has ``dims[at[i]:at[i + 1]]``."""

    def __init__(self, table, scale: int):
        import numpy as np

        lists = table.column("vec").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        values = scaled(lists.flatten().to_numpy(zero_copy_only=False), scale)
        dims = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
        kept = np.flatnonzero(values != 0)
        self.values, self.dims = values[kept], dims[kept]
        self.owner = np.repeat(np.arange(len(size)), size)[kept]
        self.at = np.searchsorted(self.owner, np.arange(len(size) + 1))
        self.rows = table.column("row").to_numpy()
        self.ids = table.column("id").to_pylist()

    def __len__(self) -> int:
        return len(self.rows)


class Shard:
    """Posting lists of one shard: for each dimension the documents in it, their components, and the extremes."""

    def __init__(self, vectors: Sparse):
        import numpy as np

        self.vectors, n = vectors, len(vectors)
        order = np.argsort(vectors.dims, kind="stable")
        dims, self.docs, self.values = vectors.dims[order], vectors.owner[order], vectors.values[order]
        terms, first = np.unique(dims, return_index=True)
        ends = np.append(first[1:], len(dims))
        self.places = {int(d): slice(int(a), int(e)) for d, a, e in zip(terms, first, ends)}
        self.extremes, self.heads = {}, {}
        for d, place in self.places.items():
            v = self.values[place]
            full = len(v) == n  # else a document without the term adds nothing to a score
            self.extremes[d] = (v.min() if full else min(v.min(), 0), v.max() if full else max(v.max(), 0))
        # smaller ids first among equal scores; a null id is the largest
        by_id = sorted(range(n), key=lambda i: (vectors.ids[i] is None, vectors.ids[i] or 0, vectors.rows[i]))
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[by_id] = np.arange(n)
        self.reach = max((max(abs(int(a)), abs(int(e))) for a, e in self.extremes.values()), default=0)

    def posting(self, d: int):
        place = self.places[d]
        return self.docs[place], self.values[place]

    def ends(self, d: int, sign: int, many: int):
        """The documents of a posting with the largest (sign > 0) or smallest components."""
        import numpy as np

        if (d, sign) not in self.heads:
            docs, values = self.posting(d)
            order = np.argsort(values, kind="stable")
            self.heads[d, sign] = docs[order[-many:] if sign > 0 else order[:many]]
        return self.heads[d, sign]

    def component(self, d: int, candidates):
        """Components of the candidates in dimension d."""
        import numpy as np

        docs, values = self.posting(d)
        if len(docs) == len(self.vectors):
            return values[candidates]
        place = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
        return np.where(docs[place] == candidates, values[place], 0)

    def search(self, dims, weights, own_row: int, k: int):
        """The k best documents (positions, scores) for a query, without the row ``own_row``."""
        import numpy as np

        n = len(self.vectors)
        terms = [(int(d), w) for d, w in zip(dims.tolist(), weights.tolist()) if int(d) in self.places]
        total = self.reach * sum(abs(w) for _, w in terms)
        kind = np.int64 if total < 2**62 else object
        allowed = self.vectors.rows != own_row
        bounds = [max(int(w) * int(self.extremes[d][0]), int(w) * int(self.extremes[d][1])) for d, w in terms]
        order = sorted(range(len(terms)), key=lambda i: -bounds[i])
        terms, bounds = [terms[i] for i in order], [bounds[i] for i in order]

        def whole(candidates):
            scores = np.zeros(len(candidates), dtype=kind)
            for d, w in terms:
                scores = scores + self.component(d, candidates).astype(kind) * w
            return scores

        def kth(scores):
            """The k-th best of scores, none where that would not rule anything out."""
            if len(scores) < k:
                return None
            least = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if kind is not object \
                else sorted(scores)[len(scores) - k]
            return least if _LOW < least <= _HIGH else None

        heads = [self.ends(d, 1 if w > 0 else -1, 2 * k) for d, w in terms[:8]]
        seeds = np.unique(np.concatenate(heads)) if heads else np.empty(0, dtype=np.int64)
        floor = kth(whole(seeds[allowed[seeds]]))

        # terms[essential:] are non-essential: their bounds, and those of any of its ends, sum up to less than the floor
        essential, left = len(terms), 0
        if floor is not None and floor > 0:
            while essential and left + bounds[essential - 1] < floor:
                essential -= 1
                left += bounds[essential]
        else:  # even a document without any term may enter
            left = 0
        scores = np.zeros(n, dtype=kind)
        touched = np.full(n, floor is None or floor <= 0)
        for d, w in terms[:essential]:
            docs, values = self.posting(d)
            if len(docs) == n:
                scores += values.astype(kind) * w
                touched[:] = True
            else:
                scores[docs] += values.astype(kind) * w
                touched[docs] = True
        candidates = np.flatnonzero(touched & allowed)
        scores = scores[candidates]
        for d, w, bound in ((*t, b) for t, b in zip(terms[essential:], bounds[essential:])):
            live = scores + left >= floor
            candidates, scores = candidates[live], scores[live]
            if not len(candidates):
                break
            scores = scores + self.component(d, candidates).astype(kind) * w
            left -= bound
        scores = np.minimum(np.maximum(scores, _LOW), _HIGH).astype(np.int64)
        if len(scores) > k:  # all that reach the k-th best score, then ties by id
            reach = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            candidates, scores = candidates[reach], scores[reach]
        best = np.lexsort((self.rank[candidates], -scores.astype(object) if (scores == _LOW).any() else -scores))[:k]
        return candidates[best], scores[best]


def _usable(vector: Column) -> Column:
    """Whether a vector takes part: not null and all components finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & ~F.exists(vector, lambda x: bad(x.cast("double")))


def _many(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def search_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
                 scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every row that ``is_query`` holds for."""
    usable = vectors.where(_usable(F.col(vec_col))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = staged(usable, "vectors")  # row numbers must not change when a task runs again
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = _many(counts.n, shard_rows), _many(counts.q, block_rows)
    deal = F.xxhash64("row")
    shard, block = F.pmod(deal, F.lit(shards)).cast("int"), F.pmod(deal, F.lit(blocks)).cast("int")
    documents = rows.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                            "row", "id", "vec")
    queries = rows.where("asks").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), "row", "id", "vec")

    def cell(mine, asking):
        import numpy as np
        import pyarrow as pa

        names = ["query_row", "query_id", "row", "vec_id", "score"]
        docs, asks = Shard(Sparse(mine, scale)), Sparse(asking, scale)
        out = []
        for i in range(len(asks) if len(docs.vectors) else 0):
            part = slice(asks.at[i], asks.at[i + 1])
            found, scores = docs.search(asks.dims[part], asks.values[part], int(asks.rows[i]), k)
            out += [(int(asks.rows[i]), asks.ids[i], int(docs.vectors.rows[d]), docs.vectors.ids[d], s)
                    for d, s in zip(found.tolist(), np.asarray(scores).tolist())]
        columns = list(zip(*out)) if out else [[]] * len(names)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, columns)})

    found = documents.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(cell, _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
