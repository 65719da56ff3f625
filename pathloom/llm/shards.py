"""Sharding over fixed virtual slots with a stored, versioned slot-to-shard map.

A record's key hashes to one of ``SLOTS`` virtual slots for good. Bytes are summed per slot; the map from slots to
shards is a small table of which a new version is written whenever shards are added or drift apart, and only the
slots that it moves change their shard. Records are numbered without gaps inside each shard from the counts of fine
hash ranges, so no task ever sorts a whole shard.

Defined results: a null text has no bytes; a null id hashes as an empty one; repeated rows each get a place of their
own; an empty table gives no rows and a map all the same.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import fresh_path, staged

SLOTS = 4096
FINE = 64  # hash ranges per slot, for numbering
MAP = "version int, slot int, shard int, bytes bigint"


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS,
               fine: int = FINE) -> DataFrame:
    """Id, size, checksum, virtual slot and fine range of each record."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return docs.select(F.col(id_col), (F.octet_length(raw) + 8).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), h.alias("__h")).select(
        id_col, "size", "text_crc32", (F.col("__h") % slots).cast("int").alias("vslot"),
        (F.floor(F.col("__h") / slots) % fine).cast("int").alias("fine"))


def planned(weights: dict[int, int], shards: int, current: dict[int, int] | None = None, slots: int = SLOTS,
            tolerance: float = 0.01) -> dict[int, int]:
    """Shard of every slot. Slots without one go, heaviest first, to the lightest shard; then, if there was a map
    before, slots move from the heaviest to the lightest shard while that brings the two closer."""
    shard_of = {s: p for s, p in (current or {}).items() if p < shards}
    load = [0] * shards
    for s, p in shard_of.items():
        load[p] += weights.get(s, 0)
    heap = [(load[p], p) for p in range(shards)]
    heapq.heapify(heap)
    for s in sorted((s for s in range(slots) if s not in shard_of), key=lambda s: (-weights.get(s, 0), s)):
        w, p = heapq.heappop(heap)
        shard_of[s] = p
        load[p] = w + weights.get(s, 0)
        heapq.heappush(heap, (load[p], p))
    if current:
        for _ in range(slots):
            high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
            gap = load[high] - load[low]
            if gap <= tolerance * sum(load) / shards:
                break
            fits = [(abs(gap - 2 * weights.get(s, 0)), s) for s, p in shard_of.items()
                    if p == high and 0 < weights.get(s, 0) < gap]
            if not fits:
                break
            s = min(fits)[1]
            shard_of[s] = low
            load[high] -= weights[s]
            load[low] += weights[s]
    return shard_of


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, by default the last."""
    rows = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(version))


def write_map(spark: SparkSession, path: str, version: int, shard_of: dict[int, int], weights: dict[int, int]) -> None:
    """Append one version: as many rows as there are slots."""
    values = ",".join(f"({version},{s},{p},{weights.get(s, 0)}L)" for s, p in sorted(shard_of.items()))
    spark.sql(f"SELECT * FROM VALUES {values} AS m(version, slot, shard, bytes)").coalesce(1) \
        .write.mode("append").parquet(path)


def slot_weights(rows: DataFrame) -> dict[int, int]:
    """Bytes of each slot; at most as many rows as there are slots."""
    return {r.vslot: r.bytes for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def rebalanced(rows: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Write the next version of the map at ``path`` for the rows as they are now, and return it."""
    spark = rows.sparkSession
    last = read_map(spark, path).collect()  # as many rows as there are slots
    weights = slot_weights(rows)
    write_map(spark, path, last[0].version + 1, planned(weights, shards, {r.slot: r.shard for r in last}, slots),
              weights)
    return read_map(spark, path)


def placed(rows: DataFrame, shard_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows with ``shard`` and ``slot``, their place in it counted from 0.

    Counts of fine ranges, a fixed number, are summed up over each shard; rows are numbered only inside their range.
    """
    ranges = rows.groupBy("vslot", "fine").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "fine").rowsBetween(Window.unboundedPreceding, -1)
    small = F.broadcast(shard_map.select(F.col("slot").alias("vslot"), "shard"))  # SLOTS rows
    offsets = ranges.join(small, "vslot").select(
        "vslot", "fine", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("vslot", "fine").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside))
    return numbered.join(offsets, ["vslot", "fine"]).select(
        id_col, "size", "text_crc32", "vslot", F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int, map_path: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Begin a map for ``docs`` over ``shards`` shards of near equal bytes, store it, and place every record."""
    spark = docs.sparkSession
    rows = staged(sized_rows(docs, id_col, text_col, slots), "shard_rows")
    path = map_path or fresh_path(spark, "shard_map")
    weights = slot_weights(rows)
    write_map(spark, path, 1, planned(weights, shards, None, slots), weights)
    return placed(rows, read_map(spark, path), id_col)
