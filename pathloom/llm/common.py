"""What the text operators share: reading tables, staging, row-wise maps and span digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.session import shared_dir

SPAN = "struct<kind:string,start:int,end:int,base:boolean>"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: survives lost executors and cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PART_BYTES = 4 << 20  # of text worked on at a time; a longer text is a part of its own


def parts(batch, limit: int = PART_BYTES):
    """A batch in slices of rows with bounded bytes in the last column."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(df: DataFrame, text_col: str, fields: str, make: Callable[[], Callable[[Iterator[str]], list]],
              keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` plus ``fields`` computed from each whole text in Arrow batches; a null text counts as empty.

    ``make()`` runs once per task and returns a function from the texts of a batch to one Arrow array per field.
    """
    out = T._parse_datatype_string(fields)
    kept = df.select(*keep, F.coalesce(text_col, F.lit("")).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], *out.fields])
    names = schema.names

    def run(batches):
        import pyarrow as pa

        fn = make()
        for batch in batches:
            for part in parts(batch):
                texts = part.column(part.num_columns - 1).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *fn(texts)], names=names)

    return kept.mapInArrow(run, schema)


def span_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("base", pa.bool_())]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(spans: str, kinds: Sequence[str]) -> list[Column]:
    """Counts of base spans per kind, hash of the base spans, and all spans as text. Spans come sorted."""
    base = F.filter(spans, lambda s: s["base"])

    def of(kind: str) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
            _joined(F.col(spans)).alias("spans")]
