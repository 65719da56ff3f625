"""Secret scan over an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its bytes. The ledger, a Parquet table that only grows,
says which rule versions have seen which blob and what they found. A run scans only the blob and rule-version pairs
the ledger lacks, appends them, and joins the findings back to every path that holds the blob.

Defined results: a null text is the empty blob; repeated rows come back as often as they went in; a changed rule
version is scanned again while older versions' findings stay in the ledger unread.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import parts


@dataclass(frozen=True)
class Rule:
    """``hints``: lower-case text of which one must occur (in any case) for the pattern to match at all."""

    kind: str
    version: int
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1
    flags: int = 0
    hints: tuple[str, ...] = ()
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the scan. Maximal runs are bounded by look-behinds, so long runs cost linear time.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6, re.IGNORECASE | re.ASCII, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, 0, ("akia",)),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, 0, ("-----begin ",), False),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, 0,
         ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), False),
)
BASE_KINDS = ("assign", "access", "hex")
LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,kind:string,start:int,end:int>>"


def scan(text: str, rules: Sequence[Rule]) -> list[tuple[str, str, int, int]]:
    """(rule, kind, start, end) of all matches long enough, in code points, leftmost and non-overlapping per rule."""
    found = []
    low = text.lower()
    for rule in rules:
        if not rule.hints or any(h in low for h in rule.hints):
            for m in re.compile(rule.pattern, rule.flags).finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((rule.key, rule.kind, m.start(), m.end()))
    return found


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger as it stands now. Spark takes two reads of one path for the same frame, whatever was appended between
    them, and would let one plan read both from the older listing; the option tells them apart."""
    return spark.read.schema(LEDGER).option("state", uuid.uuid4().hex).parquet(path)


def open_ledger(spark, path: str) -> DataFrame:
    """The ledger at ``path``, begun if there is none."""
    spark.createDataFrame([], LEDGER).coalesce(1).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def scan_versions(versions: DataFrame, ledger: str, paths: Sequence[str] = ("doc_id",), text_col: str = "text",
                  rules: Sequence[Rule] = RULES) -> DataFrame:
    """Each row's path columns, its ``blob`` and its sorted ``spans``, after scanning what ``ledger`` has not seen."""
    spark = versions.sparkSession
    keys = [r.key for r in rules]
    wanted = F.array(*[F.lit(k) for k in keys])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(*paths, F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("__text"))
    seen = (open_ledger(spark, ledger).select("blob", F.explode(F.array_intersect("rules", wanted)).alias("rule"))
            .groupBy("blob").agg(F.collect_set("rule").alias("seen")))
    needed = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    done = seen.where(F.size(needed) == 0).select("blob")
    # copies fold where they are read, so one text of each unseen blob moves; the ledger's rows lie by blob as well
    fresh = rows.select("blob", "__text").join(done, "blob", "left_anti").groupBy("blob").agg(
        F.any_value("__text").alias("__text"))
    fresh = fresh.join(seen, "blob", "left").select("blob", needed.alias("rules"), "__text")
    by_key = {r.key: r for r in rules}

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()),
                                   ("end", pa.int32())]))
        names = ("rule", "kind", "start", "end")
        for batch in batches:
            for part in parts(batch):
                blob, need, texts = part.columns
                found = [[dict(zip(names, f)) for f in scan(t.as_py(), [by_key[k] for k in n.as_py()])]
                         for n, t in zip(need, texts)]
                yield pa.RecordBatch.from_arrays([blob, need, pa.array(found, kind)],
                                                 names=["blob", "rules", "findings"])

    fresh.mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)

    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("f.kind")).cast("int")
    base = F.col("f.kind").isin(*[r.kind for r in rules if r.base])
    found = (read_ledger(spark, ledger).select("blob", F.explode("findings").alias("f"))
             .where(F.col("f.rule").isin(*keys))
             .select("blob", F.struct("f.start", order.alias("ord"), "f.kind", "f.end", base.alias("base")).alias("s"))
             .groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("found")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>")
    spans = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                    s["end"].alias("end"), s["base"].alias("base")))
    return (rows.select(*paths, "blob").join(found, "blob", "left")
            .select(*paths, "blob", F.coalesce(spans, none).alias("spans")))
