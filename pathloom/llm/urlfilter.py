"""URL filters with dated lists: every capture is held against the entries in force on the day it was fetched.

A list is a table of dated entries (key, action, entry_date), where a key is a domain, a host or a host with the
beginning of a path, and the action is ``block``, ``allow`` or ``clear``. Entries of a key become intervals, each in
force until the next entry of that key. A capture looks up all keys that cover it and takes the action of the longest
key in force on its day.

Intervals and captures meet by key and by spans of ``SPAN_DAYS`` days. As a key has one state a day, a capture meets
at most that many intervals per key, and however many captures one host has, they can be split over tasks.

Defined results: entries or captures without key, url or date match nothing; of entries for one key and day, block
goes before allow and allow before clear; repeated captures come back as often as they went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_DAYS = 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case without user, port and final dots, and path without query and fragment."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)", 2)
    host = F.rtrim(F.lower(host), F.lit("."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return host, path


def covering_keys(host: Column, path: Column) -> Column:
    """Every key that covers a URL: its host's domains of two labels or more, and the host with each path prefix. An
    address of numbers has no domains but itself."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = F.when(host.rlike(r"^([0-9]+(\.[0-9]+)*|\[.*)$"), F.array(host)).otherwise(domains)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps)))
                           .otherwise(F.array().cast("array<int>")),
                           lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (open: null) of the entries in force; one state per key and day."""
    weight = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    daily = (entries.where("key IS NOT NULL AND entry_date IS NOT NULL")
             .groupBy("key", "entry_date").agg(F.max(weight).alias("weight")))
    by_key = Window.partitionBy("key").orderBy("entry_date")  # one row a day at most
    changed = daily.withColumn("was", F.lag("weight").over(by_key)).where("was IS NULL OR was != weight")
    return changed.select(
        "key", F.when(F.col("weight") == 2, "block").when(F.col("weight") == 1, "allow").alias("action"),
        F.col("entry_date").alias("valid_from"), F.lead("entry_date").over(by_key).alias("valid_to")) \
        .where("action IS NOT NULL")


def _span(day: Column) -> Column:
    return F.floor(F.unix_date(day) / SPAN_DAYS)


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                date_col: str = "fetch_date") -> DataFrame:
    """Each capture with ``action`` (null: no entry in force), ``matched_key`` and that entry's interval."""
    rows = captures.select(id_col, url_col, date_col)
    host, path = url_parts(F.col(url_col))
    looked = (rows.where(F.col(url_col).isNotNull() & F.col(date_col).isNotNull()).distinct()
              .withColumn("key", F.explode(covering_keys(host, path))).withColumn("span", _span(F.col(date_col))))
    horizon = rows.agg(F.max(date_col)).first()[0]  # open intervals need no spans beyond the last capture
    end = F.coalesce(F.least(F.date_sub("valid_to", 1), F.lit(horizon)), F.lit(horizon))
    valid = (intervals(entries).where(F.col("valid_from") <= F.lit(horizon))
             .withColumn("span", F.explode(F.sequence(_span(F.col("valid_from")), _span(end)))))
    hits = looked.join(valid, ["key", "span"]).where(
        (F.col("valid_from") <= F.col(date_col)) & (F.col("valid_to").isNull() | (F.col(date_col) < F.col("valid_to"))))
    best = hits.groupBy(id_col, url_col, date_col).agg(F.max(F.struct(
        F.char_length("key").alias("length"), F.col("key").alias("matched_key"), "action", "valid_from",
        "valid_to")).alias("best"))
    verdict = best.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(date_col).alias("__day"),
                          "best")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(url_col) == F.col("__url")) \
        & (F.col(date_col) == F.col("__day"))
    return rows.join(verdict, same, "left").select(id_col, url_col, date_col, "best.action", "best.matched_key",
                                                   "best.valid_from", "best.valid_to")
