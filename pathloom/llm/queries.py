"""Registered queries of the text operators, each over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import (align, bpe, decontaminate, fingerprints, neardup, pii, quality, repair, secrets,
                          shards, tokencount, topk, urlfilter)
from pathloom.llm.common import fresh_path, span_digest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 24


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document, by a ledger that has seen nothing yet. The table comes in two instalments: what the second
    shares with the first is not scanned again."""
    docs, ledger = table(spark, sf, "documents"), fresh_path(spark, "ledger")
    instalment = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    first, second = (secrets.scan_versions(docs.where(instalment == i), ledger) for i in (0, 1))
    return first.unionByName(second).select("doc_id", *span_digest("spans", secrets.BASE_KINDS))


@query
def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf, "documents"))
    return found.select("doc_id", *span_digest("spans", pii.KINDS))


@query
def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf, "documents"), RANKS)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
                        .alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op5_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf, "documents"), PIECES)


@query
def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), neardup.Rule(3, 85))


@query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    # the anchors stand in the fingerprints
    return fingerprints.fingerprint_edits(table(spark, sf, "documents")).drop("anchors", "edited_anchors")


@query
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def _number(key, salt: str):
    """A number from 0 to 2^32 that a key and a salt fix."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of capture in two years; a page's id fixes it."""
    day = (_number(F.col("page_id"), "day") % 730).cast("int")
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2023-01-01")), day).alias("fetch_date"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and first path steps the pages have: each key is blocked, allowed or
    cleared on up to four days that its name fixes, so the list grows with the pages."""
    host, path = urlfilter.url_parts(F.col("url"))
    keys = (pages.where("url IS NOT NULL").select(host.alias("host"), path.alias("path")).distinct()
            .select(F.explode(F.array_distinct(F.array(
                F.col("host"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1),
                F.concat("host", F.lit("/"), F.regexp_extract("path", r"^/([^/]*)", 1))))).alias("key"))
            .where("key != '' AND key NOT LIKE '%/'").distinct())
    turns = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    own = F.concat_ws("#", "key", "turn")
    return turns.where(_number(own, "use") % 2 == 0).select(
        "key", F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("clear")),
                            (_number(own, "action") % 3 + 1).cast("int")).alias("action"),
        F.date_add(F.to_date(F.lit("2022-10-01")), (_number(own, "date") % 800).cast("int")).alias("entry_date"))


@query
def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return urlfilter.filter_urls(captures(pages), list_entries(pages)).select(
        "page_id", "url", F.col("fetch_date").cast("string").alias("fetch_date"), "action", "matched_key",
        F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query
def op11_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best inner products of every hundredth vector among all others."""
    return topk.search_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    aligned = align.align_texts(table(spark, sf, "documents"), BYTE_LEVEL, PIECES)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return align.with_counts(aligned.withColumn("groups", digest)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query
def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf, "conversations"))).verdicts


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def _span_sql(kind: str, pattern: str, keep: str) -> str:
    """Rows (doc_id, kind, a, e) of the matches of a pattern, placed by the lengths of what lies between them."""
    return f"""SELECT r, '{kind}' AS kind, s AS a, s + length(m) AS e FROM (
        SELECT r, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM (
          SELECT r, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS gs FROM d))
        WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {keep}"""


_ASSIGN = """'((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_SECRET_KINDS = [
    ("assign", _ASSIGN, f"length(regexp_extract(m, {_ASSIGN}, 2)) >= 6"),
    ("access", "'AKIA[A-Z0-9]+'", "length(m) >= 20"),
    ("hex", "'[0-9a-f]+'", "length(m) >= 24"),
    ("pem", "'-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'", "true"),
]
TWINS["op1_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_span_sql(*k) for k in _SECRET_KINDS)}
  UNION ALL {_span_sql("github", "'[A-Za-z0-9_]+'", "regexp_full_match(m, 'gh[pousr]_[A-Za-z0-9]{36,}.*')")}),
o AS (SELECT r, kind, CAST(a AS BIGINT) AS a,
    CAST(CASE WHEN kind = 'github' THEN a + length(regexp_extract((SELECT substr(t, CAST(a AS BIGINT) + 1) FROM d
      WHERE d.r = s.r), '^gh[pousr]_[A-Za-z0-9]{{36,}}')) ELSE e END AS BIGINT) AS e,
    list_position(['assign', 'access', 'hex', 'pem', 'github'], kind) AS k FROM s),
j AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (k <= 3) AS base,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)
"""

TWINS["op5_shards"] = f"""
WITH RECURSIVE table_of AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM documents),
f AS (SELECT doc_id, octet_length(raw) + 8 AS size, CAST(h % {shards.SLOTS} AS INT) AS vslot,
  (h // {shards.SLOTS}) % {shards.FINE} AS fine,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(raw)),
    lambda i: ('0x' || substr(hex(raw), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, table_of),
w AS (SELECT vslot, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, vslot) AS o
  FROM f GROUP BY vslot),
lpt AS (SELECT 0::BIGINT AS o, [0::BIGINT FOR i IN range({SHARDS})] AS loads, 0::BIGINT AS shard
  UNION ALL SELECT l.o + 1, [x + CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN w.bytes ELSE 0 END
    FOR x, i IN l.loads], list_position(l.loads, list_min(l.loads)) - 1
  FROM lpt l JOIN w ON w.o = l.o + 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law,
  CAST(lpt.shard AS INT) AS shard, row_number() OVER (PARTITION BY lpt.shard
    ORDER BY vslot, fine, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard
FROM f JOIN w USING (vslot) JOIN lpt ON lpt.o = w.o
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
TWINS["op9_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item, len(p) AS n, array_to_string(p, ' ') AS p FROM (
  SELECT item, w[i:i + least(13, len(w)) - 1] AS p FROM (
    SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
laid AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, laid.n, item FROM laid JOIN win USING (p)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def _n(key: str, salt: str) -> str:
    return f"('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '') || '{salt}'), 1, 8))::BIGINT"


TWINS["op10_url_filter"] = f"""
WITH p AS (SELECT page_id, url, DATE '2023-01-01' + CAST({_n('page_id', 'day')} % 730 AS INT) AS fetch_date,
  rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/:?#@]+)', 2)), '.') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path FROM pages),
keys AS (SELECT DISTINCT key FROM (SELECT unnest([host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1),
  host || '/' || regexp_extract(path, '^/([^/]*)', 1)]) AS key FROM p WHERE url IS NOT NULL)
  WHERE key != '' AND key NOT LIKE '%/'),
turns AS (SELECT key, key || '#' || t AS own FROM keys, range(4) x(t)),
entries AS (SELECT key, DATE '2022-10-01' + CAST({_n('own', 'date')} % 800 AS INT) AS day,
  max(CASE {_n('own', 'action')} % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS weight
  FROM turns WHERE {_n('own', 'use')} % 2 = 0 GROUP BY ALL),
turned AS (SELECT * FROM (SELECT *, lag(weight) OVER (PARTITION BY key ORDER BY day) AS was FROM entries)
  WHERE was IS NULL OR was != weight),
valid AS (SELECT key, day AS valid_from, lead(day) OVER (PARTITION BY key ORDER BY day) AS valid_to, weight FROM turned),
cover AS (SELECT page_id, url, fetch_date, unnest(
    CASE WHEN regexp_full_match(host, '[0-9]+([.][0-9]+)*|\\[.*') THEN [host]
      ELSE [array_to_string(l[i:], '.') FOR i IN range(1, greatest(len(l) - 1, 1) + 1)] END
    || [host || '/' || array_to_string(s[:i], '/') FOR i IN range(1, len(s) + 1)]) AS key
  FROM (SELECT DISTINCT page_id, url, fetch_date, host, string_split(host, '.') AS l,
    [x FOR x IN string_split(path, '/') IF x != ''] AS s FROM p WHERE host != '')),
best AS (SELECT page_id, url, fetch_date, max_by(struct_pack(k := key, w := weight, f := valid_from, t := valid_to),
    struct_pack(n := length(key), k := key)) AS b
  FROM cover JOIN valid USING (key)
  WHERE weight > 0 AND valid_from <= fetch_date AND (valid_to IS NULL OR fetch_date < valid_to) GROUP BY ALL)
SELECT p.page_id, p.url, CAST(p.fetch_date AS VARCHAR) AS fetch_date,
  CASE b.w WHEN 2 THEN 'block' WHEN 1 THEN 'allow' END AS action, b.k AS matched_key,
  CAST(b.f AS VARCHAR) AS valid_from, CAST(b.t AS VARCHAR) AS valid_to
FROM p LEFT JOIN best ON p.page_id IS NOT DISTINCT FROM best.page_id AND p.url = best.url
  AND p.fetch_date = best.fetch_date
"""

TWINS["op11_top_k"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r != c.r)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""


def _more(state: str, cost: str, letter: str) -> str:
    """A way to a state with one more edit."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 's': {state}.s || '{letter}'}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


# the cheapest and ASCII-least edits to each state (nothing yet, s, u, a) after each row; inserts come before a row
_INSERTED = f"""SELECT *, b0 AS e0, b1 AS e1,
    {_least('b2', *[_more(b, '5', 'I') for b in ('b0', 'b1', 'b3')])} AS e2,
    {_least('b3', _more('b2', '5', 'I'), _more('b0', '10', 'II'), _more('b1', '10', 'II'))} AS e3"""
_KEPT = "CASE WHEN o.c = '{}' THEN {} END"
_SOUND = "CASE WHEN o.fault NOT IN ('blank', 'duplicate') THEN {} END"
_M = "(CASE WHEN o.fault = 'truncated' THEN 5 ELSE 0 END)"
TWINS["op13_conversations"] = f"""
WITH RECURSIVE table_of AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS raw FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(length(raw) // 2), lambda i: ('0x' || substr(raw, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM k, table_of),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN ''
    WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
  FROM (SELECT *, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS n FROM h WHERE how != 0)),
o AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN said > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS said FROM d)),
step AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 's': ''}} AS b0, CAST(NULL AS STRUCT(c BIGINT, s VARCHAR)) AS b1,
    CAST(NULL AS STRUCT(c BIGINT, s VARCHAR)) AS b2, CAST(NULL AS STRUCT(c BIGINT, s VARCHAR)) AS b3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, b0, b1, b2, b3 FROM (SELECT e.conv_id, o.i, {_more('e0', '2', 'D')} AS b0,
      {_least(_more('e1', '2', 'D'), _SOUND.format(_KEPT.format('s', _more('e0', _M, 'K'))))} AS b1,
      {_least(_more('e2', '2', 'D'), *[_SOUND.format(x) for e in ('e0', 'e1', 'e3')
              for x in (_KEPT.format('u', _more(e, _M, 'K')), _more(e, '1 + ' + _M, 'R'))])} AS b2,
      {_least(_more('e3', '2', 'D'), *[_SOUND.format(x) for x in
              (_KEPT.format('a', _more('e2', _M, 'K')), _more('e2', '1 + ' + _M, 'R'))])} AS b3
    FROM ({_INSERTED} FROM step) e JOIN o ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.i = e.i + 1)),
best AS (SELECT conv_id, {_least('e0', 'e3')} AS way FROM ({_INSERTED} FROM step)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
edits AS (SELECT conv_id, p, letter, CAST(sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS BIGINT) AS i
  FROM (SELECT conv_id, unnest(range(1, length(way.s) + 1)) AS p, way.s[p] AS letter FROM best)),
kept AS (SELECT e.conv_id, e.letter, o.role, o.text, o.c, row_number() OVER w AS j,
    first_value(e.letter = 'K' AND o.c = 's') OVER w AS led
  FROM edits e LEFT JOIN o ON e.letter != 'I' AND o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.i = e.i
  WHERE e.letter != 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY e.p)),
said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
    ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS all_of FROM kept GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o) GROUP BY 1)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.c AS cost, way.s AS audit,
  sha256(coalesce(all_of, '')) AS repaired_sha256
FROM best LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id
  LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM best.conv_id
"""
