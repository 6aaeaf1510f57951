"""The queries of this subpackage and the DuckDB SQL that some of them are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import bpe, chat_format, cws, decontaminate, hpylm, line_dedup, quality, sharding, simhash, url_filter
from sentrel.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_, 'abcdefghijklmnopqrstuvwxyz' AS lower_),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper_, lower_), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper_, lower_), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM pos, sizes WHERE i + n - 1 <= len(w)),
occ AS (SELECT doc_id, i, grams.n AS n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{extra}'), (-7L, 1L, 'assistant', '{extra}') AS t(conv_id, turn, role, text)"))
    done = chat_format.format_chat(rows)
    read = done.select("conv_id", chat_format.read_chat(F.col("formatted")).alias("turns"), F.array_join(chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')) AS te,
  length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')) AS re,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (11 + sum(te + CASE WHEN before = role THEN 10 ELSE 22 + re + CASE WHEN before IS NULL THEN 0 ELSE 11 END END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS pos FROM l),
w AS (SELECT doc_id, pos, ls[pos] AS line, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS words FROM p),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
ahead AS (SELECT a.doc_id, a.pos AS lo, min(b.pos) AS hi FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.pos) AS lo, b.pos AS hi FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 50 GROUP BY ALL),
runs AS (SELECT DISTINCT r.doc_id, lo, hi, array_to_string(ls[lo:hi], chr(10)) AS run FROM (SELECT * FROM ahead UNION SELECT * FROM back) r JOIN l USING (doc_id)),
later AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS pos FROM later)
SELECT l.doc_id, len(any_value(ls)) AS n_lines, count(gone.pos) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY w.pos) FILTER (gone.pos IS NULL), '')) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY w.pos) FILTER (gone.pos IS NULL), '')) AS kept_sha256
FROM l JOIN w ON l.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos GROUP BY l.doc_id
"""


#: The rules that the url query applies: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


#: Levels of the path tree that the SQL unrolls; the operator itself goes as deep as the paths do.
SQL_LEVELS = 8


def _z_sql(b1: str, m1: str, b2: str, m2: str) -> str:
    pooled = f"(({b1} + {b2}) / nullif({m1} + {m2}, 0)::DOUBLE)"
    return f"(({b1} / nullif({m1}, 0)::DOUBLE - {b2} / nullif({m2}, 0)::DOUBLE) / nullif(sqrt({pooled} * (1 - {pooled}) * (1.0::DOUBLE / nullif({m1}, 0) + 1.0::DOUBLE / nullif({m2}, 0))), 0))"


def _op8_sql() -> str:
    """The template tree in SQL, one step a level."""
    u, d = url_filter, "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN" for h, p, _ in ordered]
    steps = [rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {d}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True))} END AS rule, CASE {" ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True))} END AS said FROM u),
p AS (SELECT host, path, count(*) FILTER (said = 'block') AS b, count(*) FILTER (said = 'allow') AS a, count(*) AS n FROM r GROUP BY ALL),
rate AS (SELECT coalesce(sum(b) / nullif(sum(a + b), 0), 0) AS rate FROM p),
t0 AS (SELECT *, string_split(CASE WHEN starts_with(path, '/') THEN substr(path, 2) ELSE path END, '/') AS segments, CAST([] AS VARCHAR[]) AS template, '' AS node FROM p)"""]
    for k in range(SQL_LEVELS):
        own = _z_sql("b", "(a + b)", "(all_b - b)", "(all_m - a - b)")
        steps.append(f"""s{k} AS (SELECT *, segments[{k + 1}] AS seg FROM t{k}),
o{k} AS (SELECT host, node, seg, sum(n) AS n, sum(b) AS b, sum(a) AS a FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
w{k} AS (SELECT *, sum(n) OVER h AS every, sum(b) OVER h AS all_b, sum(a + b) OVER h AS all_m FROM o{k} WINDOW h AS (PARTITION BY host, node)),
g{k} AS (SELECT *, CASE WHEN n > 1 AND (n * {u.SHARE} >= every OR n >= {u.SUPPORT} OR a + b >= {u.LABELLED} AND coalesce(abs({own}) >= {u.OWN}, false)) THEN '=' || seg ELSE '*' END AS grown FROM w{k}),
b{k} AS (SELECT host, node, grown, sum(b) AS b, sum(a + b) AS m, (sum(b) + 0.5::DOUBLE) / (sum(a + b) + 1) AS rate FROM g{k} GROUP BY ALL),
l{k} AS (SELECT *, lag(b) OVER v AS pb, lag(m) OVER v AS pm FROM b{k} WINDOW v AS (PARTITION BY host, node ORDER BY rate, grown)),
c{k} AS (SELECT host, node, grown, sum(CASE WHEN {_z_sql("b", "m", "pb", "pm")} >= {u.LIKE} THEN 1 ELSE 0 END) OVER (PARTITION BY host, node ORDER BY rate, grown) AS cluster FROM l{k}),
t{k + 1} AS (SELECT s.host, s.path, s.b, s.a, s.n, s.segments, CASE WHEN s.seg IS NULL THEN s.template ELSE list_append(s.template, g.grown) END AS template, CASE WHEN s.seg IS NULL THEN s.node ELSE s.node || '/' || c.cluster END AS node
  FROM s{k} s LEFT JOIN g{k} g ON s.host = g.host AND s.node = g.node AND s.seg = g.seg LEFT JOIN c{k} c ON g.host = c.host AND g.node = c.node AND g.grown = c.grown)""")
    steps.append(f"""pure AS (SELECT host, node, sum(b) AS tb, (sum(b) + {u.PRIOR} * any_value(rate)) / (sum(b) + sum(a) + {u.PRIOR}) AS purity FROM t{SQL_LEVELS}, rate GROUP BY host, node),
j AS (SELECT t.host, t.path, '/' || array_to_string(list_transform(template, lambda s: CASE WHEN starts_with(s, '=') THEN substr(s, 2) ELSE s END), '/') AS template, tb, purity FROM t{SQL_LEVELS} t JOIN pure ON t.host = pure.host AND t.node = pure.node)
SELECT page_id, r.host, r.path, rule, coalesce(said, CASE WHEN purity > 0.5 AND tb > 0 THEN 'block' ELSE 'allow' END) AS verdict, template, purity::DOUBLE AS purity FROM r JOIN j ON r.host = j.host AND r.path = j.path""")
    return ",\n".join(steps)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_lm_score": op4_lm_score,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_weighted_sampling": op10_weighted_sampling,
}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op5_chat": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_url_filter": _op8_sql()}
