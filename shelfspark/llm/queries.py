"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import (chatformat, decontaminate, exact, hardneg, kdshard, lines, mixing, neardup, permuterm, pii, substrings,
                            suffixtree, toxicity)
from shelfspark.llm.common import prepare, table

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        Q[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return deco


@register("op1_suffix_tree_lm")
def op1_suffix_tree_lm(spark, sf_dir):
    return suffixtree.report(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM src),
f AS (
  SELECT *, (SELECT sum(source_size) * 1.5::DOUBLE FROM src)
            - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM w),
g AS (SELECT *, cap / w <= room / open_w AS capped FROM f),
lev AS (SELECT arg_min(room / open_w, cap / w) AS level FROM g WHERE NOT capped),
tgt AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * (SELECT level FROM lev) END AS target FROM g),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN tgt ON sized.source IS NOT DISTINCT FROM tgt.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@register("op2_source_mixing", MIX_SQL)
def op2_source_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT *, len(regexp_extract_all(text,
    '<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*\|user\|>|<\\*\|assistant\|>|<\\*\|system\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')) AS n_control
  FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + n_control + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@register("op4_chat_format", CHAT_SQL)
def op4_chat_format(spark, sf_dir):
    return chatformat.report(table(spark, sf_dir, "conversations"))


@register("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    return neardup.report(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (k) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
runs AS (
  SELECT doc_id, count(DISTINCT g) AS n_repeats
  FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(t, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS s
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256, CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_repeats
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


@register("op6_substring_dedup", SUBSTRING_SQL)
def op6_substring_dedup(spark, sf_dir):
    return substrings.report(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER p AS keep_id, count(*) OVER p AS group_size,
       doc_id = min(doc_id) OVER p AS kept, text_sha256
FROM n WINDOW p AS (PARTITION BY text_sha256)
"""


@register("op7_exact_dedup", EXACT_SQL)
def op7_exact_dedup(spark, sf_dir):
    return exact.report(table(spark, sf_dir, "documents"))


@register("op8_contextual_pii")
def op8_contextual_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 5))::BIGINT AS h FROM x),
r AS (SELECT *, h % 2 = 0 AS cut FROM h),
c AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM r),
chunk AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM c GROUP BY doc_id, pos),
rep AS (
  SELECT *, n >= 2 AND regexp_matches(body, '[^\x20\x09-\x0D]') AS multi,
         row_number() OVER (PARTITION BY body, n ORDER BY doc_id, pos) > 1 AS again
  FROM chunk),
run AS (
  SELECT *, CASE WHEN again THEN pos - row_number() OVER (PARTITION BY doc_id, again ORDER BY pos) END AS run FROM rep),
gone AS (SELECT *, again AND bool_or(multi) OVER (PARTITION BY doc_id, again, run) AS gone FROM run)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM gone GROUP BY doc_id
"""


@register("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS k
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY doc_id),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
runs AS (
  SELECT doc_id, max(c) AS longest FROM (
    SELECT doc_id, g, count(*) AS c FROM (
      SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g
      FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit))) GROUP BY doc_id, g)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


@register("op10_decontaminate", DECONTAMINATE_SQL)
def op10_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op11_kd_shards")
def op11_kd_shards(spark, sf_dir):
    return kdshard.report(table(spark, sf_dir, "documents"))


@register("op12_permuterm_variants")
def op12_permuterm_variants(spark, sf_dir):
    return permuterm.report(table(spark, sf_dir, "documents"))


HARD_NEGATIVE_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


@register("op13_hard_negatives", HARD_NEGATIVE_SQL)
def op13_hard_negatives(spark, sf_dir):
    return hardneg.report(table(spark, sf_dir, "embeddings"))
