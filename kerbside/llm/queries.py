"""Registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import (
    ann_forest,
    byte_bpe,
    context_trees,
    divergence,
    epsilon_join,
    language,
    mixing,
    near_dups,
    page_text,
    secrets,
    suffix_dedup,
    toxicity,
    turns,
)
from kerbside.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.secret_digests(docs, secrets.fit(docs))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op3_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(table(spark, folder, "pages"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return byte_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN)


def op5_suffix_sort(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_context_trees(spark: SparkSession, folder: str) -> DataFrame:
    return context_trees.score_documents(table(spark, folder, "documents"))


def op8_epsilon_join(spark: SparkSession, folder: str) -> DataFrame:
    return epsilon_join.near_vectors(table(spark, folder, "embeddings"))


def op9_ann_forest(spark: SparkSession, folder: str) -> DataFrame:
    return ann_forest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op11_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair_digests(table(spark, folder, "conversations"))


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.fit(docs))


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


REGISTRY = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_page_text": op3_page_text,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_sort": op5_suffix_sort,
    "op6_minhash": op6_minhash,
    "op7_context_trees": op7_context_trees,
    "op8_epsilon_join": op8_epsilon_join,
    "op9_ann_forest": op9_ann_forest,
    "op10_toxicity": op10_toxicity,
    "op11_turns": op11_turns,
    "op12_language": op12_language,
    "op13_divergence": op13_divergence,
}

#: Every block is a row here, and the highest quotients win one by one.
_OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 3 * source_size AS stop, row_number() OVER (ORDER BY source IS NULL, source) AS nr,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight,
         sum(source_size) OVER () AS total
  FROM per_source
), filling AS (
  SELECT *, coalesce(sum(stop) OVER before, 0)::BIGINT AS full_stop,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS rest_weight
  FROM weighted
  WINDOW before AS (ORDER BY stop / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total::BIGINT - full_stop) / rest_weight AS level FROM filling
), shares AS (
  SELECT *, stop <= weight * level AS is_full,
         max(level) FILTER (WHERE stop > weight * level) OVER () AS final FROM levels
), targets AS (
  SELECT source, nr, source_size, stop, is_full,
         CASE WHEN is_full THEN stop::DOUBLE ELSE least(weight * final, stop::DOUBLE) END AS target
  FROM shares
), quotients AS (
  SELECT nr, target / (2 * unnest(range(0, ceil(target / 8 * 1.5)::BIGINT + 100)) + 1) AS quotient
  FROM targets WHERE NOT is_full AND target > 0
), seats AS (
  SELECT nr, row_number() OVER (ORDER BY quotient DESC, nr) AS place FROM quotients
), won AS (
  SELECT nr, count(*) AS blocks FROM seats
  WHERE place <= (SELECT round(sum(target) / 8) FROM targets WHERE NOT is_full AND target > 0) GROUP BY nr
), plan AS (
  SELECT t.source, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 WHEN is_full THEN stop
              ELSE least(8 * coalesce(blocks, 0), stop) END::BIGINT AS words,
         CASE WHEN t.source_size = 0 THEN 0
              ELSE ('0x' || substr(md5(concat_ws(':', '7', t.source)), 1, 15))::BIGINT % t.source_size
         END AS run_start
  FROM targets t LEFT JOIN won USING (nr)
), placed AS (
  SELECT s.*, p.source_size, p.target, p.run_start,
         CASE WHEN p.source_size = 0 THEN 0 ELSE words // p.source_size END AS rounds,
         CASE WHEN p.source_size = 0 THEN 0 ELSE words % p.source_size END AS run,
         coalesce(sum(size) OVER (PARTITION BY s.source
           ORDER BY md5(concat_ws(':', '7', doc_id, size)), doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), pieces AS (
  SELECT *, greatest(least(o + size, run_start + run, source_size) - greatest(o, run_start), 0) AS count,
         greatest(least(o + size, run_start + run - source_size) - o, 0) AS count2
  FROM placed
)
SELECT doc_id, size, source_size, target, (rounds * size + count + count2)::BIGINT AS taken,
       rounds::BIGINT AS rounds,
       (CASE WHEN count > 0 THEN greatest(o, run_start) - o ELSE 0 END)::BIGINT AS first,
       count::BIGINT AS count, count2::BIGINT AS count2
FROM pieces
"""

#: The cheapest edits row by row, as a recursion over (row, state); crc32 has no function and is made here.
_OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY b) AS t
  FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
        FROM range(256) r(b))
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                        lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations
), diced AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], bytes),
                  lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS fault
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM diced WHERE fault <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
  FROM damaged
), faulty AS (
  SELECT *, ending = '' AS blank,
         ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         left(role, 1) AS initial,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM ordered
), marked AS (
  SELECT *, NOT blank AND NOT duplicate AND ending NOT IN ('.', '!', '?') AS truncated FROM faulty
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), moves AS (
  -- from state q (nothing, system, user, assistant) by inserts and one edit of a row
  SELECT * FROM (VALUES
    (0, '', 0, 0), (0, 'I', 2, 5), (0, 'II', 3, 10), (1, '', 1, 0), (1, 'I', 2, 5), (1, 'II', 3, 10),
    (2, '', 2, 0), (2, 'I', 3, 5), (2, 'II', 2, 10), (3, '', 3, 0), (3, 'I', 2, 5), (3, 'II', 3, 10)
  ) m(q, inserts, mid, cost)
), fits AS (
  SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) f(q, goes_to, name)
), inserted AS (
  SELECT m.*, CASE inserts WHEN '' THEN []::VARCHAR[] WHEN 'I' THEN [a.name || ':']
                ELSE [a.name || ':', b.name || ':'] END AS lines
  FROM moves m JOIN fits a ON a.q = m.q JOIN fits b ON b.q = a.goes_to
), kept AS (
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) k(q, initial, goes_to)
), edits AS (
  SELECT conv_id, i, q, 'D' AS letter, q AS goes_to, 2 AS cost, []::VARCHAR[] AS lines FROM marked, (SELECT DISTINCT q FROM fits)
  UNION ALL
  SELECT conv_id, i, q, 'K', goes_to, CASE WHEN truncated THEN 5 ELSE 0 END, [role || ':' || text]
  FROM marked JOIN kept USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL
  SELECT conv_id, i, q, 'R', goes_to, CASE WHEN truncated THEN 6 ELSE 1 END, [name || ':' || text]
  FROM marked, fits WHERE NOT blank AND NOT duplicate
), steps AS (
  SELECT e.conv_id, e.i, s.q, s.inserts || e.letter AS letters, e.goes_to, s.cost + e.cost AS cost,
         list_concat(s.lines, e.lines) AS lines
  FROM edits e JOIN inserted s ON e.q = s.mid
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counted
  UNION ALL
  SELECT p.conv_id, s.i, s.goes_to,
         min({'cost': p.best.cost + s.cost, 'audit': p.best.audit || s.letters,
              'lines': list_concat(p.best.lines, s.lines)})
  FROM paths p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1 AND s.q = p.q
  GROUP BY p.conv_id, s.i, s.goes_to
), ended AS (
  SELECT p.conv_id, min({'cost': p.best.cost + s.cost, 'audit': p.best.audit || s.inserts,
                         'lines': list_concat(p.best.lines, s.lines)}) AS best
  FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
  JOIN inserted s ON s.q = p.q AND s.mid IN (0, 3)
  GROUP BY p.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
       coalesce(e.best.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

#: Every kept term meets every group of its language here, whether it occurs there or not.
_OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT nr, lang, source,
         unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT nr) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL
), groups AS (
  SELECT d.lang, d.source, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN totals t USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.terms))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.terms))::BIGINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES: dict[str, str] = {"op2_mixing": _OP2_SQL, "op11_turns": _OP11_SQL, "op13_divergence": _OP13_SQL}
