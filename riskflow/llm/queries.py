"""The text operators as named queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import (
    bpe, chat, dual_tree, exact_dedup, katz, language, line_rules, mixing, set_join, token_counts, toxicity, turn_repair, weighted_minhash,
)
from riskflow.llm.common import remainder, table, vocabulary_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark, d):
    out = bpe.round_trip(table(spark, d, "documents"), vocabulary_file())
    return out.select("doc_id", bpe.token_count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_language(spark, d):
    docs = table(spark, d, "documents")
    out = language.predict(docs, language.fit(docs, remainder("doc_id", 4) != 2), keep=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op3_mixing(spark, d):
    return mixing.mix_sources(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE["op3_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per)::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM levels WHERE cap >= level * w)) AS target FROM levels),
queued AS (
  SELECT r.*, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY h, r.size, doc_id ROWS UNBOUNDED PRECEDING) AS ends
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
served AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (round * source_size + ends)::DOUBLE / target, h, coalesce(source, ''), round, doc_id
                                       ROWS UNBOUNDED PRECEDING) AS served
  FROM queued, (SELECT unnest([0, 1, 2]) AS round) WHERE size > 0 AND round <= floor(target / source_size)),
copies AS (SELECT doc_id, count(*) AS copies FROM served WHERE served <= (SELECT sum(source_size) FROM per) GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, coalesce(c.copies, 0) AS copies,
       CAST(coalesce(c.copies, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN copies c USING (doc_id)
"""


@query
def op4_token_counts(spark, d):
    coded = bpe.encode(table(spark, d, "documents"), vocabulary_file())
    return token_counts.limits(token_counts.length_histogram(coded.select(bpe.token_count().alias("n_tokens"))))


@query
def op5_katz(spark, d):
    out = katz.score(table(spark, d, "documents"), remainder("doc_id", 5) != 1, order=3)
    return out.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_line_rules(spark, d):
    return line_rules.apply_rules(table(spark, d, "documents")).drop("clean_text")


_PHRASE = "|".join(p.replace(".", r"\.") for p in line_rules.PHRASES)
_DIVIDER = ", ".join(f"'{w.decode()}'" for w in sorted(line_rules.DIVIDERS))
_ENDING = ", ".join("'" + e.decode().replace("'", "''") + "'" for e in line_rules.ENDINGS)
ORACLE["op6_line_rules"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
worded AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS seen
           FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ruled AS (SELECT doc_id, seen, len(words) AS n, CASE
    WHEN 5 * len(list_filter(words, lambda w: w IN ({_DIVIDER}))) > len(words) THEN 'navigation'
    WHEN NOT list_contains([{_ENDING}], right(words[-1], 1)) AND (len(words) < {line_rules.LONG}
         OR len(list_filter(words, lambda w: right(w, 1) IN (',', {_ENDING}))) = 0) THEN 'punctuation'
    WHEN 10 * len(list_filter(words, lambda w: right(w, 2) = '!!' OR right(w, 1) IN ('#', '*', '$', '%', '&', '|', '<', '>'))) > 3 * len(words) THEN 'punctuation'
    WHEN seen OR regexp_matches(lower(line), '{_PHRASE}') THEN 'boilerplate' END AS rule FROM worded),
per AS (SELECT doc_id, count(*) FILTER (seen) AS n_dup_lines, coalesce(sum(n) FILTER (rule IS NOT NULL), 0) AS lost_words,
               count(*) FILTER (rule = 'navigation') AS navigation_lines, count(*) FILTER (rule = 'punctuation') AS punctuation_lines,
               count(*) FILTER (rule = 'boilerplate') AS boilerplate_lines FROM ruled GROUP BY doc_id),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM spots WHERE i + 2 <= len(words)),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM grams WHERE times > 1) GROUP BY doc_id),
counts AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words,
                  coalesce(navigation_lines, 0) AS navigation_lines, coalesce(punctuation_lines, 0) AS punctuation_lines,
                  coalesce(boilerplate_lines, 0) AS boilerplate_lines
           FROM docs LEFT JOIN per USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_words <= n_words AS kept FROM counts
"""


@query
def op7_near_dedup(spark, d):
    return weighted_minhash.near_duplicates(table(spark, d, "documents"), floor=weighted_minhash.FLOOR)


@query
def op8_exact_dedup(spark, d):
    return exact_dedup.duplicate_groups(table(spark, d, "documents")).withColumnRenamed("digest", "text_sha256")


ORACLE["op8_exact_dedup"] = r"""
WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
classes AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM rows JOIN classes USING (content)
"""


@query
def op9_chat(spark, d):
    planted = spark.sql(r"""SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')
                            AS t(conv_id, turn, role, text)""")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.format_conversations(turns))


ORACLE["op9_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(i, r)),
escaped AS (
  SELECT *, length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', 'xx\2\4', 'g')) AS n,
         CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 ELSE 6 END AS marks FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + marks) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op10_toxicity(spark, d):
    docs = table(spark, d, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels"), remainder("doc_id", 4) != 2))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op11_turn_repair(spark, d):
    return turn_repair.audit(turn_repair.repair(turn_repair.damaged(table(spark, d, "conversations")), live="live"))


#: crc32 of ASCII text; then the same search with whole strings in each state: (cost, edits, repaired rows), least first.
ORACLE["op11_turn_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 20 AS kind
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM (
    SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)),
judged AS (
  SELECT *, left(role, 1) AS h, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM rows),
walk AS (
  SELECT c, 0 AS i, {'c': 0::BIGINT, 'a': '', 'r': ''} AS n, {'c': 10000000000, 'a': '', 'r': ''} AS s,
         {'c': 2::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'} AS u, {'c': 4::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS e
  FROM (SELECT DISTINCT c FROM judged)
  UNION ALL
  SELECT c, i, n, s, u2, list_sort([e, {'c': u2.c + 2, 'a': u2.a || 'I', 'r': u2.r || chr(10) || 'assistant:'}])[1] FROM (
    SELECT *, list_sort([u, {'c': n.c + 2, 'a': n.a || 'I', 'r': n.r || chr(10) || 'user:'}, {'c': s.c + 2, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'},
                         {'c': e.c + 2, 'a': e.a || 'I', 'r': e.r || chr(10) || 'user:'}])[1] AS u2 FROM (
      SELECT c, i, n1 AS n, list_sort([s1, {'c': n.c + k + CASE WHEN h = 's' THEN 0 ELSE 10000000000 END, 'a': n.a || 'K', 'r': n.r || t}])[1] AS s,
             list_sort(list_concat([u1], list_transform([n, s, e], lambda x: {'c': x.c + k + CASE WHEN h = 'u' THEN 0 ELSE 10000000000 END, 'a': x.a || 'K', 'r': x.r || t}),
               list_transform([n, s, e], lambda x: {'c': x.c + k + 2, 'a': x.a || 'R', 'r': x.r || chr(10) || 'user:' || text})))[1] AS u,
             list_sort([e1, {'c': u.c + k + CASE WHEN h = 'a' THEN 0 ELSE 10000000000 END, 'a': u.a || 'K', 'r': u.r || t},
                        {'c': u.c + k + 2, 'a': u.a || 'R', 'r': u.r || chr(10) || 'assistant:' || text}])[1] AS e
      FROM (SELECT w.c, j.i, n, s, u, e, j.h, j.text, chr(10) || j.role || ':' || j.text AS t,
                   CASE WHEN j.fault IN ('blank', 'duplicate') THEN 10000000000 WHEN j.fault = 'truncated' THEN 1 ELSE 0 END AS k,
                   {'c': n.c + 3, 'a': n.a || 'D', 'r': n.r} AS n1, {'c': s.c + 3, 'a': s.a || 'D', 'r': s.r} AS s1,
                   {'c': u.c + 3, 'a': u.a || 'D', 'r': u.r} AS u1, {'c': e.c + 3, 'a': e.a || 'D', 'r': e.r} AS e1
            FROM walk w JOIN judged j ON j.c = w.c AND j.i = w.i + 1)))),
ends AS (SELECT c, list_sort([n, e])[1] AS best FROM walk JOIN (SELECT c, max(i) AS i FROM judged GROUP BY c) USING (c, i)),
per AS (
  SELECT c, conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c, conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN per p ON p.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends USING (c)
"""


@query
def op12_ranked_search(spark, d):
    return dual_tree.ranked(table(spark, d, "documents"), table(spark, d, "benchmark"))


ORACLE["op12_ranked_search"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT count(*) FILTER (len(words) > 0) AS n, CAST(sum(len(words)) AS BIGINT) AS l FROM docs),
tf AS (SELECT r, doc_id, term, n, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM docs)
       WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, term, n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM size) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
worth AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * (SELECT n FROM size)) // (SELECT l FROM size)))) AS worth
          FROM tf JOIN w USING (term)),
scored AS (SELECT item_id, r, doc_id, CAST(sum(worth) AS BIGINT) AS score FROM asked JOIN worth USING (term) GROUP BY item_id, r, doc_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10
"""


@query
def op13_set_join(spark, d):
    return set_join.similar_sets(table(spark, d, "documents"))


ORACLE["op13_set_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))) END AS own FROM docs),
nodes AS (SELECT own, min(doc_id) AS node, len(own) AS n FROM sets WHERE len(own) > 0 GROUP BY own),
each AS (SELECT node, n, unnest(own) AS shingle FROM nodes),
pairs AS (SELECT a.node AS u, b.node AS v FROM each a JOIN each b ON a.shingle = b.shingle AND a.node < b.node
          GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT node, node AS to_ FROM nodes UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.to_),
low AS (SELECT node, min(to_) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets s LEFT JOIN nodes n ON s.own = n.own LEFT JOIN low USING (node)
"""
