"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm.collocations import collocations
from vellumspark.llm.common import table
from vellumspark.llm.convtrie import grafted, placed, prefix_trie
from vellumspark.llm.decontaminate import contamination
from vellumspark.llm.html import html_text
from vellumspark.llm.mixing import mix_sources
from vellumspark.llm.ngramjoin import ngram_components
from vellumspark.llm.pii import personal_data
from vellumspark.llm.quality import RULES, STOP_WORDS, quality_rules
from vellumspark.llm.spm import encode
from vellumspark.llm.tokenbinary import training_order
from vellumspark.llm.tokencount import token_counts
from vellumspark.llm.topk import exact_top_k
from vellumspark.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(grafted(placed(table(spark, sf_dir, "conversations"))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_personal_data": op2_personal_data,
        "op3_token_counts": op3_token_counts,
        "op4_quality_rules": op4_quality_rules,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_toxicity": op7_toxicity,
        "op8_mix_sources": op8_mix_sources,
        "op9_training_order": op9_training_order,
        "op10_html_text": op10_html_text,
        "op11_collocations": op11_collocations,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_decontamination": op13_decontamination,
    }


def _quality_sql() -> str:
    """The metrics counted by unnesting, apart from how the Spark expressions count them."""
    forms = dict.fromkeys(STOP_WORDS + [w.capitalize() for w in STOP_WORDS] + [w.upper() for w in STOP_WORDS])
    stop = ", ".join(f"'{w}'" for w in forms)
    sides = [s for r in RULES for s in (None if r.low is None else f"{r.metric} >= {r.low}", None if r.high is None else f"{r.metric} <= {r.high}") if s]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(list_distinct(ws), lambda x: list_contains([{stop}], x))) AS n_stop_words, len(list_filter(ws, lambda x: list_contains([{stop}], x))) AS n_stops, len(ls) AS n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣]'))) AS n_bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_ellipses
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
q AS (SELECT *, CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(word_chars AS DOUBLE) / n_words END AS mean_word_chars,
             CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(n_stops AS DOUBLE) / n_words END AS stop_words_per_word,
             CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(n_symbols AS DOUBLE) / n_words END AS symbols_per_word,
             CASE WHEN n_lines = 0 THEN 0.0 ELSE CAST(n_dup_lines AS DOUBLE) / n_lines END AS dup_line_ratio,
             CASE WHEN n_lines = 0 THEN 0.0 ELSE CAST(n_bullets AS DOUBLE) / n_lines END AS bullet_line_ratio,
             CASE WHEN n_lines = 0 THEN 0.0 ELSE CAST(n_ellipses AS DOUBLE) / n_lines END AS ellipsis_line_ratio,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(sides)} AS kept FROM q"""


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


#: Every pair that shares a shingle is counted, and components are a transitive closure.
JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.o >= 75 * (x.n + y.n - p.o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n"""


#: Phrases counted as strings, all cuts of each scored in 128-bit integers.
PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
q AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM p)),
g AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM q)),
f1 AS (SELECT lang, x, count(*) AS a FROM g GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS a FROM g WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS a FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
u AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, 1 AS k, f2.a, l.a AS l, r.a AS r FROM f2 JOIN f1 AS l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 AS r ON r.lang = f2.lang AND r.x = f2.y
  WHERE f2.a >= 10 AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.x = f2.x AND f3.y = f2.y AND 100 * f3.a >= 50 * f2.a) AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.y = f2.x AND f3.z = f2.y AND 100 * f3.a >= 50 * f2.a)
 UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 1, f3.a, l.a, r.a FROM f3 JOIN f1 AS l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 AS r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
 UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 2, f3.a, l.a, r.a FROM f3 JOIN f2 AS l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 AS r ON r.lang = f3.lang AND r.x = f3.z),
v AS (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM u),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS t FROM v) WHERE t = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT o.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""


#: Prefixes as lists of turns; the checksum is folded bit by bit. A node is the group of the rebuilt conversations' first d turns.
TRIE_SQL = r"""
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT conv_id, ts, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END) AS c FROM t),
h AS (SELECT conv_id, ts, CAST(xor(c, CAST(4294967295 AS BIGINT)) % 9 AS INTEGER) AS h FROM b),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(g.ts, 1, h.h), []), list_slice(h.ts, h.h + 1, len(h.ts))) AS ts FROM h LEFT JOIN t AS g ON g.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(ts) AS n, d, list_slice(ts, 1, d) AS pre, CASE WHEN d > 0 THEN list_slice(ts, 1, d - 1) END AS up, CASE WHEN d > 0 THEN strlen(ts[d].text) ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT pre, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) > any_value(d) AS inner_, (count(*) - 1) * any_value(size) AS own,
  coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM p GROUP BY pre),
k AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT list_slice(pre, 1, e) AS pre, sum(CASE WHEN inner_ THEN 0 ELSE 1 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM n) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN a ON a.pre = n.pre LEFT JOIN k ON k.up = n.pre LEFT JOIN n AS u ON u.pre = n.up"""


#: Windows joined as strings; a document's word is hit if one of the windows over it occurs.
LEAK_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(list_slice(ws, i, i + 9), ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM iw WHERE len(ws) > 0)),
s AS (SELECT DISTINCT k FROM w),
p AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, s WHERE len(ws) >= k)),
h AS (SELECT p.doc_id, p.i, p.k, w.item_id FROM p JOIN w ON p.k = w.k AND p.g = w.g),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": TOP_K_SQL,
        "op4_quality_rules": _quality_sql(),
        "op5_ngram_jaccard_join": JOIN_SQL,
        "op11_collocations": PHRASE_SQL,
        "op12_conversation_trie": TRIE_SQL,
        "op13_decontamination": LEAK_SQL,
    }
