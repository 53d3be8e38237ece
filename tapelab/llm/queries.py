"""The registered queries of the corpus operators, with their SQL twins where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.llm import chat, decontam, kneser_ney, langid, merkle, mixing, neardup, packing, phrases, pii, quality, trie, urlfilter
from tapelab.llm.common import fold_of, table, text_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    found = pii.find_spans(docs.select(F.monotonically_increasing_id().alias("row"), "*"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", pii.all_spans().alias("spans"))


def op2_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("pattern")


def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op8_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    read = chat.read_back(*chat.prefix_trees(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_score_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(fold_of("doc_id", 7) != 2))
    held_out = (fold_of("doc_id", 7) == 2).alias("held_out")
    return kneser_ney.score(docs, model).select("*", held_out, F.lit(model["tokens"]).cast("long").alias("train_tokens"))


def op10_find_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_mine_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def _sql_rules() -> str:
    listed = [(r.action, *r.pattern.removeprefix("||").split("/", 1)) for r in urlfilter.LISTED]
    return ", ".join(f"('{action}', '{host}', '/{path}')" for action, host, path in listed)


OP5_SQL = rf"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
listed(action, h, p) AS (VALUES {_sql_rules()}),
other(action, x, len, pattern) AS (VALUES {", ".join(f"('{r.action}', '{urlfilter.expression(r.pattern)}', {len(r.pattern)}, '{r.pattern.removeprefix('||')}')" for r in urlfilter.PATTERNS)})
SELECT page_id, host, path, l.h || l.p AS rule,
  coalesce(l.action, (SELECT o.action FROM other o WHERE regexp_matches(host || path, o.x)
                      ORDER BY o.len DESC, o.action = 'block' DESC, o.pattern DESC LIMIT 1), 'allow') AS verdict
FROM u LEFT JOIN LATERAL (
  SELECT * FROM listed WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  ORDER BY length(h || p) DESC LIMIT 1) l ON true
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS rank
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, source_size * 6 // weight AS need FROM w),
l AS (SELECT *,
        sum(source_size) OVER ()::BIGINT - 3 * coalesce(sum(source_size) OVER b, 0)::BIGINT AS lft,
        (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS weights
      FROM o WINDOW b AS (ORDER BY need, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lft, weights FROM l WHERE weight * lft < 3 * source_size * weights ORDER BY need, source IS NULL, source LIMIT 1),
t AS (SELECT l.source, l.source_size,
        CASE WHEN weight * l.lft >= 3 * source_size * l.weights THEN (3 * source_size)::DOUBLE
             ELSE (weight * f.lft)::DOUBLE / f.weights END AS target
      FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.times, p.target - p.times * p.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank RANGE UNBOUNDED PRECEDING)::BIGINT AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.rank)::BIGINT AS own
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (times + CASE WHEN upto <= rest OR (upto - own < rest AND 2 * upto - own <= 2 * rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, '<|role|>' || regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') || '<|text|>' || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
f AS (SELECT c.conv_id, c.h, t.place, t.said FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place <= c.h),
g AS (SELECT c.conv_id, c.h, (SELECT count(*) FROM f WHERE f.conv_id = c.conv_id) AS lent FROM c),
r AS (SELECT conv_id, place, said FROM f
  UNION ALL SELECT t.conv_id, t.place - g.h + g.lent, t.said FROM t JOIN g USING (conv_id) WHERE t.place > g.h),
p AS (SELECT conv_id, place AS depth, said.text AS last, list(said) OVER (PARTITION BY conv_id ORDER BY place) AS node FROM r
  UNION ALL SELECT conv_id, 0, '', [] FROM c),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(strlen(last)) AS size FROM p GROUP BY node, depth),
m AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.node, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ends FROM p JOIN m ON p.conv_id = m.conv_id AND p.depth = m.depth GROUP BY p.node),
k AS (SELECT n.conv_id, n.depth, q.node AS parent FROM n JOIN p AS q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
s AS (SELECT q.node, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.parent = n.node)) AS leaves
      FROM n JOIN p AS q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs,
  (SELECT count(*) FROM k WHERE k.parent = n.node) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens,
  sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN e ON e.node = n.node
LEFT JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth LEFT JOIN n AS u ON u.node = k.parent
"""

OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
c AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, unnest(flatten([[w[i : i + k - 1] FOR i IN range(1, len(w) - k + 2)] FOR k IN range(1, 5)])) AS ws FROM p),
f AS MATERIALIZED (SELECT lang, ws, count(*) AS a FROM g GROUP BY lang, ws HAVING count(*) >= 30),
s AS (SELECT x.lang, x.ws, x.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1) x
  JOIN f l ON l.lang = x.lang AND l.ws = x.ws[1 : k] JOIN f r ON r.lang = x.lang AND r.ws = x.ws[k + 1 :]),
d AS (SELECT lang, ws, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
i AS (SELECT lang, sub, max(a) AS longer FROM
  (SELECT lang, a, unnest(flatten([[ws[j : j + k - 1] FOR j IN range(1, len(ws) - k + 2)] FOR k IN range(2, len(ws))])) AS sub FROM f WHERE len(ws) > 2) GROUP BY lang, sub),
e AS (SELECT d.*, array_to_string(d.ws, ' ') AS phrase FROM d LEFT JOIN i ON i.lang = d.lang AND i.sub = d.ws WHERE coalesce(100 * i.longer < 80 * d.a, true))
SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM e JOIN c ON c.lang = e.lang QUALIFY rank <= 2000
"""

QUERIES: dict[str, Query] = {
    "op1_find_personal_data": op1_find_personal_data,
    "op2_fingerprint_documents": op2_fingerprint_documents,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_score_quality": op4_score_quality,
    "op5_judge_urls": op5_judge_urls,
    "op6_identify_language": op6_identify_language,
    "op7_mix_sources": op7_mix_sources,
    "op8_format_conversations": op8_format_conversations,
    "op9_score_language": op9_score_language,
    "op10_find_benchmark_items": op10_find_benchmark_items,
    "op11_pack_documents": op11_pack_documents,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_mine_collocations": op13_mine_collocations,
}

ORACLES: dict[str, str] = {"op5_judge_urls": OP5_SQL, "op7_mix_sources": OP7_SQL, "op8_format_conversations": OP8_SQL, "op12_conversation_trie": OP12_SQL, "op13_mine_collocations": OP13_SQL}
