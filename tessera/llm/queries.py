"""Registered queries of the training-data operators over the test tables.

``QUERIES[name](spark, sf_dir)`` applies one operator with its production
parameters to a whole table; ``ORACLE[name]`` is DuckDB SQL for the ones that
SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge_quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, table(spark, sf_dir, "labels")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "llr")


# The mix of the registered query (weights in turn, share of all words, repeats).
_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
              2.0::DOUBLE * source_size AS cap FROM s1),
-- the water level is the least level at which the filled caps reach the total
s3 AS (SELECT a.*, 1.5::DOUBLE * (SELECT sum(source_size) FROM s0) AS total, a.cap / a.w AS fill FROM s2 a),
s4 AS (SELECT x.fill AS f, (max(x.total) - coalesce(sum(y.cap) FILTER (WHERE y.fill < x.fill), 0))
              / sum(y.w) FILTER (WHERE y.fill >= x.fill) AS level
       FROM (SELECT DISTINCT fill, total FROM s3) x, s3 y GROUP BY x.fill),
lv AS (SELECT arg_min(level, f) AS level FROM s4 WHERE f > level),
s5 AS (SELECT source, source_size, rank, least(cap, coalesce(lv.level * w, cap)) AS target FROM s3, lv),
n AS (SELECT round(sum(target) / 16)::BIGINT AS n FROM s5),
q1 AS (SELECT rank, target / (2 * k + 1) AS q FROM s5, n,
              unnest(range(0, (floor(target / 16) + (SELECT count(*) FROM s5) + 2)::BIGINT)) AS u(k) WHERE target > 0),
q2 AS (SELECT rank, row_number() OVER (ORDER BY q DESC, rank) AS r FROM q1),
quota AS (SELECT rank, count(*) AS quota FROM q2, n WHERE r <= n.n GROUP BY rank),
p AS (SELECT d.doc_id, d.source, d.size, d.key, s5.rank, s5.source_size, s5.target, coalesce(quota.quota, 0) AS quota,
             ('0x' || substr(d.key, 1, 8))::BIGINT % ceil(greatest(s5.source_size, 1) / 262144)::BIGINT AS shard
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN quota USING (rank)),
sh AS (SELECT rank, shard, sum(size)::BIGINT AS shard_size, max(quota) AS quota,
              max(source_size) AS source_size FROM p GROUP BY rank, shard),
q3 AS (SELECT rank, shard, quota, shard_size::DOUBLE / (2 * k + 1) AS q FROM sh, unnest(range(0,
              (floor(quota * shard_size::DOUBLE / source_size) + (SELECT count(*) FROM sh) + 2)::BIGINT)) AS u(k)
       WHERE shard_size > 0),
q4 AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY q DESC, shard) AS r FROM q3),
blocks AS (SELECT rank, shard, count(*) AS blocks FROM q4 WHERE r <= quota GROUP BY rank, shard),
t AS (SELECT sh.*, least(coalesce(blocks, 0) * 16, 2 * shard_size) AS tokens,
             ('0x' || substr(md5('mix|' || rank || '|' || shard), 1, 8))::BIGINT
             % ceil(greatest(shard_size, 1) / 16)::BIGINT * 16 AS start
      FROM sh LEFT JOIN blocks USING (rank, shard)),
l AS (SELECT p.*, t.shard_size, t.tokens, t.start,
             CASE WHEN t.shard_size > 0 THEN t.tokens // t.shard_size ELSE 0 END AS epochs,
             sum(p.size) OVER (PARTITION BY p.rank, p.shard ORDER BY p.key, p.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS hi
      FROM p JOIN t ON p.rank = t.rank AND p.shard = t.shard),
m AS (SELECT *, hi - size AS lo, start + tokens - epochs * shard_size AS stop FROM l)
SELECT doc_id, source, size, source_size, target, (epochs * size
       + greatest(0, least(hi, least(stop, shard_size)) - greatest(lo, start))
       + greatest(0, least(hi, stop - shard_size) - lo))::BIGINT AS taken FROM m
"""


@register("op2_mix_sources", _MIX_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.langid import VOCABULARY, identify_languages
    return identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"),
                              public_tokenizers.path(VOCABULARY))


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.tokencount import TOKENIZER, count_tokens
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        public_tokenizers.path(TOKENIZER))


_URL_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
       ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT p.n, p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.n ORDER BY len(r.host || r.path) DESC, len(r.host) DESC) AS k
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""


@register("op9_url_filter", _URL_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.urls import filter_urls, rules_table
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark))


def _license_sql() -> str:
    from tessera.llm.licenses import RULES, SENTENCES, SLOT_NAME, SLOT_RE, TAG
    quote = lambda x: "'" + x + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in SENTENCES.items())

    def cut(stops: str) -> str:
        plain = (f"regexp_replace(regexp_replace(t, '{stops}', chr(1) || '\\1', 'g'), "
                 f"'[^' || chr(1) || '\\p{{L}}\\p{{N}}]+', ' ', 'g')")
        return (f"list_filter(list_transform(string_split({plain}, chr(1)), "
                f"lambda x: map_extract(names, regexp_replace(trim(x), '{SLOT_RE}', '{SLOT_NAME}'))[1]), "
                "lambda x: x IS NOT NULL)")
    steps, left = [], "q0"
    for i, (_, _, seq) in enumerate(RULES):
        want = quote("|" + "||".join(seq) + "|")
        steps.append(f"{left}n AS (SELECT *, contains(seq{i}, {want}) AS r{i}, replace(seq{i}, {want}, '#') AS seq{i + 1} "
                     f"FROM {left})")
        left = f"{left}n"
    names = "[" + ", ".join(f"CASE WHEN r{i} THEN {quote(n)} END" for i, (n, _, _) in enumerate(RULES)) + "]"
    kinds = "[" + ", ".join(f"CASE WHEN r{i} THEN {quote(k)} END" for i, (_, k, _) in enumerate(RULES)) + "]"
    return f"""
WITH k AS (SELECT map(list(s), list(id)) AS names FROM (VALUES {known}) v(id, s)),
d AS (SELECT doc_id, replace(lower(coalesce(text, '')), '{TAG}:', '{TAG} ') AS t FROM documents),
b AS (SELECT doc_id, {cut('[.!?:;](\\s|$)|\\n')} AS a, {cut('[.!?:;](\\s|$)|\\n[ \\t\\r]*\\n')} AS b FROM d, k),
q0 AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids,
              coalesce(array_to_string(list_transform(CASE WHEN len(b) > len(a) THEN b ELSE a END,
                                                      lambda x: '|' || x || '|'), ''), '') AS seq0 FROM b),
{", ".join(steps)},
f AS (SELECT doc_id, ids, seq{len(RULES)} AS rest, list_sort(list_distinct(list_filter({names}, lambda x: x IS NOT NULL)))
             AS names, {kinds} AS kinds FROM {left})
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       CASE WHEN len(names) > 0 THEN array_to_string(names, ',') END AS licenses,
       CASE WHEN list_contains(kinds, 'noncommercial') THEN 'noncommercial' WHEN list_contains(kinds, 'copyleft')
            THEN 'copyleft' WHEN list_contains(kinds, 'permissive') THEN 'permissive'
            WHEN len(ids) > 0 THEN 'unknown' END AS kind,
       len(regexp_extract_all(rest, '[a-z0-9-]+'))::BIGINT AS n_unmatched
FROM f"""


@register("op10_license_scan", _license_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substrings import PASSAGE_BYTES, PASSAGE_WORDS, remove_repeats
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, passage=(PASSAGE_BYTES, PASSAGE_WORDS)).select(
        "keep.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")


_DECONTAMINATE_SQL = r"""
WITH it AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM it, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM win), unnest(range(1, greatest(len(w) - k, -1) + 2)) AS u(i)),
h AS (SELECT dw.r, dw.k, dw.i, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) AS u(p) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


@register("op6_decontaminate", _DECONTAMINATE_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.decontam import decontaminate
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.lm import VOCABULARY, score_documents
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           public_tokenizers.path(VOCABULARY))


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT min(r) AS c, min(doc_id) AS class_id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT c, n, unnest(s) AS g FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.g = b.g AND a.c < b.c
      GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT reach.a AS c, min(c.class_id) AS component_id FROM reach JOIN c ON c.c = reach.b GROUP BY reach.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) > 0 THEN component_id ELSE s.doc_id END
       AS component_id, CASE WHEN len(s.s) > 0 THEN class_id ELSE s.doc_id END AS class_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN comp ON comp.c = c.c
"""


@register("op1_ngram_jaccard_join", _JACCARD_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


@register("op11_nearest_neighbours")
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.forest import nearest
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


_TRIE_SQL = r"""
WITH t0 AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
              PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST,
              md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, pos, md5(strlen(role)::VARCHAR || ':' || role || text) AS key, strlen(text)::BIGINT AS bytes FROM t0),
-- unsigned crc32 of the decimal id: a byte is mixed in, then eight shifts
c AS (SELECT conv_id, max(pos) AS n, conv_id - conv_id % 5 AS base, (4294967295 - list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
          lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 9 AS h
      FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.pos AS d, t.key, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL
      SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.key, t.bytes
      FROM c LEFT JOIN c b ON b.conv_id = c.base JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT conv_id, d, bytes, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM m GROUP BY node, d),
k AS (SELECT a.node, count(b.node) AS n_children, any_value(u.conv_id) AS parent_conv_id
      FROM g a LEFT JOIN g b ON b.d = a.d + 1 AND left(b.node, 32 * a.d) = a.node
      LEFT JOIN g u ON u.d = a.d - 1 AND u.node = left(a.node, 32 * a.d - 32) GROUP BY a.node),
up AS (SELECT left(g.node, (32 * u.d)::BIGINT) AS top, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * bytes AS saved
       FROM g JOIN k USING (node), unnest(range(0, g.d + 1)) AS u(d)),
s AS (SELECT top AS node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY top)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM g JOIN k USING (node) JOIN s USING (node)
"""


@register("op12_conversation_trie", _TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefixtrie import prefix_trie
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


_NEGATIVES_SQL = r"""
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (
        PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS pid, p.score AS pscore, s.id, s.score, row_number() OVER (
        PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
       AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, pid AS positive_id, rank::INT AS rank, id AS negative_id, pscore AS positive_score,
       score AS negative_score FROM n WHERE rank <= 3
"""


@register("op13_hard_negatives", _NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.negatives import mine_negatives
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        "embedding")
    return mine_negatives(rows, F.col("vec_id") % 50 == 0)
