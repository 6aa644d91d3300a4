"""The operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import collocations, grammar, jaccard, language, media, mixing, packing, pii, prefix_trie, repeats, secrets, topk, warc
from kindred.llm.common import cut, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = language.train(language.training_rows(docs))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf))


def op3_media(spark: SparkSession, sf: str) -> DataFrame:
    return media.read(media.write(documents(spark, sf))).drop("media")


def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.find(documents(spark, sf)))


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return pii.digest(docs, pii.train(docs))


def op6_grammar(spark: SparkSession, sf: str) -> DataFrame:
    return grammar.read(grammar.write(documents(spark, sf)))


def op7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digest(documents(spark, sf))


def op8_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf), jaccard.JoinParams(words=4, percent=85))


def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    sized = cut(documents(spark, sf).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", taken)


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf))


def op12_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf}/conversations.parquet"))


def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.pages_as_records(spark.read.parquet(f"{sf}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM r),
o AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, pos_order) AS level FROM (SELECT level, ratio, row_number() OVER (ORDER BY ratio, pos) AS pos_order FROM l) WHERE ratio > level),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM f)), cap) AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""

OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, piece FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT lang, id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT lang, id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY lang),
e AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM e UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM e WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM e WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM e WHERE w4 IS NOT NULL),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
x AS (SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score FROM c JOIN (VALUES (1), (2), (3)) v(j) ON j < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM x) WHERE place = 1),
s AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM c, (VALUES (2), (3)) v(m) WHERE m < k),
m AS (SELECT lang, phrase, max(a) AS most FROM s GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

#: The checksum of a decimal number, byte by byte and bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""
OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(b ORDER BY turn NULLS FIRST, k) AS bs, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ks, bs, {_CRC32} % 9 AS h FROM o),
r AS (SELECT a.conv_id, list_concat(coalesce(b.ks[1:a.h], []), a.ks[a.h + 1:]) AS ks, list_concat(coalesce(b.bs[1:a.h], []), a.bs[a.h + 1:]) AS bs FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, d, ks[1:d] AS path, coalesce(bs[d], 0) AS b, d = len(ks) AS fin FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (fin), '')) AS ends_sha256 FROM p GROUP BY path, d),
c AS (SELECT path[1:d - 1] AS path, count(*) AS k FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(c.k, 0) AS n_children FROM n LEFT JOIN c USING (path)),
u AS (SELECT path[1:e] AS path, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, w.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children, u.n_leaves, u.saved_tokens, v.ends_sha256
FROM v JOIN u USING (path) LEFT JOIN n w ON v.d > 0 AND w.path = v.path[1:v.d - 1]
"""

OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

_QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language, op2_packing, op3_media, op4_secrets, op5_pii, op6_grammar, op7_repeats, op8_jaccard, op9_topk, op10_mixing, op11_phrases, op12_trie, op13_warc)}
_SQL = {"op9_topk": OP9_SQL, "op10_mixing": OP10_SQL, "op11_phrases": OP11_SQL, "op12_trie": OP12_SQL, "op13_warc": OP13_SQL}


def queries() -> dict[str, Query]:
    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
