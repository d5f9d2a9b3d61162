"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, cotraining, exponion, fm_dedup, language_mixture, merkle, mixing, orc_tokens, partenum, ppm, prefix_trie, token_counts, wand
from .common import crc_of_id, documents, small_batches


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


def op2_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), held_out=crc_of_id(F.col("doc_id")) % 7 == 2)


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(1, 2, 3), most=3).drop("key")


def op7_blockmax_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 100; searched: all documents."""
    docs = documents(spark, sf_dir)
    found = wand.search(docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"), k=10)
    return found.withColumn("score", F.round("score", 6))


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_score and toxic_score are probabilities; keep is the decision of the pipeline's stage."""
    scored = cotraining.fit_and_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("keep", cotraining.keeps())


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(documents(spark, sf_dir)).drop("key")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, width=64, rounds=10, salt="3:")


def op13_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.dedup(documents(spark, sf_dir))


def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_merkle_fingerprints, op2_orc_token_ids, op3_token_counts, op4_byte_bpe, op5_ppm_scores, op6_cube_mixing, op7_blockmax_wand, op8_cotrained_quality, op9_partenum_join, op10_language_mixture, op11_prefix_trie, op12_exponion_clusters, op13_fm_dedup)
    return {f.__name__: f if f is op2_orc_token_ids else _prepared(f) for f in own}


#: Words of the lower-cased (A-Z) texts.
_WORDS_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)"""

_BM25 = f"""WITH {_WORDS_SQL}, l AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
t AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(words) AS len, unnest(words) AS word FROM w) GROUP BY ALL),
d AS (SELECT word, count(*) AS df FROM t GROUP BY word),
s AS (SELECT q.doc_id AS query_id, t.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.len / mean))) AS score
  FROM t q JOIN t ON t.word = q.word JOIN d ON d.word = t.word, l WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE place <= 10"""

_JACCARD = f"""WITH RECURSIVE {_WORDS_SQL},
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingles FROM w),
u AS (SELECT min(doc_id) AS node, shingles, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
g AS (SELECT node, n, unnest(shingles) AS shingle FROM u),
k AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.shingle = b.shingle AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c AS (SELECT node AS a, node AS b FROM u UNION SELECT c.a, k.b FROM c JOIN k ON k.a = c.b),
m AS (SELECT a AS node, min(b) AS component_id FROM c GROUP BY a), d AS (SELECT a AS node, count(*) AS n_links FROM k GROUP BY a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(d.n_links, 0) AS n_links
FROM s LEFT JOIN u ON u.shingles = s.shingles LEFT JOIN m ON m.node = u.node LEFT JOIN d ON d.node = u.node"""


#: Table of the reversed CRC-32 polynomial, and the checksum of a text of digits from it.
_CRC = """k AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"""
_CRC_OF = "xor(4294967295, list_reduce([4294967295] || list_transform(range(1, len({x}) + 1), lambda i: CAST(ascii({x}[i]) AS BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"

_TRIE = f"""WITH {_CRC},
s AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT s.*, CAST({_CRC_OF.format(x="name")} % 9 AS BIGINT) AS h FROM s, k),
b AS (SELECT h.conv_id, coalesce(p.own[1:h.h], []) || h.own[h.h + 1:] AS seq FROM h LEFT JOIN s p ON p.conv_id = h.conv_id - h.conv_id % 5),
e AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM b),
n AS MATERIALIZED (SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN len(seq) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM e GROUP BY seq[1:depth], depth),
c AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.node),
u AS (SELECT node[1:k] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(node[depth].x)) ELSE 0 END) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM x) GROUP BY 1)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN u ON u.node = x.node LEFT JOIN n p ON x.depth > 0 AND p.node = x.node[1:x.depth - 1]"""


def _lloyd_sql(k: int = 8, width: int = 64, rounds: int = 10, salt: str = "3:") -> str:
    """Each round in two table expressions: nearest centroids, then floored means."""
    near = """a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d, row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) AS place FROM v, c{i} c) WHERE place = 1)"""
    means = """c{j} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list(q ORDER BY ix) AS x FROM (SELECT c, ix, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
FROM (SELECT a.c, unnest(v.x) AS e, unnest(range(len(v.x))) AS ix FROM a{i} a JOIN v ON v.r = a.r) GROUP BY c, ix) GROUP BY c) m ON m.c = c.c)"""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds):
        parts += [near.format(i=i), means.format(i=i, j=i + 1)]
    parts.append(near.format(i=rounds))
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c"""


_REPEATS = r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w),
k AS (SELECT r, doc_id, i, sha256(array_to_string(words[i:i + 19], ' ')) AS key FROM s),
f AS (SELECT r, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS place FROM k),
c AS (SELECT DISTINCT r, i + unnest(range(20)) AS i FROM f WHERE place > 1),
p AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
j AS (SELECT p.r, count(c.i) AS gone, string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c ON c.r = p.r AND c.i = p.i GROUP BY p.r)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(j.gone, 0) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256 FROM w LEFT JOIN j ON j.r = w.r"""


def oracle_sql() -> dict[str, str]:
    """Search, similarity join, prefix trie, clustering and substring dedup in SQL; the others cannot be stated in SQL that runs over whole tables and are held
    against brute force, their libraries, round trips or held-out accuracy."""
    return {"op7_blockmax_wand": _BM25, "op9_partenum_join": _JACCARD, "op11_prefix_trie": _TRIE, "op12_exponion_clusters": _lloyd_sql(), "op13_fm_dedup": _REPEATS}
