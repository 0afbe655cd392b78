"""The training-data operators applied to their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, language, near, packing, passages, pieces, repeats, sharding, telephony, topk, tries, vectorpacking, warc
from .common import read


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP2_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(read(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_media(read(spark, sf_dir, "documents"))


def op5_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(warc.write_archive(read(spark, sf_dir, "pages"))).drop("url")


OP6_SQL = """
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN strlen(body) >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(body) >= 1000 AND page_id <> best THEN best END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
"""


def op7_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(read(spark, sf_dir, "documents"), size=3, percent=85)


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    judged = language.identify(docs.drop("lang"), language.fit(docs.where(~F.col("held_out")).drop("doc_id")))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats.without_repeats(docs)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(tries.with_shared_heads(tries.conversation_turns(read(spark, sf_dir, "conversations")), group=5, most=9))


OP11_SQL = """
WITH own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t,
           xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.t, [])[1 : o.h], o.t[o.h + 1 : len(o.t)]) AS t
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - (o.conv_id % 5 + 5) % 5
), prefixes AS (
    SELECT conv_id, t, d, t[1 : d] AS p FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT p, d, p[1 : d - 1] AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(t) = d), '')) AS ends_sha256
    FROM prefixes GROUP BY p, d
), children AS (
    SELECT up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up
), subtrees AS (
    SELECT p[1 : e] AS p, sum(leaf) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
    FROM (SELECT n.p, n_convs, CASE WHEN c.p IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d = 0 THEN 0 ELSE strlen(n.p[d].text) END AS bytes, unnest(range(0, d + 1)) AS e
          FROM nodes n LEFT JOIN children c ON c.p = n.p)
    GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.p = n.up AND u.d = n.d - 1 LEFT JOIN children c ON c.p = n.p JOIN subtrees s ON s.p = n.p
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


OP12_SQL = r"""
WITH cut AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM cut
), occurrences AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS sizes(k))
), counts AS (
    SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM occurrences GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), frequent AS (
    SELECT * FROM counts WHERE f >= 100
), parts AS (
    SELECT lang, k, phrase, w, f, unnest(range(1, k)) AS c FROM frequent WHERE k > 1
), scored AS (
    SELECT p.lang, p.k, p.phrase, p.f AS a, l.f AS l, r.f AS r, n, c, CAST((CAST(1000 AS HUGEINT) * p.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM parts p JOIN totals USING (lang)
    JOIN frequent l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1 : c], ' ')
    JOIN frequent r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[c + 1 : p.k], ' ')
    QUALIFY row_number() OVER (PARTITION BY p.lang, p.phrase ORDER BY score, c) = 1
), inner_phrases AS (
    SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM frequent, range(2, 5) AS sizes(m) WHERE m < k)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_phrases x WHERE x.lang = s.lang AND x.phrase = s.phrase AND x.f >= s.a)
QUALIFY rank <= 2000
"""


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorpacking.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), vectorpacking.Limits(tokens=1024, segments=64))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_topk": op2_topk,
    "op3_compact_windows": op3_compact_windows,
    "op4_media": op4_media,
    "op5_bin_slack": op5_bin_slack,
    "op6_warc": op6_warc,
    "op7_odd_sketch": op7_odd_sketch,
    "op8_jump_shards": op8_jump_shards,
    "op9_language": op9_language,
    "op10_run_index": op10_run_index,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_vector_packing": op13_vector_packing,
}

ORACLES: dict[str, str] = {"op2_topk": OP2_SQL, "op6_warc": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL}
