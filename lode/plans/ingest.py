"""Chunking, change detection, limiter and message queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp_query, data_uri, preview, sentences
from ..operators import chunking as C
from ..operators.limits import changed, rate_limit
from ..operators.messages import first_text, translate, translate_blocks
from .registry import query, table

SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
LAST = "(a.cur[len(a.cur) - i + 1])"
#: Greedy packing as a fold over sentences; the overlap suffix is a fold over the sentences of the chunk.
PACK = f"""
    s AS (SELECT doc_id, text, {SENTENCES} AS ss FROM documents),
    f AS (SELECT doc_id, text, list_reduce(
            list_transform(ss, lambda x: struct_pack(chunks := []::VARCHAR[], cur := [x], n := length(x) + 1)),
            lambda a, b: CASE WHEN a.n + length(b.cur[1]) > 400 AND len(a.cur) > 0 THEN
                struct_pack(chunks := list_append(a.chunks, array_to_string(a.cur, ' ')),
                            cur := list_append(a.cur[len(a.cur) - (list_count(list_filter(range(1, len(a.cur) + 1), lambda k:
                                list_bool_and(list_transform(range(1, k + 1), lambda j: length(array_to_string(a.cur[len(a.cur) - j + 2:], ' ')) + length(a.cur[len(a.cur) - j + 1]) <= 50)))))::INT + 1:], b.cur[1]),
                            n := length(array_to_string(a.cur[len(a.cur) - (list_count(list_filter(range(1, len(a.cur) + 1), lambda k:
                                list_bool_and(list_transform(range(1, k + 1), lambda j: length(array_to_string(a.cur[len(a.cur) - j + 2:], ' ')) + length(a.cur[len(a.cur) - j + 1]) <= 50)))))::INT + 1:], ' ')) + length(b.cur[1]) + 1)
              ELSE struct_pack(chunks := a.chunks, cur := list_append(a.cur, b.cur[1]), n := a.n + length(b.cur[1]) + 1) END) AS e FROM s WHERE len(ss) > 0),
    c AS (SELECT doc_id, text, list_append(e.chunks, array_to_string(e.cur, ' ')) AS cs FROM f)"""


@query(f"SELECT doc_id, i::INT AS pos, ss[i + 1] AS sentence FROM (SELECT doc_id, ss, unnest(range(0, len(ss))) AS i FROM (SELECT doc_id, {SENTENCES} AS ss FROM documents))")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"WITH {PACK} SELECT doc_id, i::INT AS chunk_id, cs[i + 1] AS text FROM (SELECT doc_id, cs, unnest(range(0, len(cs))) AS i FROM c)")
def chunk_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.chunk_texts(F.col("text"), "By Sentence")).alias("chunk_id", "text"))


#: Each chunk is sought after the start of the one before: a fold that carries the place.
OFFSETS = f"""{PACK},
    o AS (SELECT doc_id, list_reduce(list_prepend(struct_pack(offs := []::BIGINT[], at := 0::BIGINT, c := '', t := text), list_transform(cs, lambda x: struct_pack(offs := []::BIGINT[], at := 0::BIGINT, c := x, t := text))),
        lambda a, b: struct_pack(offs := list_append(a.offs, CASE WHEN strpos(substr(b.t, a.at + 1), substr(b.c, 1, 80)) > 0 THEN a.at + strpos(substr(b.t, a.at + 1), substr(b.c, 1, 80)) - 1 ELSE a.at END),
            at := CASE WHEN strpos(substr(b.t, a.at + 1), substr(b.c, 1, 80)) > 0 THEN a.at + strpos(substr(b.t, a.at + 1), substr(b.c, 1, 80)) - 1 ELSE a.at END + 1, c := '', t := b.t)) AS r, cs FROM c),
    oc AS (SELECT doc_id, i::INT AS chunk_id, cs[i + 1] AS text, r.offs[i + 1]::INT AS start_char, (r.offs[i + 1] + length(cs[i + 1]))::INT AS end_char FROM (SELECT doc_id, r, cs, unnest(range(0, len(cs))) AS i FROM o))"""


@query(f"WITH {OFFSETS} SELECT doc_id, chunk_id, start_char, end_char FROM oc")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(table(spark, sf_dir, "documents"), "By Sentence").select("doc_id", "chunk_id", "start_char", "end_char")


@query("""WITH l AS (SELECT label, vec_id, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p, embedding AS e FROM embeddings),
    g AS (SELECT label, vec_id, sum(CASE WHEN p IS NOT NULL AND round(list_dot_product(p::DOUBLE[], e::DOUBLE[]), 9) < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS c FROM l)
    SELECT label, c::INT AS chunk_id, string_agg(vec_id::VARCHAR, ' ' ORDER BY vec_id) AS text FROM g GROUP BY 1, 2""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("t", F.col("vec_id").cast("string"))
    return C.semantic_groups(rows, "label", "vec_id", "t", "embedding", 0.0)


#: Words with the blank before them, merged into windows of 400 characters; a new window keeps the last words that fit 50 and leave room.
WINDOWS = """
    w AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents),
    p AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END) AS ps FROM w WHERE text <> ''),
    f AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: struct_pack(chunks := []::VARCHAR[], cur := [x], n := length(x))),
            lambda a, b: CASE WHEN a.n + b.n > 400 THEN struct_pack(chunks := list_append(a.chunks, trim(array_to_string(a.cur, ''))),
                cur := list_append(a.cur[len(a.cur) - len(list_filter(range(1, least(len(a.cur), 51) + 1), lambda k: length(array_to_string(a.cur[len(a.cur) - k + 1:], '')) <= least(50, 400 - b.n)))::INT + 1:], b.cur[1]),
                n := length(array_to_string(a.cur[len(a.cur) - len(list_filter(range(1, least(len(a.cur), 51) + 1), lambda k: length(array_to_string(a.cur[len(a.cur) - k + 1:], '')) <= least(50, 400 - b.n)))::INT + 1:], '')) + b.n)
              ELSE struct_pack(chunks := a.chunks, cur := list_append(a.cur, b.cur[1]), n := a.n + b.n) END) AS e FROM p),
    c AS (SELECT doc_id, list_append(e.chunks, trim(array_to_string(e.cur, ''))) AS cs FROM f)"""


@query(f"WITH {WINDOWS} SELECT doc_id, i::INT AS chunk_id, cs[i + 1] AS text FROM (SELECT doc_id, cs, unnest(range(0, len(cs))) AS i FROM c)")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.regexp_replace(F.regexp_replace("text", "(?U)\\s+", " "), "^ | $", "")
    return C.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", flat.alias("text"))).select("doc_id", "chunk_id", "text")


#: Sentences with their stand-in vectors; neighbours whose product is below one half are in different chunks.
SEMANTIC = f"""
    s AS (SELECT doc_id, text, {SENTENCES} AS ss FROM documents),
    x AS (SELECT doc_id, i AS pos, ss[i + 1] AS t FROM (SELECT doc_id, ss, unnest(range(0, len(ss))) AS i FROM s WHERE len(ss) > 1)),
    k AS (SELECT doc_id, pos, ('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS b FROM (SELECT doc_id, pos, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda y: y <> '')) AS w FROM x)),
    h AS (SELECT doc_id, pos, b, count(*)::DOUBLE AS n FROM k GROUP BY 1, 2, 3),
    l AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS norm FROM h GROUP BY 1, 2),
    d AS (SELECT a.doc_id, b.pos, sum(a.n * b.n) AS dot FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.b = b.b GROUP BY 1, 2),
    n AS (SELECT x.doc_id, x.pos, x.t, CASE WHEN x.pos > 0 AND round(coalesce(dot, 0) / coalesce(l.norm, 1) / coalesce(q.norm, 1), 9) < 0.5 THEN 1 ELSE 0 END AS new
          FROM x LEFT JOIN d ON d.doc_id = x.doc_id AND d.pos = x.pos LEFT JOIN l ON l.doc_id = x.doc_id AND l.pos = x.pos LEFT JOIN l q ON q.doc_id = x.doc_id AND q.pos = x.pos - 1),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM n),
    sc AS (SELECT doc_id, g::INT AS chunk_id, string_agg(t, ' ' ORDER BY pos) AS text FROM g GROUP BY 1, 2 UNION ALL SELECT doc_id, 0::INT, text FROM s WHERE len(ss) = 1)"""


@query(f"WITH {SEMANTIC} SELECT doc_id, chunk_id, text FROM sc")
def chunk_semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(table(spark, sf_dir, "documents"), "Semantic").select("doc_id", "chunk_id", "text")


@query(f"WITH {PACK} SELECT 'By Sentence' AS method, count(*) AS n_chunks, round(avg(length(x)), 6) AS avg_chars FROM (SELECT unnest(cs) AS x FROM c)")
def chunk_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.lit("By Sentence").alias("method"), F.explode(C.chunk_texts(F.col("text"), "By Sentence")).alias("text"))
    return C.summarise(rows)


@query()
def chunk_compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = [docs.select(F.lit(m).alias("method"), F.explode(C.chunk_texts(F.col("text"), m)).alias("text")) for m in C.METHODS]
    return C.summarise(reduce(DataFrame.unionByName, parts))


@query(f"WITH {PACK} SELECT doc_id, i::INT AS chunk_id, replace(substr(cs[i + 1], 1, 140), chr(10), ' ') AS preview, length(cs[i + 1])::INT AS chars FROM (SELECT doc_id, cs, unnest(range(0, len(cs))) AS i FROM c)")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.chunk_documents(table(spark, sf_dir, "documents"), "By Sentence")
    return c.select("doc_id", "chunk_id", preview(F.col("text"), 140).alias("preview"), F.length("text").alias("chars"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"))


@query("SELECT event_id, coalesce(md5(event_type) <> lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS changed FROM events")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(table(spark, sf_dir, "events"), "user_id", "ts, event_id", "event_type").select("event_id", "changed")


LIMITER = """WITH l AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts) AS t FROM events GROUP BY user_id),
    k AS (SELECT user_id, len(t) AS n, list_reduce(list_transform(t, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda x: b[1] - x < {seconds}000000::BIGINT)) < {limit} THEN list_concat(a, b) ELSE a END) AS k FROM l)
    SELECT user_id, n::BIGINT AS n_events, len(k)::BIGINT AS n_accepted, make_timestamp(k[-1]) AS last_accepted FROM k"""


# 2 a day, where the fold differs from a plain count over a window
@query(LIMITER.format(seconds=86_400, limit=2))
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", 2, 86_400)


@query(LIMITER.format(seconds=3600, limit=10))
def rate_limiter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit(table(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS content FROM conversations")
def message_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", translate(F.col("role"), F.col("text")).alias("m")).select("conv_id", "turn", "m.role", "m.content")


URI = "CASE WHEN turn % 4 = 0 THEN 'data:image/png;base64,' || {b64} WHEN turn % 4 = 1 THEN 'data:image/svg+xml;base64,AA' WHEN turn % 4 = 2 THEN 'https://example.org/' || conv_id ELSE '' END"


@query(f"SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'image/png' END AS media_type, CASE WHEN turn % 4 = 0 THEN {'to_base64(encode(role))'} END AS data FROM conversations")
def data_uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.expr(URI.format(b64="base64(cast(role as binary))"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", data_uri(uri).alias("u")).select("conv_id", "turn", "u.media_type", "u.data")


@query("SELECT conv_id, turn, (CASE WHEN turn % 4 = 1 OR turn % 4 = 3 THEN 1 ELSE 2 END)::INT AS n_blocks, coalesce(text, '') AS first_text FROM conversations")
def block_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.expr(URI.format(b64="base64(cast(role as binary))"))
    none = F.lit(None).cast("string")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), none.alias("url")), F.struct(F.lit("image_url").alias("type"), none.alias("text"), uri.alias("url")), F.struct(F.lit("audio").alias("type"), none.alias("text"), none.alias("url")))
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn", translate_blocks(blocks).alias("b"))
    return out.select("conv_id", "turn", F.size("b").alias("n_blocks"), first_text(F.col("b")).alias("first_text"))


@query("SELECT doc_id, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 500) AS query FROM documents")
def query_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clamp_query(F.col("text")).alias("query"))
