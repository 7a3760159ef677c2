"""Queries over files: each writes files made from the tables to the shared folder and reads them through a source."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import chunking as C
from ..operators import models as M
from ..operators import retrieval as R
from ..scratch import Scratch
from ..sources import files as S
from ..sources import writers as W
from .registry import query, table

NL = "chr(10)"


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, list[tuple[int, str]]]]:
    """(key, name, nations) of each region."""
    r = {x.r_regionkey: x.r_name for x in table(spark, sf_dir, "region").collect()}
    rows = sorted((x.n_regionkey, x.n_nationkey, x.n_name) for x in table(spark, sf_dir, "nation").collect())
    return [(k, r[k], [(n, name) for _, n, name in g]) for k, g in groupby(rows, key=lambda x: x[0])]


def put(spark: SparkSession, files: dict[str, bytes]) -> str:
    scratch = Scratch(spark, "files")
    for name, data in files.items():
        scratch.put(f"in/{name}", data)
    return scratch.path("in")


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))


def customer_files(spark: SparkSession, sf_dir: str) -> str:
    """All customers as CSV files, one for each nation, written by Spark."""
    folder = Scratch(spark, "csv").path("in")
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"))
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "key").write.partitionBy("c_nationkey").option("header", True).csv(folder)
    return folder


def nation_of(rows: DataFrame) -> DataFrame:
    return rows.filter("not path like '%/_SUCCESS'").withColumn("nation", F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int"))


PIPES = f"'| name | segment | key |' || {NL} || '| --- | --- | --- |' || {NL} || string_agg('| ' || c_name || ' | ' || c_mktsegment || ' | ' || c_custkey || ' |', {NL} ORDER BY c_custkey)"
LIST = f"string_agg('- **' || c_name || '**:' || {NL} || '  - segment: ' || c_mktsegment || {NL} || '  - key: ' || c_custkey, {NL} ORDER BY c_custkey) || {NL}"


@query(f"SELECT c_nationkey AS nation, {PIPES} AS raw_markdown FROM customer GROUP BY 1")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_of(S.extract(S.scan(spark, customer_files(spark, sf_dir)))).select("nation", "raw_markdown")


@query(f"WITH c AS (SELECT c_nationkey AS nation, {PIPES} AS raw_markdown, {LIST} AS final_markdown FROM customer GROUP BY 1) "
       "SELECT nation, raw_markdown, final_markdown AS tables_converted, final_markdown, 1::INT AS tables_found, 0::INT AS images_found, length(final_markdown)::INT AS char_count FROM c")
def pipeline_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nation_of(S.process(spark, customer_files(spark, sf_dir)))
    return rows.select("nation", "raw_markdown", "tables_converted", "final_markdown", "stats.tables_found", "stats.images_found", "stats.char_count")


@query(f"SELECT c_nationkey || '_converted' AS name, {LIST} || {NL} AS content FROM customer GROUP BY c_nationkey")
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nation_of(S.process(spark, customer_files(spark, sf_dir)))
    folder = Scratch(spark, "export").path("out")
    S.write_markdown(rows.select(F.concat(F.lit("files/"), "nation", F.lit(".csv")).alias("path"), "final_markdown"), folder)
    return spark.read.schema("value string, name string").text(folder, wholetext=True).select("name", F.col("value").alias("content"))


NATION = f"string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', {NL} ORDER BY n_nationkey)"


@query(f"""SELECT r_name || '.docx' AS file, '# ' || r_name || {NL} || string_agg('- ' || n_name, {NL} ORDER BY n_nationkey) || {NL} || '### 1.2.' || r_regionkey || ' Nations of it' || {NL} || {NL}
    || '| key | name |' || {NL} || '| --- | --- |' || {NL} || {NATION} || {NL} AS raw_markdown FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, r_regionkey""")
def source_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {
        f"{name}.docx": W.docx_bytes([("Heading1", name), *(("ListBullet", n) for _, n in of), ("", f"1.2.{k} Nations of it")], [["key", "name"], *([str(i), n] for i, n in of)])
        for k, name, of in nations(spark, sf_dir)
    }
    return named(S.extract(S.scan(spark, put(spark, files)))).select("file", "raw_markdown")


@query(f"""SELECT r_name || '.pptx' AS file, '## Slide 1' || {NL} || r_name || {NL} || r_regionkey || ' is its key' || {NL} || {NL} || '## Slide 2' || {NL} || {NL} || '| key | name |' || {NL} || '| --- | --- |' || {NL} || {NATION} || {NL} || {NL} AS raw_markdown
    FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, r_regionkey""")
def source_pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {f"{name}.pptx": W.pptx_bytes([([name, f"{k} is its key"], []), ([], [["key", "name"], *([str(i), n] for i, n in of)])]) for k, name, of in nations(spark, sf_dir)}
    return named(S.extract(S.scan(spark, put(spark, files)))).select("file", "raw_markdown")


@query(f"""SELECT r_name || '.pdf' AS file, 'Region (' || r_regionkey || ') ' || r_name || {NL} || {NL} || string_agg(n_name || ' has the key ' || n_nationkey, {NL} ORDER BY n_nationkey) AS raw_markdown
    FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, r_regionkey""")
def source_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other file is encrypted with an owner's password alone, and opens."""
    files = {f"{name}.pdf": W.pdf_bytes([[f"Region ({k}) {name}"], [f"{n} has the key {i}" for i, n in of]], 0, "" if k % 2 else None) for k, name, of in nations(spark, sf_dir)}
    return named(S.extract(S.scan(spark, put(spark, files)))).select("file", "raw_markdown")


@query("""SELECT r_name || ending AS file, error FROM region, (VALUES ('.txt', 'Unsupported file type: txt'), ('.csv', 'File is empty'), (' big.csv', 'File too large'), ('.docx', 'BadZipFile: File is not a zip file'),
    ('.pdf', 'Encrypted: Incorrect password'), (' tiny.docx', 'almost no text'), (' fits.csv', NULL)) AS e(ending, error)""")
def source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {}
    for _, name, _ in nations(spark, sf_dir):
        made = {
            ".txt": b"text", ".csv": b"", " big.csv": b"a,b\n" * 500, ".docx": b"no archive", ".pdf": W.pdf_bytes([["secret"]], 0, name), " tiny.docx": W.docx_bytes([("", "abc")], []), " fits.csv": b"a,b\n" * 250,
        }
        files |= {name + ending: data for ending, data in made.items()}
    return named(S.process(spark, put(spark, files), max_bytes=1_000)).select("file", "error")


@query("SELECT r_name || '.pdf' AS file, r_regionkey % 2 = 0 AS encrypted FROM region")
def pdf_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {f"{name}.pdf": W.pdf_bytes([[name]], 0, "" if k % 2 else name) for k, name, _ in nations(spark, sf_dir)}
    return named(M.encrypted_pdfs(S.scan(spark, put(spark, files)))).select("file", "encrypted")


@query("SELECT n_name || '.pdf' AS file, n_nationkey % 3 > 0 AND (n_nationkey % 5 = 0 OR n_nationkey % 5 >= 2 AND least(n_nationkey % 5, 3) * 0.6 <= (CASE WHEN n_nationkey % 5 >= 3 THEN 3 ELSE 2 END) - 1) AS scanned FROM nation")
def pdf_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first page with hardly any text or, in most files, with much, and key mod 5 pages of images in all."""
    files = {}
    for _, _, of in nations(spark, sf_dir):
        for k, n in of:
            first = ["x"] if k % 5 == 0 else ["a line of text that is longer than thirty characters"]
            files[f"{n}.pdf"] = W.pdf_bytes([first, *([""] for _ in range(k % 5 - 1))], k % 3)
    pages = M.pdf_page_rows(S.scan(spark, put(spark, files)))
    return named(M.scanned_pdfs(pages)).select("file", "scanned")


@query(f"""WITH c AS (SELECT conv_id, turn, 'data:image/png;base64,' || to_base64(encode(role || turn)) AS uri FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[Image: Image could not be described: no picture] and [Image: visual content]' ELSE '[Image: ' || length(uri) || ' characters] and [Image: visual content]' END || {NL} || '[Image: other]' AS md FROM c""")
def image_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def client(uri: str) -> str:
        if uri.endswith("none"):
            raise ValueError("no picture")
        return f" {len(uri)} characters "

    uri = F.expr("concat('data:image/png;base64,', case when turn % 3 = 0 then 'none' else base64(cast(concat(role, turn) as binary)) end)")
    md = F.concat(F.lit("![a]("), uri, F.lit(") and ![](http://x.org/y.png)\n![ other ](z.png)"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.rewrite_images(M.describe_images(md, client)).alias("md"))


@query("SELECT item_id, length(text) || ' characters' AS completion, CASE WHEN item_id % 7 = 0 THEN 'ValueError: refused' END AS completion_error FROM benchmark".replace("length(text) || ' characters' AS", "CASE WHEN item_id % 7 <> 0 THEN length(text) || ' characters' END AS"))
def llm_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    def client(prompt: str) -> str:
        if prompt.startswith("0"):
            raise ValueError("refused")
        return f"{len(prompt) - 1} characters"

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat((F.col("item_id") % 7).cast("string"), "text").alias("prompt"))
    return M.complete_with(rows, client).select("item_id", "completion", "completion_error")


@query("SELECT item_id, round(length(text) / sqrt(length(text) * length(text) + 16), 6) AS x, round(4 / sqrt(length(text) * length(text) + 16), 6) AS y FROM benchmark")
def embedding_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.embed_with(table(spark, sf_dir, "benchmark"), lambda texts: [[len(t), 4.0] for t in texts], "openai")
    return rows.select("item_id", *[F.round(F.get("embedding", F.lit(i)), 6).alias(n) for i, n in enumerate("xy")])


@query("""SELECT * FROM (VALUES ('all-MiniLM-L6-v2', 384, 'local'), ('all-mpnet-base-v2', 768, 'local'), ('text-embedding-3-small', 1536, 'openai'), ('text-embedding-3-large', 3072, 'openai'),
    ('voyage-3.5-lite', 1024, 'voyage'), ('gemini-embedding-001', 768, 'google'), ('text-embedding-004', 768, 'google')) AS m(model, dim, provider)""")
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.catalogue(spark)


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_nationkey < 0 AS generic, c_custkey % 4 = 0 AS merged FROM customer")
def row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic headers (P6) and merged rows (P7) on cells made of customers."""
    headers = F.expr("case c_custkey % 3 when 0 then array(concat('COL ', c_custkey), '', concat('col', c_nationkey)) when 1 then array('', concat('Col ', c_mktsegment)) else array(c_name, 'Col 1') end")
    cells = F.expr("case c_custkey % 4 when 0 then array(c_name, '', concat(' ', c_name)) when 1 then array(c_name, c_mktsegment) when 2 then array(c_name, ' ') else array('', '') end")
    return table(spark, sf_dir, "customer").select("c_custkey", T.generic_headers(headers).alias("generic"), T.merged_row(cells).alias("merged"))


@query("SELECT a::INT AS size, b::INT AS overlap, a >= 1 AND b >= 0 AND b < a AS valid FROM range(-1, 4) AS s(a), range(-1, 5) AS o(b)")
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def valid(size: int, overlap: int) -> bool:
        try:
            C.validate(size, overlap)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(a, b, valid(a, b)) for a in range(-1, 4) for b in range(-1, 5)], "size int, overlap int, valid boolean")


@query("SELECT item_id AS query_id, 0::INT AS rank, item_id AS chunk_id, text, 0::INT AS start_char, 0::INT AS end_char, 0.0::DOUBLE AS score, 0.0::DOUBLE AS bm25, 0.0::DOUBLE AS vector FROM benchmark WHERE false")
def empty_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No hits are asked for (P10); and none are found where there are no chunks."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = table(spark, sf_dir, "documents").select(F.lit(0).alias("corpus"), F.col("doc_id").alias("chunk_id"), "text")
    return R.search(chunks, asked, R.Search(top_k=0)).unionByName(R.search(chunks.filter("false"), asked))
