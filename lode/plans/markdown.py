"""Markdown normalisation queries over pages made from customers, by one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import chunking as C
from .registry import query, table

NL = "chr(10)"
#: Each feature occurs: empty first cells, doubled pipes, <br>, generic headers, captions, images, page numbers, spaced capitals, sheet names.
MARKDOWN = f"""SELECT c_custkey AS doc_id,
    '# Part ' || c_nationkey || {NL} || CASE WHEN c_custkey % 4 = 0 THEN 'C A P I T A L  X and A B' ELSE 'Some  text & <b>more</b> here.' END || {NL} || {NL}
    || CASE WHEN c_custkey % 3 = 0 THEN '![' || CASE WHEN c_custkey % 2 = 0 THEN 'alt ' || c_custkey ELSE '' END || '](http://x.org/' || c_custkey || '.png)' ELSE '<a href="javascript:go(' || c_custkey || ')">x</a>' END || {NL} || {NL}
    || '_Caption ' || c_custkey || '_' || {NL} || {NL}
    || CASE WHEN c_custkey % 11 = 0 THEN '| Col1 | Col 2 | |' ELSE '| Name | Segment | Nation |' END || {NL}
    || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '|---|:---:|---:|' || {NL} END
    || '| ' || c_name || ' | ' || c_mktsegment || ' | ' || c_nationkey || ' |' || {NL}
    || CASE WHEN c_custkey % 7 = 0 THEN '|a||c|' WHEN c_custkey % 5 = 0 THEN '| x<br>y_z<br>- item | one:<br>two<br>three. | 3 |' ELSE '| | more ' || c_mktsegment || ' | |' END || {NL}
    || '| same | same | same |' || {NL} || {NL} || {NL} || {NL} || {NL}
    || CASE WHEN c_custkey % 2 = 0 THEN '  ' || (c_custkey % 10000) || {NL} || {NL} ELSE 'Thẻ ' || c_custkey || {NL} END || 'End of ' || c_name || '.' AS md
    FROM customer"""
M = f"WITH m AS ({MARKDOWN})"
LINES = f"{M}, l AS (SELECT doc_id, string_split(md, {NL}) AS ls FROM m), x AS (SELECT doc_id, i::INT AS pos, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM l))"
SEP = "regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[|](\\s*:?-{3,}:?\\s*[|])+$')"
PIPE = "regexp_matches(line, '^[ \\t]*[|].+[|][ \\t]*$')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(MARKDOWN.replace("chr(10)", "char(10)"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("pos", "line"))


@query(f"{LINES} SELECT doc_id, pos, {SEP} AS is_separator FROM x")
def separator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", T.is_separator(F.col("line")).alias("is_separator"))


@query(f"{LINES}, f AS (SELECT doc_id, pos, {PIPE} AS p FROM x), g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM f WHERE p) SELECT doc_id, min(pos)::INT AS first_line, count(*)::BIGINT AS n_lines FROM g GROUP BY doc_id, g HAVING count(*) >= 2")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    piped = lines(spark, sf_dir).filter(T.is_pipe_line(F.col("line"))).withColumn("g", F.expr("pos - row_number() over (partition by doc_id order by pos)"))
    return piped.groupBy("doc_id", "g").agg(F.min("pos").alias("first_line"), F.count(F.lit(1)).alias("n_lines")).filter("n_lines >= 2").select("doc_id", "first_line", "n_lines")


@query(f"{LINES} SELECT doc_id, pos, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^[|]', ''), '[|]$', ''), '|'), lambda c: trim(c)), '~') AS cells FROM x WHERE {PIPE} AND NOT contains(line, '<br>')")
def pipe_row_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).filter(T.is_pipe_line(F.col("line")) & ~F.col("line").contains("<br>"))
    return rows.select("doc_id", "pos", F.array_join(T.parse_row(F.col("line")), "~").alias("cells"))


#: A cell of a customer's words with every kind of line: joined, glued, bulleted, numbered, listed after a colon.
KINDS = 6


@query(f"""SELECT c_custkey, CASE c_custkey % {KINDS}
        WHEN 0 THEN c_mktsegment || ' ' || c_name
        WHEN 1 THEN lower(c_mktsegment) || 'id_' || c_custkey
        WHEN 2 THEN c_name || {NL} || '- ' || c_mktsegment || {NL} || '1. ' || c_nationkey
        WHEN 3 THEN c_name || ':' || {NL} || c_mktsegment || {NL} || 'two ' || c_nationkey || '.' || {NL} || 'end'
        WHEN 4 THEN c_name || '.' || {NL} || c_mktsegment
        ELSE '' || c_acctbal END AS cell FROM customer""")
def cell_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr(f"""case c_custkey % {KINDS}
        when 0 then concat(' ', c_mktsegment, '<br>', c_name, '\u200b')
        when 1 then concat(lower(c_mktsegment), '<br/>id_', c_custkey)
        when 2 then concat(c_name, '<br />●', c_mktsegment, '<br>1. ', c_nationkey)
        when 3 then concat(c_name, ':<br>', c_mktsegment, '<br>two ', c_nationkey, '.<br>end')
        when 4 then concat(c_name, '.<br>', c_mktsegment)
        else concat('  ', c_acctbal, ' ') end""")
    return table(spark, sf_dir, "customer").select("c_custkey", T.clean_cell(cell).alias("cell"))


@query(f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '|' || c_name || '| |' || c_mktsegment || '|' || {NL} || 'a || b' WHEN 1 THEN '| --- | --- |' || {NL} || '|' || c_name || '|x|'
        WHEN 2 THEN '|' || c_name || '|' || {NL} || '|---|' ELSE c_name || ' || ' || c_mktsegment || {NL} || '|x|' END AS md FROM customer""")
def double_pipe_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.expr("""case c_custkey % 4 when 0 then concat('|', c_name, '||', c_mktsegment, '|\na || b') when 1 then concat('| --- | --- | ||', c_name, '|x|')
        when 2 then concat('|', c_name, '| ||---|') else concat(c_name, ' || ', c_mktsegment, '\n|x|') end""")
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalise_double_pipes(md).alias("md"))


#: A row of a table and its list, by the customer's key: plain, with a continuation row, one cell over all columns, without a first cell.
LISTED = f"""'| name | segment | key |' || {NL} || '|---|---|---|' || {NL} || string_agg(CASE c_custkey % 4
        WHEN 0 THEN '| ' || c_name || ' | ' || c_mktsegment || ' | ' || c_custkey || ' |'
        WHEN 1 THEN '| ' || c_name || ' | ' || c_mktsegment || ' | |' || {NL} || '| | more ' || c_custkey || ' | |'
        WHEN 2 THEN '| ' || c_mktsegment || ' | ' || c_mktsegment || ' | ' || c_mktsegment || ' |'
        ELSE '| ' || c_name || ' | | <br>' || c_custkey || '<br>b |' END, {NL} ORDER BY c_custkey)"""
AS_LIST = f"""string_agg(CASE c_custkey % 4
        WHEN 0 THEN '- **' || c_name || '**:' || {NL} || '  - segment: ' || c_mktsegment || {NL} || '  - key: ' || c_custkey
        WHEN 1 THEN '- **' || c_name || '**:' || {NL} || '  - segment:' || {NL} || '    - ' || c_mktsegment || {NL} || '    - more ' || c_custkey
        WHEN 2 THEN {NL} || '### ' || c_mktsegment || {NL}
        ELSE '- **' || c_name || '**:' || {NL} || '  - key:' || {NL} || '    - ' || c_custkey || ' b' END, {NL} ORDER BY c_custkey) || {NL}"""
#: Documents, one for each nation: a title, an image, a caption over a table of the nation's customers, a sheet's name, blank lines.
HEAD = f"'# Nation ' || c_nationkey || {NL} || 'Thẻ ' || c_nationkey || {NL} || 'text' || {NL} || {NL}"
IMAGE = "'![' || CASE WHEN c_nationkey % 2 = 0 THEN 'flag ' || c_nationkey ELSE '' END || '](http://x.org/' || c_nationkey || '.png)'"
CONVERTED = f"""r AS (SELECT c_nationkey, {LISTED} AS t, {AS_LIST} AS l FROM customer GROUP BY 1),
    p AS (SELECT c_nationkey AS doc_id, {HEAD} || {IMAGE} || {NL} || {NL} || '_Caption ' || c_nationkey || '_' || {NL} AS top, t, l, starts_with(l, '- **') AS near,
                 '# Nation ' || c_nationkey || {NL} || {NL} || 'text' || {NL} || {NL} || CASE WHEN c_nationkey % 2 = 0 THEN '[Image: flag ' || c_nationkey || ']' ELSE '[Image: visual content]' END
                 || {NL} || {NL} || '_Caption ' || c_nationkey || '_' || {NL} AS top2 FROM r),
    v AS (SELECT doc_id, top || {NL} || t || {NL} || {NL} || {NL} || {NL} || {NL} || 'End.' AS raw_markdown,
                 top || CASE WHEN near THEN '' ELSE {NL} END || l || {NL} || {NL} || {NL} || {NL} || 'End.' AS tables_converted,
                 top2 || CASE WHEN near THEN '' ELSE {NL} END || rtrim(l, {NL}) || {NL} || {NL} || {NL} || 'End.' AS final_markdown FROM p)"""


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, md: the documents that CONVERTED describes."""
    row = F.expr("""case c_custkey % 4 when 0 then concat('| ', c_name, ' | ', c_mktsegment, ' | ', c_custkey, ' |') when 1 then concat('| ', c_name, ' | ', c_mktsegment, ' | |\n| | more ', c_custkey, ' | |')
        when 2 then concat('| ', c_mktsegment, ' | ', c_mktsegment, ' | ', c_mktsegment, ' |') else concat('| ', c_name, ' | | <br>', c_custkey, '<br>b |') end""")
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("r"))
    rows = F.array_join(F.transform("r", lambda x: x["row"]), "\n")
    n = F.col("c_nationkey")
    alt = F.when(n % 2 == 0, F.concat(F.lit("flag "), n)).otherwise("")
    return by.select(n.alias("doc_id"), F.format_string("# Nation %d\nThẻ %d\ntext\n\n![%s](http://x.org/%d.png)\n\n_Caption %d_\n\n| name | segment | key |\n|---|---|---|\n%s\n\n\n\n\nEnd.", n, n, alt, n, n, rows).alias("md"))


@query(f"SELECT c_nationkey, {AS_LIST} AS md, 1::INT AS tables FROM customer GROUP BY 1")
def table_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.regexp_extract("md", "(?s)([|] name.*?)\n\n", 1)
    return nation_pages(spark, sf_dir).select(F.col("doc_id").alias("c_nationkey"), T.tables_to_lists(md).alias("t")).select("c_nationkey", F.col("t.md").alias("md"), F.col("t.tables").alias("tables"))


@query(f"{LINES}, r AS (SELECT doc_id, pos, list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^[|]', ''), '[|]$', ''), '|'), lambda c: trim(c)) AS c FROM x WHERE {PIPE} AND NOT {SEP} AND NOT contains(line, '<br>')), "
       "g AS (SELECT *, sum(CASE WHEN c[1] <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM r) "
       f"SELECT doc_id, g::BIGINT AS row_no, string_agg(nullif(c[2], ''), {NL} ORDER BY pos) AS second FROM g GROUP BY 1, 2")
def table_continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).filter(T.is_pipe_line(F.col("line")) & ~T.is_separator(F.col("line")) & ~F.col("line").contains("<br>"))
    rows = rows.withColumn("c", T.parse_row(F.col("line"))).withColumn("row_no", F.expr("sum(case when c[0] <> '' then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and current row)"))
    by = rows.groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_list(F.when(F.expr("get(c, 1) <> ''"), F.struct("pos", F.expr("get(c, 1)").alias("v"))))).alias("p"))
    return by.select("doc_id", "row_no", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["v"]), "\n")).alias("second"))


@query(f"{M}, n AS (SELECT doc_id, replace(md, '|', '- **') AS md FROM m) SELECT doc_id, regexp_replace(md, '(_[^_\\n]+_)\\s*\\n\\n+(- \\*\\*)', '\\1' || {NL} || '\\2', 'g') AS md FROM n")
def caption_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", X.attach_captions(F.replace("md", F.lit("|"), F.lit("- **"))).alias("md"))


@query(f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'x [Image: ' || c_name || '] [Image: visual content]' WHEN 1 THEN '[Image: visual content] by ' || c_name ELSE c_name || ' [no](image)' END AS md,
    (CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::INT AS images FROM customer""")
def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.expr("""case c_custkey % 3 when 0 then concat('x ![ ', c_name, ' ](', c_custkey, '.png) ![](y)') when 1 then concat('**==> picture [', c_custkey, ' x 3] intentionally omitted <==** by ', c_name) else concat(c_name, ' [no](image)') end""")
    return table(spark, sf_dir, "customer").select("c_custkey", X.rewrite_images(md).alias("md"), X.count_images(md).alias("images"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' of ' || c_name WHEN 1 THEN 'x ' || c_mktsegment || '.' ELSE left(c_mktsegment, 1) || ' ' || right(c_mktsegment, 1) END AS md FROM customer")
def spaced_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = "array_join(split(c_mktsegment, '(?<=.)(?=.)'), ' ')"
    md = F.expr(f"case c_custkey % 3 when 0 then concat({apart}, ' of   ', c_name) when 1 then concat('x ', {apart}, '.') else concat(left(c_mktsegment, 1), ' ', right(c_mktsegment, 1)) end")
    return table(spark, sf_dir, "customer").select("c_custkey", X.collapse_spaced_caps(md).alias("md"))


@query(f"{M} SELECT doc_id, regexp_replace(md, '\\n\\n\\s*\\d{{1,4}}\\s*\\n\\n', {NL} || {NL}, 'g') AS md FROM m")
def page_number_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", X.strip_page_numbers(F.col("md")).alias("md"))


@query(f"{M} SELECT doc_id, regexp_replace(md, '\\n{{4,}}', {NL} || {NL} || {NL}, 'g') AS md FROM m")
def blank_line_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", X.collapse_blank_lines(F.col("md")).alias("md"))


@query(f"{M} SELECT doc_id, regexp_replace(md, '(?m)^\\s*Thẻ\\s+\\d+\\s*$', '', 'g') AS md FROM m")
def sheet_name_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", X.strip_sheet_names(F.col("md")).alias("md"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query(f"{M} SELECT doc_id, regexp_replace(md, '(<a\\b[^>]*\\bhref\\s*=\\s*\")(?:javascript|vbscript|data):[^\"]*(\")', '\\1#\\2', 'gi') AS md FROM m")
def url_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", X.url_sanitise(F.col("md")).alias("md"))


@query(f"""SELECT c_nationkey, c_nationkey || ': ' || '| Name | Key |' || {NL} || '| --- | --- |' || {NL} || string_agg('| ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '<br>' || c_mktsegment ELSE '' END || ' | ' || CASE WHEN c_custkey % 4 > 0 THEN c_custkey || '∣' || c_nationkey ELSE '' END || ' |', {NL} ORDER BY c_custkey)
    || ' tail' AS md FROM customer GROUP BY 1""")
def html_table_to_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.expr("""concat('<tr><td>', case when c_custkey % 3 = 0 then concat('<p>', c_name, '</p><p>', c_mktsegment, '</p>') else concat('<b>', c_name, '</b>') end, '</td>',
        case when c_custkey % 4 > 0 then concat('<td class="k">', c_custkey, '|', c_nationkey, '</td>') else '' end, '</tr>')""")
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("r"))
    html = F.concat("c_nationkey", F.lit(": <TABLE border=1><tr><th>Name</th><th>Key</th></tr>"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit("</TABLE> tail"))
    return by.select("c_nationkey", T.html_tables_to_pipes(html).alias("md"))


@query(f"SELECT n_regionkey, '| key | name |' || {NL} || '| --- | --- |' || {NL} || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', {NL} ORDER BY n_nationkey) AS md FROM nation GROUP BY 1")
def pipe_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return by.select("n_regionkey", T.render_table(F.array(F.lit("key"), F.lit("name")), rows).alias("md"))


@query(f"""WITH c AS (SELECT c_custkey AS doc_id, i, x FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM (SELECT *, [
        'intro ' || c_name, '# A ' || c_nationkey || {NL} || {NL} || c_mktsegment || '  ' || {NL} || 'second' || {NL} || '```' || {NL} || '# no' || {NL} || '```',
        '# A ' || c_nationkey || {NL} || '## B' || {NL} || {NL} || c_name, '# C' || {NL} || {NL} || c_acctbal] AS xs FROM customer)), LATERAL (SELECT xs[i + 1] AS x))
    SELECT doc_id, i::INT AS chunk_id, x AS text FROM c""")
def chunk_by_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('intro ', c_name, '\n# A ', c_nationkey, '\n  ', c_mktsegment, ' \n\n\nsecond\n```\n# no\n```\n## B\n', c_name, '\n\n# C\n', c_acctbal)")
    return C.chunk_documents(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")), "By Markdown Headers").select("doc_id", "chunk_id", "text")


def convert(md: DataFrame) -> DataFrame:
    """doc_id, three versions of the text and the counts: tables, images, sheet names, blank lines in turn."""
    t = md.select("doc_id", F.col("md").alias("raw_markdown"), T.tables_to_lists(F.col("md")).alias("t"))
    t = t.select("doc_id", "raw_markdown", X.attach_captions(F.col("t.md")).alias("tables_converted"), F.col("t.tables").alias("tables_found"))
    final = X.collapse_blank_lines(X.strip_sheet_names(X.rewrite_images(F.col("tables_converted"))))
    return t.select("doc_id", "raw_markdown", "tables_converted", final.alias("final_markdown"), "tables_found", X.count_images(F.col("tables_converted")).alias("images_found")).withColumn("char_count", F.length("final_markdown"))


@query(f"WITH {CONVERTED} SELECT doc_id, raw_markdown, tables_converted, final_markdown, 1::INT AS tables_found, 1::INT AS images_found, length(final_markdown)::INT AS char_count FROM v")
def convert_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(nation_pages(spark, sf_dir))


@query(f"WITH {CONVERTED} SELECT count(*) AS n_docs, count(*) FILTER (WHERE contains(raw_markdown, '|---|')) AS tables, sum(len(string_split(raw_markdown, '![')) - 1)::BIGINT AS images, sum(length(final_markdown))::BIGINT AS chars FROM v")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(nation_pages(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tables_found").alias("tables"), F.sum("images_found").cast("long").alias("images"), F.sum("char_count").alias("chars"))


# The stages' messages.
LOG = {"Extracted": "**Extracted** markdown (%s chars)", "Converted": "**Converted** %s table(s) to list format", "Processed": "**Processed** %s image reference(s)"}


@query(f"WITH {CONVERTED} SELECT doc_id, unnest(['Extracted', 'Converted', 'Processed']) AS stage, unnest(['**Extracted** markdown (' || format('{{:,}}', length(final_markdown)) || ' chars)', '**Converted** 1 table(s) to list format', '**Processed** 1 image reference(s)']) AS message FROM v")
def pipeline_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = convert(nation_pages(spark, sf_dir))
    c = c.select("doc_id", F.format_number("char_count", 0).alias("Extracted"), F.col("tables_found").cast("string").alias("Converted"), F.col("images_found").cast("string").alias("Processed"))
    messages = F.array(*[F.struct(F.lit(k).alias("stage"), F.format_string(v, k).alias("message")) for k, v in LOG.items()])
    return c.select("doc_id", F.explode(messages).alias("m")).select("doc_id", "m.*")
