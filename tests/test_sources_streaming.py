import io
import zipfile

import pytest

from lode.sources import files as S
from lode.sources.office import table_lines
from lode.streaming.ingest import stream_chunks, stream_limiter


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in (["Name", "Age"], ["Ann", "30"])) + "</w:tbl>"
    body = p("Title", "Heading1") + p("An item", "ListBullet") + p("1.2.3 Deep part") + p("Plain text here.") + table
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def pptx() -> bytes:
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {ns}><p:sp><a:p><a:r><a:t>Words of slide {i}</a:t></a:r></a:p></p:sp></p:sld>")
    return out.getvalue()


def test_folder(spark, tmp_path):
    for name, data in {"a.csv": "Name,City\nAnn,Zürich\n".encode("latin-1"), "b.docx": docx(), "c.pptx": pptx(), "d.txt": b"x", "e.csv": b"", "f.docx": b"broken", "g.pdf": b"%PDF"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in S.process(spark, str(tmp_path)).collect()}
    assert got["a.csv"].final_markdown == "- **Ann**:\n  - City: Zürich\n" and got["a.csv"].stats.tables_found == 1
    assert "# Title" in got["b.docx"].final_markdown and "### 1.2.3 Deep part" in got["b.docx"].final_markdown and "- **Ann**:" in got["b.docx"].final_markdown
    assert [x for x in got["c.pptx"].final_markdown.split("\n") if x.startswith("Words")] == [f"Words of slide {i}" for i in (1, 2, 10)]
    assert all(got[n].error for n in ("d.txt", "f.docx", "g.pdf")) and got["e.csv"].error == "File is empty"
    with_pdf = {r.path.rsplit("/", 1)[1]: r for r in S.process(spark, str(tmp_path), {"pdf": lambda b: "text of a pdf file"}).collect()}
    assert with_pdf["g.pdf"].final_markdown == "text of a pdf file"
    S.write_markdown(S.process(spark, str(tmp_path)).filter("error is null"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("name=*"))) == 3


def test_merged_rows_repeat_the_header():
    assert list(table_lines([["A", "B"], ["1", "2"], ["s", "s"], ["3", "4"]])) == ["| A | B |", "| --- | --- |", "| 1 | 2 |", "", "### s", "", "| A | B |", "| --- | --- |", "| 3 | 4 |"]


def test_size_guard(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes(b"x" * 50)
    (tmp_path / "a ü.csv").write_bytes(b"")
    got = lambda most: {r.path.rsplit("/", 1)[1]: r.error for r in S.scan(spark, str(tmp_path), most).collect()}
    assert got(49) == {"a b.csv": "File too large", "a ü.csv": "File is empty"}
    assert got(50) == {"a b.csv": None, "a ü.csv": "File is empty"}


def test_path_guard(tmp_path, monkeypatch):
    monkeypatch.chdir("/")
    assert S.checked(str(tmp_path)) and S.checked("hdfs://x/y")
    with pytest.raises(ValueError):
        S.checked("somewhere/else")


def test_next_reader_after_a_failure():
    def bad(content):
        raise OSError("x")

    assert S.read_one(b"c", "pdf", {"pdf": (bad, lambda b: "short", lambda b: "a text that is long enough")}) == ("a text that is long enough", None)
    assert S.read_one(b"c", "pdf", {"pdf": (lambda b: "short", bad)}) == (None, "OSError: x")


def test_export_names_that_clash(spark, tmp_path):
    rows = spark.createDataFrame([("/a/x.pdf", "one"), ("/b/x.pdf", "two"), ("/b/x.docx", "three"), ("/b/y.pdf", "four")], "path string, final_markdown string")
    S.write_markdown(rows, str(tmp_path / "o"))
    assert len(list((tmp_path / "o").glob("name=x_*_converted"))) == 3 and (tmp_path / "o" / "name=y_converted").exists()


def test_pdf_reader():
    import time

    from lode.sources.pdf import needs_password, pdf_markdown, pdf_pages
    from lode.sources.writers import pdf_bytes

    plain = pdf_bytes([["A (line) \\ ünï", "second"], ["page two"]], images=2)
    assert pdf_pages(plain) == [(1, "A (line) \\ ünï\nsecond", 2), (2, "page two", 2)] and not needs_password(plain)
    locked = pdf_bytes([["secret"]], 0, "pw")
    assert needs_password(locked) and pdf_markdown(locked, "pw") == "secret" and not needs_password(pdf_bytes([["x"]], 0, ""))
    with pytest.raises(ValueError, match="Incorrect password"):
        pdf_markdown(locked, "no")
    with pytest.raises(ValueError):
        pdf_markdown(b"no pdf")
    body = b"BT /F1 9 Tf 1 0 0 1 9 700 Tm [(Wo) 20 (rd) -400 (next)] TJ 1 0 0 1 9 690 Tm <00480069> Tj ET"
    cmap = b"beginbfrange <0000> <FFFF> <0000> endbfrange"
    page = b"%PDF-1.7\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>> endobj 3 0 obj <</Type/Page/Contents[4 0 R]>> endobj\n"
    page += b"4 0 obj <</Length %d>> stream\n%s\nendstream endobj 5 0 obj <</Type/Font>> endobj trailer <</Root 1 0 R>>" % (len(body), body)
    assert pdf_markdown(page).split("\n")[0] == "Word next"
    mapped = page.replace(b"<</Type/Font>>", b"<</ToUnicode 6 0 R>>") + b" 6 0 obj <<>> stream\n" + cmap + b"\nendstream endobj"
    assert pdf_markdown(mapped).split("\n")[1] == "Hi"
    t = time.process_time()
    for junk in (b"1 0 obj << " * 20_000, b"1 0 obj (" * 20_000, b"<" * 50_000, b"stream " * 50_000):
        needs_password(b"%PDF " + junk)
    assert time.process_time() - t < 5


def test_images_are_described_where_it_is_switched_on(spark, tmp_path):
    from lode.sources.writers import docx_bytes

    (tmp_path / "a.docx").write_bytes(docx_bytes([("", "A picture ![x](data:image/png;base64,AAAA) of it.")], []))
    text = lambda: S.process(spark, str(tmp_path), describe=lambda uri: f"{len(uri)} long").first()["final_markdown"]
    assert "[Image: x]" in text()
    spark.conf.set(S.DESCRIBE, "1")
    try:
        assert "[Image: 26 long]" in text()
    finally:
        spark.conf.unset(S.DESCRIBE)


def test_index_tables(spark, tmp_path):
    chunks = spark.createDataFrame([(0, 1, "a b"), (0, 2, "a c")], "corpus int, chunk_id long, text string")
    S.write_index(chunks, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/terms").count() == 3 and spark.read.parquet(f"{tmp_path}/vectors").count() == 2


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One. Two. Three."), (2, "Four.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    q = stream_chunks(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/cp", size=10, overlap=0)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    spark.createDataFrame([(1, t) for t in (0, 1, 2, 10, 11, 12)], "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/ev")
    q = stream_limiter(stream, "user_id", "ts", 2, 10).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.ts // 1_000_000 for r in spark.sql("select * from limited where accepted").collect()) == [0, 1, 10, 11]
