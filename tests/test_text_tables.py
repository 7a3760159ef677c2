import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lode.functions import tables as T
from lode.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


GOLDENS = [
    (["| Name | Age |", "|---|---|", "| Alice | 30 |", "| Bob | 25 |"], "- **Alice**:\n  - Age: 30\n- **Bob**:\n  - Age: 25\n"),
    (["| Header1 | | Header3 |", "|---|---|---|", "| A | | C |"], "- **A**:\n  - Header3: C\n"),
    (["| Col1 | Col2 |", "|---|---|", "| Hello | World |"], "- **Col1**:\n  - Col 2: Col2\n- **Hello**:\n  - Col 2: World\n"),
    (["| K | V |", "|---|---|"], ""),
    (["| A | B |", "| C | D |"], "- **C**:\n  - Col 2: D\n"),
    (["| K | V |", "|---|---|", "| X | one |", "| | two |"], "- **X**:\n  - V:\n    - one\n    - two\n"),
    (["| K | V |", "|---|---|", "| Same | Same |"], "\n### Same\n\n"),
]


@pytest.mark.parametrize("lines,want", GOLDENS)
def test_table_list(lines, want):
    assert T.table_list(lines) == want


def test_tables_to_lists(spark):
    md = "intro\r\n| a || c |\r\n|---|---|---|\r\n| 1 | 2 | 3 |\r\nend\n|---|---|\n|---|---|\n"
    got = one(spark, md, T.tables_to_lists)
    assert got["tables"] == 1 and got["md"].startswith("intro\n- **1**:\n") and "|---|---|\n|---|---|" in got["md"]


def test_double_pipes(spark):
    assert one(spark, "|---|---| || a|b|", T.normalise_double_pipes) == "|---|---|\n|a|b|"
    assert one(spark, "|---|---||a|b|", T.normalise_double_pipes) == "|---|---| |a|b|"
    assert one(spark, "x || y\n|a||b|", T.normalise_double_pipes) == "x || y\n|a| |b|"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab_.:1-\n ●")), max_size=25))
def test_cell_text_is_stable(cell):
    assert "●" not in [x[:1] for x in T.cell_text(cell).split("\n")][:1]


def test_clean_cell_native_equals_python(spark):
    import random

    r = random.Random(3)
    cells = ["".join(r.choice(["a", "b_c", "d.", ":", " ", "<br>", "<br/>", "- x", "1. y", "●z", "​", "é"]) for _ in range(r.randrange(9))) for _ in range(400)]
    rows = spark.createDataFrame([(c,) for c in cells], "x string").select("x", T.clean_cell(F.col("x")).alias("y")).collect()
    assert [(x.x, x.y) for x in rows if x.y != T.cell_text(x.x)] == []


def test_separator(spark):
    for line, want in (("|---|:--:|", False), ("|---|:---:|", True), ("| --- |", True), ("|--|", False), ("||", False), ("---", False), ("|---|x|", False)):
        assert one(spark, line, T.is_separator) is want


def test_html_tables():
    page = "<TABLE><tr><th>A</th><th>B|C</th></tr><tr><td>x<p>y</p></td></tr></TABLE>"
    assert T.pipes_for_html(page) == "| A | B∣C |\n| --- | --- |\n| x<br>y |  |"
    assert T.pipes_for_html("<table></table>") == "<table></table>"


def test_text_functions(spark):
    assert one(spark, "a b\x1cc", X.tokenize) == ["a", "b", "c"]
    assert one(spark, "C A P I T A L  X and IN A B C x", X.collapse_spaced_caps) == "CAPITAL X and IN ABC x"
    assert one(spark, "**==> picture [3x4] intentionally omitted <==** ![ alt ](u)", X.rewrite_images) == "[Image: visual content] [Image: alt]"
    assert one(spark, "A B", X.collapse_spaced_caps) == "A B"
    assert one(spark, "x\n\n 12 \n\ny", X.strip_page_numbers) == "x\n\ny"
    assert one(spark, "a" + "\n" * 5 + "b\n\n\nc", X.collapse_blank_lines) == "a\n\n\nb\n\n\nc"
    assert one(spark, "![](u) ![alt](v)", X.rewrite_images) == "[Image: visual content] [Image: alt]"
    assert one(spark, "![](u) ![alt](v)", X.count_images) == 2
    assert one(spark, "_cap_\n\n- **x**", X.attach_captions) == "_cap_\n- **x**"
    assert one(spark, "0123456789", X.token_estimate) == 2
    assert one(spark, "data:image/svg+xml;base64,AA", X.data_uri) is None
    assert one(spark, "data:image/png;base64,AA", X.data_uri)["data"] == "AA"
    assert one(spark, '<a x href="javascript:alert(1)">', X.url_sanitise) == '<a x href="#">'
    assert one(spark, "<&'\">", X.html_escape) == "&lt;&amp;&#x27;&quot;&gt;"
    assert one(spark, "Hello, world and more", lambda c: X.highlight(c, F.array(F.lit("hello")))) == X.MARK[0] + "Hello,</span> world and more"
