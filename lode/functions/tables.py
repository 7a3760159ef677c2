"""Pipe tables in markdown: predicates, normalisation and row parsing as expressions, and the
conversion of a table to a nested list as an Arrow-batched function over blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .text import strip

# A separator row; bullets, numbers and stops that keep lines of a cell apart.
SEPARATOR = "^[|](\\s*:?-{3,}:?\\s*[|])+$"
BULLET = "^[-●○*■□▪▸►•]\\s"
NUMBERED = "^\\d+[.)]\\s"
STOPS = (".", ":", "!", "?", ";")
# Fixed value: characters of a label that is not a first cell's.
LABEL = 80


def is_separator(line: Column) -> Column:
    return strip(line).rlike(SEPARATOR)


def is_pipe_line(line: Column) -> Column:
    return line.rlike("^[ \\t]*[|].+[|][ \\t]*$")


def normalise_double_pipes(md: Column) -> Column:
    """Empty cells written as doubled pipes get a blank; rows glued to a separator are set apart."""

    def line(x: Column) -> Column:
        s = strip(x)
        parts = F.split(s, "[|][|]", -1)
        left, right = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
        full = F.concat(F.lit("|"), right)
        full = F.when(full.endswith("|"), full).otherwise(F.concat(full, F.lit("|")))
        glued = (F.size(parts) == 2) & left.startswith("|") & left.endswith("|") & (right != "") & ~right.startswith("|") & (is_separator(left) | is_separator(full))
        spaced = F.regexp_replace(x, "[|][|]", "| |")
        return F.when(~s.contains("||") | ~s.startswith("|"), x).when(glued, F.concat_ws("\n", left, full)).otherwise(spaced)

    return F.array_join(F.transform(F.split(md, "\n", -1), line), "\n")


def clean_cell(cell: Column) -> Column:
    """A cell with its markup resolved and the lines of narrow columns joined again, as a fold.

    The state holds the finished lines and whether items after a colon are being listed.
    """
    text = strip(F.replace(cell, F.lit("​"), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, "<br\\s*/?>", "\n"), "(?m)^[●○]\\s*", "- ")
    lines = F.split(text, "\n", -1)

    def fold(state: Column, raw: Column) -> Column:
        line, done = strip(raw), state["lines"]
        prev = F.regexp_replace(F.coalesce(F.element_at(done, -1), F.lit("")), "(?U)\\s+$", "")
        stop = line.rlike("[.:!?;]$")
        open_ = (prev != "") & ~prev.rlike("[.:!?;]$")
        tokens = ~prev.contains(" ") & ~line.contains(" ") & F.concat(prev, line).rlike("[_.]")
        touching = prev.rlike("(?U)[\\p{L}\\p{N}]$") & line.rlike("(?U)^[\\p{L}\\p{N}]")
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.when(tokens & touching, F.concat(prev, line)).otherwise(F.concat_ws(" ", prev, line))))
        new = F.concat(done, F.array(line))
        at = lambda lines, listing: F.struct(lines.alias("lines"), listing.alias("listing"))
        no = F.lit(False)
        return (
            F.when(line == "", at(F.concat(done, F.array(F.lit(""))), no))
            .when(line.rlike(BULLET) | line.rlike(NUMBERED), at(new, no))
            .when(state["listing"], at(new, F.when(stop, line.endswith(":")).otherwise(True)))
            .when(open_, at(joined, no))
            .otherwise(at(new, prev.endswith(":")))
        )

    start = F.struct(F.slice(lines, 1, 1).alias("lines"), F.lit(False).alias("listing"))
    return F.array_join(F.aggregate(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), start, fold)["lines"], "\n")


def parse_row(line: Column) -> Column:
    """Cells of a pipe row, cleaned; one outer pipe goes on each side."""
    bare = F.regexp_replace(F.regexp_replace(strip(line), "^[|]", ""), "[|]$", "")
    return F.transform(F.split(bare, "[|]", -1), clean_cell)


def generic_headers(headers: Column) -> Column:
    """Whether all headers are empty or of the form ``Col 1``; no header at all counts."""
    return F.forall(headers, lambda h: h.rlike("^(?i:col\\s*\\d+)?$"))


def merged_row(cells: Column) -> Column:
    """Whether a row has two cells at least that are not blank, all of them equal."""
    filled = F.filter(F.transform(cells, strip), lambda c: c != "")
    return (F.size(filled) > 1) & (F.size(F.array_distinct(filled)) == 1)


def render_row(cells: Column) -> Column:
    """A pipe row; pipes inside cells become U+2223 and newlines ``<br>``."""
    safe = F.transform(cells, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("∣")), F.lit("\n"), F.lit("<br>")))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def render_table(header: Column, rows: Column) -> Column:
    """A pipe table from a header row and an array of rows."""
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(render_row(header), rule), F.transform(rows, render_row)), "\n")


# --- table to nested list: one Python function per block, run over Arrow batches ---

_SEPARATOR = re.compile(r"[|](?:\s*:?-{3,}:?\s*[|])+")
_GENERIC = re.compile(r"(?:col\s*\d+)?", re.I)


def _joins(prev: str, line: str) -> str:
    """Two fragments of a wrapped line: identifiers are glued, words get a blank."""
    both = prev + line
    identifier = " " not in both and ("_" in both or "." in both) and prev[-1].isalnum() and line[0].isalnum()
    return both if identifier else f"{prev} {line}"


def cell_text(cell: str) -> str:
    """``clean_cell`` for one Python string."""
    text = re.sub(r"(?m)^[●○]\s*", "- ", re.sub(r"<br\s*/?>", "\n", cell.replace("​", "").strip()))
    done: list[str] = []
    listing = False
    for n, raw in enumerate(text.split("\n")):
        line, prev = raw.strip(), done[-1].rstrip() if done else ""
        if not n:
            done.append(raw)
        elif not line or re.match(BULLET, line) or re.match(NUMBERED, line):
            done.append(line)
            listing = False
        elif listing:
            done.append(line)
            listing = line.endswith(":") or not line.endswith(STOPS)
        elif prev and not prev.endswith(STOPS):
            done[-1] = _joins(prev, line)
        else:
            done.append(line)
            listing = prev.endswith(":")
    return "\n".join(done)


def _cells(line: str) -> list[str]:
    return [cell_text(c) for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def _fold_continuations(rows: list[list[str]]) -> list[list[str]]:
    """Rows without a first cell are added to the row above, cell by cell."""
    out: list[list[str]] = []
    for row in rows:
        if row[0].strip() or not out:
            out.append(list(row))
            continue
        above = out[-1]
        above += [""] * (max((j + 1 for j, c in enumerate(row) if c.strip()), default=0) - len(above))
        for j, cell in enumerate(c.strip() for c in row):
            if cell:
                above[j] = f"{above[j].rstrip()}\n{cell}" if above[j].strip() else cell
    return out


def _entry(row: list[str], headers: list[str], number: int) -> Iterator[str]:
    """The list lines of one row."""
    filled = [c.strip() for c in row if c.strip()]
    if len(filled) > 1 and len(set(filled)) == 1:
        yield f"\n### {filled[0]}\n"
        return
    first = lambda cell: cell.split("\n")[0].strip()
    source = 0 if row[0].strip() else 1 if len(row) > 1 and row[1].strip() else None
    label = (first(row[source]) if source == 0 else first(row[source])[:LABEL]) if source is not None else ""
    label = label or f"Row {number}"
    yield f"- **{label}**:"
    for j, (header, value) in enumerate(zip(headers, row, strict=False)):
        if not value or not header.strip():
            continue
        lines = value.split("\n")
        named = j == 0 and first(value) == label or j == 1 and not row[0].strip() and first(value)[:LABEL] == label
        nested = [x.strip() for x in (lines[1:] if named else lines) if x.strip()]
        if not named and len(lines) == 1:
            yield f"  - {header}: {value}"
        elif nested or not named:
            yield f"  - {header}:"
            yield from (f"    - {x}" for x in nested)


def table_list(lines: list[str]) -> str:
    """The nested list of a block of pipe lines; empty if it has no data."""
    lines = [x.strip() for x in lines]
    rule = next((i for i, x in enumerate(lines) if _SEPARATOR.fullmatch(x)), None)
    if rule is None:
        headers, body = [], lines[1:]
    else:
        headers = _cells(lines[rule - 1]) if rule else []
        body = [x for x in lines[: max(0, rule - 1)] if x.startswith("|")]
        if all(_GENERIC.fullmatch(h) for h in headers):
            body += lines[rule - 1 : rule] if rule else []
            headers = []
        body += lines[rule + 1 :]
    rows = [_cells(x) for x in body if x and not _SEPARATOR.fullmatch(x)]
    if not rows:
        return ""
    headers = headers or [f"Col {i + 1}" for i in range(max(map(len, rows)))]
    return "\n".join(x for n, row in enumerate(_fold_continuations(rows), 1) for x in _entry(row, headers, n)) + "\n"


_BLOCK = re.compile(r"(?m)(?:^[ \t]*[|].+[|][ \t]*(?:\n|\Z)){2,}")


def lists_for_tables(md: str) -> tuple[str, int]:
    """A text whose doubled pipes are normalised: its pipe tables as lists, and how many there were."""
    found = 0

    def swap(m: re.Match) -> str:
        nonlocal found
        lines = [x for x in m[0].strip().split("\n") if x.strip()]
        if all(_SEPARATOR.fullmatch(x.strip()) for x in lines):
            return m[0].strip()
        found += 1
        return table_list(lines)

    return _BLOCK.sub(swap, md), found


@pandas_udf(StructType([StructField("md", StringType()), StructField("tables", IntegerType())]))
def _lists(md: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lists_for_tables(x or "") for x in md], columns=["md", "tables"])


def tables_to_lists(md: Column) -> Column:
    """struct(md, tables): line ends unified, doubled pipes normalised, each pipe table a nested list."""
    return _lists(normalise_double_pipes(F.regexp_replace(md, "\r\n?", "\n")))


@pandas_udf(StringType())
def table_block_list(block: pd.Series) -> pd.Series:
    """Nested list of a block of pipe lines."""
    return block.map(lambda b: table_list(b.split("\n")) if b else "")


class _Rows(HTMLParser):
    """Cells of the first table of a fragment; a paragraph inside a cell starts a new line."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "br" and self.cell is not None or tag == "p" and "".join(self.cell or []).strip():
            self.cell.append("<br>")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            if self.tables:
                self.tables[-1] or self.tables[-1].append([])
                self.tables[-1][-1].append(re.sub(r"(?:<br>)+$", "", "".join(self.cell).strip()).strip())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data.strip() if not data.strip() else re.sub(r"\s+", " ", data))


def pipes_for_html(md: str) -> str:
    """Each HTML table of a text as a pipe table, its first row the header."""

    def swap(m: re.Match) -> str:
        parser = _Rows()
        parser.feed(m[0])
        rows = [r for r in (parser.tables or [[]])[0] if r]
        if not rows:
            return m[0]
        wide = max(map(len, rows))
        safe = [[c.replace("|", "∣").replace("\n", "<br>") for c in r + [""] * (wide - len(r))] for r in rows]
        out = ["| " + " | ".join(r) + " |" for r in safe]
        return "\n".join([out[0], "| " + " | ".join(["---"] * wide) + " |", *out[1:]])

    return re.sub(r"<table[^>]*>.*?</table>", swap, md, flags=re.S | re.I)


@pandas_udf(StringType())
def html_tables_to_pipes(md: pd.Series) -> pd.Series:
    return md.map(lambda x: pipes_for_html(x) if x is not None else None)
