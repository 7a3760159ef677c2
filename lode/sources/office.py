"""Markdown from DOCX and PPTX bytes, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NUMBERED = re.compile(r"(\d+(?:\.\d+){2,})\s*\.?\s+(.+)")


def _pipe(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "∣").replace("\n", "<br>") for c in cells) + " |"


def table_lines(rows: list[list[str]]) -> Iterator[str]:
    """A pipe table; rows whose filled cells are all the same are headings, after which the header is repeated."""
    header: list[str] | None = None
    open_ = False
    for cells in rows:
        filled = [c.strip() for c in cells if c.strip()]
        if filled and len(set(filled)) == 1 and len(cells) > 1:
            yield from ("", f"### {filled[0]}", "")
            open_ = False
            continue
        first = header is None
        header = header or cells
        if not open_:
            yield from (_pipe(header), _pipe(["---"] * len(header)))
            open_ = True
        if not first:
            yield _pipe(cells)


def _paragraph(p: ET.Element) -> str:
    text = "".join((t.text or "") if t.tag == W + "t" else "\t" if t.tag == W + "tab" else "\n" for t in p.iter() if t.tag in (W + "t", W + "tab", W + "br")).strip()
    style = p.find(f"{W}pPr/{W}pStyle")
    name = re.sub(r"\s", "", style.get(W + "val", "")) if style is not None else ""
    if not text:
        return ""
    if m := re.fullmatch(r"Heading([123])", name):
        return "#" * int(m[1]) + " " + text
    if name.startswith("List"):
        return "- " + text
    if m := _NUMBERED.match(text):
        return "#" * min(m[1].count(".") + 1, 6) + " " + text
    return text


def docx_markdown(content: bytes) -> str:
    """Paragraphs and tables of a document body in order."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(W + "body")
    out: list[str] = []
    for x in body:
        if x.tag == W + "p":
            out.append(_paragraph(x))
        elif x.tag == W + "tbl":
            rows = [["\n".join(filter(None, ("".join(t.text or "" for t in p.iter(W + "t")) for p in c.iter(W + "p")))) for c in r.findall(W + "tc")] for r in x.findall(W + "tr")]
            out += ["", *table_lines(rows), ""]
    return "\n".join(out)


def pptx_markdown(content: bytes) -> str:
    """Slides in order: a heading each, then texts, pictures and tables."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out: list[str] = []
    for i, name in enumerate(names, 1):
        out.append(f"## Slide {i}")
        for x in ET.fromstring(z.read(name)).iter():
            if x.tag == P + "pic":
                blip, label = x.find(f".//{A}blip"), x.find(f".//{P}cNvPr")
                linked = blip is not None and blip.get(R + "embed") is None
                out.append("[Image: linked image not available]" if linked else f"[Image: {label.get('name', '') if label is not None else ''}]")
            elif x.tag == P + "sp":
                texts = ("".join((t.text or "") if t.tag == A + "t" else "\n" for t in p.iter() if t.tag in (A + "t", A + "br")).strip() for p in x.iter(A + "p"))
                out += [t for t in texts if t]
            elif x.tag == A + "tbl":
                rows = [["".join(t.text or "" for t in c.iter(A + "t")) for c in r.findall(A + "tc")] for r in x.findall(A + "tr")]
                if rows:
                    out += ["", _pipe(rows[0]), _pipe(["---"] * len(rows[0])), *map(_pipe, rows[1:]), ""]
        out.append("")
    return "\n".join(out)
