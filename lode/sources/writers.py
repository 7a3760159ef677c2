"""Small DOCX, PPTX and PDF files from texts: what the queries over sources read."""

from __future__ import annotations

import csv
import hashlib
import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

from .pdf import PADDING, rc4

# Namespaces of the formats.
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SLIDE = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def csv_bytes(rows: list[list[str]]) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue().encode()


def docx_bytes(paragraphs: list[tuple[str, str]], table: list[list[str]]) -> bytes:
    """(style, text) of each paragraph, and a table at the end."""
    p = lambda style, text: f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>'
    rows = "".join(f"<w:tr>{''.join(f'<w:tc>{p("", c)}</w:tc>' for c in r)}</w:tr>" for r in table)
    return _zipped({"word/document.xml": f"<w:document {WORD}><w:body>{''.join(p(*x) for x in paragraphs)}<w:tbl>{rows}</w:tbl></w:body></w:document>"})


def pptx_bytes(slides: list[tuple[list[str], list[list[str]]]]) -> bytes:
    """The paragraphs and the table of each slide."""
    p = lambda text: f"<a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p>"
    files = {}
    for i, (texts, table) in enumerate(slides, 1):
        rows = "".join(f"<a:tr>{''.join(f'<a:tc><a:txBody>{p(c)}</a:txBody></a:tc>' for c in r)}</a:tr>" for r in table)
        frame = f"<a:tbl>{rows}</a:tbl>" if table else ""
        files[f"ppt/slides/slide{i}.xml"] = f"<p:sld {SLIDE}><p:sp>{''.join(map(p, texts))}</p:sp>{frame}</p:sld>"
    return _zipped(files)


def pdf_bytes(pages: list[list[str]], images: int = 0, password: str | None = None, owner: str = "owner") -> bytes:
    """Lines of each page, and so many images on each; with a password (an empty one, too) RC4-encrypted with 128 bits."""
    ids = b"0123456789abcdef"
    key = None
    pad = lambda x: (x.encode("latin-1") + PADDING)[:32]
    if password is not None:
        h = hashlib.md5(pad(owner)).digest()
        for _ in range(50):
            h = hashlib.md5(h).digest()
        o = pad(password)
        for i in range(20):
            o = rc4(bytes(b ^ i for b in h), o)
        key = hashlib.md5(pad(password) + o + struct.pack("<i", -4) + ids).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        u = hashlib.md5(PADDING + ids).digest()
        for i in range(20):
            u = rc4(bytes(b ^ i for b in key), u)
    out: list[bytes] = []

    def stream(number: int, head: bytes, data: bytes) -> bytes:
        data = zlib.compress(data)
        if key:
            data = rc4(hashlib.md5(key + struct.pack("<I", number)[:3] + b"\0\0").digest(), data)
        return b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n" % (head, len(data)) + data + b"\nendstream"

    def add(number: int, body: bytes) -> None:
        out.append(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    first = 5 + images
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    add(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    add(2, b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)))
    add(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    named = b" ".join(b"/I%d %d 0 R" % (i, 5 + i) for i in range(images))
    add(4, b"<< /Font << /F1 3 0 R >> /XObject << %s >> >>" % named)
    for i in range(images):
        add(5 + i, stream(5 + i, b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8", b"\x80"))
    for i, lines in enumerate(pages):
        n = first + 2 * i
        add(n, b"<< /Type /Page /Parent 2 0 R /Resources 4 0 R /Contents %d 0 R >>" % (n + 1))
        quoted = (x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines)
        add(n + 1, stream(n + 1, b"", b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(%s) Tj" % x for x in quoted) + b" ET"))
    last = b""
    if key:
        number = first + 2 * len(pages)
        add(number, b"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <%s> /U <%s> >>" % (o.hex().encode(), (u + bytes(16)).hex().encode()))
        last = b" /Encrypt %d 0 R /ID [<%s> <%s>]" % (number, ids.hex().encode(), ids.hex().encode())
    return b"%PDF-1.4\n" + b"".join(out) + b"trailer\n<< /Root 1 0 R" + last + b" >>\n%%EOF\n"
