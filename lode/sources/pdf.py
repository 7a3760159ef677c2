"""Text of PDF files with the standard library: objects, streams, the page tree, text operators, fonts' maps.

Files are read object by object, without their cross-reference table, so that damaged tables do not
matter. Streams are flate-coded or plain. Encryption is the standard handler with RC4, for which a key is
derived from the user's password; files of the AES handlers are told to be encrypted, and refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

# The padding of passwords, the white space and the delimiters of the format.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
_TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(<<|>>|[\[\]{}()<]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+)")
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\r\n])|(.))", re.S)
#: A gap in a line of text that is as wide as this, in thousandths of the type size, is a blank.
BLANK = 200


class Name(str):
    pass


class Operator(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Encrypted(ValueError):
    pass


class Reader:
    """Tokens and objects of a run of bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        m = _TOKEN.match(self.data, self.at)
        if m is None:
            return None
        self.at = m.end()
        return m[1]

    def value(self) -> Any:
        """The next object; None at the end, and for null."""
        t = self.token()
        if t is None or t == b"null":
            return None
        if t == b"<<":
            out: dict = {}
            while True:
                key = self.value()
                if key is None or key == Operator(">>"):
                    return out
                value = self.value()
                if value == Operator(">>"):
                    return out
                out[str(key)] = value
        if t == b"[":
            items = []
            while self.at < len(self.data):
                x = self.value()
                if isinstance(x, Operator) and x == "]":
                    break
                items.append(x)
            return items
        if t == b"(":
            return self._literal()
        if t == b"<":
            end = self.data.find(b">", self.at)
            end = len(self.data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if t in (b"true", b"false"):
            return t == b"true"
        try:
            number = float(t) if b"." in t else int(t)
        except ValueError:
            return Operator(t.decode("latin-1"))
        if isinstance(number, int) and (m := _REF.match(self.data, self.at)):
            self.at = m.end()
            return Ref(number)
        return number

    def _literal(self) -> bytes:
        depth, start = 1, self.at
        for m in re.compile(rb"\\.|[()]", re.S).finditer(self.data, self.at):
            depth += {b"(": 1, b")": -1}.get(m[0], 0)
            if not depth:
                break
        else:
            self.at = len(self.data)
            return b""
        self.at = m.end()
        return _ESCAPE.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1] else b"" if e[2] else _ESCAPES.get(e[3], e[3]), self.data[start : m.start()])


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, x in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = x ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


class Pdf:
    """The objects of a file. A wrong password, or a handler that is not known, raises Encrypted."""

    def __init__(self, data: bytes, password: str = ""):
        if b"%PDF" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, Any] = {}
        self.trailer: dict = {}
        self.key: bytes | None = None
        at = 0
        while m := _OBJECT.search(data, at):
            r = Reader(data, m.end())
            value = r.value()
            at = max(r.at, m.end())
            start = re.compile(rb"[\0\t\n\f\r ]*stream\r?\n").match(data, at)
            if start and isinstance(value, dict):
                length, end = value.get("Length"), data.find(b"endstream", start.end())
                end = len(data) if end < 0 else end
                if isinstance(length, int) and data[start.end() + length : start.end() + length + 20].strip()[:9] == b"endstream":
                    end = start.end() + length
                value = Stream(value, data[start.end() : end].removesuffix(b"\n").removesuffix(b"\r") if not isinstance(length, int) else data[start.end() : end])
                at = end
                if value.head.get("Type") == "XRef":
                    self.trailer |= value.head
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"trailer", data):
            found = Reader(data, m.end()).value()
            if isinstance(found, dict):
                self.trailer |= found
        if "Encrypt" in self.trailer:
            self.key = self._key(password)
        for stream in [x for x in self.objects.values() if isinstance(x, Stream) and x.head.get("Type") == "ObjStm"]:
            number = next(n for n, x in self.objects.items() if x is stream)
            body, first = self.decoded(stream, number), self.get(stream.head.get("First")) or 0
            places = Reader(body)
            for n, offset in [(places.value(), places.value()) for _ in range(self.get(stream.head.get("N")) or 0)]:
                self.objects.setdefault(n, Reader(body, first + offset).value())

    def get(self, x: Any) -> Any:
        for _ in range(32):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(x.number)
        return x

    def _key(self, password: str) -> bytes:
        """The file's key by the standard handler, if the password is the user's."""
        e = self.get(self.trailer["Encrypt"])
        v, r = e.get("V", 0), e.get("R", 0)
        filters = {self.get(f).get("CFM") for f in self.get(e.get("CF", {})).values()}
        if e.get("Filter") != "Standard" or r > 4:
            raise Encrypted("encrypted by a handler that is not known")
        ids = self.get(self.trailer.get("ID")) or [b""]
        n = self.get(e.get("Length", 40)) // 8 if v > 1 else 5
        h = hashlib.md5((password.encode("latin-1", "replace") + PADDING)[:32] + e["O"][:32] + struct.pack("<I", e["P"] & 0xFFFFFFFF) + ids[0] + (b"\xff" * 4 if r == 4 and e.get("EncryptMetadata") is False else b"")).digest()
        if r >= 3:
            for _ in range(50):
                h = hashlib.md5(h[:n]).digest()
        key = h[:n]
        if r == 2:
            good = rc4(key, PADDING) == e["U"][:32]
        else:
            u = rc4(key, hashlib.md5(PADDING + ids[0]).digest())
            for i in range(1, 20):
                u = rc4(bytes(b ^ i for b in key), u)
            good = u == e["U"][:16]
        if not good:
            raise Encrypted("Incorrect password")
        if filters - {"V2", None}:
            raise Encrypted("encrypted by a handler that is not known")
        return key

    def decoded(self, s: Stream, number: int) -> bytes:
        """The stream's bytes, decrypted and decoded; empty for a filter that is not known."""
        data = s.raw
        if self.key and s.head.get("Type") != "XRef":
            data = rc4(hashlib.md5(self.key + struct.pack("<I", number)[:3] + b"\0\0").digest()[: min(16, len(self.key) + 5)], data)
        filters = self.get(s.head.get("Filter")) or []
        params = self.get(s.head.get("DecodeParms")) or {}
        for f in filters if isinstance(filters, list) else [filters]:
            if f not in ("FlateDecode", "Fl"):
                return b""
            data = zlib.decompressobj().decompress(data)
        p = params if isinstance(params, dict) else {}
        if self.get(p.get("Predictor", 1)) >= 10:
            data = _unpredicted(data, self.get(p.get("Columns", 1)) * max(1, self.get(p.get("Colors", 1)) * self.get(p.get("BitsPerComponent", 8)) // 8))
        return data

    def number(self, x: Any) -> int:
        return x.number if isinstance(x, Ref) else 0

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with inherited resources; each node is visited once."""
        root = self.get(self.trailer.get("Root")) or next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), {})
        todo, seen = [(root.get("Pages"), {})], set()
        while todo:
            ref, held = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref.number in seen):
                continue
            seen.add(self.number(ref))
            held = held | ({"Resources": node["Resources"]} if "Resources" in node else {})
            if "Kids" in node:
                todo += [(k, held) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield held | node

    def text(self, page: dict) -> str:
        """Lines of a page's text in the order of its contents."""
        parts = page.get("Contents")
        parts = parts if isinstance(parts, list) else self.get(parts) if isinstance(self.get(parts), list) else [parts]
        body = b"\n".join(self.decoded(self.get(x), self.number(x)) for x in parts if isinstance(self.get(x), Stream))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps: dict[str, dict[bytes, str]] = {}
        out, operands, font, y = [""], [], None, None

        def show(raw: Any) -> None:
            if isinstance(raw, bytes):
                if font not in maps:
                    maps[font] = self._font(self.get(fonts.get(font)))
                out[-1] += _mapped(raw, maps[font])

        def line() -> None:
            if out[-1]:
                out.append("")

        r = Reader(body)
        while r.at < len(body):
            x = r.value()
            if not isinstance(x, Operator):
                if x is None and not body[r.at :].strip():
                    break
                operands.append(x)
                continue
            if x == "Tf" and operands:
                font = operands[0]
            elif x in ("Td", "TD") and len(operands) > 1:
                if operands[1]:
                    line()
                elif out[-1] and not out[-1].endswith(" "):
                    out[-1] += " "
            elif x == "Tm" and len(operands) > 5:
                if y is not None and operands[5] != y:
                    line()
                y = operands[5]
            elif x in ("T*", "'", '"'):
                line()
                if operands and x != "T*":
                    show(operands[-1])
            elif x == "Tj" and operands:
                show(operands[-1])
            elif x == "TJ" and operands and isinstance(operands[-1], list):
                for part in operands[-1]:
                    if isinstance(part, (int, float)):
                        out[-1] += " " if part < -BLANK and not out[-1].endswith(" ") else ""
                    else:
                        show(part)
            elif x in ("ET", "BT"):
                line()
                y = None
            elif x == "BI":  # an image inside the contents
                end = body.find(b"EI", r.at)
                r.at = len(body) if end < 0 else end + 2
            operands = []
        return "\n".join(x.rstrip() for x in out).strip("\n")

    def _font(self, font: Any) -> dict[bytes, str]:
        """Codes of a font and their texts, from its map to Unicode; none is Latin text."""
        ref = font.get("ToUnicode") if isinstance(font, dict) else None
        stream = self.get(ref)
        if not isinstance(stream, Stream):
            return {}
        text, out = self.decoded(stream, self.number(ref)), {}
        uni = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[bytes.fromhex(a.decode())] = uni(b)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                for i in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                    out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = uni(c)[:-1] + chr(ord(uni(c)[-1]) + i)
        return out

    def images(self, page: dict) -> int:
        found = self.get((self.get(page.get("Resources")) or {}).get("XObject")) or {}
        return sum(isinstance(self.get(x), Stream) and self.get(x).head.get("Subtype") == "Image" for x in found.values())


def _mapped(raw: bytes, table: dict[bytes, str]) -> str:
    if not table:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    wide = max(map(len, table))
    return "".join(table.get(raw[i : i + wide], "") for i in range(0, len(raw), wide))


def _unpredicted(data: bytes, wide: int) -> bytes:
    """Rows of a stream that a PNG predictor coded: none, left, up; the others do not occur in tables."""
    out, above = bytearray(), bytes(wide)
    for at in range(0, len(data), wide + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + wide])
        for i in range(len(row)):
            row[i] = row[i] + (above[i] if kind == 2 else row[i - 1] if kind == 1 and i else 0) & 255
        above = bytes(row).ljust(wide, b"\0")
        out += row
    return bytes(out)


def pdf_pages(content: bytes, password: str = "") -> list[tuple[int, str, int]]:
    """(page number from 1, text, number of images) of each page."""
    pdf = Pdf(content, password)
    return [(i, pdf.text(p), pdf.images(p)) for i, p in enumerate(pdf.pages(), 1)]


def pdf_markdown(content: bytes, password: str = "") -> str:
    """The pages' texts, a blank line between them."""
    return "\n\n".join(text for _, text, _ in pdf_pages(content, password))


def needs_password(content: bytes) -> bool:
    """Whether a file cannot be opened with the empty password; False for what is no PDF."""
    try:
        Pdf(content)
    except Encrypted:
        return True
    except Exception:  # a damaged file is not an encrypted one
        return False
    return False
