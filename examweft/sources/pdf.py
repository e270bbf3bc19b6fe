"""Text layers of PDF files: a row for each page, by a table function over the files' bytes.

Objects are found by their own marks, so that a damaged cross-reference table does no harm; object streams are opened,
pages are taken in the order of the page tree. A page's text is what its text operators show: strings in WinAnsi or by
their font's ToUnicode map, a line for each move of the text position downwards. What is only drawn or scanned has no
text here; such pages come out empty, for whoever recognises images. A file that can't be read gives one row with its error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|(?=\d+\s+\d+\s+obj\b)|\Z)", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/%]*|[^\s()<>\[\]/%]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_MAP = re.compile(rb"beginbfchar(.*?)endbfchar|beginbfrange(.*?)endbfrange", re.S)
_HEX = rb"<([0-9A-Fa-f\s]+)>\s*"


class Unreadable(ValueError):
    """A file that is no PDF, or one whose contents are locked."""


def _stream(body: bytes) -> bytes:
    """The decoded bytes of an object's stream; empty without one or behind a filter other than Flate."""
    head, found, rest = body.partition(b"stream")
    if not found:
        return b""
    data = rest.removeprefix(b"\r").removeprefix(b"\n").rpartition(b"endstream")[0]
    if b"/Filter" not in head:
        return data
    if b"/FlateDecode" not in head or b"/DCTDecode" in head:
        return b""
    return zlib.decompressobj().decompress(data)


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            inner, first, n = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1]), int(re.search(rb"/N\s+(\d+)", body)[1])
            numbers = list(map(int, inner[:first].split()[: 2 * n]))
            ends = [*numbers[3::2], len(inner) - first]
            for number, at, end in zip(numbers[::2], numbers[1::2], ends, strict=True):
                found.setdefault(number, inner[first + at : first + end])
    return found


def _value(objects: dict[int, bytes], body: bytes, key: bytes) -> bytes:
    """What stands behind a key: an object that it refers to, or the text up to the next key."""
    m = re.search(rb"/" + key + rb"\b\s*(\d+\s+\d+\s+R\b|\[.*?\]|<<(?:[^<>]|<<(?:[^<>]|<<.*?>>)*>>|<[^<>]*>)*>>|[^/<>\[\]]+)", body, re.S)
    if not m:
        return b""
    reference = _REFERENCE.fullmatch(m[1].strip())
    return objects.get(int(reference[1]), b"") if reference else m[1]


def _pages(objects: dict[int, bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(page, resources) in the order of the tree; resources come from above where a page has none."""
    kids = {n for body in objects.values() for n in map(int, _REFERENCE.findall(_value(objects, body, b"Kids")))}
    roots = [n for n, body in objects.items() if n not in kids and re.search(rb"/Type\s*/Pages?\b", body)]
    todo, seen = [(n, b"") for n in reversed(roots)], set()
    while todo:
        number, above = todo.pop()
        if number in seen or number not in objects:
            continue
        seen.add(number)
        body = objects[number]
        own = _value(objects, body, b"Resources") or above
        if re.search(rb"/Type\s*/Pages\b", body):
            todo += [(int(n), own) for n in reversed(_REFERENCE.findall(_value(objects, body, b"Kids")))]
        else:
            yield body, own


def _unicode_map(cmap: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for chars, ranges in _MAP.findall(cmap):
        out |= {int(a, 16): text(b) for a, b in re.findall(_HEX + _HEX, chars)}
        for low, high, start in re.findall(_HEX + _HEX + _HEX, ranges):
            first = text(start)
            out |= {code: first[:-1] + chr(ord(first[-1]) + i) for i, code in enumerate(range(int(low, 16), min(int(high, 16), int(low, 16) + 65_535) + 1)) if first}
    return out


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        if m[1][:1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _shown(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """The text that a content stream shows."""
    out, stack, font = [], [], None

    def text(token: bytes) -> str:
        raw, codes = _literal(token), fonts.get(font)
        if codes is None:
            return raw.decode("cp1252", "replace")
        wide = max(codes, default=0) > 255 or (len(raw) % 2 == 0 and raw[:1] == b"\0")
        numbers = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if wide else raw
        return "".join(codes.get(n, "\ufffd") for n in numbers)

    for token in _TOKEN.findall(content):
        if token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                out.append("\n")
            for t in stack:
                if t[:1] == b"(" or (t[:1] == b"<" and t != b"<<"):
                    out.append(text(t))
                elif token == b"TJ" and re.fullmatch(rb"-\d+(\.\d*)?", t) and float(t) < -200:
                    out.append(" ")  # a gap that is as wide as a space
        elif token == b"Tf" and len(stack) >= 2:
            font = stack[-2]
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and stack and stack[-1] not in (b"0", b"0.0")) or token == b"Tm":
            out.append("\n")
        elif not token.isalpha() or token[:1] == b"/":
            stack.append(token)
            continue
        stack = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def pages(data: bytes) -> Iterator[str]:
    """The text of each page."""
    if b"%PDF-" not in data[:1024]:
        raise Unreadable("no PDF file")
    if re.search(rb"/Encrypt\b", data):
        raise Unreadable("the file is encrypted")
    objects = _objects(data)
    found = list(_pages(objects))
    if not found:
        raise Unreadable("the file has no pages")
    for page, resources in found:
        fonts = {}
        for name, number in re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", _value(objects, resources, b"Font")):
            if cmap := _value(objects, objects.get(int(number), b""), b"ToUnicode"):
                fonts[name] = _unicode_map(_stream(cmap))
        parts = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        numbers = [int(n) for n in _REFERENCE.findall(parts[1])] if parts else []
        inner = b"\n".join(_stream(objects.get(n, b"")) for n in numbers)
        yield _shown(inner, fonts)


class PageText:
    """Table function: (page from 1, text, error) of a file's bytes."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for number, text in enumerate(pages(bytes(content)), 1):
                yield number, text, None
        except Exception as failed:  # noqa: BLE001  one damaged file is a row, not the end of a job
            yield None, None, f"{type(failed).__name__}: {failed}"


def page_texts(files: DataFrame) -> DataFrame:
    """(path, page, text, error) of files (path, content), as ``readers.binary_files`` lists them. An unreadable file is one row with
    its error, after the pages that were read before it failed; null content gives none."""
    reader = F.udtf(PageText, returnType="page int, text string, error string")
    return files.select("path", "content").lateralJoin(reader(F.col("content").outer())).select("path", "page", "text", "error")
