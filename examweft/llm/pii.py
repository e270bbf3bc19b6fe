"""Personal data, also in disguise, with offsets into the source text.

Detectors find plain e-mail addresses, IP addresses, card and phone numbers. A chain of transducers then
rewrites disguises (character references, compatible and look-alike characters, invisible ones, digits of
any script, spaced-out addresses, spelled digits, "at" and "dot"). Each transducer keeps its edits, by which
what the detectors find in the rewritten text is mapped back to the source, and added unless it lies within
plain data of its kind. All of it takes time in proportion to a text's length.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import map_batches, whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


# --- detectors ------------------------------------------------------------------------------------

def emails(text: str) -> Iterator[Span]:
    """Each ``@`` takes the local part before it, so that a text without any costs one search."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) < 4 and int(q or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of plain personal data, in order."""
    return sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in DETECTORS[kind](text))


# --- transducers ----------------------------------------------------------------------------------

#: Look-alikes and what they look like (fixed values): Cyrillic, Greek.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXovp", strict=True))
#: Invisible characters (fixed values): soft hyphen, zero-width space, joiners, word joiner, byte order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Spelled digits in English, German, French and Spanish, from zero to nine (fixed values).
DIGITS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_WORDS = {word: str(n) for line in DIGITS for n, word in enumerate(line.split())} | {"oh": "0"}
TIMES = {"double": 2, "triple": 3}

_WORD = rf"(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})"
_TIMES = rf"(?:(?:{'|'.join(TIMES)})[ -]++)?"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[ -]++)?{_TIMES}{_WORD}(?:[ ,-]++(?:{_TIMES}{_WORD}|dot|point|[0-9](?![0-9])))*[ ,-]++{_TIMES}{_WORD}(?!\w)")
_SPELLED_ITEM = re.compile(rf"(?i)plus|({'|'.join(TIMES)})[ -]++({_WORD})|{_WORD}|dot|point|[0-9]|[ ,-]++")
#: Endings that a spelled-out or spaced-out address must have where its marks are plain words or blanks (fixed values).
_ENDINGS = "com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es|it|nl|ch|at|vn|ru|pl|us|ca|au|in|jp"
#: Marks in brackets; blanks around them are taken off by hand, so that a run of blanks is never tried again and again.
_MARK = re.compile(r"(?i)\[\s*+(?:(at)|dot|\.)\s*+\]|\(\s*+(?:(at)|dot|\.)\s*+\)|\{\s*+(?:(at)|dot|\.)\s*+\}|<\s*+(?:(at)|dot|\.)\s*+>")
_PLAIN_AT = re.compile(rf"(?i)(?<=[a-z0-9]) ++at ++(?=[a-z0-9-]+(?:(?: ++dot ++|\.)[a-z0-9-]+)* ++dot ++(?:{_ENDINGS})(?![a-z0-9-]))")
_PLAIN_DOT = re.compile(r"(?i)(?<=[a-z0-9]) ++dot ++(?=[a-z0-9])")
#: Words for the marks in four languages (fixed values). Those that prose uses otherwise count within a whole address only.
_AT_WORD, _DOT_WORD = "(?:at|arroba|arobase)", "(?:dot|punto|punkt|point)"
_ADDRESS = re.compile(rf"(?i)(?<=[a-z0-9]) ++{_AT_WORD} ++[a-z0-9-]++(?:(?: ++{_DOT_WORD} ++|\.)(?!(?:{_ENDINGS})(?![a-z0-9-]))[a-z0-9-]++)*+ ++{_DOT_WORD} ++(?:{_ENDINGS})(?![a-z0-9-])")
_JOINED = re.compile(rf"(?i)(?<=[a-z0-9])_at_[a-z0-9-]++(?:_dot_(?!(?:{_ENDINGS})(?![a-z0-9_-]))[a-z0-9-]++)*+_dot_(?:{_ENDINGS})(?![a-z0-9_-])")
_SHORT_AT = re.compile(rf"(?i)(?<=[a-z0-9])\(a\)(?=[a-z0-9-]++(?:\.(?!(?:{_ENDINGS})(?![a-z0-9.-]))[a-z0-9-]++)*+\.(?:{_ENDINGS})(?![a-z0-9-]))")
_ADDRESS_ITEM = re.compile(rf"(?i)( ++{_AT_WORD} ++|_at_)| ++{_DOT_WORD} ++|_dot_")
_FOREIGN = ("arroba", "arobase", "_at_", "(a)", " punto ", " punkt ", " point ")
_REFERENCE = re.compile(r"(?i)&(?:#x[0-9a-f]{1,6}|#[0-9]{1,7}|commat|period|plus|hyphen|num|lowbar);|%40|%2e|%2b")
_SPACED_END = re.compile(rf"(?i)(?: ?[a-z0-9-]+(?: ?\. ?[a-z0-9-]+)* ?\. ?(?:{_ENDINGS})|(?: [a-z0-9-])+(?: \.(?: [a-z0-9-])+)+)(?![a-z0-9-])")


@cache
def plain_table() -> dict[str, str]:
    """Characters beyond ASCII that stand for ASCII ones: digits of any script, compatible forms, look-alikes, invisible ones."""
    table = {}
    for c in map(chr, range(0x80, 0x110000)):
        if (digit := unicodedata.decimal(c, None)) is not None:
            table[c] = str(digit)
        elif (new := unicodedata.normalize("NFKC", c)).isascii():
            table[c] = new
    return table | {"。": "."} | LOOKALIKES | dict.fromkeys(INVISIBLE, "")


@cache
def strange() -> re.Pattern:
    points = sorted(map(ord, plain_table()))
    ranges, begin = [], points[0]
    for x, y in zip(points, [*points[1:], None], strict=True):
        if y != x + 1:
            ranges.append(f"\\U{begin:08x}-\\U{x:08x}")
            begin = y
    return re.compile(f"[{''.join(ranges)}]")


Edit = tuple[int, int, str]


class Mapped:
    """A rewritten text and the edits of each rewriting, by which places are mapped back to the source."""

    def __init__(self, text: str):
        self.text, self.layers = text, []

    def rewrite(self, edits: list[Edit]) -> None:
        """Edits are (start, end, new text) in order, without overlaps. New text comes from the whole range it replaces."""
        if not edits:
            return
        out, places, at, size = [], [], 0, 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            places.append(size + a - at)
            size += a - at + len(new)
            at = b
        self.text = "".join([*out, self.text[at:]])
        self.layers.append((places, edits))

    def source(self, a: int, b: int) -> Span:
        """Where the characters from ``a`` up to ``b`` came from."""
        last = b - 1
        for places, edits in reversed(self.layers):
            a, last = self._before(places, edits, a)[0], self._before(places, edits, last)[1]
        return a, last + 1

    @staticmethod
    def _before(places: list[int], edits: list[Edit], at: int) -> Span:
        """The first and last character that one character came from."""
        k = bisect_right(places, at) - 1
        if k < 0:
            return at, at
        a, b, new = edits[k]
        past = at - places[k] - len(new)
        return (a, b - 1) if past < 0 else (b + past, b + past)


def references(m: Mapped) -> None:
    def plain(x: str) -> str:
        return chr(int(x[1:], 16)) if x[0] == "%" else html.unescape(x)

    m.rewrite([(*x.span(), plain(x[0])) for x in _REFERENCE.finditer(m.text)])


def plain_characters(m: Mapped) -> None:
    table = plain_table()
    m.rewrite([(*x.span(), table[x[0]]) for x in strange().finditer(m.text)])


def plain_digits(m: Mapped) -> None:
    edits = []
    for run in _SPELLED.finditer(m.text):
        for x in _SPELLED_ITEM.finditer(m.text, *run.span()):
            word = x[0].lower()
            if x[1]:
                new = DIGIT_WORDS[x[2].lower()] * TIMES[x[1].lower()]
            else:
                new = "+" if word == "plus" else "." if word in ("dot", "point") else DIGIT_WORDS.get(word, word if word.isdigit() else "")
            edits.append((*x.span(), new))
    m.rewrite(edits)


def plain_marks(m: Mapped) -> None:
    edits, text, done = [], m.text, 0
    for x in _MARK.finditer(text):
        a, b = x.span()
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, "@" if x.lastindex else "."))
        done = b
    m.rewrite(edits)
    m.rewrite([(*x.span(), "@") for x in _PLAIN_AT.finditer(m.text)])
    m.rewrite([(*x.span(), ".") for x in _PLAIN_DOT.finditer(m.text)])


def plain_addresses(m: Mapped) -> None:
    """Whole addresses whose marks are words of any of the languages, or joined by underscores, or an a in brackets."""
    edits = [(*x.span(), "@") for x in _SHORT_AT.finditer(m.text)]
    for whole in (*_ADDRESS.finditer(m.text), *_JOINED.finditer(m.text)):
        marked = False
        for x in _ADDRESS_ITEM.finditer(m.text, *whole.span()):
            edits.append((*x.span(), "." if marked else "@"))
            marked = True
    m.rewrite(sorted(edits))


def closed_up(m: Mapped) -> None:
    """Blanks within addresses: ``name @ host . com`` and ``n a m e @ h o s t . c o m``."""
    edits, text, done = [], m.text, 0
    at = text.find("@")
    while at >= 0:
        a = at - 1 if text[at - 1 : at] == " " else at
        tail = _SPACED_END.match(text, at + 1)
        if a > done and text[a - 1] in _LOCAL and tail and (a < at or " " in tail[0]):
            # single characters between blanks, up to a word of more than one
            while a - 2 > done and text[a - 2] == " " and text[a - 3] in _LOCAL and (a - 3 == 0 or text[a - 4] == " "):
                a -= 2
            edits += [(i, i + 1, "") for i in range(a, tail.end()) if text[i] == " "]
            done = tail.end()
        at = text.find("@", at + 1)
    m.rewrite(edits)


def disguised(text: str) -> list[tuple[int, int, str]]:
    """What shows only after rewriting, as source ranges; cheap searches pass over texts without any disguise."""
    m = Mapped(text)
    if "&" in text or "%" in text:
        references(m)
    if not m.text.isascii():
        plain_characters(m)
    plain_digits(m)
    low = m.text.lower()
    if any(word in low for word in _FOREIGN):
        plain_addresses(m)
    if "dot" in low or _MARK.search(m.text):
        plain_marks(m)
    if "@" in m.text:
        closed_up(m)
    if not m.layers:
        return []
    found = []
    for a, k, b in detect(m.text):
        begin, end = m.source(a, b)
        found.append((begin, k, end))
    return found


def find(text: str) -> tuple[list, list]:
    """Plain spans, and all spans, as (start, kind's place in KINDS, end) in order."""
    base = detect(text)
    extra = disguised(text)
    if not extra:
        return base, base
    own = [[x for x in base if x[1] == k] for k in range(len(KINDS))]  # in order and without overlaps, in each kind
    starts = [[x[0] for x in kind] for kind in own]

    def within(x: tuple[int, int, int]) -> bool:
        at = bisect_right(starts[x[1]], x[0]) - 1
        return at >= 0 and x[2] <= own[x[1]][at][2]

    return base, sorted({*base, *(x for x in extra if not within(x))})


def shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- columns --------------------------------------------------------------------------------------

def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    The counts and the digest are of plain data, ``spans`` (a string) and ``found`` (an array of
    kind, start, end) of all; offsets are code points, ends exclusive. Null counts as empty and has none;
    spans of different kinds may overlap; repeated rows are scanned each; other columns are ignored.
    """

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("_text").to_pylist():
            base, spans = find(text)
            counts = [sum(k == x[1] for x in base) for k in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]))
        found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), found]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *map(pa.array, zip(*rows, strict=True), types)], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, whole_text(text_col).alias("_text")), function, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>")


def masked(text: str) -> str:
    """The text with each stretch of personal data as ``[KIND]``; overlapping spans become one, named by the first."""
    out, at, stretches = [], 0, []
    for a, k, b in find(text)[1]:
        if stretches and a < stretches[-1][2]:
            stretches[-1][2] = max(b, stretches[-1][2])
        else:
            stretches.append([a, k, b])
    for a, k, b in stretches:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all personal data in ``text_col`` masked; every row and column stays, null stays null."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(masked, na_action="ignore")

    return docs.withColumn(text_col, mask(F.col(text_col)))
