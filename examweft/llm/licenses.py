"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases in one pass over a
text's words, and a shunting-yard parser evaluates the licence expressions behind the tags. The phrases are made by a
small grammar of notices: names, versions, clauses, and the word for a licence in either spelling and place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from examweft.llm.common import map_batches, whole_text

#: Notice phrases and their labels, in words (fixed values). The first three are the base.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
PHRASES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc0": "cc0",
    "public domain": "public-domain",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
#: Names that a notice may put before or behind the word for a licence, and their labels (fixed values).
NAMES = {
    "mit": "mit", "apache": "apache", "bsd": "bsd", "isc": "isc", "zlib": "zlib", "gpl": "gpl", "gnu gpl": "gpl", "lgpl": "lgpl", "gnu lgpl": "lgpl", "agpl": "agpl", "gnu agpl": "agpl",
    "mpl": "mpl", "mozilla public": "mpl", "epl": "epl", "eclipse public": "epl", "boost software": "bsl", "general public": "gpl", "lesser general public": "lgpl", "affero general public": "agpl",
}
#: Families whose notices name a version, and the versions in words and in identifiers (fixed values).
VERSIONED = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("3",), "mpl": ("1 1", "2 0"), "epl": ("1 0", "2 0"), "apache": ("1 1", "2 0")}
CLAUSES = {"0": "0", "1": "1", "2": "2", "3": "3", "4": "4", "two": "2", "three": "3", "four": "4"}


def notices() -> dict[str, str]:
    """Phrases of the notice grammar, in words, and their labels: a name beside "license" or "licence" in any of its places, a family with
    its version, a number of clauses. Both spellings, and the words that stand between."""
    found = {}
    for name, label in NAMES.items():
        for word in ("license", "licence"):
            found |= {f"{name} {word}": label, f"{word} {name}": label, f"{word} the {name}": label, f"{name} style {word}": label}
        found |= {f"{name} licensed": label, f"{name} licenced": label}
        for verb in ("licensed", "licenced", "released", "distributed", "available"):
            found |= {f"{verb} under {name}": label, f"{verb} under the {name}": label}
    for name, label in NAMES.items():
        for version in VERSIONED.get(label, ()):
            exact = f"{label}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            ways = (f"v{version}", f"version {version}", *([version] if " " in version else [f"{version} 0"]))
            for way in ways:
                found |= {f"{name} {way}": exact} if way.startswith("v") else {}  # bare numbers only behind the word for a licence
                found |= {f"{name} {word}{comma} {way}": exact for word in ("license", "licence") for comma in ("", " as published by the free software foundation either")}
            found[f"{name}v{version}"] = exact
            found |= {f"{verb} under {the}{name}{way}": exact for verb in ("licensed", "released", "distributed") for the in ("", "the ") for way in (f"v{version}", f" v{version}")}
    for said, n in CLAUSES.items():
        found |= {f"{said} clause bsd": f"bsd-{n}-clause", f"bsd {said} clause": f"bsd-{n}-clause", f"bsd {said} clause license": f"bsd-{n}-clause", f"bsd {said} clause licence": f"bsd-{n}-clause", f"{said} clause bsd license": f"bsd-{n}-clause"}
    return {phrase: label for phrase, label in found.items() if phrase not in BASE_PHRASES} | PHRASES


TAG = "spdx license identifier"
#: How freely a labelled text may be reused (fixed values); identifiers are looked up by their longest prefix.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl": 0.7, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN, NO_LICENCE = 0.5, 0.5
#: Identifiers without a version, and the families whose identifiers go on after a hyphen (fixed values, lower case). An
#: expression's operand is one of these, a reference, or (behind "with") an exception; any other word ends the expression.
PLAIN_IDENTIFIERS = frozenset(
    "0bsd aal abstyles adobe-glyph bitstream-vera beerware blessing curl ftl fsful glide hpnd icu ijg imagemagick info-zip intel isc jasper-2.0 json"
    " latex2e libpng libtiff linux-openib mit mit-0 mit-cmu miros motosoto ms-pl ms-rl naumen ncsa netcdf nlod-1.0 noweb ntp openssl php-3.01 plexus"
    " postgresql psfrag python-2.0 qhull ruby sgi-b-2.0 sleepycat tcl unlicense vim w3c wtfpl x11 xnet zlib zlib-acknowledgement none noassertion".split()
)
FAMILIES = "afl agpl apache apsl artistic bsd bsl cc cc0 cddl cecill cpal cpl ecl efl epl eupl gfdl gpl lgpl lppl mpl ngpl npl odbl ofl osl pddl php psf upl vsl zpl".split()
_REFERENCES = ("licenseref-", "documentref-")
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_EXPRESSION = re.compile(rb"[ \t]*:[ \t]*([A-Za-z0-9.+()/ \t-]+)")
_TOKEN = re.compile(r"[()/]|[A-Za-z0-9.-]+\+?")


@cache
def phrases() -> dict[str, str]:
    return notices()


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in (*BASE_PHRASES, *phrases(), TAG):
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def is_identifier(token: str) -> bool:
    name = token.lower().rstrip("+.")
    family, hyphen, rest = name.partition("-")
    return name in PLAIN_IDENTIFIERS or name.startswith(_REFERENCES) or (family in FAMILIES and bool(hyphen and rest))


def parse_expression(text: str) -> list[str]:
    """The expression at the start of ``text`` in postfix order. Dijkstra's shunting yard: WITH binds most, OR least.

    The expression ends where the next token can't continue it; an operator before a word that is no identifier
    belongs to the prose behind it. ValueError: nothing there, or unbalanced.
    """
    out, stack, want_operand, depth = [], [], True, 0
    for token in _TOKEN.findall(text):
        upper = "OR" if token == "/" else token.upper()  # a slash is a choice, too
        if want_operand:
            exception = stack and stack[-1] == "WITH"
            if token == "(" and not exception:
                stack.append(token)
                depth += 1
            elif token != ")" and ("exception" in token.lower() if exception else is_identifier(token)):
                out.append(token.rstrip("."))
                want_operand = False
            elif out and stack and stack[-1] in PRECEDENCE:
                stack.pop()
                want_operand = False
                break
            else:
                raise ValueError(f"{token!r} where an identifier is wanted")
        elif upper in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[upper]:
                out.append(stack.pop())
            stack.append(upper)
            want_operand = True
        elif token == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            break
    if want_operand or depth:
        raise ValueError("the expression is not complete")
    return out + stack[::-1]


def freedom(identifier: str) -> float:
    name = identifier.lower().rstrip("+")
    return next((FREEDOM[p] for p in sorted(FREEDOM, key=len, reverse=True) if name == p or name.startswith(p + "-")), UNKNOWN)


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """How free the expression is, and its identifiers: OR may choose the freest, AND must keep all; an exception frees halfway."""
    stack, names = [], set()
    for i, token in enumerate(postfix):
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "OR" else min(a, b) if token == "AND" else (a + 1) / 2)
        else:
            exception = i + 1 < len(postfix) and postfix[i + 1] == "WITH"
            names |= set() if exception else {token.lower()}
            stack.append(1.0 if exception else freedom(token))
    return stack[0], names


def tagged(text: bytes, line: str, ends: list[int]) -> Iterator[str]:
    """What stands behind the tags that the automaton found; ``ends`` are places in the line of words, in order."""
    if not ends:
        return
    ends_of_words = [m.end() for m in _WORD.finditer(text.translate(_WORDS))]
    word, at = 0, 1
    for end in ends:
        word += line.count(" ", at, end + 1)
        at = end + 1
        if m := _EXPRESSION.match(text, ends_of_words[word - 1]):
            yield m[1].decode("ascii")


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text in UTF-8."""
    found = text.translate(_WORDS).split()
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    base, labels, starts, longer, tags, known = set(), set(), [], [], [], phrases()
    for end, phrase in automaton().iter(line):
        if phrase == TAG:
            tags.append(end)
        elif label := BASE_PHRASES.get(phrase):
            base.add(label)
            starts.append(end - len(phrase) - 1)
        else:
            longer.append((end - len(phrase) - 1, end, phrase))
    last = -1
    for a, b, phrase in sorted(longer, key=lambda x: (x[0], -x[1])):  # "cc by nc" is not "cc by" as well
        if b > last:
            labels.add(known[phrase])
            last = b
    scores = [freedom(x) for x in base | labels]
    for expression in tagged(text, line, tags):
        try:
            score, names = evaluate(parse_expression(expression))
        except ValueError:
            labels.add("invalid-expression")
            score, names = UNKNOWN, set()
        scores.append(score)
        labels |= names
    places = (line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))) if starts else (None, None)
    return len(found), len(starts), *places, ",".join(sorted(base)), ",".join(sorted(base | labels)), min(scores, default=NO_LICENCE)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, A-Z (lowered) and anything beyond ASCII. ``score`` is the least freedom of
    what was found, 0.5 where nothing was. Null and empty texts have no words and no labels; repeated rows
    are scanned each; other columns are ignored.
    """

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*(scan(t.as_buffer().to_pybytes()) for t in batch.column("_text").cast(pa.binary())), strict=True)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *map(pa.array, cols, types)], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, whole_text(text_col).alias("_text")), function, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
