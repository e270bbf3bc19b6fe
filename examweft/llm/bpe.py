"""Byte-level BPE through a table of distinct words.

Spark splits texts into words. For each stretch of rows a task takes the distinct words, encodes each of them once, and
takes the ids back by position: a word's place in the text picks its row of the distinct-word table. Decoding looks ids up in
the id-to-piece table, an array of the vocabulary's size, whatever the input. Both are look-ups in arrays within a task, not
joins of tables: as joins they shuffle the distinct words of every stretch, several times the input (figures in the README).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import map_batches, whole_text

SPECIAL = "<|endoftext|>"
#: The splitting pattern of this vocabulary (a fixed value), white space spelled out as Unicode has it.
_S = r"\t-\r\x20\x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Code points that the JVM's Unicode tables don't know; texts with any are split by the library itself.
UNKNOWN = r"\p{Cn}"
#: Words that are encoded at a time: bounds the memory of a task, whatever the length of its texts.
STRETCH = 1_000_000


def words(text: Column) -> Column:
    """The words of a text in order, as array<string>; a special token is a word of its own."""

    def split(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(WORD), F.lit(0))

    parts = F.flatten(F.transform(F.split(text, r"<\|endoftext\|>"), lambda p: F.concat(F.array(F.lit(SPECIAL)), split(p))))
    return F.when(F.contains(text, F.lit(SPECIAL)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(split(text))


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes in one array, and where each id's begin (one more at the end)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    table = {i: bytes(to_byte[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    each = [table.get(i, b"") for i in range(max(table) + 1)]
    ends = np.cumsum([0, *map(len, each)])
    return np.frombuffer(b"".join(each), np.uint8), ends


def ragged(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged table one after another, and the running count of their items (one more than rows)."""
    starts, lengths = bounds[:-1][rows], np.diff(bounds)[rows]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


@cache
def word_encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of one word. Where the vocabulary numbers its pieces in the order of the merges that make
    them, merging by piece number is the same as merging by merge number, and costs a quarter."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["content"]: [t["id"]] for t in spec["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    singles = [i for piece, i in vocab.items() if len(piece) == 1]
    table, ends = pieces(path)
    ranks = {table[ends[i] : ends[i + 1]].tobytes(): i for p, i in vocab.items() if p not in special}
    if made != sorted(set(made)) or max(singles) > made[0] or len(ranks) != len(made) + 256:
        return lambda word: tokenizer(path).encode(word, add_special_tokens=False).ids
    bare = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda word: special[word] if word in special else bare(word)


def encode_words(path: str, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    each = list(map(word_encoder(path), distinct))
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))))
    return np.fromiter(chain.from_iterable(each), np.uint32, bounds[-1]), bounds


def token_ids(path: str, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after another, and the running count by text, from the texts' words."""
    bounds = np.asarray(lists.offsets, np.int64)
    bounds = bounds - bounds[0]
    if not bounds[-1]:
        return np.zeros(0, np.uint32), bounds
    table = lists.flatten().dictionary_encode()
    ids, starts = encode_words(path, table.dictionary.to_pylist())
    out, ends = ragged(ids, starts, np.asarray(table.indices))
    return out, ends[bounds]


def split_by_library(path: str, text: str) -> list[str]:
    t, out = tokenizer(path), []
    for i, part in enumerate(text.split(SPECIAL)):
        out += [SPECIAL] * bool(i) + [part[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part)]
    return out


def with_words(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and the words of each text; where the JVM can't split it, ``_odd`` has the text instead."""
    text = whole_text(text_col)
    odd = F.rlike(text, F.lit(UNKNOWN))
    return df.select(*keep, F.when(~odd, words(text)).alias("_words"), F.when(odd, text).alias("_odd"))


def stretches(path: str, batch: pa.RecordBatch):
    """(rows, ids, bounds) for consecutive rows of a batch with ``_words`` and ``_odd``, a bounded number of words each."""
    lists = batch.column("_words")
    if batch.column("_odd").null_count < batch.num_rows:
        lists = pa.array([w if o is None else split_by_library(path, o) for w, o in zip(lists.to_pylist(), batch.column("_odd").to_pylist(), strict=True)], pa.list_(pa.string()))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + STRETCH, "right")))
        ids, bounds = token_ids(path, lists.slice(at, to - at))
        yield slice(at, to), ids, bounds
        at = to


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, and ids as binary: little-endian unsigned 32-bit integers in order.

    As the tokenizers library with ``add_special_tokens=False``, without truncation or padding. A null or
    empty text has no ids; repeated rows are encoded each; an empty table gives none. ``keep`` names the
    columns that pass through; others are ignored, so that names can't clash.
    """
    keep = list(keep)

    def run(batches):
        for batch in batches:
            for rows, ids, bounds in stretches(tokenizer_path, batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                data = ids.astype("<u4", copy=False)
                blob = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(bounds)), blob], names=[*keep, "n_tokens", "ids"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return with_words(df, text_col, keep).mapInArrow(run, f"{kept}, n_tokens long, ids binary")


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids_col`` and ``decoded``: the text of the ids, malformed UTF-8 replaced as the library does.

    Ids beyond the vocabulary stand for nothing; null ids give null.
    """
    keep = list(dict.fromkeys([*keep, ids_col]))

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, starts = pieces(tokenizer_path)
        out = []
        for blob in batch.column(ids_col):
            if not blob.is_valid:
                out.append(None)
                continue
            ids = np.frombuffer(blob.as_buffer(), "<u4")
            ids = ids[ids < len(starts) - 1]
            data, _ = ragged(table, starts, ids)
            out.append(data.tobytes().decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_batches(df.select(*keep), function, f"{kept}, decoded string")
