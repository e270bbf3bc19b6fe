"""N-gram Jaccard join by T-occurrence search (DivideSkip), over word shingles of whole texts.

1. Each text becomes a set of shingle hashes; texts with equal sets become one node.
2. Document frequencies: packed shingles are dealt over buckets by hash, and a bucket answers with the
   shingles that two documents or more have. A node keeps on only if it shares enough of its own
   shingles to reach the threshold with anyone: most texts end here.
3. Lists: with shingles ordered from rare to common, two nodes that reach the threshold share one of
   the first few of each (the prefix filter). A node's label is the least node on its leading shingles'
   lists, taken twice; labels gather most partners. Where a shingle leads under two labels for nodes of
   sizes that fit, those labels are searched against each other too: a unit is a pair of labels (or one
   with itself) and the nodes that reach across. No pairs of nodes are made.
4. T-occurrence search in each unit: a query's short inverted lists are merged with a heap, which skips
   what can't reach T - L occurrences any more; its L longest lists are only probed by binary search for
   what the merge found; documents that reach the required overlap are linked. Each pair of nodes meets in
   one unit only, so that each link is found once; links are counted where they are found, and only those
   that connect something new are handed on. A unit's sides are salted into parts of bounded size, and each
   pair of parts is a cell of its own: a group of near copies, however large, is many small searches.
5. Components of the links; each document gets the smallest identifier of its component.

What moves by shuffle is 8 bytes a shingle once, then only shared shingles. Very common passages are
long lists: they are never merged and never make a unit, unless a text consists mostly of them.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import map_batches, materialize, shuffle_partitions, whole_text, without
from examweft.llm.graph import components

WORDS, PERCENT = 5, 75
#: Text bytes hashed at a time (some 40 bytes of memory each), shingles in a bucket (some 100), shingles and nodes of a part.
STRETCH, BUCKET, PART_TOKENS, PART_NODES = 1 << 20, 1_000_000, 250_000, 128
#: DivideSkip's weight of a long list's length against the number of lists that are set aside.
MU = 0.01

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in the bytes of ``text``, and a hash of each word."""
    space = _SPACE[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[text] * _powers(_BASE, len(text)), dtype=np.uint64)))
    raw = (total[end] - total[begin]) * _powers(_INVERSE, len(text) + 1)[begin]
    return begin, _mix(raw + (end - begin).astype(np.uint64) * _ODD)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are hashed together, a bounded stretch at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < STRETCH):
            size += len(texts[to]) + 1
            to += 1
        joined = np.frombuffer(b" ".join([*texts[at:to], b""]).translate(_LOWER), np.uint8)
        begin, words = word_hashes(joined)
        bounds = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts[at:to])]))
        factors = _mix(np.arange(1, k + 1, dtype=np.uint64))
        full = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            full += words[j : j + len(full)] * (factors[j] | np.uint64(1))
        full = _mix(full + np.uint64(k))
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
            elif b > a:
                yield _mix((words[a:b] * (factors[: b - a] | np.uint64(1))).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
        at = to


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column("_text").cast(pa.binary())]


def _key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def members(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, key): the size of each document's set, and the node it belongs to."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [(len(s), _key(s)) for s in shingle_sets(_texts(batch), k)]
        n, key = zip(*sets, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.int64())], names=["id", "n", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("_text")), function, f"id {kind}, n long, key long")


# --- document frequencies -------------------------------------------------------------------------

#: Documents and shingles of a slice; a run of one document's shingles in a bucket.
SLICE_DOCS, SLICE, RUN = 60_000, 1 << 20, 65_535
_PACKED = "bucket long, slice long, docs binary, counts binary, hashes binary, often binary, keys binary, sizes binary"
_COLUMNS = [c.split()[0] for c in _PACKED.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_COLUMNS)


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of neighbouring entries, and how many entries each has; long runs are cut."""
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    counts = np.diff([*cuts, len(doc)])
    if len(counts) and counts.max() > RUN:
        cuts = np.concatenate([np.arange(c, c + n, RUN) for c, n in zip(cuts, counts, strict=True)])
        counts = np.diff([*cuts, len(doc)])
    return doc[cuts].astype(np.uint16), counts.astype(np.uint16)


def _packed(docs: DataFrame, text_col: str, k: int, buckets: int) -> DataFrame:
    """A slice is some documents of a task. It sends each bucket its shingles there by document (numbered in
    the slice), and to one bucket the table of its nodes and their sizes, which passes through. Its name is
    of its place (partition, number) and its nodes: a task that runs again makes the same, and no two are equal."""

    def run(batches):
        pack = partial(packed, TaskContext.get().partitionId(), count())
        for batch in batches:
            found, held = {}, 0
            for s in shingle_sets(_texts(batch), k):
                if len(s):
                    found[_key(s)] = s
                    held += len(s)
                if held > SLICE or len(found) >= SLICE_DOCS:
                    yield pack(found)
                    found, held = {}, 0
            if found:
                yield pack(found)

    def packed(partition: int, number: Iterator[int], found: dict[int, np.ndarray]) -> pa.RecordBatch:
        sizes, keys = np.array([len(s) for s in found.values()]), np.array(list(found), np.int64)
        name = _key(np.concatenate(([partition, next(number)], keys)))
        flat, doc = np.concatenate(list(found.values())), np.repeat(np.arange(len(sizes)), sizes)
        bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, doc, flat = bucket[order], doc[order], flat[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = [(name % buckets, name, None, None, None, None, keys.tobytes(), sizes.astype(np.uint32).tobytes())]
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            docs, counts = _runs(doc[a:b])
            rows.append((bucket[a], name, docs.tobytes(), counts.tobytes(), flat[a:b].tobytes(), None, None, None))
        return _rows(rows)

    return docs.select(whole_text(text_col).alias("_text")).mapInArrow(run, _PACKED)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: by slice, the shingles that another document has too, and how many documents have them."""
    passing = table.filter(table.column("keys").is_valid())
    table = table.filter(table.column("docs").is_valid())
    if not table.num_rows:
        return passing
    docs, counts, hashes = (_joined(table.column(n), t) for n, t in (("docs", "<u2"), ("counts", "<u2"), ("hashes", "<u8")))
    row = np.repeat(np.arange(table.num_rows), [len(x.as_buffer()) // 2 for x in table.column("docs")])
    place = np.repeat(np.arange(len(docs)), counts)
    order = np.argsort(hashes, kind="stable")
    value = hashes[order]
    cuts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    often = np.diff([*cuts, len(value)])
    many = np.empty(len(hashes), np.int64)
    many[order] = np.repeat(often, often)
    keep = many > 1
    if not keep.any():
        return passing
    hashes, many, row, doc = hashes[keep], np.minimum(many[keep], 65_535).astype(np.uint16), row[place[keep]], docs[place[keep]].astype(np.int64)
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    bucket, slices, rows = table.column("bucket")[0].as_py(), table.column("slice").to_pylist(), []
    for a, b in zip(cuts, [*cuts[1:], len(row)], strict=True):
        here, n = _runs(doc[a:b])
        rows.append((bucket, slices[row[a]], here.tobytes(), n.tobytes(), hashes[a:b].tobytes(), many[a:b].tobytes(), None, None))
    return pa.concat_tables([passing, pa.Table.from_batches([_rows(rows)])])


def suspects(docs: DataFrame, text_col: str, k: int, percent: int, buckets: int) -> DataFrame:
    """(key, slice, n, tokens, prefix): nodes that share enough; their shared shingles from rare to common, and how many lead.

    A node is there once for each slice that has it.
    """

    def chosen(table: pa.Table) -> pa.Table:
        named = table.filter(table.column("keys").is_valid())
        table = table.filter(table.column("docs").is_valid())
        keys, sizes = _joined(named.column("keys"), "<i8"), _joined(named.column("sizes"), "<u4").astype(np.int64)
        docs, counts, token, often = (_joined(table.column(n), t) for n, t in (("docs", "<u2"), ("counts", "<u2"), ("hashes", "<i8"), ("often", "<u2")))
        doc = np.repeat(docs, counts).astype(np.int64)
        shared = np.bincount(doc, minlength=len(keys))
        enough = shared * 100 >= sizes * percent
        keep = enough[doc]
        doc, often, token = doc[keep], often[keep], token[keep]
        order = np.lexsort((token, often, doc))
        picked = np.flatnonzero(enough)
        n = sizes[picked]
        bounds = np.concatenate(([0], np.cumsum(shared[picked])))
        tokens = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(token[order], pa.int64())).cast(pa.list_(pa.int64()))
        prefix = shared[picked] + (-n * percent // 100) + 1  # shingles of its own come first and lead nowhere
        return pa.table({"key": pa.array(keys[picked], pa.int64()), "slice": pa.array(np.full(len(picked), named.column("slice")[0].as_py())), "n": pa.array(n), "tokens": tokens, "prefix": pa.array(prefix, pa.int32())})

    shared = _packed(docs, text_col, k, buckets).groupBy("bucket").applyInArrow(_shared, _PACKED)
    return shared.groupBy("slice").applyInArrow(chosen, "key long, slice long, n long, tokens array<long>, prefix int")


def reaches(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, shared, a, b): the label ``a`` of each node that shares a leading shingle with another one, and each label
    ``b`` (``a`` is one) that has a leading shingle of it with a node of a size that fits."""
    leads = nodes.select("key", "n", F.size("tokens").alias("shared"), F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token"))
    first = leads.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    led = materialize(leads.join(first.select("token", "first"), "token"), "leads")
    least = materialize(led.groupBy("key").agg(F.min("first").alias("least")), "least")
    above = least.select(F.col("key").alias("least"), F.col("least").alias("higher"))
    labels = least.join(above, "least").select("key", F.col("higher").alias("a"))
    led = materialize(led.join(labels, "key").select("key", "n", "shared", "token", "a"), "labelled")
    heads = led.groupBy("token", F.col("a").alias("b")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    fits = (F.col("high") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("low") * percent)
    return led.join(heads, "token").where(fits).select("key", "shared", "a", "b").distinct()


def cells(nodes: DataFrame, percent: int, part_tokens: int = PART_TOKENS, part_nodes: int = PART_NODES) -> DataFrame:
    """(key, low, high, x, y, role): the cells in which a node is searched; low and high are a unit's labels, x and y parts of
    its sides. Roles as in ``_links``."""
    own = F.col("a") <= F.col("b")
    met = materialize(reaches(nodes, percent).select("key", "shared", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), own.alias("own")), "reaches")
    side = lambda is_own: [f(F.when(F.col("own") == is_own, v)) for f, v in ((F.count, F.lit(1)), (F.sum, F.col("shared")))]
    (m, p), (n, q) = side(True), side(False)
    parts = lambda count, tokens: F.greatest(F.ceil(count / part_nodes), F.ceil(F.coalesce(tokens, F.lit(0)) / part_tokens))
    sizes = met.groupBy("low", "high").agg(m.alias("m"), n.alias("n"), parts(m, p).alias("own_parts"), parts(n, q).alias("other_parts"))
    sizes = materialize(sizes.where("(low = high and m > 1) or (low < high and m > 0 and n > 0)").drop("m", "n"), "sizes")
    one, own = F.col("low") == F.col("high"), F.col("own")
    here = F.pmod(F.xxhash64("key"), F.when(own, F.col("own_parts")).otherwise(F.col("other_parts")))
    there = F.when(one | ~own, F.col("own_parts")).otherwise(F.col("other_parts"))
    rows = met.join(sizes, ["low", "high"]).select("key", "low", "high", "own", one.alias("one"), here.alias("here"), F.explode(F.sequence(F.lit(0).cast("long"), there - 1)).alias("there"))
    one, here, there = F.col("one"), F.col("here"), F.col("there")
    x = F.when(one, F.least(here, there)).when(own, here).otherwise(there)
    y = F.when(one, F.greatest(here, there)).when(own, there).otherwise(here)
    listed = F.when(one, here < there).otherwise(own)
    return rows.select("key", "low", "high", x.alias("x"), y.alias("y"), F.when(one & (here == there), "a").when(listed, "i").otherwise("q").alias("role"))


# --- T-occurrence search --------------------------------------------------------------------------

class Lists:
    """Inverted lists of some nodes; nodes are numbered by their place."""

    def __init__(self, keys: list[int], sizes: list[int], tokens: list[np.ndarray], percent: int):
        self.keys, self.sizes, self.percent = keys, np.asarray(sizes, np.int64), percent
        flat = np.concatenate(tokens)
        node = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        cuts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        self.values, self.ends, self.nodes = flat[cuts], np.append(cuts[1:], len(flat)), node[order]
        self.places = np.repeat(np.arange(len(cuts)) * len(tokens), np.diff([*cuts, len(flat)])) + self.nodes

    def of(self, tokens: np.ndarray, after: int = -1) -> list[np.ndarray]:
        """The lists of some tokens, of nodes beyond ``after`` only, the shortest first; none is empty."""
        at = np.minimum(np.searchsorted(self.values, tokens), len(self.values) - 1)
        at = at[self.values[at] == tokens]
        begin, end = np.searchsorted(self.places, at * len(self.sizes) + after + 1), self.ends[at]
        order = np.argsort(end - begin, kind="stable")
        return [self.nodes[a:b] for a, b in zip(begin[order].tolist(), end[order].tolist(), strict=True) if a < b]

    def search(self, tokens: np.ndarray, n: int, after: int = -1) -> np.ndarray:
        """The nodes beyond ``after`` whose Jaccard similarity with a set of size ``n`` reaches the threshold."""
        p = self.percent
        least = -(-n * p // 100)  # the overlap that any partner needs: sizes differ by the threshold at most
        lists = self.of(tokens, after)
        if len(lists) < least:
            return np.zeros(0, np.int64)
        longest = len(lists[-1])
        set_aside = min(least - 1, int(least / (MU * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - set_aside], lists[len(lists) - set_aside :][::-1]
        merged = np.array(list(merge_skip([one.tolist() for one in short], least - set_aside)), np.int64).reshape(-1, 2)
        size = self.sizes[merged[:, 0]]
        fits = (size * 100 >= n * p) & (n * 100 >= size * p)
        node, count, need = merged[fits, 0], merged[fits, 1], -(-(n + size[fits]) * p // (100 + p))
        for left, one in zip(range(len(long), 0, -1), long, strict=True):
            going = count + left >= need
            if not going.all():
                node, count, need = node[going], count[going], need[going]
            if not len(node):
                break
            at = np.minimum(np.searchsorted(one, node), len(one) - 1)
            count = count + (one[at] == node)
        return node[count >= need]


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(node, occurrences) of nodes in ``least`` of the sorted lists or more.

    The heap holds each list's next node. Nodes at its top that are too few are popped together with as
    many others as can't make a difference, and those lists skip to the node then on top.
    """
    heap = [(one[0], i) for i, one in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        node, popped = heap[0][0], []
        while heap and heap[0][0] == node:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield node, len(popped)
            to = node + 1
        else:
            for _ in range(min(len(heap), least - 1 - len(popped))):
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            to = heap[0][0]
        for i in popped:
            one = lists[i]
            at[i] = bisect_left(one, to, at[i])
            if at[i] < len(one):
                heapq.heappush(heap, (one[at[i]], i))


def _links(rows: list[tuple], percent: int) -> list[tuple[int, int, int]]:
    """(u, v, 0): each node that one cell's links connect to a smaller one, with the smallest; (u, u, n): links of ``u`` to documents.

    Rows: key, n, docs, tokens, role; "a": is listed and asks for larger keys, "i": is listed, "q": asks.
    So each link is found once; it counts for both ends.
    """
    listed = sorted((r for r in rows if r[4] != "q"), key=lambda r: r[0])
    asking = [r for r in rows if r[4] != "i"]
    if not listed or not asking:
        return []
    keys, sizes, docs, tokens, _ = zip(*listed, strict=True)
    lists, order = Lists(keys, sizes, tokens, percent), np.array(keys, np.int64)
    names = np.unique(np.concatenate((order, np.array([r[0] for r in asking], np.int64))))
    place, weights = np.searchsorted(names, order), np.array(docs, np.int64)
    group, number = np.arange(len(names)), np.zeros(len(names), np.int64)
    for key, n, own_docs, own, role in asking:
        found = lists.search(own, n, int(np.searchsorted(order, key)) if role == "a" else -1)
        if not len(found):
            continue
        at, to = int(np.searchsorted(names, key)), place[found]
        number[at] += weights[found].sum()
        number[to] += own_docs
        met = np.unique(np.append(group[to], group[at]))
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
    joined = [(int(names[i]), int(names[group[i]]), 0) for i in np.flatnonzero(group != np.arange(len(names)))]
    return joined + [(int(names[i]), int(names[i]), int(number[i])) for i in np.flatnonzero(number)]


def _search(rows: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(u, v, n) of all cells; a cell's rows are together and are held one cell at a time."""
    names = ["low", "high", "x", "y"]
    dealt = rows.repartition(partitions, *names).sortWithinPartitions(*names)

    def run(batches):
        now, held = None, []
        for batch in batches:
            cell = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            tokens = batch.column("tokens")
            for i, (c, key, n, docs, role) in enumerate(zip(cell, *(batch.column(c).to_pylist() for c in ("key", "n", "docs", "role")), strict=True)):
                if c != now:
                    if held:
                        yield edges(_links(held, percent))
                    now, held = c, []
                held.append((key, n, docs, np.asarray(tokens[i].values), role))
        if held:
            yield edges(_links(held, percent))

    def edges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["u", "v", "n"])

    return dealt.select(*names, "key", "n", "docs", "tokens", "role").mapInArrow(run, "u long, v long, n long")


def links(nodes: DataFrame, classes: DataFrame, percent: int = PERCENT, **sizes: int) -> DataFrame:
    """(u, v, n): connections of nodes (key, slice, n, tokens, prefix) by links, enough of them that all components are whole,
    and rows (u, u, n) whose sum is a node's number of links to documents of other nodes; classes: key, docs."""
    met = materialize(cells(nodes, percent, **sizes), "cells")
    once = nodes.groupBy("key").agg(F.min("slice").alias("slice")).join(met.select("key").distinct(), "key", "left_semi")
    whole = materialize(nodes.join(once, ["key", "slice"]).join(classes, "key").select("key", "n", "docs", "tokens"), "asked")
    return materialize(_search(met.join(whole, "key"), percent, shuffle_partitions(nodes.sparkSession)), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, **sizes: int) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_shingles, component_id, class_id, n_links.

    Documents link when 100 * |intersection| >= percent * |union| of their distinct ``k``-word shingles
    (fewer words: one shingle of all). ``component_id`` is the smallest identifier that links lead to,
    ``class_id`` is the same for documents with equal sets, ``n_links`` is the number of other documents that a
    document links to, equal sets included. A null or empty text has no shingles and is a
    component of its own. Rows with equal identifiers are each a document; a null identifier counts as
    larger than any (a component of such rows only has null). An empty table gives an empty result; other columns are ignored.
    Shingles are compared by their 64-bit hashes, equal sets by 64-bit digests; of ``m`` different ones, m * m / 2**65 pairs
    or so fall together.
    """
    own = materialize(members(docs, id_col, text_col, k), "members")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET))
    nodes = materialize(suspects(docs, text_col, k, percent, buckets), "nodes")
    classes = materialize(own.where("n > 0").groupBy("key").agg(F.count("*").alias("docs")), "classes")
    found = links(nodes, classes, percent, **sizes)
    groups = components(found.select("u", "v")).select(F.col("node").alias("key"), "root")
    others = found.where("u = v").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("others"))
    numbers = classes.join(groups, "key", "left").join(others, "key", "left")
    numbers = materialize(numbers.select("key", "root", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "numbers")
    rooted = materialize(own.join(numbers, "key", "left").withColumns({"root": F.coalesce("root", "key"), "n_links": F.coalesce("n_links", F.lit(0))}), "rooted")
    least = materialize(rooted.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id")), "least")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rooted.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"), F.col("key").alias("class_id"), "n_links")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that bear the smallest identifier of their component, with all their columns."""
    found = near_duplicates(docs, id_col, text_col)
    stays = F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id")))
    gone = materialize(found.groupBy(F.col(id_col).alias("_gone")).agg(stays.alias("stays")).where("not stays").select("_gone"), "gone")
    return without(docs, gone, id_col)
