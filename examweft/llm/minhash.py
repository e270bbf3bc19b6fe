"""Near duplicates by circulant MinHash, banding and exact verification.

1. Each text becomes a set of shingle hashes; texts with equal sets (128-bit digests) become one node.
2. Circulant signatures: one permutation of the 32-bit universe is applied to a set once; a second one, circularly shifted
   by 0, 1, 2, ..., gives all coordinates: coordinate k is the least ``second((first(x) + k) mod 2**32)`` of the set.
   Bands of neighbouring coordinates are buckets; nodes alone in all their buckets end here.
3. Groups: nodes that shared buckets lead to, over any number of nodes. No link leaves a group, so one that fits in a cell is
   compared there, all with all; each of its sets moves to its cell once. Steps 4 and 5 are for larger groups only.
4. Rounds of parts: each node goes to one bucket, the largest that it is in, with its whole set. A bucket is cut into parts of bounded
   size by a hash; each part has the bucket's first node too, and all that link in a part are joined. Sets move once each.
   Then only buckets go on that hold several components yet (of equal ones, one), in parts dealt anew, until a round
   joins few: a large group of near copies is one component after some rounds, without its pairs. A node carries its
   buckets, so that a round looks its component up once and not once for each bucket.
5. What is left is compared whole, first within each node's largest bucket, then in all its other buckets but for pairs that
   have met: nodes of the largest side of a bucket meet the others, part by part, and the others meet each other. Pairs
   that are joined already aren't compared again.
6. Components of the links; each document gets the smallest identifier of its component.

Links are confirmed by counting common hashes of whole sets. A link at the threshold is in no common bucket with a
probability of ``(1 - 0.85**6)**32``, 3 in 10**7; a component loses it only if nothing else connects its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import map_batches, materialize, may_be_in, shuffle_partitions, whole_text
from examweft.llm.graph import components
from examweft.llm.jaccard import shingle_sets

WORDS, PERCENT = 3, 85
BANDS, ROWS = 32, 6
#: Nodes and shingles of a part.
PART_NODES, PART_TOKENS = 2048, 1_000_000
#: A round of parts is followed by another one if it joined one of so many nodes of the buckets that are still mixed.
AGAIN = 20
#: Shingles whose coordinates are computed at a time.
BLOCK = 1 << 15


def _permuted(x: np.ndarray, one: int, two: int, spare: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    for shift, factor in ((16, one), (13, two), (16, 0)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def coordinates(sets: list[np.ndarray], number: int) -> np.ndarray:
    """The first ``number`` coordinates of each of some sets (none of them empty)."""
    out = np.empty((len(sets), number), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= BLOCK):
            size += len(sets[to])
            to += 1
        placed = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        spare, moved = np.empty_like(placed), np.empty_like(placed)
        _permuted(placed, 0x7FEB352D, 0x846CA68B, spare)
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for k in range(number):
            np.add(placed, np.uint32(k), out=moved)  # the circular shift: numbers wrap around
            out[at:to, k] = np.minimum.reduceat(_permuted(moved, 0x85EBCA6B, 0xC2B2AE35, spare), starts)
        at = to
    return out


def buckets(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit name for each set and band, of the band's number and coordinates."""
    found = coordinates(sets, bands * rows).reshape(len(sets), bands, rows).astype(np.uint64)
    name = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), 1))
    for j in range(rows):
        name = (name ^ found[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())]


def signed(docs: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """(id, n, key, bands): the size of each document's set, its digest and the buckets that it is in; none for an empty set."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(_texts(batch), k))
        full = [s for s in sets if len(s)]
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(np.where(sizes > 0, BANDS, 0))
        names = buckets(full).reshape(-1) if full else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(names))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(map(_digest, sets), pa.binary()), lists], names=["id", "n", "key", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), function, f"id {kind}, n long, key binary, bands array<long>")


def whole_sets(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """``asked`` (key, id, ...) with ``tokens``, from the texts; only rows that pass a filter of identifiers are read again. Rows that
    share an identifier and a set all come."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(_texts(batch), k))
        lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(_digest, sets), pa.binary()), lists], names=["id", "key", "tokens"])

    maybe, kind = may_be_in(asked.select("id")), docs.schema[id_col].dataType.simpleString()
    rows = docs.where(maybe(F.col(id_col))).select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    found = map_batches(rows, function, f"id {kind}, key binary, tokens array<long>")
    return found.join(asked, (found["key"] == asked["key"]) & found["id"].eqNullSafe(asked["id"])).select(asked["*"], found["tokens"])


def once(sets: DataFrame) -> DataFrame:
    """A written table (node, n, tokens) without repeated nodes."""
    if sets.groupBy("node").agg(F.count("*").alias("times")).where("times > 1").isEmpty():
        return sets
    return materialize(sets.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("tokens").alias("tokens")), "sets")


# --- verification ---------------------------------------------------------------------------------

def linked(nodes: list[int], known: list[int], sizes: np.ndarray, tokens: list[np.ndarray], role: list[str], percent: int) -> list[tuple[int, int]]:
    """Of one cell: (u, v) for each known component that links join to another one, by a node of it and of the other.

    Roles: "a" meets all others of the cell, "i" and "q" each other. Nodes with the same ``known`` component aren't compared.
    """
    listed = np.array([i for i, r in enumerate(role) if r != "q"], np.int64)
    flat, owner = np.concatenate([tokens[i] for i in listed] or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(listed)), [len(tokens[i]) for i in listed])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    names, group = np.unique(np.array(known, np.int64), return_inverse=True)
    group = group.copy()
    for i in (i for i, r in enumerate(role) if r != "i"):
        fits = (sizes[listed] * 100 >= sizes[i] * percent) & (sizes[i] * 100 >= sizes[listed] * percent) & (group[listed] != group[i])
        if not fits.any():
            continue
        low, high = np.searchsorted(flat, tokens[i], "left"), np.searchsorted(flat, tokens[i], "right")
        count = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(listed))
        met = listed[fits & (both * (100 + percent) >= (sizes[listed] + sizes[i]) * percent)]
        if len(met):
            together = np.unique(np.append(group[met], group[i]))
            group[np.isin(group, together)] = together[0]
    ends: dict[int, int] = {}  # of each known component and each joined group its first node here
    first: dict[int, int] = {}
    for node, name, g in zip(nodes, known, group.tolist(), strict=True):
        first.setdefault(name, node)
        ends.setdefault(g, node)
    joined = {first[name]: ends[g] for name, g in zip(known, group.tolist(), strict=True)}
    return [(u, v) for u, v in joined.items() if u != v]


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) of all cells of ``rows`` (bucket, x, y, node, known, n, tokens, role); a cell's rows are together, held one cell
    at a time, one row for each node."""
    names = ["bucket", "x", "y"]
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            tokens = batch.column("tokens")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (*names, "node", "known", "n", "role")), strict=True)):
                if row[:3] != now:
                    yield from answer([*held.values()])
                    now, held = row[:3], {}
                if row[3] not in held:
                    held[row[3]] = (*row[3:], np.asarray(tokens[i].values))
        yield from answer([*held.values()])

    def answer(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            nodes, known, n, role, tokens = zip(*held, strict=True)
            if found := linked(list(nodes), list(known), np.array(n, np.int64), list(tokens), list(role), percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    return dealt.select(*names, "node", "known", "n", "role", "tokens").mapInArrow(run, "u long, v long")


def _parts(nodes: str, tokens: str) -> Column:
    return F.greatest(F.ceil(F.col(nodes) / PART_NODES), F.ceil(F.col(tokens) / PART_TOKENS), F.lit(1))


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts)


def in_buckets(named: DataFrame) -> DataFrame:
    """``named`` (node, n, buckets, ...) with a row for each bucket of a node: bucket and size instead of buckets."""
    return named.withColumn("b", F.explode("buckets")).select("b.*", *(c for c in named.columns if c != "buckets"))


def homes_of(rows: DataFrame) -> DataFrame:
    """One bucket for each node of ``rows`` (bucket, size, node, n, known), the one that most nodes are in."""
    homes = rows.groupBy("node").agg(F.max(F.struct("size", "bucket"))["bucket"].alias("bucket"), F.max("n").alias("n"), F.max("known").alias("known"))
    return materialize(homes, "homes")


def group_links(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links within groups that each fit in a cell; ``sets`` (node, n, tokens, root) has their nodes."""
    cell = [F.col("root").alias("bucket"), F.lit(0).alias("x"), F.lit(0).alias("y")]
    return materialize(_verified(sets.select(*cell, "node", F.col("node").alias("known"), "n", "tokens", F.lit("a").alias("role")), percent), "group")


def part_links(homes: DataFrame, sets: DataFrame, percent: int, number: int) -> DataFrame:
    """(u, v): links of nodes (node, bucket, n, known) within the parts of their buckets; ``number`` deals the parts anew."""
    kept = homes.groupBy("bucket").agg(F.count("*").alias("nodes"), F.sum("n").alias("tokens"), F.min(F.struct("node", "known")).alias("first")).where("nodes > 1")
    kept = materialize(kept.select("bucket", "first", _parts("nodes", "tokens").alias("parts")), "kept")
    own = homes.join(kept, "bucket").select("bucket", F.pmod(F.xxhash64("node", F.lit(number)), F.col("parts")).alias("x"), "node", "known")
    visits = kept.where("parts > 1").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("x"), "first.node", "first.known")
    places = own.unionByName(visits).distinct()
    rows = places.join(sets, "node").select("bucket", "x", F.lit(0).alias("y"), "node", "known", "n", "tokens", F.lit("a").alias("role"))
    return materialize(_verified(rows, percent), "part")


def named_by(spread: DataFrame, found: DataFrame) -> DataFrame:
    """``spread`` (node, n, buckets) with the components ``known`` after the links ``found``; a node is looked up once, whatever
    the number of its buckets."""
    groups = components(found).select("node", F.col("root").alias("known"))
    return materialize(spread.join(groups, "node", "left").withColumn("known", F.coalesce("known", "node")), "named")


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """(bucket): of ``rows`` (bucket, size, node, known) the buckets that hold several components; of equal ones one."""
    whole = rows.groupBy("bucket").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.any_value("size").alias("size")).where("a < b")
    return materialize(whole.groupBy("sum", "size").agg(F.min("bucket").alias("bucket")).select("bucket"), "once")


def cross_links(rows: DataFrame, once: DataFrame, sets: DataFrame, percent: int, group: str) -> DataFrame:
    """(u, v): the links that join components of each bucket of ``once``, but for pairs of one ``group``, a column of ``rows``
    (bucket, node, n, known). Rows of other buckets, and of those with one group only, have nothing to meet and go no further."""
    rows = rows.withColumn("side", F.col(group))
    shares = rows.groupBy("bucket", "side").agg(F.count("*").alias("nodes"), F.sum("n").alias("tokens"))
    sums = shares.groupBy("bucket").agg(F.count("*").alias("sides"), F.max_by(F.struct("side", "nodes", "tokens"), F.struct("nodes", "side")).alias("most"), F.sum("nodes").alias("nodes"), F.sum("tokens").alias("tokens"))
    sums = sums.where("sides > 1").join(once, "bucket")
    sums = sums.select("bucket", F.col("most.side").alias("most"), _parts("most.nodes", "most.tokens").alias("large"), (F.col("nodes") - F.col("most.nodes")).alias("nodes"), (F.col("tokens") - F.col("most.tokens")).alias("tokens"))
    sums = materialize(sums.select("bucket", "most", "large", _parts("nodes", "tokens").alias("rest")), "sums")
    rows = rows.join(sums, "bucket").withColumn("inside", F.col("side") == F.col("most"))
    rows = rows.withColumn("here", _dealt(F.when(F.col("inside"), F.col("large")).otherwise(F.col("rest"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda x, y, role: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), role.alias("role"))
    # Parts of the rest are numbered from 0, those of the largest component from -1 down.
    across = F.when(F.col("inside"), F.transform(upto(F.col("rest")), lambda j: cell(-1 - F.col("here"), j, F.lit("i"))))
    across = across.otherwise(F.transform(upto(F.col("large")), lambda i: cell(-1 - i, F.col("here"), F.lit("q"))))
    among = F.transform(upto(F.col("rest")), lambda j: cell(F.least(F.col("here"), j), F.greatest(F.col("here"), j), F.when(F.col("here") == j, "a").when(F.col("here") < j, "i").otherwise("q")))
    cells = F.when(F.col("inside"), across).otherwise(F.concat(across, among))
    places = materialize(rows.select("bucket", "node", "known", F.explode(cells).alias("c")).select("bucket", "node", "known", "c.*"), "places")
    return materialize(_verified(places.join(sets, "node").select("bucket", "x", "y", "node", "known", "n", "tokens", "role"), percent), "cross")


def large_group_links(spread: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that join all that is linked in groups of any size; ``spread`` (node, n, buckets) and ``sets`` (node, n, tokens) have their nodes."""
    homes, found, number = homes_of(in_buckets(spread.withColumn("known", F.col("node")))), None, 0
    while True:
        new = part_links(homes, sets, percent, number)
        if number and new.isEmpty():  # nothing that follows from the links has changed
            break
        found, number = new if found is None else found.unionByName(new), number + 1
        named = named_by(spread, found)
        once = mixed_buckets(in_buckets(named))
        homes = homes_of(in_buckets(named).join(once, "bucket"))
        if new.count() * AGAIN < homes.count():
            break
    new = cross_links(homes, once, sets, percent, "known")
    if not new.isEmpty():
        found = found.unionByName(new)
        named = named_by(spread, found)
        once = mixed_buckets(in_buckets(named))
    # Nodes of buckets that are still mixed have a home; other buckets aren't asked for.
    homed = materialize(named.join(homes.select("node", F.col("bucket").alias("home")), "node"), "homed")
    return found.unionByName(cross_links(in_buckets(homed), once, sets, percent, "home"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_shingles, component_id, kept.

    Documents link when 100 * |intersection| >= percent * |union| of their distinct ``k``-word shingles (fewer words: one
    shingle of all). ``component_id`` is the smallest identifier that links lead to; ``kept`` marks the document that bears it.
    A null or empty text has no shingles and is a component of its own. Rows with equal identifiers are each a document (all
    that bear the smallest are kept); a null identifier counts as larger than any (a component of such rows only has null).
    An empty table gives an empty result; other columns are ignored. Shingles are compared by 64-bit hashes.
    """
    own = materialize(signed(docs, id_col, text_col, k), "signed")
    each = own.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = materialize(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")).where("first < last")
    shared = materialize(shared.select("bucket", "first", "size"), "shared")
    maybe = may_be_in(shared.select("bucket"))
    met = materialize(banded.where(maybe(F.col("bucket"))).join(shared, "bucket"), "met")
    groups = components(met.select(F.col("node").alias("u"), F.col("first").alias("v")))
    grouped = materialize(nodes.select("node", "key", "id", "n").join(groups, "node"), "grouped")
    whole = grouped.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n").alias("tokens")).select("root", (_parts("nodes", "tokens") == 1).alias("whole"))
    asked = materialize(grouped.join(whole, "root"), "asked")
    found = group_links(whole_sets(docs, asked.where("whole"), id_col, text_col, k), percent)
    large = asked.where("NOT whole")
    if not large.isEmpty():
        sets = once(materialize(whole_sets(docs, large, id_col, text_col, k).select("node", "n", "tokens"), "found"))
        own_buckets = F.collect_list(F.struct("size", "bucket")).alias("buckets")  # one for each band at most
        spread = materialize(met.join(large.select("node"), "node").groupBy("node").agg(F.max("n").alias("n"), own_buckets), "spread")
        found = found.unionByName(large_group_links(spread, sets, percent))
    roots = nodes.select("key", "node").join(components(found), "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    rooted = materialize(own.select("id", "n", "key").join(materialize(roots, "roots"), "key", "left"), "rooted")
    least = materialize(rooted.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rooted.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), named.alias("component_id"), F.col("id").eqNullSafe(named).alias("kept"))
