import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from examweft.llm import bpe, packing

EXTRA = ["a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "it's  we'll\n\n x\t y  ", "日本語 テスト १२३ ½²", "\U0001e4d0x ​", "\xa0　 a", "don't 'S  ''s 12ab"]


@pytest.fixture(scope="module")
def texts(spark, odd):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    return odd.select("doc_id", "text").unionByName(more)


def library(path, text):
    return bpe.tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode(texts, none, tokenizer_path):
    rows = bpe.decode(bpe.encode(texts, tokenizer_path), tokenizer_path, keep=("doc_id", "n_tokens")).collect()
    want = sorted((str(r.doc_id), library(tokenizer_path, r.text), r.text or "") for r in texts.collect())
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows)
    assert got == want and all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.encode(none, tokenizer_path).count() == 0


def test_decode_of_any_ids(spark, tokenizer_path):
    rng = random.Random(1)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(0, 40))] for _ in range(50)]
    df = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)] + [(99, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, tokenizer_path).collect()}
    assert got == {i: bpe.tokenizer(tokenizer_path).decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {99: None}


def test_stretches_change_nothing(texts, tokenizer_path, monkeypatch):
    whole = {(r.doc_id, bytes(r.ids)) for r in bpe.encode(texts, tokenizer_path).collect()}
    monkeypatch.setattr(bpe, "STRETCH", 3)
    import pyarrow as pa

    words = [bpe.split_by_library(tokenizer_path, t) for t in EXTRA]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *words], pa.list_(pa.string())), pa.array(["x y z", *[None] * len(words)])], names=["_words", "_odd"])
    parts = [ids[bounds[k] : bounds[k + 1]].tolist() for _, ids, bounds in bpe.stretches(tokenizer_path, batch) for k in range(len(bounds) - 1)]
    assert parts == [library(tokenizer_path, t) for t in ["x y z", *EXTRA]] and len(whole) > 5


def test_pieces(texts, tokenizer_path):
    ids = {}
    for r in texts.collect():
        ids.setdefault(r.doc_id, []).append(library(tokenizer_path, r.text) + [0])
    got = {}
    for r in packing.token_pieces(texts, tokenizer_path, capacity=64).orderBy("piece").collect():
        own = ids[r.doc_id][0]
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) and 0 < r.length <= 64
        got.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length))
    for key, parts in got.items():
        parts = sorted(parts)
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(ids[key][0])
        assert len(parts) == 1 or all(n == 64 for _, _, n in parts[1:])


def packed_rows(spark, lengths, **kw):
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    return packing.pack(df, **kw).collect()


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 2048), 2048, 1024]) for _ in range(3000)]
    rows = packed_rows(spark, lengths, shard=1000)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(rows) == 3000 and len(bins) <= -(-sum(lengths) // 2048) * 1.03 + 4


def test_the_bound_binds():
    """In the query's own settings bins do close, and the sequences stay within one per cent of the lower bound."""
    rng = random.Random(3)
    lengths = [rng.choice([int(rng.paretovariate(0.7) * 12) % 2048 + 1, rng.randint(1, 2048)]) for _ in range(packing.SHARD)]
    bins = packing.Bins(packing.CAPACITY, packing.OPEN_BINS)
    for at in range(0, len(lengths), packing.WINDOW):
        for n in sorted(lengths[at : at + packing.WINDOW], reverse=True):
            bins.place(n)
            assert bins.count <= packing.OPEN_BINS
    assert bins.closed > 0 and bins.opened <= sum(lengths) / packing.CAPACITY * 1.01


def test_columns_left_out(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, 7, "x", 3)], "doc_id long, piece int, start long, length long, ids_crc32 long, _shard string, offset int")
    assert packing.pack(df).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_best_fit_and_closing():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (9, 8, 7, 3, 2, 1)] == [(0, 0), (1, 0), (2, 0), (2, 7), (1, 8), (3, 0)]  # the fullest, bin 0, was closed


def test_packing_of_nothing_and_repeats(spark, none, tokenizer_path):
    assert packing.pack(packing.token_pieces(none, tokenizer_path)).count() == 0
    same = spark.createDataFrame([(1, 0, 0, 5, 7)] * 4, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert sorted(r.offset for r in packing.pack(same).collect()) == [0, 5, 10, 15]


def test_other_columns_pass_through(odd, tokenizer_path):
    kept = bpe.encode(odd.withColumn("words", F.lit(1)), tokenizer_path, keep=("doc_id", "n", "words"))
    assert kept.columns == ["doc_id", "n", "words", "n_tokens", "ids"] and kept.count() == odd.count()


def test_the_newcomer_closes_if_it_is_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 9, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (1, 7)] and bins.closed == 1
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (9, 6, 7, 1, 4, 3)][3] == (2, 7)  # of bins with 1, 4 and 3 left the one with 1 was closed


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 2048), lambda r: r.randint(700, 2048), lambda r: min(2048, int(r.lognormvariate(5.5, 1.2)) + 1)])
def test_windows_are_no_worse_than_arrival(draw):
    rng = random.Random(11)
    lengths = [draw(rng) for _ in range(packing.SHARD)]
    opened = []
    for window in (1, packing.WINDOW):
        bins = packing.Bins(packing.CAPACITY, packing.OPEN_BINS)
        for at in range(0, len(lengths), window):
            for n in sorted(lengths[at : at + window], reverse=True):
                bins.place(n)
        opened.append(bins.opened)
    assert opened[1] <= opened[0]
