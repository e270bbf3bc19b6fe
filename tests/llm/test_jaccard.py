import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from examweft.llm import jaccard
from examweft.llm.graph import components


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and 100 * len(x & y) >= percent * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted((str(i), len(s), str(least[root(k)])) for k, (i, s) in enumerate(sets))


def corpus(seed):
    """Groups of near copies, chains, a passage that many share, short texts, copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeABCé", k=3))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 14)):
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = word()
            texts.append(edited)
    chain = [word() for _ in range(100)]
    for _ in range(8):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(list(chain))
    texts += [[word() for _ in range(rng.randint(0, 40))] + passage + [word() for _ in range(rng.randint(0, 40))] for _ in range(30)]
    texts += [[word() for _ in range(rng.randint(1, 5))] for _ in range(10)] + [texts[0]] * 3
    out = [rng.choice([" ", "\n", "\t "]).join(t) for t in texts]
    out += ["a b c", "A B C", "\x0ba b\x0c", "x\xa0y z", None, "", "  "]
    rng.shuffle(out)
    return list(enumerate(out))


def corpus_texts(seed):
    return [t for _, t in corpus(seed)][:40]


@pytest.mark.parametrize("sizes", [{}, {"part_tokens": 300, "part_nodes": 4}])
@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, odd, sizes, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(df, **sizes).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    by_class = {}
    for r in got:
        by_class.setdefault(r.class_id, set()).add(shingles(dict(rows)[r.doc_id]))
    assert all(len(s) == 1 for s in by_class.values())


@pytest.mark.parametrize("sizes", [{}, {"part_tokens": 300, "part_nodes": 4}])
def test_every_link_counts(spark, sizes):
    rows = corpus(3)
    sets = [shingles(t) for _, t in rows]
    want = {i: sum(j != i and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()
    assert {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 4


def test_same_rows_in_several_partitions(spark):
    """Slices with the same nodes are told apart; texts of a similarity of 0.4 do not link."""
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[:34] + [f"v{i}" for i in range(18)])
    assert 0.35 < len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.45
    rows = [(i, t) for i, t in enumerate([a, b] * 6)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")
    got = jaccard.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    nodes = jaccard.suspects(df, "text", 5, 75, 4).collect()
    assert len(nodes) == 12 and all(len(r.tokens) == r.n == len(set(r.tokens)) for r in nodes)


@pytest.mark.parametrize("partitions", ["1", "61"])
def test_partitions_make_no_difference(spark, partitions):
    """The same texts in one and in several partitions, and any number of shuffle partitions, give the same answer;
    two words whose hashes agree in 32 bits and in the bucket's number stay apart."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[:57] + ["x", "y", "z"]), " ".join(words[:40] + [f"v{i}" for i in range(7)])
    pair = ["doc155568", "doc393637"]
    rows = list(enumerate([a, b, c, *pair, *corpus_texts(5)] * 2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for slices in (1, 5):
            df = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), "doc_id long, text string")
            got = jaccard.near_duplicates(df).collect()
            assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
            firsts = {int(i) for i, _, c in brute(rows) if i == c}
            assert slices == 1 or {r.doc_id for r in jaccard.first_of_each(df).collect()} == firsts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_group_is_many_cells(spark):
    """A group of near copies is dealt over parts, and no cell holds more than two of them."""
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(80)], []
    for i in range(150):
        edited = list(base)
        edited[rng.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = jaccard.suspects(df, "text", 5, 75, 4)
    met = jaccard.cells(nodes, 75, part_nodes=16).groupBy("low", "high", "x", "y").count().collect()
    assert max(r["count"] for r in met) <= 2 * 16 * 2 and len(met) > 20
    got = jaccard.near_duplicates(df, part_nodes=16).collect()
    sets = [shingles(t) for _, t in rows]
    assert {r.doc_id: r.n_links for r in got} == {i: sum(j != i and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}


def test_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = jaccard.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    left = jaccard.first_of_each(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {0, 1, 2, 3, 4, 6, 7, 8, 9, None}
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.first_of_each(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_all_partners(seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 30, 12)
    tokens = []
    for _ in range(60):
        base = tokens[rng.integers(len(tokens))] if tokens and rng.random() < 0.7 else rng.integers(0, 500, rng.integers(3, 40))
        tokens.append(np.unique(np.concatenate((base[rng.random(len(base)) < 0.93], rng.integers(0, 500, rng.integers(0, 3)), common[:8]))))
    sizes = [len(t) + int(rng.integers(0, 3)) for t in tokens]  # some shingles that no one shares
    lists = jaccard.Lists(list(range(60)), sizes, tokens, 75)
    for q in range(60):
        want = {i for i in range(60) if 100 * (o := len(np.intersect1d(tokens[q], tokens[i]))) >= 75 * (sizes[q] + sizes[i] - o)}
        assert set(lists.search(tokens[q], sizes[q])) == want


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_merge_skip(least):
    rng = random.Random(least)
    for _ in range(100):
        lists = [sorted(rng.sample(range(25), rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        count = Counter(x for one in lists for x in one)
        assert dict(jaccard.merge_skip(lists, least)) == {k: n for k, n in count.items() if n >= least}


def test_hashes_do_not_depend_on_neighbours(monkeypatch):
    texts = [t.encode() for t in ("a b c d e f", "", "x", "A b C d e f g h", "é è", "  lead and trail  ")]
    whole = [s.tolist() for s in jaccard.shingle_sets(texts)]
    assert whole == [next(jaccard.shingle_sets([t])).tolist() for t in texts]
    monkeypatch.setattr(jaccard, "STRETCH", 4)
    assert [s.tolist() for s in jaccard.shingle_sets(texts)] == whole
    assert whole[0] != whole[3] and set(whole[0]) < set(whole[3])


def test_runs_are_cut(monkeypatch):
    monkeypatch.setattr(jaccard, "RUN", 3)
    doc, n = jaccard._runs(np.array([2, 2, 2, 2, 2, 5, 7, 7, 7]))
    assert doc.tolist() == [2, 2, 5, 7] and n.tolist() == [3, 2, 1, 3]


def test_graph(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in parent.items() if k in got} and len(got) >= 100
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hashing_holds_little_at_a_time():
    """Executors run a worker a core beside the JVM: a batch of 8 MB of texts may not take twenty times its size."""
    texts = [b" ".join(b"w%d" % (i * j % 9973) for j in range(1200)) for i in range(1, 1200)]
    assert sum(map(len, texts)) > 6 << 20
    tracemalloc.start()
    try:
        for _ in jaccard.shingle_sets(texts):
            pass
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
