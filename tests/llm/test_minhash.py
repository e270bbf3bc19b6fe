import random
import re
from collections import Counter, defaultdict

import numpy as np

from examweft.llm import minhash, queries
from examweft.llm.jaccard import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """(id, n, component, kept) of each row, sorted; rows are documents of their own."""
    sets = [shingles(t) for _, t in rows]
    lists, parent = defaultdict(list), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in lists[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            least[find(i)] = min(number, least.get(find(i), number))
    out = []
    for i, (number, _) in enumerate(rows):
        c = number if not sets[i] else least.get(find(i))
        out.append((number, len(sets[i]), c, number == c))
    return sorted(out, key=str)


def answer(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **more).collect()), key=str)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed=3):
    """Groups of near copies of all similarities around the threshold, chains, exact copies and texts that share a passage."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(120)]
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 30, 200]))]
        chain = base
        for i in range(rng.choice([2, 5, 30])):
            chain = edited(rng, chain, rng.choice([0, 1, 2]))
            rows += [" ".join(edited(rng, base, i % 4)), " ".join(chain)]
    rows += [" ".join(passage + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]) for _ in range(300)]
    rows += ["Exact copy of a text"] * 200 + ["exact COPY of a text", "one", "two words", "Two Words", "", " \t\n", None]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_small_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_NODES", 7)
    rows = corpus()
    got = answer(spark, rows)
    assert got == brute(rows) and sum(not r[3] for r in got) > 250


def test_odd_rows_and_clashing_columns(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    clash = odd.selectExpr("doc_id", "text", "1 as node", "2 as bucket", "3 as known", "4 as id", "5 as tokens")
    assert sorted((tuple(r) for r in minhash.near_duplicates(clash).collect()), key=str) == brute(rows)
    assert minhash.near_duplicates(none).collect() == []


def test_one_identifier_for_several_texts(spark):
    rows = [(5, " ".join(f"a{i}" for i in range(50))), (5, " ".join(f"b{i}" for i in range(50))), (9, " ".join(f"a{i}" for i in range(51))), (None, " ".join(f"b{i}" for i in range(51)))]
    assert answer(spark, rows) == brute(rows)


def test_coordinates_are_one_shifted_permutation():
    sets = list(shingle_sets([b"a b c d e f", b"x y z", b" ".join(b"w%d" % i for i in range(90_000))], 3))
    got = minhash.coordinates(sets, 8)
    for s, row in zip(sets, got, strict=True):
        placed = (s >> np.uint64(32)).astype(np.uint32)
        minhash._permuted(placed, 0x7FEB352D, 0x846CA68B, np.empty_like(placed))
        want = [minhash._permuted(placed + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35, np.empty_like(placed)).min() for k in range(8)]
        assert row.tolist() == want
    everything = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65_537)
    assert len(np.unique(minhash._permuted(everything.copy(), 0x85EBCA6B, 0xC2B2AE35, np.empty_like(everything)))) == 1 << 16


def test_coordinates_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        common, own = int(2000 * share), int(1000 * (1 - share))
        hits = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
            a, b = minhash.coordinates([pool[: common + own], np.concatenate((pool[:common], pool[common + own :]))], 160)
            hits.append((a == b).mean())
        assert abs(np.mean(hits) - common / (common + 2 * own)) < 0.03


def test_whole_query(spark, tmp_path):
    rows = corpus(8)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.queries()["op13_minhash"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_sets_of_groups_that_fit_move_once(spark, monkeypatch):
    """Texts that share many buckets, linked or not, are compared in one cell of their group."""
    moved, verified = [], minhash._verified

    def watched(rows, percent):
        moved.extend(r.node for r in rows.select("node").collect())
        return verified(rows, percent)

    monkeypatch.setattr(minhash, "_verified", watched)
    rows = corpus(5)
    assert answer(spark, rows) == brute(rows)
    assert len(moved) > 300 and len(moved) == len(set(moved))


def test_equal_rows_of_one_identifier(spark, monkeypatch):
    words = [[f"{x}{i}" for i in range(40)] for x in "ab"]
    rows = [(g if n else None, " ".join(words[g] + ["end"] * n)) for g in (0, 1) for n in range(4) for _ in range(3)]
    want = brute(rows)
    assert answer(spark, rows) == want and len({r[2] for r in want}) == 2
    monkeypatch.setattr(minhash, "PART_NODES", 2)
    assert answer(spark, rows) == want


def test_rounds_look_up_each_node_once(spark, monkeypatch):
    """In groups larger than a cell a node takes one row of the joins by node, whatever the number of its buckets."""
    seen, write = [], minhash.materialize

    def watched(df, name, **options):
        out = write(df, name, **options)
        if name in ("named", "homed"):
            seen.append([r.node for r in out.select("node").collect()])
        return out

    monkeypatch.setattr(minhash, "materialize", watched)
    monkeypatch.setattr(minhash, "PART_NODES", 7)
    rows = corpus(11)
    assert answer(spark, rows) == brute(rows)
    assert len(seen) >= 3 and all(len(nodes) == len(set(nodes)) > 0 for nodes in seen)


def test_rounds_without_links_change_nothing(spark, monkeypatch):
    """Texts that share a passage and aren't linked: components are named once, not again for each step that finds no link."""
    names, write = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name, **options: names.append(name) or write(df, name, **options))
    monkeypatch.setattr(minhash, "PART_NODES", 7)
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(passage + [f"x{i}_{j}" for j in range(40 + i % 20)])) for i in range(60)]
    assert answer(spark, rows) == brute(rows)
    assert "cross" in names and names.count("named") == 1
