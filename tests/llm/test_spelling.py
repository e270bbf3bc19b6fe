import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from examweft.llm import queries, spelling
from examweft.llm.common import prepare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_count(rows, every=97):
    found = Counter()
    for number, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if number is None else number}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near, rest = defaultdict(set), defaultdict(set)
    for w in words:
        for p in range(len(w)):
            short = w[:p] + w[p + 1 :]
            rest[p, short].add(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in rest.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def answer(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: tuple(r) for r in spelling.variants(df).collect()}


@pytest.mark.parametrize("seed, letters, longest", [(1, "ab", 7), (2, "aé", 9), (3, "abcdefgh", 5)])
def test_dense_words(spark, seed, letters, longest):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.choice([3, 4, 6, 8, 9, 100, 1000]) for _ in range(400)}
    assert answer(spark, words) == brute(words)


def test_runs_ends_long_words_and_ties(spark):
    long = "ab" * 20_000
    words = {"aaaaa": 10, "aaaaaa": 10, "aaaaaaa": 20, "aaaab": 5, "stop": 7, "stops": 14, "stopss": 3, "alone": 4, long: 3, long[:-1]: 6, "x" + long: 12, "ÿ×÷zz": 3, "ÿ×÷z": 6}
    got = answer(spark, words)
    assert got == brute(words)
    assert got["stop"][1:3] == ("stops", "stops") and got[long][2] == "x" + long and got["alone"][1] is None


def test_whole_query(spark, tmp_path):
    rng = random.Random(5)
    stems = ["house", "houses", "Maison", "été là", "straße", "naïve", "CLOCK clock", "x" * 3000]
    rows = [(i, " ".join(rng.choices(stems, k=rng.randint(0, 60))) + rng.choice(["", " ", "😀a", "_b1"])) for i in range(300)] + [(300, None), (301, ""), (7, "repeat repeat repeat"), (None, "nulls " * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word: tuple(r) for r in queries.queries()["op12_spelling"](spark, str(tmp_path)).collect()}
    assert got == brute(brute_count(rows)) and any(r[1] for r in got.values())


def test_empty_and_clashing_columns(spark, odd, none):
    prepare(spark)
    assert spelling.variants(spelling.count_words(none)).collect() == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {r.word: r.n for r in spelling.count_words(odd).collect()} == brute_count(rows, every=0)


def test_trie_rows():
    number, place, node, code = spelling.trie_rows(["abc", "abd", "", "b"])
    rows = {(int(a), int(b)): (int(n), int(c)) for a, b, n, c in zip(number, place, node, code, strict=True)}
    assert len(rows) == 4 + 4 + 1 + 2 and rows[0, 2][0] == rows[1, 2][0] and rows[0, 3][0] != rows[1, 3][0]
    assert {rows[k][0] for k in [(0, 0), (1, 0), (2, 0), (3, 0)]} == {rows[2, 0][0]} and rows[2, 0][1] == -1 and rows[0, 2][1] == ord("c")
    assert len(np.unique(node)) == 1 + 3 + 1 + 1


def test_few_light_edges(spark):
    """The words on a heavy path are never asked: a comb of n words has n light ends, not n squared places."""
    words = spark.createDataFrame([("a" * i + "b" * 5, i) for i in range(1, 200)], "word string, id long")
    assert spelling.light_edges(words).count() <= 2 * 200
