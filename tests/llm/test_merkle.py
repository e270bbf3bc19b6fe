import hashlib
import string
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from examweft.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top, out = levels([trees[g][-1][0] for g in names]), []
    for place, g in enumerate(names):
        for pos, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded, siblings = leaf((*r[:4], r[4] and r[4].translate(LOWER))) if hit else own, ""
            for tree, at in ((trees[g], pos), (top, place)):
                for nodes in tree[:-1]:
                    first = at - at % 8
                    left, right = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])
                    siblings, folded, at = siblings + left + right, digest(left + folded + right), at // 8
            out.append((r[0], own, trees[g][-1][0], top[-1][0], digest(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def answer(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in queries.queries()["op11_merkle"](spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {"en": 130, "de": 1, None: 2, "": 3, "é": 64, "z": 65}, {f"l{i:02d}": 1 + i % 3 for i in range(20)}])
def test_trees(spark, tmp_path, sizes):
    rows, number = [], 0
    for lang, n in sizes.items():
        for i in range(n):
            number += 7
            rows.append((number * 31 % 1009 - 5, None if i % 5 == 0 else f"s{i % 3}", lang, None if i % 7 == 0 else i, [None, "", "Ab É", "UPPER\nline", "low"][i % 5]))
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_repeated_rows_null_identifiers_and_ties(spark, tmp_path):
    rows = [(3, "s", "en", 1, "A")] * 11 + [(3, "s", "en", 1, "B"), (None, "s", "en", 1, "C"), (None, None, None, None, None)]
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert answer(spark, tmp_path, []) == []


def test_extra_columns_and_very_long_text(spark):
    text = "Word " * 400_000
    docs = spark.createDataFrame([(1, "s", "en", 2, text), (2, "s", "en", 2, "x")], SCHEMA)
    for name in ("bucket", "pos", "n", "at", "digest", "leaf", "steps", "run"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = merkle.manifest(docs, extra=F.length("text")).withColumn("ok", merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root"))
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].ok and got[2].ok and got[1].extra == len(text) and got[1].leaf == leaf((1, "s", "en", 2, text))
