import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pipeline = pytest.importorskip("corpus_pipeline")

from examweft.llm import bpe, pii, quality  # noqa: E402
from examweft.llm.queries import bpe_path  # noqa: E402
from tests.llm.test_jaccard import corpus, shingles  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, junk and personal data, and labels of some."""
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t) for i, t in corpus(7)]
    rows += [(1000 + i, f"Mail number {i} to joe{i}@mail.org about the thing with some other words, please do so.") for i in range(30)]
    rows += [(2000 + i, "BUY!! NOW!! CHEAP!! " * 20 + str(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    df.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, 0 if i >= 2000 else 1, 0) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns, seen = rows.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        rows = pipeline.materialize(stage(spark, rows, folder), name)
        assert rows.columns == columns
        seen[name] = {r.doc_id: r for r in rows.collect()}
    before = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    predicted = {r.doc_id for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels.select("doc_id", "quality")).where("predicted = 1").collect()}
    junk = sum(i >= 2000 for i in predicted)
    assert set(seen["quality_filter"]) == predicted and junk < 5, junk
    last = {}
    for i in sorted(predicted):
        last[before[i].text or ""] = i
    assert set(seen["exact_dedup"]) == set(last.values())
    sets = {i: shingles(r.text) for i, r in seen["exact_dedup"].items()}
    group = {i: i for i in sets}
    for _ in sets:
        changed = False
        for a in sets:
            for b in sets:
                if group[b] < group[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a], changed = group[b], True
        if not changed:
            break
    assert set(seen["near_dedup"]) == {i for i, g in group.items() if i == g}
    for i, r in seen["mask_pii"].items():
        text = seen["near_dedup"][i].text
        assert r.text == (None if text is None else pii.masked(text)) and r.n_chars == (None if text is None else len(r.text))
    assert any("[EMAIL]" in (r.text or "") for r in seen["mask_pii"].values())
    packed = pipeline.run(spark, folder).collect()
    want = {i: len(bpe.tokenizer(bpe_path()).encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in seen["mask_pii"].items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and len({r.sequence_id for r in packed}) <= -(-sum(want.values()) // 2048) + 1


CLASHES = ("_row", "piece", "id", "key", "n", "bands", "digest", "found", "tokens", "stats", "grams", "_gone", "kept", "group_size")


def stages(spark, rows, folder, last=4):
    out = []
    for name, stage in pipeline.STAGES[:last]:
        rows = pipeline.materialize(stage(spark, rows, folder), name)
        out.append(rows)
    return out


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for rows in stages(spark, docs, folder):
        assert rows.count() == 0 and rows.columns == docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_nulls_and_repeats(spark, folder):
    """Each stage by rules of its own: no column is lost, nor a row but those that the stage names."""
    text = "A clean sentence about the thing with some words, number {} of many that differ in one place only here."
    other = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(60)) for i in range(4)]
    rows = [(1, text.format(1), "en"), (2, text.format(1), None), (3, other[0], "en"), (3, other[0], "en"), (4, other[1], "en"), (4, other[2], "de"), (5, None, "en"), (None, other[3], "en"), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit(c) for c in CLASHES}})
    good = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 4, 5, 6)], "doc_id long, quality int, toxic int")
    labels = f"{folder}-all-good"
    good.write.mode("overwrite").parquet(f"{labels}/labels.parquet")
    for kept in stages(spark, docs, labels):
        assert kept.columns == docs.columns
        assert all(r[c] == c for r in kept.collect() for c in CLASHES)
    one = pipeline.exact_dedup(spark, docs, labels).collect()
    count = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str)
    assert {t for _, t in count(one)} >= {text.format(1), *other} and (1, text.format(1)) not in count(one) and (2, text.format(1)) in count(one)
    near = pipeline.near_dedup(spark, docs, labels).collect()
    assert (1, text.format(1)) in count(near) and (2, text.format(1)) not in count(near)
    assert count(r for r in near if r.doc_id != 1) == count(r for r in docs.collect() if r.doc_id not in (1, 2))
    masked = pipeline.mask_pii(spark, docs.withColumn("text", F.concat("text", F.lit(" joe@mail.org"))), labels).collect()
    assert all(r.text is None or ("joe@mail" not in r.text and r.n_chars == len(r.text)) for r in masked) and len(masked) == len(rows)
    packed = pipeline.pack_sequences(spark, docs, labels).collect()
    assert sorted(r.doc_id for r in packed if r.doc_id is not None) == [1, 2, 3, 3, 4, 4, 5, 6] and all(r.piece == 0 for r in packed)
