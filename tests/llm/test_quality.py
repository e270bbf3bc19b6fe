import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from examweft.llm import quality as Q


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    words = ["thing", "with", "some", "letters", "and", "more", "of", "them", "Words", "here."]
    good = lambda: " ".join(rng.choice(words) + rng.choice(["", "", ",", str(rng.randint(0, 9))]) for _ in range(rng.randint(30, 120)))
    bad = lambda: rng.choice([lambda: " | ".join(rng.choices(words, k=40)), lambda: (rng.choice(words).upper() + "!! ") * 30, lambda: "$$%% " * 40])()
    rows, labels = [], []
    for i in range(1500):
        y = int(rng.random() < 0.8)
        rows.append((i, good() if y else bad(), y))
        if rng.random() < 0.4:
            labels.append((i, y))
    labels += [(0, None), (10**6, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, truth int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = Q.classify(docs, labels).collect()
    truth = {r.doc_id: r.truth for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_read(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(Q.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    stats = Q.features(docs)
    one, two = Q.fit(stats, labels), Q.fit(stats, turned)
    assert np.allclose(one.weights, two.weights) and one.prior == two.prior


def test_bad_labels_are_not_read(labelled):
    docs, labels = labelled
    stats = Q.features(docs)
    one, two = Q.fit(stats, labels), Q.fit(stats, labels.where("quality = 1"))
    assert np.allclose(one.weights, two.weights) and one.prior == two.prior


def test_identifier_is_no_input(labelled):
    docs, labels = labelled
    model = Q.fit(Q.features(docs), labels)
    a = {r.doc_id: r.score for r in Q.score(Q.features(docs), model).collect()}
    b = {r.doc_id - 5000: r.score for r in Q.score(Q.features(docs.withColumn("doc_id", F.col("doc_id") + 5000)), model).collect()}
    assert a == b


def test_non_negative_risk_is_not_above_the_unbiased_minimum():
    rng = np.random.default_rng(0)
    stats = np.abs(rng.normal(size=(400, len(Q.FEATURES))))
    x = Q.basis(stats, rng.random((400, 2 * Q.HASHED)))
    pos, unl = (lambda z: (len(z), z.sum(0), z.T @ z))(x[:40]), (lambda z: (len(z), z.sum(0), z.T @ z))(x[40:])

    def risk(w, prior):
        p, u = x[:40] @ w, x[40:] @ w
        return prior * np.mean((1 - p) ** 2) + max(0, np.mean((1 + u) ** 2) - prior * np.mean((1 + p) ** 2)) + (Q.RIDGE + 3 / 40) * w @ w

    for prior in (0.3, 0.9):
        n_p, p, _ = pos
        start = np.linalg.solve(unl[2] / 360 + (Q.RIDGE + 3 / 40) * np.eye(Q.SIZE), 2 * prior * p / n_p - unl[1] / 360)
        assert risk(Q.minimise(pos, unl, prior), prior) <= risk(start, prior) + 1e-9


def plain_statistics(text):
    """The statistics and shares in plain Python, for ASCII white space between words."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    size, n = max(1, len(raw)), len(words)
    share = lambda chars, of=size: sum(c in chars for c in raw) / of
    upper, lower = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
    return [
        math.log(1 + n), len(set(words)) / max(1, n), sum(words[i] == words[i + 1] for i in range(n - 1)) / max(1, n - 1), len(set(lines)) / len(lines),
        (size - sum(c in b"\t\n\r " for c in raw)) / max(1, n), sum(c in upper for c in raw) / max(1, sum(c in upper + lower for c in raw)), share(b"0123456789"),
        share(b",."), share(b"!"), share(b"|"), share(b"#$%&*+<=>@[]^_`{}~\\"), share(b"\t\n\r "), sum(c > 127 for c in raw) / size,
    ]


def test_statistics_and_moments_by_brute_force(spark, odd):
    """Statistics, shares, moments, risk and prior against plain statements of them."""
    docs = odd.select("doc_id", "text").where("doc_id is null or doc_id <> 8")
    rows = Q.features(docs, keep=("text",)).collect()
    x = []
    for r in rows:
        assert np.allclose(r.stats, plain_statistics(r.text)), r.text
        words = (r.text or "").encode().lower().split()
        shares = np.frombuffer(r.grams, np.uint8).reshape(2, Q.HASHED) / 255
        assert abs((shares**2).sum(1) - [bool(words), len(words) > 1]).max() < 0.05  # shares of one
        assert (shares[0] > 0).sum() <= len(set(words)) and (shares[1] > 0).sum() <= len(set(zip(words, words[1:], strict=False)))
        hats = [1.0]
        for v, knots in zip(r.stats, Q.FEATURES.values(), strict=True):
            v = min(max(v, knots[0]), knots[-1])
            for i, k in enumerate(knots):
                left, right = knots[max(i - 1, 0)], knots[min(i + 1, len(knots) - 1)]
                hats.append(1.0 if v == k else (v - left) / (k - left) if left < v < k else (right - v) / (right - k) if k < v < right else 0.0)
        x.append(np.concatenate((hats, shares.ravel())))
    x = np.array(x)
    (n, total, square) = Q.moments(Q.features(docs, keep=("text",)).withColumn("g", F.lit("u")), "g")["u"]
    assert n == len(rows) and np.allclose(total, x.sum(0)) and np.allclose(square, x.T @ x)


def test_prior():
    """Bad documents low in the order and as many as one third: the prior is two thirds or so; without any it is one."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(160, 20, 8000), rng.normal(80, 20, 4000)
    table = lambda pos, unl: [(i, int((pos.astype(int) == i).sum()), int((unl.astype(int) == i).sum())) for i in range(256)]
    assert abs(Q.estimate_prior(table(good[:4000], np.concatenate((good[4000:], bad[:2000])))) - 2 / 3) < 0.03
    assert Q.estimate_prior(table(good[:4000], good[4000:])) > 0.95
    assert Q.estimate_prior([(0, 1, 1)]) == 1


def test_odd(odd, none, labelled):
    labels = labelled[1]
    rows = Q.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert Q.classify(none, labels).count() == 0
    assert {r.score for r in Q.classify(odd, labels.where("false")).collect()} == {0.5}
    assert {r.predicted for r in Q.classify(odd, labels.where("quality = 0")).collect()} <= {0, 1}
    assert Q.keep_good(none, labels).columns == none.columns


def test_keep_good(labelled):
    docs, labels = labelled
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("truth = 1").count() == docs.where("truth = 1").count()
    assert kept.where("truth = 0").count() < 0.05 * docs.where("truth = 0").count() + 1


def test_keep_good_keeps_clashing_columns(labelled):
    docs, labels = labelled
    more = docs.selectExpr("*", "doc_id + 1 as _row", "'x' as __row", "2 as stats", "3 as grams", "4 as _bad", "5 as _text")
    kept = Q.keep_good(more, labels)
    assert kept.columns == more.columns and kept.where("_row = doc_id + 1 and __row = 'x' and stats + grams + _bad + _text = 14").count() == Q.keep_good(docs, labels).count()
