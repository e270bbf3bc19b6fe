"""A quality classifier by positive-unlabelled learning.

Only documents marked good are trusted; marks of bad documents are never read. All training documents together
are unlabelled text, a mixture of good and bad in a share that the class prior states. The prior is estimated
from the two samples alone: a first model, fitted on one half of them, orders the documents of the other half, and
the prior is the least ratio of the unlabelled to the positive share among those above any place in that order
(with a margin for chance).
A linear model on binned text statistics and hashed words and word pairs then minimises the non-negative
unbiased risk: pi * E_p[loss(f, +1)] + max(0, E_u[loss(f, -1)] - pi * E_p[loss(f, -1)]).

With the squared loss the risk depends on the data only by first and second moments, so that one pass over
all documents (no sample) gives a table of fixed size, and the minimum is found from that; the loss's own
minimum is twice the probability of good less one, which makes the score without any calibration.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import map_batches, materialize, whole_text, without
from examweft.llm.jaccard import word_hashes

#: The statistics of a text, and the knots between which each is interpolated (parameters of the model).
FEATURES = {
    "log_words": (0, 1, 2, 3, 4, 6, 9),
    "distinct_words": (0, 0.15, 0.3, 0.5, 0.75, 1),
    "repeated_next": (0, 0.01, 0.05, 0.2, 1),
    "distinct_lines": (0, 0.5, 1),
    "word_length": (0, 3, 5, 8, 20),
    "upper": (0, 0.05, 0.2, 0.6, 1),
    "digits": (0, 0.02, 0.1, 0.4, 1),
    "stops": (0, 0.005, 0.02, 0.05, 1),
    "shouts": (0, 0.005, 0.02, 0.1, 1),
    "bars": (0, 0.005, 0.02, 0.1, 1),
    "symbols": (0, 0.005, 0.02, 0.1, 1),
    "spaces": (0, 0.1, 0.2, 0.4, 1),
    "beyond_ascii": (0, 0.02, 0.1, 1),
}
#: Places for hashed words, and as many for hashed pairs of words.
HASHED = 64
SIZE = 1 + sum(map(len, FEATURES.values())) + 2 * HASHED
THRESHOLD, FOLDS, BINS, RIDGE = 0.3, 5, 256, 1e-3
#: How sure the bound on the prior is to hold: the chance that either sample's share is further off than allowed for.
CHANCE = 0.1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@[]^_`{}~\\", np.uint8)
_P = np.triu_indices(SIZE)


def statistics(text: bytes) -> tuple[float, ...]:
    words, lines = text.split(), text.split(b"\n")
    n, size = len(words), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    return (
        float(np.log1p(n)), len(set(words)) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n - 1), len(set(lines)) / len(lines),
        (size - int(count[[9, 10, 13, 32]].sum())) / max(1, n), int(count[65:91].sum()) / letters, int(count[48:58].sum()) / size,
        int(count[[44, 46]].sum()) / size, int(count[33]) / size, int(count[124]) / size, int(count[_SYMBOLS].sum()) / size, int(count[[9, 10, 13, 32]].sum()) / size, int(count[128:].sum()) / size,
    )


def grams(text: bytes) -> bytes:
    """Shares of hashed words and pairs of neighbouring words: square roots, in 255ths."""
    _, words = word_hashes(np.frombuffer(text.translate(_LOWER), np.uint8))
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    out = []
    for x in (words, pairs ^ pairs >> np.uint64(29)):
        n = np.bincount((x % np.uint64(HASHED)).astype(np.int64), minlength=HASHED)
        out.append(np.rint(255 * np.sqrt(n / max(1, len(x)))))
    return np.concatenate(out).astype(np.uint8).tobytes()


def basis(stats: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Rows of hat functions at the statistics' knots after a constant, then the shares of hashed words and pairs."""
    parts = [np.ones((len(stats), 1))]
    for j, knots in enumerate(FEATURES.values()):
        k = np.array(knots, float)
        x = np.clip(stats[:, j], k[0], k[-1])
        parts.append(np.stack([np.interp(x, k, row) for row in np.eye(len(k))], axis=1))
    return np.concatenate([*parts, shares], axis=1)


def fold(id_col: str) -> Column:
    """crc32 of the identifier as text, modulo the number of folds; rows of fold 0 are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (self.margin(x) + 1) / 2

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ np.array(self.weights), -1, 1)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The basis functions of a batch with stats and grams, a row for each document."""
    n = batch.num_rows
    stats = np.asarray(batch.column("stats").flatten(), float).reshape(n, len(FEATURES))
    shares = np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.uint8).reshape(n, 2 * HASHED)
    return basis(stats, shares / 255)


def features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``stats`` (array<double>) and ``grams`` (binary) of each whole text; null counts as empty."""
    keep = list(keep)

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_buffer().to_pybytes() for t in batch.column("_text").cast(pa.binary())]
        stats, shares = [statistics(t) for t in texts], [grams(t) for t in texts]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(stats, pa.list_(pa.float64())), pa.array(shares, pa.binary())], names=[*keep, "stats", "grams"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_batches(docs.select(*keep, whole_text(text_col).alias("_text")), function, f"{kept}, stats array<double>, grams binary")


def moments(rows: DataFrame, group: str) -> dict:
    """By group: the number of rows, the sum of their features, and of the products of features."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            x, names = _rows(batch), np.array(batch.column(group).to_pylist())
            for g in set(names.tolist()):
                own = x[names == g]
                sums[g] = sums.get(g, 0) + np.concatenate((own.sum(axis=0), (own.T @ own)[_P]))
        for g, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(values)), pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["g", "cell", "value"])

    cells = rows.select(group, "stats", "grams").mapInArrow(run, "g string, cell int, value double").groupBy("g", "cell").agg(F.sum("value").alias("value"))
    out: dict = {}
    for r in cells.collect():  # a fixed number of cells for each of two groups
        out.setdefault(r["g"], np.zeros(SIZE + len(_P[0])))[r["cell"]] = r["value"]
    return {g: (v[0], v[:SIZE], _square(v[SIZE:])) for g, v in out.items()}


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((SIZE, SIZE))
    out[_P] = upper
    return out + np.triu(out, 1).T


def minimise(positive: tuple, unlabelled: tuple, prior: float, steps: int = 400) -> np.ndarray:
    """The weights of least non-negative risk, from the unbiased risk's own minimum on."""
    (n_p, p, pp), (n_u, u, uu) = positive, unlabelled
    p, pp, u, uu = p / n_p, pp / n_p, u / n_u, uu / n_u
    ridge = (RIDGE + 3 / min(n_p, n_u)) * np.eye(SIZE)  # few documents say little
    w = np.linalg.solve(uu + ridge, 2 * prior * p - u)
    rate = 0.5 / np.linalg.eigvalsh(uu + prior * pp + ridge)[-1]

    def negative(w):  # the risk that unlabelled text has as bad text, less what its good part adds
        return 1 + 2 * w @ u + w @ uu @ w - prior * (1 + 2 * w @ p + w @ pp @ w)

    best, least = w, np.inf
    for _ in range(steps):
        risk = prior * (1 - 2 * w @ p + w @ pp @ w) + max(0.0, negative(w)) + w @ ridge @ w
        if risk < least:
            best, least = w, risk
        down = u + uu @ w - prior * (p + pp @ w)
        step = prior * (pp @ w - p) + down if negative(w) >= 0 else -down
        w = w - rate * 2 * (step + ridge @ w)
    return best


def estimate_prior(table: list[tuple[int, int, int]]) -> float:
    """The share of good among unlabelled documents from (bin, positive, unlabelled) counts, bins in order of the margin.

    Above any place in the order, the unlabelled share is the prior times the positive share at least; where bad
    documents are few it is little more. Of all places the one counts whose ratio has the least upper bound.
    """
    _, p, u = (np.array(c, float) for c in zip(*sorted(table, reverse=True), strict=True))
    n_p, n_u = p.sum(), u.sum()
    above_p, above_u = np.cumsum(p) / n_p, np.cumsum(u) / n_u
    slack = np.sqrt(np.log(4 / CHANCE) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    seen = above_p > 0
    best = np.argmin((above_u[seen] + slack) / above_p[seen])
    return float(np.clip(above_u[seen][best] / above_p[seen][best], 1 / (n_u + 1), 1))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from all rows outside fold 0: ``stats`` has id_col, stats and grams, ``labels`` id_col and label_col.

    A document is trusted where any label of its identifier is 1; no other label is looked at. Without a trusted
    document every document scores 0.5.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).distinct().withColumn("good", F.lit(True))
    half = F.when(fold(id_col) <= FOLDS // 2, "1").otherwise("2")
    train = materialize(
        stats.where(fold(id_col) != 0).join(good, F.col(id_col) == F.col("_id"), "left")
        .select("stats", "grams", F.concat(F.when(F.col("good"), "p").otherwise("u"), half).alias("g")), "train"
    )
    parts = moments(train, "g")
    total = lambda *names: [sum(x) for x in zip(*(parts[n] for n in names if n in parts), strict=True)]
    if not total("p1", "p2"):
        return Model((0.0,) * SIZE, 0.5)
    prior = 0.5  # where a half has no trusted document
    if "p1" in parts and "p2" in parts:
        first = Model(tuple(minimise(parts["p1"], total("p1", "u1"), 0.5)), 0.5)
        prior = estimate_prior(_margins(train.where("g in ('p2', 'u2')"), first))
    return Model(tuple(minimise(total("p1", "p2"), total("p1", "p2", "u1", "u2"), prior)), prior)


def _margins(train: DataFrame, model: Model) -> list[tuple[int, int, int]]:
    """(bin, positive, unlabelled) counts of training rows by margin, in a fixed number of bins; unlabelled are all."""
    weights = np.array(model.weights)

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = np.clip(np.floor((_rows(batch) @ weights + 2) / 4 * BINS), 0, BINS - 1)
        return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), batch.column("g")], names=["bin", "g"])

    counts = map_batches(train, function, "bin int, g string").groupBy("bin").agg(F.count_if(F.col("g").startswith("p")).alias("p"), F.count("*").alias("u"))
    return [(r["bin"], r["p"], r["u"]) for r in counts.collect()]


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, score, predicted for each row of ``stats``; the identifier is no input of the score."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(_rows(batch))
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = stats.schema[id_col].dataType.simpleString()
    return map_batches(stats.select(id_col, "stats", "grams", (fold(id_col) == 0).alias("held_out")), function, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: id_col, held_out, score, predicted (score >= 0.3). Empty texts are scored too."""
    stats = materialize(features(docs, text_col, (id_col,)), "stats")
    return score(stats, fit(stats, labels, id_col, label_col), id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns. Each text is looked at once; a row is known by its
    identifier and a hash of its text."""
    known = "_row"
    while known in map(str.lower, docs.columns):
        known = f"_{known}"
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("hash"))
    stats = materialize(features(docs.withColumn(known, row), text_col, (id_col, known)), "stats")
    model = fit(stats, labels, id_col, label_col)

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select([known]).filter(pa.array(model.scores(_rows(batch)) < THRESHOLD))

    bad = map_batches(stats.select(known, "stats", "grams"), function, f"{known} {stats.schema[known].dataType.simpleString()}").distinct()
    bad = materialize(bad.select(F.col(known).alias("bad")), "rejected")
    return without(docs.withColumn(known, row), bad, known).drop(known)
