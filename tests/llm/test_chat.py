import hashlib
import random

import pytest
from pyspark.sql import functions as F

from examweft.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|=user|>x", "\\", "\\l<\\\\b[", "a|>b", "", "<s>", "[[\\", "|", "\\\\", "<|+assistant|>\\"]


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(2)
    rows = []
    for c in range(30):
        rows += [(c, t, rng.choice(["user", "assistant", "system", "ro|le<", None]), rng.choice([*NASTY, None])) for t in range(rng.choice([1, 5, 600]))]
    rows += [(40, 1, "assistant", "tie"), (40, 1, "assistant", "tie"), (40, None, "user", "first"), (None, 0, "user", "x"), (None, 0, "assistant", "y")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"chunk": F.lit(1), "t": F.lit("x")})


def test_round_trip(turns):
    want = {}
    for r in turns.collect():
        want.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    want = {k: [(a, b) for _, a, b in sorted(v)] for k, v in want.items()}
    out = chat.format_conversations(turns)
    rows = out.withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.back] for r in rows} == want
    unescape = lambda s: s.replace("\\\\", "\0").replace("\\l", "<").replace("\\b", "[").replace("\0", "\\")
    for r in rows:
        spoken = [t for role, t in want[r.conv_id] if role == "assistant"]
        assert [unescape(r.formatted[s.start : s.end]) for s in r.loss_spans] == spoken and r.n_turns == len(want[r.conv_id])
        merged = sum(a[0] == b[0] for a, b in zip(want[r.conv_id], want[r.conv_id][1:], strict=False))
        assert r.formatted.count("<|+") == merged and r.formatted.count("<|=") == r.n_turns - merged
    for r in chat.digests(out).collect():
        t = want[r.conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        loss = "".join(b for a, b in t if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_digests_follow_the_mask(turns):
    """The loss digest is what the mask covers: with half of the spans it is half of the text."""
    out = chat.format_conversations(turns).withColumn("loss_spans", F.slice("loss_spans", F.lit(1), F.size("loss_spans") - F.floor(F.size("loss_spans") / 2).cast("int")))
    whole = {r.conv_id: r.loss_chars for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert any(r.loss_chars < whole[r.conv_id] for r in chat.digests(out).collect())
    none = chat.format_conversations(turns, ("nobody",))
    assert all(r.loss_chars == 0 and r.loss_sha256 == hashlib.sha256(b"").hexdigest() for r in chat.digests(none).collect())


def test_nothing(turns):
    assert chat.digests(chat.format_conversations(turns.where("false"))).count() == 0


def test_many_tied_turns(spark):
    """A stretch holds so many turns at most, whether they are tied, repeated or without a number."""
    turns = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.when(F.col("id") % 2 == 0, 7).cast("long").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), (F.col("id") % 100).cast("string").alias("text"))
    r = chat.digests(chat.format_conversations(turns)).first()
    rows = sorted(((i % 2 == 0), "user" if i % 3 == 0 else "assistant", str(i % 100)) for i in range(60_000))
    assert r.n_turns == 60_000 and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest()
    loss = "".join(b for _, a, b in rows if a == "assistant")
    assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_any_stretch_gives_the_same(turns, monkeypatch):
    want = {r.conv_id: r.formatted for r in chat.format_conversations(turns).collect()}
    monkeypatch.setattr(chat, "CHUNK", 2)
    assert {r.conv_id: r.formatted for r in chat.format_conversations(turns).collect()} == want
