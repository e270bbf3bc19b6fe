import os

import pyarrow as pa
from pyspark.sql import functions as F

from examweft.operators import catalog, search
from examweft.plans import remote


def counting(path):
    """A client that notes each call in a file, from whatever process."""
    def client(text):
        with open(path, "a") as out:
            out.write(text + "\n")
        if text.startswith("bad"):
            raise OSError("no answer")
        return text.upper()

    return client


def calls(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def test_each_distinct_prompt_once(spark, tmp_path):
    log, place = tmp_path / "log", str(tmp_path / "kept")
    rows = [(i, f"p{i % 7}") for i in range(100)] + [(100, None), (101, "bad")]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(5)
    ask = lambda d: {r.id: (r.reply, r.reply_error) for r in remote.kept_replies(d, counting(log), "prompt", "reply", place, delay=0, in_file=2).collect()}
    want = {i: (p.upper(), None) for i, p in rows[:100]} | {100: (None, None), 101: (None, "OSError: no answer")}
    assert ask(df) == want and calls(log) == sorted([f"p{i}" for i in range(7)] + ["bad"] * 3)
    assert ask(df.where("id <> 101")) == {k: v for k, v in want.items() if k != 101} and len(calls(log)) == 10  # nothing new
    more = spark.createDataFrame([(1, "p1"), (2, "new")], "id long, prompt string")
    assert ask(more) == {1: ("P1", None), 2: ("NEW", None)} and len(calls(log)) == 11
    assert ask(df.where("id = 101"))[101][1] == "OSError: no answer" and len(calls(log)) == 14  # failures are asked again
    assert ask(df.where("false")) == {}


def test_a_task_that_runs_again_asks_for_the_rest(tmp_path):
    log, place = tmp_path / "log", str(tmp_path / "r" / "00000")
    batch = pa.record_batch({"digest": [str(i) for i in range(10)], "prompt": [f"p{i}" for i in range(10)]})
    half = iter([batch.slice(0, 6)])
    assert remote.keep_replies(half, counting(log), place, 1, 0, 2, 3) == 6  # and then the executor is lost
    assert remote.keep_replies(iter([batch]), counting(log), place, 1, 0, 2, 3) == 4
    assert calls(log) == sorted(f"p{i}" for i in range(10)) and len(os.listdir(tmp_path / "r")) == 4


def test_search_by_trigrams(spark, tmp_path):
    names = ["Toán 12", "toán nâng cao", "Lý", "", None, "ab", "abc", "ABCABC", "xabx", "aaaa", "İstanbul", "straße", "100% sure", "a.c", "😀😀😀x"]
    df = spark.createDataFrame([(i, n, None if i % 3 else "Math", "9") for i, n in enumerate(names * 3)], "id long, title string, subject string, grade string")
    search.write_index(df, str(tmp_path / "i"))
    for query in ("toán", "TOÁN 1", "abc", "bca", "aaa", "math", "a.c", "a", "9", "", "😀😀😀", "none at all", "xabx", "İst", "STRASSE", "ß", "abcabcabc"):
        want = sorted(r.id for r in catalog.search(df, query, ("title", "subject", "grade")).collect())
        assert sorted(r.id for r in search.search(df, str(tmp_path / "i"), query).collect()) == want, query
    assert df.select(search.grams(F.lit("abab")).alias("g")).first().g == ["aba", "bab"]
