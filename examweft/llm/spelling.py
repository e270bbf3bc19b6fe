"""Spelling variants: one-edit neighbours of all words by errata-trie merging, and the form that each word goes back to.

1. Words are counted: by batch in the tasks, then in Spark.
2. The trie of all words, one row for each character: its node (a hash of the prefix) and the child that it leads to. A
   node's heavy child is the one with most words below; a word leaves the heavy path wherever its character is another
   one, or where it ends above a child. It does so log2(words) times at most (and once at its end).
3. At each such node the light subtrees are merged into the rest, small into large: each word of a light subtree goes in
   with its character skipped, with the heavy child's character in its place, and with that character put before it.
   Light subtrees meet each other with the character replaced by a mark. Coinciding terminals are one-edit pairs: a pair
   parts at one node, where one side at least is light; skipped and put-in characters count at the last place that
   gives the same word, so that each pair is found once.
4. Of each word's neighbours their number and the most frequent one are kept; forms are followed by pointer jumping.

A hash of two prefixes that fell together would only name another heavy child: pairs are compared as whole strings.
The trie's root is a hot key of a join with one row a node, which adaptive execution splits; sums combine before shuffles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import materialize, whole_text

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
MARK = "*"  # no letter
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> Counter[str]:
    """Runs of letters, A-Z in lower case, and how often each is there."""
    return Counter(LETTERS.findall(text.encode("utf-8", "replace").translate(_LOWER).decode("utf-8")))


def cut_word(number: object, word: str, every: int) -> str:
    """``word`` without a character where ``every`` divides the CRC-32 of ``number:word``: the character at that number."""
    h = zlib.crc32(f"{number}:{word}".encode())
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_every: int = 0, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of ``length`` code points or more that all texts have ``least`` times or more.

    A null or empty text has none. With ``cut_every``, some words lose a character first (``cut_word``); a null
    identifier counts as an empty one there. Repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for number, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words_of(text)
                if cut_every:
                    before = zlib.crc32(f"{number}:".encode())
                    for word, n in own.items():
                        if zlib.crc32(word.encode(), before) % cut_every:
                            found[word] += n
                        else:
                            found[cut_word(number, word, cut_every)] += n
                else:
                    found.update(own)
            kept = {w: n for w, n in found.items() if len(w) >= length}
            yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(whole_text(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- the trie -------------------------------------------------------------------------------------

_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def trie_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and each of its places, the end included: the word's number, the place, the node, the character there (-1 at the end)."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    number = np.repeat(np.arange(len(words)), lengths + 1)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    place = np.arange(len(codes)) - starts[number]
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, _BASE))
    own = _mix((codes.astype(np.uint64) + np.uint64(1)) * _ODD) * powers[place]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))
    node = _mix((total[:-1] - total[starts][number]) + place.astype(np.uint64) * _ODD).view(np.int64)
    ends = place == lengths[number]
    return number, place, node, np.where(ends, -1, codes)


def _edges(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, place, node, char = trie_rows(batch.column("word").to_pylist())
                ids = batch.column("id").to_numpy()[number]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place.astype(np.int32)), pa.array(node), pa.array(char.astype(np.int32))], names=["id", "place", "node", "code"])

    return words.select("id", "word").mapInArrow(run, "id long, place int, node long, code int")


def light_edges(words: DataFrame) -> DataFrame:
    """(id, place, code, heavy): where each of ``words`` (id, word) leaves a heavy path; ``code`` is -1 where it ends."""
    edges = materialize(_edges(words), "edges")
    sizes = edges.groupBy("node", "code").agg(F.count("*").alias("size"))
    heaviest = F.max_by(F.when(F.col("code") >= 0, F.col("code")), F.when(F.col("code") >= 0, F.struct("size", "code")))
    heavy = materialize(sizes.groupBy("node").agg(heaviest.alias("heavy"), F.count("*").alias("ways")).where("ways > 1 and heavy is not null").drop("ways"), "heavy")
    return edges.join(heavy, "node").where("code <> heavy").select("id", "place", "code", "heavy")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n, near_word): for words (word, n; distinct) numbers of one-edit neighbours, and the most frequent of
    them (the smallest of equal ones), in parts: a word's numbers add up, its best is the best of its parts."""
    words = materialize(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    light = materialize(light_edges(words), "light").join(words, "id")
    head, tail = F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")
    own, heavy = F.expr("substring(word, place + 1, 1)"), F.expr("char(heavy)")
    inner = F.col("code") >= 0
    skipped = F.when(inner & (F.substring(tail, 1, 1) != own), F.concat(head, tail))
    replaced = F.when(inner, F.concat(head, heavy, tail))
    put_in = F.concat(head, heavy, F.expr("substring(word, place + 1)"))
    merged = light.select("id", F.explode(F.array_compact(F.array(skipped, replaced, put_in))).alias("terminal"))
    found = merged.join(words.select(F.col("word").alias("terminal"), F.col("n").alias("m")), "terminal")
    pairs = materialize(found.join(words, "id").select("word", "n", F.col("terminal").alias("other"), "m"), "pairs")
    one = lambda a, n, b, m: pairs.select(F.col(a).alias("word"), F.lit(1).cast("long").alias("near"), F.col(m).alias("near_n"), F.col(b).alias("near_word"))
    marked = light.where(inner).select(F.concat(head, F.lit(MARK), tail).alias("terminal"), F.struct((-F.col("n")).alias("less"), "word").alias("who"))
    # A group has a member for each letter of the alphabet at most.
    groups = marked.groupBy("terminal").agg(F.sort_array(F.collect_list("who")).alias("who")).where("size(who) > 1")
    each = groups.select(F.posexplode("who").alias("at", "own"), "who").withColumn("best", F.when(F.col("at") == 0, F.col("who")[1]).otherwise(F.col("who")[0]))
    light_pairs = each.select(F.col("own.word").alias("word"), (F.size("who") - 1).cast("long").alias("near"), (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near_word"))
    return one("word", "n", "other", "m").unionByName(one("other", "m", "word", "n")).unionByName(light_pairs)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following forms (word, to) to their ends; frequencies at least double on the way, so that it has no circle."""
    while True:
        above = forms.select(F.col("word").alias("to"), F.col("to").alias("higher"))
        jumped = materialize(forms.join(above, "to", "left").select("word", F.coalesce("higher", "to").alias("to"), F.col("higher").isNotNull().alias("moved")), "forms")
        forms = jumped.select("word", "to")
        if jumped.where("moved").isEmpty():
            return forms.withColumnRenamed("to", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Words (word, n; distinct) with their forms: word, form, root, n, n_near, form_n.

    ``n_near`` is how many other words differ by exactly one inserted, deleted or replaced code point. ``form`` is the
    most frequent of them (of equal ones the smallest) if it is ``times`` as frequent or more, else null like ``form_n``. ``root`` is where
    forms lead to in the end, the word itself without a form. No words give an empty result.
    """
    words = materialize(words, "counted")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word")))
    near = neighbours(words).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.less") >= F.col("n") * times
    found = words.join(near, "word", "left").select("word", F.when(takes, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "found")
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("to")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
