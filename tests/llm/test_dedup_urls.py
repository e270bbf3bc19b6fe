import hashlib
import random

import pytest
from pyspark.sql import functions as F

from examweft.llm import common, dedup, urls


def brute_groups(rows, keep):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return sorted((str(i), str(keep([x for x in g if x is not None] or [None])), len(g)) for g in by.values() for i in g)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_groups(spark, odd, keep, weak):
    """A weak digest gives many texts the same digest, which the byte check must tell apart."""
    digest = (lambda t: F.encode((F.crc32(t) % 3).cast("string"), "utf-8")) if weak else dedup.sha256
    rng = random.Random(1)
    more = spark.createDataFrame([(100 + i, rng.choice(["a", "A", "a ", "", "b" * 1000, str(rng.randint(0, 50))])) for i in range(300)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = dedup.groups(docs, keep=keep, digest=digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == brute_groups(rows, {"min": min, "max": max}[keep])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    if not weak:
        assert {bytes(r.digest).hex() for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}


def test_deduplicate(odd, none):
    left = dedup.deduplicate(odd, keep="max")
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "5", "6", "7", "8", "9", "None"])
    assert dedup.groups(none).count() == 0 and dedup.deduplicate(none).count() == 0


def test_runs_have_filters_and_answer_lookups(odd):
    import duckdb

    runs = dedup.flush(odd, "doc_id", "text", dedup.sha256)
    for path in runs.inputFiles():
        found = duckdb.sql(f"SELECT bloom_filter_length FROM parquet_metadata('{path.removeprefix('file://')}') WHERE path_in_schema = 'digest'").fetchall()
        assert all(n for (n,) in found)
    assert sorted(r.id for r in dedup.lookup(runs, ["Same text here twice", "never seen"]).collect()) == [4, 4, 5]


def test_levels_merge(spark):
    """Levels of parts merge into the level of the whole."""
    rng = random.Random(2)
    parts = [spark.createDataFrame([(1000 * k + i, str(rng.randint(0, 60))) for i in range(100)], "doc_id long, text string") for k in range(3)]
    levels = [dedup.compact(dedup.flush(p, "doc_id", "text", dedup.sha256)) for p in parts]
    whole = dedup.compact(dedup.flush(parts[0].unionByName(parts[1]).unionByName(parts[2]), "doc_id", "text", dedup.sha256))
    rows = lambda df: sorted((bytes(r.digest), r.keep_id, r.n) for r in df.collect())
    assert rows(dedup.merge([dedup.merge(levels[:2]), levels[2]])) == rows(whole)


@pytest.mark.parametrize("most_bits", [1 << 8, 1 << 26])
def test_filter_has_all_its_keys(spark, most_bits):
    keys = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("k"))
    test = common.may_be_in(keys, most_bits)
    got = spark.range(4000).select("id", test(F.col("id").cast("string")).alias("held")).collect()
    assert all(r.held for r in got if r.id % 2 == 0)
    passed = sum(r.held for r in got if r.id % 2)
    assert passed < 100 if most_bits > 1 << 20 else passed <= 2000
    assert not any(r.held for r in spark.range(9).select(common.may_be_in(keys.where("false"))(F.col("id").cast("string")).alias("held")).collect())


def brute_judge(url, rules, default):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for pattern, verdict in rules:
        h, _, p = pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (-len(pattern), pattern) < (-len(best[0]), best[0])):
            best = (pattern, verdict)
    return host, path, *(best or (None, default))


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://x.NET/en/1", "https://example.net/en/", "http://example.net/en", "http://a.example.com/de/x?y=/z#t", "http://notexample.com/de/",
        "http://org/fr/", "http://a.org/FR/", "ftp://u:p@h.net:80/x", "http://h.net?x=/y", "http://h.net#/", "a://b://c.net/x", "http://é.net/ü", "http://x.net/\nnew", "://net/", "http://example.com.net/de/"] * 2


@pytest.mark.parametrize("literal", [True, False])
def test_rules(spark, literal, monkeypatch):
    rng = random.Random(8)
    labels, parts = ["a", "b", "net", "org", "x-y"], ["en", "de", "p+q", "1"]
    many = tuple({p: urls.Rule(p, rng.choice(["block", "allow"])) for _ in range(60) for p in [".".join(rng.choices(labels, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 2)) + rng.choice([[""], []]))]}.values())
    made = ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 3))) + rng.choice(["", "/", "?q"]) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate([*URLS, *made])), "page_id long, url string").withColumns({"host": F.lit(1), "token": F.lit(2)})
    if not literal:
        monkeypatch.setattr(urls, "LITERAL_RULES", 0)
    for rules in (urls.RULES, many, ()):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
        assert got == {i: brute_judge(u, rules, "allow") for i, u in enumerate([*URLS, *made])}
    assert urls.judge(pages.where("false")).count() == 0


def test_index():
    filed = urls.index((urls.Rule("a.net/x/", "block"), urls.Rule("b.net/", "allow"), urls.Rule("net/", "block")))
    assert {t: [r.pattern for r in rs] for t, rs in filed.items()} == {"h:a": ["a.net/x/"], "h:b": ["b.net/"], "h:net": ["net/"]}
    with pytest.raises(ValueError):
        urls.index((urls.Rule("/x", "block"),))


def brute_fits(pattern, host, path):
    """A rule against a url by backtracking over its characters, without regular expressions."""
    exact, ends = pattern.startswith("|"), len(pattern) > 1 and pattern.endswith("|")
    h, _, p = pattern[exact : len(pattern) - ends].partition("/")
    kept = {*range(48, 58), *range(65, 91), *range(97, 123), *b"_.%-"}

    def fits(rule, text, i, done):
        if not rule:
            return done(i)
        if rule[0] == "*":
            return any(fits(rule[1:], text, j, done) for j in range(i, len(text) + 1))
        if rule[0] == "^":
            parts = i < len(text) and ord(text[i]) < 128 and ord(text[i]) not in kept
            return (parts and fits(rule[1:], text, i + 1, done)) or (i == len(text) and fits(rule[1:], text, i, done))
        return i < len(text) and text[i] == rule[0] and fits(rule[1:], text, i + 1, done)

    starts = [0] if exact else [0, *(i + 1 for i, c in enumerate(host) if c == ".")]
    return any(fits(h, host, i, lambda i: i == len(host)) for i in starts) and path[:1] == "/" and fits(p, path, 1, lambda i: not ends or i == len(path))


def brute_best(rules, host, path):
    fitting = [r for r in rules if brute_fits(r.pattern, host, path)]
    return min(fitting, key=lambda r: (-len(r.pattern), r.pattern), default=None)


@pytest.mark.parametrize("literal", [True, False])
def test_wildcards_anchors_and_own_rules(spark, literal, monkeypatch):
    rng = random.Random(9)
    if not literal:
        monkeypatch.setattr(urls, "LITERAL_RULES", 0)
    symbols = lambda more, n: "".join(rng.choices(["a", "b1", "-", *more], k=n))
    patterns = {rng.choice(["|", "", ""]) + symbols([".", "*", "^"], rng.randint(1, 4)) + "/" + symbols(["/", "*", "^", "."], rng.randint(0, 4)) + rng.choice(["|", "", ""]) for _ in range(400)}
    rules = tuple(urls.Rule(p, rng.choice(["block", "allow"])) for p in sorted(patterns) if urls.rule_tokens(p))
    assert len(rules) > 100
    texts = [symbols([".", ".", ":"], rng.randint(1, 5)) + "/" + symbols(["/", "/", ".", ":", "é", "\n"], rng.randint(0, 5)) for _ in range(500)]
    texts += ["m.casino-win.org/x", "a.b-bets.com/", "casino.org/", "casinos.org/", "xcasino-a.org/", "x.org/login", "x.org/login/1", "x.org/logins", "x.org/a/login", "porn", "x.net/login", "bet", "a.bet/"]
    pages = spark.createDataFrame(list(enumerate("http://" + t for t in texts)), "page_id long, url string").withColumn("method_rule", F.lit(3))
    for mine, own in ((rules, urls.OWN_RULES), ((), rules), (urls.RULES, urls.OWN_RULES)):
        got = {r.page_id: (r.rule, r.method_rule, r.verdict) for r in urls.judge(pages, mine, own=own).collect()}
        for i, text in enumerate(texts):
            host, slash, path = text.partition("/")
            first, second = (brute_best(rs, host, slash + path) for rs in (mine, own))
            want = (first.pattern, None, first.verdict) if first else (None, second.pattern, second.verdict) if second else (None, None, "allow")
            assert got[i] == want, text


@pytest.mark.parametrize("literal", [True, False])
def test_judge_keeps_every_column(spark, literal, monkeypatch):
    if not literal:
        monkeypatch.setattr(urls, "LITERAL_RULES", 0)
    pages = spark.createDataFrame([(1, "http://x.net/", 4, 5, 6, 7, 8, "h")], "page_id long, url string, _h int, _p int, _r int, row int, `a.b` int, Host string")
    r = urls.judge(pages).first().asDict()
    assert [r[c] for c in ("page_id", "_h", "_p", "_r", "row", "a.b")] == [1, 4, 5, 6, 7, 8]
    assert (r["host"], r["rule"], r["verdict"]) == ("x.net", "net/", "block") and "Host" not in r
