"""URL filters: pattern rules indexed by their rarest literal token.

A rule is ``host/path``: it fits its host and every subdomain of it, where the url's path starts
with the rule's path. In a rule ``*`` stands for any characters (in the host: of the host), ``^`` for a
separator or the end, ``|`` in front for the host itself without subdomains, and ``|`` at the end for the
end of the path. Each rule is filed under the one of its literal tokens that the fewest rules have; a
url's own tokens fetch the rules filed under them, and only those run their regular expression. The
longest rule that fits decides. Where none does, the method's own rules are asked in the same way.
Everything is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An index of up to so many rules travels inside the plan as a literal map; a larger one is joined.
LITERAL_RULES = 2000


class Rule(NamedTuple):
    pattern: str
    verdict: str


#: The rules of the registered query (fixed values).
RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)
DEFAULT_VERDICT = "allow"
#: Words of hosts, and beginnings of paths, that the method itself blocks (fixed values).
HOST_WORDS = ("bet", "bets", "casino", "pills", "poker", "porn", "xxx")
PATH_STARTS = ("ads", "cart", "checkout", "login", "logout", "signup", "track", "wp-login.php")
OWN_RULES = (
    *(Rule(form.format(w), "block") for w in HOST_WORDS for form in ("{}.*/", "{}-*/", "*-{}.*/", "*-{}-*/")),
    *(Rule(f"*/{p}^", "block") for p in PATH_STARTS),
)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: What splits tokens, and what a rule's ``^`` fits besides the end; the second is part of the first.
NO_TOKEN, SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x24\x26-\x2C/\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"


def _parts(pattern: str) -> tuple[bool, str, str, bool]:
    """Whether the host has no subdomains, the host, the path without its first slash, whether the path ends there."""
    exact, ends = pattern.startswith("|"), len(pattern) > 1 and pattern.endswith("|")
    host, _, path = pattern[exact : len(pattern) - ends].partition("/")
    return exact, host, path, ends


def rule_tokens(pattern: str) -> list[str]:
    """The literal tokens that every url fitting the pattern has: runs of letters and digits that nothing can lengthen."""
    _, host, path, ends = _parts(pattern)
    found = []
    for kind, text, open_end in (("h", host, False), ("p", path, not ends)):
        # Next to a wildcard, or at an open end, a run may be part of a longer one.
        runs = re.split(NO_TOKEN.replace(r"\x2F", r"\x29\x2B-\x2F"), text + "*" * open_end)
        found += [f"{kind}:{r}" for r in runs if r and "*" not in r]
    return found


def rule_regex(pattern: str) -> str:
    exact, host, path, ends = _parts(pattern)

    def literal(text: str, anything: str, separator: str) -> str:
        wild = {"*": anything, "^": separator}
        return "".join(wild.get(c) or re.escape(c) for c in text)

    below = "" if exact else r"(?:[^/]*\.)?"
    whole_host = literal(host, "[^/]*", rf"(?:(?!/){SEPARATOR}|(?=/))")
    return rf"(?s)^{below}{whole_host}/" + literal(path, ".*", rf"(?:{SEPARATOR}|\z)") + r"\z" * ends


def index(rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token (the first such one in text order on a tie)."""
    for rule in rules:
        if not rule_tokens(rule.pattern):
            raise ValueError(f"the rule {rule.pattern!r} has no literal token")
    often = Counter(t for r in rules for t in set(rule_tokens(r.pattern)))
    filed = defaultdict(list)
    for rule in rules:
        filed[min(rule_tokens(rule.pattern), key=lambda t: (often[t], t))].append(rule)
    return dict(filed)


def url_tokens(host: Column, path: Column) -> Column:
    tokens = lambda kind, text: F.transform(F.split(text, NO_TOKEN), lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_distinct(F.concat(tokens("h", host), tokens("p", path)))


def best_rule(candidates: Column) -> Column:
    """The longest of the rules that fit, the caller's before the method's; of two equally long ones the first in text order."""
    return F.try_element_at(F.array_sort(
        F.transform(candidates, lambda r: F.struct(r["own"].alias("own"), (-F.length(r["pattern"])).alias("k"), r["pattern"].alias("pattern"), r["verdict"].alias("verdict")))
    ), F.lit(1))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT_VERDICT, url: str = "url", own: tuple[Rule, ...] = OWN_RULES) -> DataFrame:
    """``pages`` with host, path, rule, method_rule and verdict; columns of those names are replaced, all others stay.

    ``rule`` is the one of ``rules`` that decides; where there is none, ``method_rule`` is the one of ``own`` that does.
    A null url, or one without ``://``, has an empty host and path and gets the default verdict, as
    does a url that no rule fits. Repeated rows are judged one by one; an empty table stays empty.
    An empty rule set gives every row the default verdict.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    known = {r.pattern for r in rules}
    own = tuple(r for r in own if r.pattern not in known)
    filed, mine = index((*rules, *own)), {r.pattern for r in own}
    out = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host.alias("_h"), path.alias("_p"))
    if len(rules) + len(own) <= LITERAL_RULES:
        out = out.withColumn("_r", best_rule(_from_literal(filed, mine)))
    else:
        out = _from_join(out, filed, mine)
    names = {"host": F.col("_h"), "path": F.col("_p"), "rule": F.when(~F.col("_r.own"), F.col("_r.pattern")),
             "method_rule": F.when(F.col("_r.own"), F.col("_r.pattern")), "verdict": F.coalesce(F.col("_r.verdict"), F.lit(default))}
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in names]
    return out.select(*kept, *(column.alias(name) for name, column in names.items()))


def _from_literal(filed: dict[str, list[Rule]], mine: set[str]) -> Column:
    kind = "array<struct<own:boolean,pattern:string,verdict:string,regex:string>>"
    if not filed:
        return F.array().cast(kind)

    def literal(rule: Rule) -> Column:
        return F.struct(F.lit(rule.pattern in mine).alias("own"), F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"), F.lit(rule_regex(rule.pattern)).alias("regex"))

    table = F.create_map(*[x for token, rules in sorted(filed.items()) for x in (F.lit(token), F.array(*map(literal, rules)))])
    fetched = F.flatten(F.transform(url_tokens(F.col("_h"), F.col("_p")), lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast(kind))))
    return F.filter(fetched, lambda r: F.rlike(F.concat(F.col("_h"), F.col("_p")), r["regex"]))


def _from_join(pages: DataFrame, filed: dict[str, list[Rule]], mine: set[str]) -> DataFrame:
    """The same with the index as a table: Spark broadcasts it where its size allows, and else shuffles.

    Urls are judged once per distinct host and path, so that a common host costs one row.
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame([(t, r.pattern in mine, r.pattern, r.verdict, rule_regex(r.pattern)) for t, rs in filed.items() for r in rs], "token string, own boolean, pattern string, verdict string, regex string")
    urls = pages.select("_h", "_p").distinct()
    hits = (
        urls.withColumn("token", F.explode(url_tokens(F.col("_h"), F.col("_p"))))
        .join(rules, "token")
        .where(F.rlike(F.concat("_h", "_p"), F.col("regex")))
        .groupBy("_h", "_p")
        .agg(F.min(F.struct("own", (-F.length("pattern")).alias("k"), "pattern", "verdict")).alias("_r"))
    )
    return pages.join(hits, ["_h", "_p"], "left")
