"""URL filters: pattern rules under their rarest literal token; only the rules a URL's tokens fetch run as expressions."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A pattern over host and path: ``||`` starts a host or a label of it, ``*`` is anything, ``^`` a separator or the end.

    The rest is literal; a pattern that starts with none of them may match anywhere. Listed rules come before others.
    """

    action: str
    pattern: str
    listed: bool = False


def host_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains under a path."""
    return Rule(action, f"||{host}{path}", True)


#: The rules that the URL query is asked for.
LISTED = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
#: The library's own rules: words of gambling, drug and click-bait hosts and of tracking paths.
PATTERNS = (
    *(Rule("block", f"||{word}-*.") for word in ("ads", "adult", "casino", "cheap", "free", "poker", "slots", "spam", "xxx")),
    *(Rule("block", f"||*-{word}.") for word in ("bets", "casino", "loans", "pills", "porn", "win", "xxx")),
    *(Rule("block", f"/{word}^") for word in ("ads", "adserver", "banner", "clickbait", "popup", "tracker")),
)


def expression(pattern: str) -> str:
    """The regular expression of a pattern, over host and path."""
    head = r"^(?:[^/]*\.)?" if pattern.startswith("||") else ""
    parts = re.split(r"([*^])", pattern.removeprefix("||"))
    shown = {"*": "[^/]*" if head else ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}
    return "(?s)" + head + "".join(shown.get(p) or re.sub(r"([^A-Za-z0-9])", r"\\\1", p) for p in parts)


def literals(pattern: str) -> list[str]:
    """Tokens that every match holds whole: those with a border on either side."""
    start = pattern.startswith("||")
    body = pattern.removeprefix("||").lower()
    found = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] != "*" if m.start() else start
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return sorted(set(found))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to /, ?, # or the end, A-Z lower-cased) and path (up to ? or #); empty without ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, whole, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def tokens(address: Column) -> Column:
    """Distinct tokens of an address, and the empty one, which fetches rules without a literal."""
    return F.array_union(F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit("")))


def rule_index(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """token, listed, length, rule, action, expression: each rule under the one of its tokens that is rarest in the rows."""
    spark = rows.sparkSession
    made = [(i, r.action, r.listed, len(r.pattern), r.pattern.removeprefix("||"), expression(r.pattern), literals(r.pattern) or [""]) for i, r in enumerate(rules)]
    table = spark.createDataFrame(made, "id long, action string, listed boolean, length long, rule string, expression string, tokens array<string>")
    entries = table.withColumn("token", F.explode("tokens")).drop("tokens")
    asked = sorted({t for *_, own in made for t in own})
    counts = rows.select(F.explode(tokens(F.concat("host", "path"))).alias("token")).where(F.col("token").isin(asked)).groupBy("token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "token")
    return keep(entries.join(counts, "token", "left").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "n"), "rules")


def judge_urls(pages: DataFrame, id_column: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = LISTED + PATTERNS) -> DataFrame:
    """page_id, host, path, rule (the listed rule that decides, else null), pattern (any rule that decides), verdict.

    Of the rules that match, listed ones come first, then the longest, then ``block``, then the pattern's text; without a
    match the verdict is ``allow``. The URLs' tokens fetch their rules from the index (one row a rule), so a URL runs only
    rules whose rarest token it holds; the winner is found before the shuffle, one row a page moves. Null URLs and URLs
    without ``://`` have an empty host and path and match no host rule. Every row is judged by itself: null and repeated ids
    keep their rows; an empty table gives no rows.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    index = rule_index(rows, rules)
    address = F.concat("host", "path")
    fetched = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("token", F.explode(tokens(address)))
        .join(index, "token", "left")
        .withColumn("hit", F.rlike(address, F.col("expression")))
    )
    rank = F.struct("listed", "length", (F.col("action") == "block").alias("blocks"), "rule", "action")
    best = fetched.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("hit"), rank)).alias("best"))
    return best.select(
        "page_id", "host", "path", F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"), F.col("best.rule").alias("pattern"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )
