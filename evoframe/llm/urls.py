"""URL filters: rules are indexed by their rarest literal token; a URL's tokens fetch candidates, and only those run their patterns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules their index is a constant of the plan and no page is moved; up to so many it is broadcast to the
#: pages' tokens; beyond, it meets them in a shuffle.
INLINE_RULES, BROADCAST_RULES = 2000, 50_000


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path, the literal tokens that any match contains, and its verdict. name: what is reported, if anything."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def host_rule(verdict: str, name: str) -> Rule:
    """host/path: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, path = name.partition("/")
    return Rule(rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}", tokens_of(host), verdict, name)


def word_rule(verdict: str, *words: str) -> Rule:
    """The words joined by hyphens, as a whole part of a host name."""
    return Rule(rf"(?:^|\.){re.escape('-'.join(words))}\.", words, verdict)


HOST_RULES = [
    host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"), host_rule("block", "net/fr/"),
]
#: What judges a URL that no host rule fits: host parts that join two words of a kind by a hyphen, in either order. A URL without a match is allowed.
WORD_PAIRS = [
    (("casino", "poker", "slots", "roulette", "jackpot", "free"), ("win", "bonus", "spins", "bets", "cash")),
    (("cheap", "buy", "discount", "order"), ("pills", "meds", "tabs", "replica", "followers")),
    (("ads", "ad", "click", "banner", "pixel"), ("track", "tracker", "server", "delivery", "net")),
    (("adult", "xxx", "sexy", "nude"), ("x", "cams", "chat", "videos", "dating")),
]
WORD_RULES = [word_rule("block", *order) for left, right in WORD_PAIRS for pair in product(left, right) for order in (pair, pair[::-1])]


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a JSON-lines table: verdict, and either rule (host/path), or pattern with its tokens and, if it is to be reported, a name."""
    rows = spark.read.schema("verdict string, rule string, pattern string, tokens array<string>, name string").json(path).where("verdict is not null and (rule is not null or pattern is not null)").collect()
    return [host_rule(r.verdict, r.rule) if r.rule else Rule(r.pattern, tuple(r.tokens or ()), r.verdict, r.name) for r in rows]


def host(url: str) -> Column:
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    return F.when(F.instr(F.col(url), "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path(url: str) -> Column:
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    return F.when(F.instr(F.col(url), "://") > 0, F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)).otherwise("")


def index_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, pattern, verdict, name, token) of each rule under the token that fewest URLs hold; "" for a rule without one, as every URL holds that."""
    spark = urls.sparkSession
    flat = spark.createDataFrame(
        [(i, t, r.pattern, r.verdict, r.name) for i, r in enumerate(rules) for t in r.tokens or ("",)], "rule int, token string, pattern string, verdict string, name string"
    )
    wanted = _small(flat.select("token").distinct(), rules)
    seen = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    return (
        flat.join(_small(seen, rules), "token", "left")
        .groupBy("rule", "pattern", "verdict", "name")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )


def _small(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


INDEX_SQL = "array<array<struct<token string, pattern string, verdict string, name string>>>"


def inline_index(spark: SparkSession, index: DataFrame, rules: list[Rule]) -> tuple[Column, int]:
    """The index as a constant: rules in buckets by a hash of their token, so that a token is looked up in one step. There are at most INLINE_RULES of them."""
    n = max(1, 2 * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for r in index.select(F.pmod(F.xxhash64("token"), F.lit(n)).alias("bucket"), "token", "pattern", "verdict", "name").orderBy("name", "pattern").collect():
        buckets[r.bucket].append({"token": r.token, "pattern": r.pattern, "verdict": r.verdict, "name": r.name})
    return F.from_json(F.lit(json.dumps(buckets)), INDEX_SQL), n


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages.

    rule is the longest named rule that fits, and gives the verdict; without one, the verdict is block where any unnamed
    rule says so, else allow. A url that is null or has no :// has an empty host and path, and only a rule without tokens can fit it. Equal
    rows stay rows of their own; an empty table gives no rows; further columns are ignored. A rule without a token is run on every URL.
    """
    rules = HOST_RULES + WORD_RULES if rules is None else rules
    # A dash also ends a token; the distinct tokens of host and path are few. Every URL has the token "".
    words = F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+")
    urls = pages.select("page_id", "url").select("page_id", host("url").alias("host"), path("url").alias("path")).withColumn("tokens", F.array_union(F.array(F.lit("")), words))
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    index = index_rules(urls, rules)
    if len(rules) <= INLINE_RULES:
        table, n = inline_index(pages.sparkSession, index, rules)
        fetched = F.flatten(F.transform("tokens", lambda t: F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(n)).cast("int")), lambda r: r["token"] == t)))
        judged = urls.withColumn("fits", F.filter(fetched, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"])))
        best = F.array_max(F.transform(F.filter("fits", lambda r: r["name"].isNotNull()), lambda r: F.struct(F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
        judged = judged.withColumns({"named": best, "blocked": F.exists("fits", lambda r: r["name"].isNull() & (r["verdict"] == "block"))})
    else:
        fetched = (
            urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode("tokens"))
            .join(_small(index, rules), "token", "left")
            .withColumn("fits", F.coalesce(F.expr("regexp_like(concat(host, path), pattern)"), F.lit(False)))
        )
        best = F.struct(F.length("name").alias("n"), F.col("name").alias("name"), F.col("verdict").alias("verdict"))
        judged = fetched.groupBy("row", "page_id", "host", "path").agg(
            F.max(F.when(F.col("fits") & F.col("name").isNotNull(), best)).alias("named"),
            F.bool_or(F.col("fits") & F.col("name").isNull() & F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("blocked"),
        )
    verdict = F.coalesce("named.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("named.name").alias("rule"), verdict.alias("verdict"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql(rules: list[Rule] | None = None) -> str:
    """The same verdicts without an index, in DuckDB's dialect."""
    rules = HOST_RULES + WORD_RULES if rules is None else rules
    named = sorted((r for r in rules if r.name), key=lambda r: -len(r.name))
    fits = lambda r: f"regexp_matches(host || path, {_literal(r.pattern)})"
    rule = " ".join(f"WHEN {fits(r)} THEN {_literal(r.name)}" for r in named)
    verdict = " ".join(f"WHEN {fits(r)} THEN {_literal(r.verdict)}" for r in named)
    block = " OR ".join(fits(r) for r in rules if not r.name and r.verdict == "block") or "false"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest
)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} WHEN {block} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""
