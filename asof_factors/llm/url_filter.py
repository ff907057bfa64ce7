"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
that any match must hold whole.  Token counts over all URLs (of tokens that
rules hold) name each rule's rarest token; the tokens of a URL fetch the rules
filed under them, and only those rules run their regular expression.

Up to INLINE_RULES rules the index is a hash table of constants in the plan:
a page is judged where it is read, without join or shuffle.  Beyond, the index
is a table joined on token (by broadcast while it is below a checked length),
and only URLs with a token of the index take part in the join.

Defined results: a null URL or one without ``://`` has an empty host and path
and no rule; repeated rows give repeated results; of rules that fit, those of
the highest rank win, then the longest, then the last in text order.  A URL
that no rule fits is allowed.  An empty table gives an empty result.  Other
columns of the table play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

INLINE_RULES, BROADCAST_RULES = 5_000, 200_000


@dataclass(frozen=True)
class Rule:
    """``rank``: rules of a higher rank win over any of a lower one."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int = 0


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains, if the path starts so."""
    whole = re.findall(r"[0-9a-z]+", host.lower()) + re.findall(r"(?<=[^0-9A-Za-z])[0-9A-Za-z]+(?=[^0-9A-Za-z])", path)
    return Rule(host + path, action, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(t.lower() for t in whole), 1)


def pattern_rule(action: str, literal: str) -> Rule:
    """Fits hosts that hold the literal between separators."""
    return Rule(f"*{literal}*", action, rf"\A(?:[^/?#]*[.-])?{re.escape(literal)}(?:[.-][^/?#]*)?(?:/|\z)", tuple(re.findall(r"[0-9a-z]+", literal)), 0)


#: The contract's rules.
SITE_RULES = [
    site_rule("block", "com", "/en/"),
    site_rule("allow", "example.com", "/en/7"),
    site_rule("allow", "net", "/de/"),
    site_rule("block", "example.net", "/de/8"),
    site_rule("block", "org", "/es/"),
]
#: What hosts sell that no corpus wants, alone or with a second word.
SOLD = ("adult", "bets", "bingo", "camgirls", "cams", "casino", "cialis", "erotic", "escort", "escorts", "fetish", "gambling", "hentai", "hookup", "jackpot", "milf", "nude", "nudes", "payday", "poker", "porn", "porno", "replica", "roulette", "sex", "slots", "spam", "spins", "viagra", "warez", "webcam", "xxx")
WITH = ("best", "bonus", "buy", "cheap", "club", "deal", "deals", "farm", "free", "girls", "hot", "live", "mega", "now", "online", "play", "shop", "site", "store", "top", "tube", "video", "videos", "vip", "win", "world", "x", "zone")
PATTERN_RULES = [pattern_rule("block", x) for a in SOLD for x in (a, *(f"{a}-{b}" for b in WITH), *(f"{b}-{a}" for b in WITH))]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise("")
    bare = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)\A([^?#]*)", 1)
    return ascii_lower(F.regexp_extract(bare, r"(?s)\A([^/]*)", 1)), F.regexp_extract(bare, r"(?s)\A[^/]*(.*)\z", 1)


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat(host, path)), "[^0-9a-z]+"))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs (one row a token)."""
    known = sorted({t for r in rules for t in r.tokens})
    held = F.filter("tokens", lambda t: t.isin(known))
    return {r.token: r["n"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """page_id, url, host, path, rule (name), rank, verdict and n_run (how many
    rules ran their regular expression) of each row."""
    if bad := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token cannot be indexed: {bad}")
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    urls = urls.withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    if len(rules) <= inline:
        counts = token_counts(urls, rules)
        filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r) for r in rules]
        found = urls.select("page_id", "url", "host", "path", _by_constants(filed).alias("fetched"))
        fits = F.filter("fetched", lambda r: F.rlike(F.concat("host", "path"), r["regex"]))
        best = F.array_max(F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), F.char_length(r["name"]).alias("size"), r["name"].alias("name"), r["action"].alias("action"))))
        found = found.select("page_id", "url", "host", "path", F.size("fetched").alias("n_run"), best.alias("best"))
    else:
        found = _by_join(urls, rules)
    return found.select("page_id", "url", "host", "path", F.col("best.name").alias("rule"), F.col("best.rank").alias("rank"), F.coalesce("best.action", F.lit(default)).alias("verdict"), F.col("n_run").cast("long").alias("n_run"))


def _by_constants(filed: list[tuple[str, Rule]]) -> Column:
    """The rules filed under a URL's tokens, from a hash table of constants."""
    kind = "array<array<struct<token:string,name:string,action:string,regex:string,rank:int>>>"
    size = max(1, 2 * len({t for t, _ in filed}))
    slots: list[list[dict]] = [[] for _ in range(size)]
    for t, r in filed:
        slots[_slot(t, size)].append({"token": t, "name": r.name, "action": r.action, "regex": r.regex, "rank": r.rank})
    table_ = F.from_json(F.lit(json.dumps({"s": slots})), f"struct<s:{kind}>")["s"]
    return F.flatten(F.transform("tokens", lambda t: F.filter(F.get(table_, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int")), lambda r: r["token"] == t)))


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def _by_join(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, url, host, path, n_run and best, for rule lists of any size."""
    spark = urls.sparkSession
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    pairs = spark.createDataFrame([(n, t) for n, r in enumerate(rules) for t in r.tokens], "rule int, token string")
    names = spark.createDataFrame([(n, r.name, r.action, r.regex, r.rank) for n, r in enumerate(rules)], "rule int, name string, action string, regex string, rank int")
    counts = urls.select(F.explode("tokens").alias("token")).join(small(pairs.select("token").distinct()), "token").groupBy("token").count()
    rarest = pairs.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = rarest.join(names, "rule").select("token", "name", "action", "regex", "rank")
    # a row's own number: it is dealt where it is read, before any shuffle
    rows = urls.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "page_id", "url", "host", "path", F.explode("tokens").alias("token"))
    fits = F.rlike(F.concat("host", "path"), F.col("regex"))
    best = F.when(fits, F.struct("rank", F.char_length("name").alias("size"), "name", "action"))
    return each.join(small(index), "token", "left").groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "host", "path")], F.count("name").alias("n_run"), F.max(best).alias("best")).drop("row")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"), SITE_RULES + PATTERN_RULES)
    return found.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict")


_SQL_SITE = ", ".join(f"('{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.action}')" for r in SITE_RULES)
# a host that holds a pair of words holds its first one too
_SQL_PATTERN = "|".join(SOLD)
SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/]*(.*)$', 1) AS path
  FROM u
), r(rhost, rpath, action) AS (VALUES {_SQL_SITE}),
m AS (
  SELECT n, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n
)
SELECT page_id, host, path, rule,
       CASE WHEN action IS NOT NULL THEN action
            WHEN regexp_matches(host, '(^|[.-])({_SQL_PATTERN})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (n)
"""
