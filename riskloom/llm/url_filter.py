"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join that removes false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm.common import fresh

WORDS = 8                   # 64-bit words in a block; a key sets one bit in each
KEYS_PER_BLOCK = 32         # 16 bits for each listed key
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for texts without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` and path without trailing slashes; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host(url), F.lit(r"^www\."), F.lit("")), F.regexp_replace(path(url), F.lit("/+$"), F.lit("")))


def _rule_key(host_: Column, path_: Column) -> Column:
    return F.concat(F.lit("rule "), host_, path_)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """The list, one row a key: ``rules(rule, verdict)`` such as ``example.com/en/``, and the canonical form of ``listed(url)``.

    Of contradicting verdicts for one rule, block counts.  Null rules, verdicts and URLs, and URLs without ``://``, are left out.
    """
    ruled = rules.filter("rule IS NOT NULL AND verdict IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host_ = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)
    path_ = F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    ruled = ruled.select(_rule_key(host_, path_).alias("key"), "rule", "verdict", F.length("rule").alias("long"), F.length(host_).alias("host_long"), F.length(path_).alias("path_long"),
                         host_.alias("rule_host"))
    none = F.lit(None)
    plain = listed.select(canonical(F.col("url")).alias("key")).filter("key <> ''").distinct()
    return ruled.unionByName(plain.select(F.concat(F.lit("url "), "key").alias("key"), none.cast("string").alias("rule"), F.lit("block").alias("verdict"),
                                          F.lit(-1).alias("long"), F.lit(0).alias("host_long"), none.cast("int").alias("path_long"), none.cast("string").alias("rule_host")))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the key's block."""
    hash_ = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftrightunsigned(hash_, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: a row ``(block, w0 ... w7)`` for every block with a key.  It grows with the list and is never collected."""
    keys = listed.select("key", _block(F.col("key"), blocks).alias("block"))
    return keys.groupBy("block").agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])


def possible(keys: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The distinct keys that the filter does not rule out."""
    found = keys.select("key", _block(F.col("key"), blocks).alias("block")).join(filter_, "block")
    hit = [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("key")))]
    for h in hit:
        found = found.filter(h)
    return found.select("key")


def candidates(urls: DataFrame, known: DataFrame) -> DataFrame:
    """``(url, key)``: all keys under which a URL may be listed.

    Its canonical form, and, for every host from itself up to its last label that some rule has, the starts of the path that are as long as
    the paths of that host's rules.  Hosts meet the rules' hosts first, each once, so a long list costs a URL only the rules of its own host.
    """
    parts = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).filter("host <> ''")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    hosts = parts.select("host").distinct().select("host", F.explode(F.array_distinct(above)).alias("rule_host"))
    ruled = known.filter("rule_host IS NOT NULL").select("rule_host", "path_long").distinct()
    # stored, so that Spark may split the URLs of a host with a third of them over several tasks of the join
    fits = durable(hosts.join(ruled, "rule_host").select(F.col("host").alias("of"), "rule_host", "path_long"), "host-rules")
    started = parts.join(fits, F.col("host") == F.col("of")).filter(F.col("path_long") <= F.length("path"))
    return parts.select("url", F.concat(F.lit("url "), canonical(F.col("url"))).alias("key")).unionByName(
        started.select("url", _rule_key(F.col("rule_host"), F.substring(F.col("path"), F.lit(1), F.col("path_long"))).alias("key")))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (longer names where these exist).

    A rule fits its host and all subdomains when the URL's path starts with the rule's path; of several the longest
    decides, then the one with the longest host.  Without a rule, a URL whose canonical form is listed is blocked and any other allowed.

    Distinct keys meet the filter, and what it passes meets the list in an exact join, so a host or URL with a third of all rows
    is looked up once.  Null URLs and texts without ``://`` have empty host and path and are allowed; repeated rows stay; an
    empty list allows all; an empty table gives no rows.
    """
    known = durable(entries(rules, listed), "url-list")
    blocks = max(1, -(-known.count() // KEYS_PER_BLOCK))
    filter_ = durable(bloom(known, blocks), "url-filter")
    own, found = fresh(pages, "url_judged", "found")
    keys = durable(candidates(pages.select(F.col(f"`{url}`").cast("string").alias("url")).filter("url IS NOT NULL").distinct(), known), "url-keys")
    hits = durable(possible(keys.select("key").distinct(), filter_, blocks).join(known, "key"), "url-hits")
    order = F.struct("long", "host_long", "rule")
    best = keys.join(hits, "key").groupBy(F.col("url").alias(own)).agg(F.max_by(F.struct("rule", "verdict"), order).alias(found))
    names = fresh(pages, "host", "path", "rule", "verdict")
    column = F.col(f"`{url}`").cast("string")
    joined = pages.join(durable(best, "url-verdicts"), column == F.col(own), "left")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], F.coalesce(host(column), F.lit("")).alias(names[0]), F.coalesce(path(column), F.lit("")).alias(names[1]),
                         F.col(found)["rule"].alias(names[2]), F.coalesce(F.col(found)["verdict"], F.lit("allow")).alias(names[3]))
