"""URL filter: a trie over reversed host labels and path segments decides between allow and block rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: A rule: action ("allow" or "block"), host, path prefix.
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the right; under ``None`` the path's trie.

    A path's node is reached by whole segments (those with a ``/`` behind them);
    under its ``None`` stand the lengths, longest first, and rules of last, unfinished segments.
    """
    root: dict = {}
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(None, {})
        if ends.get(rest, ("allow", ""))[0] != "block":
            ends[rest] = (action, host + path)
    _sort_ends(root)
    return root


def _sort_ends(root: dict) -> None:
    todo = [(root, False)]
    while todo:
        node, in_path = todo.pop()
        for key, child in node.items():
            if key is not None:
                todo.append((child, in_path))
            elif in_path:
                node[None] = (sorted({len(rest) for rest in child}, reverse=True), child)
            else:
                todo.append((child, True))


def host_tries(trie: dict, host: str) -> list[dict]:
    """Path tries of the rules that fit the host, of the longest rule host first."""
    found, node = [], trie
    if None in node:
        found.append(node[None])
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            found.append(node[None])
    return found[::-1]


def longest_match(tries: list[dict], path: str) -> tuple[str, str] | None:
    """(action, rule) of the longest fitting rule."""
    segments = path.split("/")
    for node in tries:
        best = None
        for i, segment in enumerate(segments):
            lengths, ends = node.get(None, ((), {}))
            best = next((ends[segment[:n]] for n in lengths if segment[:n] in ends), best)
            node = node.get(segment) if i + 1 < len(segments) else None
            if node is None:
                break
        if best:
            return best
    return None


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, url: str = "url", default: str = "allow", max_trie_rules: int = 200_000) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The rule with the longest host wins, then the one with the longest
    path; of an allow and a block rule for the same host and path, block wins.
    Without a fitting rule ``rule`` is null and ``verdict`` is ``default``.
    An empty rule host fits every host.

    ``rules`` is a list, or a DataFrame with columns ``action host path``. Up to
    ``max_trie_rules`` rules are broadcast as a trie; more are joined on the
    url's host suffixes and path prefixes.

    Null urls and urls without ``://`` have an empty host and path. Columns of
    ``pages`` named like the four new ones are replaced, all others stay. Empty tables give
    empty results; repeated rows are judged alike.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rows = rules.select("action", "host", "path").limit(max_trie_rules + 1).collect()
        known = [tuple(r) for r in rows] if len(rows) <= max_trie_rules else None
        table = rules
    else:
        known = list(rules)
        table = None
        if len(known) > max_trie_rules:
            table, known = spark.createDataFrame(known, "action string, host string, path string"), None
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(F.struct(*kept).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if known is None:
        return _by_join(judged, table, default)
    shared = spark.sparkContext.broadcast(build_trie(known))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            tries = {h: host_tries(trie, h) for h in set(hosts)}
            hits = [longest_match(tries[h], p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [h and h[1] for h in hits], "verdict": [h[0] if h else default for h in hits]})

    return judged.withColumn("found", judge("host", "path")).select("row.*", "host", "path", "found.rule", "found.verdict")


def _by_join(judged: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same result for a rule set too large to broadcast: equality join of (host suffix, whole path segments)."""
    keyed = (
        rules.select("action", F.col("host").alias("_rh"), F.col("path").alias("_rp"))
        .withColumn("_dir", F.regexp_extract("_rp", r"(?s)^(.*/)?", 1))
    )
    pairs = judged.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.split("path", "/", -1)
    prefixes = F.concat(
        F.array(F.lit("")),
        F.when(F.size(segments) > 1, F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda i: F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")),
    )
    probes = pairs.withColumn("_rh", F.explode(F.array_distinct(suffixes))).withColumn("_dir", F.explode(F.array_distinct(prefixes)))
    order = F.struct(F.length("_rh"), F.length("_rp"), F.when(F.col("action") == "block", 1).otherwise(0))
    best = (
        probes.join(keyed, ["_rh", "_dir"])
        .where(F.col("path").startswith(F.col("_rp")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("action", F.concat("_rh", "_rp").alias("rule")), order).alias("_b"))
    )
    found = judged.join(best, ["host", "path"], "left")
    return found.select("row.*", "host", "path", F.col("_b.rule").alias("rule"), F.coalesce(F.col("_b.action"), F.lit(default)).alias("verdict"))


RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every url of ``pages`` judged by the four production rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(action, rh, rp)),
m AS (
  SELECT page_id, action, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
  FROM p JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1
"""
