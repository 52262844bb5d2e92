"""URL filters: allow and block rules in a trie over reversed host labels, then path segments.

A rule names a host and the beginning of a path. It fits its host and all subdomains where the
url's path starts with the rule's. Of the rules that fit, the longest match decides: the one with
most host labels, among those the one with the longest path; of an allow and a block rule that are
otherwise equal the block rule. A url that no rule fits gets the ``default`` verdict.

The trie is broadcast, as long as the texts of the rules stay within ``trie_bytes``. Larger rule
tables are never gathered: they are joined to the host suffixes and path prefixes of the distinct
(host, path) pairs, with the same result.

Defined results: a null url, or one without ``://``, has empty host and path; no rule fits it.
Empty tables give empty results, repeated rows are judged each on their own, urls of any length are
read whole. Columns of the table named like one of the four new columns are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table

# Bytes of rule texts up to which the trie is built on the driver and broadcast.
TRIE_BYTES = 32 << 20

RULE_SCHEMA = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# Fixed values of the query's contract.
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """The rules as steps from node to node: reversed host labels, ``/``, whole path segments.

    What is left of a rule's path behind its last slash is a tail, kept at the node it follows.
    Flat tables instead of nested ones: rules of any depth can be pickled.
    """

    PATH = "/"  # the step from a host to its paths; no label can be a slash

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = list(rules)
        self.steps: dict[tuple[int, str], int] = {}
        self.tails: dict[int, dict[str, int]] = {}
        self.lengths: dict[int, list[int]] = {}
        self.labels = self.segments = 0
        nodes = 1
        for number, rule in enumerate(self.rules):
            labels = rule.host.split(".")[::-1]
            *whole, tail = rule.path.split("/")
            self.labels = max(self.labels, len(labels))
            self.segments = max(self.segments, len(whole))
            at = 0
            for step in [*labels, self.PATH, *whole]:
                to = self.steps.setdefault((at, step), nodes)
                nodes += to == nodes
                at = to
            ends = self.tails.setdefault(at, {})
            if rule.verdict == "block" or tail not in ends:
                ends[tail] = number
        for at, ends in self.tails.items():
            self.lengths[at] = sorted({len(t) for t in ends}, reverse=True)

    def _tail(self, at: int, text: str) -> int | None:
        for size in self.lengths.get(at, ()):
            if len(text) >= size and (number := self.tails[at].get(text[:size])) is not None:
                return number
        return None

    def _path(self, at: int, parts: list[str]) -> int | None:
        best = self._tail(at, parts[0])
        for part, rest in zip(parts, parts[1:]):
            at = self.steps.get((at, part))
            if at is None:
                break
            found = self._tail(at, rest)
            best = best if found is None else found
        return best

    def longest(self, host: str, path: str) -> int | None:
        """Number of the rule that decides, or None."""
        parts = path.split("/", self.segments)
        best, at = None, 0
        for label in host.rsplit(".", self.labels)[: -self.labels - 1 : -1]:
            at = self.steps.get((at, label))
            if at is None:
                break
            paths = self.steps.get((at, self.PATH))
            found = None if paths is None else self._path(paths, parts)
            best = best if found is None else found
        return best


def _checked(rules: Sequence[Rule]) -> list[Rule]:
    """The rules with lower-cased hosts; an unusable one raises ValueError."""
    done = []
    for host, path, verdict in rules:
        if not host or set(host) & set("/?#") or verdict not in ("allow", "block"):
            raise ValueError(f"no usable rule: {host!r}, {path!r}, {verdict!r}")
        if path is None or (path and not path.startswith("/")) or set(path) & set("?#"):
            raise ValueError(f"a rule's path is empty or begins with a slash: {path!r}")
        done.append(Rule(host.translate(str.maketrans(UPPER, LOWER)), path, verdict))
    return done


def _by_trie(frame: DataFrame, rules: Sequence[Rule], host: str, path: str, found: str) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        named = [(f"{r.host}{r.path}", r.verdict) for r in trie.rules]
        for hosts, paths in batches:
            numbers = [trie.longest(h, p) for h, p in zip(hosts, paths)]
            made = [(None, None) if k is None else named[k] for k in numbers]
            yield pd.DataFrame(made, columns=["rule", "verdict"])

    return frame.withColumn(found, decide(host, path))


def _by_join(frame: DataFrame, rules: DataFrame, host: str, path: str, found: str) -> DataFrame:
    """Rules joined to the host suffixes and path prefixes of each distinct (host, path)."""
    folder = F.regexp_extract("path", "(?s)^(?:.*/)?", 0)
    lowered = F.translate("host", UPPER, LOWER)
    entries = rules.select(
        lowered.alias("r_host"),
        folder.alias("r_folder"),
        F.expr("substr(path, length(regexp_extract(path, '(?s)^(?:.*/)?', 0)) + 1)").alias("r_tail"),
        F.struct(
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("length"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat(lowered, "path").alias("rule"),
            "verdict",
        ).alias("r"),
    )
    deepest = entries.agg(
        F.max("r.labels").alias("labels"), F.max(F.size(F.split("r_folder", "/"))).alias("segments")
    ).first()
    labels, parts = F.split("u_host", r"\."), F.split("u_path", "/", deepest["segments"] or 1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest["labels"] or 1))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    folders = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n > 0, "/").otherwise("")),
    )
    pairs = frame.select(F.col(host).alias("u_host"), F.col(path).alias("u_path")).distinct()
    asked = pairs.select("*", F.explode(suffixes).alias("r_host")).select("*", F.explode(folders).alias("r_folder"))
    rest = F.expr("substr(u_path, length(r_folder) + 1)")
    best = (
        asked.join(entries, ["r_host", "r_folder"])
        .where(rest.startswith(F.col("r_tail")))
        .groupBy("u_host", "u_path")
        .agg(F.max("r").alias("r"))
        .select("u_host", "u_path", F.struct("r.rule", "r.verdict").alias(found))
    )
    on = (F.col(host) == F.col("u_host")) & (F.col(path) == F.col("u_path"))
    return frame.join(best, on, "left").drop("u_host", "u_path")


def filter_urls(
    frame: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    *,
    url: str = "url",
    default: str = "allow",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``frame`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    ``rules`` is a list, or a table of host, path and verdict. Rules of a list are checked; rows of
    a table that are no usable rules raise as well when the trie takes them, and fit nothing or
    their literal text when the table is too large for it.
    """
    spark = frame.sparkSession
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
        listed = _checked(rules.select("host", "path", "verdict").collect()) if size <= trie_bytes else None
    else:
        listed = _checked(rules)
        if sum(len(r.host.encode()) + len(r.path.encode()) + 64 for r in listed) > trie_bytes:
            rules, listed = spark.createDataFrame(listed, RULE_SCHEMA), None
    # Names of their own while at work: the new columns may replace the url itself.
    host, path, found = fresh(frame, "u_host_", "u_path_", "u_found_")
    split = frame.withColumns({host: url_host(F.col(url)), path: url_path(F.col(url))})
    judged = (
        _by_join(split, rules, host, path, found)
        if listed is None
        else _by_trie(split, listed, host, path, found)
    )
    new = {"host", "path", "rule", "verdict"}
    return judged.select(
        *[F.col(f"`{c}`") for c in frame.columns if c.lower() not in new],
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(f"{found}.rule").alias("rule"),
        F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"),
    )


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(urls, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH split AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(r_host, r_path, r_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
    SELECT page_id, host, path,
           (SELECT max({'labels': length(r_host) - length(replace(r_host, '.', '')), 'size': length(r_path),
                        'rule': r_host || r_path, 'verdict': r_verdict})
            FROM rules
            WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS found
    FROM split
)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, 'allow') AS verdict FROM judged
"""
