"""URL filter: a trie over reversed host labels and path prefixes decides between allow and block rules.

The host and path are cut out by built-in functions; only (host, path) goes through the trie, which is broadcast.  A
rule list is configuration, checked to hold at most ``MAX_RULES`` entries.  The deepest host wins, then the longest
path; an entry that is both allowed and blocked is blocked.  A URL that fits no rule gets ``default``.  Null, empty or
scheme-less URLs have an empty host and path and fit no rule.  Repeated rows are judged each on its own.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
Rule = tuple[str, str, str]  # verdict, host, path prefix


def build(rules: Sequence[Rule]) -> dict:
    """Nodes by reversed host label; a node's rules are a trie over path segments, its last step any prefix of one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
    root: dict = {"next": {}, "paths": None}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        node["paths"] = node["paths"] or {"next": {}, "ends": {}}
        *whole, last = path.split("/")
        step = node["paths"]
        for segment in whole:
            step = step["next"].setdefault(segment, {"next": {}, "ends": {}})
        if step["ends"].get(last, ("",))[0] != "block":
            step["ends"][last] = (verdict, f"{host.lower()}{path}")
    return root


def _by_path(step: dict, path: str) -> tuple[str, str] | None:
    """The longest rule path that the path starts with: whole segments, then a prefix of the next one."""
    best = None
    segments = path.split("/")
    for i, segment in enumerate(segments):
        ends = step["ends"]
        for size in range(min(len(segment), max(map(len, ends), default=-1)) + 1):
            if segment[:size] in ends:
                best = ends[segment[:size]]
        step = step["next"].get(segment)
        if step is None or i + 1 == len(segments):
            break
    return best


def judge(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest fitting entry."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        if node["paths"] is not None:
            best = _by_path(node["paths"], path) or best
    return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of each row of ``pages`` (page_id, url)."""
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            found = [judge(trie.value, h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x and x[1] for x in found], pa.string()),
                                              pa.array([x[0] if x else default for x in found], pa.string())],
                                             ["rule", "verdict"])

    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return (cut.withColumn("found", look_up("host", "path"))
            .select("page_id", "host", "path", "found.rule", "found.verdict"))
