"""URL allow and block lists: a trie over reversed host labels, then path segments.

A rule is ``(verdict, "host/path")``. It fits a url if the url's host is the rule's host or a subdomain of it and the
url's path starts with the rule's path (from the first ``/`` on). Of the rules that fit, the longest wins: more host
labels first, then the longer path; ``block`` wins a tie of one rule listed with both verdicts.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Rules that are sent to every executor as one trie (about 300 bytes each); longer lists are joined instead.
MAX_BROADCAST_RULES = 200_000
ALLOW, BLOCK = "allow", "block"
NO_RULE_VERDICT = ALLOW


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


class Node:
    """One host label or path segment. ``ends`` holds (rest of a path, rule, verdict) of the rules that stop here."""

    __slots__ = ("labels", "segments", "ends")

    def __init__(self):
        self.labels, self.segments, self.ends = {}, {}, []

    def __getstate__(self):
        return self.labels, self.segments, self.ends

    def __setstate__(self, state):
        self.labels, self.segments, self.ends = state


def build_trie(rules: Iterable[tuple[str, str]]) -> Node:
    root = Node()
    for verdict, rule in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict must be {ALLOW} or {BLOCK}: {verdict}")
        host, path = split_rule(rule)
        if not host:
            raise ValueError(f"a rule needs a host: {rule!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        whole, _, rest = path.rpartition("/")
        # "/en/ab" is the segments "", "en" and the rest "ab", which only has to begin the next segment.
        for segment in whole.split("/") if path else []:
            node = node.segments.setdefault(segment, Node())
        node.ends.append((rest if path else None, rule, verdict))
    stack = [root]
    while stack:
        node = stack.pop()
        # The longest rest first; block before allow.
        node.ends.sort(key=lambda e: (-len(e[0] or ""), e[2] != BLOCK))
        stack += [*node.labels.values(), *node.segments.values()]
    return root


def match(root: Node, host: str, path: str) -> tuple[str | None, str]:
    """The winning rule (or None) and the verdict."""
    best = None
    node = root
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        best = _deepest(node, segments) or best
    return (best[1], best[2]) if best else (None, NO_RULE_VERDICT)


def _deepest(node: Node, segments: list[str]):
    """The rule with the longest path below one host node, or None. A rule without a path fits every path."""
    best = None
    for depth in range(len(segments)):
        if depth:
            node = node.segments.get(segments[depth - 1])
            if node is None:
                break
        for end in node.ends:
            if end[0] is None or depth and segments[depth].startswith(end[0]):
                best = end
                break
    return best


def filter_urls(urls: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns ``id_col``, host, path, rule, verdict: one row per input row, whatever other columns it has.

    Null urls and urls without ``://`` have an empty host and path and fit no rule; without a rule the verdict is
    ``allow``. Repeated rows are judged one by one; an empty table gives an empty table. Lists of more than
    ``MAX_BROADCAST_RULES`` rules are joined by host suffix and path prefix instead of sent to every executor.
    """
    parts = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if len(rules) > MAX_BROADCAST_RULES:
        return _by_join(parts, rules).withColumnRenamed("id", id_col)
    id_type = parts.schema["id"].dataType.simpleString()
    shared = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batch: pa.RecordBatch) -> dict:
        root = shared.value
        hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = [match(root, h, p) for h, p in zip(hosts, paths, strict=True)]
        return {"id": batch.column(0), "host": hosts, "path": paths, "rule": [f[0] for f in found], "verdict": [f[1] for f in found]}

    if id_type not in ("bigint", "int", "string"):
        raise ValueError(f"ids must be long, int or string, not {id_type}")
    kind = {"bigint": "long"}.get(id_type, id_type)
    return map_rows(parts, judge, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _by_join(parts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The same for long lists: each distinct (host, path) meets its host suffixes and path prefixes in one equi-join."""
    spark = parts.sparkSession
    rows = [(*split_rule(rule), rule, verdict) for verdict, rule in rules]
    listed = spark.createDataFrame(rows, "r_host string, r_path string, rule string, verdict string")
    lengths = sorted({len(r[1]) for r in rows})
    keys = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    cand = keys.select("host", "path", F.explode(suffixes).alias("r_host")).select(
        "host", "path", "r_host", F.explode(F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("r_path")
    )
    order = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), (F.col("verdict") == BLOCK))
    best = cand.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("b"))
    return parts.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(NO_RULE_VERDICT)).alias("verdict")
    )
