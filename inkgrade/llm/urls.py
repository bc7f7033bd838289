"""URL filter: a trie over reversed host labels and path segments, longest match between allow and block entries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkgrade.llm.common import lower_ascii

Rule = tuple[str, str]  # verdict, "host/path"

# The rules that every url is judged by first.
BASE_RULES: list[Rule] = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]

#: Entries of this library's own, for urls that no given rule fits.
OWN_RULES: list[Rule] = [
    ("block", "spam-farm.example.org/"), ("block", "spam-farm.example.net/"), ("block", "spam-farm.example.com/"),
    ("block", "adult-x.example.org/"), ("block", "adult-x.example.net/"), ("block", "adult-x.example.com/"),
    ("block", "casino-win.example.org/"), ("block", "casino-win.example.net/"), ("block", "casino-win.example.com/"),
]


class UrlTrie:
    """Host labels from the right, then whole path segments, then what follows the last slash of a rule.

    The rule with the most host labels wins, among those the one with the longest path. Of an allow and a
    block entry for the same place, block wins.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, text in rules:
            host, _, path = text.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("label", label), {})
            *whole, rest = f"/{path}".split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            if node.setdefault("rules", {}).get(rest, ("", ""))[0] != "block":
                node["rules"][rest] = (verdict, text)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest fitting rule, or None."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            if "paths" in node:
                best = self._path(node["paths"], segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            fitting = [rest for rest in node.get("rules", ()) if segment.startswith(rest)]
            if fitting:
                best = node["rules"][max(fitting, key=len)]
            node = node.get(("segment", segment))
            if node is None:
                break
        return best


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filter_urls(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = BASE_RULES,
    own_rules: Sequence[Rule] = OWN_RULES, default: str = "allow",
) -> DataFrame:
    """Judge every url: (page_id, host, path, rule, verdict, own_rule).

    ``rule`` is the longest fitting entry of ``rules``, else null; then the longest entry of ``own_rules``
    decides (``own_rule``), and without one ``default``. Null urls and urls without ``://`` have an empty host
    and path, so no rule fits them. Repeated rows are judged one by one; an empty table gives no rows; other
    columns are left out. The tries hold the rules alone, so their broadcast does not grow with the pages.
    """
    spark = pages.sparkSession
    tries = spark.sparkContext.broadcast((UrlTrie(rules), UrlTrie(own_rules)))

    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        given, own = tries.value
        for hosts, paths in parts:
            rows = []
            for host, path in zip(hosts, paths, strict=True):
                hit = given.match(host, path)
                more = None if hit else own.match(host, path)
                rows.append((hit[1] if hit else None, (hit or more or (default,))[0], more[1] if more else None))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "own_rule"], dtype=object)

    judged = F.pandas_udf(judge, "rule string, verdict string, own_rule string")
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(
        F.col(id_col).alias("page_id"),
        lower_ascii(F.regexp_extract(url, split, 1)).alias("host"), F.regexp_extract(url, split, 2).alias("path"),
    )
    return parts.select("page_id", "host", "path", judged("host", "path").alias("hit")).select(
        "page_id", "host", "path", "hit.rule", "hit.verdict", "hit.own_rule"
    )
