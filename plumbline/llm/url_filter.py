"""URL rules with redirect equivalence.

Rules name a host and a path prefix and allow or block; a rule fits its host and all
subdomains, and the longest fitting rule decides. Pages that no rule fits take the
decision of their aliases: URLs linked by redirects or canonical links form connected
components, and a component with a blocked member and no explicitly allowed one is blocked.
An explicit allow takes precedence over a propagated block. Without either the verdict is
"allow".

URLs are one node if they differ only in the case of scheme and host or in the fragment.
Rules are looked up by host suffix, so their number is bounded by memory alone.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule
and has no aliases. Equal URLs share a verdict, repeated pages keep their rows, and URLs of
any length are read whole. Of rules with equal names an allow goes first. A link target that
is no URL is no link.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, join_unique
from plumbline.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REFRESH = re.compile(r"(?is)url\s*=\s*[\"']?([^\"']*)")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def node(url: Column) -> Column:
    """What equal URLs share; null without ``://``."""
    parts = r"(?s)^(.*?://[^/?#]*)([^#]*)"
    return F.when(F.contains(url, F.lit("://")), F.concat(F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER), F.regexp_extract(url, parts, 2)))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; both null without one."""
    by_host: dict[str, list[tuple[int, str, str, str]]] = defaultdict(list)
    for rule in rules:
        by_host[rule.host].append((-len(rule.name), rule.verdict, rule.name, rule.path))
    table = {h: sorted(found) for h, found in by_host.items()}

    def best(host: str, path: str) -> tuple[str | None, str | None]:
        found, labels = [], host.split(".")
        for i in range(len(labels)):
            here = table.get(".".join(labels[i:]), ())
            found += [next((r for r in here if path.startswith(r[3])), None)]
        size, verdict, name, _ = min(filter(None, found), default=(0, None, None, None))
        return name, verdict

    @F.pandas_udf("rule string, verdict string")
    def work(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = [known[u] if u in known else known.setdefault(u, best(*u)) for u in zip(hosts, paths, strict=True)]
        return pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

    return work(host, path)


class _Links(HTMLParser):
    """The targets of all canonical links and meta refreshes of a page."""

    def __init__(self):
        super().__init__()
        self.base, self.targets = None, []

    def handle_starttag(self, tag, attrs):
        if tag not in ("base", "link", "meta"):
            return
        named = {k: v or "" for k, v in reversed(attrs)}  # the first of a name counts
        if tag == "base" and self.base is None:
            self.base = named.get("href")
        elif tag == "link" and "canonical" in named.get("rel", "").lower().split():
            self.targets.append(named.get("href", ""))
        elif tag == "meta" and named.get("http-equiv", "").strip().lower() == "refresh" and (found := _REFRESH.search(named.get("content", ""))):
            self.targets.append(found[1])


def link_targets(url: str, html: str) -> list[str]:
    """Absolute URLs that the page says it is or goes to."""
    links = _Links()
    try:
        links.feed(html)
        links.close()
    except AssertionError:  # a malformed declaration ends the page
        pass
    out = []
    for target in links.targets:
        try:
            absolute = urljoin(urljoin(url, links.base or ""), target.strip())
        except ValueError:  # no URL
            continue
        if target.strip() and "://" in absolute:
            out.append(absolute)
    return list(dict.fromkeys(out))


def html_aliases(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(a, b)`` from pages to the targets of all their canonical links and meta refreshes.

    Relative targets are resolved, by the page's ``base`` if it has one, and entities decoded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u, t) for u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in link_targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["a", "b"])

    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    some = pages.select(url.alias("url"), html.alias("html")).where(F.contains("url", F.lit("://")) & F.col("html").rlike(r"(?i)<(link|meta)\b") & F.col("html").rlike("(?i)canonical|refresh|&#"))
    return some.mapInArrow(work, "a string, b string").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict, component)`` for each row of ``pages``.

    ``edges (a, b)`` are alias pairs of URLs; they may name URLs that no page has.
    """
    url = F.col(f"`{url_col}`")
    base = pages.select(F.col(f"`{id_col}`").alias("_id"), url.alias("_url"), node(url).alias("_node")).withColumns(dict(zip(("host", "path"), host_and_path(F.col("_url")), strict=True))).drop("_url")
    members = cut(connected_components(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).where("a is not null and b is not null")))
    judged = members.withColumns(dict(zip(("h", "p"), host_and_path(F.col("node")), strict=True)))
    judged = cut(judged.withColumn("own", fitting_rule(F.col("h"), F.col("p"), rules)["verdict"]))
    whole = judged.groupBy("component").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
    blocked = F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))
    spread = whole.select("component", blocked.alias("spread"))
    aliases = join_unique(judged.select("node", "component"), spread, "component").withColumnRenamed("node", "_node")
    joined = join_unique(base, cut(aliases), "_node").withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("spread"), "block").otherwise("allow"))
    return joined.select(F.col("_id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "component")
