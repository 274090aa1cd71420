"""URL filter: allow and block entries in a trie of reversed host labels and path segments; the longest match decides.

An entry is (host, path, action). It fits its host and every subdomain of it, if the url's path starts with the
entry's. Of the entries that fit, the one with most host labels wins, then the one with the longest path; between two
actions for the same entry, block wins. The trie is broadcast in shards of at most `shard_bytes` (pickled); a longer list
takes one pass over the urls for each shard, so that nothing beyond that bound is ever broadcast, and each pass keeps
the better of its match and the match so far.

Defined cases: a null url or one without '://' has an empty host and path, fits no entry and gets the default verdict.
Repeated rows get the same verdict each. An empty table gives an empty table. Only page_id and url are read, so other
columns can't clash.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 32_000_000
Entry = tuple[str, str, str]


def segments(path: str) -> list[str]:
    """The path in pieces, each with the slash that ends it; the last piece may have none."""
    return re.findall(r"[^/]*/|[^/]+", path)


class Trie:
    """Nodes are dicts; under HOST they lead on to the path part, under END lies an entry, under PART entries that end within a segment."""

    END, PATH, PART = 0, 1, 2

    def __init__(self, entries: list[Entry]):
        self.root: dict = {}
        for host, path, action in entries:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATH, {})
            parts = segments(path)
            whole = parts if not parts or parts[-1].endswith("/") else parts[:-1]
            for x in whole:
                node = node.setdefault(x, {})
            found = (host.count(".") + 1, len(path), action == "block", f"{host}{path}", action)
            if len(whole) < len(parts):
                node.setdefault(self.PART, {})[parts[-1]] = max(found, node.get(self.PART, {}).get(parts[-1], found))
            else:
                node[self.END] = max(found, node.get(self.END, found))

    def longest(self, host: str, path: str) -> tuple | None:
        best, node = None, self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            if self.PATH in node:
                best = self._along(node[self.PATH], path) or best  # more labels beat any path
        return best

    def _along(self, node: dict, path: str) -> tuple | None:
        best = node.get(self.END)
        for x in [*segments(path), ""]:
            for part, found in node.get(self.PART, {}).items():
                if x.startswith(part) and (best is None or found > best):
                    best = found
            node = node.get(x)
            if node is None:
                break
            best = node.get(self.END, best)
        return best


def shards(entries: list[Entry], shard_bytes: int = SHARD_BYTES) -> list[list[Entry]]:
    """The entries in lists whose tries stay within the bound when pickled, halved until they do."""
    if len(entries) < 2 or len(pickle.dumps(Trie(entries))) <= shard_bytes:
        return [entries]
    half = len(entries) // 2
    return shards(entries[:half], shard_bytes) + shards(entries[half:], shard_bytes)


def filter_urls(pages: DataFrame, entries: list[Entry], default: str = "allow", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages` (page_id, url)."""
    after = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    rest = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    got = pages.select("page_id", F.coalesce(F.translate(after, upper, lower), F.lit("")).alias("host"), F.coalesce(rest, F.lit("")).alias("path"))
    got = got.withColumns({"labels": F.lit(0), "length": F.lit(0), "block": F.lit(False), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    for part in shards(entries, shard_bytes):
        trie = pages.sparkSession.sparkContext.broadcast(Trie(part))

        def judged(frames: Iterator[pd.DataFrame], trie=trie) -> Iterator[pd.DataFrame]:
            for df in frames:
                best = [trie.value.longest(h, p) for h, p in zip(df["host"], df["path"], strict=True)]
                so_far = zip(df["labels"], df["length"], df["block"], df["rule"], df["verdict"], strict=True)
                rows = [x if x and x[:3] > y[:3] else tuple(y) for x, y in zip(best, so_far, strict=True)]
                yield pd.concat([df[["page_id", "host", "path"]], pd.DataFrame(rows, columns=["labels", "length", "block", "rule", "verdict"], index=df.index)], axis=1)

        got = got.mapInPandas(judged, got.schema)
    return got.select("page_id", "host", "path", "rule", "verdict")
