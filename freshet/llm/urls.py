"""Operator 7: URL filter by rules and gradient-boosted trees on lexical features.

Rules judge what they fit.  The URLs they judge are the labelled rows from which the trees
are trained: a bounded sample of them (``training_rows`` distinct ones, by the order of a
hash), collected to the driver.  The trees judge every other URL.

Contract
--------
Null URLs and those without ``://`` have an empty host and path; no rule fits
them.  Without training rows, or with one verdict only, the model gives that
verdict, or allow.  Repeated rows are judged alike; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, pages


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, value(rule)) if out is None else out.when(fits, value(rule))
    return F.lit(None).cast("string") if out is None else out


class Lexical:
    """Lexical features; suffix statistics are smoothed shares of blocked URLs."""

    NAMES = ("length", "host_length", "depth", "labels", "digit_ratio", "digits_in_path", "entropy", "parameters", "fragment", "hyphens", "suffix_1", "suffix_2", "first_folder", "first_digit")

    def __init__(self, smoothing: float = 10.0):
        self.smoothing = smoothing
        self.shares: list[dict[str, float]] = [{}, {}, {}]
        self.prior = 0.5

    @staticmethod
    def keys(host: str, path: str) -> tuple[str, str, str]:
        labels = host.split(".")
        return labels[-1], ".".join(labels[-2:]), path.split("/")[1] if path.count("/") > 1 else ""

    @staticmethod
    def first_digit(path: str) -> int:
        """The digit that the last folder or name begins with, else -1."""
        last = path.rstrip("/").rpartition("/")[2]
        return int(last[0]) if last[:1] in tuple("0123456789") else -1

    def fit(self, urls: list[tuple[str, str, str]], y: np.ndarray) -> "Lexical":
        self.prior = float(y.mean()) if len(y) else 0.5
        for i in range(3):
            total: dict[str, list[float]] = {}
            for (_, host, path), v in zip(urls, y):
                t = total.setdefault(self.keys(host, path)[i], [0.0, 0.0])
                t[0] += v
                t[1] += 1
            self.shares[i] = {k: (a + self.smoothing * self.prior) / (n + self.smoothing) for k, (a, n) in total.items()}
        return self

    def row(self, url: str, host: str, path: str) -> list[float]:
        n = max(1, len(url))
        digits = sum(c.isdigit() for c in url)
        counts = np.array([url.count(c) for c in set(url)] or [1]) / n
        query = url.partition("?")[2].partition("#")[0]
        return [
            len(url), len(host), path.count("/"), host.count(".") + 1, digits / n, sum(c.isdigit() for c in path),
            float(-(counts * np.log2(counts)).sum()), query.count("=") or bool(query), "#" in url, url.count("-"),
            *[s.get(k, self.prior) for s, k in zip(self.shares, self.keys(host, path))],
            self.first_digit(path),
        ]

    def matrix(self, urls: list[tuple[str, str, str]]) -> np.ndarray:
        return np.array([self.row(*u) for u in urls], dtype=float).reshape(len(urls), len(self.NAMES))


class BoostedTrees:
    """Gradient boosting of small regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, penalty: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, step = self._grow(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            f += self.rate * step
        return self

    def _grow(self, binned, cuts, g, h):
        """A full binary tree as a heap of (feature, cut, value); feature -1 marks a leaf."""
        tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        node = np.zeros(len(g), dtype=np.int64)
        step = np.zeros(len(g))
        for k in range(len(tree)):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if k < 2**self.depth - 1:
                for j, q in enumerate(cuts):
                    if not len(q):
                        continue
                    b = binned[rows, j]
                    gl, hl, n = (np.cumsum(np.bincount(b, w, len(q) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + self.penalty) + (sum_g - gl) ** 2 / (sum_h - hl + self.penalty) - sum_g**2 / (sum_h + self.penalty)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), j, at)
            if best[1] < 0:
                value = float(-sum_g / (sum_h + self.penalty))
                tree[k] = (-1, 0.0, value)
                step[rows] = value
            else:
                _, j, at = best
                tree[k] = (j, float(cuts[j][at]), 0.0)
                node[rows] = np.where(binned[rows, j] <= at, 2 * k + 1, 2 * k + 2)
        return tree, step

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            feature, cut, value = (np.array(c) for c in zip(*tree))
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = feature[node]
                inner = j >= 0
                go = x[np.arange(len(x)), np.maximum(j, 0)] <= cut[node]
                node = np.where(inner, np.where(go, 2 * node + 1, 2 * node + 2), node)
            f += self.rate * value[node]
        return 1 / (1 + np.exp(-f))


def train(labelled: DataFrame, training_rows: int = 20_000) -> tuple[Lexical, BoostedTrees]:
    """Fit on at most ``training_rows`` distinct rows of ``(url, host, path, blocked)``, those first in the order of a hash.

    The hash is cut off before anything is dealt or collected, so the driver gets about a
    quarter more than ``training_rows`` whatever the input, and a URL counts once.
    """
    parts = 1 << 40
    n = labelled.agg(F.approx_count_distinct("url")).first()[0]
    drawn = labelled.withColumn("drawn", F.pmod(F.xxhash64("url"), F.lit(parts))).where(F.col("drawn") < min(parts, int(parts * 1.25 * training_rows / max(1, n))))
    sample = sorted(drawn.distinct().collect(), key=lambda r: (r.drawn, r.url))[:training_rows]
    urls = [(r.url, r.host, r.path) for r in sample]
    y = np.array([float(r.blocked) for r in sample])
    lexical = Lexical().fit(urls, y)
    return lexical, BoostedTrees().fit(lexical.matrix(urls), y)


def judge_urls(df: DataFrame, rules: tuple[Rule, ...] = RULES, training_rows: int = 20_000, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(<id>, host, path, rule, verdict, block_probability)``; the last is null where a rule judged."""
    host, path = split_url(F.col("url"))
    rows = only(df, key=id_column, url=url_column).select("key", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.name)), "by_rule": rule_column(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.verdict))})
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    lexical, trees = train(rows.where("rule IS NOT NULL").select("url", "host", "path", (F.col("by_rule") == "block").alias("blocked")), training_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_rule = batch.column("by_rule").to_pylist()
            urls = list(zip(*[batch.column(c).to_pylist() for c in ("url", "host", "path")]))
            open_ = [i for i, v in enumerate(by_rule) if v is None]
            p = trees.probability(lexical.matrix([urls[i] for i in open_])).tolist() if open_ else []
            probability: list[float | None] = [None] * len(urls)
            for i, v in zip(open_, p):
                probability[i], by_rule[i] = v, "block" if v >= 0.5 else "allow"
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key", "host", "path", "rule")], pa.array(by_rule, pa.string()), pa.array(probability, pa.float64())],
                ["key", "host", "path", "rule", "verdict", "block_probability"],
            )

    schema = f"key {rows.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string, block_probability double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", id_column)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(pages(spark, sf_dir))
