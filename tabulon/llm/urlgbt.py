"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

Rules decide what they fit. The URLs they decide are the labelled ones; from a sample of at most
`max_rows` of them (in the order of a hash: a documented bound for the fit alone) boosted trees learn to
tell block from allow by lexical features: lengths, depth, digit ratio, entropy, parameter counts, and
statistics of the host's and the path's suffixes (for a URL that a rule decides, of other URLs only). The trees judge every URL that no rule fits.

Defined results: a null URL or one without `://` has empty host and path and is judged by the trees on
those features; if the sample has no label or one label only, that label (or allow) is the verdict.
Repeated rows are each judged, null ids too; an empty table gives an empty result. Only the id and the
URL column are read. Equal rule lengths: the rule listed first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: (host, path prefix, verdict)
Rule = tuple[str, str, str]

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "fragment", "punctuation", "longest_segment", "longest_number", "secure", "host_suffix_rate", "domain_rate", "path_suffix_rate")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):  # the last that fits counts
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    counts = np.bincount(np.frombuffer(s.encode(), np.uint8))
    counts = counts[counts > 0] / counts.sum()
    return float(-(counts * np.log2(counts)).sum())


KINDS = ("host_suffix", "domain", "path_suffix")


def suffixes_of(host: Column, path: Column) -> tuple[Column, Column, Column]:
    """Top label, last two labels, and the path's extension (or its last character's kind)."""
    name, last = F.regexp_replace(host, ":[^:]*$", ""), F.substring_index(path, "/", -1)
    tail = F.when(F.contains(last, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(last, ".", -1)))).when(path.endswith("/"), "/").when(path.rlike("[0-9]$"), "digit").otherwise("other")
    return F.substring_index(name, ".", -1), F.substring_index(name, ".", -2), tail


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    segments = [x for x in path.split("/") if x]
    number = best = 0
    for c in path:
        number = number + 1 if c.isdigit() else 0
        best = max(best, number)
    share = lambda s: sum(c.isdigit() for c in s) / max(1, len(s))
    return [
        len(url), len(host), len(path), len(segments), host.count(".") + bool(host), share(url), share(host), _entropy(url), _entropy(host),
        len(query.split("&")) if query else 0, len(query), "#" in url, sum(url.count(c) for c in "-_.~%=&"), max(map(len, segments), default=0), best, url.startswith("https"),
    ]


def with_rates(known: DataFrame, smooth: float = 20, few: int = 100_000, folds: int = 5) -> DataFrame:
    """Adds host_suffix_rate, domain_rate, path_suffix_rate: smoothed shares of blocked URLs among those that a rule decides, by suffix.

    All rows are counted, in one aggregate. A URL that a rule decides has the rate of the other `folds` - 1 parts
    of the URLs (dealt by a hash), so its own label and its copies' are not in it. A suffix without such URLs has
    the mean (0.5 if no URL is ruled). Up to `few` suffixes of a kind are broadcast, after a count; more are joined by a shuffle.
    """
    df = known.withColumns(dict(zip(KINDS, suffixes_of(F.col("host"), F.col("path")), strict=True)) | {"fold": F.pmod(F.xxhash64("url"), F.lit(folds))})
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in KINDS), F.struct(F.lit("all").alias("kind"), F.lit("").alias("suffix")))
    ruled = df.where("ruled is not null").select("ruled", "fold", F.explode(kinds).alias("k"))
    parts = written(ruled.groupBy("k.kind", "k.suffix", "fold").agg(F.count_if(F.col("ruled") == "block").alias("b"), F.count("ruled").alias("n")), "url-rates")
    n, blocked = parts.where("kind = 'all'").agg(F.sum("n"), F.sum("b")).first()
    mean = blocked / n if n else 0.5
    own = lambda c: F.coalesce(F.try_element_at("parts", F.when(F.col("ruled").isNotNull(), F.col("fold")))[c], F.lit(0))
    for kind in KINDS:
        by = parts.where(F.col("kind") == kind).groupBy(F.col("suffix").alias(kind)).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("b", "n")))).alias("parts"))  # a row for each part
        rate = (F.col("b") - own("b") + smooth * mean) / (F.col("n") - own("n") + smooth)
        df = df.join(small(by, few), kind, "left").withColumn(f"{kind}_rate", F.coalesce(rate, F.lit(mean))).drop("b", "n", "parts")
    return df.select(*known.columns, *(f"{kind}_rate" for kind in KINDS))


@dataclass
class Trees:
    """Boosted trees for log-loss; each tree is arrays (feature, threshold, left, right, value)."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20, ridge: float = 1.0) -> Trees:
    """Newton boosting over histograms of quantile bins."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(math.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-score))
        g, h = s - y, s * (1 - s)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, 0, 0, -rate * total_g / (total_h + ridge)])
            if level == 0 or len(rows) < 2 * least:
                return at
            best = (1e-6, -1, 0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                lg, lh = (np.cumsum(np.bincount(b, w[rows], len(e) + 1))[:-1] for w in (g, h))
                gain = lg**2 / (lh + ridge) + (total_g - lg) ** 2 / (total_h - lh + ridge) - total_g**2 / (total_h + ridge)
                gain[(n < least) | (len(rows) - n < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                return at
            _, f, k = best
            left = binned[rows, f] <= k
            nodes[at][:2] = [f, float(edges[f][k])]
            nodes[at][2] = grow(rows[left], level - 1)
            nodes[at][3] = grow(rows[~left], level - 1)
            return at

        grow(np.arange(len(y)), depth)
        t = np.array(nodes)
        tree = (t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4])
        model.trees.append(tree)
        score = score + Trees(0.0, [tree]).raw(x)
    return model


#: (url, host, path, host_suffix_rate, domain_rate, path_suffix_rate)
Known = tuple[str | None, str, str, float, float, float]


def features(rows: list[Known]) -> np.ndarray:
    return np.array([lexical(*r[:3]) + list(r[3:]) for r in rows], float).reshape(-1, len(FEATURES))


def block_probability(model: Trees, rows: list[Known]) -> np.ndarray:
    return 1 / (1 + np.exp(-model.raw(features(rows)))) if rows else np.zeros(0)


def fit(rows: list[Known], y: np.ndarray) -> Trees:
    if not len(y) or y.min() == y.max():
        return Trees(6.0 if len(y) and y[0] else -6.0)
    return boost(features(rows), y)


def labelled(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and the rule's verdict."""
    df = pages.withColumn("host", F.coalesce(host_of(F.col(url)), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col(url)), F.lit("")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return df.withColumn("rule", name).withColumn("ruled", verdict)


_READ = ("url", "host", "path", *(f"{kind}_rate" for kind in KINDS))


def train(known: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on at most `max_rows` distinct URLs of (url, host, path, ruled, rates)."""
    sample = known.where("ruled is not null").select(*_READ, "ruled").distinct().orderBy(F.xxhash64("url"), "url").limit(max_rows).collect()
    return fit([tuple(r)[:6] for r in sample], np.array([r[6] == "block" for r in sample], float))


def _judge(batches: Iterator[pa.RecordBatch], model: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ruled = batch.column("ruled").to_pylist()
        read = list(zip(*(batch.column(c).to_pylist() for c in _READ), strict=True))
        todo = [i for i, v in enumerate(ruled) if v is None]
        prob: list[float | None] = [None] * len(ruled)
        for i, x in zip(todo, block_probability(model, [read[i] for i in todo]).tolist(), strict=True):
            prob[i] = x
            ruled[i] = "block" if x >= 0.5 else "allow"
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(ruled, pa.string()), pa.array(prob, pa.float64())], names=[batch.schema.names[0], "host", "path", "rule", "verdict", "block_score"])


def judge_urls(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, block_score (null where a rule decides)."""
    known = with_rates(labelled(pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url")), rules))
    model = train(known)
    kind = pages.schema[id_column].dataType.simpleString()
    judged = known.mapInArrow(lambda it: _judge(it, model), f"page_id {kind}, host string, path string, rule string, verdict string, block_score double")
    return judged.withColumnRenamed("page_id", id_column)
