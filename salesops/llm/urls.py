"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Rules give the verdict where one fits. URLs that a rule decides are the labelled ones; the trees learn
from a bounded sample of them (the URLs of the smallest hashes) and judge all others. Features are
lengths, depth, digit ratio, entropy, parameter counts and how often the host's suffixes were blocked.
Each level of a tree is one aggregation of gradients by node, feature and bin; a tree is a CASE
expression. Gradients are summed as whole millionths, so that a model does not depend on the order of
rows. Everything is DataFrame expressions.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule fits it, and the
trees judge it by its other features. Without labelled URLs, or with labels of one kind only, the
verdict is the kind of most labels, allow if there are none. Repeated rows are judged alike. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UNIT = 1_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Boosting(NamedTuple):
    """``max_train`` bounds the labelled URLs that the trees learn from."""

    max_train: int = 20_000
    trees: int = 10
    depth: int = 3
    rate: float = 0.4
    bins: int = 16
    smoothing: float = 1.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    chosen = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    length = F.length(text)

    def share(c: Column) -> Column:
        p = (length - F.length(F.replace(text, c, F.lit("")))) / length
        return -p * F.log2(p)

    distinct = F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    total = F.aggregate(distinct, F.lit(0.0), lambda a, c: a + share(c))
    return F.when(length > 0, total).otherwise(F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    long = lambda text: F.length(text).cast("double")
    return {
        "url_chars": long(url),
        "host_chars": long(host),
        "path_chars": long(path),
        "host_labels": count(host, r"[^.]+"),
        "depth": count(path, r"[^/]+"),
        "digit_ratio": F.when(long(url) > 0, count(url, "[0-9]") / long(url)).otherwise(F.lit(0.0)),
        "host_digits": count(host, "[0-9]"),
        "hyphens": count(host, "-"),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "parameters": count(query, r"[^&]+"),
        "fragment": url.contains("#").cast("double"),
        "secure": url.startswith("https://").cast("double"),
    }


def _suffixes(host: Column) -> list[Column]:
    """The last label of the host, and the last two."""
    return [F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)]


def _binned(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    bin_ = F.lit(0)
    for cut in cuts:
        bin_ = bin_ + (value > F.lit(cut)).cast("int")
    return bin_


def _score(tree: list, node: int = 1) -> Column:
    split = tree[0].get(node)
    if split is None:
        return F.lit(tree[1].get(node, 0.0))
    name, cut = split
    return F.when(F.col(name) <= F.lit(cut), _score(tree, 2 * node)).otherwise(_score(tree, 2 * node + 1))


def _node(splits: dict, node: int = 1) -> Column:
    if node not in splits:
        return F.lit(node)
    name, cut = splits[node]
    return F.when(F.col(name) <= F.lit(cut), _node(splits, 2 * node)).otherwise(_node(splits, 2 * node + 1))


def _margin(prior: float, trees: list) -> Column:
    total = F.lit(prior)
    for tree in trees:
        total = total + _score(tree)
    return total


def boost(rows: DataFrame, names: list[str], how: Boosting = Boosting()) -> tuple[float, list]:
    """Prior and trees for column ``label`` (0 or 1) of a bounded table of labelled rows.

    A tree is (splits, leaves): node to (feature, cut), node to value. The driver sees one row per
    node, feature and bin.
    """
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n == 0:
        return -1.0, []
    if positive in (0, n):
        return (1.0 if positive else -1.0), []
    prior = math.log(positive / (n - positive))
    places = [k / how.bins for k in range(1, how.bins)]
    found = rows.agg(*[F.percentile(name, F.array(*map(F.lit, places))).alias(name) for name in names]).first()
    cuts = {name: sorted(set(found[name])) for name in names}
    binned = rows.select("label", *names, *[_binned(F.col(c), cuts[c]).alias(f"bin_{c}") for c in names])
    binned = written(binned, "url-bins")
    trees: list = []
    pairs = [F.struct(F.lit(c).alias("name"), F.col(f"bin_{c}").alias("bin")) for c in names]
    for _ in range(how.trees):
        p = 1 / (1 + F.exp(-_margin(prior, trees)))
        splits, leaves = {}, {}
        for level in range(how.depth):
            sums = _sums(binned, p, _node(splits), pairs)
            grown = _grow(sums, cuts, range(2**level, 2 ** (level + 1)), how)
            splits |= grown[0]
            leaves |= grown[1]
            if not grown[0]:
                break
        trees.append((splits, leaves))
    return prior, trees


def _sums(rows: DataFrame, p: Column, node: Column, pairs: list[Column]) -> dict:
    """Sums of gradient and curvature by node, feature and bin."""
    whole = lambda c: F.round(c * _UNIT).cast("long")
    points = rows.select(
        node.alias("node"), whole(F.col("label") - p).alias("g"), whole(p * (1 - p)).alias("h"),
        F.array(*pairs).alias("at"),
    )
    summed = points.select("node", "g", "h", F.explode("at").alias("at")).groupBy("node", "at.name", "at.bin")
    out: dict = {}
    for node, name, bin_, g, h in summed.agg(F.sum("g"), F.sum("h")).collect():
        out.setdefault(node, {}).setdefault(name, {})[bin_] = (g / _UNIT, h / _UNIT)
    return out


def _grow(sums: dict, cuts: dict, nodes: range, how: Boosting) -> tuple[dict, dict]:
    """The best split of every node of a level, and the values of the nodes it makes."""
    splits, leaves = {}, {}
    worth = lambda g, h: g * g / (h + how.smoothing)
    value = lambda g, h: how.rate * g / (h + how.smoothing)
    for node in nodes:
        best = (1e-3, None)
        for name, bins in sorted(sums.get(node, {}).items()):
            total_g, total_h = map(sum, zip(*bins.values()))
            g = h = 0.0
            for bin_ in range(len(cuts[name])):
                here = bins.get(bin_, (0.0, 0.0))
                g, h = g + here[0], h + here[1]
                rest = (total_g - g, total_h - h)
                gain = worth(g, h) + worth(*rest) - worth(total_g, total_h)
                if h >= 1e-3 and rest[1] >= 1e-3 and gain > best[0] + 1e-9:
                    best = (gain, (name, cuts[name][bin_]))
                    leaves[2 * node], leaves[2 * node + 1] = value(g, h), value(*rest)
        if best[1]:
            splits[node] = best[1]
    return splits, leaves


def judge(urls: DataFrame, rules: list[Rule], how: Boosting = Boosting(), key: str = "page_id") -> DataFrame:
    """Rows (key, host, path, rule, verdict, score): the rule's verdict, or else that of the trees."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = urls.select(F.col(key), "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    suffix = _suffixes(F.col("host"))
    rows = rows.select(
        key, "host", "path", F.xxhash64("url").alias("hash"), F.col("fit.rule").alias("rule"),
        F.col("fit.verdict").alias("ruled"), suffix[0].alias("suffix_1"), suffix[1].alias("suffix_2"),
        *[c.alias(n) for n, c in features.items()],
    )
    rows = written(rows, "url-features")
    names = list(features)
    labelled = rows.filter("ruled IS NOT NULL")
    blocked = (F.col("ruled") == "block").cast("long")
    for name in ("suffix_1", "suffix_2"):
        stats = labelled.groupBy(name).agg(F.count("*").alias("seen"), F.sum(blocked).alias("bad"))
        rate = (F.col("bad") + 1.0) / (F.col("seen") + 2.0)
        stats = written(stats.select(F.col(name).alias("of"), rate.alias(f"{name}_rate")), "url-suffixes")
        joined = rows.join(stats, F.col(name) == F.col("of"), "left").drop("of")
        rows = joined.withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(0.5)))
        names.append(f"{name}_rate")
    sample = rows.filter("ruled IS NOT NULL").orderBy("hash", key).limit(how.max_train)
    sample = written(sample.select(blocked.alias("label"), *names), "url-sample")
    prior, trees = boost(sample, names, how)
    score = _margin(prior, trees)
    method = F.when(score > 0, "block").otherwise("allow")
    return rows.select(
        key, "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), score.alias("score")
    )
