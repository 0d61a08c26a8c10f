"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule fits.

A rule `host/path` fits its host and all subdomains of it where the url's path starts with the rule's; the longest fitting
rule decides. The trees (Spark's own boosted trees) learn from labelled urls: by default those that a rule decides.
Features are lengths, depths, digit ratio, entropy of the bytes, signs, parameter counts, and suffix statistics: how often
the last label, the last two labels of the host and the file ending occur, and the smoothed share of blocked urls with them.
Those statistics count all urls in a fixed number of hash buckets; the trees are fitted on at most `sample` distinct labelled
urls, picked by a hash of the url. Judging is a map: rules are Column expressions, only undecided urls reach the features.

Defined results: a null url or one without `://` has an empty host and path; no rule fits an empty host; without any label
every undecided url is allowed, with labels of one kind only it gets that verdict; a url with both labels counts as blocked
where at least half of its rows are; repeated rows each give their row; columns of the result's names are replaced, other
columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import stored

FEATURES = [
    *("url_length", "host_length", "path_length", "query_length", "path_depth", "host_depth", "parameters"),
    *("digit_ratio", "entropy", "hyphens", "dots", "escapes", "capitals"),
    *("tld_share", "tld_blocked", "domain_share", "domain_blocked", "ending_share", "ending_blocked"),
]
#: Hash buckets of each kind of suffix: the statistics stay this small whatever the urls hold.
BUCKETS = 4096
_KINDS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) after the first `://`, and the path up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, both null where none fits; of equally long ones the first listed."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last branch put around the others is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def suffixes(host: Column, path: Column) -> Column:
    """Bucket numbers of the last label, the last two labels and the file ending."""
    found = [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)]
    return F.array(*(F.crc32(s.cast("binary")) % BUCKETS + k * BUCKETS for k, s in enumerate(found)))


@dataclass
class Model:
    share: np.ndarray
    blocked: np.ndarray
    trees: GBTClassificationModel | None
    only: str = "allow"

    def features(self, url: Column, host: Column, path: Column) -> Column:
        """The FEATURES of a url as an array; zeros for null."""
        share, blocked = self.share, self.blocked

        @F.pandas_udf("array<double>")
        def udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for urls, hosts, paths, buckets in batches:
                yield pd.Series([lexical(*row, share, blocked) for row in zip(urls, hosts, paths, buckets, strict=True)], dtype=object)

        return udf(url, host, path, suffixes(host, path))


def lexical(url, host: str, path: str, buckets, share: np.ndarray, blocked: np.ndarray) -> list[float]:
    """FEATURES of one url."""
    if url is None:
        return [0.0] * len(FEATURES)
    raw = url.encode("utf-8", "surrogatepass")
    query = url.partition("#")[0].partition("?")[2]
    n = np.array(list(Counter(raw).values()), dtype=np.float64)
    entropy = float(np.log2(len(raw)) - (n * np.log2(n)).sum() / len(raw)) if raw else 0.0
    size = max(len(raw), 1)
    digits, capitals = (len(raw) - len(raw.translate(None, drop)) for drop in (b"0123456789", _UPPER.encode()))
    shape = [len(raw), len(host), len(path), len(query), path.count("/"), host.count("."), sum(p != "" for p in query.split("&")), digits / size, entropy, url.count("-"), url.count("."), url.count("%"), capitals / size]
    return [float(x) for x in shape] + [float(x) for b in buckets for x in (share[b], blocked[b])]


def suffix_statistics(urls: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Share of all urls and smoothed share of blocked ones, by suffix bucket; urls: host, path, label (1, 0 or null)."""
    each = urls.select(F.explode(suffixes(F.col("host"), F.col("path"))).alias("bucket"), "label")
    sums = each.groupBy("bucket").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("bad"))
    table = np.zeros((_KINDS * BUCKETS, 3))
    for r in sums.collect():  # at most _KINDS x BUCKETS rows
        table[r["bucket"]] = r["n"], r["labelled"], r["bad"] or 0
    n, labelled, bad = table.T
    whole = bad[:BUCKETS].sum() / max(labelled[:BUCKETS].sum(), 1)
    return n / max(n[:BUCKETS].sum(), 1), (bad + prior * whole) / (labelled + prior)


def fit(df: DataFrame, label: Column, url_col: str = "url", sample: int = 20_000, prior: float = 20.0, trees: int = 20, depth: int = 4, seed: int = 1) -> Model:
    """Model of the urls with a label: 1 block, 0 allow, null unknown. `sample` bounds the distinct labelled urls that the trees see."""
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    urls = df.select(url.alias("url"), host.alias("host"), path.alias("path"), label.cast("int").alias("label"))
    share, blocked = suffix_statistics(urls, prior)
    labelled = urls.where("label is not null and url is not null")
    about = labelled.agg(F.approx_count_distinct("url").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if about["low"] is None or about["low"] == about["high"]:
        return Model(share, blocked, None, "block" if about["low"] == 1 else "allow")
    part = min(1.0, 2 * sample / about["n"])  # about twice the sample: the estimate may be off by some hundredths
    chosen = labelled.withColumn("h", F.xxhash64("url")).where(F.col("h") <= F.lit(min(int(-(1 << 63) + (1 << 64) * part), (1 << 63) - 1)))
    distinct = chosen.groupBy("h", "url", "host", "path").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    model = Model(share, blocked, None)
    seen = distinct.orderBy("h", "url").limit(sample).select(model.features(F.col("url"), F.col("host"), F.col("path")).alias("x"), "label")
    seen = stored(seen, "url-sample").select(array_to_vector("x").alias("features"), "label")
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(seen)
    return model


def judge(df: DataFrame, rules: list[tuple[str, str]], model: Model, url_col: str = "url") -> DataFrame:
    """All columns of df, and host, path, rule, verdict (allow or block), block_score (0 to 1; null where a rule decides)."""
    names = ["host", "path", "rule", "verdict", "block_score"]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))  # a struct: the user's names never meet ours
    host, path = host_and_path(F.col("url"))
    found = df.select(row.alias("row"), F.col(f"`{url_col}`").alias("url")).select("row", "url", host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    found = found.withColumns({"rule": rule, "action": action})
    if model.trees is None:
        score = F.lit(1.0 if model.only == "block" else 0.0)
    else:
        open_url = F.when(F.col("action").isNull(), F.coalesce("url", F.lit("")))
        found = found.withColumn("features", array_to_vector(model.features(open_url, F.col("host"), F.col("path"))))
        found = model.trees.transform(found)
        score = vector_to_array("probability")[1]
    found = found.withColumn("block_score", F.when(F.col("action").isNull(), score))
    verdict = F.coalesce("action", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    found = found.withColumn("verdict", verdict)
    return found.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c not in names), *names)


def filtered(df: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", **options) -> DataFrame:
    """judge() by a model fitted on the urls that the rules decide; options as in fit."""
    action = ruled(*host_and_path(F.col(f"`{url_col}`")), rules)[1]
    model = fit(df, F.when(action == "block", 1).when(action == "allow", 0), url_col, **options)
    return judge(df, rules, model, url_col)
