"""Quality classifier by hierarchical empirical Bayes: what a document shows, with what its path and host are like.

A logistic classifier on text statistics, trained from labels, gives each document the likelihood ratio of good against
bad (its odds over the labels' odds). Summed evidence then gives each host a posterior share of good documents, shrunk
towards the whole table's share, and each path within a host one shrunk towards its host's: (expected good documents +
strength * parent's share) / (documents + strength). The strength is the beta prior's that moments of the shares across
sites suggest (large if sites are alike, small if they differ), so sparse sites stay near their parent. A document's
score is its likelihood ratio times its path's odds, where the path's counts leave the document itself out.

Without URLs, the source is the host and the language within it the path. The classifier is fitted on at most about
``ROWS`` labelled ids, chosen by hash (an id with several labels is good if one of them says so); all counts and posteriors
cover every document. Evidence is held within ``CLIP`` (a likelihood ratio of about 3,000 either way), so that one statistic
far outside the sample cannot outweigh a whole site; the strength of a site's prior lies within ``STRENGTH`` documents.

A null text counts as empty; null hosts or paths are sites of their own; without labels of both kinds the ratio
is 1 everywhere. Rows that repeat count each. Very long texts are measured whole; a score equal to the limit is kept; only
the named columns are read, so others cannot clash. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hash_sample, let, small_side, text_of, written

ROWS, STEPS, RIDGE, CLIP = 20_000, 40, 1.0, 8.0
STRENGTH = (2.0, 10_000.0)


def _share(part: Column, whole: Column) -> Column:
    return F.sqrt(part / F.greatest(whole, F.lit(1)))


def features(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; roots and logs, so that a logistic curve fits them."""
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    n = F.char_length(text)
    lines = F.split(text, "\n", -1)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), F.lit(0))
    of_words = let(words, lambda w: F.struct(
        F.log1p(F.size(w)).alias("length"), _share((F.size(w) - F.size(F.array_distinct(w))).cast("double"), F.size(w)).alias("repeat"),
        _share(F.size(F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))).cast("double"), F.size(w)).alias("twin")))
    return {
        "words": of_words, "symbol": _share(left(r"[^#*$%&|<>]+").cast("double"), n), "upper": _share(left(r"[^\p{Lu}]+").cast("double"), n),
        "digit": _share(left(r"[^0-9]+").cast("double"), n), "mark": _share(left(r"[^!?]+").cast("double"), n),
        "line": let(lines, lambda x: _share((F.size(x) - F.size(F.array_distinct(x))).cast("double"), F.size(x)))}


NAMES = ("length", "repeat", "twin", "symbol", "upper", "digit", "mark", "line")


def measured(docs: DataFrame, key: str, text: str, host: str, path: str) -> DataFrame:
    """(key, ``host``, ``path``, the features): one pass over the texts."""
    clean = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    doc = docs.select(F.col(key).alias("__key"), clean(host).alias("__host"), F.concat_ws("/", clean(host), clean(path)).alias("__path"), text_of(text).alias("__t"))
    f = features(F.col("__t"))
    out = doc.select("__key", "__host", "__path", *[v.alias(k) for k, v in f.items()])
    return out.select("__key", "__host", "__path", *[F.col(f"words.{n}" if n in ("length", "repeat", "twin") else n).cast("double").alias(n) for n in NAMES])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: weights (the last is the constant), and the scaling used."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    ridge = np.diag([RIDGE] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def evidence(rows: DataFrame, labels: DataFrame, key: str, label: str, sample_rows: int = ROWS) -> Column:
    """Log-likelihood ratio of good against bad, as an expression over the features."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).where("__key is not null and __y in (0, 1)")
    known = written(known.groupBy("__key").agg(F.max("__y").alias("__y")), "labels")
    known = hash_sample(known, "__key", sample_rows, known.count(), 17)  # about ``sample_rows`` different keys
    sample = rows.join(F.broadcast(known), "__key").select("__y", *NAMES).limit(2 * sample_rows).toPandas()
    y = sample["__y"].to_numpy(dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return F.lit(0.0)
    w, mean, scale = fit(sample[list(NAMES)].to_numpy(dtype=np.float64), y)
    prior = math.log(y.mean() / (1 - y.mean()))
    terms = [(F.col(n) - float(m)) / float(s) * float(v) for n, m, s, v in zip(NAMES, mean, scale, w)]
    total = sum(terms[1:], terms[0]) + F.lit(float(w[-1]) - prior)
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), total))


def _strength(sites: DataFrame) -> float:
    """Strength of the beta prior whose shares vary as the sites' do: from the mean and the variance of shares between
    sites, less what sampling alone gives."""
    r = sites.where("n >= 2").agg(F.avg("share").alias("m"), F.var_pop("share").alias("v"), F.avg(F.lit(1.0) / F.col("n")).alias("noise")).first()
    if r["m"] is None:
        return STRENGTH[0]
    base = r["m"] * (1 - r["m"])
    between = r["v"] - base * r["noise"]
    return min(STRENGTH[1], max(STRENGTH[0], base / between - 1 if between > 0 else STRENGTH[1]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
             label: str = "quality", keep: float = 0.5) -> DataFrame:
    """(key, evidence, host_share, path_share, score, kept) for every row."""
    rows = written(measured(docs, key, text, host, path), "features")
    rows = written(rows.withColumn("evidence", evidence(rows, labels, key, label)).drop(*NAMES), "evidence")
    prior = labels.select(F.col(label).cast("double").alias("y")).where("y in (0, 1)").agg(F.avg("y")).first()[0]
    prior = min(0.99, max(0.01, prior if prior is not None else 0.5))
    odds = math.log(prior / (1 - prior))
    good = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") + odds)))
    rows = rows.withColumn("good", good)
    paths = written(rows.groupBy("__host", "__path").agg(F.sum("good").alias("good"), F.count("*").alias("n")), "paths")
    hosts = written(paths.groupBy("__host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("share", F.col("good") / F.col("n")), "hosts")
    whole = hosts.agg(F.sum("good"), F.sum("n")).first()
    overall = whole[0] / whole[1] if whole[1] else 0.5
    at_host, at_path = _strength(hosts), _strength(paths.withColumn("share", F.col("good") / F.col("n")))
    hosts = hosts.withColumn("host_share", (F.col("good") + F.lit(at_host * overall)) / (F.col("n") + at_host)).select("__host", "host_share")
    sites = written(paths.join(hosts, "__host").select("__path", F.col("good").alias("path_good"), F.col("n").alias("path_n"), "host_share"), "sites")
    out = rows.join(small_side(sites, sites.count(), 512), "__path")
    share = lambda less, n: (F.col("path_good") - less + F.lit(at_path) * F.col("host_share")) / (F.col("path_n") - n + F.lit(at_path))
    others = F.greatest(F.lit(0.001), F.least(F.lit(0.999), share(F.col("good"), F.lit(1))))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") + F.ln(others / (F.lit(1.0) - others)))))
    return out.select(F.col("__key").alias(key), "evidence", "host_share", share(F.lit(0.0), F.lit(0)).alias("path_share"), score.alias("score")).withColumn("kept", F.col("score") >= keep)
