"""Quality classification with site-level shrinkage (hierarchical empirical Bayes).

A logistic classifier over text statistics gives each document's own evidence. Hosts' shares of good documents get a beta prior
whose mean and strength come from all hosts; paths (here: the language section of a host) get their host's posterior as prior.
A document's score adds to its evidence the log odds of its path against the global share, with its own evidence left out.

Null and empty texts have the statistics of an empty text. A null host or path is a site of its own. Repeated rows are rows.
Without labels every document scores 0.5 and is kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table
from tidemark.llm.toxicity import fit_logistic

SAMPLE = 20_000  #: most labelled rows used for fitting, the smallest by hash of doc_id
STEP = 0.5  #: weight of the site's log odds
SITES = 50_000  #: most path sites that are broadcast; beyond that Spark picks the join


def statistics(text: Column) -> list[Column]:
    """Text statistics, each from 0 to about 1."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.split(t, r"\s+")
    lines = F.split(t, "\n")
    share = lambda chars, most: F.least(F.regexp_count(t, F.lit(chars)) / n * most, F.lit(1.0))
    return [
        share("[A-Z]", 2), share(r"[#&$%*|<>{}\[\]=_~^\\/]", 5), share(r"[0-9]", 5), share(r"[!?]", 5), share("[.,]", 10),
        F.size(F.array_distinct(words)) / F.size(words),
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.least(n / F.size(words) / 20.0, F.lit(1.0)),
        F.least(F.log1p(F.size(words).cast("double")) / 10.0, F.lit(1.0)),
        # words equal to the one before
        F.regexp_count(t, F.lit(r"(?<!\S)(\S+) \1(?!\S)")) / F.size(words),
        F.when(F.size(words) < 20, 1.0).otherwise(0.0),
        F.when(F.size(F.array_distinct(words)) / F.size(words) < 0.3, 1.0).otherwise(0.0),
    ]


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[float], float]:
    """(weights, log odds of good among the rows fitted). Weights are empty without labels of both kinds."""
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = found.select("y", F.array(*statistics(F.col("text"))).alias("x")).collect()  # at most `limit` short rows
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return [], 0.0
    return [float(w) for w in fit_logistic(np.array([r["x"] for r in rows]), y, ridge=0.01)], float(np.log(y.mean() / (1 - y.mean())))


def evidence(docs: DataFrame, fitted: tuple[list[float], float]) -> DataFrame:
    """Adds p: the document classifier's probability of good."""
    w, _ = fitted
    if not w:
        return docs.withColumn("p", F.lit(0.5))
    z = sum((F.lit(a) * x for a, x in zip(w, statistics(F.col("text")), strict=False)), F.lit(w[-1]))
    return docs.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))


def site_priors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """(host, path, n, good, prior, strength) of each path; the global share; hosts' strength. Two grouped aggregations."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    def strength(sites: DataFrame, n: str, good: str) -> tuple[float, float]:
        """Mean and prior strength by moments of the sites' shares."""
        r = sites.agg(F.sum(good) / F.sum(n), F.var_samp(F.col(good) / F.col(n)), F.avg(1 / F.col(n))).first()
        mean, spread, inverse = r[0] if r[0] is not None else 0.5, r[1] or 0.0, r[2] or 1.0
        noise = mean * (1 - mean) * inverse
        return mean, min(1e4, max(2.0, mean * (1 - mean) / max(spread - noise, 1e-6) - 1))

    mean, k_host = strength(hosts, "host_n", "host_good")
    _, k_path = strength(paths, "n", "good")
    host_post = (F.lit(k_host * mean) + F.col("host_good")) / (k_host + F.col("host_n"))
    same = F.col("host").eqNullSafe(F.col("h"))
    out = paths.join(hosts.withColumnRenamed("host", "h"), same).select("host", "path", "n", "good", host_post.alias("host_posterior"))
    return out, mean, k_path


def classify(docs: DataFrame, fitted: tuple[list[float], float], keys: list[str] | None = None) -> DataFrame:
    """(doc_id, host, path, p, host_posterior, path_posterior, score, keep) of each row of docs (doc_id, text, host, path). keys:
    further columns that stay."""
    keys = ["doc_id", *(keys or [])]
    scored = materialize(evidence(docs.select(*keys, "text", "host", "path"), fitted).drop("text"))
    sites, mean, k = site_priors(scored)
    sites = materialize(sites.withColumnsRenamed({"host": "h", "path": "q"}))
    small = sites.limit(SITES + 1).count() <= SITES
    key = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q"))
    both = scored.join(F.broadcast(sites) if small else sites, key)
    post = (k * F.col("host_posterior") + F.col("good") - F.col("p")) / (k + F.col("n") - 1)
    post = F.least(F.greatest(post, F.lit(1e-4)), F.lit(1 - 1e-4))
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    p = F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    z = F.log(p / (1 - p)) + STEP * (F.log(post / (1 - post)) - math.log(mean / (1 - mean)))
    out = both.select(*keys, "host", "path", "p", "host_posterior", post.alias("path_posterior"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("keep", F.col("score") >= 0.5)


def of_documents(docs: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The source is the host; documents have no URL, so the language section of the source is the path."""
    sited = docs.select("doc_id", *(keys or []), "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return classify(sited, fit(docs, labels), keys)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
