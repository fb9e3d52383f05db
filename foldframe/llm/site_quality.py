"""Document quality by hierarchical empirical Bayes: a document classifier's evidence with host- and path-level posteriors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.llm.work import Work

#: Labelled rows the document classifier is fitted on, at most: those with the smallest hash of id.
TRAINING_ROWS = 20_000
#: How many documents a site's prior is worth at least and at most.
STRENGTHS = (1.0, 10_000.0)
FEATURES = ("chars", "word_chars", "upper", "digits", "marks", "odd_marks", "stop_marks", "distinct", "top_repeat", "lines", "long_words", "short_words")


def quality_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, features of the whole text) with built-in functions only; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    of = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), words.alias("w"), *[x.alias(a) for x, a in (
        (F.log1p(F.length(text)), "chars"), (of(r"\p{Lu}+"), "upper"), (of(r"\p{Nd}+"), "digits"), (of(r"[^\p{L}\p{Nd}\s]+"), "marks"), (of(r"[#$%&*+|!<>=~^_\\{}@]+"), "odd_marks"), (of(r"[.,;:?]+"), "stop_marks"), (of(r"\n+"), "lines"))])
    count = F.greatest(F.size("w"), F.lit(1)).cast("double")
    same = F.size(F.filter(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))
    share = lambda keep: F.size(F.filter("w", keep)) / count
    return base.select("id", *[c.cast("double").alias(a) for c, a in (
        (F.col("chars"), "chars"), (F.length("text") / count, "word_chars"), (F.col("upper"), "upper"), (F.col("digits"), "digits"), (F.col("marks"), "marks"), (F.col("odd_marks"), "odd_marks"), (F.col("stop_marks"), "stop_marks"),
        (F.size(F.array_distinct("w")) / count, "distinct"), (same / count, "top_repeat"), (F.col("lines"), "lines"), (share(lambda w: F.length(w) > 12), "long_words"), (share(lambda w: F.length(w) < 3), "short_words"))])


class Classifier:
    """Ridge logistic regression on standardised features and their squares; ``evidence`` is the log Bayes factor for good."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.concatenate((np.ones((len(z), 1)), z, z * z), 1)
        w = np.zeros(z.shape[1])
        keep = np.eye(len(w)) * ridge
        keep[0, 0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + keep
            w = w + np.linalg.solve(h, z.T @ (y - p) - keep @ w)
        self.weights, self.prior = w, float(np.clip(y.mean(), 1e-3, 1 - 1e-3))

    def evidence(self) -> Column:
        """Log odds of the features less the log odds of the training rows, as a column expression."""
        k = len(FEATURES)
        total = F.lit(float(self.weights[0]) - math.log(self.prior / (1 - self.prior)))
        for i, name in enumerate(FEATURES):
            z = F.least(F.lit(8.0), F.greatest(F.lit(-8.0), (F.col(name) - float(self.mean[i])) / float(self.scale[i])))
            total = total + z * float(self.weights[1 + i]) + z * z * float(self.weights[1 + k + i])
        return total


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Classifier | None:
    """Fit on at most ``rows`` labelled documents; None where the labels have one class only or meet no document."""
    some = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).where("label_id is not null and y in (0, 1)").orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    some = F.broadcast(some)  # at most ``rows`` rows of two numbers
    texts = docs.select(id_col, text_col).join(some, F.col(id_col) == F.col("label_id"), "left_semi")
    got = quality_features(texts, id_col, text_col).join(some, F.col("id") == F.col("label_id")).select(*FEATURES, "y").collect()
    data = np.array([tuple(r) for r in got], float).reshape(-1, len(FEATURES) + 1)
    if len(set(data[:, -1])) < 2:
        return None
    return Classifier(data[:, :-1], data[:, -1])


def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def strength(rows: DataFrame, group: str, parent: str, bounds: tuple[float, float] = STRENGTHS) -> float:
    """Prior rows a group is worth (the sum of the Beta prior's parameters), by moments of the groups' means about their parents'.

    Large where groups differ no more than chance lets them, small where they differ by themselves; kept within ``bounds``, of which
    the upper one also stands for groups without any spread of their own and the lower one for no rows.
    """
    g = rows.select("n", (F.col(group) / F.col("n")).alias("m"), F.col(parent).alias("q"))
    v = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("q"), 2)).alias("ss"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("q") * (1 - F.col("q"))).alias("noise")).first()
    if not v.n or not v.k:
        return bounds[0]
    spread = v.noise / v.n  # variance of one document
    between = (v.ss - v.k * spread) / v.n
    return float(min(bounds[1], max(bounds[0], spread / between - 1))) if between > 0 else bounds[1]


def site_posteriors(scored: DataFrame, bounds: tuple[float, float] = STRENGTHS) -> DataFrame:
    """scored(id, host, path, evidence, p) to one row each with host and path posteriors and the document's own.

    Means add up from documents to paths to hosts before the shuffle. A path's prior is its host's posterior mean, a host's prior
    the global mean, each worth as many documents as ``strength`` says; a document is left out of its own path's mean. So a site
    with few documents is drawn to what lies above it, and one with many speaks for itself.
    """
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))
    paths = Work(scored.sparkSession, "sites").keep(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = float(total.s / total.n) if total.n else 0.5
    k_host = strength(hosts.select(F.col("host_n").alias("n"), "host_s", F.lit(mean).alias("mean")), "host_s", "mean", bounds)
    hosts = hosts.withColumn("host_mean", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host))
    named = hosts.withColumnRenamed("host", "h_host")
    joined = paths.join(named, F.col("host").eqNullSafe(F.col("h_host"))).select("host", "path", "n", "s", "host_mean", "host_n")
    k_path = strength(joined, "s", "host_mean", bounds)
    site = joined.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "s", "host_mean", "host_n")
    rows = scored.join(site, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    path_mean = (F.col("s") - F.col("p") + k_path * F.col("host_mean")) / (F.col("n") - 1 + k_path)
    post = logit(F.col("path_mean")) + F.col("evidence")
    return rows.withColumn("path_mean", path_mean).withColumn("quality", 1 / (1 + F.exp(-post))).select("id", "host", "path", "evidence", F.col("n").alias("path_docs"), F.col("host_n").alias("host_docs"), "host_mean", "path_mean", "quality")


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", threshold: float = 0.5, bounds: tuple[float, float] = STRENGTHS) -> DataFrame:
    """One row per document: id, evidence, host_docs, path_docs, host_mean, path_mean, quality (probability of good), keep.

    ``host`` and ``path`` are columns of ``docs`` (default ``source`` and ``lang``); null ones form a site of their own. Null texts count as
    empty. Without usable labels the evidence is 0 and every document has the prior one half. Repeated rows count each. ``bounds`` limits
    how many documents a prior is worth (see ``strength``).
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = train(docs, labels, id_col, text_col, label_col)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path")).alias("key"), F.col(text_col).alias("text"))
    evidence = F.lit(0.0) if model is None else model.evidence()
    prior = 0.5 if model is None else model.prior
    scored = quality_features(keyed, "key", "text").select("id.*", evidence.alias("evidence")).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + math.log(prior / (1 - prior))))))
    scored = Work(docs.sparkSession, "quality").keep(scored, "scored")
    out = site_posteriors(scored, bounds)
    return out.select(F.col("id").alias(id_col), "evidence", "host_docs", "path_docs", "host_mean", "path_mean", "quality", (F.col("quality") >= threshold).alias("keep"))
