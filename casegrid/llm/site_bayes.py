"""Quality from a document classifier and the site it stands on: hierarchical empirical Bayes.

A logistic model over rule statistics, fitted on all labelled rows, gives each document the
probability that it is good. Sites are a hierarchy of host and path. Grouped sums give each host the posterior mean of
a Beta prior whose mean and strength are estimated over all hosts by the method of moments; each path is shrunk in the
same way toward its host. A document's own evidence is left out of its site's sums, and its posterior adds the site's
log-odds against the global mean to its own. So a sparse site says little, a large one speaks by its other documents.

Up to ``sample_rows`` labelled rows are held on the driver; more stay where they are and only sums and counts leave them.
The threshold is calibrated on all labelled rows: in log-odds it lies half way between its good rows (but the share
``max_false_share``) and the bad ones below them. Without both labels nothing is rejected.

Null or empty text: statistics of 0. Null host or path: no site of its own, the prior above it counts. Null doc_id is
judged and never labelled. Repeated rows are evidence as often as they occur; of repeated labels the least counts.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import extend_rows, map_rows, require
from casegrid.llm.quality_forest import calibrated, calibrated_rows, held, labelled, with_counts
from casegrid.llm.text_stats import COUNTS, features
from casegrid.session import cut_lineage


def inputs(c: np.ndarray) -> np.ndarray:
    """What the classifier sees: a constant, the smoothed shares, and how far they are over nothing."""
    x = features(c)
    return np.concatenate([np.ones((len(x), 1)), x, np.sqrt(np.maximum(x, 0))], axis=1)


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and bend of the likelihood at ``w``, without penalty."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights by Newton steps on the penalised likelihood; the constant is not penalised."""
    return newton(lambda w: logistic_sums(x, y, w), x.shape[1], penalty, steps)


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(width)
    ridge = np.full(width, penalty)
    ridge[0] = 1e-9
    for _ in range(steps):
        slope, bend = sums(w)
        move = np.linalg.solve(bend + np.diag(ridge), slope + ridge * w)
        w -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_spread(marked: DataFrame, width: int) -> np.ndarray:
    """``fit_logistic`` over all labelled rows where they are: a step sums each partition and adds up the sums."""
    rows = cut_lineage(marked.select("label", *COUNTS))

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches):
            slope, bend = np.zeros(width), np.zeros((width, width))
            for batch in batches:
                c = np.array([batch[name] for name in COUNTS], dtype=np.int64).T.reshape(-1, len(COUNTS))
                if len(c):
                    s, b = logistic_sums(inputs(c), np.array(batch["label"]) > 0, w)
                    slope, bend = slope + s, bend + b
            yield {"slope": [slope.tolist()], "bend": [bend.ravel().tolist()]}

        found = map_rows(rows, "slope array<double>, bend array<double>", part).collect()
        slope, bend = (np.sort([r[k] for r in found], axis=0).sum(axis=0) for k in ("slope", "bend"))
        return slope, bend.reshape(width, width)

    return newton(sums, width)


def strength(groups: DataFrame, mean: Column) -> float:
    """Strength of the Beta prior by moments: how many documents' evidence the parent's mean is worth.

    ``groups`` has n, total (sum of evidence) and within (sum of squared deviations from the group's own mean).
    """
    off = F.col("total") / F.col("n") - mean
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("g"),
        F.sum(F.col("n") * off * off).alias("between"),
        F.sum("within").alias("within"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    n, g = row["n"] or 0, row["g"] or 0
    if g < 2 or n <= g:
        return float(max(n, 1))
    noise = row["within"] / (n - g)
    signal = max(row["between"] - (g - 1) * noise, 0.0) / max(n - row["squares"] / n, 1.0)
    if signal <= 0:
        return 1e6
    return float(min(max(noise / signal, 1.0), 1e6))


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(clipped / (1 - clipped))


def evidence(docs: DataFrame, labels: DataFrame, host: str, path: str, sample_rows: int, seed: int) -> tuple[DataFrame, bool]:
    """doc_id, host, path and the classifier's probability p_doc; and whether both labels occur."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    stats = cut_lineage(with_counts(rows))
    marked = labelled(stats, labels, "quality")
    sample = held(marked, sample_rows, seed)
    sides = {r["label"] > 0 for r in sample} if sample is not None else {r[0] for r in marked.select(F.col("label") > 0).distinct().collect()}
    width = 1 + 2 * features(np.zeros((1, len(COUNTS)))).shape[1]
    if len(sides) < 2:
        weights = np.zeros(width)
    elif sample is None:
        weights = fit_spread(marked, width)
    else:
        weights = fit_logistic(inputs(np.array([[r[c] for c in COUNTS] for r in sample])), np.array([r["label"] > 0 for r in sample], dtype=float))

    def start():
        def work(batch: dict[str, list]) -> dict[str, list]:
            c = np.array([batch[name] for name in COUNTS], dtype=np.int64).T.reshape(-1, len(COUNTS))
            return {"p_doc": (1 / (1 + np.exp(-np.clip(inputs(c) @ weights, -30, 30)))).tolist()}

        return work

    return extend_rows(stats, list(COUNTS), "p_doc double", start, COUNTS), len(sides) == 2


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    sums = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("p_doc").alias("total"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("squares"))
    within = F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.col("n"), F.lit(0.0))
    return cut_lineage(sums.select(*keys, "n", "total", within.alias("within")))


def judge_sites(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    sample_rows: int = 8192,
    max_false_share: float = 0.0,
    seed: int = 8,
) -> DataFrame:
    """doc_id, p_doc, p_host, p_path (posteriors without the document itself), posterior and kept."""
    require(docs, "doc_id", "text", host, path)
    scored, both = evidence(docs, labels, host, path, sample_rows, seed)
    rows = cut_lineage(scored)
    hosts, paths = _sums(rows, "host"), _sums(rows, "host", "path")
    mean = rows.agg(F.avg("p_doc")).first()[0]
    mean = 0.5 if mean is None else float(mean)
    k_host = strength(hosts, F.lit(mean))
    shrunk = hosts.select("host", ((F.lit(k_host * mean) + F.col("total")) / (k_host + F.col("n"))).alias("parent"))
    k_path = strength(paths.join(shrunk, "host"), F.col("parent"))

    own = F.col("p_doc")
    p_host = F.when(F.col("host_n").isNull(), F.lit(mean)).otherwise((F.lit(k_host * mean) + F.col("host_total") - own) / (F.lit(k_host) + F.col("host_n") - 1))
    p_path = F.when(F.col("path_n").isNull(), F.col("p_host")).otherwise((F.lit(k_path) * F.col("p_host") + F.col("path_total") - own) / (F.lit(k_path) + F.col("path_n") - 1))
    joined = rows.join(hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total")), "host", "left")
    joined = joined.join(paths.select("host", "path", F.col("n").alias("path_n"), F.col("total").alias("path_total")), ["host", "path"], "left")
    site = F.least(F.greatest(F.col("p_path"), F.lit(1e-6)), F.lit(1 - 1e-6))
    prior = math.log(max(mean, 1e-6) / max(1 - mean, 1e-6))
    odds = logit(own) + logit(site) - F.lit(prior)
    judged = joined.withColumn("p_host", p_host).withColumn("p_path", p_path).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    judged = cut_lineage(judged.select("doc_id", "p_doc", "p_host", "p_path", "posterior"))
    threshold = _threshold(judged, both, labels, sample_rows, max_false_share, seed)
    return judged.withColumn("kept", F.col("posterior") >= threshold)


def _threshold(judged: DataFrame, both: bool, labels: DataFrame, rows: int, max_false_share: float, seed: int) -> float:
    if not both:
        return 0.0
    marked = labelled(judged, labels, "quality")
    found = held(marked, rows, seed)
    if found is None:
        p = F.least(F.greatest(F.col("posterior"), F.lit(1e-12)), F.lit(1 - 1e-12))
        at = calibrated_rows(cut_lineage(marked.select("label", (-F.log(p / (1 - p))).alias("score"))), max_false_share)
    else:
        good, bad = (-np.array([_odds(r["posterior"]) for r in found if (r["label"] > 0) == side]) for side in (True, False))
        at = calibrated(good, bad, max_false_share)
    return float(1 / (1 + math.exp(at)))


def _odds(p: float) -> float:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return math.log(p / (1 - p))
