"""Quality rules with an isolation forest over rule statistics.

One scan counts words, symbols, repeated lines and repeated five-word windows of every whole text. The base rules
reject texts of under 10 words, and texts of which over 20 % of the words lie in repeated windows. The other texts
get an anomaly score from an isolation forest: the mean path length over random splits of their shares (symbols,
repeated lines, repeated words, capitals, marks, doubled words), against that of a random tree of the same size.
Each tree sees good labelled rows and a few bad ones, and splits every share alike, also beyond the values it has seen.

The forest is fitted on all labelled rows that pass the base rules: its units are taken over all good ones, and each tree
draws its few rows from all of them. The score threshold is calibrated on all of them too: it lies half way between the good
ones (but the share ``max_false_share``) and the first of the bad ones beyond them. Up to ``sample_rows`` labelled rows are
held on the driver; more stay where they are and are counted there. Without a good and a bad labelled row, the method rejects
nothing.

Null or empty text: no words, base_failed. Null doc_id: judged like others, never labelled. Repeated rows are judged
each by itself; of repeated labels the worst counts; labels with nulls are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import extend_rows, lots, neutral, quantile, ranked, require
from casegrid.llm.text_stats import COUNTS, base_failed, counts, features

STATS = ", ".join(f"{c} long" for c in COUNTS)


def with_counts(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """The rows with the counts of their whole texts."""
    require(docs, "text")

    def start():
        def work(batch: dict[str, list]) -> dict[str, list]:
            values = list(zip(*[counts(t) for t in batch["text"]], strict=True)) or [()] * len(COUNTS)
            return dict(zip(COUNTS, map(list, values), strict=True))

        return work

    return extend_rows(docs.withColumn("text", F.col("text").cast("string")), ["text"], STATS, start, () if keep_text else ("text",))


def labelled(stats: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """All labelled rows of ``stats``; ``label`` is the least label of a document."""
    require(labels, "doc_id", column)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    return stats.join(marks, "doc_id")


def held(rows: DataFrame, most: int, seed: int) -> list | None:
    """The rows in the order of their hash of doc_id, the same on every run; none if there are over ``most``."""
    found = rows.withColumn("_place", F.xxhash64(F.lit(seed), F.col("doc_id"))).limit(most + 1).collect()
    return sorted(found, key=lambda r: (r["_place"], r["doc_id"])) if len(found) <= most else None


@dataclass
class Forest:
    """Trees as arrays: split column (-1: leaf), split value, children, and path length at leaves."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    usual: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores: 2 ** -(mean path length / usual path length)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.column)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                c = self.column[t][at]
                down = np.where(x[rows, np.maximum(c, 0)] < self.value[t][at], self.left[t][at], self.right[t][at])
                at = np.where(c < 0, at, down)
            total += self.length[t][at]
        return np.exp2(-total / len(self.column) / self.usual)


def usual_length(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n points."""
    if n < 2:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


#: Splits go up to so many times the values of good rows. Shares under the least unit count as usual even if no good row has them.
REACH, LEAST_UNIT = 6.0, 0.005


def units(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The value of each column that nearly all good rows stay under."""
    return np.maximum(np.quantile(good if len(good) else bad, 0.999, axis=0), LEAST_UNIT)


def fit_forest(good: np.ndarray, bad: np.ndarray, trees: int = 100, points: int = 256, bad_points: int = 4, seed: int = 7) -> Forest:
    """Each tree sees ``points`` good rows and ``bad_points`` bad ones: known anomalies stay few, so that they are isolated early.

    All columns are split alike, in units of the good rows and beyond their largest value, so that an anomaly in any
    one column is isolated early whether or not a labelled row shows it.
    """
    rng = np.random.default_rng(seed)
    points, bad_points = min(points, len(good)), min(bad_points, len(bad))

    def draw(tree: int) -> np.ndarray:
        return np.concatenate([part[rng.choice(len(part), size=n, replace=False)] for part, n in ((good, points), (bad, bad_points)) if n])

    return grown_forest(draw, units(good, bad), trees, points, bad_points, rng)


def grown_forest(draw: Callable[[int], np.ndarray], unit: np.ndarray, trees: int, points: int, bad_points: int, rng: np.random.Generator) -> Forest:
    """Trees over the rows that ``draw`` gives each of them."""
    depth = max(1, int(np.ceil(np.log2(max(points + bad_points, 2)))))
    grown = []
    for tree in range(trees):
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, level: int, nodes=nodes) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, level + usual_length(len(part))])
            if level >= depth or len(part) < 2:
                return me
            low = part.min(axis=0) / unit
            open_ = np.flatnonzero(low < REACH)
            if not len(open_):
                return me
            c = int(rng.choice(open_))
            at = rng.uniform(low[c], REACH) * unit[c]
            below = part[:, c] < at
            if not below.any():
                return me
            nodes[me] = [c, at, grow(part[below], level + 1), grow(part[~below], level + 1), 0.0]
            return me

        grow(draw(tree), 0)
        grown.append(nodes)
    width = max(map(len, grown))
    packed = np.zeros((trees, width, 5))
    for t, nodes in enumerate(grown):
        packed[t, : len(nodes)] = nodes
    as_int = lambda k: packed[:, :, k].astype(np.int64)
    return Forest(as_int(0), packed[:, :, 1], as_int(2), as_int(3), packed[:, :, 4], usual_length(points + bad_points) or 1.0, depth)


def calibrated(good: np.ndarray, bad: np.ndarray, max_false_share: float, spare: float = 0.02) -> float:
    """Scores over this are rejected: half way from the good rows to all bad ones beyond them but the share ``spare``.

    At most ``max_false_share`` of the good rows lie beyond the point from which the half way is taken.
    """
    if not len(good) or not len(bad):
        return np.inf
    most = float(np.sort(good)[len(good) - 1 - int(max_false_share * len(good))])
    beyond = bad[bad > most]
    return (most + float(np.quantile(beyond, spare))) / 2 if len(beyond) else most


def calibrated_rows(rows: DataFrame, max_false_share: float, spare: float = 0.02) -> float:
    """``calibrated`` over all ``rows``: ``label`` and ``score``."""
    good, bad = rows.filter("label > 0"), rows.filter("label <= 0")
    n = good.count()
    if not n or bad.isEmpty():
        return np.inf
    most, _ = ranked(good, "score", n - 1 - int(max_false_share * n))
    beyond = bad.filter(F.col("score") > F.lit(most))
    over = beyond.count()
    return (most + quantile(beyond, "score", spare, over)) / 2 if over else most


SHARES = tuple(f"share_{i}" for i in range(features(np.zeros((1, len(COUNTS)))).shape[1]))


def fit_rules(
    stats: DataFrame, labels: DataFrame, sample_rows: int = 8192, trees: int = 100, points: int = 256, bad_points: int = 4, max_false_share: float = 0.0, seed: int = 7
) -> tuple[Forest | None, float]:
    """The forest and the score threshold, from all labelled rows that pass the base rules; the driver holds up to ``sample_rows``."""
    marked = labelled(stats, labels, "quality")
    rows = held(marked, sample_rows, seed)
    if rows is None:
        return fit_spread(marked, trees, points, bad_points, max_false_share, seed)
    rows = [r for r in rows if not base_failed(r["n_words"], r["n_repeat_words"])]
    if not rows:
        return None, np.inf
    x = features(np.array([[r[c] for c in COUNTS] for r in rows]))
    good = np.array([r["label"] > 0 for r in rows])
    forest = fit_forest(x[good], x[~good], trees, points, bad_points, seed)
    scores = forest.scores(x)
    return forest, calibrated(scores[good], scores[~good], max_false_share, spare=0.0)


def fit_spread(marked: DataFrame, trees: int, points: int, bad_points: int, max_false_share: float, seed: int) -> tuple[Forest | None, float]:
    """``fit_rules`` over labelled rows that stay where they are; the driver gets the rows of each tree, and counts."""
    from casegrid.session import cut_lineage

    def start():
        def work(batch: dict[str, list]) -> dict[str, list]:
            c = np.array([batch[name] for name in COUNTS], dtype=np.int64).T.reshape(-1, len(COUNTS))
            failed = [base_failed(n, r) for n, r in zip(batch["n_words"], batch["n_repeat_words"], strict=True)]
            return {"failed": failed, **dict(zip(SHARES, features(c).T.tolist(), strict=True))}

        return work

    shares = ", ".join(f"{c} double" for c in SHARES)
    spread = extend_rows(marked.select("doc_id", "label", *COUNTS), list(COUNTS), f"failed boolean, {shares}", start, COUNTS)
    rows = cut_lineage(spread.filter("not failed").drop("failed"))
    good, bad = rows.filter("label > 0"), rows.filter("label <= 0")
    n_good, n_bad = good.count(), bad.count()
    if not n_good + n_bad:
        return None, np.inf
    usual, n = (good, n_good) if n_good else (bad, n_bad)
    unit = np.maximum([quantile(usual, c, 0.999, n) for c in SHARES], LEAST_UNIT)
    points, bad_points = min(points, n_good), min(bad_points, n_bad)
    drawn = [lots(part, "doc_id", list(SHARES), trees, size, n, seed + i) for i, (part, size, n) in enumerate(((good, points, n_good), (bad, bad_points, n_bad))) if size]
    forest = grown_forest(lambda t: np.concatenate([part[t] for part in drawn]), unit, trees, points, bad_points, np.random.default_rng(seed))

    def scoring():
        def work(batch: dict[str, list]) -> dict[str, list]:
            x = np.array([batch[c] for c in SHARES]).T.reshape(-1, len(SHARES))
            return {"score": forest.scores(x).tolist() if len(x) else []}

        return work

    scored = cut_lineage(extend_rows(rows, list(SHARES), "score double", scoring, SHARES))
    return forest, calibrated_rows(scored, max_false_share, spare=0.0)


def judge(stats: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """Adds anomaly (score), base_failed and kept to rows with counts."""

    def start():
        def work(batch: dict[str, list]) -> dict[str, list]:
            c = np.array([batch[name] for name in COUNTS], dtype=np.int64).T.reshape(-1, len(COUNTS))
            failed = [base_failed(n, r) for n, r in zip(batch["n_words"], batch["n_repeat_words"], strict=True)]
            scores = forest.scores(features(c)) if forest is not None and len(c) else np.zeros(len(c))
            kept = [not f and s <= threshold for f, s in zip(failed, scores.tolist(), strict=True)]
            return {"anomaly": scores.tolist(), "base_failed": failed, "kept": kept}

        return work

    return extend_rows(stats, list(COUNTS), "anomaly double, base_failed boolean, kept boolean", start)


def judged_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, the counts, anomaly, base_failed and kept of every document."""
    from casegrid.session import cut_lineage

    require(docs, "doc_id", "text")
    stats = cut_lineage(with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    forest, threshold = fit_rules(stats, labels, **settings)
    return judge(stats, forest, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that base rules and forest keep, with their own columns. Texts are scanned in place, not shuffled.

    The labelled rows are counted first, then every row is counted and judged in one scan. With over ``sample_rows``
    labelled documents the counts of all rows are written, and the labelled ones are taken from them.
    """
    from casegrid.session import cut_lineage

    require(docs, "doc_id", "text")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    most = settings.get("sample_rows", 8192)
    ids = texts.select("doc_id").join(marks, "doc_id", "left_semi").distinct().limit(most + 1).collect()
    if len(ids) <= most:
        picked = texts.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")
        stats = with_counts(picked)
    else:
        stats = cut_lineage(with_counts(texts))
    forest, threshold = fit_rules(stats, labels, **settings)
    plain, names = neutral(docs, "text")
    judged = judge(with_counts(plain, keep_text=True), forest, threshold)
    return judged.filter("kept").select(*plain.columns).toDF(*names)
