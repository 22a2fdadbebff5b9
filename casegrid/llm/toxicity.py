"""Toxicity by a chain of linear classifiers.

The categories are columns of the label table, predicted in the given order. Each model is logistic over the presence
of words and word beginnings (4 to 8 bytes), chosen by their association with the category, and over the log-odds of
the categories before it. For training, those log-odds are out-of-fold: a row never sees a model that saw the row.
For use, the models fitted on all rows are run one after the other.

The models are fitted on a bounded sample of labelled rows: the ``sample_rows`` of least hash of doc_id. What is
fitted is small (``n_features`` weights a category) and travels with the tasks; texts are scanned whole, in place.
The decision threshold of the last category comes from its out-of-fold probabilities: the one of best F1 among those
that mark at most ``max_false_share`` of the other rows.

Null or empty text: no features, so the models' constants. Null doc_id is judged and never labelled. Repeated rows are
judged each by itself; of repeated labels the greatest counts; labels with nulls are left out. Without labelled rows,
or if a category has one value only, its probability is that of the sample (0 without a sample). An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import WORD_BYTES, WORD_TABLE_SIZE, bounded_sample, extend_rows, require

#: Lower-cased ASCII letters, digits and other bytes stay; the rest of ASCII parts words.
_SPLIT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS = 5


def word_features(word: bytes) -> list[int]:
    """32-bit ids of a word and of its beginnings."""
    return [xxhash.xxh32_intdigest(b"w" + word)] + [xxhash.xxh32_intdigest(b"p" + word[:n]) for n in BEGINNINGS if len(word) > n]


def distinct_words(text: bytes | None) -> set[bytes]:
    return set(text.decode("utf-8").lower().encode("utf-8").translate(_SPLIT).split()) if text else set()


def feature_ids(text: bytes | None) -> np.ndarray:
    ids: set[int] = set()
    for word in distinct_words(text):
        ids.update(word_features(word))
    return np.array(sorted(ids), dtype=np.uint32)


@dataclass
class Linear:
    """Weights over chosen feature ids and over earlier log-odds."""

    ids: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def odds(self, present: np.ndarray, before: np.ndarray) -> np.ndarray:
        return present @ self.weights + before @ self.earlier + self.constant


@dataclass
class Chain:
    models: list[Linear] = field(default_factory=list)
    threshold: float = 1.0


def chosen_features(column: np.ndarray, rows: np.ndarray, y: np.ndarray, n_ids: int, n_features: int, least: int = 3) -> np.ndarray:
    """The ids most associated with the label: by their share among positive rows against the others, signed chi-square."""
    pos = np.bincount(column[y[rows] > 0], minlength=n_ids).astype(float)
    neg = np.bincount(column[y[rows] == 0], minlength=n_ids).astype(float)
    n_pos, n_neg = max((y > 0).sum(), 1), max((y == 0).sum(), 1)
    total = pos + neg
    expected = total * n_pos / (n_pos + n_neg)
    score = np.where(total >= least, (pos - expected) ** 2 / np.maximum(expected * (1 - n_pos / (n_pos + n_neg)), 1e-9), 0.0)
    best = np.argsort(-score, kind="stable")[:n_features]
    return best[score[best] > 6.0]


def dense(column: np.ndarray, rows: np.ndarray, chosen: np.ndarray, n_rows: int, n_ids: int) -> np.ndarray:
    """Presence of the chosen ids, a row for each document."""
    place = np.full(n_ids, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    at = place[column]
    out = np.zeros((n_rows, len(chosen)), dtype=np.float32)
    out[rows[at >= 0], at[at >= 0]] = 1
    return out


def fit_linear(x: np.ndarray, before: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
    """Penalised logistic weights by adaptive gradient steps; both classes weigh by the root of their share."""
    z = np.concatenate([x, before.astype(np.float32), np.ones((len(x), 1), dtype=np.float32)], axis=1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, np.sqrt((1 - share) / share), 1.0).astype(np.float32)
    weight /= weight.sum()
    w = np.zeros(z.shape[1], dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty * np.append(w[:-1], 0).astype(np.float32)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    k = before.shape[1]
    return w[: len(w) - 1 - k], w[len(w) - 1 - k : -1], float(w[-1])


def fit_chain(texts: list[np.ndarray], keys: list[int], y: np.ndarray, n_features: int, max_false_share: float) -> Chain:
    """Models of all categories (columns of y) in order; ``texts`` are feature ids of each row."""
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ids, column = np.unique(np.concatenate(texts) if len(rows) else np.empty(0, np.uint32), return_inverse=True)
    fold = np.array([xxhash.xxh32_intdigest(str(k)) % FOLDS for k in keys])
    chain = Chain()
    before = np.zeros((len(texts), 0))
    out_of_fold = np.zeros(len(texts))
    for c in range(y.shape[1]):
        label = y[:, c].astype(np.float32)
        if len(set(label.tolist())) < 2:
            constant = 20.0 if len(label) and label[0] > 0 else -20.0
            chain.models.append(Linear(np.empty(0, np.uint32), np.empty(0), np.zeros(c), constant))
            out_of_fold = np.full(len(texts), constant)
        else:
            out_of_fold = np.zeros(len(texts))
            for f in range(FOLDS):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if not len(test):
                    continue
                if len(set(label[train].tolist())) < 2:
                    out_of_fold[test] = -5.0
                    continue
                inside = fold[rows] != f
                chosen = chosen_features(column[inside], rows[inside], _only(label, train), len(ids), n_features)
                x = dense(column, rows, chosen, len(texts), len(ids))
                w, e, b = fit_linear(x[train], before[train], label[train])
                out_of_fold[test] = x[test] @ w + before[test] @ e + b
            chosen = chosen_features(column, rows, label, len(ids), n_features)
            x = dense(column, rows, chosen, len(texts), len(ids))
            w, e, b = fit_linear(x, before, label)
            chain.models.append(Linear(ids[chosen], w.astype(float), e.astype(float), b))
        before = np.concatenate([before, np.clip(out_of_fold, -20, 20)[:, None]], axis=1)
    chain.threshold = best_threshold(1 / (1 + np.exp(-np.clip(out_of_fold, -30, 30))), y[:, -1] > 0, max_false_share)
    return chain


def _only(label: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Labels outside ``rows`` as -1: neither positive nor negative."""
    out = np.full(len(label), -1.0)
    out[rows] = label[rows]
    return out


def best_threshold(p: np.ndarray, positive: np.ndarray, max_false_share: float) -> float:
    """The probability of best F1 among those that mark at most the given share of the other rows."""
    if not positive.any() or positive.all():
        return 2.0 if not positive.any() else 0.0
    order = np.argsort(-p, kind="stable")
    hits, false = np.cumsum(positive[order]), np.cumsum(~positive[order])
    last = np.append(p[order][1:] < p[order][:-1], True)
    f1 = np.where(last & (false <= max_false_share * (~positive).sum()), 2 * hits / (hits + false + positive.sum()), -1.0)
    i = int(np.argmax(f1))
    if f1[i] < 0:
        return float(p[order][0]) + 1e-9
    after = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + after) / 2)


def scorer(chain: Chain):
    """A function from texts to the probabilities of each category; words met before are looked up."""
    places: dict[int, list[tuple[int, int]]] = {}
    for c, model in enumerate(chain.models):
        for k, i in enumerate(model.ids.tolist()):
            places.setdefault(i, []).append((c, k))
    known: dict[bytes, tuple[int, ...]] = {}

    def hits(word: bytes) -> tuple[int, ...]:
        found = known.get(word)
        if found is None:
            found = tuple(i for i in word_features(word) if i in places)
            if len(word) <= WORD_BYTES:
                if len(known) >= WORD_TABLE_SIZE:
                    known.clear()
                known[word] = found
        return found

    def score(text: bytes | None) -> list[float]:
        present = {i for word in distinct_words(text) for i in hits(word)}
        odds = [model.constant for model in chain.models]
        for i in present:
            for c, k in places[i]:
                odds[c] += chain.models[c].weights[k]
        for c, model in enumerate(chain.models):
            odds[c] += sum(w * min(max(odds[e], -20.0), 20.0) for e, w in enumerate(model.earlier))
        return [float(1 / (1 + np.exp(-min(max(o, -30.0), 30.0)))) for o in odds]

    return score


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = 8000, n_features: int = 512, max_false_share: float = 0.002, seed: int = 10) -> Chain:
    """Fit the chain on at most ``sample_rows`` labelled rows, one per doc_id. ``categories``: name to 0/1 column of the label table."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    marks = marks.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in categories])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    chosen = bounded_sample(marks.join(ids, "doc_id", "left_semi"), "doc_id", sample_rows, seed)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # of rows that share an id the least text stands for all, so the sample is bounded in rows, not only in ids
    picked = texts.join(chosen, "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text"))

    def start():
        return lambda batch: {"ids": [feature_ids(t).tobytes() for t in batch["text"]]}

    rows = extend_rows(picked, ["text"], "ids binary", start, ("text",)).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return Chain([Linear(np.empty(0, np.uint32), np.empty(0), np.zeros(c), -30.0) for c in range(len(categories))], 2.0)
    y = np.array([[r[n] for n in categories] for r in rows])
    return fit_chain([np.frombuffer(r["ids"], dtype=np.uint32) for r in rows], [r["doc_id"] for r in rows], (y > 0).astype(int), n_features, max_false_share)


def judge(docs: DataFrame, chain: Chain, names: list[str]) -> DataFrame:
    """doc_id, p_<name> of each category, and marked: the last category's decision."""
    require(docs, "doc_id", "text")

    def start():
        score = scorer(chain)

        def work(batch: dict[str, list]) -> dict[str, list]:
            rows = [score(t) for t in batch["text"]]
            out = {f"p_{n}": [r[c] for r in rows] for c, n in enumerate(names)}
            return out | {"marked": [r[-1] >= chain.threshold for r in rows]}

        return work

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return extend_rows(narrow, ["text"], ", ".join(f"p_{n} double" for n in names) + ", marked boolean", start, ("text",))
