import numpy as np
from pyspark.sql import functions as F

from casegrid.llm.common import quantile, ranked
from casegrid.llm.quality_forest import Forest, calibrated, fit_forest, judged_documents, keep_good, usual_length
from casegrid.llm.site_bayes import fit_logistic, judge_sites
from casegrid.llm.text_stats import counts, features
from casegrid.llm.toxicity import best_threshold, feature_ids, fit_chain, judge, scorer, train
from tests.llm import edges




def plain_counts(text):
    """The base values by their definition."""
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    lines = [line for line in (text or "").split("\n") if line.encode().strip()]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


TEXTS = [
    "a b c d e a b c d e", "a b c d e f", "x\nx\n \n\nx\ny\ny ", "# * $ % & | < > é", "a b c d e b c d e a b c d e f", " nbsp stays a word", "é" * 10, "w " * 5000,
    "one two three four five six seven eight nine ten", "\x0b\x0c\x1c a", None, "", " \n ",
]


def test_counts_by_definition(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        got = counts(text.encode() if text is not None else None)
        want = plain_counts(text)
        if not want[0]:
            assert got == (0,) * len(got)
        else:
            assert got[:5] == want, text[:60]


def path_length(forest: Forest, t: int, row: np.ndarray) -> float:
    at = 0
    while forest.column[t, at] >= 0:
        at = forest.left[t, at] if row[forest.column[t, at]] < forest.value[t, at] else forest.right[t, at]
    return forest.length[t, at]


def test_forest_scores_by_walking_each_tree():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 0.05, (500, 6)), rng.normal(1, 0.2, (40, 6))
    forest = fit_forest(good, bad)
    rows = np.concatenate([good[:20], bad[:20]])
    mean = [np.mean([path_length(forest, t, r) for t in range(len(forest.column))]) for r in rows]
    assert np.allclose(forest.scores(rows), 2 ** (-np.array(mean) / forest.usual))
    assert forest.scores(bad).min() > np.quantile(forest.scores(good), 0.9)
    assert usual_length(2) == 1.0 and abs(usual_length(256) - 10.244) < 0.01


def test_quality_on_held_out_rows(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = marks.filter("doc_id % 2 = 0")
    judged = {r.doc_id: r for r in judged_documents(docs, half).collect()}
    rest = [(judged[r.doc_id], r.quality) for r in marks.filter("doc_id % 2 = 1").collect()]
    good = [j for j, q in rest if q == 1 and not j.base_failed]
    bad = [j for j, q in rest if q == 0 and not j.base_failed]
    assert np.mean([j.kept for j in good]) > 0.995 and np.mean([j.kept for j in bad]) < 0.1
    assert not any(j.kept for j in judged.values() if j.base_failed)


def test_every_kind_of_anomaly_is_told_by_itself():
    """Labels show symbols 200 times, each other kind twice; the rarer kinds are found, and those no label shows too."""
    rng = np.random.default_rng(4)
    top = np.array([0.0, 0.06, 0.07, 0.02, 0.035, 0.02])
    made = lambda n: rng.random((n, 6)) ** 2 * top

    def odd(column, n, low=0.3, high=0.5):
        rows = made(n)
        rows[:, column] = rng.uniform(low, high, n)
        return rows

    good, fresh = made(3000), made(3000)
    for labelled_kinds in ((0,), range(6)):
        bad = np.concatenate([odd(0, 200, 0.05, 0.35), *[odd(c, 2) for c in labelled_kinds]])
        forest = fit_forest(good, bad)
        threshold = calibrated(forest.scores(good), forest.scores(bad), 0.0, spare=0.0)
        assert (forest.scores(bad) > threshold).all() and (forest.scores(fresh) > threshold).mean() < 0.005
        for column in range(6):
            assert (forest.scores(odd(column, 50)) > threshold).all(), column


def test_labelled_doubled_words_are_rejected(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rare = judged_documents(docs, marks).join(marks.filter("quality = 0"), "doc_id").filter("not base_failed and n_symbols = 0").collect()
    assert len(rare) == 5 and not any(r.kept for r in rare)


def test_quality_edges(spark):
    docs = edges.documents(spark)
    marks = edges.labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 1), (5, None, 0), (99, 0, 1)])
    for labels in (marks, marks.limit(0)):
        rows = judged_documents(docs, labels).collect()
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=repr)
        assert got == sorted(((r[0], *(plain_counts(r[1]) if (r[1] or "").split() else (0,) * 5)) for r in edges.ROWS), key=repr)
        kept = keep_good(docs, labels)
        assert kept.schema == docs.schema
        flags = sorted((r.doc_id for r in rows if r.kept), key=repr)
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == flags
    assert judged_documents(docs.limit(0), marks).count() == 0 and keep_good(docs.limit(0), marks).count() == 0


def test_site_posteriors_by_plain_sums(spark):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(600):
        host = ["big", "small", None, f"h{i % 40}"][0 if i < 300 else 1 if i < 302 else 2 if i < 320 else 3]
        good = rng.random() < (0.9 if host == "big" else 0.6)
        rows.append((i, "plain words of a fine text that says this and that " * 3 if good else "$$$ %%% |||| ### buy *** " * 6, ["en", "de", None][i % 3], host))
        marks.append((i, int(good), 0))
    docs = edges.documents(spark, rows)
    made = {r.doc_id: r for r in judge_sites(docs, edges.labels(spark, marks)).collect()}
    p = {i: made[i].p_doc for i in made}
    mean = np.mean(list(p.values()))

    def strength(groups, parent):
        n = np.array([len(g) for g in groups], float)
        m = np.array([np.mean(g) for g in groups])
        noise = sum(((np.array(g) - x) ** 2).sum() for g, x in zip(groups, m, strict=True)) / (n.sum() - len(n))
        signal = max((n * (m - parent) ** 2).sum() - (len(n) - 1) * noise, 0) / (n.sum() - (n**2).sum() / n.sum())
        return 1e6 if signal <= 0 else min(max(noise / signal, 1.0), 1e6)

    hosts, paths = {}, {}
    for i, _, lang, host in rows:
        if host is not None:
            hosts.setdefault(host, []).append(p[i])
            if lang is not None:
                paths.setdefault((host, lang), []).append(p[i])
    k = strength(list(hosts.values()), mean)
    parent = np.array([(k * mean + sum(hosts[h])) / (k + len(hosts[h])) for h, _ in paths])
    kp = strength(list(paths.values()), parent)
    for i, _, lang, host in rows:
        p_host = mean if host is None else (k * mean + sum(hosts[host]) - p[i]) / (k + len(hosts[host]) - 1)
        p_path = p_host if host is None or lang is None else (kp * p_host + sum(paths[host, lang]) - p[i]) / (kp + len(paths[host, lang]) - 1)
        odds = [np.log(x / (1 - x)) for x in np.clip([p[i], p_path, mean], 1e-6, 1 - 1e-6)]
        assert np.allclose([made[i].p_host, made[i].p_path], [p_host, p_path])
        assert np.isclose(made[i].posterior, 1 / (1 + np.exp(-(odds[0] + odds[1] - odds[2]))))
    kept = {i for i in made if made[i].kept}
    assert kept >= {i for i, q, _ in marks if q} and len(kept) < 450


def test_site_edges(spark):
    docs, marks = edges.documents(spark), edges.labels(spark, [(1, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, 0)])
    for labels in (marks, marks.limit(0)):
        made = judge_sites(docs, labels).collect()
        assert sorted((r.doc_id for r in made), key=repr) == sorted((r[0] for r in edges.ROWS), key=repr)
        assert all(0 <= r.posterior <= 1 for r in made)
    assert all(r.kept for r in made) and judge_sites(docs.limit(0), marks).count() == 0


def test_logistic_weights_have_no_slope_left():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 3))], axis=1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.3, 2, -1, 0])))).astype(float)
    w = fit_logistic(x, y, penalty=0.5)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + np.array([1e-9, 0.5, 0.5, 0.5]) * w
    assert np.abs(slope).max() < 1e-4


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    half, rest = rows[::2], rows[1::2]
    y = np.array([[1 - r.quality, r.toxic] for r in half])
    chain = fit_chain([feature_ids(r.text.encode()) for r in half], [r.doc_id for r in half], y, 512, 0.002)
    score = scorer(chain)
    marked = np.array([score(r.text.encode())[1] >= chain.threshold for r in rest])
    toxic = np.array([r.toxic for r in rest]) > 0
    assert marked[toxic].mean() > 0.9 and marked[~toxic].mean() < 0.005
    # the batch scorer and the models' own matrices agree
    ids = feature_ids(rest[0].text.encode())
    odds = []
    for model in chain.models:
        odds.append(float(np.isin(model.ids, ids) @ model.weights + np.clip(odds, -20, 20) @ model.earlier + model.constant))
    assert np.allclose(score(rest[0].text.encode()), 1 / (1 + np.exp(-np.array(odds))))


def test_toxicity_sample_is_bounded_whatever_the_repeats(spark, monkeypatch):
    rows = [(1, f"text number {i}") for i in range(500)] + [(i, f"other text {i}") for i in range(2, 12)]
    marks = edges.labels(spark, [(i, 1, i % 2) for i in range(1, 12)])
    categories = {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}
    kept = []
    monkeypatch.setattr("casegrid.llm.toxicity.fit_chain", lambda texts, keys, *rest: kept.extend(keys))
    train(edges.plain(spark, rows), marks, categories, sample_rows=20)
    assert sorted(kept) == list(range(1, 12))
    again = list(kept)
    kept.clear()
    train(edges.plain(spark, rows[::-1]).repartition(3), marks, categories, sample_rows=5)
    assert len(kept) == 5 and set(kept) <= set(again)


def test_word_tables_do_not_keep_long_words():
    from casegrid.llm.common import WORDS, hand_back, word_hashes

    long = [b"x" * 1000 + str(i).encode() for i in range(50)]
    first = word_hashes([b"short", *long])
    assert b"short" in WORDS and not any(w in WORDS for w in long)
    hand_back()
    assert not WORDS and (word_hashes([b"short", *long]) == first).all()


def test_threshold_is_the_best_f1():
    p, y = np.array([0.9, 0.8, 0.8, 0.4, 0.3, 0.1]), np.array([True, True, False, True, False, False])
    def f1(t, allowed):
        hit, false = (y & (p >= t)).sum(), (~y & (p >= t)).sum()
        return 2 * hit / (hit + false + 3) if false <= allowed * 3 else -1
    for allowed in (0, 0.4, 1):
        t = best_threshold(p, y, allowed)
        assert f1(t, allowed) == max(f1(x, allowed) for x in (0.95, 0.85, 0.6, 0.35, 0.2, 0.05))


def test_toxicity_edges(spark):
    docs = edges.documents(spark)
    categories = {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}
    marks = edges.labels(spark, [(1, 1, 0), (1, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, 0), (7, 1, 0), (8, 0, 1)])
    for labels in (marks, marks.limit(0), marks.filter("toxic = 0")):
        made = judge(docs, train(docs, labels, categories), list(categories)).collect()
        assert sorted((r.doc_id for r in made), key=repr) == sorted((r[0] for r in edges.ROWS), key=repr)
    assert judge(docs.limit(0), train(docs.limit(0), marks, categories), list(categories)).count() == 0


def test_bounded_sample_is_the_least_hashes(spark):
    from casegrid.llm.common import bounded_sample

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    place = F.xxhash64(F.lit(3), F.col("doc_id"))
    for n in (50, 19_000, 30_000):
        want = [r.doc_id for r in rows.orderBy(place, "doc_id").limit(n).collect()]
        assert [r.doc_id for r in bounded_sample(rows, "doc_id", n, 3).collect()] == want


def marked_texts(spark):
    """400 labelled texts in shares of all kinds; symbols mark the bad ones."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"word{i}" for i in rng.integers(0, 10**6, n))
    rows = [(k, words(60) + (" #" * int(rng.integers(12, 30)) if k % 8 == 0 else " #" * int(rng.integers(0, 3))), "en", f"s{k % 7}") for k in range(400)]
    marks = edges.labels(spark, [(k, int(k % 8 > 0), 0) for k in range(400)])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), marks


def test_values_by_rank_are_exact(spark):
    values = np.concatenate([np.random.default_rng(5).normal(0, 1, 300) ** 9, np.zeros(40), [1e-300, 3.0, 3.0, 1e6]])
    rows, order = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3), np.sort(values)
    for rank in (0, 1, 150, 170, len(values) - 2):
        assert ranked(rows, "v", rank) == (order[rank], order[rank + 1])
    assert ranked(rows, "v", len(values) - 1) == (order[-1], order[-1])
    for share in (0.0, 0.02, 0.999, 1.0):
        assert quantile(rows, "v", share, len(values)) == np.quantile(values, share)


def test_more_labelled_rows_than_the_driver_holds_all_count(spark):
    docs, marks = marked_texts(spark)
    whole = {r.doc_id: r.kept for r in judged_documents(docs, marks).collect()}
    spread = judged_documents(docs, marks, sample_rows=20)
    rows = {r.doc_id: r.kept for r in spread.collect()}
    # every labelled good row takes part in the calibration, so none is rejected, and all bad ones lie beyond
    assert rows == whole and all(rows[k] == (k % 8 > 0) for k in rows)
    assert {r.doc_id for r in keep_good(docs, marks, sample_rows=20).collect()} == {k for k, kept in rows.items() if kept}
    a = {r.doc_id: r for r in judge_sites(docs, marks).collect()}
    b = {r.doc_id: r for r in judge_sites(docs, marks, sample_rows=20).collect()}
    assert np.allclose([a[k].p_doc for k in sorted(a)], [b[k].p_doc for k in sorted(a)], rtol=1e-6, atol=1e-12)
    assert [a[k].kept for k in sorted(a)] == [b[k].kept for k in sorted(a)]
