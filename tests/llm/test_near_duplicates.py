import random

import numpy as np

from casegrid.llm.components import least_reachable
from casegrid.llm.near_duplicates import find_groups, keep_one, superminhash
from tests.llm import edges


def shingle_set(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(docs, width, percent=80):
    """doc_id -> (set sizes, component) over all pairs; rows that share an id are one node."""
    sets = [(d, shingle_set(t, width)) for d, t in docs]
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    own = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(s), top(d) if d is not None else None, d is None or top(d) == d) for d, s in sets), key=repr)


def rows(groups):
    return sorted((tuple(r) for r in groups.collect()), key=repr)


def noisy(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(25):
        words = rng.choices(VOCABULARY, k=rng.choice([3, 8, 30, 120, 400]))
        docs += [" ".join(noisy(rng, words, share)) for share in (0, 0, 0.005, 0.01, 0.02, 0.05, 0.2)]
    passage = " ".join(rng.choices(VOCABULARY, k=60))
    docs += [passage + " " + " ".join(rng.choices(VOCABULARY, k=rng.choice([5, 12, 30]))) for _ in range(120)]
    hub = rng.choices(VOCABULARY, k=200)
    docs += [" ".join(noisy(rng, hub, 0.018)) for _ in range(80)] + [" ".join(hub)]
    chain = rng.choices(VOCABULARY, k=300)
    for _ in range(40):  # each is near the one before, the ends are far apart
        at = rng.randrange(300)
        chain = chain[:at] + rng.choices(VOCABULARY, k=4) + chain[at + 4 :]
        docs.append(" ".join(chain))
    docs += ["One", "one", "ONE two", "one two", "", None, "É é", "é é"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_groups_equal_brute_force(spark):
    for seed, width in ((1, 4),):
        docs = corpus(seed)
        assert rows(find_groups(edges.plain(spark, docs), width)) == brute(docs, width)


def test_open_pairs_are_settled_when_stars_cannot_link_them(spark):
    """With a single band row, buckets are wide and most links must come from the exact step after the stars."""
    docs = corpus(3)[:160]
    assert rows(find_groups(edges.plain(spark, docs), 4, bands=60, rows=1)) == brute(docs, 4)


def test_edges(spark):
    docs = edges.documents(spark)
    want = brute([r[:2] for r in edges.ROWS], 5)
    assert rows(find_groups(docs)) == want
    assert find_groups(docs.limit(0)).count() == 0
    kept = keep_one(docs)
    assert kept.schema == docs.schema
    dropped = {w[0] for w in want if not w[3]}
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in dropped)
    assert keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(70)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    made = {r.node: r.component for r in least_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {made[i] for i in range(71)} == {0} and {made[i] for i in range(500, 560)} == {500} and {made[i] for i in (900, 901, 902)} == {900}


def slow_signature(elements, size):
    """The signature by its definition: every element takes all its steps."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    out = [None] * size
    for e in elements:
        order = list(range(size))
        for j in range(size):
            r = mix((int(e) + (j + 1) * 0x9E3779B97F4A7C15) & mask)
            k = j + ((r & 0xFFFFFFFF) * (size - j) >> 32)
            order[j], order[k] = order[k], order[j]
            value = j << 32 | r >> 32
            if out[order[j]] is None or value < out[order[j]]:
                out[order[j]] = value
    return out


def test_signature_is_the_full_one_and_estimates_similarity():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    made = superminhash(np.concatenate(sets), np.repeat(np.arange(5), [len(s) for s in sets]), 5, 32)
    assert made.tolist() == [slow_signature(s, 32) for s in sets]
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 120).astype(np.uint64)
        a, b = pool[:110], pool[10:]
        two = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 110), 2, 128)
        errors.append((two[0] == two[1]).mean() - 100 / 120)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.033


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    import casegrid.llm.near_duplicates as module

    monkeypatch.setattr(module, "BLOCK", 7)
    docs = corpus(5)[:120]
    assert rows(find_groups(edges.plain(spark, docs), 4, bands=60, rows=1)) == brute(docs, 4)
