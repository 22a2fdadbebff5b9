import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from casegrid.llm.prefix_trie import balanced_order, crossed, prefix_trie, turn_lists
from casegrid.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, kind string, ids string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(spark, rows):
    return spark.createDataFrame([(*r, "k", "i", 3) for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    """Turn lists of (conv_id, turn, role, text) rows, straight from the contract."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    lists = {c: [t[-1] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in own.items()}
    out = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = lists.get(base, [])[:h] + turns[h:]
    return out


def brute(lists):
    """Every node by plain dictionaries of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in kids
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def plain(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_equals_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = QUERIES["op11_prefix_trie"](spark, folder)
    assert [f.name for f in result.schema] == COLUMNS
    assert plain(result) == brute(rebuilt(rows))


@pytest.mark.parametrize("block_turns, last_turns", [(1, 8), (7, 30), (40, 1_000_000)])
def test_small_blocks_are_merged_into_the_same_tree(spark, block_turns, last_turns):
    rng = random.Random(block_turns)
    rows = []
    for c in range(260):
        kind = rng.random()
        turns = ["hello"] * 9 if kind < 0.3 else [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 8))]
        rows += [(c, t, "user" if t % 2 else "", text) for t, text in enumerate(turns)]
    lists = crossed(turn_lists(made(spark, rows)))
    assert plain(prefix_trie(lists.repartition(5), block_turns, last_turns)) == brute(rebuilt(rows))


def test_edge_rows(spark):
    rows = [
        (0, 0, None, None), (0, 1, "", ""), (0, 1, "", ""), (0, None, "user", "first"), (0, 2, "user", "x" * 300_000), (0, 3, "u", "é😀"),
        (1, 5, "user", None), (1, 5, "user", "tie"), (1, None, None, "a"), (1, None, None, "a"), (None, 1, "user", "no conversation"),
        (7, 0, "user", "only"), (-3, 0, "a", "b"), (-3, 1, "a", "c"), (-205, 0, "a", "b"), (305, 0, "", "turnless maybe"), (306, 1, "", ""),
    ]
    long = [(900, t, "user", f"t{t % 7}") for t in range(150)] + [(901, t, "user", f"t{t % 7}") for t in range(150)]
    want = brute(rebuilt(rows + long))
    assert plain(prefix_trie(crossed(turn_lists(made(spark, rows + long))), block_turns=100)) == want
    assert any(r[1] == 0 and r[4] < len(rows) for r in want)
    assert prefix_trie(crossed(turn_lists(made(spark, [])))).count() == 0
    nobody = prefix_trie(crossed(turn_lists(made(spark, [(None, 1, "a", "b")]))))
    assert nobody.columns == COLUMNS and nobody.count() == 0


def test_median_insertion_visits_every_place_once():
    for n in (0, 1, 2, 7, 100):
        order = list(balanced_order(n))
        assert sorted(order) == list(range(n)) and (not n or order[0] == n // 2)
