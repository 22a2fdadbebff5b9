"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union by least id.

A document's set holds the distinct ``width``-word shingles of its whole text, A-Z lower-cased (a shorter text is one
shingle; no words, no set). Two documents are linked if 100 * intersection >= percent * union. The steps:

1. One scan gives each row its set's size and digest, a SuperMinHash signature cut into bands, and a short sketch.
2. Documents with equal sets form a class, and the one of least doc_id stands for it; copies are never paired.
3. Representatives that share a band meet in its bucket. Every member is verified against the least member on full
   sets: a star, not all pairs. The least members of the buckets of one group are few, so the pairs are few too.
4. In buckets that then still hold several groups, a second star starts from the member that meets most others.
5. What is still open is settled for all: members apart from the centre's group meet the others of their bucket in
   blocks of bounded size, where sketches are compared, and likely pairs of different groups are verified.
6. Groups are the connected components of the links; component_id is the least doc_id reachable.

Candidates are lost only by chance: bands 40 of 6 rows miss a pair at 0.8 with probability 5e-6, and the sketch
limit lies over five standard deviations below 0.8.

Null or empty text: no set, linked with nothing, its own component. Null doc_id: no node; component_id null, kept.
Rows that share a doc_id are one node with the links of all its texts. An empty table gives no rows. Other columns
are not read by the search and are kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import GOLDEN, U64, extend_rows, map_rows, mixed, require, window_hashes, word_hashes
from casegrid.llm.components import least_reachable
from casegrid.session import cut_lineage

SIGNATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"
SKETCH = 128
#: Shingles that a task signs at a time, and representatives of a block whose sketches are compared.
CHUNK_SHINGLES = 100_000
#: Sets that a task signs at a time.
CHUNK_SETS = 4000
BLOCK = 1000
BLOCK_BYTES = 8_000_000


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=U64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(width, len(hashes))))


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, size: int) -> np.ndarray:
    """Signatures (n_sets x size) of the sets whose elements are given with their owners.

    Step j gives each element a value in [j, j + 1) at the j-th place of its own random permutation. A set whose
    places are all taken is finished, since later values are larger; large sets stop after a step or two.
    The permutation of an element is drawn swap by swap; the place of a step is found by going back over its swaps.
    """
    empty = np.iinfo(np.uint64).max
    signature = np.full(n_sets * size, empty, dtype=U64)
    swaps: list[np.ndarray] = []
    alive = np.bincount(owner, minlength=n_sets) > 0
    for j in range(size):
        with np.errstate(over="ignore"):
            random = mixed(elements + U64(j + 1) * GOLDEN)
        place = (j + (((random & U64(0xFFFFFFFF)) * U64(size - j)) >> U64(32)).astype(np.int64)).astype(np.int16)
        at = place.copy()
        for i in range(j - 1, -1, -1):
            at[swaps[i] == at] = i
        swaps.append(place)
        np.minimum.at(signature, owner * size + at, (U64(j) << U64(32)) | (random >> U64(32)))
        sets = np.flatnonzero(alive)
        finished = sets[(signature.reshape(n_sets, size)[sets] != empty).all(axis=1)]
        if len(finished):
            alive[finished] = False
            if not alive.any():
                break
            stay = alive[owner]
            elements, owner, swaps = elements[stay], owner[stay], [s[stay] for s in swaps]
    return signature.reshape(n_sets, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * GOLDEN, parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mixed(key * U64(31) + parts[:, :, r])
    return key.view(np.int64)


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set size, set digest, band keys and sketch of every row."""
    size = max(bands * rows, SKETCH)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        def signed(ids: list, sets: list[np.ndarray]) -> dict[str, list]:
            counts = [len(s) for s in sets]
            signature = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), counts), len(sets), size)
            keys = band_keys(signature, bands, rows)
            short = (signature[:, :SKETCH] & U64(0xFFFF)).astype("<u2")
            return {
                "doc_id": ids,
                "n_shingles": counts,
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "bands": [k if n else [] for k, n in zip(keys, counts, strict=True)],
                "sketch": [s.tobytes() if n else None for s, n in zip(short, counts, strict=True)],
            }

        ids: list = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(doc)
                sets.append(shingles(text, width))
                held += len(sets[-1])
                if held >= CHUNK_SHINGLES or len(sets) >= CHUNK_SETS:
                    yield signed(ids, sets)
                    ids, sets, held = [], [], 0
        if sets:
            yield signed(ids, sets)

    return map_rows(docs, SIGNATURES, run)


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, common, total): sizes of intersection and union of the full sets of each pair."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = cut_lineage(pairs).join(left, "a").join(right, "b")

    def start():
        recent: dict[bytes, np.ndarray] = {}  # a centre's text comes again and again

        def set_of(text: bytes) -> np.ndarray:
            found = recent.get(text)
            if found is None:
                if len(recent) >= 32:
                    recent.clear()
                found = recent[text] = shingles(text, width)
            return found

        def work(batch: dict[str, list]) -> dict[str, list]:
            common, total = [], []
            for ta, tb in zip(batch["text_a"], batch["text_b"], strict=True):
                x, y = set_of(ta), shingles(tb, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                total.append(len(x) + len(y) - both)
            return {"common": common, "total": total}

        return work

    return extend_rows(rows, ["text_a", "text_b"], "common long, total long", start, ("text_a", "text_b"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets, written."""
    checked = overlaps(pairs, texts, width).filter(100 * F.col("common") >= percent * F.col("total"))
    return cut_lineage(checked.select("a", "b").distinct())


def settled(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different groups of one bucket, at least one of the two apart from the centre's group.

    Rows: key, rep, component, apart. The members apart and the others of a bucket are cut into blocks of about
    ``BLOCK`` members or ``BLOCK_BYTES`` of text; a block of members apart meets each block of its bucket in a task of
    its own. There sketches are compared all at once, and likely pairs are verified on full sets on the spot, so that
    only links leave the task. Pairs that a link of the same task has already joined are passed over.
    """
    sized = members.join(texts.select(F.col("doc_id").alias("rep"), "bytes"), "rep")
    many = lambda side: F.ceil(F.greatest(F.count_if(side) / BLOCK, F.coalesce(F.sum(F.when(side, F.col("bytes"))), F.lit(0)) / BLOCK_BYTES)).cast("int")
    blocks = cut_lineage(sized.groupBy("key").agg(many(F.col("apart")).alias("parts"), many(~F.col("apart")).alias("others")))
    placed = members.join(blocks, "key")
    own = F.when(F.col("apart"), F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.col("parts") + F.pmod(F.xxhash64("rep"), F.col("others"))).cast("int")
    # block i is apart; j is any block not before it, so that each two blocks meet once
    first = F.when(F.col("apart"), F.sequence(F.col("block"), F.col("parts") + F.col("others") - 1))
    as_first = F.transform(first, lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    before = F.when(F.col("apart"), F.col("block")).otherwise(F.col("parts"))
    as_second = F.when(before > 0, F.transform(F.sequence(F.lit(0), before - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))))
    none = F.array().cast("array<struct<i:int,j:int>>")
    meets = F.concat(F.coalesce(as_first, none), F.coalesce(as_second, none))
    met = placed.withColumn("block", own).select("key", "rep", "component", "block", F.inline(meets))
    met = cut_lineage(met).join(texts.select(F.col("doc_id").alias("rep"), "text", "sketch"), "rep")
    enough = int(SKETCH * (percent / 100 - 0.2))

    def compare(keys, group):
        rep, component = group["rep"].to_pylist(), group["component"].to_pylist()
        short = group["sketch"].to_pylist()
        sketch = np.frombuffer(b"".join(k or bytes(2 * SKETCH) for k in short), dtype="<u2").reshape(-1, SKETCH)
        unknown = np.array([k is None for k in short])
        sets = [shingles(t.encode("utf-8"), width) for t in group["text"].to_pylist()]
        size = np.array([len(s) for s in sets])
        block = group["block"].to_numpy()
        i, j = keys[1].as_py(), keys[2].as_py()
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        up = {c: c for c in component}

        def top(c: int) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        a, b = [], []
        for x in first:
            least, most = np.minimum(size[second], size[x]), np.maximum(size[second], size[x])
            alike = ((sketch[second] == sketch[x]).sum(axis=1) >= enough) | unknown[second] | unknown[x]
            likely = alike & (100 * least >= percent * most)
            for y in second[likely]:
                p, q = top(component[x]), top(component[y])
                if p == q or (i == j and y <= x):
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    up[max(p, q)] = min(p, q)
                    a.append(rep[x])
                    b.append(rep[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut_lineage(met.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").select(*unordered("a", "b")).distinct())


def grouped(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one group, with their ``component``, written."""
    named = members.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = cut_lineage(named)
    open_ = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return cut_lineage(named.join(cut_lineage(open_), "key", "left_semi"))


def unordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def find_groups(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    require(docs, "doc_id", "text")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut_lineage(sign(given, width, bands, rows))
    classes = cut_lineage(signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")))

    reps = signed.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["doc_id", "set_key"], "left_semi")
    entries = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    members = cut_lineage(entries.join(cut_lineage(shared.select("key", "low")), "key").distinct())
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    short = signed.filter("sketch is not null").join(wanted, "doc_id", "left_semi").groupBy("doc_id")
    # an id with several texts has no one sketch: its texts always go on to verification
    short = short.agg(F.when(F.min("set_key") == F.max("set_key"), F.max("sketch")).alias("sketch"))
    texts = cut_lineage(given.filter("text is not null").join(short, "doc_id").withColumn("bytes", F.octet_length("text")))

    # first stars: the least member of each bucket
    tried = cut_lineage(members.filter("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct())
    links = verified(tried, texts, width, percent)
    components = least_reachable(links)

    # second stars, in buckets of several groups: the member that meets most others
    open_ = grouped(members.select("key", "rep"), components)
    if not open_.isEmpty():
        size = open_.groupBy("key").agg(F.count("*").alias("n"))
        standing = cut_lineage(open_.join(size, "key").groupBy("rep").agg(F.sum("n").alias("met")))
        ranked = cut_lineage(open_.join(standing, "rep"))
        most = ranked.groupBy("key").agg(F.max("met").alias("met"))
        centre = cut_lineage(ranked.join(most, ["key", "met"]).groupBy("key").agg(F.min("rep").alias("centre")))
        starred = cut_lineage(open_.join(centre, "key"))
        across = starred.join(open_.select("key", F.col("rep").alias("centre"), F.col("component").alias("middle")), ["key", "centre"])
        pairs = across.filter("component != middle").select(*unordered("rep", "centre")).distinct()
        links = links.union(verified(pairs.join(tried, ["a", "b"], "left_anti"), texts, width, percent))
        components = least_reachable(links)

        # what is still open: members apart from the centre's group against all others of their bucket
        rest = grouped(starred.select("key", "rep", "centre"), components)
        if not rest.isEmpty():
            middle = rest.select("key", F.col("rep").alias("centre"), F.col("component").alias("middle"))
            apart = rest.join(middle, ["key", "centre"]).select("key", "rep", "component", (F.col("component") != F.col("middle")).alias("apart"))
            more = settled(cut_lineage(apart), texts, width, percent)
            if not more.isEmpty():
                components = least_reachable(links.union(more))

    whole = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    whole = whole.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    named = whole.select("doc_id", "n_shingles", component.alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, **settings) -> DataFrame:
    """The documents with one of each group, in their own columns; rows with null doc_id all stay."""
    dropped = find_groups(docs, width, percent, **settings).filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_dropped"], "left_anti")
