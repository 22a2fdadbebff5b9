"""Benchmark decontamination with one word-level phrase automaton.

Test texts and documents are normalised alike: A-Z to a-z, words are runs of letters, digits and non-ASCII
characters. Every window of ``window`` consecutive item words (an item of fewer words is one window) is a key of one
Aho-Corasick automaton, which reads each whole document once. Normalising keeps byte positions, so hit words are
mapped back to code point spans of the original text.

The test set travels with the tasks. Its size is measured first: up to ``block_bytes`` it is one automaton and the text
is read once. A larger one is cut into blocks of that size, and the documents are written to the shared folder with the
hits of a block before the next block is read, so neither the driver nor a task ever holds more than one block; the
passes then grow with the test set.

Null or empty text (of document or item): no words, nothing hit. Items with null id are left out; items that share
an id count once. Repeated document rows are judged each by itself. An empty table gives no rows; an empty test set
hits nothing. Other columns of the documents are kept; ones named like an output are replaced.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import extend_rows, neutral, require
from casegrid.session import cut_lineage

FOUND = "n_words long, n_hit long, items array<long>, spans array<struct<start: long, end: long>>"

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every ASCII character outside a word into a space; other bytes stay.
NORMAL = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def spaced(text: bytes) -> tuple[str, int]:
    """Words with one space before and after each, one character per byte; and their number."""
    words = text.translate(NORMAL).split()
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


def windows(text: bytes, width: int) -> list[str]:
    words = text.translate(NORMAL).decode("latin-1").split(" ")
    words = [w for w in words if w]
    if not words:
        return []
    return [f" {' '.join(words[i : i + width])} " for i in range(max(1, len(words) - width + 1))]


def build(items: list[tuple[int, bytes]], width: int) -> ahocorasick.Automaton:
    owners: dict[str, set[int]] = {}
    for item, text in items:
        for key in windows(text, width):
            owners.setdefault(key, set()).add(item)
    automaton = ahocorasick.Automaton()
    for key, ids in owners.items():
        automaton.add_word(key, (len(key), frozenset(ids)))
    if owners:
        automaton.make_automaton()
    return automaton


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of each word in the original text."""
    inside = np.frombuffer(text.translate(NORMAL), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def scan(automaton: ahocorasick.Automaton, text: bytes) -> tuple[int, np.ndarray | None, set[int]]:
    """Number of words, which of them are hit (None: none) and the items found."""
    flat, n = spaced(text) if text else ("", 0)
    if not n or not len(automaton):
        return n, None, set()
    items: set[int] = set()
    marks = None
    for end, (length, owners) in automaton.iter(flat):
        if marks is None:
            blanks = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), dtype=np.uint8) == 0x20)
            marks = np.zeros(n + 1, dtype=np.int64)
        marks[np.searchsorted(blanks, end - length + 1)] += 1
        marks[np.searchsorted(blanks, end)] -= 1
        items |= owners
    return n, None if marks is None else np.cumsum(marks[:-1]) > 0, items


def spans_of(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of the runs of hit words."""
    starts, ends = word_bounds(text)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    points = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    before = np.concatenate(([0], points))
    return [(int(before[starts[a]]), int(before[ends[b - 1]])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def hit_words(text: bytes, spans: list[dict]) -> np.ndarray:
    """The inverse of ``spans_of``: which words earlier blocks have hit."""
    starts, _ = word_bounds(text)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))[starts]
    hit = np.zeros(len(starts), dtype=bool)
    for s in spans:
        hit |= (points >= s["start"]) & (points < s["end"])
    return hit


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32_000_000, keep_text: bool = True) -> DataFrame:
    """The documents with n_words, n_hit, items (sorted ids) and spans of hit words in the original text."""
    require(docs, "text")
    require(benchmark, "item_id", "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    out = docs.withColumn("text", F.col("text").cast("string"))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        held = [(r["item_id"], r["text"].encode("utf-8")) for r in part.collect()]
        before = [] if block == 0 else ["n_hit", "items", "spans"]
        drop = ("text",) if block == blocks - 1 and not keep_text else ()
        out = extend_rows(out, ["text", *before], FOUND, _scanner(held, window), drop)
        if block < blocks - 1:
            out = cut_lineage(out)
    return out


def _scanner(held: list[tuple[int, bytes]], window: int):
    def start():
        automaton = build(held, window)

        def judged(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items", "spans")}
            for i, text in enumerate(batch["text"]):
                n, hit, items = scan(automaton, text or b"")
                if "n_hit" in batch and batch["n_hit"][i]:
                    items |= set(batch["items"][i])
                    earlier = hit_words(text, batch["spans"][i])
                    hit = earlier if hit is None else hit | earlier
                out["n_words"].append(n)
                out["n_hit"].append(0 if hit is None else int(hit.sum()))
                out["items"].append(sorted(items))
                out["spans"].append([] if hit is None else [{"start": a, "end": b} for a, b in spans_of(text, hit)])
            return out

        return judged

    return start


def passage_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents that hold no passage of the test set, with their own columns in their own order."""
    plain, names = neutral(docs, "text")
    found = find_passages(plain, benchmark, window).filter(F.col("n_hit") == 0)
    return found.select(*plain.columns).toDF(*names)
