"""Rows that every operator must bear: nulls, empty and very long texts, repeats and clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(60_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, "   \n\t ", "de", "b"),
    (None, "A text without an id that is long enough to have a few words in it, twelve.", "en", "a"),
    (None, None, None, None),
    (5, LONG, "en", "a"),
    (6, "x" * 300_000, "en", "c"),
    (7, "Zürich ünïcode 😀😀 text with émigré words, mail me: jürgen.x+1@mail-host.example.org now.", "de", "c"),
    (8, "The quick brown fox jumps over the lazy dog near the old river bank today.", "fr", "b"),
]
CLASH = ["n_words", "kept", "spans", "key", "rep", "component", "sketch", "start", "email", "items", "node", "_dropped", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in CLASH)


def documents(spark, rows=ROWS):
    """The rows with extra columns named like inner or output columns."""
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], SCHEMA)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
