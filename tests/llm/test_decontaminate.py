import hashlib
import random
import re

from casegrid.llm.decontaminate import clean_documents, find_passages, passage_digests
from tests.llm import edges

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        if words and item is not None:
            for i in range(max(1, len(words) - width + 1)):
                windows.setdefault(tuple(words[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        found = list(WORD.finditer(lower(text)))
        words = [m[0] for m in found]
        hit, ids = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    ids |= owners
        listed = ",".join(sorted(map(str, ids)))
        spans, last = [], None
        for i in sorted(hit):
            if last is not None and i == last + 1:
                spans[-1] = (spans[-1][0], found[i].end())
            else:
                spans.append((found[i].start(), found[i].end()))
            last = i
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit), spans))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "x1", "42", "ÉPSILON", "zeta"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(10, 25))) for i in range(30)] + [(30, "short item here"), (31, None), (32, ""), (None, text(12)), (30, "other text of the same id"), (33, "...")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += [(200 + i, f"{text(7)} {t} {text(5)}") for i, (_, t) in enumerate(items) if t]
    docs += [(300, "So a SHORT; item. here!"), (301, None), (302, ""), (None, items[0][1]), (303, items[1][1] * 3)]
    return docs, items


def test_equals_brute_force_in_one_and_in_many_blocks(spark):
    docs, items = cases()
    frame = edges.plain(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=repr)
    for block in (32_000_000, 300):
        found = find_passages(frame, bench, block_bytes=block)
        digests = sorted((tuple(r) for r in passage_digests(found).collect()), key=repr)
        assert digests == sorted((w[:6] for w in want), key=repr)
        spans = {(r.doc_id, r.text): [(s.start, s.end) for s in r.spans] for r in found.collect()}
        for (doc, text), (d, *_, expected) in zip(docs, brute(docs, items), strict=True):
            assert doc == d and spans[doc, text] == expected


def test_clean_documents_keeps_columns_and_rows(spark):
    docs = edges.documents(spark)
    bench = spark.createDataFrame([(1, "the quick BROWN fox, jumps over the lazy dog near the old mill")], "item_id long, text string")
    kept = clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    want = sorted((r for r in docs.collect() if not (r.text or "").startswith("The quick")), key=repr)
    assert sorted(kept.collect(), key=repr) == want
    assert clean_documents(docs, bench.limit(0)).count() == len(edges.ROWS)
    assert clean_documents(docs.limit(0), bench).count() == 0
