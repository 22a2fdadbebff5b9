import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casegrid.llm.binary_packing import best_fit, pack_binary
from casegrid.llm.cost_packing import balanced, capacities, pack, piece_digests
from casegrid.llm.tokens import default_vocabulary, encoder
from tests.llm import edges

LENGTHS = st.lists(st.integers(1, 900), max_size=60)


def reference_ids(texts):
    plain = Tokenizer.from_file(default_vocabulary())
    plain.encode_special_tokens = True
    return [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer_library(spark):
    texts = [r[1] for r in edges.ROWS if r[1]] + [
        "<|endoftext|> a b\r\n\t c   d\n\n\n", "it's we'll I'd 've", "1234567890 ½ ² ١٢٣", "日本語テキスト 한국어 ไทย", "é ‍﻿ \x00\x01", " " * 5000 + "x", "é" * 3000, "퟿\U0001f9d1‍\U0001f4bb",
    ]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    made = encoder(default_vocabulary())
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert made(text).tolist() == ids


@settings(max_examples=60, deadline=None)
@given(LENGTHS)
def test_balanced_pieces_cover_every_id_once_without_gaps(lengths):
    pieces, cost = balanced(lengths, 64, 1.0, 1.0 / 16)
    room = capacities(sum(lengths), 64)
    assert sum(room) == sum(lengths) and all(r == 64 or r & (r - 1) == 0 for r in room)
    spans = defaultdict(list)
    fills = defaultdict(list)
    for p in pieces:
        spans[p.doc].append((p.start, p.start + p.length))
        fills[p.sequence].append((p.offset, p.offset + p.length))
    for doc, n in enumerate(lengths):
        at = 0
        for a, b in sorted(spans[doc]):
            assert a == at
            at = b
        assert at == n
    for s, r in enumerate(room):
        at = 0
        for a, b in sorted(fills[s]):
            assert a == at
            at = b
        assert at == r
    assert len(cost) == len(room)


def test_costs_are_even():
    rng = np.random.default_rng(1)
    lengths = [int(n) for n in rng.integers(10, 500, 4000)]
    _, cost = balanced(lengths, 2048, 1.0, 1.0 / 256)
    in_order, fill = [0.0], 0
    for n in lengths:
        while n:
            part = min(n, 2048 - fill)
            in_order[-1] += part + part * part / 256
            fill, n = (fill + part) % 2048, n - part
            if not fill:
                in_order.append(0.0)
    full = capacities(sum(lengths), 2048).count(2048)
    assert np.std(cost[:full]) < 0.5 * np.std(in_order[:full])


def test_pack_round_trip_and_edges(spark):
    docs = edges.documents(spark)
    rows = pack(docs, group_tokens=20_000).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in edges.ROWS}
    want = sorted(tuple(i) + (1,) for i in reference_ids([r[1] or "" for r in edges.ROWS]))
    # rows with the same id are told apart by where their pieces start anew
    by_task = defaultdict(list)
    for r in rows:
        by_task[r.doc_id].append(r)
    got = []
    for group in by_task.values():
        parts = defaultdict(list)
        for r in group:
            parts[r.start].append(r)
        copies = len(parts[0])
        for c in range(copies):
            ids: tuple = ()
            while len(ids) < parts[0][c].doc_tokens:
                r = next(x for x in parts[len(ids)] if x.doc_tokens == parts[0][c].doc_tokens)
                ids += tuple(np.frombuffer(r.ids, "<u4").tolist())
            got.append(ids)
    assert sorted(got) == want
    fills = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        fills[r.sequence_id].append((r.offset, r.length))
    for parts in fills.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    digests = piece_digests(pack(docs, group_tokens=20_000)).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(r.ids) for r in rows)
    assert pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(LENGTHS)
def test_best_fit_takes_the_least_room(lengths):
    made = best_fit(lengths, 128)
    pieces = sorted(((min(128, n - a), d, a) for d, n in enumerate(lengths) for a in range(0, n, 128)), key=lambda p: -p[0])
    room: list[int] = []
    for n, _, _ in pieces:
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(128 - n)
    assert sorted(128 - sum(n for _, _, n in s) for s in made) == sorted(room)
    assert sorted((d, a, n) for s in made for d, a, n in s) == sorted((d, a, n) for n, d, a in pieces)


def test_binary_rows_round_trip(spark):
    docs = edges.documents(spark)
    rows = pack_binary(docs, group_tokens=20_000).collect()
    pieces = defaultdict(list)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any()
        for doc, at, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces[doc].append((at, ids[a:b].tolist()))
    texts = defaultdict(list)
    for r in edges.ROWS:
        texts[r[0]].append(r[1] or "")
    for doc, own in texts.items():
        want = sorted(x for ids in reference_ids(own) for x in [*ids, 1])
        assert sorted(x for _, part in pieces[doc] for x in part) == want
    long = sorted(pieces[5])
    assert sum((part for _, part in long), []) == [*reference_ids([edges.LONG])[0], 1]
    assert pack_binary(docs.limit(0)).count() == 0
