import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrid.llm.personal_data import KINDS, find, mask, span_digests
from tests.llm import edges

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    text = text or ""
    kinds = [k for k in KINDS if k != "email" or "@" in text]  # the plain pattern takes quadratic time in long words
    return [(k, m.start(), m.end()) for k in kinds for m in PATTERNS[k].finditer(text) if good(k, m[0])]


def row(text):
    spans = brute(text)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest())


def digests(spark, texts):
    frame = edges.plain(spark, list(enumerate(texts)))
    return {r.doc_id: tuple(r[1:6]) for r in span_digests(find(frame)).collect()}


HARD = [
    "a@b.c@d.e a@b.c_x@d.e.f @x.y a@-.- a@b a@b. a@b.c. ..@..a %@a.b",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 1.2.3.4. 99999999999999999999.1.1.1 0.0.0.0",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 4111111111111111 2 5500005555555559",
    "+1 (988) 555-2485 +1 2 +12345678 +1234567890123456 + 1 +1..2..3..4..5..6..7 +49 (0)30 1234567 +1+2345678901",
    "😀 é 10.0.0.1 😀 x.y@z.example.com 😀 +4 4444 4444 a+b@c.d+e@f.g",
    "x" * 3_000 + "@a.b " + "9" * 3_000 + " " + "a.b" * 1_000,
    " ".join("10.0.0.1" for _ in range(3000)),
]


def test_base_spans_equal_brute_force(spark):
    texts = HARD + [None, ""] + [r[1] for r in edges.ROWS]
    made = digests(spark, texts)
    for i, text in enumerate(texts):
        assert made[i] == row(text), text and text[:80]


@pytest.mark.parametrize("seed", [0])
def test_random_strings_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("a1.@+- ()9_\n😀Z25") for _ in range(rng.randint(0, 120))) for _ in range(1000)]
    made = digests(spark, texts)
    assert [made[i] for i in range(len(texts))] == [row(t) for t in texts]


def test_contexts_discover_open_identifiers_and_base_spans_stay(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    docs = [(i, f"Please reach wanda at +1 ({digits(3)}) 555-{digits(4)} before noon.") for i in range(40)]
    docs += [(100, "Please reach wanda at 020-7946-0958 before noon."), (101, "Version 2024-11-02 came out by 020-7946-0958 or so.")]
    docs += [(200 + i, f"The plan of {digits(6)} is old") for i in range(20)]
    docs += [(300 + i, f"wrote of {digits(2)}@host{i}.example.org is old") for i in range(3)]
    found = {r.doc_id: r for r in find(edges.plain(spark, docs)).collect()}
    text = docs[40][1]
    start = text.index("020")
    assert [tuple(s) for s in found[100].spans] == [(4, "phone", start, start + 13)]
    assert not found[100].base and not found[101].spans and not found[205].spans
    for doc, text in docs:
        base = [(s.kind, s.start, s.end) for s in found[doc].base]
        assert base == brute(text) and set(base) <= {(s.kind, s.start, s.end) for s in found[doc].spans}


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    docs = edges.documents(spark)
    found = span_digests(find(docs)).collect()
    assert sorted(map(repr, [tuple(r[:6]) for r in found])) == sorted(map(repr, [(r[0], *row(r[1])) for r in edges.ROWS]))
    assert find(docs.limit(0)).count() == 0
    hidden = mask(docs)
    assert hidden.schema == docs.schema and hidden.count() == len(edges.ROWS) and mask(docs.limit(0)).count() == 0
    by_id = {r.doc_id: r for r in hidden.collect()}
    assert "mail me: jürgen" not in by_id[7].text and by_id[7].text == "Zürich ünïcode 😀😀 text with émigré words, mail me: jü[EMAIL] now."
    assert by_id[7].n_chars == len(by_id[7].text) and by_id[2].text is None and by_id[3].text == "" and by_id[5].text == edges.LONG


def masked_plainly(text):
    out, at = "", 0
    for start, end, kind in sorted((a, b, k) for k, a, b in brute(text)):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_mask_equals_brute_force(spark):
    texts = HARD[:5] + [r[1] for r in edges.ROWS if r[1]]
    made = {r.doc_id: r.text for r in mask(edges.plain(spark, list(enumerate(texts)))).collect()}
    assert [made[i] for i in range(len(texts))] == [masked_plainly(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789", min_size=1, max_size=25))
def test_luhn_helper_of_the_tests(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    assert luhn(digits) == (sum(d // 10 + d % 10 for d in doubled) % 10 == 0)


def test_found_identifiers_seed_contexts_of_their_own(spark):
    """Three hops: seeds back the first context, what it finds backs the second, what that finds backs the third."""
    rng = random.Random(6)
    number = lambda: "0" + "-".join("".join(rng.choice("0123456789") for _ in range(n)) for n in (2, 4, 4))
    texts = [f"Please reach wanda at +1 (212) 555-{i:04} before noon." for i in range(150)]
    first, second, plain, last = [number() for _ in range(30)], [number() for _ in range(6)], [number() for _ in range(20)], number()
    texts += [f"Please reach wanda at {n} before noon." for n in first]
    texts += [f"Extension quartz line {n} belongs here." for n in [*first, *second]]
    texts += [f"Our velvet desk {n} answers always." for n in [*second, last]]
    texts += [f"Some part {n} was sold." for n in [*plain, *first[:5]]]
    rows = list(enumerate(texts))
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in find(edges.plain(spark, rows)).collect()}
    for i, text in rows[150:]:
        numbers = re.findall(r"0[0-9]{2}-[0-9]{4}-[0-9]{4}", text)
        assert len(numbers) == 1 and found[i] == ([] if text.startswith("Some part") else [("phone", numbers[0])]), text
