from collections import defaultdict

import numpy as np

import corpus_pipeline
from casegrid.llm.quality_forest import judged_documents
from tests.llm import edges
from tests.llm.test_decontaminate import brute as brute_passages
from tests.llm.test_near_duplicates import brute as brute_groups
from tests.llm.test_packing import reference_ids
from tests.llm.test_personal_data import masked_plainly
from tests.llm.test_quality import plain_counts

SF = "/root/testdata/sf0.001"


def stages_by_hand(spark, docs):
    """What each stage should leave, by plain loops; the forest's verdict is taken from the operator."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = defaultdict(list)
    for r in judged_documents(docs, labels).collect():
        verdict[r.doc_id].append(r.kept)
    rows = docs.collect()
    left = []
    for r in rows:
        n, *_, repeat = plain_counts(r.text)
        if n >= 10 and 100 * repeat <= 20 * n and all(verdict[r.doc_id]):
            left.append(r)
    yield left
    dropped = {d for d, _, _, kept in brute_groups([(r.doc_id, r.text) for r in left], 5) if not kept}
    left = [r for r in left if r.doc_id not in dropped]
    yield left
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute_passages([(r.doc_id, r.text) for r in left], items)
    left = [r for r, h in zip(left, hit, strict=True) if not h[5]]
    yield left
    left = [type(r)(**(r.asDict() | {"text": (t := masked_plainly(r.text)), "n_chars": len(t)})) for r in left]
    yield left


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


def test_stages_equal_the_plain_version_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES, stages_by_hand(spark, docs), strict=False):
        made = stage(spark, at, SF)
        assert made.columns == docs.columns
        assert same(made.collect(), want)
        at = spark.createDataFrame(want, docs.schema)
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = defaultdict(dict)
    for r in rows:
        ids[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    got = {d: sum((parts[s] for s in sorted(parts)), []) for d, parts in ids.items()}
    assert got == {r.doc_id: [*i, 1] for r, i in zip(want, reference_ids([r.text for r in want]), strict=True)}


def test_stages_bear_odd_rows_and_empty_tables(spark):
    docs = edges.documents(spark)
    for docs in (docs, docs.limit(0)):
        at = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == docs.columns
                at = spark.createDataFrame(at.collect(), at.schema)
        assert at.count() >= 0
