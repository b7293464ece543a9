"""Near copies of the pipeline against all pairs."""

import random

import corpus_pipeline
import numpy as np
from trajlytics.llm import common, near_copies

from llm_text import prose


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def kept_ids(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    lead = {}
    for k, (i, _) in enumerate(rows):
        lead[find(k)] = min(i, lead.get(find(k), i))
    return sorted(lead.values())


def changed(text, n, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def test_the_stage_removes_what_is_alike_in_five_words(spark, docs_of):
    rng = random.Random(6)
    rows = [(k, prose(k, 150)) for k in range(40)] + [(50, None), (51, " \n"), (52, "a b"), (53, "A  b"), (54, "a c")]
    for k in range(40):
        rows += [(100 + k, changed(rows[k][1], 1 + k % 5, rng)), (200 + k, changed(rows[k][1], 12, rng))]
    docs = docs_of(rows)
    want = kept_ids(rows)
    assert len(want) < 100
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == want


def test_large_classes_are_verified_in_chunks(spark):
    rng = random.Random(7)
    rows = [(k, changed(prose(k % 3, 120), rng.randrange(4), rng)) for k in range(90)]
    texts = spark.createDataFrame([(1, i, t.encode()) for i, t in rows], "root long, node long, text binary").repartition(4)
    for chunk in (512, 11):
        named = {r["node"]: r["root"] for r in near_copies.components(near_copies.verified_links(near_copies.shingle_sets(texts), chunk=chunk)).collect()}
        assert sorted({named.get(i, i) for i, _ in rows}) == kept_ids(rows)


def test_bands_hold_the_similar_pairs():
    rng, factors = np.random.default_rng(1), near_copies.multipliers()
    met = 0
    for _ in range(400):
        common, own = rng.integers(0, 1 << 64, 80, np.uint64), rng.integers(0, 1 << 64, (2, 10), np.uint64)
        a, b = (near_copies.band_keys(np.concatenate([common, x]), factors) for x in own)
        met += (a == b).any()
    assert met >= 396


def test_odd_rows_stay_once(odd_docs, no_docs):
    kept = near_copies.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema and near_copies.keep_one(no_docs).count() == 0
    rows = kept.collect()
    # the copy of text 1, its repeated row and the texts without words leave one document each; the null id with a text stays
    assert sorted((r["doc_id"] for r in rows), key=str) == [1, 3, 6, 7, 7, 8, None]
    assert sum(r["doc_id"] is None and r["text"] is not None for r in rows) == 1


def test_rows_with_texts_are_not_shuffled_and_both_ways_agree(odd_docs, docs_of, monkeypatch):
    rng = random.Random(9)
    docs = docs_of([(k, changed(prose(k % 20, 120), k // 20, rng)) for k in range(60)]).unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.union(docs.limit(9))
    kept = near_copies.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffles) <= 1  # repeated rows only
    small = sorted(map(repr, kept.collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, near_copies.keep_one(docs).collect())) == small
