"""Divergence against plain dictionaries; trees against dense sums."""

import re
from collections import Counter, defaultdict

import numpy as np

from llm_text import prose
from trajlytics.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=30, top=50):
    groups, within = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source, terms = r["lang"] or "", r["source"] or "", TERM.findall((r["text"] or "").translate(LOWER))
        groups[lang, source].update(terms)
        within[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in within[lang].items() if n >= min_docs]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(c, v=len(kept)):
            total = sum(c.values())
            return {t: 1 + 10**9 * (n + 5) // (total + 5 * v) for t, n in c.items()}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return out


def check(docs, **options):
    got = [tuple(r) for r in divergence.divergence(docs, **options).collect()]
    assert sorted(got) == sorted(plain(docs.collect(), **options))
    return got


def test_odd_and_empty_documents(odd_docs, no_docs):
    assert check(odd_docs)  # no term is in 30 documents: pairs of distance 0
    assert check(odd_docs, min_docs=2)
    assert check(no_docs) == []


def test_many_sources_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "SEGMENT", 8)
    rows = [(k, prose(k, 30) + " ÄÖ Straße x1y", "en" if k % 3 else "de", f"s{k % 11}" if k % 2 else "hot") for k in range(200)]
    rows += [(1, None, "fr", "a"), (2, "only here", "fr", "b"), (3, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'z' AS item", "1 AS value")
    found = check(docs)
    assert {r[2] for r in found} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in found
    assert any(len(r[3]) == 3 and r[0] == "de" for r in found if r[2] == "pair")


def test_consed_trees_price_equal_pairs_once():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.3, (12, 256)).astype(np.int64)
    counts[3] = counts[4]
    counts[:, 250:] = -1
    roots, leaves, levels = divergence.consed(counts)
    assert roots[3] == roots[4] and len(levels) == 8
    assert len(levels[0][0]) < 12 * 128 / 10  # few distinct pairs of small counts
    totals = np.maximum(counts, 0).sum(axis=1)
    shares = np.stack([divergence.whole_shares(leaves, int(t), 250, 5) for t in totals])
    dense = np.stack([divergence.whole_shares(c, int(t), 250, 5) for c, t in zip(counts, totals, strict=True)])
    for k in range(12):
        found = divergence.tree_distances(roots[k], roots, levels, shares[k], shares)
        assert found.tolist() == np.abs(dense[k] - dense).sum(axis=1).tolist()


def test_counts_beyond_64_bits(spark):
    big = np.array([10**12, 3, -1], np.int64)
    assert divergence.whole_shares(big, 10**12 + 3, 2, 5).tolist() == [1 + 10**9 * (10**12 + 5) // (10**12 + 13), 1 + 10**9 * 8 // (10**12 + 13), 0]
    row = spark.sql("SELECT 1000000000000L AS n, 1000000000003L AS total, 2L AS terms").select(divergence.share(*map(divergence.F.col, ("n", "total", "terms")))).first()
    assert row[0] == 1 + 10**9 * (10**12 + 5) // (10**12 + 13)
