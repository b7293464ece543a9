"""Attention over passages: held-out accuracy, gradients against differences, pieces of long texts, odd rows."""

import zlib

import numpy as np

from llm_text import prose
from trajlytics.llm import passage_quality as pq
from trajlytics.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = pq.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in known]
    right = [r["predicted"] == known[r["doc_id"]] for r in held]
    assert len(held) > 50 and np.mean(right) >= 0.93
    good = [r["score"] for r in held if known[r["doc_id"]]]
    bad = [r["score"] for r in held if not known[r["doc_id"]]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_held_out_labels_do_not_matter(spark, docs_of):
    docs = docs_of([(k, prose(k) if k % 2 else "!!! ### " * 40) for k in range(60)])
    rows = [(k, k % 2) for k in range(60)]
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in rows]
    nets = [pq.fit(docs, spark.createDataFrame(r, "doc_id long, quality int")) for r in (rows, flipped)]
    assert all(np.array_equal(nets[0][k], nets[1][k]) for k in pq.SHAPES)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = pq.blank_net() | {k: rng.normal(0, 0.4, pq.SHAPES[k]) for k in ("w1", "b1", "v", "u", "w", "c", "b")}
    x, bag, y = rng.normal(size=(9, pq.SIZE)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        h, _, _, e = pq.represent(net, x)
        total = 0.0
        for k in range(4):
            a = np.exp(e[bag == k])
            s = pq.sigmoid((a / a.sum()) @ h[bag == k] @ net["c"] + net["b"][0])
            total -= y[k] * np.log(s) + (1 - y[k]) * np.log(1 - s)
        return total / 4

    found = pq.gradients(net, x, bag, y)
    for name, g in found.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 6)]:
            was = net[name][at]
            net[name][at] = was + 1e-6
            up = loss()
            net[name][at] = was - 1e-6
            down = loss()
            net[name][at] = was
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5, name


def test_passages_of_a_part_do_not_depend_on_its_neighbours():
    powers = pq.hash_powers()
    texts = [prose(k, n).encode() for k, n in enumerate((3, 64, 65, 500))] + [b"", b" \n ", b"\n\nlate start\n", "ä 漢字".encode() * 9]
    x, owner = pq.encoded(list(enumerate(texts)), powers)
    for k, t in enumerate(texts):
        alone, _ = pq.encoded([(0, t)], powers)
        assert np.abs(x[owner == k] - alone).max() < 1e-6 and len(alone) == max(1, -(-len(t.split()) // pq.WORDS))


def test_long_texts_and_odd_rows(spark, odd_docs, no_docs, docs_of, monkeypatch):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (6, 1), (7, 0)], "doc_id long, quality int")
    found = pq.classify(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {True}
    assert pq.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in pq.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    net = pq.fit(odd_docs, labels)
    docs = docs_of([(1, prose(1, 40_000)), (2, prose(2))])
    whole = {r["doc_id"]: r["score"] for r in pq.score(docs, net).collect()}
    assert len(list(pq.pieces(prose(1, 200_000).encode()))) > 1 and b"".join(pq.pieces(prose(1, 90_000).encode())) == prose(1, 90_000).encode()
    assert set(whole) == {1, 2}
