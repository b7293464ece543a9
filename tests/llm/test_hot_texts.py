"""Inputs that make a filter meet itself: many items with one prompt, many values on one line, rules of many tokens."""

import resource
import time

import numpy as np

from llm_text import prose
from trajlytics.llm import decontaminate as dc
from trajlytics.llm import pseudonyms, url_rules


def index_of(items):
    index, table = dc.Index(dc.Q), dc.lower_table()
    for k, text in enumerate(items):
        index.add(k, dc.normal(dc.code_points(text), table)[0])
    return index.close(dc.EDIT_SHARE)


def test_items_with_one_prompt_keep_memory_bounded(monkeypatch):
    prompt = "question: which of the following statements is right? "
    items = [prompt + prose(k, 30) for k in range(2000)]
    index, table = index_of(items), dc.lower_table()
    text = (prompt + " ") * 60 + items[7] + " " + prose(5000, 60)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = dc.matches(dc.normal(dc.code_points(text), table)[0], index)
    assert [m[0] for m in found] == [7]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def test_slices_of_hits_change_nothing(monkeypatch):
    items = [prose(k, 12) for k in range(50)]
    index, table = index_of(items), dc.lower_table()
    codes = dc.normal(dc.code_points(" ".join(items[::7]) + prose(9, 50)), table)[0]
    whole = dc.matches(codes, index)
    monkeypatch.setattr(dc, "HITS", 5)
    monkeypatch.setattr(dc, "CELLS", 300)
    assert sorted(dc.matches(codes, index)) == sorted(whole) and len(whole) >= 8


def test_one_long_item_costs_its_own_length():
    index = index_of([prose(k, 10) for k in range(2000)] + [prose(1, 9000)])
    assert index.flat.nbytes == 4 * int(index.length.sum())


def test_many_dates_on_a_line_take_seconds():
    text = " ".join(f"19{k % 90 + 10}-0{k % 9 + 1}-1{k % 9}" for k in range(100_000))
    start = time.time()
    found = pseudonyms.find(text, b"key")
    assert len(found) == 100_000 and time.time() - start < 60
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))


def test_rules_of_more_than_three_tokens(spark):
    rows = [(["h:a", "h:b", "p:c", "p:d", "p:e"], True)] * 30
    rows += [([t for k, t in enumerate(["h:a", "h:b", "p:c", "p:d", "p:e"]) if k != out], False) for out in range(5) for _ in range(30)]
    rows += [(["h:z", "p:c"], True)] * 20
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = {tuple(r["tokens"]) for r in url_rules.mine(labelled).collect()}
    assert rules == {("h:a", "h:b", "p:c", "p:d", "p:e"), ("h:z",)}


def test_spans_by_bisection():
    rng, spans, kept = np.random.default_rng(3), pseudonyms.Spans([]), []
    for _ in range(400):
        a = int(rng.integers(0, 500))
        b = a + int(rng.integers(1, 9))
        free = all(b <= s or e <= a for s, e in kept)
        assert spans.add(a, b) == free
        if free:
            kept.append((a, b))
        assert spans.next_start(a, b) == min((s for s, _ in kept if a < s < b), default=None)
