"""Repeated passages against plain dictionaries, and cuts of overlapping spans."""

import random
import re

from llm_text import prose
from trajlytics.llm import line_dedup


def plain(rows, least):
    """(doc_id, start, end) of every run of sentences of at least `least` words that is not the first of its kind."""
    seen, out = {}, set()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts, at = [], 0
        for piece in re.split(r"(?<=\n)|(?<=[.!?] )(?! )", text or ""):
            words = piece.lower().split()
            if words:
                parts.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip()), words))
            at += len(piece)
        for k in range(len(parts)):
            words, j = [], k
            while len(words) < least and j < len(parts):
                words, j = words + parts[j][2], j + 1
            if len(words) < least and k:
                break
            key = tuple(words)
            if key in seen and seen[key] != (doc_id, parts[k][0]):
                out.add((doc_id, parts[k][0], parts[j - 1][1]))
            seen.setdefault(key, (doc_id, parts[k][0]))
    return out


def sentences(rng, n):
    return [" ".join(prose(rng.randrange(10**6), rng.randrange(2, 9)).split()) + rng.choice([". ", ".\n", "\n", "! "]) for _ in range(n)]


def corpus():
    rng = random.Random(4)
    shared = [sentences(rng, 14) for _ in range(3)]  # passages of over 50 words in short lines
    rows = []
    for k in range(60):
        body = sentences(rng, 12)
        if k % 3 == 0:
            at = rng.randrange(12)
            body[at:at] = shared[k % 9 // 3]
        rows.append((k, "A common heading\n" + "".join(body)))
    return rows + [(70, "one short text"), (71, "One  short text"), (72, None), (73, ""), (None, rows[0][1])], shared


def test_passages_match_plain_search(docs_of):
    rows, _ = corpus()
    got = line_dedup.repeated_units(docs_of(rows), "passage", 16).collect()
    assert {(r["doc_id"], r["start_pos"], r["end_pos"]) for r in got} == plain(rows, 16)
    by_id = {r["doc_id"] for r in got}
    assert by_id == {k for k in range(9, 60) if k % 3 == 0} | {71, None}  # headings alone are left


def test_cut_texts_keep_the_first_passage(docs_of):
    rows, shared = corpus()
    docs = docs_of(rows, start_pos=["x"] * len(rows))
    clean = {r["doc_id"]: r["text"] for r in line_dedup.without_units(docs, line_dedup.repeated_units(docs, "passage", 16)).collect()}
    texts = dict(rows)
    for passage in shared:
        holders = [k for k, t in clean.items() if t and "".join(passage).strip() in t]
        assert len(holders) == 1
    assert clean[72] is None and clean[73] == "" and clean[1] == texts[1] and clean[71] == "" and not clean[None].strip()


def test_overlapping_spans(spark, docs_of):
    docs = docs_of([(1, "abcdefghij\nkl"), (2, "same")])
    spans = spark.createDataFrame([(1, 2, 5), (1, 4, 7), (1, 3, 4), (1, 9, 10), (9, 0, 1)], "doc_id long, start_pos long, end_pos long")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_units(docs, spans).collect()}
    assert got == {1: "abhikl", 2: "same"}


def test_lines_and_paragraphs_still_work(docs_of):
    docs = docs_of([(1, "a b\n\nc d\ne"), (2, "x\n\nc d\ne")])
    assert [(r["doc_id"], r["start_pos"], r["end_pos"]) for r in line_dedup.repeated_units(docs, "paragraph").collect()] == [(2, 3, 8)]
    assert sorted((r["doc_id"], r["start_pos"]) for r in line_dedup.repeated_units(docs, "line").collect()) == [(2, 3), (2, 7)]
