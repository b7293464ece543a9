"""Manifest against plain trees built with hashlib: nulls, repeated ids and rows, sparse and negative ids, many sources."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_text import prose
from trajlytics.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [*(row[c] for c in manifest.FIELDS[:-1]), text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, place):
    for level in levels[:-1]:
        first = place // 3 * 3
        yield level[first:place], level[place + 1 : first + 3]
        place //= 3


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups[r["source"]].append((r["doc_id"], leaf_of(r, r["text"]), leaf_of(r, text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(groups[s], key=lambda x: (x[0] is not None, x)) for s in names}
    trees = {s: levels_of([x[1] for x in order[s]]) for s in names}
    roof = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, claim) in enumerate(order[s]):
            path = [*path_of(trees[s], i), *path_of(roof, k)]
            for left, right in path:
                claim = h(*left, claim, *right)
            root = roof[-1][0]
            out.append((doc_id, s, i, leaf, trees[s][-1][0], root, h(*[x for a, b in path for x in a + b]), claim, claim == root))
    return out


NAMES = ("doc_id", "source", "slot", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(docs):
    got = [tuple(r[n] for n in NAMES) for r in manifest.audited(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain(docs.collect()), key=repr)
    return got


def test_odd_and_empty_documents(odd_docs, no_docs):
    assert len(check(odd_docs)) == odd_docs.count()
    assert check(no_docs) == []


def test_hot_source_sparse_ids_ties_and_repeated_rows(spark):
    rows = [(k * 37 - 4000, prose(k, 5) + "\n" * (k % 2), "en", "src0", k) for k in range(1500)]
    rows += [(10**15 + k, f"far {k}", "en", "src0", k) for k in range(3)] + [(-(2**62), "low", "en", "src0", 1)]
    rows += [(None, f"no id {k}", None, "src0", None) for k in range(40)] + [(None, "no id", None, None, None)] * 5
    rows += [(7, "same\nrow", "en", "src1", 8)] * 900 + [(7, f"same id {k}", "en", "src1", 8) for k in range(20)]
    rows += [(k, "one", "en", f"host{k}", 3) for k in range(60)] + [(1, "umlaut", "de", "ä", 6), (2, "tag", "de", "-", 3), (3, "", "de", "", 0)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7))
    assert {r[8] for r in got} == {True, False}


def test_a_run_more_than_one_round_deep(spark):
    n = manifest.RUN * 3 + 5
    docs = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("t\n"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    assert len(check(docs)) == n


def test_directory_takes_no_sort_of_rows_and_no_single_partition(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    plan = manifest.audited(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


@pytest.mark.parametrize("value", [None, "", "a:b", "ß"])
def test_encoding(spark, value):
    row = spark.createDataFrame([(value,)], "v string").select(manifest.encoded(F.col("v"))).first()[0]
    assert row == ("-" if value is None else f"{len(value.encode())}:{value}")
