"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import corpus_pipeline
import pytest

from trajlytics.llm import decontaminate, licenses, line_dedup, near_copies, packing, pseudonyms, quality, secrets, sharding, simhash, url_rules
from trajlytics.llm.common import staged_path


@pytest.fixture(scope="session")
def bench(spark):
    rows = [(1, None), (2, ""), (3, "short"), (None, "a passage with a null id that nothing contains"), (4, "another passage that nothing contains")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, edits string")


def test_rows_without_findings_do_not_crash(odd_docs, no_docs, bench):
    for docs in (odd_docs, no_docs):
        assert secrets.scan(docs).count() == 0
        assert licenses.scan(docs).count() == 0
        assert decontaminate.find_items(docs, bench).count() == 0
        assert decontaminate.find_items(docs, bench.limit(0)).count() == 0
        assert pseudonyms.find_private(docs, b"k").count() == 0


def test_one_row_per_document(odd_docs, no_docs):
    n = odd_docs.count()
    assert quality.verdicts(odd_docs).count() == n and quality.score(odd_docs).count() == n
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == n
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["component_id"] == 1 and by_id[3]["fingerprint"] == "0" * 16
    assert {by_id[k]["component_id"] for k in (3, 4, 5)} == {3} and by_id[None]["component_id"] in (None, 3)
    assert quality.verdicts(no_docs).count() == simhash.near_duplicates(no_docs).count() == 0


def test_filters_keep_columns_and_define_null_rows(odd_docs, no_docs, bench):
    kept = near_copies.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    # copies of text 1, the texts without words and the repeated row leave one document each
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 6, 7, 7, 8, None]
    assert decontaminate.clean_documents(odd_docs, bench).count() == odd_docs.count()
    assert secrets.redact(odd_docs).exceptAll(odd_docs).count() == 0
    assert quality.keep_good(odd_docs).schema == odd_docs.schema
    for stage in (near_copies.keep_one, quality.keep_good, secrets.redact, lambda d: decontaminate.clean_documents(d, bench)):
        assert stage(no_docs).count() == 0


def test_sharding_packing_and_dedup(spark, odd_docs, no_docs):
    shards = sharding.shuffle_to_shards(odd_docs, staged_path(spark, "t"), n_shards=3).collect()
    assert len(shards) == 12 and "shard_in" in shards[0].asDict() and "size_in" in shards[0].asDict()
    packed = packing.pack_documents(odd_docs).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert sum(r["n_tokens"] for r in packed if r["doc_id"] == 6) == 30_001
    removed = line_dedup.repeated_units(odd_docs).collect()
    assert [(r["doc_id"], r["keep_doc_id"]) for r in removed] == [(2, 1), (2, 1)]
    for empty in (
        packing.pack_documents(no_docs),
        line_dedup.repeated_units(no_docs),
        sharding.shuffle_to_shards(no_docs, staged_path(spark, "t"), n_shards=3),
    ):
        assert empty.count() == 0


def test_urls(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://A.example.NET/en/1", "x"), (4, "http://A.example.NET/en/1", "x"), (None, "ftp://org/fr/", "x"), (5, "http://h?x/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages).collect()}
    assert (4, "a.example.net", "/en/1", "example.net/en/", "allow") in got
    assert (1, "", "", None, "allow") in got and (3, "", "", None, "allow") in got and (5, "h", "", None, "allow") in got
    assert (None, "org", "/fr/", "org/fr/", "allow") in got
    labels = spark.createDataFrame([("http://h?x/", True), (None, True), ("http://q/", None)], "url string, blocked boolean")
    assert url_rules.judge(pages, labels).count() == 7 and url_rules.judge(pages.limit(0), labels).count() == 0


def test_stages_on_odd_and_empty_documents(spark, odd_docs, no_docs, sf_dir):
    base = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (base, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, sf_dir)
            if name != "best_fit_packing":
                assert after.columns == docs.columns, name
            after.count()
