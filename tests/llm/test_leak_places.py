"""A leak is charged to the document that holds it."""

from trajlytics.llm import decontaminate

from llm_text import prose


def test_an_item_without_its_first_characters_at_the_start_of_a_later_document(spark, docs_of):
    item = prose(21, 30)
    rows = [(1, prose(1, 40)), (2, item[1:] + " " + prose(2, 30)), (3, prose(3, 40)), (4, item[3:]), (5, prose(4, 40)), (6, prose(5, 30) + " " + item[:-2]), (7, prose(6, 40))]
    docs, items = docs_of(rows).coalesce(1), spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_items(docs, items).collect()}
    assert {i: r["edits"] for i, r in got.items()} == {2: 1, 4: 3, 6: 2}
    texts = dict(rows)
    assert all(0 <= r["start_pos"] < r["end_pos"] <= len(texts[i]) for i, r in got.items())
    assert got[2]["start_pos"] == got[4]["start_pos"] == 0
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()) == [1, 3, 5, 7]
