"""Operators against plain Python on small inputs."""

import itertools
import random

import xxhash

from trajlytics.llm import decontaminate, licenses, packing, pseudonyms, quality, secrets, sharding, simhash
from trajlytics.llm.common import staged_path

from llm_text import prose


def naive_print(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[k : k + 4]) for k in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, docs_of):
    rng = random.Random(5)
    rows = [(k, prose(k % 9, 60)) for k in range(40)] + [(50, None), (51, "a b"), (52, "A  b")]
    for k in range(40):
        words = prose(k % 9, 60).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    prints = {i: naive_print(t) for i, t in rows}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    root = {i: i for i in prints}
    for _ in rows:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    assert root == {i: r["component_id"] for i, r in got.items()}


def test_links_lose_nothing_when_keys_are_crowded(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(60)}
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long").repartition(5)
    root = {simhash.signed(p): simhash.signed(p) for p in prints}
    pairs = [(a, b) for a, b in itertools.combinations(root, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    linked = {a for p in pairs for a in p}
    for n_blocks, chunk in ((6, 4096), (6, 7), (7, 20), (8, 4096)):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4, n_blocks, chunk)).collect()}
        assert {k: v for k, v in root.items() if v != k} == {k: v for k, v in got.items() if v != k}, (n_blocks, chunk)
        assert set(got) <= linked


def edit_distance_inside(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for k, d in enumerate(item, 1):
            diagonal, row[k] = row[k], min(diagonal + (c != d), row[k] + 1, row[k - 1] + 1)
        best = min(best, row[-1])
    return best


def test_decontamination_finds_what_edit_distance_finds(spark, docs_of):
    rng = random.Random(3)
    items = [(k, prose(100 + k, 14 + 5 * k)) for k in range(4)]
    rows = []
    for k in range(60):
        item = items[k % 4][1]
        letters = list(item)
        for _ in range(rng.randrange(0, len(item) // 6)):
            at = rng.randrange(len(letters))
            rng.choice([lambda a=at: letters.insert(a, "z"), lambda a=at: letters.pop(a), lambda a=at: letters.__setitem__(a, "q")])()
        rows.append((k, prose(k, 50) + "\n" + "".join(letters) + " " + prose(k + 1, 40)))
    rows += [(90, items[0][1].upper().replace(" ", "  \n")), (91, items[1][1][: len(items[1][1]) // 2]), (92, items[2][1] + " " + prose(4, 30) + " " + items[2][1])]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_items(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in rows:
        flat = " ".join(t.lower().split())
        for j, item in items:
            d = edit_distance_inside(item.lower(), flat)
            if d <= min(int(len(item) * 0.1), (len(item) - 8) // 8):
                want[i, j] = d
    assert got == want and len(want) > 30
    spans = decontaminate.find_items(docs_of(rows[-1:]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(rows[-1][1][r["start_pos"] : r["end_pos"]] for r in spans) == [items[2][1]] * 2


def test_long_texts_are_searched_in_segments(monkeypatch):
    item = prose(1, 30)
    index = decontaminate.Index(8)
    index.add(5, decontaminate.code_points(item))
    index.close(0.1)
    text = decontaminate.code_points(" ".join([prose(8, 300), item, prose(9, 200), item]))
    whole = decontaminate.matches_in_segments(text, index)
    for size in (97, 400, 1000):
        monkeypatch.setattr(decontaminate, "PIECE_CHARS", size)
        assert sorted(decontaminate.matches_in_segments(text, index)) == sorted(whole)
    assert len(whole) == 2


def test_licenses(spark, docs_of):
    name, notice = "Apache-2.0 header", licenses.TEMPLATES["Apache-2.0 header"]
    words = notice.split()
    broken = " ".join(words[:12] + ["word"] + words[13:])
    rows = [(1, prose(1) + "\n" + notice.upper() + "\n" + prose(2)), (2, notice), (3, " ".join(words[: len(words) // 2])), (4, prose(3, 3000) + " " + broken)]
    got = {(r["doc_id"], r["template"]): r for r in licenses.scan(docs_of(rows)).collect()}
    assert (1, name) in got and (2, name) in got and (3, name) not in got
    r = got[1, name]
    assert rows[0][1][r["start_pos"] : r["end_pos"]].lower() == notice.lower()
    n = len(licenses.Retrieval({name: notice}, 1).sets[0])
    assert ((4, name) in got) == ((n - 5) / n >= 0.8)
    assert all(licenses.recall_bound(n) > 0.9999 for n in range(1, 400))
    every = {(i, t) for i, text in rows for t, share in shares(text).items() if share >= 0.8}
    assert set(got) == every


def shares(text):
    import re

    def grams(s):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", s.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    have = grams(text)
    return {t: len(grams(s) & have) / len(grams(s)) for t, s in licenses.TEMPLATES.items()}


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for per_source in (1, 2):
        n = 300
        sizes = sorted((rng.randrange(1, 100) for _ in range(n)), reverse=True)
        sources = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [rng.choice([0, *range(1, 200)]) for _ in range(n)]
        bins, offsets = packing.best_fit(sizes, sources, clusters, 100, per_source)
        content = []
        for size, source, cluster, chosen, offset in zip(sizes, sources, clusters, bins, offsets, strict=True):
            fits = [(100 - sum(x[0] for x in b), k) for k, b in enumerate(content) if 100 - sum(x[0] for x in b) >= size and sum(x[1] == source for x in b) < per_source and all(x[2] != cluster for x in b)]
            if fits:
                assert 100 - sum(x[0] for x in content[chosen]) == min(fits)[0]
            else:
                assert chosen == len(content)
                content.append([])
            assert offset == sum(x[0] for x in content[chosen])
            content[chosen].append((size, source, cluster))


def test_packed_blocks_keep_every_token(spark, docs_of):
    rows = [(k, prose(k, 5 + 7 * k)) for k in range(120)] + [(500 + k, prose(3, 40)) for k in range(60)]
    docs = docs_of(rows)
    packed = packing.pack_documents(docs, capacity=100, per_source=3, block=50)
    got = packed.collect()
    for i, t in rows:
        assert sum(r["n_tokens"] for r in got if r["doc_id"] == i) == len(t.split()) + 1
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r["bin_id"], r["bin_offset"])), key=lambda r: r["bin_id"]):
        group = list(group)
        ends = list(itertools.accumulate(r["n_tokens"] for r in group))
        assert ends[-1] <= 100 and [r["bin_offset"] for r in group] == [0, *ends[:-1]]
        assert len({r["cluster"] for r in group}) == len(group) <= 3
    texts = packing.packed_texts(packed, docs).collect()
    assert sum(len(r["text"].split()) for r in texts) == sum(len(t.split()) for _, t in rows)


def test_shards_are_gapless_whole_and_stable(spark, docs_of):
    rows = [(k, prose(k, 20)) for k in range(400)] + [(7, "same")] * 300
    docs = docs_of(rows)
    got = sharding.shuffle_to_shards(docs, staged_path(spark, "t"), n_shards=5, bucket_bytes=4000).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)
    for k in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert all(shard[r["doc_id"]] == r["shard"] for r in got)
    grown = {r["doc_id"]: r["shard"] for r in sharding.shuffle_to_shards(docs, staged_path(spark, "t"), n_shards=6).collect()}
    assert all(r["grown_shard"] == grown[r["doc_id"]] and r["grown_shard"] in (r["shard"], 5) for r in got)
    again = sharding.shuffle_to_shards(docs.repartition(1).sortWithinPartitions("doc_id", "text"), staged_path(spark, "t"), n_shards=5, bucket_bytes=4000)
    assert {r["doc_id"]: r["shard"] for r in again.collect()} == shard


def test_pseudonyms_round_trip_and_format():
    key = b"key"
    values = {"number": ["4111111111111111", "4111-1111-1111-1112", "2390 4095 0064 8960"], "ip": ["129.38.82.176"], "phone": ["+1 (017) 555-7713"], "national_id": ["123-45-6789"], "date": ["2024-02-29", "31.12.1999", "1203-05-06"], "mail": ["Ab.9@mail7.example.com"], "iban": ["GB82 WEST 1234 5698 7654 32"]}
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    for kind, examples in values.items():
        for value in examples:
            new = pseudonyms.pseudonym(kind, value, key)
            assert new != value and pseudonyms.pseudonym(kind, new, key, inverse=True) == value
            assert kind == "ip" or shape(new) == shape(value)
    assert pseudonyms.luhn_digit(pseudonyms.pseudonym("number", "4111111111111111", key)[:-1]) == pseudonyms.pseudonym("number", "4111111111111111", key)[-1]
    assert pseudonyms.pseudonym("date", "2023-02-29", key) is None and pseudonyms.pseudonym("ip", "1.2.3.256", key) is None
    for size in (2, 7, 100, 1000):
        assert sorted(pseudonyms.permute(v, size, key, "t") for v in range(size)) == list(range(size))


def test_neighbouring_values_are_told_apart():
    text = "call +1 (826) 555-4081 190.137.223.204 or +49 30 1234 5678 10.0.0.1, card 4111111111111111 +1 (017) 555-7713 2024-02-29"
    found = [(kind, text[a:b]) for kind, a, b, _ in pseudonyms.find(text, b"k")]
    assert found == [
        ("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204"), ("phone", "+49 30 1234 5678"), ("ip", "10.0.0.1"),
        ("number", "4111111111111111"), ("phone", "+1 (017) 555-7713"), ("date", "2024-02-29"),
    ]


def test_equal_values_stay_linked(spark, docs_of):
    rows = [(1, "card 4111 1111 1111 1111, from 2024-02-29, mail a.b@x.example"), (2, "4111-1111-1111-1111 on 2024-02-29; a.b@x.example 10.0.0.1"), (3, "no values, 12 apples in 2024")]
    docs = docs_of(rows)
    found = {(r["doc_id"], r["kind"]): r["pseudonym"] for r in pseudonyms.find_private(docs, b"k").collect()}
    assert set(found) == {(1, "number"), (1, "date"), (1, "mail"), (2, "number"), (2, "date"), (2, "mail"), (2, "ip")}
    assert found[1, "number"].replace(" ", "") == found[2, "number"].replace("-", "") and found[1, "date"] == found[2, "date"]
    texts = {r["doc_id"]: r["text"] for r in pseudonyms.with_pseudonyms(docs, b"k").collect()}
    assert texts[3] == rows[2][1] and "4111" not in texts[1][:12] and "a.b@" not in texts[2]


def test_secret_forest_on_held_out_findings(spark, docs_of):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, secret = [], set()
    for k in range(240):
        kind = k % 4
        if kind == 0:
            secret.add(k)
            rows.append((k, prose(k, 20) + f' {rng.choice(["token", "api_key", "password"])} = "{hexes(40)}" ' + prose(k + 1, 10)))
        elif kind == 1:
            rows.append((k, prose(k, 20) + " " + "".join(rng.choice(["river", "stone", "light", "green"]) for _ in range(5))))
        elif kind == 2:
            rows.append((k, prose(k, 20) + f" commit {hexes(40)} " + prose(k, 5)))
        else:
            rows.append((k, prose(k, 20) + f" number {rng.randrange(10**15, 10**16)}"))
    words = ["river", "stone", "light", "green", "winter"]
    from pyspark.sql import functions as F

    found = secrets.candidates(docs_of(rows), words, F.col("doc_id")).drop("label").withColumn("label", F.col("doc_id").isin([*secret]).cast("double"))
    model = secrets.train(found.where("doc_id < 120"))
    held = secrets.classify(found.where("doc_id >= 120"), model).collect()
    right = sum((r["probability"] >= 0.5) == (r["doc_id"] in secret) for r in held)
    assert len(held) >= 110 and right / len(held) >= 0.98
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(rows)).collect()}
    assert all(('"[secret]"' in redacted[i]) == (i in secret) for i, _ in rows)
    assert all(redacted[i] == t for i, t in rows if i not in secret)


def test_repeated_words_against_a_plain_count(spark, docs_of):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        words = prose(k, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = words[: rng.randrange(0, 20)]
        rows.append((k, "\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9))))
    got = {r["doc_id"]: r for r in quality.verdicts(docs_of(rows)).collect()}
    for i, text in rows:
        w = text.split()
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        covered = {j + d for j, g in enumerate(grams) if grams.count(g) > 1 for d in range(8)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines))), i
        assert got[i]["word_chars"] == sum(map(len, w))


def test_label_model_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = quality.keep_good(docs).join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in kept}
    all_ = {r["quality"]: r["count"] for r in docs.join(labels, "doc_id").groupBy("quality").count().collect()}
    assert kept[1] / all_[1] > 0.98 and kept.get(0, 0) / all_[0] < 0.05
