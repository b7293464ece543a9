"""Merkle manifest of a dataset by bitmap ranks: every row is a leaf, every group (source) a tree of fan-out three, and the
groups' roots are the leaves of one more tree.

Coordinates come from counting, not from sorting rows. The ids of a group are merged into 64-bit words that name the ids they
hold; popcount directories over blocks of 1024 words, of 1024 such blocks and so on give the number of ids before each word,
so the slot of a leaf is one lookup and one popcount. Runs of 3 ** 6 slots are then arrays keyed by slot, reduced six levels at
a time; one row a run goes on to the next round. No step holds more than one run, block or word of a group.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.llm.common import staged
from trajlytics.plans.scan import null_safe_join, running

FAN, LEVELS = 3, 6
#: Slots reduced at once.
RUN = FAN**LEVELS
#: A directory block covers 2 ** BLOCK_BITS words, or blocks of the level below.
BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A null as '-', anything else as the number of its UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the joined values."""
    return F.sha2(F.concat(*values), 256)


def leaf(values: list[Column]) -> Column:
    return digest(*[encoded(v) for v in values])


def tagged(group: Column) -> Column:
    """A group name that is never null and keeps the order: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def untagged(group: Column) -> Column:
    return F.when(F.startswith(group, F.lit("=")), F.substring(group, 2, 1 << 30))


def shifted(value: int, place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), place.cast("int"))


def id_words(counted: DataFrame, null_word: int) -> DataFrame:
    """One row per group and run of 64 ids: the bitmap of the ids, the number of rows, and what repeated ids add.

    Rows without an id stand in a word of their own before all others."""
    place = F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0))
    more = F.when(F.col("n") > 1, F.struct(place.cast("int").alias("place"), (F.col("n") - 1).alias("n")))
    return counted.groupBy("src", F.coalesce(F.shiftright("doc_id", 6), F.lit(null_word)).alias("node")).agg(
        F.bit_or(shifted(1, place)).alias("bits"), F.sum("n").alias("n"), F.collect_list(more).alias("more")
    )


def directory(words: DataFrame, span: int) -> DataFrame:
    """words with `before`, the rows of the group in earlier words, and `total`, all rows of the group.

    Blocks are counted level by level until a group has at most one block's worth of them; offsets are windows inside a block,
    and come down by joins on the block's number."""
    levels = [words.select("src", "node", "n")]
    while span > 1 << BLOCK_BITS:
        up = levels[-1].groupBy("src", F.shiftright("node", BLOCK_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(staged(up, "blocks"))
        span = (span >> BLOCK_BITS) + 2
    earlier = lambda keys: Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows_before = lambda keys: F.coalesce(F.sum("n").over(earlier(keys)), F.lit(0))
    known = levels[-1].select("src", "node", rows_before(["src"]).alias("before"), F.sum("n").over(Window.partitionBy("src")).alias("total"))
    for level in reversed(levels[:-1]):
        here = level.withColumn("up", F.shiftright("node", BLOCK_BITS)).withColumn("inside", rows_before(["src", "up"]))
        above = known.select("src", F.col("node").alias("up"), "before", "total")
        known = here.join(above, ["src", "up"]).select("src", "node", (F.col("before") + F.col("inside")).alias("before"), "total")
    return words.drop("n").join(known, ["src", "node"])


def tie_order(tied: DataFrame) -> DataFrame:
    """row and its place among the rows of one group and id: by leaf, equal leaves in any order. Two-level scans, so that an id
    of a third of all rows is spread over the ranges of its leaves, and a leaf of as many copies over ranges of rows."""
    kinds = tied.groupBy("src", "doc_id", "leaf").agg(F.count(F.lit(1)).alias("copies"))
    first = running(kinds, ["src", "doc_id"], F.substring("leaf", 1, 3), ["leaf"], {"first": ("sum", "copies")}, exclusive=True)
    copies = running(tied, ["src", "doc_id", "leaf"], F.shiftright("row", 16), ["row"], {"copy": ("count", F.lit(1))}, exclusive=True)
    both = null_safe_join(copies, first.drop("copies"), ["src", "doc_id", "leaf"])
    return both.select("row", (F.col("first") + F.col("copy")).cast("long").alias("tie"))


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (src, doc_id, leaf, row) with `slot`, their place in the group from zero, and `total`.

    Ids ascend, rows without an id come first, rows of one id follow their leaves."""
    counted = staged(rows.groupBy("src", "doc_id").agg(F.count(F.lit(1)).alias("n")), "ids")
    low, high, most = counted.agg(F.min("doc_id"), F.max("doc_id"), F.max("n")).first()
    low, high = (low or 0) >> 6, (high or 0) >> 6
    words = staged(directory(staged(id_words(counted, low - 1), "words"), high - low + 2), "directory")
    place = F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int")
    keyed = rows.withColumns({"node": F.coalesce(F.shiftright("doc_id", 6), F.lit(low - 1)), "place": place})
    inside = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(shifted(-1, F.col("place")))))
    repeats = F.aggregate("more", F.lit(0).cast("long"), lambda t, m: t + F.when(m["place"] < F.col("place"), m["n"]).otherwise(0))
    tied = F.exists("more", lambda m: m["place"] == F.col("place"))
    found = keyed.join(words, ["src", "node"]).select(*rows.columns, (F.col("before") + inside + repeats).alias("slot"), "total", tied.alias("tied"))
    if (most or 0) < 2:
        return found.drop("tied")
    found = staged(found, "slots")
    order = tie_order(found.where("tied").select("src", "doc_id", "leaf", "row"))
    again = found.where("tied").join(order, "row").withColumn("slot", F.col("slot") + F.col("tie")).select(*found.columns)
    return found.where("not tied").unionByName(again).drop("tied")


def nodes_at(level: int) -> Column:
    """Nodes that a tree of `total` nodes has after so many levels."""
    return F.expr(f"(total + {FAN**level - 1}) div {FAN**level}")


def run_digest(below: Column, number: Column) -> Column:
    return F.sha2(F.array_join(F.slice(below, (number * FAN + 1).cast("int"), F.lit(FAN)), ""), 256)


def reduced(nodes: DataFrame) -> DataFrame:
    """One row per tree and RUN slots: its members in slot order, the nodes of each level inside (l0 to l6) and the digest that
    goes on. A tree with one node left is done; while there are more, every run of three becomes its digest."""
    member = F.struct("slot", *[c for c in nodes.columns if c not in ("src", "slot", "total")])
    run = F.expr(f"slot div {RUN}")
    groups = nodes.groupBy("src", run.alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.first("total").alias("total"))
    groups = groups.withColumn("l0", F.transform("members", lambda m: m["leaf"]))
    for k in range(LEVELS):
        below = F.col(f"l{k}")
        ids = F.sequence(F.lit(0), F.expr(f"(size(l{k}) - 1) div {FAN}"))
        runs = F.transform(ids, partial(run_digest, below))
        groups = groups.withColumn(f"l{k + 1}", F.when(nodes_at(k) > 1, runs).otherwise(below))
    return groups.withColumn("leaf", F.element_at(f"l{LEVELS}", 1))


def own_steps() -> Column:
    """members with their siblings inside the run, level by level, joined left and right of the node."""

    def steps(place: Column) -> Column:
        found = []
        for k in range(LEVELS):
            at, first = F.floor(place / FAN**k).cast("int"), (F.floor(place / FAN ** (k + 1)) * FAN).cast("int")
            left = F.array_join(F.slice(F.col(f"l{k}"), first + 1, at - first), "")
            right = F.array_join(F.slice(F.col(f"l{k}"), at + 2, first + FAN - 1 - at), "")
            found.append(F.when(nodes_at(k) > 1, F.struct(left.alias("left"), right.alias("right"))))
        return F.filter(F.array(*found), lambda s: s.isNotNull())

    return F.transform("members", lambda m, i: F.struct(m.alias("member"), steps(i).alias("steps")))


def grown(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The rounds of `reduced` from the leaves up, until every tree has one run; staged, one row a run."""
    rounds = [staged(reduced(nodes), name)]
    while most > RUN:
        most = -(-most // RUN)
        up = rounds[-1].select("src", F.col("run").alias("slot"), "leaf", nodes_at(LEVELS).cast("long").alias("total"))
        rounds.append(staged(reduced(up), name))
    return rounds


def with_paths(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Members of the first round with their siblings up to the top; `top` has one row per tree (src, steps, subroot, root)."""
    above = top.withColumn("run", F.lit(0).cast("long"))
    for groups in reversed(rounds):
        met = groups.select("src", "run", F.explode(own_steps()).alias("at")).join(above, ["src", "run"])
        lower = met.select("src", F.col("at.member.slot").alias("run"), "at.member", F.concat("at.steps", "steps").alias("steps"), "subroot", "root")
        above = lower.drop("member")
    return lower


def numbered(sources: DataFrame) -> DataFrame:
    """One row per group with its place in the order of names: a range-partitioned sort and the counts of its partitions."""
    at = F.monotonically_increasing_id()
    placed = staged(sources.orderBy("src").select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "sources")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(counts.select("part", before.alias("before")), "part").withColumn("slot", F.col("at") + F.col("before")).drop("part", "at", "before")


def manifest(leaves: DataFrame) -> DataFrame:
    """One row per leaf: src, slot, doc_id, leaf, claim, steps (its siblings from the leaf to the root: left and right of each
    node), subroot and root. `leaves` has src (never null), doc_id, leaf and claim (a digest to verify, null: the leaf).

    Repeated rows are leaves of their own. An empty table has no leaves and gives no rows.
    """
    rows = staged(leaves.select("src", "doc_id", "leaf", "claim", F.monotonically_increasing_id().alias("row")), "leaves")
    placed = with_slots(rows)
    most = rows.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    rounds = grown(placed.select("src", "slot", "total", "leaf", "doc_id", "claim"), most, "runs")
    subroots = rounds[-1].select("src", F.col("leaf").alias("subroot"))
    named = staged(numbered(subroots), "subroots")
    n_sources = named.count()
    tree = named.select(F.lit("").alias("src"), "slot", F.lit(n_sources).cast("long").alias("total"), F.col("subroot").alias("leaf"), F.col("src").alias("name"))
    roof = grown(tree, n_sources, "roof")
    no_steps = F.array().cast("array<struct<left:string,right:string>>")
    summit = roof[-1].select("src", no_steps.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("leaf").alias("root"))
    tops = with_paths(roof, summit).select(F.col("member.name").alias("src"), "steps", F.col("member.leaf").alias("subroot"), "root")
    found = with_paths(rounds, staged(tops, "tops"))
    return found.select("src", F.col("run").alias("slot"), "member.doc_id", "member.leaf", "member.claim", "steps", "subroot", "root")


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def document_leaves(docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """Leaves of documents by FIELDS; where `changed` holds, the claim is the leaf of the row with `changed_text` as its text.
    Other columns, whatever their names, are not read."""
    values = [docs[c] for c in FIELDS]
    claim = F.lit(None).cast("string")
    if changed is not None:
        claim = F.when(changed & ~changed_text.eqNullSafe(docs["text"]), leaf([*values[:-1], changed_text]))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), tagged(docs["source"]).alias("src"), leaf(values).alias("leaf"), claim.alias("claim"))


def audited(docs: DataFrame) -> DataFrame:
    """Proofs of all documents and their check against rows whose line breaks were deleted where the checksum of the id is
    even. A row with a null id is never changed; ids and sources may be null and rows may repeat (see `manifest`)."""
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    found = manifest(document_leaves(docs, F.coalesce(even, F.lit(False)), F.translate(docs["text"], "\n", "")))
    checked = found.select(
        "doc_id", untagged(F.col("src")).alias("source"), "slot", "leaf", "subroot", "root",
        proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("claim", "leaf"), F.col("steps")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
