"""Quality by attention-based multiple-instance learning: a document is a bag of passages, only the bag has a label.

Every passage of 64 words is encoded (shares of characters, repetition, word lengths, hashed words), a hidden layer makes its
representation, a gated attention (tanh times sigmoid) weighs it inside the document, and the weighted sum of representations
is scored. The network is fitted in one task on a bounded sample of labelled documents; scoring is one map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import staged
from trajlytics.llm.licenses import SHINGLE, hash_powers, hashed_words, shingles

WORDS = 64
HASHED = 32
#: Bound of what is fitted on: labelled documents, passages of one of them, passages in all.
FIT_DOCS, FIT_PASSAGES_EACH, FIT_PASSAGES = 8192, 64, 200_000
EPOCHS, BATCH, RATE, DECAY = 20, 128, 0.01, 1e-4
HIDDEN, GATE = 24, 12
KEEP_FROM = 0.3
#: Texts are worked on in pieces of about so many bytes, cut at blanks.
PIECE_BYTES = 1 << 18
BLANK = np.ones(256, bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = False
#: Classes of bytes that are counted: capitals, digits, symbols, other marks, beyond ASCII, line breaks.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?.,;:'\"()-", bytes(range(128, 256)), b"\n")
SIZE = len(CLASSES) + 7 + HASHED
SHAPES = {"mean": (SIZE,), "scale": (SIZE,), "w1": (SIZE, HIDDEN), "b1": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}


def pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while len(data) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        cut = max(data.rfind(b" ", start + 1, end), data.rfind(b"\n", start + 1, end))
        cut = cut if cut > 0 else end
        yield data[start:cut]
        start = cut
    yield data[start:]


def encoded(parts: list[tuple[int, bytes]], powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of SIZE numbers for each passage of the parts, and the owner (first item of its part) of each passage. A part
    without words has one passage of zeros."""
    whole = b" ".join(p[1] for p in parts)
    raw = np.frombuffer(whole, np.uint8)
    begins = np.cumsum([0, *(len(p[1]) + 1 for p in parts)])
    words, starts, ends = hashed_words(np.frombuffer(whole.lower(), np.uint8), BLANK, powers)
    part = np.searchsorted(begins, starts, side="right") - 1
    n_words = np.bincount(part, minlength=len(parts))
    n_passages = np.maximum(1, -(-n_words // WORDS))
    base = np.cumsum(n_passages) - n_passages
    inside = np.arange(len(words)) - (np.cumsum(n_words) - n_words)[part]
    at = base[part] + inside // WORDS
    total = int(n_passages.sum())
    owner = np.repeat([p[0] for p in parts], n_passages)
    out = np.zeros((total, SIZE), np.float32)
    if not len(words):
        return out, owner
    n = np.maximum(np.bincount(at, minlength=total), 1).astype(float)
    heads = np.flatnonzero(np.diff(at, prepend=-1))  # first word of each passage that has words
    length = (ends - starts).astype(float)
    n_bytes = np.maximum(np.bincount(at, length, total), 1)
    lasts = np.append(heads[1:], len(words)) - 1
    bounds = np.stack([starts[heads], ends[lasts]], axis=1).ravel()  # blanks between passages belong to none
    for k, members in enumerate(CLASSES):
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        out[at[heads], k] = np.add.reduceat(np.append(table[raw], 0), bounds)[::2]
    out[:, [0, 1, 4]] /= n_bytes[:, None]
    out[:, [2, 3, 5]] /= n[:, None]
    order = np.lexsort((words, at))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (at[order][1:] != at[order][:-1])
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (part[1:] == part[:-1])
    again = np.zeros(len(words), bool)
    found = shingles(words)
    if len(found):
        here = part[: len(found)]
        order_s = np.lexsort((found, here))
        again[order_s[1:]] = (found[order_s][1:] == found[order_s][:-1]) & (here[order_s][1:] == here[order_s][:-1]) & (part[order_s[1:] + SHINGLE - 1] == here[order_s[1:]])
    mean = np.bincount(at, length, total) / n
    k = len(CLASSES)
    out[:, k] = np.log1p(np.bincount(at, minlength=total))
    out[:, k + 1] = mean / 8
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(at, length**2, total) / n - mean**2, 0)) / 4
    out[at[heads], k + 3] = np.log1p(np.maximum.reduceat(length, heads))
    out[:, k + 4] = np.bincount(at[order], fresh, total) / n
    out[:, k + 5] = np.bincount(at, stutter, total) / n
    out[:, k + 6] = np.bincount(at, again, total) / n
    bucket = (words >> np.uint64(59)).astype(np.int64)
    sign = ((words >> np.uint64(58)) & np.uint64(1)).astype(float) * 2 - 1
    out[:, k + 7 :] = np.bincount(at * HASHED + bucket, sign, total * HASHED).reshape(total, HASHED) / np.sqrt(n)[:, None]
    return out, owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def represent(net: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Representation of each passage, its gates and its attention before normalisation."""
    h = np.maximum(np.clip((x - net["mean"]) / net["scale"], -5, 5) @ net["w1"] + net["b1"], 0)
    t, s = np.tanh(h @ net["v"]), sigmoid(h @ net["u"])
    return h, t, s, (t * s) @ net["w"]


def gradients(net: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss; bag numbers the bags from zero in order, every bag has a passage."""
    first = np.flatnonzero(np.diff(bag, prepend=-1))
    z = np.clip((x - net["mean"]) / net["scale"], -5, 5)
    h, t, s, e = represent(net, x)
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    pooled = np.add.reduceat(a[:, None] * h, first)
    d_logit = (sigmoid(pooled @ net["c"] + net["b"][0]) - y) / len(y)
    d_pooled = np.outer(d_logit, net["c"])[bag]
    d_a = (d_pooled * h).sum(axis=1)
    d_e = a * (d_a - np.add.reduceat(a * d_a, first)[bag])
    d_gate = np.outer(d_e, net["w"])
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    d_h = (a[:, None] * d_pooled + d_t @ net["v"].T + d_s @ net["u"].T) * (h > 0)
    return {"w1": z.T @ d_h, "b1": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "w": (t * s).T @ d_e, "c": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True)}


def blank_net() -> dict[str, np.ndarray]:
    """A network that scores one half."""
    return {k: (np.ones if k == "scale" else np.zeros)(shape) for k, shape in SHAPES.items()}


def fitted(x: np.ndarray, bag: np.ndarray, y: np.ndarray, seed: int = 12) -> dict[str, np.ndarray]:
    """Adam over batches of bags; the same rows in the same order give the same network."""
    net = blank_net()
    if not len(y):
        return net
    net["mean"], net["scale"] = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    for k in ("w1", "v", "u", "w", "c"):
        net[k] = rng.normal(0, 1 / np.sqrt(SHAPES[k][0]), SHAPES[k])
    first = np.append(np.flatnonzero(np.diff(bag, prepend=-1)), len(bag))
    low, high, step = {}, {}, 0
    for _ in range(EPOCHS):
        deal = rng.permutation(len(y))
        for a in range(0, len(deal), BATCH):
            chosen, step = deal[a : a + BATCH], step + 1
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in chosen])
            sizes = first[chosen + 1] - first[chosen]
            found = gradients(net, x[rows], np.repeat(np.arange(len(chosen)), sizes), y[chosen])
            for k, g in found.items():
                g = g + DECAY * net[k]
                low[k] = 0.9 * low.get(k, 0) + 0.1 * g
                high[k] = 0.999 * high.get(k, 0) + 0.001 * g * g
                net[k] = net[k] - RATE * (low[k] / (1 - 0.9**step)) / (np.sqrt(high[k] / (1 - 0.999**step)) + 1e-8)
    return net


def id_digits(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def is_held_out(doc_id: Column) -> Column:
    """One fifth of the ids, by checksum; a null id has the checksum of '', so it is held out."""
    return F.crc32(id_digits(doc_id).cast("binary")) % 5 == 0


def labelled_passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """bag, label and x of passages to fit on: labelled rows that are not held out, FIT_DOCS ids of them by hash, of each
    document at most FIT_PASSAGES_EACH passages spread over its whole text, FIT_PASSAGES in all. An id with several labels
    takes the lowest one; null ids and labels are left out."""
    known = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & ~is_held_out(labels["doc_id"]))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("double").alias("label"))
    chosen = staged(known.orderBy(F.xxhash64("__id"), "__id").limit(FIT_DOCS), "chosen")  # FIT_DOCS rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hash_powers()
        for batch in batches:
            for bag, label, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                x = np.concatenate([encoded([(0, part)], powers)[0] for part in pieces(text.as_py() or b"")])
                x = x[np.unique(np.linspace(0, len(x) - 1, FIT_PASSAGES_EACH).astype(int))]
                n = len(x)
                parts = [pa.array([bag.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([label.as_py()] * n, pa.float64()), pa.array(list(x), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(parts, ["bag", "no", "label", "x"])

    met = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    read = met.select(F.xxhash64("doc_id", "text").alias("bag"), "label", F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(rows, "bag long, no int, label double, x array<float>").orderBy("bag", "no").limit(FIT_PASSAGES)


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """The network, fitted in a task on labelled_passages; a few thousand numbers come back."""

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bag", "ascending"), ("no", "ascending")])
        bags = table.column("bag").to_numpy()
        head = np.append(True, bags[1:] != bags[:-1])
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(bags), SIZE).astype(float)
        net = fitted(x, np.cumsum(head) - 1, table.column("label").to_numpy()[head])
        return pa.table({"net": pa.array([np.concatenate([net[k].ravel() for k in SHAPES])], pa.list_(pa.float64()))})

    sample = staged(labelled_passages(docs, labels), "passages")
    row = staged(sample.groupBy(F.lit(1).alias("one")).applyInArrow(learn, "net array<double>"), "net").first()
    if row is None:
        return blank_net()
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {k: v.reshape(SHAPES[k]) for k, v in zip(SHAPES, np.split(np.array(row[0]), ends[:-1]), strict=True)}


def score(docs: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score (0 to 1) and top_passage (number of the passage with the most attention) of each row of docs.

    Whole texts; attention is normalised while the pieces of a text go by, so a text of any length takes the memory of one
    piece. Null and empty texts are one passage without words. Repeated rows get equal scores; other columns are not read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hash_powers()
        for batch in batches:
            n = batch.num_rows
            peak, mass, pooled = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
            seen, best = np.zeros(n, np.int64), np.zeros(n, np.int64)

            def work(parts: list[tuple[int, bytes]]) -> None:
                x, owner = encoded(parts, powers)
                h, _, _, e = represent(net, x)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                who, own = owner[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
                top = np.maximum.reduceat(e, first)
                rise = np.maximum(peak[who], top)
                a = np.exp(e - rise[own])
                keep = np.exp(peak[who] - rise)
                lead = np.minimum.reduceat(np.where(e == top[own], np.arange(len(e)), len(e)), first) - first
                best[who] = np.where(top > peak[who], seen[who] + lead, best[who])
                mass[who] = mass[who] * keep + np.add.reduceat(a, first)
                pooled[who] = pooled[who] * keep[:, None] + np.add.reduceat(a[:, None] * h, first)
                peak[who] = rise
                seen[who] += np.diff(np.append(first, len(owner)))

            waiting: list[tuple[int, bytes]] = []
            size = 0
            for k, text in enumerate(batch.column(1)):
                for part in pieces(text.as_py() or b""):
                    waiting.append((k, part))
                    size += len(part)
                    if size >= PIECE_BYTES:
                        work(waiting)
                        waiting, size = [], 0
            if waiting:
                work(waiting)
            found = sigmoid(pooled / np.maximum(mass, 1e-300)[:, None] @ net["c"] + net["b"][0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(best)], ["doc_id", "score", "top_passage"])

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return read.mapInArrow(rows, "doc_id long, score double, top_passage long")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted and top_passage of each row of docs, after fitting on the labelled rows that are not
    held out. Without such rows every score is one half; an empty table gives no rows."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "top_passage")
