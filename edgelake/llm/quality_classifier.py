"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; a gated attention network, learned from labels of whole
documents, weighs the passages, and a logistic layer scores the weighted passage representation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelake.llm.words import Words, slices, word_count, words_of
from edgelake.operators.scale import lookup_join
from edgelake.session import stored

PASSAGE_WORDS = 64
PART_BYTES = 128 << 10
TRAIN_ROWS = 4096
TRAIN_PASSAGES = 40_000
ATTENTION = 16
EPOCHS = 60
BATCH = 64
RATE = 3e-3
DECAY = 1e-4
THRESHOLD = 0.7
SEED = 7
SHAPES = 16
EXTRA = 5
WIDTH = SHAPES * SHAPES + EXTRA


def _shapes() -> np.ndarray:
    """Class of each byte: letters, digits, blanks, marks by kind, and bytes of other scripts."""
    kinds = np.full(256, 12, np.uint8)
    kinds[:32] = 15
    kinds[97:123], kinds[65:91], kinds[48:58] = 0, 1, 2
    for kind, marks in ((3, b" \t\r\x0b\x0c"), (4, b"\n"), (5, b".!?"), (6, b",;:"), (7, b"|"), (8, b"#"), (9, b"*"), (10, b"$%&"), (11, b"<>")):
        kinds[list(marks)] = kind
    kinds[128:192], kinds[192:] = 14, 13
    return kinds


def parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``encode`` of the texts, in parts of about PART_BYTES; a longer text is cut between passages."""
    for low, high in slices(texts, PART_BYTES):
        words = words_of(texts.slice(low, high - low))
        step = PASSAGE_WORDS * max(1, PART_BYTES * len(words.starts) // max(len(words.data), 1) // PASSAGE_WORDS)
        if high - low > 1 or len(words.starts) <= step:
            x, doc = encode(words)
            yield x, doc + low
            continue
        for first in range(0, len(words.starts), step):
            begin = int(words.starts[first]) if first else 0
            # One byte of the next part is kept for the pair of bytes at the border.
            end = int(words.starts[first + step]) + 1 if first + step < len(words.starts) else len(words.data)
            own = slice(first, first + step)
            x, doc = encode(Words(
                words.data[begin:end], np.array([0, end - begin]), words.starts[own] - begin, words.ends[own] - begin, words.doc[own]
            ))
            yield x, doc + low


def encode(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Passages of the texts, encoded, and the text each is of; a text without words is one empty passage.

    A passage is encoded by the square roots of the shares of its pairs of byte classes, its shares of distinct
    words, of words equal to the last and to the last but one, its mean word length and its number of words.
    """
    hashes, first = words.hashes(), words.first
    texts = len(words.at) - 1
    in_doc = np.arange(len(hashes)) - first[words.doc]
    counts = np.maximum(-(-np.diff(first) // PASSAGE_WORDS), 1)
    base = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(texts), counts)
    out = np.zeros((len(doc), WIDTH), np.float32)
    if not len(hashes):
        return out, doc
    passage = base[words.doc] + in_doc // PASSAGE_WORDS
    new = np.flatnonzero(np.diff(passage, prepend=-1))
    begins, filled = words.starts[new], passage[new]
    kinds = _shapes()[words.data].astype(np.int64)
    place = np.searchsorted(begins, np.arange(len(kinds)), side="right") - 1
    holder = filled[np.maximum(place, 0)]
    of = np.repeat(np.arange(texts), np.diff(words.at))
    inside = (place[:-1] >= 0) & (of[:-1] == of[1:]) & (doc[holder[:-1]] == of[:-1])
    pairs, held = (kinds[:-1] * SHAPES + kinds[1:])[inside], holder[:-1][inside]
    shares = np.bincount(held * (SHAPES * SHAPES) + pairs, minlength=len(doc) * SHAPES * SHAPES).reshape(len(doc), -1)
    out[:, : SHAPES * SHAPES] = np.sqrt(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1))
    n = np.bincount(passage, minlength=len(doc)).astype(np.float32)
    some = np.maximum(n, 1)
    order = np.lexsort((hashes, passage))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    out[:, -5] = np.bincount(passage[order][new], minlength=len(doc)) / some
    for column, step in ((-4, 1), (-3, 2)):
        same = (hashes[step:] == hashes[:-step]) & (passage[step:] == passage[:-step])
        out[:, column] = np.bincount(passage[step:][same], minlength=len(doc)) / some
    out[:, -2] = np.bincount(passage, weights=np.log1p(words.ends - words.starts), minlength=len(doc)) / some / 3
    out[:, -1] = n / PASSAGE_WORDS
    return out, doc


@dataclass
class AttentionModel:
    """Gated attention: passage x has weight softmax(w . (tanh(V x) * sigmoid(U x))); the bag scores c . sum + b."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        logits, values, doc = [], [], []
        for x, of in parts(texts):
            x = (x - self.mean) * self.scale
            logits.append((np.tanh(x @ self.v) * _sigmoid(x @ self.u)) @ self.w)
            values.append(x @ self.c)
            doc.append(of)
        if not doc:
            return np.zeros(0)
        logits, values, doc = map(np.concatenate, (logits, values, doc))
        starts = np.searchsorted(doc, np.arange(len(texts)))
        weights = np.exp(logits - np.maximum.reduceat(logits, starts)[doc])
        weights /= np.add.reduceat(weights, starts)[doc]
        return _sigmoid(np.add.reduceat(weights * values, starts) + self.b).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> AttentionModel:
    """Learn attention and score together by Adam on the logistic loss of whole bags."""
    rng = np.random.default_rng(seed)
    n = max(1, sum(map(len, bags)))
    mean = sum((bag.sum(axis=0, dtype=np.float64) for bag in bags), np.zeros(WIDTH)) / n
    square = sum((((bag - mean) ** 2).sum(axis=0) for bag in bags), np.zeros(WIDTH)) / n
    mean, scale = mean.astype(np.float32), (1 / (np.sqrt(square) + 0.02)).astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    p = {
        "v": rng.normal(0, 0.1, (WIDTH, ATTENTION)), "u": rng.normal(0, 0.1, (WIDTH, ATTENTION)),
        "w": rng.normal(0, 0.1, ATTENTION), "c": np.zeros(WIDTH), "b": np.array(np.log(share / (1 - share))),
    }
    first = {k: np.zeros_like(x) for k, x in p.items()}
    second = {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for _ in range(EPOCHS if 0 < labels.sum() < len(labels) else 0):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = (np.concatenate([bags[i] for i in chosen]) - mean) * scale
            sizes = np.array([len(bags[i]) for i in chosen])
            doc, starts = np.repeat(np.arange(len(chosen)), sizes), np.cumsum(sizes) - sizes
            tan, gate = np.tanh(x @ p["v"]), _sigmoid(x @ p["u"])
            logits = (tan * gate) @ p["w"]
            a = np.exp(logits - np.maximum.reduceat(logits, starts)[doc])
            a /= np.add.reduceat(a, starts)[doc]
            s = x @ p["c"]
            pooled = np.add.reduceat(a * s, starts)
            error = (_sigmoid(pooled + p["b"]) - labels[chosen]) / len(chosen)
            d_logits = error[doc] * a * (s - pooled[doc])
            hidden = d_logits[:, None] * p["w"]
            grads = {
                "c": x.T @ (error[doc] * a) + DECAY * p["c"],
                "b": error.sum(),
                "w": (tan * gate).T @ d_logits,
                "v": x.T @ (hidden * gate * (1 - tan**2)) + DECAY * p["v"],
                "u": x.T @ (hidden * tan * gate * (1 - gate)) + DECAY * p["u"],
            }
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    f = {k: x.astype(np.float32) for k, x in p.items() if k != "b"}
    return AttentionModel(mean, scale, f["v"], f["u"], f["w"], f["c"], float(p["b"]))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS,
    train_passages: int = TRAIN_PASSAGES,
) -> AttentionModel:
    """Model from at most ``train_rows`` labelled documents, those of the smallest id hashes.

    Bags are whole: a document teaches with all its passages. ``train_passages`` bounds the passages of all bags together, so
    that fewer documents are taken where texts are long (the driver holds them, in half precision); a text with more passages than that teaches nothing. Rows with a
    null id or label teach nothing; of several labels of one id the majority counts, a tie is 1. Without both labels
    the score is their share.
    """
    marks = (
        labels.select(F.col(label_id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    known = marks.join(ids, "doc_id", "left_semi")
    sample = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "train")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.greatest(F.ceil(word_count(F.col("text")) / PASSAGE_WORDS), F.lit(1)).cast("bigint")
    labelled = stored(
        lookup_join(texts, sample, ["doc_id"], small=True).select("doc_id", "text", "label", size.alias("passages")), "labelled"
    )
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = labelled.groupBy("doc_id").agg(F.sum("passages").alias("passages")).where(F.col("passages") <= train_passages)
    taken = fitting.withColumn("all", F.sum("passages").over(order)).where(F.col("all") <= train_passages).select("doc_id")
    chosen = labelled.join(F.broadcast(taken), "doc_id", "left_semi").select("doc_id", "text", "label")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                bags: list[list[bytes]] = [[] for _ in range(high - low)]
                for x, doc in parts(batch.column(1).slice(low, high - low)):
                    for i in np.unique(doc).tolist():
                        bags[i].append(x[doc == i].astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(map(b"".join, bags), pa.binary())],
                    ["doc_id", "label", "bag"],
                )

    found = chosen.mapInArrow(passages, "doc_id bigint, label int, bag binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b.as_buffer(), np.float16).reshape(-1, WIDTH) for b in found.column("bag")]
    return train(bags, found.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every row's whole text: doc_id, score in 0 to 1. A null text is an empty one.

    A text of any length is encoded part by part and keeps two numbers per passage. Repeated rows stay repeated; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                scores = sent.value.scores(batch.column(1).slice(low, high - low))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(scores)], ["doc_id", "score"]
                )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, score double"
    )


def accept(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose whole text scores at least ``threshold``, with all their columns; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                yield part.filter(pa.array(sent.value.scores(part.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
