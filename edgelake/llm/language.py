"""Language identification by mixture inference.

A language is a distribution over hashed byte trigrams of letters. A document is a mixture of languages: each run
of words has a likelihood under every language, and expectation-maximisation finds the proportions that
explain all its runs. Languages enter the mixture one by one, the most helpful first, as long as the likelihood
grows by more than a penalty for one more proportion. The language with the largest proportion is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.words import _offsets, slices

BUCKETS = 1 << 15
SMOOTHING = 0.5
RUN_WORDS = 8
TEMPER = 0.5
PENALTY = 3.0
EM_STEPS = 10
UNKNOWN = "und"


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram inside a word, the word it is in, and the text of each word.

    Letters are a-z after lower-casing and all bytes of other scripts; a word is a run of them with one blank
    on either side.
    """
    texts = pc.utf8_lower(texts.fill_null(""))
    at = _offsets(texts).astype(np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    before = np.zeros(len(data) + 1, bool)
    before[1:] = letter
    before[at] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = letter
    after[at] = False
    begins = letter & ~before[:-1]
    places = np.flatnonzero(letter)
    own = data[places].astype(np.uint32)
    left = np.where(before[places], np.concatenate([[0], data])[places], 32).astype(np.uint32)
    right = np.where(after[places + 1], np.concatenate([data, [0]])[places + 1], 32).astype(np.uint32)
    buckets = ((left << 16 | own << 8 | right) * np.uint32(2654435761)) >> np.uint32(32 - 15)
    word = np.cumsum(begins[places]) - 1
    doc = np.searchsorted(at, places[begins[places]], side="right") - 1
    return buckets, word, doc


def ngram_counts(labelled: DataFrame) -> DataFrame:
    """Trigram counts of all rows (lang, text): lang, bucket, n. Every task sums its rows before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            numbers = np.array([names.index(x) for x in langs])
            for low, high in slices(batch.column(1)):
                buckets, word, doc = _trigrams(batch.column(1).slice(low, high - low))
                own = numbers[low:high][doc][word] if len(doc) else np.zeros(0, np.int64)
                found = np.bincount(own * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, found):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(row[used])],
                ["lang", "bucket", "n"],
            )

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Logarithms of trigram probabilities, one row per language in name order."""

    langs: list[str]
    logs: np.ndarray

    def mixtures(self, texts: pa.Array) -> np.ndarray:
        """Proportions of the languages in each text; zeros where a text has no letters."""
        buckets, word, doc = _trigrams(texts)
        shares = np.zeros((len(texts), len(self.langs)))
        if not len(doc) or not self.langs:
            return shares
        in_doc = np.arange(len(doc)) - np.searchsorted(doc, doc)
        new = np.flatnonzero(in_doc % RUN_WORDS == 0)
        run_doc = doc[new]
        starts = np.searchsorted(word, new)
        logs = np.stack([np.add.reduceat(row[buckets], starts) for row in self.logs], axis=1).astype(np.float64) * TEMPER
        docs, first, runs = np.unique(run_doc, return_index=True, return_counts=True)
        shares[docs] = _mixtures(logs, first, runs)
        return shares


def _mixtures(logs: np.ndarray, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Proportions for documents whose runs of words have these log-likelihoods (runs x languages)."""
    of = np.repeat(np.arange(len(first)), runs)
    top = logs.max(axis=1, keepdims=True)
    likely = np.exp(logs - top)
    singles = np.add.reduceat(logs - top, first, axis=0)
    best = singles.argmax(axis=1)
    shares = np.zeros(singles.shape)
    rows = np.arange(len(first))
    shares[rows, best] = 1.0
    gained = singles[rows, best]
    going = rows
    while len(going) and shares.shape[1] > 1:
        mask = np.zeros(len(first), bool)
        mask[going] = True
        used = np.flatnonzero(mask[of])
        here = np.searchsorted(going, of[used])
        cuts = np.searchsorted(here, np.arange(len(going)))
        part, own = likely[used], shares[going]
        mixed = np.maximum((part * own[here]).sum(axis=1), 1e-300)
        slope = np.add.reduceat(part / mixed[:, None], cuts, axis=0) / runs[going][:, None]
        slope[own > 0] = -np.inf
        add = slope.argmax(axis=1)
        trial = own * 0.8
        trial[np.arange(len(going)), add] += 0.2
        for _ in range(EM_STEPS):
            parts = part * trial[here]
            trial = np.add.reduceat(parts / np.maximum(parts.sum(axis=1), 1e-300)[:, None], cuts, axis=0) / runs[going][:, None]
        found = np.add.reduceat(np.log(np.maximum((part * trial[here]).sum(axis=1), 1e-300)), cuts)
        better = (slope.max(axis=1) > 1) & (found - gained[going] > PENALTY * np.log(runs[going] + 1))
        shares[going[better]] = trial[better]
        gained[going[better]] = found[better]
        going = going[better]
    return shares


def fit(labelled: DataFrame) -> LanguageModel:
    """Model of the languages in rows (lang, text) over all of them; rows without a lang teach nothing.

    The driver receives at most BUCKETS counts per language.
    """
    counts = ngram_counts(labelled.where("lang IS NOT NULL")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(langs), BUCKETS))
    number = {name: i for i, name in enumerate(langs)}
    rows = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    if len(rows):
        table[rows, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    logs = np.log((table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return LanguageModel(langs, logs.astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every row: doc_id, lang_pred, score (its proportion), langs and shares (the whole mixture).

    ``und`` with score 0 where a text is null or has no letter, or nothing was learned. Ties go to the first
    name. Repeated rows stay repeated; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sent.value.langs, object)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                texts = batch.column(1).slice(low, high - low)
                shares = sent.value.mixtures(texts)
                lettered = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
                rows: dict[str, list] = {"lang_pred": [], "score": [], "langs": [], "shares": []}
                for share, ok in zip(shares, lettered):
                    known = ok and share.any()
                    used = np.flatnonzero(share > 0) if known else np.zeros(0, np.int64)
                    rows["lang_pred"].append(names[share.argmax()] if known else UNKNOWN)
                    rows["score"].append(min(1.0, float(share.max())) if known else 0.0)
                    rows["langs"].append(names[used].tolist())
                    rows["shares"].append(share[used].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(rows["lang_pred"], pa.string()),
                        pa.array(rows["score"], pa.float64()),
                        pa.array(rows["langs"], pa.list_(pa.string())),
                        pa.array(rows["shares"], pa.list_(pa.float64())),
                    ],
                    ["doc_id", "lang_pred", "score", "langs", "shares"],
                )

    schema = "doc_id bigint, lang_pred string, score double, langs array<string>, shares array<double>"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(label, schema)
