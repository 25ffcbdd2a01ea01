"""Encoding to piece ids and decoding, as the sentencepiece library does, over a table of distinct words.

When no piece of a model has a white-space marker behind another character, no merge crosses from one marked word to
the next (a marked word is a run of markers and what follows it up to the next marker). Then a text's ids are those of its
marked words in a row. So every distinct marked word is segmented once: texts are cut in blocks of bounded size; a block
lists its distinct words, dealt to buckets by a hash, and its texts keep the places of their words in that list. Each bucket
has all blocks' lists of its words and segments a word when it first meets it; the ids come back to the blocks list by list,
and to the texts by place. Lists travel as compressed bytes, a row per block and bucket. Texts of ids can be had with the ids,
from the task that joins them: a decoding step behind it would keep a second Python worker for every core at the same time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.words import slices
from edgelake.session import stored

MARKER = "▁"
MARKED = re.compile(" +[^ ]*")
BORDER = re.compile("(?<! ) ")
BLOCK_BYTES = 8 << 20
DECODED_IDS = 1 << 18
PART_CHARS = 1 << 20
BUCKETS_PER_PARTITION = 8
TEXTS = "block bigint, cut bigint, doc_ids array<bigint>, sizes array<int>, places binary, buckets binary"
LISTS = "block bigint, cut bigint, bucket int, words binary"


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def words_apart(library: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether pieces stay inside marked words, texts are taken as they are, and a text begins with a marker."""
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    probe = " Äﬁ́ \t  b\n "
    return library.normalize(probe) == MARKER + probe.replace(" ", MARKER) and not any(
        crossing.search(library.id_to_piece(i)) for i in range(library.get_piece_size())
    )


def marked_words(text: str) -> Iterator[list[str]]:
    """The marked words of a text in order, a list for each part of about PART_CHARS characters; blanks are markers."""
    text = " " + text.replace(MARKER, " ")
    at = 0
    while at < len(text):
        border = BORDER.search(text, at + PART_CHARS)
        end = border.start() if border else len(text)
        yield MARKED.findall(text, at, end)
        at = end


def segment(library: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[list[int]]:
    """Ids of marked words. The library puts a marker before a text that is not empty, so one is taken away."""
    ids = library.encode([w[1:] for w in words], num_threads=1)
    if " " in words:
        ids[words.index(" ")] = library.encode("a ")[len(library.encode("a")) :]
    return ids


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; the high ones are mostly zero."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, Iterator[str | None]]]:
    """Blocks of texts with their numbers, which hang on the partition and the order of its rows alone.

    A block's texts are made strings one by one, as they are asked for.
    """
    number = TaskContext.get().partitionId() << 36
    for batch in batches:
        for low, high in slices(batch.column(1), BLOCK_BYTES):
            texts = batch.column(1).slice(low, high - low)
            yield number, batch.column(0).slice(low, high - low), (text.as_py() for text in texts)
            number += 1


def _dealt(words: list[str], n_buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of each word, and a checksum of all of them."""
    buckets, cut = np.empty(len(words), np.int32), 0
    for i, word in enumerate(words):
        data = word.encode()
        buckets[i] = zlib.crc32(data) % n_buckets
        cut = zlib.crc32(data, cut)
    return buckets, cut


def _texts(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per block: its texts' ids, numbers of words and words' places, and the bucket of each place."""
    for number, ids, texts in _blocks(batches):
        places, found = _Places(), []
        for text in texts:
            parts = [
                np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                for words in (marked_words(text) if text else ())
            ]
            found.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        buckets, cut = _dealt(list(places), n_buckets)
        row = (number, cut, ids.to_pylist(), list(map(len, found)), _packed(np.concatenate(found)), _packed(buckets))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], kind) for x, kind in zip(row, kinds)], ["block", "cut", "doc_ids", "sizes", "places", "buckets"]
        )


def _lists_of_words(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per block and bucket: the words, in the order of their places."""
    for number, _, texts in _blocks(batches):
        places: dict[str, None] = {}
        for text in texts:
            for words in marked_words(text) if text else ():
                places.update(dict.fromkeys(words))
        words = np.array(list(places), object)
        buckets, cut = _dealt(words.tolist(), n_buckets)
        order = np.argsort(buckets, kind="stable")
        used, starts = np.unique(buckets[order], return_index=True)
        parts = np.split(words[order], starts[1:]) if len(used) else []
        lists = [zstandard.compress(json.dumps(part.tolist(), ensure_ascii=False).encode()) for part in parts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(used), number)), pa.array(np.full(len(used), cut)),
                pa.array(used, pa.int32()), pa.array(lists, pa.binary()),
            ],
            ["block", "cut", "bucket", "words"],
        )


def _segmented(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """Ids of lists of words that come bucket by bucket; what a bucket has met is kept until its end."""
    library, known, current = load(model), {}, None
    for batch in batches:
        out = []
        for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words")):
            if bucket != current:
                known, current = {}, bucket
            words = json.loads(zstandard.decompress(words.as_py()))
            new = [w for w in words if w not in known]
            known.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(new, segment(library, new)))
            ids = [known[w] for w in words]
            sizes = np.fromiter((len(x) // 4 for x in ids), "<u4", len(ids))
            out.append(_packed(np.concatenate([sizes, np.frombuffer(b"".join(ids), "<u4")])))
        columns = [batch.column(c) for c in ("block", "cut", "bucket")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["of_block", "cut", "bucket", "ids"])


def _joined(
    texts: pa.Table, known: pa.Table, end: list[int], decoder: Decoder | None = None, decoded: str | None = None
) -> pa.Table:
    """Ids of a block's texts: its lists by bucket hold its words' ids in the order of their buckets and places.

    With a decoder, also the texts of the ids, as ``decoded``.
    """
    if texts.num_rows != 1 or any(c != texts.column("cut")[0] for c in known.column("cut")):
        raise RuntimeError("the rows came in another order when they were read again; call encode with store=True")
    row = texts.to_pylist()[0]
    buckets, places = _unpacked(row["buckets"]), _unpacked(row["places"])
    sizes, flat = [], []
    counts = dict(zip(*(x.tolist() for x in np.unique(buckets, return_counts=True))))
    for x in known.sort_by("bucket").to_pylist():
        values = _unpacked(x["ids"])
        sizes.append(values[: counts[x["bucket"]]])
        flat.append(values[counts[x["bucket"]] :])
    order = np.argsort(buckets, kind="stable")
    size, begin = np.zeros((2, len(buckets)), np.int64)
    if len(sizes) < len(counts):
        raise RuntimeError("the rows came in another order when they were read again; call encode with store=True")
    if sizes:
        size[order] = np.concatenate(sizes)
        begin[order] = np.cumsum(size[order]) - size[order]
    ids = np.concatenate([*flat, np.array(end, "<u4")]).astype(np.int32)
    out, at = [], 0
    for n in row["sizes"]:
        own = places[at : at + n]
        at += n
        k = size[own]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out.append(np.concatenate([ids[np.repeat(begin[own], k) + inside], ids[len(ids) - len(end) :]]))
    lists = _lists(out, pa.int32())
    columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": lists}
    return pa.table(columns if decoder is None else {**columns, decoded: decoder.of_lists(lists)})


def encode(
    docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True, store: bool = False,
    decoded: str | None = None,
) -> DataFrame:
    """Ids of every row's whole text, with the model's end id behind them: doc_id, ids.

    ``decoded`` names a further column with the text of the ids, what ``decode`` gives. The task that joins ids decodes them.

    ``docs`` is read twice, once for the words and once for their places, and is to be a table: partitions and the order of their
    rows must be the same both times. A checksum per block tells if they are not, and the job then fails. ``store`` writes
    the texts first, for frames that may be computed differently.

    ``model`` is the content of a model file. A null text is an empty one; it has the end id only. Repeated
    rows stay repeated, a null id stays null, no rows give no rows; other columns are not read. A text of any length
    is one row and one block of its own; it is cut in parts while its words are looked up. A task that segments holds the
    distinct words of one bucket; there are BUCKETS_PER_PARTITION buckets per shuffle partition. With a model whose
    pieces cross markers, or one that changes texts, there is nothing to share: every text is segmented as a whole.
    """
    if decoded in ("doc_id", "ids"):
        raise ValueError(f"{decoded!r} is a column of its own")
    library = load(model)
    end = [library.eos_id()] if add_end else []
    schema = "doc_id bigint, ids array<int>" + (f", `{decoded}` string" if decoded else "")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.column(1).slice(low, high - low).fill_null("").to_pylist()
                ids = _lists([np.array([*x, *end], np.int32) for x in own.encode(part, num_threads=1)], pa.int32())
                columns = {"doc_id": batch.column(0).slice(low, high - low), "ids": ids}
                yield pa.RecordBatch.from_pydict(columns | ({decoded: _decoder(model).of_lists(ids)} if decoded else {}))

    if not words_apart(library):
        return texts.mapInArrow(whole, schema)

    n_buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if store:
        texts = stored(texts, "texts")
    lists = texts.mapInArrow(lambda batches: _lists_of_words(batches, n_buckets), LISTS)
    found = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: _segmented(batches, model), "of_block bigint, cut bigint, bucket int, ids binary"
    )
    blocks = texts.mapInArrow(lambda batches: _texts(batches, n_buckets), TEXTS)
    return blocks.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(
        lambda left, right: _joined(left, right, end, _decoder(model) if decoded else None, decoded), schema
    )


class Decoder:
    """Texts of ids from the bytes of their pieces, joined for many texts at once.

    The library itself decodes what is not plain: ids that are no normal, byte or control piece, texts that do not begin with a
    normal piece, and bytes that are no UTF-8.
    """

    def __init__(self, model: bytes):
        library = self.library = load(model)
        n = library.get_piece_size()
        pieces = [library.id_to_piece(i).replace(MARKER, " ").encode() for i in range(n)]
        pieces = [
            bytes([int(p[3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else p
            for i, p in enumerate(pieces)
        ]
        self.plain = np.array([not (library.is_unknown(i) or library.is_unused(i)) for i in range(n)])
        self.normal = self.plain & np.array([not (library.is_byte(i) or library.is_control(i)) for i in range(n)])
        self.blank = np.array([p[:1] == b" " for p in pieces])
        self.sizes = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        known = (ids >= 0) & (ids < len(self.sizes))
        safe = np.where(known, ids, 0)
        known &= self.plain[safe]
        sizes = self.sizes[safe]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(self.starts[safe] - ends[:-1], sizes) + np.arange(ends[-1])
        data, odd = self.data[places].tobytes(), np.concatenate([[0], np.cumsum(~known)])
        out = []
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if low == high:
                out.append("")
                continue
            if odd[high] == odd[low] and self.normal[safe[low]]:
                try:
                    out.append(data[ends[low] + self.blank[safe[low]] : ends[high]].decode())
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.library.decode(ids[low:high].tolist()))
        return out

    def of_lists(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids, about DECODED_IDS ids at once; a null list is an empty one."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, flat = np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().fill_null(-1).to_numpy()
        texts, low = [], 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + DECODED_IDS, side="right")) - 1)
            texts.append(
                pa.array(self.texts(flat[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]), pa.string())
            )
            low = high
        return pa.concat_arrays(texts) if texts else pa.array([], pa.string())


@lru_cache(maxsize=1)
def _decoder(model: bytes) -> Decoder:
    """One decoder for all blocks of a worker."""
    return Decoder(model)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids in ``out``; a null list is an empty one, and other columns stay as they are.

    ``out`` must be no column of ``rows``. An id the model does not have is an error of the library.
    """
    if out in rows.columns:
        raise ValueError(f"rows have a column {out!r}")
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _decoder(model).of_lists(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out])

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(out)).schema)
