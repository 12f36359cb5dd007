"""Token ids in binary files: frequency-ranked ids, variable-length bytes, control bytes apart.

Texts are encoded by a tokenizer of the tokenizers library and end with ``end_id``. Ids are counted
over the whole corpus and replaced by their rank, so the most frequent 256 take one byte, the next
65,280 two. A document is a run of control bytes, two bits an id for its length of 1 to 4 bytes, and
a run of data bytes, little-endian. Files hold documents in ascending order of their id, in blocks of
about ``BLOCK_IDS`` ids:

    file   magic, uint32 number of ranks, uint32 id of each rank, blocks
    block  uint32 documents, uint64 control bytes, uint64 data bytes,
           documents x (int64 doc_id, uint8 1 without doc_id, uint64 ids), control bytes, data bytes

All numbers are little-endian. Reading looks up the four lengths of each control byte in a table of
256 rows, sums them to the place of each id, and looks its rank up in the file's ids.

The tokenizer must drop white space and never join across it, nor across a letter and the stop behind
it; one that does is refused. So a text is cut there, and each distinct part is encoded once in a worker
process, however often it comes (``PIECES_KEPT`` parts are remembered). The corpus is tokenized once, into a table
that the count and the files read. Files are written by tasks that hold a range of document ids; a
task run again writes new files, and only files named in the manifest, which Spark commits, are read.

A null or empty text holds only the end id. Rows without id come first. Rows that repeat an id are
documents each, in the order of their texts' digests. Other columns are ignored; ids are whole
numbers. Memory follows a block and the longest text. An empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import os
import struct
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import drop_written, new_path, small_batches, written

MAGIC = b"SRTOKID1"
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 25
SLICE_BYTES = 1 << 23
PIECES_KEPT = 1 << 20
BLOCK = "<IQQ"
DOCUMENT = np.dtype([("doc_id", "<i8"), ("unnamed", "u1"), ("ids", "<u8")])

# The four lengths that a control byte stands for.
LENGTHS = (np.arange(256, dtype=np.int64)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1

_STOPS = frozenset(".,;:!?")
# No token spans a letter and a stop behind it: pattern and replacement that part them.
_CUT = (r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?])", r"\1 \2")


def control_bytes(ids: np.ndarray) -> np.ndarray:
    """Control bytes that documents with so many ids take; each begins a new one."""
    return (ids + 3) // 4


def _places(ids: np.ndarray) -> np.ndarray:
    """The place of each id among the two-bit codes, where documents begin at whole bytes."""
    gap = 4 * control_bytes(ids) - ids
    return np.arange(int(ids.sum())) + np.repeat(np.cumsum(gap) - gap, ids)


def encode(ranks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of the ranks of some documents with ``ids`` ids each."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(4 * int(control_bytes(ids).sum()), np.uint8)
    codes[_places(ids)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control, data


def decode(control: np.ndarray, data: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ranks that :func:`encode` was given."""
    length = LENGTHS[control].ravel()[_places(ids)]
    end = np.cumsum(length)
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    ranks = np.zeros(len(length), np.uint32)
    for byte in range(int(length.max(initial=0))):
        longer = np.flatnonzero(length > byte)
        ranks[longer] |= padded[(end - length)[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


class Pieces:
    """Ids of the distinct parts of texts, one array after the other.

    Part ``i`` has ``ids[at[i]:at[i + 1]]``. Texts are split, parts told apart and looked up by Arrow
    and one dictionary, so Python's work follows the distinct parts of a slice of texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts, whole = (self._ids(text) for text in ("a. A\nb", "a.  a b"))
        if parts != whole or whole != [i for part in "a.ab" for i in self._ids(part)]:
            raise ValueError(f"{path}: the tokenizer keeps white space or joins words and stops")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            vocabulary = self.tokenizer.get_vocab().items()
            self.ends[[i for token, i in vocabulary if token.endswith(suffix)]] = True
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Encode parts not seen before."""
        simple = [part for part in parts if part.isalpha() or part in _STOPS] if self.ends.any() else []
        for first in range(0, len(simple), 256):
            self._store(simple[first : first + 256], *self._joined(simple[first : first + 256]))
        others = [part for part in parts if part not in self.number]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in found], np.int64)
        self._store(others, np.array([i for ids in found for i in ids], np.uint32), sizes)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, encoded as one text: ids that end a word tell them apart.

        Each word has such an id at its end, so if there are no more of them than words, none is split.
        """
        ids = np.array(self._ids(" ".join(words)), np.uint32)
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) == len(words):
            return ids, np.diff(end, prepend=0)
        found = [self._ids(word) for word in words]
        sizes = np.array([len(ids) for ids in found], np.int64)
        return np.array([i for ids in found for i in ids], np.uint32), sizes

    def _store(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        have = len(self.number)
        begin = int(self.at[have])
        self.ids = _grown(self.ids, begin + len(ids))
        self.at = _grown(self.at, have + len(parts) + 1)
        self.ids[begin : begin + len(ids)] = ids
        self.at[have + 1 : have + len(parts) + 1] = begin + np.cumsum(sizes)
        self.number.update(zip(parts, range(have, have + len(parts))))

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers of distinct parts."""
        known = parts.to_pylist()
        if len(self.number) > PIECES_KEPT:
            self.clear()
        unseen = [part for part in known if part not in self.number]
        if unseen:
            self.learn(unseen)
        return np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of an Arrow string array without nulls."""
        split = pc.ascii_split_whitespace(texts)
        pieces = split.flatten().dictionary_encode()
        cut = pc.split_pattern(pc.replace_substring_regex(pieces.dictionary, *_CUT), " ")
        parts = cut.flatten().dictionary_encode()
        # ASCII letters are lowered by the tokenizer too, but its own tokens are matched before.
        plain = pc.and_not(
            pc.string_is_ascii(parts.dictionary), pc.match_substring(parts.dictionary, "<|")
        )
        same = pc.if_else(plain, pc.ascii_lower(parts.dictionary), parts.dictionary).dictionary_encode()
        number = self.numbers(same.dictionary)[same.indices.to_numpy()][parts.indices.to_numpy()]
        # Ids of each distinct piece, its parts one after the other
        ids, sizes = _runs(self.ids, self.at, number)
        part_ends = np.concatenate(([0], np.cumsum(sizes)))
        at = part_ends[cut.offsets.to_numpy()]
        ids, sizes = _runs(ids, at, pieces.indices.to_numpy())
        ends = np.concatenate(([0], np.cumsum(sizes)))[split.offsets.to_numpy()]
        return ids, np.diff(ends)


def _runs(values: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[at[i]:at[i + 1]]`` of the chosen ``i``, joined, and their lengths."""
    first, size = at[chosen], at[chosen + 1] - at[chosen]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return values[np.arange(total) + np.repeat(first - end + size, size)], size


def _grown(values: np.ndarray, least: int) -> np.ndarray:
    if least <= len(values):
        return values
    return np.concatenate((values, np.zeros(max(least - len(values), len(values)), values.dtype)))


def pieces_of(path: str) -> Pieces:
    """The pieces of a tokenizer file, kept for all tasks of a worker process."""
    kept = sys.modules.setdefault("_stayrate_pieces", types.ModuleType("_stayrate_pieces"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.pieces = path, Pieces(path)
    return kept.pieces


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``SLICE_BYTES``; null texts are empty."""
    texts = texts.fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = done = 0
    while first < len(texts):
        last = max(int(np.searchsorted(sizes, done + SLICE_BYTES, "right")), first + 1)
        yield texts[first:last]
        first, done = last, int(sizes[last - 1])


def tokenized(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, digest, row, n_tokens, ids): compressed uint32 ids of each text, end id included.

    ``path`` is the tokenizer file, as workers see it. ``row`` tells equal rows apart.
    """
    small_batches(docs.sparkSession)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        tool = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u4").tobytes()
        row = 0
        for batch in batches:
            digests, sizes, packed = [], [], []
            for texts in slices(batch.column(1)):
                ids, counts = pieces.encode(texts)
                content, place = ids.astype("<u4").tobytes(), 0
                for text, count in zip(texts, counts.tolist()):
                    digest = hashlib.blake2b(text.as_buffer(), digest_size=8).digest()
                    digests.append(int.from_bytes(digest, "little", signed=True))
                    sizes.append(count + 1)
                    packed.append(tool.compress(content[place : place + 4 * count] + end))
                    place += 4 * count
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests, pa.int64()),
                    pa.array(range(row, row + len(digests)), pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                names=["doc_id", "digest", "row", "n_tokens", "ids"],
            )
            row += len(digests)

    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(
        tokenize, "doc_id bigint, digest bigint, row bigint, n_tokens bigint, ids binary"
    )


def ranked_ids(tokens: DataFrame) -> np.ndarray:
    """All ids of a tokenized table by falling frequency, ties by id; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                ids = np.frombuffer(tool.decompress(value.as_buffer()), "<u4")
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id bigint, n bigint")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (counts[c].to_numpy() for c in ("id", "n"))
    return ids[np.lexsort((ids, -n))].astype("<u4")


def write_files(tokens: DataFrame, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Files of about ``file_ids`` ids below ``folder``; the manifest (shard, file, documents, ids).

    ``shard`` numbers the files in the order of their documents.
    """
    spark = tokens.sparkSession
    ids = ranked_ids(tokens)
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    head = MAGIC + struct.pack("<I", len(ids)) + ids.tobytes()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        store, place = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.tokens"
        out, shard, documents, total, held = None, None, 0, 0, 0
        rows: list[tuple[int, int, int]] = []
        parts: list[np.ndarray] = []

        def flush() -> None:
            table = np.array(rows, DOCUMENT)
            control, data = encode(np.concatenate(parts), table["ids"].astype(np.int64))
            out.write(struct.pack(BLOCK, len(rows), len(control), len(data)))
            for content in (table, control, data):
                out.write(content.tobytes())

        for batch in batches:
            for number, doc_id, value in zip(*(batch.column(i) for i in range(3))):
                if out is None:
                    shard = number.as_py()
                    out = store.open_output_stream(f"{place}/{name}")
                    out.write(head)
                doc_id = doc_id.as_py()
                parts.append(rank[np.frombuffer(tool.decompress(value.as_buffer()), "<u4")])
                rows.append((doc_id or 0, doc_id is None, len(parts[-1])))
                documents, total = documents + 1, total + len(parts[-1])
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    flush()
                    rows, parts, held = [], [], 0
        if out is None:
            return
        if rows:
            flush()
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in (shard, f"{folder}/{name}", documents, total)],
            names=["shard", "file", "documents", "ids"],
        )

    total = tokens.agg(F.expr("coalesce(sum(n_tokens), 0)")).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // file_ids + 1)
    order = ["doc_id", "digest", "row"]
    dealt = (
        tokens.drop("n_tokens")
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().cast("bigint").alias("shard"), "doc_id", "ids")
    )
    schema = "shard bigint, file string, documents bigint, ids bigint"
    return written(dealt.mapInArrow(save, schema), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, in the order of the files.

    ``start`` is the number of ids before the document, ``ids`` its ids as little-endian uint32.
    Only the manifest, a row for each file, passes through the driver.
    """
    spark = manifest.sparkSession
    files = manifest.orderBy("shard").collect()
    start, rows = 0, []
    for file in files:
        rows.append((file["file"], start))
        start += file["ids"]
    frame = spark.createDataFrame(rows, "file string, start bigint")
    frame = frame.repartition(max(1, min(len(rows), 10_000)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = pa.fs.FileSystem.from_uri(uri)
                with store.open_input_stream(place) as file:
                    if file.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{uri} is no token file")
                    (known,) = struct.unpack("<I", file.read(4))
                    ids_of = np.frombuffer(file.read(4 * known), "<u4")
                    while head := file.read(struct.calcsize(BLOCK)):
                        documents, *sizes = struct.unpack(BLOCK, head)
                        table = np.frombuffer(file.read(documents * DOCUMENT.itemsize), DOCUMENT)
                        control, data = (np.frombuffer(file.read(n), np.uint8) for n in sizes)
                        counts = table["ids"].astype(np.int64)
                        ids = ids_of[decode(control, data, counts)]
                        ends = np.concatenate(([0], np.cumsum(counts)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(table["doc_id"], mask=table["unnamed"] == 1),
                                pa.array(start + ends[:-1]),
                                pa.array(counts),
                                pa.array(
                                    [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()
                                ),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        start += int(ends[-1])

    return frame.mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Tokenize ``docs``, write the files and return their manifest."""
    tokens = written(tokenized(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    manifest = write_files(tokens, folder or new_path(docs.sparkSession, "token-files"))
    drop_written(tokens)
    return manifest
