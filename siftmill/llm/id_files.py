"""Token ids of documents in files of Simple-8b words, in ascending order of doc_id.

A file holds whole documents and these parts, all of 64-bit little-endian numbers but for the head:
head (magic, ids a block, crc32 of the rest, six sizes), words, whole numbers of the escapes, first
word and first escape of each block, doc_ids, end of each document among the file's ids. So any run
of ids is read by its blocks alone. Documents with a null id come first and are only counted.

Texts are sorted by ranges of doc_id and encoded where they land, and the task that encodes a range
writes its files. A file's name holds the task's attempt; the table of files, which Spark commits,
says which ones count. Reading starts from that table: the ids of all earlier files are added up and
each file is decoded by one task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import simple8b
from siftmill.llm.common import slices_by_size, stored, table_of, whole_texts
from siftmill.llm.token_count import _ODD
from siftmill.operators.ranking import sums_before
from siftmill.session import scratch, shuffle_width

END_ID = 0
# A file is closed behind the document that fills it.
FILE_IDS = 2 << 20
SLICE_BYTES = 4 << 20
# Bytes of the table that one task sorts, encodes and writes, about.
PART_BYTES = 96 << 20
# Pre-tokens whose ids a worker remembers; beyond it the memory starts anew, the ids are the same.
REMEMBERED = 1_400_000
_ALONE = 500
# Latin-1 characters that the quick cut knows.
_USUAL = bytes(b for b in range(256) if not _ODD.match(chr(b)))
# Kinds of the bytes of texts without odd characters, whose bytes above 127 all belong to letters.
_MARK, _WHITE, _LETTER, _DIGIT, _OTHER = range(5)
_KINDS = bytes(
    _MARK if c == "\0" else _WHITE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER
    for c in map(chr, range(128))
) + bytes([_LETTER]) * 128
_MAGIC = b"IDS8B\x00\x00\x01"
_HEAD = "<8sII6Q"
_FILES = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
    ("n_ids", pa.int64()),
])
_DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
])


def _starts(raw: bytes) -> np.ndarray:
    """Where the pre-tokens of texts without odd characters begin; each text ends with a zero byte,
    which is one of its own."""
    data = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
    start = kind == _MARK
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    # The last of the white characters before a word stands alone; as a blank, it leads the word.
    led = (kind[:-1] == _WHITE) & (kind[1:] > _WHITE)
    start[:-1] |= led
    start[1:] &= ~(led & (data[:-1] == 32))
    # Short forms: an apostrophe that begins a pre-token takes the letters behind it.
    at = np.flatnonzero(start & (data == 39))
    first, second = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    for letters, n in (("s", 1), ("t", 1), ("m", 1), ("d", 1), ("re", 2), ("ve", 2), ("ll", 2)):
        here = first == ord(letters[0])
        if n > 1:
            here &= second == ord(letters[1])
        start[at[here] + 1] = False
        start[at[here] + 1 + n] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts by the tokenizers library with a byte-level vocabulary.

    The texts of a call are cut into pre-tokens and these are numbered as arrays, so that only their
    distinct ones are looked up; the ids of all places are taken by number. Pre-tokens do not
    influence one another, so each distinct one goes through the library once, many in one text:
    those of one blank and what follows it stand behind one another, as a token with a leading blank
    begins each of them, others have an added token in between. Texts with added tokens, or with
    characters whose classes depend on the Unicode version, go through it as they are.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the library would only hand its work around.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        added = self.library.get_added_tokens_decoder()
        self.mark_id, mark = next(iter(added.items()))
        self.mark = mark.content
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()))
        vocabulary = self.library.get_vocab()
        blank = self.library.id_to_token(self.library.encode(" ", add_special_tokens=False).ids[0])
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(blank)]] = True
        self.known: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        led, others = [], []
        for p in pieces:
            (led if p[0] == 32 and len(p) > 1 and not p[1:2].isspace() else others).append(p)
        for some, between in ((led, b""), (others, self.mark.encode())):
            groups = [some[i:i + _ALONE] for i in range(0, len(some), _ALONE)]
            lines = [between.join(g).decode() for g in groups]
            for group, made in zip(groups, self._library(lines), strict=True):
                raw = made.tobytes()
                if between:
                    ends = np.append(np.flatnonzero(made == self.mark_id), len(made)) * 4
                    starts = np.append(0, ends[:-1] + 4)
                else:
                    starts = np.flatnonzero(self.begins[made]) * 4
                    ends = np.append(starts[1:], len(raw))
                for piece, i, j in zip(group, starts.tolist(), ends.tolist(), strict=True):
                    self.known[piece] = raw[i:j]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        made = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(m.ids, "<u4") for m in made]

    def _whole(self, text: str) -> bool:
        """Whether the library must cut the text."""
        try:
            odd = text.encode("latin-1").translate(None, _USUAL)
        except UnicodeEncodeError:
            odd = _ODD.search(text)
        return bool(odd or self.added.search(text))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that the quick cut knows."""
        raw = "".join([t + "\0" for t in texts]).encode()
        starts = _starts(raw)
        offsets = np.append(starts, len(raw))
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        # The mark behind each text has no ids.
        self.known[b"\0"] = b""
        found = list(map(self.known.get, distinct))
        late = [i for i, ids in enumerate(found) if ids is None]
        self._learn([distinct[i] for i in late])
        for i in late:
            found[i] = self.known[distinct[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = pieces.indices.to_numpy()
        held = sizes[number]
        ends = np.cumsum(held)
        # From each place of the result to the same id among those of the distinct pre-tokens.
        place = np.repeat((np.cumsum(sizes) - sizes)[number] - (ends - held), held)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        last = ends[np.frombuffer(raw, np.uint8)[starts] == 0] * 4
        return [ids[i:j] for i, j in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        whole = [self._whole(t) for t in texts]
        odd = iter(self._library([t for t, w in zip(texts, whole, strict=True) if w]))
        plain = [t for t, w in zip(texts, whole, strict=True) if not w]
        made = iter(self._plain(plain) if plain else [])
        return [next(odd).tobytes() if w else next(made) for w in whole]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass
class IdFile:
    """What a file holds."""

    coded: simple8b.Coded
    doc_ids: list[int | None]
    ends: np.ndarray

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from place `start` of the file up to `end`, by their blocks alone."""
        size = self.coded.block
        first, last = start // size, -(-end // size)
        return simple8b.decode(self.coded, first, last)[start - first * size:end - first * size]


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, block: int = simple8b.BLOCK) -> bytes:
    """A file of the documents' ids, which lie behind one another; null ids are the first."""
    coded = simple8b.encode(ids, block)
    known = [i for i in doc_ids if i is not None]
    body = b"".join(
        np.asarray(part).astype(kind).tobytes()
        for part, kind in (
            (coded.words, "<u8"), (coded.escapes, "<u8"), (coded.word_at, "<u8"), (coded.escape_at, "<u8"),
            (known, "<i8"), (ends, "<u8"),
        )
    )
    sizes = (len(doc_ids), len(known), len(ids), len(coded.word_at) - 1, len(coded.words), len(coded.escapes))
    return struct.pack(_HEAD, _MAGIC, block, zlib.crc32(body), *sizes) + body


def from_bytes(data: bytes) -> IdFile:
    """The file's parts as views of `data`; damaged files are errors."""
    magic, block, check, docs, known, ids, blocks, words, escapes = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC or zlib.crc32(memoryview(data)[struct.calcsize(_HEAD):]) != check:
        raise ValueError("not a whole file of ids")
    at, parts = struct.calcsize(_HEAD), []
    for n, kind in (
        (words, "<u8"), (escapes, "<u8"), (blocks + 1, "<u8"), (blocks + 1, "<u8"), (known, "<i8"), (docs, "<u8"),
    ):
        parts.append(np.frombuffer(data, kind, n, at))
        at += 8 * n
    coded = simple8b.Coded(ids, *parts[:4], block)
    return IdFile(coded, [None] * (docs - known) + parts[4].tolist(), parts[5])


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _write_file(path: str, data: bytes) -> None:
    system, path = _place(path)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def _read_file(path: str) -> bytes:
    system, path = _place(path)
    with system.open_input_stream(path, compression=None) as file:
        return file.read()


def _bytes_of(docs: DataFrame, text: str) -> int:
    """About the bytes of the table: those of its files, or, if no files say so, of its texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def write(
    docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID,
    file_ids: int = FILE_IDS, ident: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(part, seq, path, n_docs, n_ids) of the files written, in the order of (part, seq).

    `folder` must be one that all executors share (default: one below `spark.checkpoint.dir`).
    Null and empty texts hold the end id alone. Documents with a null id come first; those with one
    id follow the hash of their texts, repeated rows stay; an empty table has no files.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "id-files")
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()
    system, place = _place(folder)
    system.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        seq, doc_ids, held, ends, size = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/part-{part:06d}-{seq:05d}-{attempt}.ids"
            _write_file(name, to_bytes(np.frombuffer(b"".join(held), "<u4"), doc_ids, np.array(ends)))
            row = (part, seq, name, len(doc_ids), size)
            return table_of({n: [v] for n, v in zip(_FILES.names, row, strict=True)}, _FILES)

        for batch in slices_by_size(batches, "text", SLICE_BYTES):
            made = encoder(path)(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), made, strict=True):
                held += ids, end
                size += len(ids) // 4 + 1
                doc_ids.append(doc_id)
                ends.append(size)
                if size >= file_ids:
                    yield close()
                    seq, doc_ids, held, ends, size = seq + 1, [], [], [], 0
        if doc_ids:
            yield close()

    # Equal rows may take any order, so a random number spreads them over ranges.
    keyed = whole_texts(docs, ident, text).select("*", F.xxhash64("text").alias("hash"), F.rand(42).alias("spread"))
    order = ["doc_id", "hash", "spread"]
    width = max(spark.sparkContext.defaultParallelism, -(-_bytes_of(docs, text) // PART_BYTES))
    rows = keyed.repartitionByRange(width, *order).sortWithinPartitions(*order)
    files = rows.select("doc_id", "text").mapInArrow(
        run, "part int, seq int, path string, n_docs long, n_ids long"
    )
    return stored(files, "id-file-list")


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files: the ids of all documents
    before it, the number of its own and their checksum as unsigned 32-bit numbers."""
    spark = files.sparkSession
    slim = files.select("part", "seq", "path", "n_ids")
    placed = sums_before(slim, ["part", "seq"], {"before": F.col("n_ids")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(batch.column(n).to_pylist() for n in ("path", "before")), strict=True):
                file = from_bytes(_read_file(path))
                ids = memoryview(simple8b.decode(file.coded).astype("<u4").tobytes())
                ends = file.ends.astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                yield table_of({
                    "doc_id": file.doc_ids, "start": before + starts, "n_tokens": ends - starts,
                    "ids_crc32": [
                        zlib.crc32(ids[4 * i:4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)
                    ],
                }, _DIGESTS)

    spread = placed.select("path", "before").repartition(shuffle_width(spark))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """The digests of all documents, written to files and read back."""
    return read_digests(write(docs, **options))
