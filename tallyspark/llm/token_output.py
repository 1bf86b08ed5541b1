"""Token ids in binary files, each document compressed by itself with a shared dictionary.

A zstandard dictionary is trained on the serialised ids of a bounded sample of documents
(``SAMPLE_DOCS`` documents, ``SAMPLE_TOKENS`` ids of each) and saved under its SHA-256. Ids
are little-endian unsigned integers of 2 bytes where the vocabulary allows, else 4, with
``END`` after each document. Compressed documents are put in ascending order of id over a range
partitioning; each range is one file:

    TIDS1\\n                   magic
    frames                    a zstandard frame for each document
    index                     Arrow stream: id, place of the frame in the file, ids before it in the file, number of ids
    place of the index (8 bytes), bytes of an id (1), SHA-256 of the dictionary (32), TIDS1\\n

A reader checks the hash of the dictionary, and finds one document with two reads. The
manifest of a dataset is a Parquet table of one row for each file; only files it names
count, so files of failed or doubled tasks are never read.

Texts are encoded by the tokenizers library where they are; only compressed ids are
shuffled. For byte-level vocabularies, texts are cut at single blanks and line ends
between other characters, and between letters and marks, where such vocabularies always
cut, and equal pieces are encoded once; other vocabularies get whole texts.

Edge cases: a null or empty text is a document of the end id alone; a null id comes
first; rows of equal id go by their ids' frames, whole copies are interchangeable; a very
long text is one frame; other columns are not read; an empty table gives a dataset
without files and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, quoted, shared_dir, stored

VOCABULARY = "byte_bpe_50k.json"
END = 0
SAMPLE_DOCS = 1_000
SAMPLE_TOKENS = 2_048
DICTIONARY_BYTES = 1 << 16
LEVEL = 1
#: Pieces of text whose ids a task remembers, in two generations.
REMEMBERED = 400_000
#: Texts that a task turns into Python strings at once.
AT_ONCE = 200
#: Bytes of ids in a batch that a reader hands on.
READ_BYTES = 1 << 22
MAGIC = b"TIDS1\n"
TAIL = "<QB32s6s"
#: Between characters that are no white space (in any table of Unicode), a blank begins a piece and a line end is one.
WHITE = "\\s\u180e\u200b\ufeff"
CUT = re.compile(f"(?<=[^{WHITE}])(?=[ \n][^{WHITE}])|(?<=[^{WHITE}]\n)(?=[^{WHITE}])")
BLANK = re.compile(f"[{WHITE}]")
#: Such a vocabulary cuts between letters and the marks after them; apostrophes may take letters along.
WORD_AND_MARKS = re.compile(r"( ?[^\W\d_]+)([^\w\s']+)")
#: Letters whose class is the same in all tables of Unicode that are in use.
LATIN = "\u0250"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Uneven(Exception):
    """A text with white space that the quick cut doesn't serve."""


class _Pieces(dict):
    """Ids of pieces of text, found when first asked for. Seldom used ones are forgotten."""

    def __init__(self, encode, letters):
        super().__init__()
        self.encode, self.letters, self.older = encode, letters, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            rest = piece[1:] if piece[:1] == " " else piece
            if rest.isalpha() and (rest.isascii() or max(rest) < LATIN):
                ids = self.letters(piece)
            elif not rest or (piece != "\n" and BLANK.search(rest)):
                raise _Uneven
            elif parts := WORD_AND_MARKS.fullmatch(piece):
                ids = self[parts[1]] + self[parts[2]]
            else:
                ids = self.encode(piece)
        self[piece] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Texts to serialised ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before, added = parts.get("pre_tokenizer") or {}, parts.get("added_tokens", [])
        plain = not parts.get("normalizer") and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        plain = plain and not any(BLANK.search(t["content"]) or t["content"].isalpha() for t in added)
        self.by_piece = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = {2: "H", 4: "I"}[self.width]
        self.written = _byte_letters()
        # bound once: each look at ``model`` makes an object
        self.tokenize = self.tokenizer.model.tokenize
        self.known = _Pieces(self._one, self._letters)

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _one(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, piece: str) -> bytes:
        """Ids of letters with or without a blank before them, which are cut no further before the model sees them."""
        shown = piece.replace(" ", self.written[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.written)
        return self._packed([t.id for t in self.tokenize(shown)])

    def _by_pieces(self, text: str) -> bytes:
        if "\0" not in text:
            try:
                return b"".join(map(self.known.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))) if text else b""
            except _Uneven:
                pass
        return b"".join(map(self._one, CUT.split(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.by_piece:
            return [self._by_pieces(t) for t in texts]
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _ids_of(path: str, end: int):
    """Serialised ids of the texts of a batch, end included."""

    def run(texts: pa.Array) -> Iterator[bytes]:
        encoder = _encoder(path)
        last = end.to_bytes(encoder.width, "little")
        for k in range(0, len(texts), AT_ONCE):
            for ids in encoder.encode([t or "" for t in texts[k : k + AT_ONCE].to_pylist()]):
                yield ids + last

    return run


def _opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train(docs: DataFrame, path: str, end: int = END) -> bytes:
    """The dictionary from a sample of ``docs`` (id, text): those whose hash of the id is least."""
    docs = docs.withColumn("h", F.xxhash64(F.lit(42), "id"))
    last = docs.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    encode, width = _ids_of(path, end), _encoder(path).width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x[: SAMPLE_TOKENS * width] for x in encode(batch["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    # ids that are equal may be more than the sample has
    sample = docs.where(F.col("h") <= last).select("text").limit(SAMPLE_DOCS).mapInArrow(run, "ids binary")
    pieces = sorted(bytes(r.ids) for r in sample.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too short to train on
        return b"".join(pieces)[:DICTIONARY_BYTES]


def _compressed(docs: DataFrame, path: str, dictionary: bytes, end: int) -> DataFrame:
    """(id, n, frame) for each row."""
    encode = _ids_of(path, end)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _encoder(path).width
        shared = _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        for batch in batches:
            frames, n = [], []
            for ids in encode(batch["text"]):
                frames.append(compressor.compress(ids))
                n.append(len(ids) // width)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["id", "n", "frame"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, frame binary")


MANIFEST = "shard int, file string, n_docs long, n_tokens long, bytes long, width int, dictionary string"


def _writer(folder: str, width: int, sha: str):
    """Writes the rows of a task as one file and says so in one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sink, index, at, before = TaskContext.get().partitionId(), None, [], len(MAGIC), 0
        where, root = _opened(folder)
        # a name of its own for each attempt
        name = f"tokens-{shard:06d}-{uuid.uuid4().hex}.tids"
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                sink = where.open_output_stream(f"{root}/{name}")
                sink.write(MAGIC)
            frames, n = batch["frame"].to_pylist(), batch["n"].to_numpy(zero_copy_only=False)
            sizes = np.array([len(f) for f in frames], np.int64)
            places, starts = at + np.cumsum(sizes) - sizes, before + np.cumsum(n) - n
            index.append(pa.RecordBatch.from_arrays([batch["id"], pa.array(places), pa.array(starts), pa.array(n)], ["id", "place", "start", "n"]))
            sink.write(b"".join(frames))
            at, before = at + int(sizes.sum()), before + int(n.sum())
        if sink is None:
            return
        with pa.ipc.new_stream(sink, index[0].schema) as out:
            for batch in index:
                out.write_batch(batch)
        sink.write(struct.pack(TAIL, at, width, bytes.fromhex(sha), MAGIC))
        sink.close()
        made = [[shard], [name], [sum(b.num_rows for b in index)], [before], [at], [width], [sha]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Write ``docs`` as token files into ``folder``, which all executors share; returns the manifest.

    ``tokenizer`` is the path of a vocabulary file of the tokenizers library.
    """
    tokenizer = tokenizer or vocabulary_path()
    spark = docs.sparkSession
    chosen = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    dictionary = train(chosen, tokenizer, end)
    sha = hashlib.sha256(dictionary).hexdigest()
    where, root = _opened(folder)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/{sha}.dictionary") as sink:
        sink.write(dictionary)
    frames = _compressed(chosen, tokenizer, dictionary, end)
    frames = stored(frames.withColumn("h", F.xxhash64("frame")).withColumn("row", F.monotonically_increasing_id()), "frames")
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("row")]
    ranged = frames.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "n", "frame")
    ranged.mapInArrow(_writer(folder, _encoder(tokenizer).width, sha), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


@lru_cache(maxsize=2)
def _decompressor(folder: str, sha: str) -> zstandard.ZstdDecompressor:
    where, root = _opened(folder)
    with where.open_input_stream(f"{root}/{sha}.dictionary") as source:
        data = source.read()
    if hashlib.sha256(data).hexdigest() != sha:
        raise ValueError(f"the dictionary {sha} of {folder} has been changed")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(data))


class TokenFile:
    """A file of token ids: its index, and documents by their number in it."""

    def __init__(self, folder: str, name: str):
        where, root = _opened(folder)
        self.source = where.open_input_file(f"{root}/{name}")
        size = self.source.size()
        tail = struct.calcsize(TAIL)
        at, self.width, sha, magic = struct.unpack(TAIL, self.source.read_at(tail, size - tail))
        if magic != MAGIC or self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        self.end, self.size = at, size
        self.frames = _decompressor(folder, sha.hex())
        self.index = pa.ipc.open_stream(pa.py_buffer(self.source.read_at(size - tail - at, at))).read_all().combine_chunks()
        self.places = np.append(self.index["place"].to_numpy(), at)

    def ids(self, first: int, stop: int) -> Iterator[np.ndarray]:
        """Ids of the documents first, ..., stop - 1, in one read."""
        begin = int(self.places[first])
        data = memoryview(self.source.read_at(int(self.places[stop]) - begin, begin))
        for k in range(first, stop):
            yield np.frombuffer(self.frames.decompress(data[self.places[k] - begin : self.places[k + 1] - begin]), f"<u{self.width}")

    def batches(self, of_bytes: int = READ_BYTES) -> Iterator[tuple[int, int]]:
        """Stretches of documents that have so many bytes of ids, or one document."""
        n = self.index["n"].to_numpy() * 4
        first = held = 0
        for k, size in enumerate(n.tolist()):
            if k > first and held + size > of_bytes:
                yield first, k
                first, held = k, 0
            held += size
        if len(n):
            yield first, len(n)


def _bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids in earlier files. The driver sees one row for each file."""
    before, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((*r, before))
        before += r.n_tokens
    spark = manifest.sparkSession
    return spark.createDataFrame(rows, f"{MANIFEST}, base long").repartition(max(1, len(rows)), "shard")


def read(spark: SparkSession, folder: str, id_type: str = "bigint", wanted: list | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents of a dataset: id, start (ids of all documents before it), n_tokens, ids (4 bytes each).

    ``wanted``: only these ids; their frames alone are read and decompressed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(folder, row["file"])
                if wanted is None:
                    stretches: Iterable[tuple[int, int]] = file.batches()
                else:
                    hits = pa.compute.is_in(file.index["id"], pa.array(wanted, file.index.schema.field("id").type))
                    stretches = [(int(k), int(k) + 1) for k in np.flatnonzero(hits.to_numpy(zero_copy_only=False))]
                for first, stop in stretches:
                    part = file.index.slice(first, stop - first)
                    ids = pa.array([x.astype("<u4").tobytes() for x in file.ids(first, stop)], pa.binary())
                    start = pa.array(part["start"].to_numpy() + row["base"])
                    yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), start, part["n"].combine_chunks(), ids], ["id", "start", "n_tokens", "ids"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return _bases(manifest).mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` and read each document's place, length and checksum back from the files."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer)
    return read(spark, folder, dict(docs.dtypes)["doc_id"]).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
