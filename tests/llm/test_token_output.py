"""Token files: ids against plain encoding, round trips, changed files."""

import random
import struct
import zlib
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from tallyspark.llm import token_output as to


def plain(rows):
    """(id, start, n, crc) with one call of the library for each text."""
    tokenizer = Tokenizer.from_file(to.vocabulary_path())
    out, before = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, before, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        before += len(ids)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr)


def test_report_against_plain_encoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert rows_of(to.report(docs)) == sorted(plain(rows), key=repr)


def test_edge_rows(docs, no_docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert rows_of(to.report(docs)) == sorted(plain(rows), key=repr)
    assert to.report(no_docs).count() == 0


def test_pieces_encode_like_whole_texts():
    """Blanks, line ends, contractions, marks and the end-of-text string in all combinations."""
    rng = random.Random(3)
    parts = [" ", "\n", "\t", "\r\n", "  ", "a", "word", "don't", "I'll", "'s", "12", "é", "漢", " ", " ", "\u0085", "\x1c", "᠎", "​", "﻿", "\0", "<|endoftext|>", ".", "!?", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    encoder = to.Encoder(to.vocabulary_path())
    assert encoder.by_piece and encoder.width == 2
    tokenizer = Tokenizer.from_file(to.vocabulary_path())
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}H", *ids), repr(text)


def test_other_vocabularies_get_whole_texts():
    encoder = to.Encoder(to.vocabulary_path("word_bpe_49k.json"))
    assert not encoder.by_piece
    tokenizer = Tokenizer.from_file(to.vocabulary_path("word_bpe_49k.json"))
    texts = ["Some  Words\nhere", "", "x"]
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode(texts) == [struct.pack(f"<{len(i)}H", *i) for i in ids]


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(to, "REMEMBERED", 3)
    few, many = to.Encoder(to.vocabulary_path()), ["a b c d e", "f g h", "a b c", ""]
    assert few.encode(many) + few.encode(many) == to.Encoder(to.vocabulary_path()).encode(many) * 2


@pytest.fixture
def dataset(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = to.write(docs, str(tmp_path / "set"))
    return docs, tmp_path / "set", manifest.collect()


def test_single_documents_and_orphans(spark, dataset):
    docs, folder, manifest = dataset
    (folder / "tokens-000000-orphan.tids").write_bytes(b"half a file")  # of a task that was lost
    all_rows = {r.doc_id: r for r in to.read(spark, str(folder)).collect()}
    assert len(all_rows) == docs.count()
    some = {r.doc_id: r for r in to.read(spark, str(folder), wanted=[3, 77, 10**9]).collect()}
    assert some == {k: all_rows[k] for k in (3, 77)}
    tokenizer = Tokenizer.from_file(to.vocabulary_path())
    ids = list(memoryview(bytes(some[77].ids)).cast("I"))
    assert ids[-1] == to.END and tokenizer.decode(ids[:-1]) == docs.where("doc_id = 77").first().text
    assert sum(m.n_tokens for m in manifest) == max(r.start + r.n_tokens for r in all_rows.values())
    assert sum(m.bytes for m in manifest) < sum(2 * m.n_tokens for m in manifest)


def test_frames_are_read_alone(dataset):
    _, folder, manifest = dataset
    file = to.TokenFile(str(folder), manifest[0].file)
    (alone,) = file.ids(5, 6)
    assert (alone == list(file.ids(0, 8))[5]).all()
    assert [k for a, b in file.batches(1) for k in range(a, b)] == list(range(manifest[0].n_docs))


def test_changed_dictionary_is_noticed(dataset):
    _, folder, manifest = dataset
    (path,) = Path(folder).glob("*.dictionary")
    path.write_bytes(path.read_bytes()[:-1] + b"?")
    to._decompressor.cache_clear()
    with pytest.raises(ValueError, match="has been changed"):
        to.TokenFile(str(folder), manifest[0].file)
    to._decompressor.cache_clear()


def test_samples_too_small_to_train_on(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    to.write(docs, str(tmp_path / "set"))
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(to.read(spark, str(tmp_path / "set"), "string").collect())] == [("a", 0, 2), ("b", 2, 1)]
