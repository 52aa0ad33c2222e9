"""Token-ID / binary output: sorted-string-table shards.

A shard is one file of documents in ascending doc_id order:

    block*  entries (varint shared key bytes, varint new key bytes, varint value bytes, new key bytes, value); the first
            entry of a block shares nothing
    index   per block: first key, last key (16 bytes each), offset, length and ids before it (8-byte integers)
    bloom   bits over the 8-byte part of the keys
    footer  offsets, lengths, counts and a magic number

A key is the doc_id as 8 big-endian bytes that sort like the number, then a running number for repeated ids. A value is
the ids as little-endian unsigned 16-bit integers (32-bit if the vocabulary needs them). `ShardReader.get` reads footer,
filter and index, finds the block by binary search and reads only it.

Shards are ranges of (doc_id, hash of the text), as many as the table's bytes ask for, so that a repeated id can fill
several shards; a writer keeps 8 bytes for each key of its shard.

Nulls: a null text is empty (its only id is the end id); a null doc_id is stored before all others and read back as null. Repeated rows are all kept, those of one id in the order of a hash of their texts. Empty tables give no files and
no rows; further columns are not read. Files are written under a temporary name and then moved, so a task that runs twice
leaves one file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import bounded_batches, filesystem, materialize, stage_path

MAGIC = b"NLSST001"
FOOTER = struct.Struct("<7QI4x8s")
INDEX_ENTRY = struct.Struct("<16s16sQQQ")
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, HASHES = 10, 7
END_ID = 0
#: The smallest long.
LEAST = -(1 << 63)
#: Stored bytes of the input for each shard, and tasks that read the shards back.
SHARD_BYTES, READERS = 128 << 20, 20_000
#: Where Spark cannot tell the bytes of a plan it names a huge number.
MAX_SHARDS = 2_000_000
#: Pre-tokens that a worker keeps.
CACHE_WORDS = 400_000
PIECE_CHARS = 1 << 20
#: The published pre-token pattern of byte-level BPE, with the letters and numbers of the signs that
#: `_UNSURE` lets through written out.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u0233"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
#: Signs outside the Latin blocks and common punctuation, and control signs that only some engines call white space.
_UNSURE = re.compile("[^\t\n\r -~\xa1-\u0233\u2010-\u2027\u2030-\u205e\u20ac]")
_SURE_BYTES = bytes(c for c in range(256) if not _UNSURE.match(chr(c)))
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """Ids of texts as bytes. A text is cut into pre-tokens by the tokenizer's own published pattern and each distinct
    pre-token is encoded by the library once; texts with signs on which pattern engines may differ go to it whole."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        setup = json.loads(self.tokenizer.to_str())
        split = setup["pre_tokenizer"] or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and setup["normalizer"] is None
        # A sign of a byte-level token stands for a byte.
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> None:
        # Words with their space in front can be encoded side by side: each starts a new pre-token.
        spaced, other = [], []
        for w in words:
            (spaced if w[0] == " " and w[1:].isalpha() else other).append(w)
        for at in range(0, len(spaced), 4000):
            part = spaced[at : at + 4000]
            text = "".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            sizes = list(map(len, part)) if text.isascii() else [len(w.encode()) for w in part]
            cuts = ((np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1) * ids.itemsize).tolist()
            self._keep(part, ids.tobytes(), [0, *cuts])
        for at in range(0, len(other), 4000):
            part = other[at : at + 4000]
            done = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(done.ids, self.kind)
            self._keep(part, ids.tobytes(), (np.searchsorted(np.array(done.word_ids), np.arange(len(part) + 1)) * ids.itemsize).tolist())

    def _keep(self, words: list[str], raw: bytes, cuts: list[int]) -> None:
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True))

    def sure(self, text: str) -> bool:
        """Whether all pattern engines agree on the signs of a text."""
        if self.by_word and not any(x in text for x in self.special):
            try:
                return not text.encode("latin-1").translate(None, _SURE_BYTES)
            except UnicodeEncodeError:
                return not _UNSURE.search(text)
        return False

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts at a time, as little-endian bytes."""
        cut = [[_PRE_TOKEN.findall(p) for p in text_pieces(t)] if self.sure(t) else None for t in texts]
        # The first CACHE_WORDS pre-tokens, among them all frequent ones, stay known; rare ones only for these texts.
        missing = list(set().union(*(words for pieces in cut if pieces for words in pieces)).difference(self.known))
        self._learn(missing)
        known = self.known.__getitem__
        out = [self._whole(t) if pieces is None else b"".join(b"".join(map(known, words)) for words in pieces) for t, pieces in zip(texts, cut, strict=True)]
        if len(self.known) > CACHE_WORDS:
            for w in missing:
                del self.known[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _groups(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about PIECE_CHARS signs."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_CHARS:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def text_pieces(text: str) -> Iterator[str]:
    """Long texts in pieces, cut before a single space between visible signs, where a pre-token always starts."""
    at = 0
    while len(text) - at > PIECE_CHARS and (m := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder for each tokenizer file in a worker, so that later tasks know earlier words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _key(doc_id: int | None, number: int = 0) -> bytes:
    """Null has the id part of the smallest long and comes before it: the running numbers of that one have their top bit set."""
    if doc_id is None:
        return bytes(8) + number.to_bytes(8, "big")
    return (doc_id + (1 << 63)).to_bytes(8, "big") + (number | (doc_id == LEAST) << 63).to_bytes(8, "big")


def _id_of(key: bytes) -> int | None:
    doc_id = int.from_bytes(key[:8], "big") + LEAST
    return None if doc_id == LEAST and key[8] < 128 else doc_id


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _bloom_bits(h: np.ndarray) -> np.ndarray:
    return np.column_stack([(h >> np.uint64(32)) + np.uint64(i) * (h & np.uint64(0xFFFFFFFF) | np.uint64(1)) for i in range(HASHES)])


class ShardWriter:
    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.at = self.ids = self.before = 0
        self.block, self.block_size, self.first, self.last = [], 0, b"", b""
        self.index: list[bytes] = []
        self.hashes = array("Q")

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, self.ids
        entry = _varint(shared) + _varint(16 - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        self.hashes.append(xxhash.xxh3_64_intdigest(key[:8]))
        self.ids += len(value) // self.id_bytes
        if self.block_size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(b"".join(self.block))
            self.index.append(INDEX_ENTRY.pack(self.first, self.last, self.at, self.block_size, self.before))
            self.at, self.block, self.block_size = self.at + self.block_size, [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.hashes) * BITS_PER_KEY // 64 * 64 + 64)
        bloom = np.zeros(bits // 8, np.uint8)
        for first in range(0, len(self.hashes), 100_000):
            at = (_bloom_bits(np.array(self.hashes[first : first + 100_000], np.uint64)) % np.uint64(bits)).ravel()
            np.bitwise_or.at(bloom, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        self.out.write(index + bloom.tobytes())
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits // 8, len(self.index), len(self.hashes), self.ids, self.id_bytes, MAGIC))


class ShardReader:
    def __init__(self, source):
        """source: an object with read_at(length, offset) and size(), such as a pyarrow input file."""
        self.source = source
        self.index_at, index_size, bloom_at, bloom_size, _, self.n_docs, self.n_ids, self.id_bytes, magic = FOOTER.unpack(source.read_at(FOOTER.size, source.size() - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw = source.read_at(index_size, self.index_at)
        self.index = list(INDEX_ENTRY.iter_unpack(raw))
        self.bloom = np.frombuffer(source.read_at(bloom_size, bloom_at), np.uint8)

    def _entries(self, entry: tuple) -> Iterator[tuple[bytes, bytes]]:
        _, _, offset, length, _ = entry
        data, at, key = self.source.read_at(length, offset), 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            fresh, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + fresh]
            at += fresh
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this shard, ids) of all documents, in order."""
        start = 0
        for entry in self.index:
            for key, value in self._entries(entry):
                ids = np.frombuffer(value, f"<u{self.id_bytes}")
                yield _id_of(key), start, ids
                start += len(ids)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row with this doc_id."""
        key = _key(doc_id)[:8]
        at = (_bloom_bits(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64)) % np.uint64(len(self.bloom) * 8)).ravel()
        if not all(self.bloom[int(x) >> 3] >> (int(x) & 7) & 1 for x in at):
            return []
        i = max(0, bisect_right([e[0][:8] for e in self.index], key) - 1)
        while i > 0 and self.index[i][0][:8] == key:
            i -= 1
        out = []
        while i < len(self.index) and self.index[i][0][:8] <= key:
            if self.index[i][1][:8] >= key:
                out += [np.frombuffer(v, f"<u{self.id_bytes}") for k, v in self._entries(self.index[i]) if k[:8] == key and _id_of(k) == doc_id]
            i += 1
        return out


def write_shards(documents: DataFrame, tokenizer: str | None = None, shards: int | None = None, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode and write; returns the folder and the manifest (shard, file, n_docs, n_ids)."""
    spark = documents.sparkSession
    bounded_batches(spark)
    tokenizer, folder = tokenizer or default_tokenizer(), folder or stage_path(spark, "tokens")
    if shards is None:
        stored = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(stored // SHARD_BYTES, MAX_SHARDS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(folder)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}.sst"
        encoder, writer, out, last, run_number = encoder_for(tokenizer), None, None, None, -1
        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        end = np.array([END_ID], encoder.kind).tobytes()
        for batch in batches:
            if writer is None and len(batch):
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(temporary)
                writer = ShardWriter(out, len(end))
            ids, none, texts = batch["doc_id"].tolist(), batch["no_id"].tolist(), batch["text"].tolist()
            for group in _groups(texts):
                for doc_id, unknown, value in zip(ids[group], none[group], encoder.encode_all(texts[group]), strict=True):
                    own = None if unknown else doc_id
                    run_number = run_number + 1 if own == last and run_number >= 0 else 0
                    last = own
                    writer.add(_key(own, run_number), value + end)
        if writer is not None:
            writer.close()
            out.close()
            files.move(temporary, f"{root}/{name}")
            yield pd.DataFrame([(number, name, len(writer.hashes), writer.ids)], columns=["shard", "file", "n_docs", "n_ids"])

    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = documents.select(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    order = [F.desc("no_id"), "doc_id", "hash"]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").drop("hash")
    return folder, materialize(ordered.mapInPandas(run, "shard int, file string, n_docs long, n_ids long"), "manifest")


def read_shards(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    rows, start = [], 0
    for r in sorted(manifest.collect()):  # one row per shard file
        rows.append((r["file"], start))
        start += r["n_ids"]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(folder)
        for batch in batches:
            for file, first in zip(batch["file"], batch["first"], strict=True):
                out = []
                with files.open_input_file(f"{root}/{file}") as source:
                    for doc_id, at, ids in ShardReader(source).scan():
                        out.append((doc_id, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield _frame(out)
                            out = []
                yield _frame(out)

    shards = spark.createDataFrame(rows, "file string, first long").repartition(min(len(rows), READERS))
    return shards.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    ids = [r[0] for r in rows]
    frame = pd.DataFrame([r[1:] for r in rows], columns=["start", "n_tokens", "ids_crc32"], dtype=np.int64)
    frame.insert(0, "doc_id", pd.arrays.IntegerArray(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool)))
    return frame
