"""Cross-tokenizer alignment: union-find over the bipartite graph of overlapping tokens.

Tokenizer A (byte-level BPE) and tokenizer B (SentencePiece) cut the bytes of one text (a space and the document's text)
into tokens. Two tokens that share a byte are linked; the connected components of this graph, found by union-find, are the
minimal groups of tokens that cover the same bytes, and the edges inside a component are its links. How many documents hold
a pair of ids linked is counted over the corpus, and each document's links are read against these counts.

Texts are cut where both tokenizers always have a boundary (`chunk_pattern`), each distinct chunk is aligned once while a
worker remembers it, and a document is the sequence of its chunks. Texts with signs on which pattern engines differ are
one chunk.

A task is a block. It writes its documents, each with its distinct pairs and how often they occur, and the number of its
documents that hold each pair. Pairs are summed over blocks and every block gets the sums of its own pairs in a folder of
the shared directory, which the second pass over the documents reads, so that documents are never shuffled and nobody holds
the table of all pairs. The only broadcast is the highest count of each id of A: at most as many rows as A has entries.

Nulls: null and empty texts, and those whose tokens do not give back their bytes (B reads its own space sign as a space),
have no tokens: zeros and an empty digest. Null ids stay null. Repeated rows are documents of their own and count as such;
equal counts are all highest. Texts of any length are cut into pieces. Empty tables give no rows; further columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import block_batches, bounded_batches, kept, materialize, stage_path, trimmed
from noteloom.llm.sentencepieces import LETTERS, MARKS, SPACE, BatchDecoder, PieceTable, default_model
from noteloom.llm.token_store import PIECE_CHARS, WordEncoder, default_tokenizer, text_pieces

#: Chunks that a worker keeps, and pairs that it counts before it writes them out.
CACHE_CHUNKS, HELD_PAIRS = 300_000, 2_000_000
#: Folders of the counts of blocks.
FOLDERS = 4096

Docs = tuple[np.ndarray, ...]


def chunk_pattern(mixed: bool) -> str:
    """Pieces of a text at whose ends both tokenizers have a boundary: in front of a space or line end after a visible sign,
    behind a line end before a visible sign and, unless pieces of B mix letters and marks, between letters and marks. A
    sign behind an apostrophe may belong to a contraction of A, so there is no cut between."""
    other = r"(?s:\s*+(?:[^ \n]*\S)(?=[ \n]|\Z)|.+)"
    if mixed:
        return rf"\n(?=\S)|{other}"
    marks = MARKS.replace("!-/", "!-&(-/")  # without the apostrophe
    return rf" ?[{LETTERS}]++(?=[ \n{MARKS}]|\Z)| ?[{marks}]++(?=[ \n{LETTERS}]|\Z)|\n(?=[{LETTERS}{MARKS}])|{other}"


def byte_signs() -> dict[str, int]:
    """What byte each sign of a byte-level entry stands for: printable Latin-1 signs for themselves, the others in order
    from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def union_find(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest node of each node's component."""
    parent = np.arange(size)
    while len(left):
        p, q = parent[left], parent[right]
        apart = p != q
        left, right, p, q = left[apart], right[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of consecutive ranges, one range after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Aligner:
    """Alignments of chunks, known by number."""

    def __init__(self, tokenizer: str, model: str, mixed: bool, first_byte: int):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.encoder = WordEncoder(tokenizer, special_as_text=True)
        signs = byte_signs()
        vocabulary = range(self.encoder.tokenizer.get_vocab_size())
        self.a_parts = BatchDecoder([bytes(signs.get(c, 63) for c in self.encoder.tokenizer.id_to_token(i) or "") for i in vocabulary])
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as file:
            proto.ParseFromString(file.read())
        proto.normalizer_spec.add_dummy_prefix = False  # the space in front is part of the first chunk
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        size = self.pieces.get_piece_size()
        b_parts = [b"" if self.pieces.is_control(i) or self.pieces.is_unknown(i) else self.pieces.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        b_parts[first_byte : first_byte + 256] = [bytes([b]) for b in range(256)]
        self.b_parts, self.b_size = BatchDecoder(b_parts), size
        # Ids as text, with the sign in front of them: A's by ";" or ",", B's by "|" or ",".
        numbers = max(len(vocabulary), size)
        self.names, self.numbers = BatchDecoder([f"{s}{i}".encode() for s in ";,|" for i in range(numbers)]), numbers
        self.find = re.compile(chunk_pattern(mixed)).findall
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.exact = np.zeros(0, bool)
        self.first = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        return self.find(text) if self.encoder.sure(text) else [text]

    def learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        raw = self.encoder.encode_all(chunks)
        if len(self.encoder.known) > CACHE_CHUNKS // 4:
            self.encoder.known.clear()
        n_a = np.array([len(r) for r in raw], np.int64) // np.dtype(self.encoder.kind).itemsize
        a = np.frombuffer(b"".join(raw), self.encoder.kind).astype(np.int64)
        lists = self.pieces.encode(chunks, num_threads=1)
        n_b = np.array([len(x) for x in lists], np.int64)
        b = np.fromiter((i for x in lists for i in x), np.int64, n_b.sum())
        exact = self._exact(chunks, a, n_a, b, n_b)
        at = np.arange(len(chunks))
        of_a, of_b = np.repeat(at, n_a), np.repeat(at, n_b)
        a, b, of_a, of_b = a[exact[of_a]], b[exact[of_b]], of_a[exact[of_a]], of_b[exact[of_b]]
        ends_a, ends_b = np.cumsum(self.a_parts.sizes[a]), np.cumsum(self.b_parts.sizes[b])
        # Between two ends there is one token of each side, and a pair that overlaps has one such place.
        ends = np.union1d(ends_a, ends_b)
        left, right = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        parent = union_find(left, right + len(a), len(a) + len(b))
        root = parent[: len(a)] == np.arange(len(a))  # a component's smallest node is its first token of A
        group_a = np.cumsum(root) - 1
        group_b = group_a[parent[len(a) :]]
        count = lambda of: np.bincount(of, minlength=len(chunks))
        counts = np.column_stack([count(of_a), count(of_b), count(of_a[root]), count(of_a[left])]).astype(np.int64)
        names = np.empty(len(a) + len(b), np.int64)
        groups = int(root.sum())
        before_b = np.searchsorted(group_b, np.arange(groups + 1))  # tokens of B before each group
        before_a = np.searchsorted(group_a, np.arange(groups + 1))
        start_b = np.diff(group_b, prepend=-1) > 0
        names[np.arange(len(a)) + before_b[group_a]] = a + np.where(root, 0, self.numbers)
        names[np.arange(len(b)) + before_a[group_b + 1]] = b + np.where(start_b, 2 * self.numbers, self.numbers)
        written = self.names.raw(names)
        # Tokens are written chunk by chunk, because groups do not cross chunks.
        stops = np.cumsum(self.names.sizes[names])
        stop = np.concatenate([[0], stops])[np.cumsum(counts[:, 0] + counts[:, 1])].tolist()
        self.texts += [written[i:j] for i, j in zip([0, *stop[:-1]], stop, strict=True)]
        self.known.update(zip(chunks, range(len(self.counts), len(self.counts) + len(chunks)), strict=True))
        links = counts[:, 3]
        self.first = np.concatenate([self.first, len(self.codes) + np.cumsum(links) - links])
        self.codes = np.concatenate([self.codes, a[left] * self.b_size + b[right]])
        self.counts, self.exact = np.concatenate([self.counts, counts]), np.concatenate([self.exact, exact])

    def _exact(self, chunks: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether the tokens of both sides give back each chunk."""
        plain = [c.encode() for c in chunks]
        out = np.ones(len(chunks), bool)
        for parts, ids, n in ((self.a_parts, a, n_a), (self.b_parts, b, n_b)):
            raw = parts.raw(ids)
            if raw == b"".join(plain):
                ends = np.concatenate([[0], np.cumsum(parts.sizes[ids])])[np.cumsum(n)]
                out &= np.diff(ends, prepend=0) == np.array(list(map(len, plain)))
                continue
            ends = np.concatenate([[0], np.cumsum(parts.sizes[ids])])[np.cumsum(n)].tolist()
            out &= np.array([raw[i:j] == p for i, j, p in zip([0, *ends[:-1]], ends, plain, strict=True)])
        return out

    def forget(self, size: int) -> None:
        """Only the first chunks stay known."""
        for chunk in [c for c, i in self.known.items() if i >= size]:
            del self.known[chunk]
        if size < len(self.texts):
            self.codes = self.codes[: self.first[size]].copy()
            self.first, self.counts, self.exact = self.first[:size].copy(), self.counts[:size].copy(), self.exact[:size].copy()
            del self.texts[size:]

    def pairs(self, docs: np.ndarray, chunks: np.ndarray) -> Docs:
        """Document, code and number of links of each distinct pair of documents with these chunks."""
        key, times = np.unique(docs * len(self.counts) + chunks, return_counts=True)
        docs, chunks = np.divmod(key, len(self.counts))
        links = self.counts[chunks, 3]
        codes = self.codes[spread(self.first[chunks], links)]
        return _summed(np.repeat(docs, links), codes, np.repeat(times, links))


def _summed(docs: np.ndarray, codes: np.ndarray, times: np.ndarray) -> Docs:
    """Sums of times by document and code, in their order."""
    if not len(docs):
        return docs, codes, times
    order = np.lexsort((codes, docs)) if codes.max() >= 1 << 40 else np.argsort(docs * (int(codes.max()) + 1) + codes, kind="stable")
    docs, codes, times = docs[order], codes[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(codes) != 0)]))
    return docs[first], codes[first], np.add.reduceat(times, first)


def _portions(texts: list[str | None], aligner: Aligner) -> Iterator[list[tuple[int, str]]]:
    """(document, piece of its text with a space in front), about PIECE_CHARS signs at a time."""
    out, size = [], 0
    for i, text in enumerate(texts):
        if text:
            for piece in text_pieces(" " + text) if aligner.encoder.sure(text) else [" " + text]:
                out.append((i, piece))
                size += len(piece)
                if size >= PIECE_CHARS:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def align_texts(aligner: Aligner, texts: list[str | None], groups: bool = False) -> tuple[np.ndarray, list[str], Docs, list[str]]:
    """Counts and digest of each text, its pairs, and on demand the groups themselves."""
    counts, exact = np.zeros((len(texts), 4), np.int64), np.array([bool(t) for t in texts], bool)
    digests, written = [sha256() for _ in texts], [[] for _ in texts]
    found: list[Docs] = []
    started = [False] * len(texts)
    for portion in _portions(texts, aligner):
        cut = [aligner.cut(piece) for _, piece in portion]
        before = len(aligner.texts)
        aligner.learn(list(set().union(*cut).difference(aligner.known)))
        known, text_of = aligner.known.__getitem__, aligner.texts.__getitem__
        numbers = [list(map(known, chunks)) for chunks in cut]
        for (i, _), own in zip(portion, numbers, strict=True):
            raw = b"".join(map(text_of, own))
            raw, started[i] = (raw if started[i] else raw[1:]), True
            digests[i].update(raw)
            if groups:
                written[i].append(raw.decode())
        docs = np.repeat(np.array([i for i, _ in portion]), list(map(len, numbers)))
        flat = np.fromiter((x for own in numbers for x in own), np.int64, len(docs))
        exact[docs[~aligner.exact[flat]]] = False
        for k in range(4):
            counts[:, k] += np.bincount(docs, aligner.counts[flat, k], len(texts)).astype(np.int64)
        found.append(aligner.pairs(docs, flat))
        if len(aligner.texts) > CACHE_CHUNKS:
            aligner.forget(before)
    counts[~exact] = 0
    if found:
        docs, codes, times = (np.concatenate([x[k] for x in found]) for k in range(3))
        docs, codes, times = (x[exact[docs]] for x in (docs, codes, times))
        pairs = _summed(docs, codes, times) if len(found) > 1 else (docs, codes, times)
    else:
        pairs = tuple(np.zeros(0, np.int64) for _ in range(3))
    return counts, [d.hexdigest() if ok else "" for d, ok in zip(digests, exact.tolist(), strict=True)], pairs, ["".join(w) if ok else "" for w, ok in zip(written, exact.tolist(), strict=True)]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, groups string, block long, codes binary, times binary, code long, n long"


class BlockCounts:
    """How many documents of a block hold each pair, bounded in memory."""

    def __init__(self, limit: int = HELD_PAIRS):
        self.limit = limit
        self.codes, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, codes: np.ndarray) -> bool:
        """Whether it is time to write out."""
        self.waiting.append(codes)
        if sum(map(len, self.waiting)) > self.limit:
            self._merge()
        return len(self.codes) > self.limit

    def _merge(self) -> None:
        codes, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (self.codes[:0], self.n[:0])
        _, self.codes, self.n = _summed(np.zeros(len(codes) + len(self.codes), np.int64), np.concatenate([self.codes, codes]), np.concatenate([self.n, n]))
        self.waiting = []

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self.codes, self.n
        self.codes, self.n = self.codes[:0], self.n[:0]
        return out


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of values as binary cells."""
    offsets = pa.array((cuts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets.buffers()[1], pa.py_buffer(values.tobytes())])


def _aligned(documents: DataFrame, tokenizer: str, model: str, groups: bool) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their pairs, the counts of pairs by block, and the number of ids of B."""
    table = PieceTable.load(model)
    mixed = rf"[{LETTERS}]" not in table.pattern
    first_byte = table.first_byte
    code_type = _code_type(tokenizer, table.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", tokenizer, model), lambda: Aligner(tokenizer, model, mixed, first_byte))
        block, held = TaskContext.get().partitionId(), BlockCounts()

        def pairs_out() -> Iterator[pa.RecordBatch]:
            codes, n = held.take()
            for at in range(0, len(codes), 100_000):
                yield frame({"block": block, "code": pa.array(codes[at : at + 100_000]), "n": pa.array(n[at : at + 100_000])}, min(100_000, len(codes) - at))

        for batch in batches:
            counts, digests, (docs, codes, times), written = align_texts(aligner, batch.column("text").to_pylist(), groups)
            cuts = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            own = {c: pa.array(counts[:, k]) for k, c in enumerate(COUNTS)}
            own |= {"doc_id": batch.column("doc_id"), "groups_sha256": pa.array(digests, pa.string()), "block": block}
            own |= {"codes": _binary(codes.astype(code_type), cuts), "times": _binary(times.astype("<u4"), cuts)}
            if groups:
                own["groups"] = pa.array(written, pa.string())
            yield frame(own, batch.num_rows)
            if held.add(codes):
                yield from pairs_out()
        yield from pairs_out()

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)
    stored = materialize(out, "aligned")  # both kinds of rows come from one pass, so blocks are the same for both
    names = [c for c in stored.columns if c not in ("code", "n")]
    return stored.where("code IS NULL").select(names), stored.where("code IS NOT NULL").select("block", "code", "n"), table.size


_TYPES = {"groups_sha256": pa.string(), "groups": pa.string(), "codes": pa.binary(), "times": pa.binary()}


def frame(columns: dict, rows: int) -> pa.RecordBatch:
    """A batch of the schema ALIGNED; what is not given is null, a number stands in every row."""
    out = []
    for name in (part.split()[0] for part in ALIGNED.split(", ")):
        value, kind = columns.get(name), _TYPES.get(name, pa.int64())
        if value is None or isinstance(value, int):
            value = pa.nulls(rows, kind) if value is None else pa.array(np.full(rows, value, np.int64))
        out.append((name, value.cast(kind) if value.type != kind else value))
    return pa.RecordBatch.from_arrays([v for _, v in out], [n for n, _ in out])


def pair_counts(documents: DataFrame, tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """a_id, b_id, n: how many documents hold a pair of ids linked."""
    _, pairs, size = _aligned(documents, tokenizer or default_tokenizer(), model or default_model(), False)
    return pairs.groupBy("code").agg(F.sum("n").alias("n")).select(F.expr(f"code div {size}").alias("a_id"), (F.col("code") % size).alias("b_id"), "n")


def align(documents: DataFrame, tokenizer: str | None = None, model: str | None = None, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and on demand the groups as text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    tokenizer, model = tokenizer or default_tokenizer(), model or default_model()
    docs, pairs, size = _aligned(documents, tokenizer, model, groups)
    counts = materialize(pairs.groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    token = F.expr(f"code div {size}")
    best = F.broadcast(counts.groupBy(token.alias("a")).agg(F.max("n").alias("most")))  # at most one row for each id of A
    known = counts.join(best, token == F.col("a")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    blocks = pairs.agg(F.count_distinct("block")).first()[0]
    folders, folder = max(1, min(FOLDERS, blocks)), stage_path(spark, "block-counts")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = pairs.select("block", "code").distinct().join(known, "code").withColumn("folder", F.pmod("block", F.lit(folders)).cast("int"))
    dealt = told.repartitionById(tasks, F.pmod("folder", F.lit(tasks))).sortWithinPartitions("folder", "block", "code")
    dealt.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("folder").parquet(folder)
    code_type = _code_type(tokenizer, size)
    names = [c for c in docs.columns if c not in ("block", "codes", "times") and (groups or c != "groups")]
    kinds = {"groups_sha256": "string", "groups": "string"}
    shape = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names) + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codes, n, best = None, None, None, None
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            cells = zip(batch.column("block").to_pylist(), batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True)
            for i, (own, raw, times) in enumerate(cells):
                if not raw:
                    continue
                if own != block:
                    block, (codes, n, best) = own, _read_counts(folder, own % folders, own)
                at = np.searchsorted(codes, np.frombuffer(raw, code_type).astype(np.int64))
                times = np.frombuffer(times, "<u4").astype(np.int64)
                sums[:, i] = times[best[at]].sum(), (times * n[at]).sum()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sums[0]), pa.array(sums[1])], [*names, "n_best", "count_sum"])

    return docs.mapInArrow(trimmed(run), shape)


def _code_type(tokenizer: str, size: int) -> str:
    return "<u4" if WordEncoder(tokenizer).tokenizer.get_vocab_size() * size <= 1 << 32 else "<i8"


def _read_counts(folder: str, group: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a block in order, how many documents hold each, and whether that is its id's highest count."""
    parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")] for batch in block_batches(f"{folder}/folder={group}", block, ["code", "n", "best"])]
    codes, n, best = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    return codes[order], n[order], best[order].astype(bool)
