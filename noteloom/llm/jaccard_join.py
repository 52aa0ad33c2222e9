"""N-gram Jaccard join: signature trees.

Two documents link when 100 * |x & y| >= 80 * |x | y| over their sets of distinct 5-word shingles. Only shingles that
some other document has can be common, so a document can link only if at least 80 % of its shingles are shared:

1. every text is cut into hashed shingles, which go to partitions by hash, packed as (hash, row) arrays. Frequent
   shingles, found in a bounded sample of documents, are known to be shared: they stay with their document and never
   meet in one partition;
2. each partition keeps the shingles of two rows or more, which come back to their documents with their frequency;
3. documents with fewer than 80 % shared shingles are done; the others, one per distinct set, form candidate families:
   components of the graph that links documents of one rare-first prefix shingle, of which linked documents share one;
4. each family, in blocks of bounded bytes, is joined by signature trees: nodes hold OR-combined bitmaps and size
   ranges, a dual traversal drops node pairs whose largest possible overlap is too small, and every leaf pair left by
   the bitmap difference is checked exactly. A block's own node (bitmap and size range) drops pairs of blocks before
   their sets meet. A pair of blocks returns the number of links of each of its sets, and a spanning forest of these
   links: the links of a family grow with the square of its size, their numbers do not;
5. components of the forests, joined to all documents by the fingerprint of their sets. n_links is the number of other
   rows that a row links with: its copies, and the rows of each set that its own set links with.

Which shingles count as frequent changes where they travel, never a result: all documents order shingles alike, and
every link is checked on whole sets. Copies collapse by fingerprint, first within a task, then overall. Sizes come from
64-bit hashes of shingles; sets are compared by 48 bits beside the partition's number, so by 51 bits at least, and told
apart by a 64-bit fingerprint and their size.

Nulls: a null text has no shingles; such documents, and null doc_ids, link with nothing (component_id is the doc_id).
A text of fewer than `words` words is one shingle. Rows are the documents, whether or not ids repeat: repeated rows are each
returned and link through their equal sets, rows of one id with different texts link only if their sets do, so that an
id can have several component_ids. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import bounded_batches, join_hot_keys, materialize, trimmed
from noteloom.llm.components import connected_components

WORDS, PERCENT = 5, 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingles that one partition compares at a time, about.
PART_TOKENS = 4_000_000
#: Bytes of shingle sets in one block of a family.
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 200_000
#: Signs of the sample that frequent shingles are looked for in; a shingle in one of FREQUENT sampled documents is one.
SAMPLE_CHARS, FREQUENT = 16_000_000, 256
#: Frequencies of a byte: shingles with at least this many rows, and the frequent ones.
MANY, MOST = 254, 255
BITS = 2048
#: Bits of the bitmap of a whole block.
BLOCK_BITS = 1 << 13
LEAF, FANOUT = 16, 8
#: Pairs of two leaves that are intersected one by one; more are counted by a product of matrices.
FEW = 3
#: Odd constants that mix the hashes of a shingle's words.
MIX = tuple(np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(WORDS))
_LOWER = str.maketrans(UPPER, LOWER)


def words_of(text: str) -> list[str]:
    """Runs of signs other than space, tab, line feed, vertical tab, form feed and carriage return, in lower case A-Z."""
    return [w for w in text.translate(_LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of a text."""
        if not text:
            return np.zeros(0, np.uint64)
        words, known = words_of(text), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(31))) * MIX[i % WORDS] + h[i : len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(29))) * MIX[1]
        out ^= out >> np.uint64(32)
        return np.unique(out)


def fingerprint(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _part_and_token(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of each shingle, and what tells it apart: that number and 48 bits of the hash."""
    part = (hashes >> np.uint64(32)) % np.uint64(parts)
    return part, part << np.uint64(48) | hashes & np.uint64(0xFFFFFFFFFFFF)


def _frequent(documents: DataFrame, chars: int, words: int) -> np.ndarray:
    """Sorted hashes of shingles in many documents of a sample by hash of doc_id. At most FREQUENT times as many as a
    sampled document has on average."""
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, chars // SAMPLE_CHARS))) == 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.hashes(t) for t in batch["text"]]
            tokens, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pd.DataFrame({"token": np.append(tokens.view(np.int64), 0), "n": np.append(n, len(sets)), "documents": np.append(np.zeros(len(n), bool), True)})

    counted = sample.select("text").mapInPandas(run, "token long, n long, documents boolean").groupBy("token", "documents").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where((F.col("n") > 2) | F.col("documents")), "frequencies")
    total = counted.where("documents").agg(F.sum("n")).first()[0] or 0
    found = counted.where(~F.col("documents") & (F.col("n") > max(2, total // FREQUENT))).select("token").collect()
    return np.sort(np.array([r["token"] for r in found], np.int64).view(np.uint64))


_PACK = "part int, doc_ids binary, sizes binary, prints binary, low binary, high binary, rows binary"


def _shingle(parts: int, words: int, frequent: np.ndarray):
    """Document rows (part -1), frequent shingles by document (part -2: lengths and tokens), and packed shingles of the
    first document with each set that a task meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                piece = batch.iloc[at : at + 1024]
                sets = [shingler.hashes(t) for t in piece["text"]]
                ids = piece["doc_id"].to_numpy(np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                prints = np.array([fingerprint(s) for s in sets], np.int64)
                out = [(-1, ids.tobytes(), sizes.tobytes(), prints.tobytes(), b"", b"", b"")]
                first = []
                for i, key in enumerate(zip(prints.tolist(), sizes.tolist(), strict=True)):
                    if key[1] and key not in seen:
                        seen.add(key)
                        first.append(i)
                if first:
                    hashes = np.concatenate([sets[i] for i in first])
                    rows = np.repeat(np.arange(len(first), dtype=np.uint16), sizes[first])
                    part, tokens = _part_and_token(hashes, parts)
                    if len(frequent):
                        often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
                        used, lengths = np.unique(rows[often], return_counts=True)
                        if len(used):
                            docs = np.array(first)[used]
                            out.append((-2, ids[docs].tobytes(), sizes[docs].tobytes(), prints[docs].tobytes(), lengths.astype(np.int32).tobytes(), tokens[often].tobytes(), b""))
                        rows, part, tokens = rows[~often], part[~often], tokens[~often]
                    order = np.argsort(part, kind="stable")
                    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                    low, high = tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint16)
                    for p in range(parts):
                        own = order[cuts[p] : cuts[p + 1]]
                        if len(own):
                            used, local = np.unique(rows[own], return_inverse=True)
                            docs = np.array(first)[used]
                            out.append((p, ids[docs].tobytes(), sizes[docs].tobytes(), prints[docs].tobytes(), low[own].tobytes(), high[own].tobytes(), local.astype(np.uint16).tobytes()))
                yield pd.DataFrame(out, columns=["part", "doc_ids", "sizes", "prints", "low", "high", "rows"])

    return run


_SHARED = "bucket int, doc_ids binary, sizes binary, prints binary, lengths binary, tokens binary, counts binary"
_SHARED_NAMES = ["bucket", "doc_ids", "sizes", "prints", "lengths", "tokens", "counts"]
_CANDIDATE = "print long, n long, tokens binary, prefix binary"


def _unpack_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids, sizes, prints = (np.frombuffer(x, np.int64) for x in (row.doc_ids, row.sizes, row.prints))
            yield pd.DataFrame({"doc_id": ids, "n_shingles": sizes, "print": prints})


def _share(buckets: int):
    """Rows come sorted by part. Shingles of two distinct sets or more go back towards their documents, with frequencies,
    packed by buckets of documents, as do the frequent ones; document rows (bucket -1) pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        part = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.part == -1:
                    yield pd.DataFrame([(-1, row.doc_ids, row.sizes, row.prints, b"", b"", b"")], columns=_SHARED_NAMES)
                    continue
                if row.part == -2:
                    ids, sizes, prints = (np.frombuffer(x, np.int64) for x in (row.doc_ids, row.sizes, row.prints))
                    docs = np.repeat(np.arange(len(ids)), np.frombuffer(row.low, np.int32))
                    tokens = np.frombuffer(row.high, np.uint64)
                    yield _by_bucket(buckets, ids, sizes, prints, docs, tokens, np.full(len(tokens), MOST, np.uint8))
                    continue
                if row.part != part and held:
                    yield _shared_of(part, held, buckets)
                    held = []
                part = row.part
                held.append(row)
        if held:
            yield _shared_of(part, held, buckets)

    return run


def _by_bucket(buckets: int, ids: np.ndarray, sizes: np.ndarray, prints: np.ndarray, docs: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """One packed row for each bucket of documents (by fingerprint). docs: which document each token is of."""
    bucket = (prints.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((docs, bucket[docs]))
    docs, tokens, counts = docs[order], tokens[order], counts[order]
    cuts = np.searchsorted(bucket[docs], np.arange(buckets + 1))
    out = []
    for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if x < y:
            who, lengths = np.unique(docs[x:y], return_counts=True)
            out.append((b, ids[who].tobytes(), sizes[who].tobytes(), prints[who].tobytes(), lengths.astype(np.int32).tobytes(), tokens[x:y].tobytes(), counts[x:y].tobytes()))
    return pd.DataFrame(out, columns=_SHARED_NAMES)


def _first_of_each(prints: np.ndarray, sizes: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by print and size (then `more`), and where in it a new set begins."""
    order = np.lexsort((*more, sizes, prints))
    new = np.ones(len(order), bool)
    new[1:] = (prints[order][1:] != prints[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    return order, new


def _shared_of(part: int, held: list, buckets: int) -> pd.DataFrame:
    ids, sizes, prints = (np.concatenate([np.frombuffer(getattr(r, c), np.int64) for r in held]) for c in ("doc_ids", "sizes", "prints"))
    # One row per distinct set: the smallest doc_id stands for those that other tasks sent.
    order, new = _first_of_each(prints, sizes, ids)
    keep = np.zeros(len(ids), bool)
    keep[order[new]] = True
    total = sum(len(r.low) for r in held) // 4
    tokens, docs, at, first = np.empty(total, np.uint64), np.empty(total, np.int32), 0, 0
    for r in held:
        rows = np.frombuffer(r.rows, np.uint16).astype(np.int32) + np.int32(first)
        own = keep[rows]
        n = int(own.sum())
        tokens[at : at + n] = np.frombuffer(r.high, np.uint16)[own]
        tokens[at : at + n] <<= np.uint64(32)
        tokens[at : at + n] |= np.frombuffer(r.low, np.uint32)[own]
        docs[at : at + n] = rows[own]
        at, first = at + n, first + len(r.doc_ids) // 8
    held.clear()
    # Equal shingles become neighbours.
    order = np.argsort(tokens[:at], kind="stable")
    tokens, docs = tokens[order], docs[order]
    same = tokens[1:] == tokens[:-1]
    some = np.zeros(len(tokens), bool)
    some[1:] |= same
    some[:-1] |= same
    tokens, docs = tokens[some], docs[some]
    edge = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True]))) if len(tokens) else np.zeros(1, int)
    counts = np.minimum(np.repeat(np.diff(edge), np.diff(edge)), MANY).astype(np.uint8)
    return _by_bucket(buckets, ids, sizes, prints, docs, np.uint64(part) << np.uint64(48) | tokens, counts)


def _gather(percent: int):
    """Rows come sorted by bucket. One row per distinct set with enough shared shingles: its tokens, and the prefix of
    which linked documents share one; rare shingles come first."""

    def of(held: list) -> pd.DataFrame:
        sizes, prints = (np.concatenate([np.frombuffer(getattr(r, c), np.int64) for r in held]) for c in ("sizes", "prints"))
        lengths = np.concatenate([np.frombuffer(r.lengths, np.int32) for r in held])
        tokens = np.concatenate([np.frombuffer(r.tokens, np.uint64) for r in held])
        counts = np.concatenate([np.frombuffer(r.counts, np.uint8) for r in held])
        starts = np.cumsum(lengths) - lengths
        order, new = _first_of_each(prints, sizes)
        edge = np.append(np.flatnonzero(new), len(order))
        shared = np.add.reduceat(lengths[order], edge[:-1])
        out = []
        for i in np.flatnonzero(100 * shared >= percent * sizes[order][edge[:-1]]):
            rows = order[edge[i] : edge[i + 1]]
            own = np.concatenate([np.arange(starts[r], starts[r] + lengths[r]) for r in rows])
            n = int(sizes[rows[0]])
            # Copies of a set in several tasks each bring its frequent shingles.
            mine, at = np.unique(tokens[own], return_index=True)
            if 100 * len(mine) < percent * n:
                continue
            rare = np.lexsort((mine, counts[own][at]))[: len(mine) - -(-percent * n // 100) + 1]
            out.append((int(prints[rows[0]]), n, mine.tobytes(), mine[rare].tobytes()))
        return pd.DataFrame(out, columns=["print", "n", "tokens", "prefix"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and row.bucket != held[0].bucket:
                    yield of(held)
                    held = []
                held.append(row)
        if held:
            yield of(held)

    return run


def _explode_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        tokens = [np.frombuffer(p, np.int64) for p in batch["prefix"]]
        if tokens:
            yield pd.DataFrame({"print": np.repeat(batch["print"].to_numpy(), [len(t) for t in tokens]), "token": np.concatenate(tokens)})


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by token: links of each set to the one before it with its token. A token may go on in the next
    task, so the first and the last set are linked to a node of their token; should its number be that of a set, two
    families are one, which costs time but no link."""
    last: tuple[int, int] | None = None
    for batch in batches:
        token, doc = batch["token"].to_numpy(np.int64), batch["print"].to_numpy(np.int64)
        if not len(token):
            continue
        if last is None:
            yield pd.DataFrame({"src": doc[:1], "dst": ~token[:1]})
        else:
            token, doc = np.append(last[0], token), np.append(last[1], doc)
        same = token[1:] == token[:-1]
        yield pd.DataFrame({"src": doc[1:][same], "dst": doc[:-1][same]})
        last = (int(token[-1]), int(doc[-1]))
    if last is not None:
        yield pd.DataFrame({"src": [last[1]], "dst": [~last[0]]}, dtype=np.int64)


def _bitmap(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    at = (tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


class SignatureTree:
    """Levels of nodes over documents sorted by size; level 0 has the leaves. Per node: OR of the bitmaps, smallest and
    largest set size, most shared shingles and fewest bits of a member. weights: documents with each set."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], weights: np.ndarray | None = None):
        self.order = np.lexsort(([s[0] if len(s) else 0 for s in sets], sizes))
        self.sizes = sizes[self.order]
        self.sets = [sets[i] for i in self.order]
        self.weights = np.ones(len(sets), np.int64) if weights is None else weights[self.order]
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bits = np.array([_bitmap(s) for s in self.sets]).reshape(len(sets), -1)
        self.lengths = lengths = np.array([len(s) for s in self.sets], np.int64)
        count = np.bitwise_count(self.bits).sum(1)
        self.levels = []
        step, low, high, most, fewest, either = LEAF, self.sizes, self.sizes, lengths, count, self.bits
        while True:
            at = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            most, fewest, either = np.maximum.reduceat(most, at), np.minimum.reduceat(fewest, at), np.bitwise_or.reduceat(either, at, axis=0)
            self.levels.append((low, high, most, fewest, either))
            if len(at) == 1:
                break
            step = FANOUT

    def children(self, level: int, node: int) -> range:
        if level == 0:
            return range(node * LEAF, min(len(self.sizes), (node + 1) * LEAF))
        return range(node * FANOUT, min(len(self.levels[level - 1][0]), (node + 1) * FANOUT))

    def incidence(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of a leaf, sorted, and which of its members have each."""
        if leaf not in self.known:
            rows = self.children(0, leaf)
            tokens, at = np.unique(np.concatenate([self.sets[x] for x in rows]), return_inverse=True)
            has = np.zeros((len(rows), len(tokens)), bool)
            has[np.repeat(np.arange(len(rows)), self.lengths[rows.start : rows.stop]), at] = True
            self.known[leaf] = tokens, has
        return self.known[leaf]


def _may_link(a: SignatureTree, i: tuple[int, int], b: SignatureTree, j: tuple[int, int], percent: int) -> bool:
    low_a, high_a, most_a, fewest_a, either_a = (x[i[1]] for x in a.levels[i[0]])
    low_b, high_b, most_b, fewest_b, either_b = (x[j[1]] for x in b.levels[j[0]])
    if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
        return False
    common = int(np.bitwise_count(either_a & either_b).sum())
    overlap = min(most_a - max(0, int(fewest_a) - common), most_b - max(0, int(fewest_b) - common))
    # |x & y| >= p / (100 + p) * (|x| + |y|)
    return (100 + percent) * overlap >= percent * (int(low_a) + int(low_b))


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_forest(a: SignatureTree, b: SignatureTree, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (position in a, position in b) of links that join what no earlier pair joined."""
    return all_links(a, b, percent)[0]


def all_links(a: SignatureTree, b: SignatureTree, percent: int = PERCENT) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """A spanning forest of all links, and for each position in a and in b the weight of the sets that it links with."""
    links = _Links(a, b, percent)
    same = a is b
    stack = [((len(a.levels) - 1, 0), (len(b.levels) - 1, 0))]
    while stack:
        i, j = stack.pop()
        if same and i[0] == j[0] and i[1] > j[1]:
            continue
        if not _may_link(a, i, b, j, percent):
            continue
        if i[0] == 0 and j[0] == 0:
            links.leaves(i[1], j[1])
        elif i[0] >= j[0] and not (same and i == j):
            stack += [((i[0] - 1, c), j) for c in a.children(*i)] if i[0] > j[0] else [((i[0] - 1, c), (j[0] - 1, d)) for c in a.children(*i) for d in b.children(*j)]
        elif i[0] < j[0]:
            stack += [(i, (j[0] - 1, d)) for d in b.children(*j)]
        else:
            stack += [((i[0] - 1, c), (i[0] - 1, d)) for c in a.children(*i) for d in a.children(*i) if c <= d]
    return links.forest, links.of_a, links.of_b


class _Links:
    def __init__(self, a: SignatureTree, b: SignatureTree, percent: int):
        self.a, self.b, self.percent, self.same = a, b, percent, a is b
        self.offset = 0 if self.same else len(a.sizes)
        self.parent = list(range(self.offset + len(b.sizes)))
        self.forest: list[tuple[int, int]] = []
        self.of_a = np.zeros(len(a.sizes), np.int64)
        self.of_b = self.of_a if self.same else np.zeros(len(b.sizes), np.int64)

    def leaves(self, i: int, j: int) -> None:
        a, b, percent = self.a, self.b, self.percent
        rows, cols = a.children(0, i), b.children(0, j)
        sa, sb = a.sizes[rows.start : rows.stop, None], b.sizes[None, cols.start : cols.stop]
        apart = np.bitwise_count(a.bits[rows.start : rows.stop, None] ^ b.bits[None, cols.start : cols.stop]).sum(2)
        la, lb = a.lengths[rows.start : rows.stop, None], b.lengths[None, cols.start : cols.stop]
        # Bits that differ stand for different shingles: |x & y| <= (|x| + |y| - bits) / 2 over the shared shingles.
        good = (100 + percent) * (la + lb - apart.astype(np.int64)) >= 2 * percent * (sa + sb)
        if self.same and i == j:
            good = np.triu(good, 1)
        many = np.count_nonzero(good)
        if not many:
            return
        if many > FEW:
            (ua, ma), (ub, mb) = a.incidence(i), b.incidence(j)
            _, ca, cb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
            common = (ma[:, ca].astype(np.float32) @ mb[:, cb].astype(np.float32).T).astype(np.int64)
        else:
            common = np.zeros(good.shape, np.int64)
            for x, y in zip(*np.nonzero(good), strict=True):
                common[x, y] = len(np.intersect1d(a.sets[rows.start + x], b.sets[cols.start + y], assume_unique=True))
        good &= (100 + percent) * common >= percent * (sa + sb)
        if not good.any():
            return
        self.of_a[rows.start : rows.stop] += good @ b.weights[cols.start : cols.stop]
        self.of_b[cols.start : cols.stop] += a.weights[rows.start : rows.stop] @ good
        parent, offset = self.parent, self.offset
        pa, pb = np.array([_find(parent, x) for x in rows]), np.array([_find(parent, y + offset) for y in cols])
        for x, y in zip(*np.nonzero(good & (pa[:, None] != pb[None])), strict=True):
            x, y = rows.start + int(x), cols.start + int(y)
            p, q = _find(parent, x), _find(parent, y + offset)
            if p != q:
                parent[p] = q
                self.forest.append((x, y))


def _join_blocks(percent: int):
    def tree(row_ids: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, SignatureTree]:
        sizes, lengths, weights = np.frombuffer(sizes, np.int64).reshape(3, -1)
        tokens = np.frombuffer(data, np.uint64)
        ends = np.cumsum(lengths)
        t = SignatureTree(sizes, [tokens[e - n : e] for e, n in zip(ends, lengths, strict=True)], weights)
        return np.frombuffer(row_ids, np.int64)[t.order], t

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids_a, a = tree(row.ids, row.sizes, row.data)
                if row.other_ids is None:
                    ids_b, b = ids_a, a
                else:
                    ids_b, b = tree(row.other_ids, row.other_sizes, row.other_data)
                forest, of_a, of_b = all_links(a, b, percent)
                yield pd.DataFrame({"src": [ids_a[x] for x, _ in forest], "dst": [ids_b[y] for _, y in forest], "n_links": 0}, dtype=np.int64)
                for ids, n in ((ids_a, of_a),) if a is b else ((ids_a, of_a), (ids_b, of_b)):
                    yield pd.DataFrame({"src": ids[n > 0], "dst": ids[n > 0], "n_links": n[n > 0]}, dtype=np.int64)

    return run


_BLOCKS = "family long, low long, high long, most long, fewest long, bits array<bigint>, ids binary, sizes binary, data binary"


def _pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by family and size; runs of one family become blocks of bounded bytes."""
    held, family, size = [], None, 0

    def block() -> pd.DataFrame:
        sets = [np.frombuffer(r.tokens, np.uint64) for r in held]
        sizes = np.array([r.n for r in held], np.int64)
        lengths = np.array([len(x) for x in sets], np.int64)
        node = np.zeros(BLOCK_BITS // 64, np.uint64)
        fewest = BLOCK_BITS
        for x in sets:
            own = _bitmap(x, BLOCK_BITS)
            fewest = min(fewest, int(np.bitwise_count(own).sum()))
            node |= own
        weights = np.array([r.weight for r in held], np.int64)
        return pd.DataFrame([{
            "family": family, "low": sizes.min(), "high": sizes.max(), "most": lengths.max(), "fewest": fewest, "bits": node.view(np.int64),
            "ids": np.array([r.print for r in held], np.int64).tobytes(), "sizes": np.concatenate([sizes, lengths, weights]).tobytes(), "data": np.concatenate(sets).tobytes(),
        }])

    for batch in batches:
        for row in batch.itertuples(index=False):
            if held and (row.family != family or size >= BLOCK_BYTES):
                yield block()
                held, size = [], 0
            family = row.family
            held.append(row)
            size += 8 * int(row.n)
    if held:
        yield block()


def ngram_components(documents: DataFrame, percent: int = PERCENT, words: int = WORDS, sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links; on demand also the fingerprint of each row's set and a fingerprint that
    tells its component apart, for rows with an id."""
    spark = documents.sparkSession
    bounded_batches(spark)
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(None).cast("long"))
    chars = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(chars / 6 / PART_TOKENS) + 1)
    known = documents.where(F.col("doc_id").isNotNull()).select(ids.alias("doc_id"), "text")
    packed = known.mapInPandas(trimmed(_shingle(parts, words, _frequent(known, chars, words))), _PACK)
    # Document rows (part -1) and frequent shingles are dealt out by row, the others by part: as many parts to each task.
    tasks = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    task = F.when(F.col("part") >= 0, F.col("part").cast("long")).otherwise(F.pmod(F.xxhash64("doc_ids"), F.lit(tasks))).cast("int")
    dealt = packed.repartitionById(tasks, task).sortWithinPartitions("part")
    both = materialize(dealt.mapInPandas(trimmed(_share(parts)), _SHARED), "shingles")
    all_docs = both.where(F.col("bucket") == -1).select("doc_ids", "sizes", "prints").mapInPandas(_unpack_documents, "doc_id long, n_shingles long, print long")

    back = both.where(F.col("bucket") >= 0).repartitionById(tasks, F.col("bucket")).sortWithinPartitions("bucket")
    candidates = materialize(back.mapInPandas(trimmed(_gather(percent)), _CANDIDATE), "candidates")
    prefix = materialize(candidates.select("print", "prefix").mapInPandas(_explode_prefixes, "print long, token long"), "prefix")
    # Sets of one token are linked along sorted runs, so a token of many sets is split freely.
    edges = prefix.repartitionByRange("token", "print").sortWithinPartitions("token", "print").mapInPandas(_chain, "src long, dst long")
    families = connected_components(edges).withColumnRenamed("id", "print").withColumnRenamed("component", "family")

    by_set = materialize(all_docs.where(F.col("n_shingles") > 0).groupBy("print", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight")), "sets")
    weights = by_set.select("print", F.col("n_shingles").alias("n"), "weight")
    members = candidates.join(families, "print").join(weights, ["print", "n"]).select("family", "n", "print", "tokens", "weight")
    blocks = materialize(members.repartitionByRange("family", "n", "print").sortWithinPartitions("family", "n", "print").mapInPandas(_pack_blocks, _BLOCKS).withColumn("block", F.expr("uuid()")), "blocks")
    own = blocks.select("ids", "sizes", "data", *[F.lit(None).cast("binary").alias(f"other_{c}") for c in ("ids", "sizes", "data")])
    # Blocks of one family meet only if their size ranges and the overlap that their bitmaps allow leave a link possible.
    several = blocks.groupBy("family").count().where("count > 1").select("family")
    light = materialize(blocks.select("family", "block", "low", "high", "most", "fewest", "bits").join(several, "family", "left_semi"), "nodes")
    x, y = light.alias("x"), light.alias("y")
    near = x.join(y, F.col("x.family") == F.col("y.family")).where(
        (F.col("x.block") < F.col("y.block")) & (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    )
    common = F.aggregate(F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, v: s + v)
    overlap = F.least(*[F.col(f"{t}.most") - F.greatest(F.lit(0), F.col(f"{t}.fewest") - F.col("common")) for t in ("x", "y")])
    meet = near.withColumn("common", common).where((100 + percent) * overlap >= percent * (F.col("x.low") + F.col("y.low"))).select(F.col("x.block").alias("block"), F.col("y.block").alias("other"))
    other = blocks.select(F.col("block").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("ids", "sizes", "data")])
    pairs = meet.join(blocks.select("block", "ids", "sizes", "data"), "block").join(other, "other").select(*own.columns)
    # Rows of one set (src = dst) have the number of its links in a pair of blocks, the others are the forest.
    links = materialize(own.unionByName(pairs).repartition(F.xxhash64("ids", "other_ids")).mapInPandas(trimmed(_join_blocks(percent)), "src long, dst long, n_links long"), "links")

    # Nodes are sets: rows of one id with different texts are documents of their own.
    linked = connected_components(links, roots=False).withColumnRenamed("id", "print")
    counted = links.where(F.col("n_links") > 0).groupBy(F.col("src").alias("print")).agg(F.sum("n_links").alias("others"))
    # A set with links that no other stands before is the smallest of its component.
    joined = counted.join(linked, "print", "left").select("print", F.coalesce("component", "print").alias("component"), "others")
    by_set = by_set.join(joined, "print", "left")
    smallest = by_set.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("smallest"))
    n_links = (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    named = by_set.join(smallest, "component", "left").select("print", "n_shingles", "weight", F.coalesce("smallest", "first").alias("component_id"), n_links, F.coalesce("component", "print").alias("component"))
    out = join_hot_keys(all_docs, materialize(named, "named"), ["print", "n_shingles"], "weight", ["component_id", "n_links", "component"])
    more = ["print", F.coalesce("component", "print").alias("component")] if sets else []
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)
    if sets:
        return out
    unknown = documents.where(F.col("doc_id").isNull()).select("doc_id", "text")
    return out.unionByName(unknown.mapInPandas(_count_only(words), "doc_id long, n_shingles long, component_id long, n_links long"))


def with_prints(documents: DataFrame, name: str, plain: str, words: int = WORDS) -> DataFrame:
    """documents with the fingerprint of each text's set in `name`, and in `plain` the text itself where it has no words."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        shingler = Shingler(words)
        return pd.Series([fingerprint(shingler.hashes(t)) for t in texts], dtype="int64")

    empty = fingerprint(np.zeros(0, np.uint64))
    return documents.withColumn(name, prints("text")).withColumn(plain, F.when(F.col(name) == empty, F.col("text")))


def _count_only(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            none = pd.array([None] * len(batch), dtype="Int64")
            yield pd.DataFrame({"doc_id": none, "n_shingles": [len(shingler.hashes(t)) for t in batch["text"]], "component_id": none, "n_links": 0})

    return run


def oracle(percent: int = PERCENT, words: int = WORDS) -> str:
    """For tables whose ids are distinct."""
    last = words - 1
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {last}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {last}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.smallest AS component_id, coalesce(l.n, 0) AS n_links
FROM docs d JOIN (SELECT x, min(y) AS smallest FROM reach GROUP BY x) r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = d.doc_id"""
