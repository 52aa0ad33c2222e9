"""SentencePiece encoding and decoding: relational lattice.

Words (runs that no piece can cross) are made distinct, exploded into substrings of at most the longest piece, joined to
the piece table, grouped by word, and folded with the higher-order `aggregate`. The fold follows the type of the model
file. For a unigram file it is Viterbi: the segmentation with the largest sum of scores, traced back by a second fold. The
scores of a BPE file are merge ranks, whose sum says nothing (`the` would be `t` + `he`, whose ranks add up to less), so
for such a file the fold takes the edges of the same lattice by rank, then place, and an edge whose two ends are still
boundaries removes the boundaries inside it. That is what the merges do: as long as its ends are boundaries, what lies
between evolves like the piece on its own, and each piece on its own is complete by its turn (`PieceTable.load` checks
that of every piece). Ids equal the library's. Signs outside the table become byte pieces. Words of any length take this
way: substrings come from windows of a word, and the boundaries of a word are the bits of one long. Words of LIMB signs or
more, whose state would be copied with every edge of such a fold, run the same fold over the same edges in Arrow batches.

Each input split is a block: its distinct words get their ids as rows of the lexicon in the shared folder, and the
scan that encodes the block's texts reads only those, so texts are never shuffled and no task holds the whole
lexicon. Every document's ids are decoded again and compared with its text (`exact`).

Nulls and empty texts have no pieces. Repeated rows are encoded row by row. `decode` gives back the
text exactly, but for the piece sign itself, which reads back as a space (`exact` is false there). Empty tables give no
rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import block_batches, bounded_batches, flagged, materialize, nullable, set_for_now, stage_path, trimmed

SPACE = "▁"
#: Words of fewer signs have their boundaries in one long.
LIMB = 62
#: Substrings are taken from windows of WINDOW signs and the longest piece, and those from windows of OUTER signs.
WINDOW, OUTER = 64, 4096
#: Splits whose words are encoded together, and folders of the lexicon.
SPLITS, FOLDERS = 1024, 4096
#: Words whose edges a task groups by hash before it sorts.
GROUPS_IN_MEMORY = 100_000
#: Added to the lowest score for a sign outside the table.
UNKNOWN_PENALTY = 10.0
#: Signs between whose classes words are cut, if the table has no piece that crosses.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = "0-9!-/:-@\\[-`{-~"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class PieceTable:
    pieces: tuple[tuple[str, int, float], ...]  # (piece, id, score) of normal pieces
    first_byte: int  # id of <0x00>; the 256 byte pieces are consecutive
    size: int
    pattern: str  # words
    merges: bool  # a BPE file

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def kind(self) -> str:
        """Type of packed ids."""
        return "<u2" if self.size <= 1 << 16 else "<u4"

    @property
    def unknown(self) -> float:
        return min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str | None = None) -> PieceTable:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path or default_model(), "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.trainer_spec
        if spec.model_type not in (spec.BPE, spec.UNIGRAM):
            raise ValueError("only unigram and BPE models")
        model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        ids = range(model.get_piece_size())
        odd = [i for i in ids if model.is_byte(i)]
        if [model.id_to_piece(i) for i in odd] != [f"<0x{b:02X}>" for b in range(256)] or odd[-1] - odd[0] != 255:
            raise ValueError("the model needs 256 consecutive byte pieces")
        normal = tuple((model.id_to_piece(i), i, float(model.get_score(i))) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
        crossing = re.compile(rf"[^{SPACE}]{SPACE}|\n")
        if any(crossing.search(p) for p, _, _ in normal):
            raise ValueError("a piece crosses words")
        if spec.model_type == spec.BPE and (odd_pieces := out_of_order(normal)):
            raise ValueError(f"merges are not in the order of their ranks: {odd_pieces[:5]}")
        mixed = re.compile(rf"[{LETTERS}][{MARKS}]|[{MARKS}][{LETTERS}]")
        rest = rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+"
        if not any(mixed.search(p) for p, _, _ in normal):
            glue = rf"(?![^{LETTERS}{MARKS}{SPACE}\n])"
            rest = rf"{SPACE}*+[{LETTERS}]++{glue}|{SPACE}*+[{MARKS}]++{glue}|{rest}"
        return cls(normal, odd[0], len(ids), rf"\n|{rest}", spec.model_type == spec.BPE)

    def words(self, text: str) -> list[str]:
        return re.findall(self.pattern, SPACE + text.replace(" ", SPACE)) if text else []

    def ids_of(self, part: str, table: dict[str, int]) -> list[int]:
        known = table.get(part)
        return [known] if known is not None else [self.first_byte + b for b in part.encode()]


def out_of_order(pieces: tuple[tuple[str, int, float], ...]) -> list[str]:
    """Pieces of a BPE file that their own signs do not merge into by the turn of their rank."""
    scores = {p: s for p, _, s in pieces}
    out = []
    for piece, _, score in pieces:
        parts, least = list(piece), np.inf
        while len(parts) > 1:
            ready = [(scores[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in scores]
            if not ready:
                break
            best, at = max(ready)
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            least = min(least, best)
        if len(parts) > 1 or least < score:
            out.append(piece)
    return out


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def _start_of(e: Column) -> Column:
    return F.shiftright(e, 6).bitwiseAND((1 << 26) - 1).cast("int")


def _replay_merges(word: Column, edges: Column) -> Column:
    """Fold over a word's edges (packed longs, sorted by rank, then start) from all boundaries to those that remain."""
    everything = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(word) + 1) - 1

    def step(bounds: Column, e: Column) -> Column:
        start = _start_of(e)
        end = start + e.bitwiseAND(63).cast("int")
        ends = _power(start) + _power(end)
        return F.when(bounds.bitwiseAND(ends) == ends, bounds.bitwiseAND(F.bitwise_not(_power(end) - _power(start + 1)))).otherwise(bounds)

    return F.aggregate(edges, everything, step)


def replay_long(n: int, edges: np.ndarray) -> list[int]:
    """The same for a word of any length n: its boundaries."""
    bounds = bytearray(b"\x01") * (n + 1)
    for start, size in zip((edges >> 6 & (1 << 26) - 1).tolist(), (edges & 63).tolist(), strict=True):
        end = start + size
        if bounds[start] and bounds[end]:
            bounds[start + 1 : end] = bytes(size - 1)
    return np.flatnonzero(np.frombuffer(bounds, np.uint8)).tolist()


def _bytes_of(word: Column, start: Column, first_byte: int) -> Column:
    """Byte pieces of the sign at `start`."""
    raw = F.hex(F.encode(F.substring(word, start + 1, F.lit(1)), "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda i: F.conv(F.substring(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + first_byte)


def cut_at(word: str, bounds: int) -> list[str]:
    """Parts of a word between the boundaries that are set."""
    out, first, bounds = [], 0, bounds & ~1
    while bounds:
        low = bounds & -bounds
        last = low.bit_length() - 1
        out.append(word[first:last])
        first, bounds = last, bounds ^ low
    return out


def viterbi_long(edges: list, byte_ids: Callable[[int], list[int]]) -> list[int]:
    """Ids of the best path over edges sorted by end and start; ties go to the first start, as in the fold of columns."""
    best, back = [0.0], [(0, 0)]
    for e in edges:
        score = best[e["start"]] + e["score"]
        if e["end"] == len(best):
            best.append(score)
            back.append((e["start"], e["id"]))
        elif score > best[-1]:
            best[-1], back[-1] = score, (e["start"], e["id"])
    out, at = [], len(best) - 1
    while at:
        at, i = back[at]
        out.append([i] if i >= 0 else byte_ids(at))
    return [i for ids in reversed(out) for i in ids]


def _viterbi(edges: Column) -> Column:
    """Fold over edges sorted by end and start: best path to each position as (score, start, id)."""
    node = "struct<score:double,start:int,id:int>"
    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id"))).cast(f"array<{node}>")

    def step(best: Column, e: Column) -> Column:
        new = F.struct((F.element_at(best, e["start"] + 1)["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["id"].alias("id")).cast(node)
        worse = F.element_at(best, -1)["score"] >= new["score"]
        return F.when(e["end"] == F.size(best), F.concat(best, F.array(new))).when(worse, best).otherwise(F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(new)))

    return F.aggregate(edges, none, step)


def _trace(word: Column, best: Column, first_byte: int) -> Column:
    """Follow the back pointers from the last position."""
    start = F.struct(F.size(best).alias("at"), F.array().cast("array<int>").alias("ids")).cast("struct<at:int,ids:array<int>>")

    def step(s: Column, position: Column) -> Column:
        node = F.element_at(best, position)
        ids = F.when(node["id"] >= 0, F.array(node["id"])).otherwise(_bytes_of(word, node["start"], first_byte))
        here = F.struct((node["start"] + 1).alias("at"), F.concat(ids, s["ids"]).alias("ids")).cast("struct<at:int,ids:array<int>>")
        return F.when(position == s["at"], here).otherwise(s)

    return F.aggregate(F.sequence(F.size(best), F.lit(2), F.lit(-1)), start, step, lambda s: s["ids"])


def _lattice(words: DataFrame, table: PieceTable, key: list[str], carried: list[str], long: bool) -> DataFrame:
    """Edges of each word: the columns `key`, start, end, id, score and rank. The columns `carried` come with one edge of
    each word, null with the others."""
    spark = words.sparkSession
    ranked = sorted(table.pieces, key=lambda x: (-x[2], x[1]))
    ranks = {s: r for r, (_, _, s) in reversed(list(enumerate(ranked)))}  # equal scores share a rank
    pieces = F.broadcast(spark.createDataFrame([(p, i, s, ranks[s]) for p, i, s in table.pieces], "piece string, id int, score double, rank int"))  # the model's vocabulary
    if long:
        # Substrings are taken from windows, and those from windows of a word, so that no row carries more than a small one.
        def windows(text: str, size: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)), lambda i: F.substring(text, i + 1, F.lit(size + table.longest)))

        outer = words.select(*key, *carried, F.posexplode(windows("word", OUTER)).alias("far", "outer"))
        inner = outer.select(*key, *carried, "far", F.posexplode(windows("outer", WINDOW)).alias("near", "window")).where(F.col("near") < OUTER // WINDOW)
        text, own = "window", F.least(F.length("window"), F.lit(WINDOW))
        starts = inner.select(*key, *carried, text, (F.col("far") * OUTER + F.col("near") * WINDOW).alias("base"), F.explode(F.sequence(F.lit(0), own - 1)).alias("local"))
    else:
        text = "word"
        starts = words.select(*{*key, *carried, text}, F.lit(0).alias("base"), F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("local"))
    first = F.col("base") + F.col("local") == 0
    starts = starts.withColumns({c: F.when(first, F.col(c)) for c in carried})
    stops = F.sequence(F.col("local") + 1, F.least(F.length(text), F.col("local") + table.longest))
    parts = starts.select(*{*key, *carried, text}, "base", "local", F.explode(stops).alias("stop"))
    parts = parts.withColumns({"start": F.col("base") + F.col("local"), "end": F.col("base") + F.col("stop")})
    parts = parts.withColumns({c: F.when(F.col("end") == 1, F.col(c)) for c in carried})
    if table.merges:
        # Signs are boundaries of their own; one edge of one sign keeps words that nothing can merge.
        parts = parts.where((F.col("end") > F.col("start") + 1) | (F.col("start") == 0))
    lattice = parts.withColumn("piece", F.substring(text, F.col("local") + 1, F.col("stop") - F.col("local"))).join(pieces, "piece", "left")
    return lattice.where(F.col("id").isNotNull() | (F.col("end") == F.col("start") + 1))


def _edges(table: PieceTable) -> Column:
    """Of a BPE file one long each: rank, start and length, so that sorting longs sorts by rank, then start."""
    if table.merges:
        rank = F.shiftleft(F.coalesce("rank", F.lit(len(table.pieces))).cast("bigint"), 32)
        edge = rank + F.shiftleft(F.col("start").cast("bigint"), 6) + (F.col("end") - F.col("start")).cast("bigint")
    else:
        edge = F.struct("end", "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(table.unknown)).alias("score"))
    return F.sort_array(F.collect_list(edge)).alias("edges")


def encode_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """words: distinct (`word`, `salt`), and `blocks` that pass through. Returns word, blocks, ids (packed little-endian
    bytes). One edge of each word carries the blocks through the grouping. Words beyond LIMB signs are grouped by their
    hash and length, so that they are not copied with each edge, and meet their text again by a join."""
    short, long = words.where(F.length("word") < LIMB), words.where(F.length("word") >= LIMB)
    key = F.xxhash64("word", F.reverse("word"))
    folded = _lattice(short, table, ["word", "salt"], ["blocks"], False).groupBy("word", "salt").agg(_edges(table), F.first("blocks", ignorenulls=True).alias("blocks"))
    named = long.withColumns({"key": key, "n": F.length("word")})
    edges = _lattice(named, table, ["key", "n", "salt"], [], True).groupBy("key", "n", "salt").agg(_edges(table))
    if table.merges:
        short_state = _replay_merges(F.col("word"), F.col("edges"))
    else:
        short_state = _trace(F.col("word"), _viterbi(F.col("edges")), table.first_byte)
    long_words = named.select("key", "n", "salt", "word", "blocks").join(edges, ["key", "n", "salt"])
    known = {p: i for p, i, _ in table.pieces}
    kind, merges, ids_of = table.kind, table.merges, table.ids_of

    def of_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, states = batch["word"], batch["state"].tolist()
            lists = [[x for part in cut_at(w, b) for x in ids_of(part, known)] for w, b in zip(words, states, strict=True)] if merges else states
            yield pd.DataFrame({"word": words, "blocks": batch["blocks"], "ids": [np.array(i, kind).tobytes() for i in lists]})

    def of_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = []
            for word, own in zip(batch["word"], batch["edges"], strict=True):
                if merges:
                    at = replay_long(len(word), np.asarray(own, np.int64))
                    ids.append([x for a, b in zip(at[:-1], at[1:], strict=True) for x in ids_of(word[a:b], known)])
                else:
                    ids.append(viterbi_long(own, lambda i: ids_of(word[i], {})))  # noqa: B023
            yield pd.DataFrame({"word": batch["word"], "blocks": batch["blocks"], "ids": [np.array(i, kind).tobytes() for i in ids]})

    out = "word string, blocks array<bigint>, ids binary"
    return folded.select("word", "blocks", short_state.alias("state")).mapInPandas(trimmed(of_short), out).unionByName(
        long_words.select("word", "blocks", "edges").mapInPandas(trimmed(of_long), out)
    )


def _block() -> Column:
    return F.xxhash64(F.input_file_name(), F.input_file_block_start())


def _is_scan(documents: DataFrame) -> bool:
    """Whether rows come straight from files, so that each knows its split."""
    plan = documents._jdf.queryExecution().optimizedPlan().toString()
    return bool(documents.inputFiles()) and all(re.match(r"\W*(Project|Filter|Relation) ?", line) for line in plan.splitlines() if line.strip())


def _distinct_words(pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, block, seen = re.compile(pattern).findall, None, set()

        def out():
            words = sorted(seen)  # neighbours share their beginnings, which compresses well
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pd.DataFrame({"block": np.full(len(part), block, np.int64), "word": part})

        for batch in batches:
            for b, text in zip(batch["block"].tolist(), batch["text"].tolist(), strict=True):
                if b != block:
                    if seen:
                        yield from out()
                    block, seen = b, set()
                seen.update(find(SPACE + text.replace(" ", SPACE)))
        if seen:
            yield from out()

    return run


def _read_lexicon(folder: str, group: int, block: int) -> dict[str, bytes]:
    """Ids of a block's words as bytes; rows of a folder are sorted by block."""
    known: dict[str, bytes] = {}
    for batch in block_batches(f"{folder}/group={group}", block, ["word", "ids"]):
        known.update(zip(batch.column("word").to_pylist(), batch.column("ids").to_pylist(), strict=True))
    return known


def decode_ids(ids: np.ndarray, parts: list[bytes]) -> str:
    raw = b"".join(map(parts.__getitem__, ids.tolist())).decode()
    return raw.replace(SPACE, " ")[1:]


class BatchDecoder:
    """Bytes of many ids at a time."""

    def __init__(self, parts: list[bytes]):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[at + np.arange(len(at))].tobytes()


def byte_parts(table: PieceTable) -> list[bytes]:
    out = [b""] * table.size
    for piece, i, _ in table.pieces:
        out[i] = piece.encode()
    for b in range(256):
        out[table.first_byte + b] = bytes([b])
    return out


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, exact: the piece ids of each text and whether they decode to it."""
    spark = documents.sparkSession
    bounded_batches(spark)
    table = PieceTable.load(model)
    kind = table.kind
    if not _is_scan(documents):
        documents = materialize(documents, "documents")
    texts = documents.select("text", _block().alias("block")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    used = materialize(texts.mapInPandas(trimmed(_distinct_words(table.pattern)), "block long, word string"), "words")
    splits = used.agg(F.count_distinct("block")).first()[0]
    folder, folders = stage_path(spark, "lexicon"), max(1, min(FOLDERS, splits))
    group = F.pmod(F.col("block"), F.lit(folders)).cast("int")
    # Ids travel as packed little-endian bytes. Words are short-lived groups, for which hashing beats sorting; a partition
    # of words grows some twenty times when it is exploded, so partitions are not merged by their bytes.
    settings = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(GROUPS_IN_MEMORY), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with set_for_now(spark, settings):
        # A salt bounds the list of splits that a frequent word comes with.
        salted = used.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(-(-max(splits, 1) // SPLITS))).cast("int"))
        words = salted.repartition(tasks, "word", "salt").groupBy("word", "salt").agg(F.collect_list("block").alias("blocks"))
        lexicon = encode_words(words, table).select("word", "ids", F.explode("blocks").alias("block")).withColumn("group", group)
        # All words of a block meet in one folder; row groups are small, so that a reader opens little beside its block.
        dealt = lexicon.repartitionById(max(tasks, 1), F.pmod("group", F.lit(tasks))).sortWithinPartitions("group", "block")
        dealt.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("group").parquet(folder)
    pattern, decoder = table.pattern, BatchDecoder(byte_parts(table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, block, known = re.compile(pattern).findall, None, {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                piece = batch.iloc[at : at + 500]
                raws, plain = [], []
                for b, g, text in zip(piece["block"].tolist(), piece["group"].tolist(), piece["text"].tolist(), strict=True):
                    if b != block:
                        known = {}
                        block, known = b, _read_lexicon(folder, g, b)
                    signs = SPACE + text.replace(" ", SPACE) if text else ""
                    raws.append(b"".join(map(known.__getitem__, find(signs))))
                    plain.append(signs.encode())
                ids = [np.frombuffer(r, kind).astype(np.int32) for r in raws]
                ends = np.cumsum(decoder_sizes(decoder, ids))
                back = decoder.raw(np.concatenate(ids)) if ids else b""
                exact = [t == back[e - n : e] for t, e, n in zip(plain, ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
                exact = [ok and SPACE not in (text or "") for ok, text in zip(exact, piece["text"].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": nullable(piece, "doc_id"), "n_pieces": np.array([len(x) for x in ids], np.int64), "ids": ids, "exact": exact})

    rows = documents.select(*flagged("doc_id"), "text", _block().alias("block")).withColumn("group", group)
    return rows.mapInPandas(trimmed(run), "doc_id long, n_pieces long, ids array<int>, exact boolean")


def decoder_sizes(decoder: BatchDecoder, lists: list[np.ndarray]) -> np.ndarray:
    """Bytes that each list of ids stands for."""
    return np.array([decoder.sizes[x].sum() for x in lists], np.int64)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    parts = byte_parts(PieceTable.load(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": nullable(batch, "doc_id"), "text": [decode_ids(np.asarray(x, np.int64), parts) if len(x) else "" for x in batch["ids"]]})

    return encoded.select(*flagged("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")
