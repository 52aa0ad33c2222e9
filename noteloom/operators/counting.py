"""Chunking with a tokenizer whose counts do not add up.

The rules are those of `chunking`; what differs is how a piece is measured: its text with the breadcrumb in front goes to
the counter as a whole, and a union of pieces is counted again. Sections and children come from the same column folds. Then
all notes of an Arrow batch are folded side by side: each round gathers the texts that the folds ask for next, the counter
gets those that it has not seen in this batch, in calls of bounded size, and the folds go on. A note asks for one text at a
time, a call to the counter holds texts of many notes.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.operators import chunking
from noteloom.operators.chunking import HARD_LIMIT, ChunkConfig

Count = Callable[[Sequence[str]], Sequence[int]]
#: Texts and signs of one call to the counter, and notes that are folded side by side.
CALL_TEXTS, CALL_CHARS, SIDE_BY_SIDE = 64, 1 << 20, 256

Piece = tuple[int, int, tuple[str, ...]]  # first line, line behind the last, breadcrumb


def prefixed(lines: list[str], body_ends: bool, piece: Piece) -> str:
    """The text of a chunk: breadcrumb, an empty line, its lines."""
    start, end, breadcrumb = piece
    text = "\n".join(lines[start:end]) + ("\n" if end < len(lines) or body_ends else "")
    return " > ".join(breadcrumb) + "\n\n" + text if breadcrumb else text


def common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def fold_note(lines: list[str], body_ends: bool, sections: list[tuple[Piece, list[Piece]]], config: ChunkConfig) -> Generator[str, int, list[tuple[Piece, int]]]:
    """Yields texts to be counted and is sent their counts; returns the chunks with theirs. sections: pieces that are not
    blank, each with its children (none if nothing cuts it)."""
    text = lambda piece: prefixed(lines, body_ends, piece)
    pieces: list[tuple[Piece, int | None]] = []
    for whole, children in sections:
        n = yield text(whole)
        if n <= config.ceiling or not children:
            pieces.append((whole, n))
        else:
            pieces += [(c, None) for c in children]
    out: list[tuple[Piece, int]] = []
    at = 0
    while at < len(pieces):
        now, n = pieces[at]
        if n is None:
            n = yield text(now)
        at += 1
        while n < config.floor and at < len(pieces):
            following = pieces[at][0]
            union = (now[0], following[1], common(now[2], following[2]))
            size = yield text(union)
            if size > config.ceiling:
                break
            now, n, at = union, size, at + 1
        out.append((now, n))
    return out


class Counts:
    """Counts of texts, each asked for once while it is known."""

    def __init__(self, count: Count):
        self.count, self.known, self.calls = count, {}, 0

    def of(self, texts: Sequence[str]) -> list[int]:
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        first = size = 0
        for i, t in enumerate(new):
            if i > first and (i - first >= CALL_TEXTS or size + len(t) > CALL_CHARS):
                self._ask(new[first:i])
                first, size = i, 0
            size += len(t)
        if first < len(new):
            self._ask(new[first:])
        return [self.known[t] for t in texts]

    def _ask(self, texts: list[str]) -> None:
        said = list(self.count(texts))
        self.calls += 1
        if len(said) != len(texts):
            raise ValueError(f"the counter returned {len(said)} counts for {len(texts)} texts")
        self.known.update(zip(texts, map(int, said), strict=True))


def fold_all(folds: list[Generator[str, int, list[tuple[Piece, int]]]], counts: Counts) -> list[list[tuple[Piece, int]]]:
    """Run folds side by side, in rounds of one question each."""
    out: list[list[tuple[Piece, int]]] = [[] for _ in folds]
    asked: dict[int, str] = {}

    def step(i: int, answer: int | None) -> None:
        try:
            asked[i] = folds[i].send(answer)  # type: ignore[arg-type]
        except StopIteration as e:
            out[i] = e.value

    for i in range(len(folds)):
        step(i, None)
    while asked:
        who = list(asked)
        answers = counts.of([asked.pop(i) for i in who])
        for i, n in zip(who, answers, strict=True):
            step(i, n)
    return out


def chunk_notes(notes: DataFrame, load: Callable[[], Count], config: ChunkConfig | None = None, body: str = "body") -> DataFrame:
    """What `chunking.chunk_notes` gives, with tokens of a counter that `load` makes once per worker."""
    config = config or ChunkConfig()
    keep = [c for c in notes.columns if c != body]
    scanned = chunking.scan_sections(notes, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load()
        piece = lambda p: (p["start"], p["end"], tuple(p["breadcrumb"]))
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                own = batch.slice(at, SIDE_BY_SIDE)
                lines, ends, sections = (own.column(c).to_pylist() for c in ("lines", "ends", "sections"))
                folds = [fold_note(x, e, [(piece(s["piece"]), [piece(c) for c in s["children"]]) for s in parts], config) for x, e, parts in zip(lines, ends, sections, strict=True)]
                made = [(i, n, p, tokens) for i, chunks in enumerate(fold_all(folds, Counts(count))) for n, (p, tokens) in enumerate(chunks)]
                rows = pa.array([i for i, *_ in made], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[own.column(c).take(rows) for c in keep], pa.array([n for _, n, *_ in made], pa.int32()), pa.array([list(p[2]) for *_, p, _ in made], pa.list_(pa.string())),
                        pa.array([prefixed(lines[i], ends[i], p) for i, _, p, _ in made], pa.string()), pa.array([t for *_, t in made], pa.int32()),
                    ],
                    [*keep, "chunk_index", "breadcrumb", "text", "tokens"],
                )

    scanned = scanned.where(F.size("sections") > 0).select(*keep, "lines", "ends", "sections")
    shape = T.StructType([notes.schema[c] for c in keep]).add("chunk_index", T.IntegerType()).add("breadcrumb", T.ArrayType(T.StringType())).add("text", T.StringType()).add("tokens", T.IntegerType())
    tokens = F.col("tokens")
    return scanned.mapInArrow(run, shape).withColumns({"oversize": tokens > config.ceiling, "error": F.when(tokens > HARD_LIMIT, "chunk over the hard limit")})
