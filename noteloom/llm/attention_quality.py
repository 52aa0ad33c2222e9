"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by numbers that are read off its bytes (`describe`), an encoder
layer turns them into a representation h, and gated attention w . (tanh(V h) * sigmoid(U h)), a softmax over the passages
of a document, weighs the representations into one, which a logistic output scores. Encoder, attention and output are
learned together from labels of documents, so that the weights tell which passages a verdict rests on.

Passages are runs of at least PASSAGE bytes that end at white space where some is near; a document has at most PASSAGES of
them, so those of a long document are longer. Together they are the whole text. The model is fitted on at most TRAIN_ROWS
labelled documents, chosen by a hash of doc_id among those whose crc32(doc_id) mod 5 is not 0, which bounds what comes to
the driver (TRAIN_ROWS * PASSAGES descriptions of some 240 bytes). All documents are scored in their own rows: no shuffle.

Nulls: a null text is empty; an empty text is one empty passage and gets the score of that. A null doc_id hashes like an
empty text, so it is held out. A document labelled more than once is good if all labels say so; of several texts with one
labelled id, one is learned from. Without labels of both kinds the score is the smoothed share of good rows. Of equal
weights the first passage is the top one. Repeated rows are scored row by row; empty tables give no rows; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import bounded_batches, materialize, trimmed
from noteloom.llm.toxicity import HELD_OUT, fold_of

TRAIN_ROWS = 4_000
PASSAGE, PASSAGES = 512, 64
#: Bytes behind a cut in which white space is looked for, and bytes described at a time.
NEAR, PORTION = 64, 1 << 20
THRESHOLD = 0.3
HIDDEN, GATES = 24, 12
EPOCHS, BAGS, RATE, DECAY = 30, 64, 0.01, 1e-4

#: Classes of bytes: letters, digits, white space, each ASCII mark, and the kinds of bytes of other signs.
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
LOWER, UPPER, DIGIT, BLANK, BREAK, CONTROL = range(6)
CLASSES = 6 + len(_MARKS) + 4


def _classes() -> np.ndarray:
    out = np.full(256, CONTROL, np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    out[ord(" ")], out[ord("\n")] = BLANK, BREAK
    out[_MARKS] = 6 + np.arange(len(_MARKS))
    for i, first in enumerate((0x80, 0xC0, 0xE0, 0xF0)):
        out[first:] = 6 + len(_MARKS) + i
    return out


_CLASS = _classes()
CONTINUED = 6 + len(_MARKS)
#: Pairs of neighbouring bytes fall into buckets: letters without case, and other classes as one sign each.
BUCKETS = 64
_FOLD = np.where(_CLASS == LOWER, np.arange(256) - 97, np.where(_CLASS == UPPER, np.arange(256) - 65, 26 + np.minimum(_CLASS, 6) - 2))
_BUCKET = np.random.default_rng(0).integers(0, BUCKETS, 32 * 32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))
WORD_NUMBERS = 9
NUMBERS = CLASSES + BUCKETS + WORD_NUMBERS


def cut_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages of documents that lie side by side in data, and the number of passages of each."""
    sizes = np.diff(offsets)
    length = np.maximum(PASSAGE, -(-sizes // PASSAGES))
    counts = np.maximum(1, -(-sizes // length))
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(offsets[:-1], counts) + number * np.repeat(length, counts)
    inner = np.flatnonzero(number)
    if len(inner):
        end = np.repeat(offsets[1:], counts)[inner]
        last = np.minimum(np.append(starts[1:], offsets[-1])[inner], end) - 1  # a passage keeps a byte at least
        near = data[np.minimum(starts[inner][:, None] + np.arange(NEAR), last[:, None])]
        blank = near <= 32
        at = np.where(blank.any(1), blank.argmax(1), 0)
        moved = np.minimum(starts[inner] + at, last)
        for _ in range(3):  # not inside a sign
            moved = np.where((data[moved] & 0xC0) == 0x80, np.minimum(moved + 1, last), moved)
        starts[inner] = moved
    return starts, counts


def describe(data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Numbers of passages that lie side by side in data and end at `end`."""
    out = np.zeros((len(starts), NUMBERS), np.float32)
    sizes = np.diff(np.append(starts, end))
    first = 0
    while first < len(starts):
        stop = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), PORTION)) + first)
        out[first:stop] = _describe(data[starts[first] : starts[first] + sizes[first:stop].sum()], sizes[first:stop])
        first = stop
    return out


def _describe(b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n = len(sizes)
    whole = np.maximum(sizes, 1)[:, None]
    of = np.repeat(np.arange(n), sizes)
    kind = _CLASS[b]
    classes = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    sign = _FOLD[b]
    inside = of[1:] == of[:-1]
    pairs = np.bincount((of[1:] * BUCKETS + _BUCKET[sign[:-1] << 5 | sign[1:]])[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.hstack([np.sqrt(classes / whole), np.sqrt(pairs / whole), _words(b, kind, of, n, sizes)]).astype(np.float32)


def _words(b: np.ndarray, kind: np.ndarray, of: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Words (runs without white space): number, mean and spread of length, how many of them repeat the one before or the
    one before that, are distinct, end in a mark, or are marks only; and the size of the passage."""
    visible = b > 32
    edge = np.concatenate([[True], ~visible[:-1] | (of[1:] != of[:-1])])[: len(b)]
    start = np.flatnonzero(visible & edge)
    size = np.log1p(sizes)[:, None]
    if not len(start):
        return np.hstack([np.zeros((n, WORD_NUMBERS - 1)), size])
    place = np.arange(len(b)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(b)]])))
    value = np.where(visible, (b.astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)], np.uint64(0))
    mark = (kind >= 6) & (kind < CONTINUED)
    length = np.add.reduceat(visible.astype(np.int64), start)
    marks = np.add.reduceat((mark & visible).astype(np.int64), start)
    key = np.add.reduceat(value, start)
    word_of = of[start]
    count = lambda which: np.bincount(word_of[which], minlength=n)
    same = lambda k: np.concatenate([np.zeros(min(k, len(key)), bool), (key[k:] == key[:-k]) & (word_of[k:] == word_of[:-k])])
    _, kept = np.unique(key * _ODD + word_of.astype(np.uint64), return_index=True)
    words = np.bincount(word_of, minlength=n)
    per = np.maximum(words, 1)
    mean = np.bincount(word_of, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(word_of, length.astype(float) ** 2, n) / per - mean**2, 0))
    shares = [np.bincount(word_of[kept], minlength=n), count(same(1)), count(same(2)), count(mark[start + length - 1]), count(marks == length)]
    return np.hstack([np.column_stack([np.log1p(words), np.log1p(mean), np.log1p(spread), *[s / per for s in shares]]), size])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts without nulls, and where each text starts."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)), places


def encode_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Descriptions of the passages of texts, the number of passages of each text, and where passages start in it."""
    if not len(column):
        return np.zeros((0, NUMBERS), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, offsets = bytes_of(column)
    starts, counts = cut_passages(data, offsets)
    return describe(data, starts, int(offsets[-1])), counts, starts - np.repeat(offsets[:-1], counts)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class AttentionModel:
    """mean and scale of the descriptions; encoder W, e; attention V, U, w; output c, b."""

    NAMES = ("W", "e", "V", "U", "w", "c", "b")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def constant(cls, share: float) -> AttentionModel:
        shapes = {"W": (NUMBERS, 1), "e": 1, "V": (1, 1), "U": (1, 1), "w": 1, "c": 1}
        return cls(np.zeros(NUMBERS), np.ones(NUMBERS), {k: np.zeros(s) for k, s in shapes.items()} | {"b": np.array(np.log(share / (1 - share)))})

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages of bags side by side."""
        p, first = self.weights, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"])}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f = self.weights, self.forward(x, counts)
        bag = np.repeat(np.arange(len(counts)), counts)
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * p["c"]
        from_z = dz[bag]
        da = (from_z * f["h"]).sum(1)
        da = f["a"] * (da - np.bincount(bag, f["a"] * da, len(counts))[bag])
        gate = da[:, None] * p["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (from_z * f["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ d, "b": d.sum()}

    @classmethod
    def learn(cls, bags: list[np.ndarray], y: np.ndarray, seed: int = 0) -> AttentionModel:
        """Adam over small groups of bags."""
        random = np.random.default_rng(seed)
        x, counts = np.concatenate(bags).astype(np.float64), np.array(list(map(len, bags)))
        scale = x.std(0)
        start = lambda *shape: random.normal(0, shape[0] ** -0.5, shape)
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights = {"W": start(NUMBERS, HIDDEN), "e": np.zeros(HIDDEN), "V": start(HIDDEN, GATES), "U": start(HIDDEN, GATES), "w": start(GATES), "c": start(HIDDEN), "b": np.array(np.log(share / (1 - share)))}
        model = cls(x.mean(0), np.where(scale > 1e-6, scale, 1.0), weights)
        x, first = model.standard(x), np.cumsum(counts) - counts
        moved = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
        steps, last = 0, EPOCHS * -(-len(y) // BAGS)
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for at in range(0, len(y), BAGS):
                own = order[at : at + BAGS]
                rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in own])
                steps += 1
                rate = RATE * (1 - (steps - 1) / last)
                for k, g in model.gradients(x[rows], counts[own], y[own]).items():
                    m, v = moved[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    weights[k] = weights[k] * (1 - rate * DECAY * (k != "b")) - rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        return model

    def score_texts(self, column: pa.Array) -> dict[str, np.ndarray]:
        """score, passages, and the place and weight of the top passage of each text; and the same of all passages."""
        x, counts, starts = encode_texts(column)
        if not len(counts):
            none = np.zeros(0, np.int64)
            return {"score": none.astype(float), "counts": none, "starts": none, "weights": none.astype(float), "own": none.astype(float), "top": none}
        f = self.forward(self.standard(x.astype(np.float64)), counts)
        first = np.cumsum(counts) - counts
        most = np.repeat(np.maximum.reduceat(f["a"], first), counts)
        top = np.minimum.reduceat(np.where(f["a"] == most, np.arange(len(most)), len(most)), first)
        return {"score": f["score"], "counts": counts, "starts": starts, "weights": f["a"], "own": _sigmoid(f["h"] @ self.weights["c"] + self.weights["b"]), "top": top}


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> AttentionModel:
    bounded_batches(documents.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    text = F.coalesce("text", F.lit(""))
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(known), "doc_id")  # at most train_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, counts, _ = encode_texts(batch.column("text"))
            ends = np.cumsum(counts)
            cells = pa.array([x[e - n : e].astype(np.float16).tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("hash"), cells], ["doc_id", "quality", "hash", "x"])

    described = sample.select("doc_id", "quality", "hash", "text").mapInArrow(trimmed(run), "doc_id long, quality int, hash long, x binary")
    rows = materialize(described.groupBy("doc_id", "quality").agg(F.min_by("x", "hash").alias("x")), "bags").collect()  # at most train_rows rows
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] > 0 for r in rows], float)
    if not len(y) or y.min() == y.max():
        return AttentionModel.constant((y.sum() + 0.5) / (len(y) + 1))
    return AttentionModel.learn([np.frombuffer(r["x"], np.float16).reshape(-1, NUMBERS).astype(np.float32) for r in rows], y)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def score_documents(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, and start (in bytes) and weight of the top passage."""
    model = fit(documents, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score_texts(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(s["score"]), pa.array(s["counts"]), pa.array(s["starts"][s["top"]]), pa.array(s["weights"][s["top"]])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_passages", "top_start", "top_weight"])

    scored = _texts(documents).mapInArrow(trimmed(run), "doc_id long, score double, n_passages long, top_start long, top_weight double")
    held_out, predicted = fold_of(F.col("doc_id")) == HELD_OUT, (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "n_passages", "top_start", "top_weight")


def score_passages(documents: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, passage, start (in bytes), weight and own score of every passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score_texts(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), s["counts"])
            number = np.arange(len(row)) - np.repeat(np.cumsum(s["counts"]) - s["counts"], s["counts"])
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(number), pa.array(s["starts"]), pa.array(s["weights"]), pa.array(s["own"])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "passage", "start", "weight", "score"])

    return _texts(documents).mapInArrow(trimmed(run), "doc_id long, passage long, start long, weight double, score double")
