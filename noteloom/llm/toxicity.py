"""Toxicity: noisy-channel deobfuscation.

A character language model (4-grams of the words of all texts, smoothed towards shorter contexts) and a channel model
(leetspeak signs, separators between letters, repeated letters) give each disguised word a lattice; Viterbi decoding
restores it, without a beam. A gap in a run of spaced signs is dropped or ends a word, so a run can hold several words;
the words of all likely readings and the run read as one word count. Restored and plain words and their stems (first
letters, STEMS) are the features of a logistic regression.

Tokens and runs of any length are decoded, in linear time. A word of more than WHOLE letters is no feature itself, its
stems are; so the readings of a spaced run that are inside one long word are told apart by its first letters only. Which
readings are followed is decided by the best score of the rest of the run, which a backward pass gives: all that can end
within the margin, no others. The channel reads more than RUN equal signs as RUN, a disguised token as one word, and a
spaced run without any plain letter as numbers.

The language model counts every text; its table is bounded by the alphabet. The classifier is fitted on at most
`TRAIN_ROWS` labelled rows, chosen by a hash of doc_id among those whose crc32(doc_id) mod 5 is not 0.

Nulls: a null text is empty and gets the score of a text without features. A null doc_id hashes like an empty text, so
it is held out. Rows labelled more than once count as toxic if any label says so. Without labels of both kinds the
score is the smoothed share of toxic rows. Repeated rows are scored row by row; empty tables give no rows; further
columns are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import bounded_batches, materialize, release_memory, trimmed

TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
#: Symbols of the language model: word edge and a to z.
SYMBOLS = 27
ORDER = 4
SMOOTHING = 3.0
RUN = 3
#: Hypotheses whose log probability is within this of the best count as restorations too.
MARGIN = 4.0
#: The same of the readings of a spaced run, which has an edge or none at every gap.
SPACED_MARGIN = 8.0
#: Letters of stems, and the most letters of a word that is a feature as a whole.
STEMS, WHOLE = (4, 5), 24
#: Tokens whose words a worker keeps, the most signs of such a token, and moves between nodes that it keeps.
CACHE_TOKENS, CACHE_SIGNS, CACHE_MOVES = 60_000, 64, 300_000

#: What a sign may stand for in disguised words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¥": "y", "§": "s",
}
#: Log probabilities of the channel: a letter as itself, a sign for a letter, a separator or a repeat dropped.
KEPT, SWAPPED, DROPPED, REPEATED = -0.05, -1.0, -1.0, -1.5
#: A gap of a spaced run: log probabilities of dropping it and of a word edge. The most frequent gap of a run rather
#: parts letters (GAP), any other rather parts words (ODD_GAP).
GAP, ODD_GAP, END = " ", "\t", "\n"
GAPS = {GAP: (KEPT, DROPPED), ODD_GAP: (DROPPED, KEPT), END: (0.0, 0.0)}

_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_WORD = re.compile(r"[^\W\d_]+")
#: Three or more single signs with separators between them.
_SPACED = re.compile(r"(?<![^\W_])(?:[a-z0-9@$!|+][ .\-_*~]{1,2}){2,}[a-z0-9@$!|+](?![^\W_])")
_GAP = re.compile(r"[ .\-_*~]+")
_LEET_TOKEN = re.compile(r"[^\s]*[a-z][0-9@$!|+(<{€£¥§.\-_*~]+[a-z][^\s]*|[^\s]*[0-9@$!|+(<{€£¥§][a-z][^\s]*|[a-z]+[0-9@$!|+][^\s]*")
_LETTERS = re.compile(r"[a-z]+")
_TRIPLE = re.compile(r"([a-z])\1\1")
_LONG_RUN = re.compile(r"(.)\1{%d,}" % RUN)
_EDGE = " .,;:?\"'`)]}>-_*~#%&"
#: Code of each sign up to 255 (1 to 26 for letters), and 0 for all others.
_CODE = np.array([max(0, ord(c) - 96) if "a" <= (c := chr(i).lower().translate(_FOLD)) <= "z" else 0 for i in range(256)] + [0], np.int32)


def _codes(text: str) -> np.ndarray:
    """0 for other signs, 1 to 26 for letters; runs of other signs become ORDER - 1 zeros."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    code = _CODE[np.minimum(raw, 256)]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    code = code[keep]
    return np.repeat(code, np.where(code > 0, 1, ORDER - 1))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SYMBOLS**ORDER, np.int64)

    def add(texts: list[str]) -> None:
        code = _codes(" " + " ".join(texts) + " ")
        gram = ((code[:-3] * SYMBOLS + code[1:-2]) * SYMBOLS + code[2:-1]) * SYMBOLS + code[3:]
        total[:] += np.bincount(gram, minlength=len(total))

    for batch in batches:
        held, size = [], 0
        for text in batch["text"]:
            held.append(text)
            size += len(text)
            if size > 250_000:
                add(held)
                held, size = [], 0
        if held:
            add(held)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})


class CharModel:
    """log p(letter | three letters before), interpolated with shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c4 = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
        c4[0, 0, 0, 0] = 0
        c3, c2, c1 = c4.sum(0), c4.sum((0, 1)), c4.sum((0, 1, 2))
        p = (c1 + 1) / (c1.sum() + SYMBOLS)
        for c in (c2, c3, c4):
            p = (c + SMOOTHING * p) / (c.sum(-1, keepdims=True) + SMOOTHING)
        self.log = np.log(p).astype(np.float32)

    @classmethod
    def fit(cls, texts: DataFrame) -> CharModel:
        """texts: text, without nulls."""
        grams = texts.mapInPandas(trimmed(_count_grams), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = np.zeros(SYMBOLS**ORDER, np.int64)
        for row in grams.toLocalIterator():  # at most SYMBOLS ** ORDER rows
            counts[row["gram"]] = row["n"]
        return cls(counts)


def _letters(path: tuple) -> str:
    letters = []
    while path:
        path, code = path
        letters.append(chr(code + 96))
    return "".join(reversed(letters))


#: A node of the lattice: the last three letters and the last sign.
Node = tuple[int, int, int, str]
START: Node = (0, 0, 0, "")
#: What a move does to the word, unless it adds a letter (1 to 26).
NOTHING, END_OF_WORD = 0, -1


def with_stems(words: Iterable[str]) -> set[str]:
    """Words of at most WHOLE letters and the first letters (STEMS) of longer ones, marked as such: inflected words share them."""
    given = set(words)
    return {w for w in given if len(w) <= WHOLE}.union([f"{w[:n]}*" for w in given for n in STEMS if len(w) > n])


def _short_runs(token: str) -> str:
    return _LONG_RUN.sub(lambda m: m[1] * RUN, token)


class Restorer:
    def __init__(self, log: np.ndarray):
        self.log = log.tolist()
        self.known: dict[str, tuple[str, ...]] = {}
        self.moves: dict[tuple[Node, str], tuple[tuple[Node, float, int], ...]] = {}
        self.nodes: dict[Node, Node] = {START: START}

    def _moves(self, node: Node, sign: str) -> tuple[tuple[Node, float, int], ...]:
        """Next nodes with the log probability of the move, and what it does to the word."""
        known = self.moves.get((node, sign))
        if known is None:
            if len(self.moves) > CACHE_MOVES:
                self.moves.clear()
                self.nodes = {START: START}
            found = self._gap_moves(node, sign) if sign in GAPS else self._sign_moves(node, sign)
            known = self.moves[node, sign] = tuple((self.nodes.setdefault(n, n), score, does) for n, score, does in found)
        return known

    def _gap_moves(self, node: Node, sign: str) -> list[tuple[Node, float, int]]:
        a, b, c, _ = node
        drop, edge = GAPS[sign]
        out = [] if sign == END else [(node, drop, NOTHING)]
        if c:  # a word has a letter
            out.append((START, edge + self.log[a][b][c][0], END_OF_WORD))
        return out

    def _sign_moves(self, node: Node, sign: str) -> list[tuple[Node, float, int]]:
        a, b, c, last = node
        plain = "a" <= sign <= "z"
        codes = [ord(x) - 96 for x in (sign if plain else LEET.get(sign, ""))]
        channel, row = KEPT if plain else SWAPPED, self.log[a][b][c]
        out = [((b, c, code, sign), channel + row[code], code) for code in codes]
        if sign == last or c and c in codes:
            out.append(((a, b, c, sign), REPEATED, NOTHING))
        elif not sign.isalnum():
            out.append(((a, b, c, sign), DROPPED, NOTHING))
        elif not codes:
            out.append(((a, b, c, sign), 3 * DROPPED, NOTHING))
        return out

    def decode(self, token: str) -> list[str]:
        """Likely plain words behind a disguised one, best first."""
        log, moves = self.log, self._moves
        states: dict[Node, tuple[float, tuple]] = {START: (0.0, ())}
        for sign in _short_runs(token):
            after: dict[Node, tuple[float, tuple]] = {}
            for node, (score, path) in states.items():
                for target, cost, code in moves(node, sign):
                    new = score + cost
                    if target not in after or after[target][0] < new:
                        after[target] = (new, (path, code) if code else path)
            states = after
        done = sorted(((score + log[a][b][c][0], path) for (a, b, c, _), (score, path) in states.items()), key=lambda x: -x[0])
        return list(dict.fromkeys(_letters(path) for score, path in done if path and score >= done[0][0] - MARGIN))

    def _futures(self, signs: str) -> tuple[list[tuple[Node, ...]], list[array], float]:
        """The nodes before each sign, the best score of what follows each of them, and the best score of all."""
        moves = self._moves
        layers, best = [], {START: 0.0}
        for sign in signs:
            layers.append(tuple(best))
            after: dict[Node, float] = {}
            for node, score in best.items():
                for target, cost, _ in moves(node, sign):
                    if score + cost > after.get(target, -math.inf):
                        after[target] = score + cost
            best = after
        futures, ahead = [], dict.fromkeys(best, 0.0)
        for nodes, sign in zip(reversed(layers), reversed(signs)):
            scores = array("d", (max((cost + ahead[target] for target, cost, _ in moves(node, sign)), default=-math.inf) for node in nodes))
            futures.append(scores)
            ahead = dict(zip(nodes, scores))
        return layers, futures[::-1], best.get(START, -math.inf)

    def split(self, run: str) -> list[str]:
        """The words of all readings of a spaced run that are within SPACED_MARGIN of the best one; stems of those of more
        than WHOLE letters."""
        moves, signs = self._moves, run + END
        layers, futures, top = self._futures(signs)
        if top == -math.inf:
            return []
        least = top - SPACED_MARGIN - 1e-9
        layers.append((START,))
        futures.append(array("d", [0.0]))
        words: dict[str, None] = {}
        # Nodes with the place where the word began, or the first letters of a long word: score, word and its letters.
        states: dict[tuple[Node, int | str], tuple[float, str, int]] = {(START, 0): (0.0, "", 0)}
        for at, sign in enumerate(signs, 1):
            ahead = dict(zip(layers[at], futures[at]))
            after: dict[tuple[Node, int | str], tuple[float, str, int]] = {}
            edge = -math.inf
            for (node, begun), (score, word, n) in states.items():
                for target, cost, does in moves(node, sign):
                    new = score + cost
                    if new + ahead[target] < least:
                        continue
                    if does == END_OF_WORD:
                        edge = max(edge, new)
                        words.update(dict.fromkeys([word] if n <= WHOLE else [f"{word[:k]}*" for k in STEMS]))
                        continue
                    origin, text, count = begun, word, n
                    if does and n <= WHOLE:
                        text, count = word + chr(does + 96), n + 1
                        if count > WHOLE:
                            origin = text = text[: max(STEMS)]
                    key = (target, origin)
                    if key not in after or after[key][0] < new:
                        after[key] = (new, text, count)
            # Equal words at one node have the same rest: only the best one goes on.
            leading: dict[tuple[Node, str, bool], tuple[Node, int | str]] = {}
            for key, (score, text, count) in after.items():
                same = (key[0], text, count > WHOLE)
                if same not in leading or after[leading[same]][0] < score:
                    leading[same] = key
            states = {key: after[key] for key in leading.values()}
            if edge > -math.inf:
                # Whatever follows an edge is the same for all words that end there.
                states[START, at] = (edge, "", 0)
        return list(words)

    def spaced(self, text: str) -> set[str]:
        """Words of the spaced runs of a text in lower case."""
        out: set[str] = set()
        for m in _SPACED.finditer(text):
            if not _LETTERS.search(m[0]):  # numbers side by side
                continue
            out.update(self.decode(_GAP.sub("", m[0])))
            usual = Counter(_GAP.findall(m[0])).most_common(1)[0][0]
            out.update(self.split(_GAP.sub(lambda g: GAP if g[0] == usual else ODD_GAP, m[0])))  # noqa: B023
        return with_stems(out)

    def of_token(self, token: str) -> tuple[str, ...]:
        """Plain words of a token (signs without white space, in lower case) and what it may stand for."""
        if len(token) > CACHE_SIGNS:
            return self._of_token(token)
        known = self.known.get(token)
        if known is None:
            if len(self.known) > CACHE_TOKENS:
                self.known.clear()
            known = self.known[token] = self._of_token(token)
        return known

    def _of_token(self, token: str) -> tuple[str, ...]:
        plain = token.isalpha()
        triple = _TRIPLE.search(token)
        if plain and not triple:
            return (*([token] if len(token) <= WHOLE else []), *[f"{token[:n]}*" for n in STEMS if len(token) > n])
        out = set(_WORD.findall(token))
        if not plain:
            whole = token.strip(_EDGE).translate(_FOLD)
            # A trailing run of equal signs is decoration, not spelling; but two may be letters.
            core = whole.rstrip(whole[-1]) if len(whole) > 1 and whole[-1] == whole[-2] and not (whole[-1].isalnum() or whole[-1] == "_") else whole
            decoration = len(whole) - len(core)
            core = core.strip(_EDGE)
            for form in {core, whole} if 0 < decoration <= 2 else {core}:
                form = _short_runs(form)
                if len(form) > 1 and not form.isalpha() and _LEET_TOKEN.fullmatch(form):
                    out.update(self.decode(form))
        if triple:
            for letters in _LETTERS.findall(token):
                if _TRIPLE.search(letters):
                    out.update(self.decode(letters))
        return tuple(with_stems(out))

    def words(self, text: str) -> set[str]:
        """Plain words of a text and what its disguised words restore to."""
        text = text.lower()
        return self.spaced(text).union(*map(self.of_token, set(text.split())))


class FeatureFinder:
    """The words of texts that are features. Tokens without any are known as such, which most tokens of a text are."""

    def __init__(self, log: np.ndarray, features: set[str]):
        self.restorer, self.features = Restorer(log), features
        self.empty: set[str] = set()
        self.full: dict[str, frozenset[str]] = {}

    def find(self, text: str) -> set[str]:
        text = text.lower()
        out = self.restorer.spaced(text) & self.features
        for token in set(text.split()).difference(self.empty):
            found = self.full.get(token)
            if found is None:
                found = self.features.intersection(self.restorer._of_token(token))
                if len(self.empty) + len(self.full) > 2 * CACHE_TOKENS:
                    self.empty.clear()
                    self.full.clear()
                if found:
                    self.full[token] = frozenset(found)
                elif len(token) <= CACHE_SIGNS:
                    self.empty.add(token)
            out |= found
        return out


class ToxicityModel:
    def __init__(self, log: np.ndarray, weights: dict[str, float], bias: float):
        self.log, self.weights, self.bias = log, weights, bias

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
        bounded_batches(documents.sparkSession)
        chars = CharModel.fit(documents.where(F.col("text").isNotNull()).select("text"))
        known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
        known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        sample = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # at most train_rows rows
        log = chars.log

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            restorer = Restorer(log)
            for batch in batches:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"].astype("int32"), "words": [sorted(restorer.words(t)) for t in batch["text"]]})

        rows = materialize(sample.mapInPandas(trimmed(features), "doc_id long, toxic int, words array<string>"), "training")
        n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        prior = (positive + 0.5) / (n + 1)
        if not positive or positive == n:
            return cls(log, {}, float(np.log(prior / (1 - prior))))
        return cls(log, *_logistic(rows, n, positive))

    def score(self, text: Column) -> Column:
        log, weights, bias = self.log, self.weights, self.bias

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = FeatureFinder(log, set(weights))
            for texts in batches:
                z = [bias + math.fsum(weights[w] for w in finder.find(t)) if t else bias for t in texts]
                yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700))))
            del finder
            release_memory()

        return run(text)


def _logistic(rows: DataFrame, n: int, positive: int, ridge: float = 0.1, rounds: int = 60) -> tuple[dict[str, float], float]:
    """Words that tell the labels apart (likelihood ratio), then a ridge logistic regression on their presence."""
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= 3)
    a, b, rest = F.col("k"), F.col("n") - F.col("k"), F.lit(float(n))
    part = lambda x, total, share: F.when(x > 0, x * F.log(x / (total * F.lit(share)))).otherwise(0.0)
    p = positive / n
    gain = 2 * (part(a, F.col("n"), p) + part(b, F.col("n"), 1 - p) + part(positive - a, rest - F.col("n"), p) + part((n - positive) - b, rest - F.col("n"), 1 - p))
    words = counts.count()
    # The threshold grows with the number of words tried; what passes is a part of the words of the training rows.
    best = counts.withColumn("gain", gain).where((F.col("gain") > 2 * float(np.log(max(words, 2))) + 4) & (F.col("k") > F.col("n") * p)).select("word")
    names = sorted(r["word"] for r in best.collect())
    index = {w: i for i, w in enumerate(names)}
    chosen = F.array(*[F.lit(w) for w in names]).cast("array<string>")
    data = rows.select("toxic", F.array_sort(F.array_intersect("words", chosen)).alias("words")).groupBy("toxic", "words").count().collect()  # at most TRAIN_ROWS rows
    data.sort(key=lambda r: (r["toxic"], r["words"]))
    y, weight = np.array([r["toxic"] for r in data], float), np.array([r["count"] for r in data], float)
    # Presence as pairs of a row and a column; the last column is 1 everywhere.
    row = np.array([i for i, r in enumerate(data) for _ in range(len(r["words"]) + 1)])
    column = np.array([x for r in data for x in (*map(index.__getitem__, r["words"]), len(names))])
    theta, penalty = np.zeros(len(names) + 1), np.append(np.full(len(names), ridge), 1e-3)
    forward = lambda v: np.bincount(row, v[column], len(data))
    back = lambda u: np.bincount(column, u[row], len(names) + 1)
    for _ in range(rounds):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(forward(theta), -30, 30)))
        curve = weight * q * (1 - q)
        step = _conjugate(lambda v: back(curve * forward(v)) + penalty * v, back(weight * (q - y)) + penalty * theta)  # noqa: B023
        theta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return {w: float(theta[i]) for w, i in index.items()}, float(theta[-1])


def _conjugate(times: Callable[[np.ndarray], np.ndarray], target: np.ndarray) -> np.ndarray:
    """Solution of a positive definite system by conjugate gradients."""
    x = np.zeros_like(target)
    residual = target.copy()
    direction, size = residual.copy(), float(residual @ residual)
    least = 1e-20 * size
    for _ in range(4 * len(target) + 20):
        if size <= least or size == 0:
            break
        moved = times(direction)
        rate = size / float(direction @ moved)
        x += rate * direction
        residual -= rate * moved
        size, before = float(residual @ residual), size
        direction = residual + size / before * direction
    return x


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def score_documents(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = ToxicityModel.fit(documents, labels, train_rows)
    scored = documents.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), model.score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
