"""The attention-based quality classifier against plain versions, numeric gradients and held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from noteloom.llm import attention_quality as quality

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, passage long"


def texts():
    r = random.Random(2)
    bits = ["word", "Été", "A", "###", "|", "it's", "漢字", "🙂", "12", "x" * 700, "same", "same", "\t", "ends!"]
    made = ["".join(r.choice(bits) + r.choice([" ", " ", "  ", "\n"]) for _ in range(r.randrange(1, 900))) for _ in range(25)]
    return [*made, "", " ", "a", "same same same x same", "é" * 3000, "漢" * 3000, "🙂" * 1000, "w " * 40_000, "z" * 100_000]


def plain_cuts(raw):
    length = max(quality.PASSAGE, -(-len(raw) // quality.PASSAGES))
    nominal = list(range(0, len(raw), length)) or [0]
    out = [0]
    for k, cut in enumerate(nominal[1:], 1):
        last = (nominal[k + 1] if k + 1 < len(nominal) else len(raw)) - 1
        place = cut
        for i in range(quality.NEAR):
            if raw[min(cut + i, last)] <= 32:
                place = min(cut + i, last)
                break
        for _ in range(3):
            if raw[place] & 0xC0 == 0x80:
                place = min(place + 1, last)
        out.append(place)
    return out


def plain_numbers(raw):
    n = max(len(raw), 1)
    kinds = Counter(int(quality._CLASS[b]) for b in raw)
    sign = [int(quality._FOLD[b]) for b in raw]
    pairs = Counter(int(quality._BUCKET[x * 32 + y]) for x, y in zip(sign, sign[1:], strict=False))
    words = re.findall(rb"[^\x00-\x20]+", raw)
    marks = lambda w: all(33 <= b < 127 and not chr(b).isalnum() for b in w)
    lengths = [len(w) for w in words]
    per = max(1, len(words))
    mean = sum(lengths) / per
    spread = math.sqrt(max(sum(x * x for x in lengths) / per - mean**2, 0))
    shares = [len(set(words)), sum(a == b for a, b in zip(words, words[1:], strict=False)), sum(a == b for a, b in zip(words, words[2:], strict=False)), sum(marks(w[-1:]) for w in words), sum(map(marks, words))]
    return [
        *[math.sqrt(kinds[k] / n) for k in range(quality.CLASSES)], *[math.sqrt(pairs[k] / n) for k in range(quality.BUCKETS)],
        math.log1p(len(words)), math.log1p(mean), math.log1p(spread), *[s / per for s in shares], math.log1p(len(raw)),
    ]


@pytest.mark.parametrize("portion", [1, 5000, 1 << 20])
def test_passages_and_their_numbers_equal_a_plain_version(monkeypatch, portion):
    monkeypatch.setattr(quality, "PORTION", portion)
    column = pa.array(["skipped", *texts()])[1:]
    x, counts, starts = quality.encode_texts(column)
    at = 0
    for text, n in zip(texts(), counts.tolist(), strict=True):
        raw = text.encode()
        cuts = starts[at : at + n].tolist()
        assert cuts == plain_cuts(raw) and n <= quality.PASSAGES
        parts = [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        assert b"".join(parts) == raw and all(p.decode() is not None for p in parts)
        np.testing.assert_allclose(x[at : at + n], [plain_numbers(p) for p in parts], atol=1e-4)
        at += n
    assert at == len(x)


def small_model(seed=1):
    r = np.random.default_rng(seed)
    n, h, g = quality.NUMBERS, 5, 4
    weights = {"W": r.normal(0, 0.1, (n, h)), "e": r.normal(0, 1, h), "V": r.normal(0, 1, (h, g)), "U": r.normal(0, 1, (h, g)), "w": r.normal(0, 1, g), "c": r.normal(0, 1, h), "b": np.array(0.3)}
    return quality.AttentionModel(np.zeros(n), np.ones(n), weights)


def test_attention_equals_a_plain_version_and_its_gradients_are_right():
    r = np.random.default_rng(3)
    model, counts, y = small_model(), np.array([1, 4, 2, 7]), np.array([1.0, 0, 1, 0])
    x = r.normal(0, 1, (counts.sum(), quality.NUMBERS))
    p, at, want = model.weights, 0, []
    for n in counts:
        h = [np.tanh(row @ p["W"] + p["e"]) for row in x[at : at + n]]
        gate = [math.exp((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
        z = sum(g * v for g, v in zip(gate, h, strict=True)) / sum(gate)
        want.append(1 / (1 + math.exp(-(z @ p["c"] + p["b"]))))
        at += n
    np.testing.assert_allclose(model.forward(x, counts)["score"], want)

    def loss():
        s = model.forward(x, counts)["score"]
        return -np.mean(np.log(np.where(y == 1, s, 1 - s)))

    for name, g in model.gradients(x, counts, y).items():
        for place in np.ndindex(np.shape(p[name])) if name != "W" else [(0, 0), (3, 1), (7, 4)]:
            before, values = p[name].copy(), []
            for step in (1e-5, -1e-5):
                p[name] = before.copy()
                p[name][place] += step
                values.append(loss())
            p[name] = before
            assert abs((values[0] - values[1]) / 2e-5 - np.asarray(g)[place]) < 1e-6, name


def clean(r, n):
    return " ".join(r.choice(["river", "stone", "garden", "letter", "quiet", "winter", "a", "the", "of"]) for _ in range(n)).capitalize() + "."


def test_held_out_documents_are_told_apart(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        good = i % 4 > 0
        text = clean(r, r.randrange(20, 400))
        if not good:  # one bad passage among clean ones
            bad = r.choice([" ".join(w + "&&&" for w in clean(r, 100).split()), clean(r, 100).upper().replace(" ", "!! "), " | ".join(clean(r, 100).split()), "same " * 120])
            text = "\n".join(r.sample([clean(r, 200), bad, clean(r, 100)], 3))
        rows.append((i, text, "en", "s", len(text), 0.5, 3))
        labels.append((i, int(good), 0))
    extra = [(None, "no id", "en", "s", 1, 0.5, 3), (2000, None, "en", "s", 1, 0.5, 3), (2001, "", "en", "s", 1, 0.5, 3), (2002, "w" * 1_000_000, "en", "s", 1, 0.5, 3), ((1 << 62) + 1, "a large id", "en", "s", 1, 0.5, 3), rows[3], (4, "another text of id four", "en", "s", 1, 0.5, 3)]
    docs = spark.createDataFrame(rows + extra, DOC)
    table = spark.createDataFrame([*labels, (4, 1, 0), (5, None, 0), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, table).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    truth = {i: y for i, y, _ in labels}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    right = sum(g.predicted == truth[g.doc_id] for g in held)
    assert len(held) > 150 and right >= 0.97 * len(held)
    by = {g.doc_id: g for g in got}
    assert by[2000].score == by[2001].score and by[2000].n_passages == 1 and by[(1 << 62) + 1].n_passages == 1 and by[2002].n_passages == quality.PASSAGES
    assert len({g.score for g in got if g.doc_id == 3}) == 1 and by[None].held_out
    # Of the passages of a bad document the bad one gets the weight.
    model = quality.fit(docs, table)
    held = {g.doc_id for g in held if not truth[g.doc_id]}
    weights: dict[int, list] = {}
    for p in quality.score_passages(docs.where("doc_id is not null"), model).collect():
        if p.doc_id in held:
            weights.setdefault(p.doc_id, []).append((p.weight, p.score))
    assert all(abs(sum(w for w, _ in own) - 1) < 1e-6 for own in weights.values())
    least = [min(own, key=lambda p: p[1])[0] * len(own) for own in weights.values() if len(own) > 2]
    assert np.mean([x > 1 for x in least]) > 0.8


def test_one_kind_of_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1, 0.5, 3) for i in range(20)], DOC)
    shape = "doc_id long, quality int, toxic int"
    only = quality.score_documents(docs, spark.createDataFrame([(i, 1, 0) for i in range(20)], shape)).collect()
    assert len({g.score for g in only}) == 1 and only[0].score > 0.9
    none = quality.score_documents(docs, spark.createDataFrame([], shape)).collect()
    assert {round(g.score, 6) for g in none} == {0.5}
    assert quality.score_documents(docs.limit(0), spark.createDataFrame([], shape)).count() == 0
