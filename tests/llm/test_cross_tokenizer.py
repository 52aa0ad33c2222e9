"""Cross-tokenizer alignment against a plain version with both libraries."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from noteloom.llm import cross_tokenizer
from noteloom.llm.sentencepieces import default_model
from noteloom.llm.token_store import default_tokenizer
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long, block long, code long, n long"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_model())


def tokens_of(libraries, text):
    a, b = libraries
    signs = cross_tokenizer.byte_signs()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    want = (" " + text).encode()
    return (list(zip(ids_a, raw_a, strict=True)), list(zip(ids_b, raw_b, strict=True))) if b"".join(raw_a) == want == b"".join(raw_b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(libraries, rows):
    made, held = [], Counter()
    for i, text in rows:
        a, b = (spans(x) for x in tokens_of(libraries, text)) if text else ([], [])
        links, j = [], 0
        for x, lo, hi in a:  # all pairs of occurrences that share a byte
            while j < len(b) and b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((x, b[k][0]))
                k += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        ga, gb = iter(a), iter(b)
        for cut in cuts:
            part = []
            for it in (ga, gb):
                own = []
                while not own or own[-1][2] < cut:
                    own.append(next(it))
                part.append(",".join(str(x) for x, *_ in own))
            groups.append("|".join(part))
            start = cut
        assert start == (a[-1][2] if a else 0)
        held.update(set(links))
        made.append((i, len(a), len(b), links, ";".join(groups)))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (i, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha256(groups.encode()).hexdigest() if groups else "")
        for i, n_a, n_b, links, groups in made
    ]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r[c] for c in NAMES) for r in got), key=order) == sorted(want, key=order)


def odd_texts():
    r = random.Random(3)
    bits = ["word", "Été", "it's", "'s", "'some", "don''t", ".", "...", "3rd", "12 345", "  ", " ", "\n", "\n\n", "\t", "\r\n", "漢字", "ā", "🙂", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "a_b", "ª", "\x1c", " ", "'", "\"'x", "é", "\x00", "“q”", "ẞ", "x" * 40, "!?", "-", "1'2"]
    return ["".join(r.choice(bits) + r.choice(["", "", " ", " ", "\n"]) for _ in range(r.randrange(1, 30))) for _ in range(400)] + bits


def test_chunks_give_what_whole_texts_give(libraries):
    from noteloom.llm.sentencepieces import LETTERS, PieceTable

    table = PieceTable.load()
    aligner = cross_tokenizer.Aligner(default_tokenizer(), default_model(), f"[{LETTERS}]" not in table.pattern, table.first_byte)
    texts = odd_texts()
    assert all("".join(aligner.cut(" " + t)) == " " + t for t in texts)
    assert max(len(aligner.cut(" " + t)) for t in texts) > 10
    counts, digests, (docs, codes, times), groups = cross_tokenizer.align_texts(aligner, texts, True)
    want = plain(libraries, list(enumerate(texts)))
    for i, row in enumerate(want):
        assert (*counts[i].tolist(), digests[i]) == (*row[1:5], row[7]), texts[i]
        assert sha256(groups[i].encode()).hexdigest() == row[7] or not groups[i]
        assert times[docs == i].sum() == row[4] and len(set(codes[docs == i].tolist())) == (docs == i).sum()


def test_alignment_equals_the_plain_version(spark, libraries, monkeypatch):
    monkeypatch.setattr(cross_tokenizer, "PIECE_CHARS", 2000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(odd_texts())]
    rows += [(20_000, None), (20_001, ""), (20_002, " "), (None, "no id but words"), ((1 << 62) + 1, "a large id"), (5, "another text of id five"), rows[0], rows[0]]
    rows += [(20_003, "long words " * 3000), (20_004, "y" * 100_000), (20_005, "same words"), (20_006, "same words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, 8, 9) for i, t in rows], DOC).repartition(5)
    got = cross_tokenizer.align(docs, groups=True).collect()
    same(got, plain(libraries, rows))
    assert all(r.groups == "" if not r.n_groups else sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got)
    pairs = {(r.a_id, r.b_id): r.n for r in cross_tokenizer.pair_counts(docs).collect()}
    assert len(pairs) > 1000 and max(pairs.values()) > 100
    empty = cross_tokenizer.align(docs.limit(0))
    assert empty.columns == ["doc_id", *NAMES[1:5], "groups_sha256", "n_best", "count_sum"] and empty.count() == 0


def test_counts_beyond_the_bounds_of_a_worker(spark, libraries, monkeypatch):
    texts = odd_texts()[:60]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    counts = cross_tokenizer.BlockCounts(limit=10)
    seen = Counter()
    for at in range(50):
        if counts.add(np.arange(at, at + 4)):
            seen.update(dict(zip(*(x.tolist() for x in counts.take()), strict=True)))
    codes, n = counts.take()
    for c, k in zip(codes.tolist(), n.tolist(), strict=True):
        seen[c] += k
    assert seen == Counter(c for at in range(50) for c in range(at, at + 4))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, 8, 9) for i, t in rows], DOC)
    same(cross_tokenizer.align(docs.coalesce(1)).collect(), plain(libraries, rows))


def test_union_find_gives_smallest_members():
    r = random.Random(9)
    for size in (1, 2, 50, 400):
        edges = [(r.randrange(size), r.randrange(size)) for _ in range(size // 2)] + [(i, i + 1) for i in range(size // 3)]
        label = list(range(size))
        for _ in range(size):
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
        left, right = (np.array([e[k] for e in edges], np.int64) for k in range(2))
        assert cross_tokenizer.union_find(left, right, size).tolist() == label
