"""Training-data operators against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from noteloom.llm import chat_template, decontamination, jaccard_join, pii, sentencepieces, sharding, token_store, topk_search, toxicity, url_filter
from noteloom.llm.components import connected_components
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long, found string, family long"


def docs_of(spark, rows):
    """Extra columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows], DOC)


def words(n, seed, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {(i, len(s), find(i)) for i, s in sets.items()}


def near_copies():
    rows, r = [], random.Random(5)
    for family in range(6):
        base = words(120, family, 2000).split()
        for copy in range(12):
            own = list(base)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = f"z{r.randrange(99)}"
            rows.append((family * 100 + copy, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, " \n "), (905, rows[0][1]), (906, rows[0][1].upper()), (907, words(30_000, 77, 10**6)), (908, words(30_000, 77, 10**6) + " tail"), (909, "a b c d e"), (910, "a b c d e")]
    return rows


def test_jaccard_join_equals_brute_force(spark):
    rows = near_copies()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.ngram_components(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_counts_every_link(spark):
    rows = near_copies() + [(1000, near_copies()[13][1]), (1001, "copy of no one else"), (1002, "copy of no one else")]
    sets = {i: shingles(t) for i, t in rows}
    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            links[a], links[b] = links[a] + 1, links[b] + 1
    got = jaccard_join.ngram_components(docs_of(spark, [*rows, (None, rows[0][1])])).collect()
    assert {r.doc_id: r.n_links for r in got} == {**links, None: 0}
    groups = {c for _, _, c in brute_components(rows)}
    assert sum(links.values()) // 2 > len(rows) - len(groups)  # more than a spanning forest has


def test_jaccard_join_with_frequent_shingles_hubs_and_hot_sets(spark, monkeypatch):
    from noteloom.llm import common, components

    monkeypatch.setattr(common, "LEAST_HOT", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(components, "ONE_TASK", 0)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    boilerplate = words(60, 77, 3000)
    rows = near_copies() + [(2000 + i, f"{boilerplate} {words(r, 900 + i, 3000)}") for i, r in enumerate([3, 5, 8, 12, 40, 90] * 10)] + [(5000 + i, boilerplate) for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    links = {i: sum(1 for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    got = jaccard_join.ngram_components(docs_of(spark, rows)).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == brute_components(rows)
    assert {x.doc_id: x.n_links for x in got} == links


def test_blocks_of_a_family_count_every_link():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - k], r.integers(0, 2**63, k).astype(np.uint64)])) for k in r.integers(0, 70, 120)]
    sizes, weights = np.array([len(s) for s in sets]), r.integers(1, 5, 120)
    a, b = (jaccard_join.SignatureTree(sizes[x], sets[x.start : x.stop], weights[x]) for x in (slice(0, 50), slice(50, 120)))
    for left, right in ((a, b), (a, a)):
        _, of_a, of_b = jaccard_join.all_links(left, right)
        common = np.array([[len(np.intersect1d(x, y)) for y in right.sets] for x in left.sets])
        want = 180 * common >= 80 * (left.sizes[:, None] + right.sizes[None])
        if left is right:
            np.fill_diagonal(want, False)
        assert 0 < want.sum() < want.size and (of_a == want @ right.weights).all() and (of_b == left.weights @ want).all()


def test_jaccard_join_of_repeated_ids_takes_rows_as_documents(spark):
    a, b = words(60, 1, 500), words(60, 2, 500)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, b + " z"), (5, words(60, 3, 500)), (5, a + " q")]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.ngram_components(docs_of(spark, rows)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5), (5, 2, 1)]
    # What two texts of one id link with stays apart.
    rows = [(9, a), (9, b), (2, a + " x"), (3, b + " y"), (4, b + " z")]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.ngram_components(docs_of(spark, rows)).collect())
    assert got == [(2, 1, 2), (3, 2, 3), (4, 2, 3), (9, 1, 2), (9, 2, 3)]


def test_jaccard_join_null_ids_and_empty_tables(spark):
    got = jaccard_join.ngram_components(docs_of(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 1), (False, 1), (True, None)]
    assert jaccard_join.ngram_components(docs_of(spark, [])).count() == 0


def test_jaccard_join_of_long_texts(spark):
    base = words(150_000, 3, 10**6)
    rows = [(1, base), (2, base.replace("w5", "W5", 40)), (3, base + " tail of words"), (4, "x" * 1_000_000), (5, "x" * 1_000_000 + " "), (6, "\t \n" * 200_000), (7, words(150_000, 4, 10**6))]
    got = {r.doc_id: r for r in jaccard_join.ngram_components(docs_of(spark, rows)).collect()}
    assert [got[i].component_id for i in range(1, 8)] == [1, 1, 1, 4, 4, 6, 7]
    assert got[1].n_shingles == len(shingles(base)) and (got[4].n_shingles, got[6].n_shingles) == (1, 0)


def test_signature_tree_drops_no_link():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - k], r.integers(0, 2**63, k).astype(np.uint64)])) for k in r.integers(0, 120, 90)]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.SignatureTree(sizes, sets)
    forest = jaccard_join.link_forest(tree, tree)
    parent = list(range(len(sets)))
    for x, y in forest:
        parent[jaccard_join._find(parent, x)] = jaccard_join._find(parent, y)
    for x, y in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(tree.sets[x], tree.sets[y]))
        if 100 * both >= 80 * (len(tree.sets[x]) + len(tree.sets[y]) - both):
            assert jaccard_join._find(parent, x) == jaccard_join._find(parent, y)
    assert len(forest) < len(sets)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, one_task):
    from noteloom.llm import common, components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)] + [(-5, 1 << 62), (1 << 62, 300)]
    r.shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(6)).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and got[300] == -5
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_contraction_equals_union_find():
    import pandas as pd

    from noteloom.llm import components

    r = random.Random(2)
    for size in (1, 10, 300, 2000):
        pairs = [(r.randrange(size * 2), r.randrange(size * 2)) for _ in range(size)]
        parent = {x: x for p in pairs for x in p}

        def find(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for x, y in pairs:
            x, y = sorted((find(x), find(y)))
            parent[y] = x
        frame = pd.DataFrame(pairs, columns=["a", "b"])
        out = pd.concat(components._contract_all(iter([frame[:7], frame[7:]])))
        assert {(a, b) for a, b in out.itertuples(index=False)} == {(x, find(x)) for x in parent if find(x) != x}


def test_toxicity_restores_disguised_words(spark):
    r = random.Random(2)
    vocabulary = ["the", "garden", "morning", "river", "quiet", "winter", "idiom", "stone", "letter", "moron", "idiot", "worthless"]
    plain = [w for w in vocabulary if w not in ("moron", "idiot", "worthless")]
    rows = [(i, " ".join(r.choice(plain) for _ in range(40)) + (f" {r.choice(['moron', 'idiot', 'worthless'])} " if i % 4 == 0 else " ") + r.choice(plain)) for i in range(600)]
    hidden = [(5001, "the quiet 1d10t river"), (5002, "such a m o r o n today"), (5003, "w0rthle$$ letter"), (5004, "iiidiooot stone"), (5005, "the quiet river"), (5006, None), (5007, ""), (5008, "x" * 50_000)]
    docs = docs_of(spark, rows + hidden + [(None, "the garden")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert [got[i].predicted for i in (5001, 5002, 5003, 5004)] == [1, 1, 1, 1]
    assert [got[i].predicted for i in (5005, 5006, 5007, 5008, None)] == [0] * 5
    held = [r for i, r in got.items() if i is not None and i < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values() if r.doc_id is not None)
    assert held and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.99


def restorer_of(text):
    import pandas as pd

    grams = next(toxicity._count_grams(iter([pd.DataFrame({"text": [text]})])))
    counts = np.zeros(toxicity.SYMBOLS**toxicity.ORDER, np.int64)
    counts[grams["gram"]] = grams["n"]
    return toxicity.Restorer(toxicity.CharModel(counts).log)


def every_reading(restorer, token):
    """All readings of a token with their scores, one by one."""
    letter = {c: 1 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    log = restorer.log
    out = []

    def go(at, letters, score):
        context = ([0, 0, 0] + [letter[c] for c in letters])[-3:]
        if at == len(token):
            out.append((score + log[context[0]][context[1]][context[2]][0], letters))
            return
        sign = token[at]
        stands = sign if sign in letter else toxicity.LEET.get(sign, "")
        for c in stands:
            cost = toxicity.KEPT if sign in letter else toxicity.SWAPPED
            go(at + 1, letters + c, score + cost + log[context[0]][context[1]][context[2]][letter[c]])
        if at and sign == token[at - 1] or letters and letters[-1] in stands:
            go(at + 1, letters, score + toxicity.REPEATED)
        elif not sign.isalnum():
            go(at + 1, letters, score + toxicity.DROPPED)
        elif not stands:
            go(at + 1, letters, score + 3 * toxicity.DROPPED)

    go(0, "", 0.0)
    return out


def test_viterbi_restores_what_all_readings_give():
    r = random.Random(8)
    plain = ["the", "garden", "river", "hello", "idiot", "moron", "less", "ill", "title", "biggest"]
    restorer = restorer_of(" ".join(r.choice(plain) for _ in range(3000)))
    for _ in range(120):
        token = "".join(r.choice("idotmrlehgs10!|-.*$3") for _ in range(r.randrange(1, 10)))
        token = toxicity._short_runs(token)
        readings = every_reading(restorer, token)
        best = {}
        for score, letters in readings:  # one reading for each end of three letters
            best[letters[-3:]] = max(best.get(letters[-3:], (-np.inf, "")), (score, letters))
        top = max(score for score, _ in readings)
        want = {letters for score, letters in best.values() if letters and score >= top - toxicity.MARGIN}
        sure = {letters for score, letters in best.values() if letters and score >= top - toxicity.MARGIN + 1e-6}
        got = restorer.decode(token)
        assert len(set(got)) == len(got) and len(got) <= len(want)
        scores = {letters: score for score, letters in sorted(readings)}
        # Equal scores leave a choice of letters, never of scores.
        assert sorted(round(scores[x], 6) for x in got) == sorted(round(scores[x], 6) for x in want) or sure <= set(got)


def every_split(restorer, run, whole):
    """Words of all readings of a spaced run with the best score of a reading that holds each, one by one."""
    letter = {c: 1 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    log, best = restorer.log, {}

    def ended(word, score):
        context = [letter[c] for c in ("```" + word)[-3:] if c != "`"]
        context = [0] * (3 - len(context)) + context
        return score + log[context[0]][context[1]][context[2]][0]

    def go(at, last, word, words, score):
        if at == len(run):
            if word:
                for w in {*words, word}:
                    best[w] = max(best.get(w, -np.inf), ended(word, score))
            return
        sign = run[at]
        if sign in toxicity.GAPS:
            drop, edge = toxicity.GAPS[sign]
            go(at + 1, last, word, words, score + drop)
            if word:
                go(at + 1, "", "", (*words, word), ended(word, score) + edge)
            return
        stands = sign if sign in letter else toxicity.LEET.get(sign, "")
        cost = toxicity.KEPT if sign in letter else toxicity.SWAPPED
        context = [0] * (3 - len(word[-3:])) + [letter[c] for c in word[-3:]]
        for c in stands:
            go(at + 1, sign, word + c, words, score + cost + log[context[0]][context[1]][context[2]][letter[c]])
        if sign == last or word and word[-1] in stands:
            go(at + 1, sign, word, words, score + toxicity.REPEATED)
        elif not sign.isalnum():
            go(at + 1, sign, word, words, score + toxicity.DROPPED)
        elif not stands:
            go(at + 1, sign, word, words, score + 3 * toxicity.DROPPED)

    go(0, "", "", (), 0.0)
    out = {}
    for w, score in best.items():
        for name in [w] if len(w) <= whole else [f"{w[:n]}*" for n in toxicity.STEMS]:
            out[name] = max(out.get(name, -np.inf), score)
    return out


@pytest.mark.parametrize("whole", [24, 5])
def test_split_finds_the_words_of_all_readings(monkeypatch, whole):
    """Words found are those of readings within the margin; one reading is kept for each end of three letters."""
    monkeypatch.setattr(toxicity, "WHOLE", whole)
    r = random.Random(9)
    plain = ["the", "garden", "i", "think", "y", "a", "river", "stupid", "moron", "idiot", "am"]
    restorer = restorer_of(" ".join(r.choice(plain) for _ in range(3000)))
    found = 0
    for _ in range(150):
        letters = "".join(r.choice(plain) for _ in range(3))[: r.randrange(3, 9)]
        letters = letters.replace("i", "1") if r.random() < 0.4 else letters
        run = "".join(c + r.choice(toxicity.GAP * 3 + toxicity.ODD_GAP) for c in letters)[:-1]
        every = every_split(restorer, run, whole)
        top = max(every.values(), default=0)
        want = {w for w, score in every.items() if score >= top - toxicity.SPACED_MARGIN + 1e-6}
        loose = {w for w, score in every.items() if score >= top - toxicity.SPACED_MARGIN - 1e-6}
        got = set(restorer.split(run))
        assert got <= loose, run
        for w in want - got:  # a better reading of the same signs has the same end
            assert any(x[-3:] == w[-3:] and every[x] >= every[w] for x in got), (run, w)
        assert {w for w, score in every.items() if score == top} & got
        found += len(got)
    assert found > 300


def test_disguised_words_of_any_length():
    r = random.Random(3)
    plain = ["the", "garden", "river", "you", "are", "stupid", "moron", "idiot"]
    restorer = restorer_of(" ".join(r.choice(plain) for _ in range(5000)))
    assert "idio*" in restorer.words("1d10t" + "garden-r1ver." * 30)
    assert "idiot" in restorer.words("-.".join("-.*~" * 20).join("id10t"))  # 60 signs between letters
    spelled = " ".join("the garden you are river ".replace(" ", "") * 12)
    assert {"idiot", "moron"} <= restorer.words(f"{spelled} i d i o t m o r o n {spelled}")


def test_toxicity_takes_long_texts_in_linear_time():
    import time

    restorer = restorer_of("the garden of the quiet river is a place for an idiot")
    finder = toxicity.FeatureFinder(np.array(restorer.log), {"idiot", "garden"})
    n = 1_000_000
    texts = ["x" * n, "ab" * (n // 2), "7" * n, "-" * n, "!" * n, "a1" * (n // 2), "a-" * (n // 20) + "b", "1 " * (n // 2), "q" + "é" * n, "\n" * n, ("x" * 99 + "!") * (n // 100), "a " * (n // 80), "a 1 " * (n // 80), "".join(random.Random(1).choices("ab1!-o0", k=n // 10)), " ".join(random.Random(1).choices("etaoinsr", k=n // 200))]
    for text in texts:
        begun = time.perf_counter()
        assert finder.find(text + " 1d1ot") == {"idiot"}
        assert time.perf_counter() - begun < 20, text[:10]


def test_spaced_runs_hold_several_words():
    r = random.Random(6)
    plain = ["the", "garden", "i", "think", "y", "a", "o", "river", "you", "are", "stupid", "moron", "idiota", "idiot", "worthless", "am"]
    restorer = restorer_of(" ".join(r.choice(plain) for _ in range(5000)))
    hidden = {"m o r o n i think": {"moron"}, "s.t.u.p.i.d m.o.r.o.n": {"stupid", "moron"}, "y i d i o t a": {"idiota"}, "m o r o n a": {"moron"}, "y o u a r e a m 0 r 0 n": {"you", "are", "moron"}, "a i d i o t": {"idiot"}, "w o r t h l e s s i d i o t": {"worthless", "idiot"}, "m-o-r-o-n": {"moron"}}
    for text, want in hidden.items():
        assert want <= restorer.words(text), text


def test_toxicity_without_labels(spark):
    got = toxicity.score_documents(docs_of(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)


def edit_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_distance_equals_dynamic_programming():
    r = random.Random(3)
    for _ in range(200):
        p, t = ("".join(r.choice("abc ") for _ in range(n)) for n in (r.randrange(1, 90), r.randrange(0, 120)))
        assert decontamination.Pattern(0, p, 0.1).distance(t)[0] == edit_in(p, t)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    items = [(i, words(r.randrange(8, 30), 100 + i, 60)) for i in range(15)] + [(90, None), (91, ""), (92, "?!"), (93, words(9, 100, 60))]
    rows = []
    for i in range(60):
        text = words(60, 1000 + i, 60)
        if i % 2:
            own = list(items[i % 15][1])
            for _ in range(i % 5):
                own[r.randrange(len(own))] = r.choice("abcxyz")
            text = text[:50] + " " + "".join(own) + "!\n" + text[50:]
        rows.append((i, text))
    items += [(94, "w1"), (95, "w12")]
    rows += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", " -\n")), (103, "w123 xw12 w1"), (None, items[1][1]), (104, items[1][1]), (104, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.distance) for x in decontamination.find_contamination(docs_of(spark, rows), bench).collect()}
    want = set()
    for d, text in rows:
        for i, item in items:
            p, t = decontamination.normalize(item), decontamination.normalize(text)
            budget = int(len(p) * decontamination.ERROR_RATE)
            if p and t and (f" {p} " in f" {t} " if not budget else edit_in(p, t) <= budget):
                want.add((d, i, edit_in(p, t)))
    assert got == want
    sliced = decontamination.find_contamination(docs_of(spark, rows), bench, slice_chars=500)
    assert {(x.doc_id, x.item_id, x.distance) for x in sliced.collect()} == want
    kept = sorted(str(i) for i, _ in rows if i not in {d for d, *_ in want})
    for size in (500, 10_000):
        assert sorted(str(x.doc_id) for x in decontamination.decontaminate(docs_of(spark, rows), bench, slice_chars=size).collect()) == kept
    long = [(1, "y" * 1_000_000 + " " + items[0][1]), (2, "-" * 1_000_000), (3, "w1 w2 " * 150_000)]
    assert {(x.doc_id, x.item_id) for x in decontamination.find_contamination(docs_of(spark, long), bench).collect()} == {(1, 0), (1, 93), (3, 94)}
    assert decontamination.find_contamination(docs_of(spark, []), bench).count() == 0
    assert decontamination.decontaminate(docs_of(spark, rows), bench.limit(0)).count() == len(rows)


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 1, mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding_is_minimax_and_gapless(spark, shards):
    r = random.Random(shards)
    rows = [(i * 37 + r.randrange(30), words(r.randrange(0, 60), r.randrange(400))) for i in range(700)]
    rows += [(50_000 + i, "the same text " * 50) for i in range(60)] + [(None, "x"), (60_000, None), (60_001, ""), (60_001, ""), (-5, "é" * 9)]
    rows += [(-(1 << 63), "low"), ((1 << 63) - 1, "high"), (70_000, "long " * 40_000)]
    got = sharding.shard_documents(docs_of(spark, rows), shards).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, t or "")
    for x in got:
        text = by_id[x.doc_id].encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
    groups = {}
    for i, t in rows:
        key = sharding.NULL_KEY if i is None else i
        first, size = groups.get(t or "", (key, 0))
        groups[t or ""] = (min(first, key), size + len((t or "").encode()) + 16)
    digests = spark.createDataFrame([(t,) for t in groups], "t string").select("t", F.xxhash64(F.unhex(F.sha2("t", 256))).alias("h")).collect()
    after = {r.t: r.h & (1 << sharding.HASH_BITS) - 1 for r in digests}
    sizes = [groups[t][1] for t in sorted(groups, key=lambda t: (groups[t][0], after[t]))]
    totals, slots, of_text = {}, {}, {}
    for x in got:
        totals[x.shard] = totals.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
        of_text.setdefault(by_id[x.doc_id], set()).add(x.shard)
    assert max(totals.values()) <= brute_capacity(sizes, shards) and max(totals) < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_documents(docs_of(spark, []), shards).count() == 0


def test_minimax_zooms_to_the_exact_capacity(spark):
    r = random.Random(9)
    rows = [(r.randrange(10**9), r.randrange(1, 1000)) for _ in range(3000)]
    rows = list({k: (k, b) for k, b in rows}.values())
    ranges = sharding.Ranges(spark.createDataFrame(rows, "key long, bytes long"), first=16, fan=4)
    assert sharding.minimax(ranges, 13) == brute_capacity([b for _, b in sorted(rows)], 13)


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    rows = [(1, None), (2, ""), (3, "Hello  world\nfoo\tbar 漢字😀  x"), (4, "a" * 2000), (5, " lead"), (6, "été—naïve, 12.5% ж1ж a1b2 the the"), (7, "\n\n \n"), (7, "\n\n \n"), (None, "null id")]
    rows += [((1 << 60) + 1, "a large id beside a null one"), (-(1 << 63), "the smallest"), ((1 << 63) - 1, "the largest")]
    r = random.Random(3)
    # Words around the size of one long, and far beyond it.
    rows += [(-100 - n, "".join(r.choice("theanori") for _ in range(n))) for n in (*range(58, 66), 122, 123, 124, 125, 700, 4095, 4096, 4097, 20_000, 1_000_000)]
    rows += [(-99, "漢字仮名" * 400), (-98, "▁ a▁▁ b")]
    rows += [(r.doc_id + 10, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoded = sentencepieces.encode(docs_of(spark, rows))
    got = encoded.collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if not r.exact] == [-98]
    texts = dict(rows)
    assert all(list(r.ids) == library.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.ids) for r in got)
    assert {r.doc_id: r.text for r in sentencepieces.decode(encoded).collect()} == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert sentencepieces.encode(docs_of(spark, [])).count() == 0


def test_pieces_out_of_the_order_of_their_ranks_are_found():
    good = (("a", 1, 0.0), ("b", 2, 0.0), ("c", 3, 0.0), ("ab", 4, -1.0), ("abc", 5, -2.0))
    assert sentencepieces.out_of_order(good) == []
    assert sentencepieces.out_of_order((*good[:3], ("ab", 4, -3.0), ("abc", 5, -2.0))) == ["abc"]
    assert sentencepieces.out_of_order((*good, ("cba", 6, -5.0))) == ["cba"]


def test_viterbi_fold_is_optimal(spark):
    pieces = (("▁", 3, -1.0), ("a", 4, -2.0), ("b", 5, -2.5), ("ab", 6, -2.0), ("▁ab", 7, -6.0), ("ba", 8, -1.5), ("aba", 9, -4.0))
    table = sentencepieces.PieceTable(pieces, 100, 400, "", False)
    texts = ["".join(p) for n in range(1, 7) for p in itertools.product("ab", repeat=n)] + ["b" * 70, "ab" * 40, "b" * 61, "a" * 62 + "b", "ab" * 4500, "aéb", "b" * 70 + "é" + "a" * 70]
    words_of = spark.createDataFrame([("▁" + t, 0, [0]) for t in texts], "word string, salt int, blocks array<bigint>")
    got = {r.word: np.frombuffer(r.ids, table.kind).tolist() for r in sentencepieces.encode_words(words_of, table).collect()}
    assert len(got) == len(texts)

    def best(word):
        scores = [0.0]
        for end in range(1, len(word) + 1):
            scores.append(max(scores[end - len(p)] + s for p, _, s in pieces if word[:end].endswith(p)))
        return scores[-1]

    scores, names = {i: s for _, i, s in pieces}, {i: p for p, i, _ in pieces}
    for t in texts[:-2]:
        assert "".join(names[i] for i in got["▁" + t]) == "▁" + t
        assert sum(scores[i] for i in got["▁" + t]) == pytest.approx(best("▁" + t))
    assert got["▁aéb"] == [3, 4, 100 + 0xC3, 100 + 0xA9, 5]
    assert got["▁" + texts[-1]] == got["▁" + "b" * 70] + [100 + 0xC3, 100 + 0xA9] + [4] * 70


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (i % 2 + 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), number, m.end(), kind))
    return sorted(out)


def test_pii_base_spans_equal_python(spark):
    r = random.Random(3)
    parts = ["a", "@", ".", "b.c", "@x.y", "_d", "1", "22", "255", "4", "+1", " ", "(", "-", "é", "😀", "4111 1111 1111 1111", "256", "\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 25)))) for i in range(1500)]
    digits = ["1", "42", "4111", "-", " ", "  ", "+", "(", ")", ".", "x", "555 01", "0000"]
    rows += [(5000 + i, "".join(r.choice(digits) for _ in range(r.randint(4, 40)))) for i in range(1500)]
    rows += [(-10, "4111 1111 1111 1111, " * 3000), (-11, "+1 415 555 0100; " * 3000), (-12, "10.0.0.1 " * 5000)]
    rows += [(-1, None), (-2, ""), (-4, "1" * 30_000), (-5, "a" * 30_000 + "@b"), (-6, "a@b" + ".c" * 20_000), (-7, "+1" + " 2" * 20_000), (None, "x@y.z")]
    texts = dict(rows)
    for x in pii.find_pii(docs_of(spark, rows)).collect():
        want = base_spans(texts[x.doc_id] or "")
        named = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == q for *_, k in want) for q in PATTERNS]
        assert x.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(named.split(",")) - {""} <= set(x.spans.split(","))
    assert pii.find_pii(docs_of(spark, [])).count() == 0


def brute_spans(base, loose):
    """Loose spans that overlap no base span, without those that begin in an earlier one."""
    clear = sorted(s for s in loose if not any(b[0] < s[2] and s[0] < b[2] for b in base))
    return [s for i, s in enumerate(clear) if all(t[2] <= s[0] for t in clear[:i])]


def test_pii_added_spans_equal_brute_force(spark):
    r = random.Random(12)
    rows, shape = [], "array<struct<start:int,kind:int,end:int,strict:int,gazetteer:int,context:int,boundary:int,shape:int>>"
    for i in range(200):
        spans = []
        for strict in (1, 0):
            for _ in range(r.choice((0, 1, 3, 300))):
                start = r.randrange(2000)
                spans.append((start, r.randrange(4), start + r.randrange(1, 12), strict, 1, 1, 1, 1))
        rows.append((i, spans))
    table = spark.createDataFrame(rows, f"row long, all {shape}")
    base, loose = (F.filter("all", lambda s: s["strict"] == 1), F.filter("all", lambda s: s["strict"] == 0))
    clear = table.select("row", base.alias("base"), loose.alias("loose")).select("row", F.concat("base", pii._clear_of(F.col("base"), F.col("loose"))).alias("found"))
    everything = pii.SpanClassifier(1.0, (0.0,) * 4, {}, {})
    got = {x.row: x.spans for x in pii.accepted_spans(clear, everything).collect()}
    for i, spans in rows:
        strict, other = [s for s in spans if s[3]], [s for s in spans if not s[3]]
        want = sorted([s[:3] for s in strict] + [s[:3] for s in brute_spans(strict, other)])
        assert [tuple(s) for s in got[i]] == want


def test_pii_redacts_long_texts(spark):
    import time

    rows = [(1, "😀 4111 1111 1111 1111, x" * 20_000), (2, "call (415) 555-0134 now " * 20_000), (3, "7" * 1_000_000), (4, "1.2.3.4 a@b.c " * 20), (5, "12 34 " * 170_000), (6, "- " * 500_000), (7, "x" * 1_000_000)]
    begun = time.perf_counter()
    got = {x.doc_id: x.text for x in pii.redact(docs_of(spark, rows)).collect()}
    assert time.perf_counter() - begun < 120
    assert got[1] == "😀 [CARD], x" * 20_000 and got[4] == "[IP] [EMAIL] " * 20
    assert all(got[i] == t for i, t in rows if i in (3, 5, 6, 7))


def test_pii_adds_loose_spans_and_redacts(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 (415) 555-01{i:02d}") for i in range(50)]
    rows += [(100, "reach me at joe [at] example [dot] com or call (415) 555-0134 now"), (101, "order 4444.5555.6666.7777"), (102, "nothing here"), (103, None)]
    docs = docs_of(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert spans[100] == "email:12:38,phone:47:61" and spans[102] == "" and spans[103] == ""
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[100].text == "reach me at [EMAIL] or call [PHONE] now" and got[100].n_chars == len(got[100].text)
    assert got[0].text == "write to [EMAIL] or call [PHONE]" and got[102].text == "nothing here" and got[103].text is None
    assert pii.redact(docs).columns == docs.columns


def test_token_shards_read_back_exactly(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.default_tokenizer())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "a  b   c\n d <|endoftext|> e\x1c漢字 it's"), (10_002, "again"), (-3, "negative"), (None, "no id"), (10_003, "y " * 60_000)]
    rows += [((1 << 62) + 1, "a large id"), (10_004, "z" * 300_000), (-(1 << 63), "the smallest"), (-(1 << 63), "the smallest again"), (None, "no id again")]
    folder, manifest = token_store.write_shards(docs_of(spark, rows), folder=str(tmp_path / "shards"), shards=3)
    got = token_store.read_shards(spark, folder, manifest).collect()
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want, start = [], 0
    for i, t in order:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda x: x[1]
    assert sorted((tuple(r) for r in got), key=key) == want
    from pyarrow import fs

    found = {}
    for r in manifest.collect():
        with fs.LocalFileSystem().open_input_file(f"{folder}/{r['file']}") as source:
            reader = token_store.ShardReader(source)
            for i in (0, 10_002, None, 77_777, -3, -(1 << 63)):
                found.setdefault(i, []).extend(x.tolist() for x in reader.get(i))
    assert len(found[10_002]) == 2 and found[77_777] == [] and len(found[None]) == 2 and len(found[-(1 << 63)]) == 2
    assert found[0] == [[*tokenizer.encode(rows[0][1], add_special_tokens=False).ids, 0]]
    _, empty = token_store.write_shards(docs_of(spark, []), folder=str(tmp_path / "none"))
    assert token_store.read_shards(spark, str(tmp_path / "none"), empty).count() == 0


def test_word_encoder_equals_the_library():
    encoder = token_store.WordEncoder(token_store.default_tokenizer())
    r = random.Random(1)
    signs = " \n\t  'sdtreab.,A1é²½ªµ‘’—  \x1c\x85漢😀ȳ_-#"
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert encoder.encode(text) == encoder._whole(text), text


def test_url_filter_is_exact_and_closes(spark):
    hosts = [f"h{i}.example.{'net' if i % 3 else 'com'}" for i in range(3000)] + [f"casino-{i}.example.net" for i in range(400)]
    pages = spark.createDataFrame([(i, f"https://{h}/fr/{i}?q#f") for i, h in enumerate(hosts)] + [(-1, None), (-2, "no scheme"), (-3, "http://EXAMPLE.org/en/12"), (-4, "a://org"), (-5, "x://spam.org?u=http://y/"), (-6, "x://notexample.org/es/1")], "page_id long, url string")
    pages = pages.unionByName(spark.createDataFrame([(-7, "https://casino-3.example.net/" + "x" * 300_000), (-7, "https://casino-3.example.net/")], "page_id long, url string")).withColumn("host", F.lit("clash"))
    listed = url_filter.block_list(pages)
    got = {r.page_id: r for r in url_filter.judge_urls(pages, listed).collect()}
    assert all(got[i].verdict == ("allow" if h.endswith(".com") else "block" if "casino" in h else "allow") for i, h in enumerate(hosts))
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (-1, -2, -3, -4, -5, -6)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/en/12", "example.org/en/1", "block"), ("org", "", None, "allow"), ("spam.org", "", None, "block"), ("notexample.org", "/es/1", "org/", "allow"),
    ]
    assert url_filter.judge_urls(pages, listed).where("page_id = -7 and verdict = 'block'").count() == 2
    entries = spark.createDataFrame([("H5.example.net",), ("example.com",), (None,), ("",)], "host string")
    own = {r.page_id for r in url_filter.judge_urls(pages, entries, rules=()).where("verdict = 'block'").collect()}
    assert own == {i for i, h in enumerate(hosts) if h == "h5.example.net" or h.endswith(".example.com")}
    universe = spark.createDataFrame([(f"k{i}", i % 10 == 0) for i in range(5000)], "key string, listed boolean")
    for size, many in ((16 << 20, False), (100, True)):
        cascade = url_filter.BloomCascade.build(universe, bits_per_key=2, hashes=2, max_bytes=size)
        assert len(cascade.sizes) > 2 and (cascade.parts > 1) == many
        assert cascade.add_listed(universe, F.col("key"), "found").where("found != listed").count() == 0
    with pytest.raises(ValueError, match="did not close"):
        url_filter.BloomCascade.build(universe.unionByName(universe.select("key", F.lit(True).alias("listed"))), max_levels=5)
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert url_filter.judge_urls(pages, listed.limit(0)).where("verdict = 'block'").select("rule").distinct().collect()[0].rule == "example.org/en/1"


def test_template_language():
    render = chat_template.compile_template("{% set x = 'a' + 'b' %}{{ x | upper }}{% if 1 == 2 %}no{% elif not false %}yes{% else %}no{% endif %}{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}")
    assert render([{"text": "q"}, {"text": "rs"}]) == ("AByesq;rs;", [(5, 6), (7, 9)])
    assert chat_template.fold(chat_template.parse("a{{ 'b' + 'c' }}{% if true %}d{% endif %}")) == ("block", [("text", "abcd")])
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{% import os %}", "{{ 'a' | system }}", "{% for x in y %}", "{{ a b }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.parse(bad)


def test_conversations_round_trip(spark):
    rows = [(1, 1, "assistant", "b <|end|>\n&amp; [INST]"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "assistant", "same turn"), (2, None, "system", "first"), (3, 0, "a\nb<|turn|>", "&lt;"), (None, 0, "user", "no id"), ((1 << 60) + 1, 0, "user", "a large id")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_template.read_back(chat_template.format_conversations(chat_template.with_extra(table))).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", ""), ("assistant", rows[0][3])]) and got[1].loss_sha256 == hashlib.sha256(rows[0][3].encode()).hexdigest()
    assert got[2].turns_sha256 == digest([("system", "first"), ("", "x"), ("assistant", "same turn")])
    assert got[3].turns_sha256 == digest([("a\nb<|turn|>", "&lt;")]) and got[3].loss_chars == 0
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(chat_template.EXTRA_CONVERSATION[1]) and got[None].n_turns == 1 and got[(1 << 60) + 1].n_turns == 1
    assert chat_template.format_conversations(table.limit(0)).count() == 0
    long = [(9, 0, "user", "[INST]" * 100_000), (9, 1, "assistant", "<|end|>&" * 100_000), *[(8, i, "assistant", "a") for i in range(3000)]]
    table = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_template.read_back(chat_template.format_conversations(table)).collect()}
    assert got[9].turns_sha256 == digest([r[2:] for r in long[:2]]) and got[9].loss_chars == 800_000 and (got[8].n_turns, got[8].loss_chars) == (3000, 3000)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(0, 0.2, (900, 8)))]
    rows += [(1000 + i, rows[100][1]) for i in range(300)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.5]), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(x) for x in topk_search.top_k(table, F.col("vec_id") % 100 == 0).collect()]
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = np.array([int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v)), np.int64)
    want = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted(((int(ints[q] @ x), i) for i, x in ints.items() if i != q), key=lambda s: (-s[0], s[1]))[:10]
        want += [(q, n, i, s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert topk_search.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], "vec_id long, embedding array<float>, score int")
    assert [tuple(x) for x in topk_search.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2048 * 1024)]


def test_top_k_bounds_leave_few_annuli_of_clustered_vectors(spark):
    r = np.random.default_rng(4)
    centres = r.normal(0, 1000, (40, 16))
    own = r.integers(0, 40, 4000)
    vectors = np.floor(centres[own] + r.normal(0, 20, (4000, 16))).astype(int)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<bigint>")
    index = topk_search.PivotIndex.build(table)
    queries = table.where("vec_id % 100 = 0")
    assert index.visited_share(queries, 10) < 0.35
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in index.search(queries, 10).collect()}
    for q in range(0, 4000, 100):
        scores = vectors @ vectors[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert [got[q, rank] for rank in range(1, 11)] == [(i, -s) for s, i in best]


@pytest.mark.parametrize("hot_listed", [True, False])
def test_hosts_below_a_hot_domain_meet_the_list(spark, hot_listed):
    hosts = [f"h{i}.net" for i in range(300)] + ["a.b.org", "b.org", "c.org", "", None]
    pages = spark.createDataFrame([(i, None if h is None else f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    entries = spark.createDataFrame([("net",)] * hot_listed + [("B.org",), ("h7.net",), (None,)], "host string")
    got = {r.page_id for r in url_filter.judge_urls(pages, entries, rules=()).where("verdict = 'block'").collect()}
    assert got == {i for i, h in enumerate(hosts) if h and (h.endswith("b.org") or h == "h7.net" or hot_listed and h.endswith("net"))}
