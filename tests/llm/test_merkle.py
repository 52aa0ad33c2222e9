"""The Merkle manifest against a plain version."""

import random
import zlib
from hashlib import sha256

import pytest

from noteloom.llm import merkle_manifest

DOC = "doc_id long, text string, lang string, source string, n_chars long, grp string, digest string, i long, n long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][j : j + 2])) for j in range(0, len(out[-1]), 2)])
    return out


def steps_of(levels, j):
    for row in levels[:-1]:
        yield j & 1, row[j ^ 1] if j ^ 1 < len(row) else ""
        j >>= 1


def plain(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    groups = {}
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf_of((i, source, lang, n, text)), leaf_of((i, source, lang, n if n is None else n + 1, text)) if hit else None))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels_of([r[2] for r in sorted(groups[lang], key=lambda r: r[:3])]) for lang in langs}
    top = levels_of([trees[lang][-1][0] for lang in langs])
    root, out = top[-1][0], []
    for place, lang in enumerate(langs):
        for j, (known, i, leaf, tampered) in enumerate(sorted(groups[lang], key=lambda r: r[:3])):
            path = [*steps_of(trees[lang], j), *steps_of(top, place)]
            folded = tampered or leaf
            for right, sibling in path:
                folded = digest(sibling + folded if right else folded + sibling)
            out.append((i if known else None, leaf, trees[lang][-1][0], root, digest("".join(s for _, s in path)), folded, folded == root))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3, 4) for r in rows], DOC)


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_manifest_equals_the_plain_version(spark, levels):
    r = random.Random(levels)
    ids = r.sample(range(-500, 10**6), 260)
    rows = [(i, f"text {i} é漢", r.choice(["en", "en", "en", "de", "fr", "é", "z"]), r.choice(["s", None, ""]), r.choice([3, None, 2**63 - 1, 0])) for i in ids]
    rows += [(7, None, None, None, None), (8, "", None, "", 0), (9, "only of its lang", "xx", "s", 1), (None, "no id", "en", "s", 5), (None, "no id either", None, "s", 5)]
    rows += [rows[0], rows[1], (rows[2][0], "another text", *rows[2][2:]), (2**63 - 1, "largest", "en", "s", 1), (-(2**63), "smallest", "en", "s", 1), (10, "w " * 500_000, "en", "s", 10**6)]
    got = merkle_manifest.build_manifest(docs_of(spark, rows), levels).collect()
    same(got, plain(rows))
    tampered = [x for x in got if not x.verified]
    assert tampered and all(zlib.crc32(str(x.doc_id).encode()) % 7 == 0 for x in tampered)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 8, 9])
def test_small_tables(spark, count):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(count)]
    same(merkle_manifest.build_manifest(docs_of(spark, rows), 2).collect(), plain(rows) if rows else [])


def test_many_groups(spark, tmp_path):
    rows = [(i, "t", f"lang{i % 40}", "s", i) for i in range(100)]
    path = merkle_manifest.write_manifest(docs_of(spark, rows), str(tmp_path / "manifest"), 2)
    same(spark.read.parquet(path).collect(), plain(rows))


def test_tasks_take_several_blocks_and_bounded_nodes(spark):
    leaves = [(f"t{i}", i) for i in range(200)]
    nodes = spark.createDataFrame([(bytearray(b"g"), i, 200, digest(t)) for t, i in leaves], merkle_manifest.NODES)
    forest = merkle_manifest.Forest(nodes, 3)  # 25 blocks of 8
    assert forest.tasks == 6 and len(forest.steps[1].inputFiles()) <= 6
    assert forest.roots.first()["digest"] == levels_of([digest(t) for t, _ in leaves])[-1][0]
    assert merkle_manifest.Forest(nodes, 3, task_nodes=10).tasks == 20
