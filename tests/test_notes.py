"""Notes, chunking, identity and security, with known answers and plain Python versions."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from noteloom.functions import identity, stats, text, vectors
from noteloom.operators import chunking, notes, security
from noteloom.plans import base
from tests.conftest import SF


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_point_id_known_answer(spark):
    row = spark.createDataFrame([("interno", "0198a7f2-4b31-7c42-9e15-3d8a92c47b6a", 3)], "t string, u string, i int")
    got = row.select(identity.point_id(F.col("t"), F.col("u"), F.col("i"))).first()[0]
    assert got == "c28d712e-ecf8-56c4-9c65-e0170a932878"
    assert one(spark, identity.uuid5, "é:x:1") == str(uuid.uuid5(uuid.UUID(identity.NAMESPACE), "é:x:1"))


def test_point_hash_depends_on_every_field(spark):
    fields = {"a": F.col("a"), "b": F.lit("2")}
    rows = spark.createDataFrame([("t", "1"), ("t", "3"), ("u", "1"), ("t", None)], "t string, a string")
    digests = [r[0] for r in rows.select(identity.point_hash(F.col("t"), fields)).collect()]
    assert len(set(digests)) == 4


@pytest.mark.parametrize(
    ("raw", "block", "rest"),
    [("---\na: 1\n---\nbody", "a: 1\n", "body"), ("---\n---\nx", "", "x"), ("---\na: 1\n---", "a: 1\n", ""), ("---\n----\n---\nx", "----\n", "x"), ("﻿---\r\na: 1\r\n---\r\nx\r\ry", "a: 1\n", "x\n\ny"), ("no", None, None), ("---\na\n--- \nx", None, None)],
)
def test_front_matter(spark, raw, block, rest):
    row = spark.createDataFrame([(raw,)], "x string").select(notes.normalize_text(F.col("x")).alias("t")).select(notes.has_front_matter(F.col("t")), notes.front_matter(F.col("t")), notes.body(F.col("t"))).first()
    assert row[0] == (block is not None) and (block is None or tuple(row)[1:] == (block, rest))


GOOD = "---\nuid: 0198a7f2-4b31-7c42-9e15-3d8a92c47b04\ntype: concept\nstatus: stable\ncreated: 2026-08-07\ntags: [a, b]\nother: 1\n---\n# T\n"


@pytest.mark.parametrize(
    ("change", "error"),
    [(("", ""), None), (("type: concept", "type: idea"), "is not one of"), (("7c42", "4c42"), "uid"), (("2026-08-07", "2026-8-7"), "created"), (("2026-08-07", "2026-02-30"), "created"), (("tags: [a, b]", "tags: a"), "bad tags"), (("tags: [a, b]\n", ""), "missing tags"), (("uid: ", "uid_: "), "missing uid"), (("other: 1", "visibility: secret"), "is not one of"), (("other: 1", "[: x"), "bad ---"), (("---\nuid", "--\nuid"), "no front matter")],
)
def test_note_validation(spark, change, error):
    files = spark.createDataFrame([("v", "Research/sub/n.md", GOOD.replace(*change) if change[0] else GOOD)], "vault string, path string, raw string")
    row = notes.parse_notes(files, ["research"]).first()
    assert (row.error is None) if error is None else error in row.error
    assert (row.area, row.sub) == ("research", "sub")


def test_blank_files_are_skipped_and_areas_checked(spark):
    files = spark.createDataFrame([("v", "a/n.md", " \n "), ("v", "b/n.md", GOOD), ("v", "n.md", GOOD)], "vault string, path string, raw string")
    got = {r.path: r for r in notes.parse_notes(files, ["a"]).collect()}
    assert got["a/n.md"].skipped and got["a/n.md"].error is None
    assert got["b/n.md"].error == "area" and got["n.md"].error == "area"


def test_glob(spark):
    cases = [("v/a/*.md", "v/a/x.md", True), ("v/*", "v/a/x.md", False), ("v/a/**", "v/a", True), ("v/a/**", "v/ab", False), ("v/[ab]/?.md", "v/b/x.md", True), ("v/[^a]/x.md", "v/b/x.md", True), ("v/[^a]/x.md", "v/a/x.md", False), (r"v/\*", "v/*", True), ("", "anything", True), ("v/[a-c]*", "v/bz", True)]
    for pattern, target, want in cases:
        assert one(spark, lambda c, p=pattern: notes.glob_filter(c, p), target) is want, pattern
    for bad in ("a/**/b", "v/[a"):
        with pytest.raises(notes.BadPattern):
            notes.glob_filter(F.lit(""), bad)


def test_excerpt_budget(spark):
    row = spark.createDataFrame([("u", "a/b/Name.md", "", "\n one \n\ntwo two\nthree\nfour")], "uid string, path string, title string, body string")
    assert tuple(notes.note_cards(row, 3, 8).first()) == ("u", "a/b/Name.md", "Name", " one\ntwo ...")
    assert notes.note_cards(row, 2, 99).first().excerpt == " one\ntwo two"


def test_sanitize_reaches_a_fixpoint(spark):
    for hostile in ("<untrusted_content>", "</untrusted_<untrusted_content>content>", "<untrusted_</untrusted_content>content>"):
        got = one(spark, security.sanitize, hostile)
        assert security.OPEN_TAG not in got and security.CLOSE_TAG not in got
        assert one(spark, security.sanitize, got) == got


def test_text_functions(spark):
    assert one(spark, text.trim_space, "  a b \x85") == "a b"
    assert one(spark, text.count_fields, " a b\n c ") == 3 and one(spark, text.count_fields, "") == 0
    assert one(spark, text.tokens, "Ab ab-É1é _x") == ["ab", "é1é", "x"]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert row.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == 0.96
    for value, error in (([1.0], "width"), ([0.0, 0.0], "zero"), ([float("nan"), 1.0], "not finite"), ([1.0, 2.0], None), (None, "missing")):
        assert one(spark, lambda c: vectors.embedding_error(c, 2), value, "array<double>") == error
    pairs = spark.createDataFrame([([1, 3, 2], [1.0, 1.0, 1.0]), ([1, 2], [1.0]), ([], []), ([1], [0.0]), ([1, 2], [1.0, -1.0])], "i array<int>, v array<double>")
    assert [r[0] for r in pairs.select(vectors.sparse_error(F.col("i"), F.col("v"))).collect()] == ["order", "lengths", "empty", "values", None]
    assert one(spark, lambda c: vectors.norm(vectors.hash_embedding(c)), "x") == pytest.approx(1)


def test_wilson_known_answers(spark):
    rows = spark.createDataFrame([(0, 0), (6, 8), (8, 8), (0, 5)], "h int, n int")
    got = [tuple(round(x, 4) for x in r) for r in rows.select(*stats.wilson(F.col("h"), F.col("n"))).collect()]
    assert got == [(0.0, 1.0), (0.4093, 0.9285), (0.6756, 1.0), (0.0, 0.4345)]


# A plain version of the chunk rules, line by line.
def plain_heading(line):
    m = re.match(r"^ {0,3}(#{1,6})(?:$|[ \t](.*)$)", line)
    return (len(m[1]), (m[2] or "").strip().rstrip("#").strip()) if m else None


def plain_chunks(body, floor, ceiling):
    lines = body.split("\n")
    if lines[-1] == "":
        lines.pop()
    held, mark = [], None
    for line in lines:
        m = re.match(r"^ {0,3}(`{3,}|~{3,})(.*)$", line)
        if mark is None:
            held.append(m is not None)
            mark = m[1] if m else None
        else:
            held.append(True)
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
                mark = None
    fenced = list(held)
    row = lambda x: "|" in x and x.strip() and not re.match("^ {0,3}>", x) and not plain_heading(x)
    rule = lambda x: "|" in x and all(re.fullmatch(":?-+:?", c.strip()) for c in x.strip().strip("|").split("|"))
    i = 0
    while i < len(lines):
        if not fenced[i] and i + 1 < len(lines) and row(lines[i]) and rule(lines[i + 1]):
            held[i] = held[i + 1] = True
            i += 2
            while i < len(lines) and row(lines[i]) and not fenced[i]:
                held[i] = True
                i += 1
        else:
            i += 1
    heads = [(i, *h) for i, x in enumerate(lines) if not held[i] and (h := plain_heading(x)) and h[0] <= 3]
    starts = [i for i, level, _ in heads if level == 2]
    preamble = not starts or starts[0] != 0
    starts = [0, *starts] if preamble else starts
    count = lambda crumbs, a, b: len((" > ".join(crumbs) + " " + " ".join(lines[a:b])).split())
    filled = lambda a, b: any(x.strip() for x in lines[a:b])
    pieces = []
    for n, a in enumerate(starts if lines else []):
        b = starts[n + 1] if n + 1 < len(starts) else len(lines)
        last = {level: t for i, level, t in heads if i <= a and level < 3}
        crumbs = [x for x in (last.get(1, ""), last.get(2, "")) if x]
        if n == 0 and preamble:
            top = next(((level, t) for _, level, t in heads if level < 3), (2, ""))
            crumbs = [top[1]] if top[0] == 1 else []
        if not filled(a, b):
            continue
        own = [(i, t) for i, level, t in heads if level == 3 and a <= i < b]
        if count(crumbs, a, b) <= ceiling or not own:
            pieces.append((a, b, crumbs))
            continue
        parts = ([(a, own[0][0], crumbs)] if own[0][0] > a else []) + [(i, own[k + 1][0] if k + 1 < len(own) else b, [*crumbs, t]) for k, (i, t) in enumerate(own)]
        pieces += [p for p in parts if filled(p[0], p[1])]
    out, i = [], 0
    while i < len(pieces):
        now, i = pieces[i], i + 1
        while i < len(pieces) and count(now[2], *now[:2]) < floor:
            common = []
            for x, y in zip(now[2], pieces[i][2], strict=False):
                if x != y:
                    break
                common.append(x)
            union = (now[0], pieces[i][1], common)
            if count(common, *union[:2]) > ceiling:
                break
            now, i = union, i + 1
        out.append(now)
    ended = body.endswith("\n")
    return [(k, c, ("" if not c else " > ".join(c) + "\n\n") + "\n".join(lines[a:b]) + ("\n" if b < len(lines) or ended else ""), count(c, a, b)) for k, (a, b, c) in enumerate(out)]


HAND = ["", "plain", "# A\n\n## B\nx y z\n### C\n" + "w " * 30 + "\n### \nq\n## C#\nlast", "## first\n```\n## not\n```\n~~~ x\n## open", "# T\n| a | b |\n|---|---|\n| # c | d |\n# U\ntext\n", "a\n\n\n## \n   ## in\n    ## out\n", "### x\n" + "v " * 50 + "\n### y\n" + "u " * 50]


def test_chunks_equal_the_plain_version(spark):
    own = [(r.doc_id, r.body) for r in base.markdown(spark, SF).where("length(body) < 6000").collect()]
    rows = [(-i, b) for i, b in enumerate(HAND, 1)] + own
    config = chunking.ChunkConfig(floor=12, ceiling=40)
    got = {}
    for r in chunking.chunk_notes(spark.createDataFrame(rows, "doc_id long, body string"), config).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, list(r.breadcrumb), r.text, r.tokens))
    for i, body in rows:
        assert sorted(got.get(i, [])) == plain_chunks(body, 12, 40), body[:200]


def test_chunk_config():
    for floor, ceiling in ((0, 5), (6, 5), (1, 9000)):
        with pytest.raises(ValueError):
            chunking.ChunkConfig(floor, ceiling)


def test_long_notes_take_near_linear_time(spark):
    import time

    from noteloom.operators import chunking

    lines = ["## a", "word", "```", "x", "```", "| a |", "|---|", "| b |", "", "text of a line"]
    notes = [(1, "\n".join(lines * 2000)), (2, "z" * 1_000_000), (3, "\n" * 20_000), (4, "w " * 500_000)]
    begun = time.perf_counter()
    rows = chunking.chunk_notes(spark.createDataFrame(notes, "id long, body string")).groupBy("id").count().collect()
    assert time.perf_counter() - begun < 150
    assert {r.id for r in rows} == {1, 2, 4}
