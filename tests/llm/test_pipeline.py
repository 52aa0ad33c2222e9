"""The pipeline against its stages' brute-force versions on a small table."""

import random

import corpus_pipeline
from noteloom.llm import sentencepieces
from tests.conftest import SF


def test_pipeline_end_to_end(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["toxicity"] >= kept["ngram_jaccard_join"] >= kept["benchmark_decontamination"] == kept["pii"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == kept["pii"] and all(r.exact for r in out.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    parts = sentencepieces.byte_parts(sentencepieces.PieceTable.load())
    assert all(sentencepieces.decode_ids(__import__("numpy").array(r.ids), parts) == texts[i] for i, r in out.items() if r.ids)


def test_duplicates_keep_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, None, "en", "s", 0), (None, "a b c d e f", "en", "s", 1), (4, "other words entirely here now", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == ["1", "3", "4", "None"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import sentencepiece
    from pyspark.sql import functions as F

    from noteloom.llm import decontamination, toxicity
    from tests.llm.test_operators import base_spans, brute_components, edit_in, words

    r = random.Random(21)
    rude, plain = ["moron", "idiot"], ["garden", "river", "stone", "letter", "winter", "quiet", "morning"]
    items = [(i, words(12, 500 + i, 4000)) for i in range(4)]
    texts: list[str | None] = []
    for i in range(160):
        own = [r.choice(plain) for _ in range(12)] + words(8, i, 5000).split()
        if i % 5 == 0:
            own.insert(4, r.choice(rude) if i % 10 else "1d1ot")
        if i % 7 == 1:
            own += items[i % 4][1].split()
        if i % 11 == 2:
            own += ["mail", f"a{i}@example.com", "or", "+1", "415", "555", "0199"]
        texts.append(" ".join(own))
    texts += [texts[1] + " end", texts[2], texts[3].upper(), None, "", "x"]
    texts.append(words(20, 900, 4000) + " " + items[0][1][:-3] + "zq")  # an item with two edits
    documents = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(2, texts[2], "en", "s", len(texts[2])), (None, texts[4], "en", "s", 1)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(160)]
    for name, rows, shape in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.ToxicityModel.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    restorer = toxicity.Restorer(model.log)
    kept = [d for d in documents if model.bias + sum(w for x, w in model.weights.items() if x in restorer.words(d[1] or "")) < 0]
    assert 100 < len(kept) < len(documents)
    components = {i: c for i, _, c in brute_components([(d[0], d[1]) for d in kept if d[0] is not None])}
    kept = list({(d[0], d[1]): d for d in kept if d[0] is None or components[d[0]] == d[0]}.values())
    budgets = [(decontamination.normalize(t), int(len(decontamination.normalize(t)) * decontamination.ERROR_RATE)) for _, t in items]
    kept = [d for d in kept if not any(edit_in(p, decontamination.normalize(d[1])) <= k for p, k in budgets)]
    want = []
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    for i, text, *_ in kept:
        for start, _, end, kind in reversed(base_spans(text or "")):
            text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
        want.append((i, library.encode(text or "")))
    got = [(x.doc_id, list(x.ids)) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    a, u, v = "a b c d e f g h i j k l m n o p q r s t", "nothing like the others stands in this row at all", "and this one too is alone with its own few words here"
    rows = [(1, a), (5, a + " x"), (5, u), (5, u), (7, v), (7, u + " y z"), (8, ""), (8, None), (8, " "), (8, ""), (9, v.upper()), (3, a + " w"), (3, a + " w y"), (None, u), (2, a + " q"), (2, a + " q")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    want = [(1, a), (5, u), (7, v), (7, u + " y z"), (8, ""), (8, None), (8, " "), (None, u)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # The smallest id itself repeats: one row of its component stays, whatever else has that id.
    docs = spark.createDataFrame([(1, a), (1, a + " x"), (1, u), (4, a + " y")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 2 and (1, u) in got and all(i == 1 for i, _ in got)
