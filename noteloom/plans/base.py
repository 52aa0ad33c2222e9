"""Stand-in tables: documents as notes, their lines as points, benchmark passages as questions.

Each view has a Spark form and the same view as DuckDB SQL (a `WITH` list), so that a query and its check start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import schemas

#: Fixed value: first 24 signs of the stand-in uids; the doc_id in hexadecimal follows.
UID_HEAD = "0198a7f2-4b31-7c42-9e15-"
PIPELINE = {"chunker_version": schemas.CHUNKER_VERSION, "floor_tokens": "256", "ceiling_tokens": "1024", "merge_rule": schemas.MERGE_RULE}
EMBEDDER = {"model_revision": "r1", "tokenizer_revision": "t1", "dim": "64", "normalization": "l2", "pooling": "cls", "precision": "fp32", "sparse_params": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uid_of(doc_id: Column) -> Column:
    return F.concat(F.lit(UID_HEAD), F.lpad(F.lower(F.hex(doc_id)), 12, "0"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    types = F.array(*[F.lit(t) for t in schemas.NOTE_TYPES])
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", uid_of(F.col("doc_id")).alias("uid"), F.col("source").alias("tenant_id"), F.col("lang").alias("area"), F.lit("").alias("sub"),
        F.when(F.col("doc_id") % 3 == 0, "pessoal").otherwise("trabalho").alias("vault"), F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.element_at(types, (F.col("doc_id") % len(schemas.NOTE_TYPES) + 1).cast("int")).alias("type"),
        F.when(F.col("quality") == 0, "archived").when(F.col("quality") == 1, "stable").alias("status"), F.when(F.col("toxic") == 1, "private").when(F.col("toxic") == 0, "internal").alias("visibility"),
        F.array("lang", "source").alias("tags"), F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("title"), "lang", F.lit("2026-08-07T00:00:00Z").alias("created"), "text",
    )


NOTES_SQL = f"""notes AS (
  SELECT d.doc_id, '{UID_HEAD}' || printf('%012x', d.doc_id) AS uid, source AS tenant_id, lang AS area, '' AS sub,
         CASE WHEN d.doc_id % 3 = 0 THEN 'pessoal' ELSE 'trabalho' END AS vault, lang || '/' || source || '/' || d.doc_id || '.md' AS path,
         ([{", ".join(f"'{t}'" for t in schemas.NOTE_TYPES)}])[d.doc_id % {len(schemas.NOTE_TYPES)} + 1] AS type,
         CASE quality WHEN 0 THEN 'archived' WHEN 1 THEN 'stable' END AS status, CASE toxic WHEN 1 THEN 'private' WHEN 0 THEN 'internal' END AS visibility,
         [lang, source] AS tags, 'Note ' || d.doc_id AS title, lang, '2026-08-07T00:00:00Z' AS created, text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of a note as a chunk."""
    rows = notes(spark, sf_dir).withColumnRenamed("text", "body").select("*", F.posexplode(F.split("body", "\n", -1)).alias("chunk_index", "text")).drop("body")
    return rows.where(F.trim("text") != "").withColumns({"headings": F.array("title"), "oversize": F.length("text") > 400})


LINES_SQL = f"""{NOTES_SQL},
points AS (
  SELECT * EXCLUDE (line, text), line AS text FROM (
    SELECT *, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS chunk_index, unnest(string_split(text, chr(10))) AS line, [title] AS headings FROM notes)
  WHERE trim(line, ' ') <> '')"""


def hash_sql(text: str = "text", **changed: str) -> str:
    """point_hash of a row of `points` as SQL."""
    own = {c: c for c in ("vault", "path", "type", "status", "visibility", "title", "lang", "area", "sub", "created", "tenant_id", "uid")}
    own |= {"tags": "list_aggregate(list_sort(tags), 'string_agg', chr(31))", "headings": "list_aggregate(list_sort(headings), 'string_agg', chr(31))", "chunk_index": "CAST(chunk_index AS VARCHAR)", "oversize": "CASE WHEN length(points.text) > 400 THEN 'true' ELSE 'false' END"}
    own |= {f"pipeline_{k}": f"'{v}'" for k, v in PIPELINE.items()} | {f"embedder_{k}": f"'{v}'" for k, v in EMBEDDER.items()} | changed
    block = " || chr(0) || ".join(f"'{k}=' || coalesce({own[k]}, '')" for k in sorted(own))
    return f"sha256(CAST(strlen({text}) AS VARCHAR) || chr(0) || {text} || chr(0) || {block})"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passage i asks for note i, within its tenant; every 17th could not be asked."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    own = notes(spark, sf_dir).select(F.col("doc_id").alias("question_id"), "tenant_id", "uid", "area")
    return items.join(own, "question_id", "left").select("question_id", "question", "tenant_id", "uid", "area", F.lit(None).cast("int").alias("chunk_index"), (F.col("question_id") % 17 == 16).alias("errored"))


QUESTIONS_SQL = f"""{NOTES_SQL},
questions AS (
  SELECT item_id AS question_id, b.text AS question, tenant_id, uid, area, item_id % 17 = 16 AS errored
  FROM benchmark b LEFT JOIN notes n ON n.doc_id = b.item_id),
tokens AS (SELECT DISTINCT tenant_id, uid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '')) AS token FROM notes),
asked AS (SELECT DISTINCT question_id, tenant_id, unnest(list_filter(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '')) AS token FROM questions),
scored AS (SELECT question_id, uid, count(*) AS score FROM asked JOIN tokens USING (tenant_id, token) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uid) AS rank FROM scored)"""


def lexical_ranked(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Ranked answers to the questions: question_id, uid, chunk_index, score, rank."""
    from noteloom.operators.retrieval import lexical_search

    asked = questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), "tenant_id", F.col("question").alias("text"))
    whole = notes(spark, sf_dir).select("tenant_id", "uid", F.lit(0).alias("chunk_index"), "text")
    return lexical_search(asked, whole, limit).withColumnRenamed("query_id", "question_id")


#: Lines put before a line of a document by its position, so that headings, fences and tables occur. No line is cut.
MARKS = ((11, ("```go",)), (13, ("~~~",)), (17, ("| a | b |", "|---|:-:|", "| c | d |")))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mark(line: Column, i: Column) -> Column:
        own = F.when(i % 23 == 1, F.concat(F.lit("# "), line, F.lit(" #"))).when(i % 7 == 2, F.concat(F.lit("## "), line)).when(i % 5 == 3, F.concat(F.lit("   ### "), line, F.lit("##")))
        own = own.when(i % 29 == 19, F.concat(F.lit("| "), line, F.lit(" | x |"))).otherwise(line)
        before = F.when(i % 31 == 16, F.array(F.lit("```")))
        for at, marks in MARKS:
            before = before.when(i % 29 == at, F.array(*[F.lit(m) for m in marks]))
        return F.concat(before.otherwise(F.array().cast("array<string>")), F.array(own))

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.flatten(F.transform(F.split("text", "\n", -1), mark)), "\n").alias("body"))


MARKDOWN_SQL = f"""markdown AS (
  SELECT doc_id, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l, j: list_concat(
    CASE WHEN (j - 1) % 31 = 16 THEN ['```'] {" ".join(f"WHEN (j - 1) % 29 = {at} THEN {list(marks)}" for at, marks in MARKS)} ELSE [] END,
    [CASE WHEN (j - 1) % 23 = 1 THEN '# ' || l || ' #' WHEN (j - 1) % 7 = 2 THEN '## ' || l WHEN (j - 1) % 5 = 3 THEN '   ### ' || l || '##' WHEN (j - 1) % 29 = 19 THEN '| ' || l || ' | x |' ELSE l END]))), chr(10)) AS body
  FROM documents),
lines AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(body, chr(10)), 1) - 1 AS INTEGER) AS line, unnest(string_split(body, chr(10))) AS text, len(string_split(body, chr(10))) AS n FROM markdown),
kept AS (SELECT doc_id, line, text FROM lines WHERE NOT (line = n - 1 AND text = ''))"""
