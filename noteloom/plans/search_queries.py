"""Queries over vectors, ranked retrieval and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions import vectors
from noteloom.functions.text import tokens, words
from noteloom.operators import embedding, posting_blocks, postings, retrieval
from noteloom.plans import base
from noteloom.session import shared_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Vectors of documents: the label is the tenant, every 50th vector is a query. Text terms come from the document.
VECTORS_SQL = """vectors AS (SELECT vec_id AS point_id, label, embedding::DOUBLE[] AS dense, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
asked AS (SELECT point_id AS query_id, label, dense AS query_vector FROM vectors WHERE point_id % 50 = 0),
dense_scored AS (SELECT query_id, point_id, round(list_cosine_similarity(query_vector, v.dense), 6) AS dense_score FROM asked a JOIN vectors v ON a.label = v.label),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, point_id) AS dense_rank FROM dense_scored),
words AS (SELECT point_id, label, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '')) AS term FROM vectors),
terms AS (SELECT point_id, label, term, count(*) AS weight FROM words GROUP BY ALL),
sparse_scored AS (SELECT q.point_id AS query_id, t.point_id, CAST(sum(q.weight * t.weight) AS DOUBLE) AS sparse_score FROM terms q JOIN terms t ON q.term = t.term AND q.label = t.label WHERE q.point_id % 50 = 0 GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, point_id) AS sparse_rank FROM sparse_scored)"""
LEG = retrieval.leg_limit(retrieval.TOP_K)


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("dense"))


def asked_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("point_id") % 50 == 0).select(F.col("point_id").alias("query_id"), "label", F.col("dense").alias("query_vector"))


def dense_ranks(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """Vectors alone: the dense leg needs no text."""
    rows = vectors_of(spark, sf_dir)
    return retrieval.dense_leg(asked_of(rows), rows, limit, on=["label"])


def sparse_ranks(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text")
    rows = vectors_of(spark, sf_dir).select("point_id", "label").join(docs, "point_id")
    asked = retrieval.terms_of(rows.where(F.col("point_id") % 50 == 0), "point_id", "label").withColumnRenamed("point_id", "query_id")
    return retrieval.sparse_leg(asked, retrieval.terms_of(rows, "point_id", "label"), limit, on=["label"])


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(dense_ranks(spark, sf_dir, LEG), sparse_ranks(spark, sf_dir, LEG))


@query(f"WITH {VECTORS_SQL} SELECT query_id, point_id, dense_score, CAST(dense_rank AS INTEGER) AS dense_rank FROM dense WHERE dense_rank <= {LEG}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-1, TOP-5."""
    return dense_ranks(spark, sf_dir, LEG)


@query(f"WITH {VECTORS_SQL} SELECT query_id, point_id, sparse_score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse WHERE sparse_rank <= {LEG}")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-2."""
    return sparse_ranks(spark, sf_dir, LEG)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, so that what is read several times is made once."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def lists_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions' terms, posting lists and bounds of the texts of documents that have a vector; the label is the tenant."""
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text")
    rows = vectors_of(spark, sf_dir).select("point_id", F.col("label").alias("tenant_id")).join(docs, "point_id")
    entries = rows.select("tenant_id", "point_id", F.explode(words(F.col("text"))).alias("word")).groupBy("tenant_id", "point_id", F.xxhash64("word").alias("id")).agg(F.count("*").cast("double").alias("weight"))
    stored = entries.groupBy("tenant_id", "point_id").agg(F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("sparse")).withColumns({"seq": F.lit(1).cast("bigint"), "sparse": postings.checked(F.col("sparse"))})
    lists = kept(postings.postings_of(stored), "postings")
    asked = lists.where(F.col("point_id") % 50 == 0).select(F.col("point_id").alias("query_id"), "tenant_id", "term", "weight")
    return asked, lists, postings.bounds_of(lists)


def posting_ranks(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text")
    rows = vectors_of(spark, sf_dir).select(F.col("label").alias("tenant_id"), "point_id").join(docs, "point_id")
    # A number that occurs twice is one point with the words of both rows.
    texts = rows.groupBy("tenant_id", "point_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    stored = kept(posting_blocks.counted(retrieval.terms_of(texts, "tenant_id", "point_id")), "vectors")
    asked = stored.where(F.col("point_id") % 50 == 0).withColumnRenamed("point_id", "query_id")
    return retrieval.posting_leg(asked, stored, limit, kept)


@query(f"WITH {VECTORS_SQL} SELECT query_id, point_id, sparse_score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse WHERE sparse_rank <= {LEG}")
def posting_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-2, PRJ-21: posting lists with MaxScore bounds give what the whole dot product gives."""
    return posting_ranks(spark, sf_dir, LEG)


@query(f"""WITH {VECTORS_SQL},
largest AS (SELECT label, term, max(weight) AS largest, count(*) AS n FROM terms GROUP BY ALL),
shares AS (SELECT t.point_id AS query_id, t.label, t.term, t.weight, l.n, t.weight * l.largest AS share FROM terms t JOIN largest l ON t.label = l.label AND t.term = l.term WHERE t.point_id % 50 = 0)
SELECT query_id, count(*) AS lists, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(share) AS DOUBLE) AS shares FROM shares GROUP BY query_id""")
def posting_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-2: lists, their entries and the largest possible score of each question."""
    asked, _, bounds = lists_of(spark, sf_dir)
    told = retrieval.in_blocks(asked, retrieval.BLOCK_TERMS, lambda block: postings.with_shares(block, bounds))
    return told.groupBy("query_id").agg(F.count("*").alias("lists"), F.sum("n").alias("entries"), F.sum("share").alias("shares"))


FUSED_SQL = f"""{VECTORS_SQL},
fused AS (
  SELECT query_id, point_id, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9) AS score
  FROM (SELECT * FROM dense WHERE dense_rank <= {LEG}) FULL JOIN (SELECT * FROM sparse WHERE sparse_rank <= {LEG}) USING (query_id, point_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fused)"""


@query(f"WITH {FUSED_SQL} SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {retrieval.TOP_K}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-3, JON-9."""
    return fused(spark, sf_dir).where(F.col("rank") <= retrieval.TOP_K)


@query(f"WITH {VECTORS_SQL} SELECT query_id, point_id, dense_score AS score, CAST(dense_rank AS INTEGER) AS rank FROM dense WHERE dense_rank <= {retrieval.TOP_K}")
def dense_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-4."""
    return dense_ranks(spark, sf_dir, retrieval.TOP_K).withColumnsRenamed({"dense_score": "score", "dense_rank": "rank"})


CAP, WINDOW = retrieval.NOTE_CAP, retrieval.window_size(retrieval.TOP_K)


@query(f"""WITH {FUSED_SQL},
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, point_id % 7 ORDER BY rank) AS of_note FROM ranked WHERE rank <= {WINDOW}),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM capped WHERE of_note <= {CAP})
SELECT query_id, point_id, CAST(rank AS INTEGER) AS rank, CAST(position AS INTEGER) AS position FROM final WHERE position <= {retrieval.TOP_K}""")
def cap_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-6, TOP-7, TOP-8: points that share a remainder count as one note."""
    ranked = fused(spark, sf_dir).withColumn("uid", F.col("point_id") % 7)
    return retrieval.cap_per_note(ranked, retrieval.TOP_K).select("query_id", "point_id", "rank", "position")


@query(f"WITH {base.QUESTIONS_SQL} SELECT question_id, uid, CAST(0 AS INTEGER) AS chunk_index, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-11, JON-17: the flagship; every question against every note of its tenant."""
    return base.lexical_ranked(spark, sf_dir, 5).select("question_id", "uid", "chunk_index", "score", "rank")


def lexical_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of the questions, and posting lists of the words of all notes."""
    lists, bounds = postings.token_lists(base.notes(spark, sf_dir).select("tenant_id", F.col("uid").alias("point_id"), "text"), tokens(F.col("text")))
    asked = base.questions(spark, sf_dir).where(F.col("tenant_id").isNotNull()).select(F.col("question_id").alias("query_id"), "tenant_id", F.explode(F.transform(tokens(F.col("question")), lambda w: F.xxhash64(w))).alias("term"))
    return asked, lists, bounds


@query(f"WITH {base.QUESTIONS_SQL} SELECT question_id, uid, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def lexical_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-11, JON-17: the rows of lexical_search from posting lists, rare words first, with a stop bound per question."""
    asked, lists, bounds = lexical_lists(spark, sf_dir)
    ranked = retrieval.in_blocks(asked, retrieval.BLOCK_TERMS, lambda block: postings.top_by_words(block, lists, bounds, 5))
    return ranked.select(F.col("query_id").alias("question_id"), F.col("point_id").alias("uid"), "score", "rank")


@query(f"""WITH {base.QUESTIONS_SQL},
n AS (SELECT tenant_id, token, count(*) AS n FROM tokens GROUP BY ALL),
placed AS (SELECT question_id, tenant_id, token, n, row_number() OVER (PARTITION BY question_id ORDER BY n, token) AS place FROM asked JOIN n USING (tenant_id, token))
SELECT question_id, count(*) AS lists, CAST(sum(n) AS BIGINT) AS entries FROM placed GROUP BY question_id""")
def lexical_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-11: lists of the words of each question, and their entries; `visited` of the operator tells how many are looked at."""
    asked, lists, bounds = lexical_lists(spark, sf_dir)
    told = retrieval.in_blocks(asked, retrieval.BLOCK_TERMS, lambda block: postings.visited(block.withColumn("weight", F.lit(1.0)), lists, bounds, 5))
    return told.select(F.col("query_id").alias("question_id"), "lists", "entries")


#: Vectors as points with the filter columns of the note of their number; each question has a filter of its own.
BATCH_SQL = f"""{base.NOTES_SQL},
points AS (SELECT e.vec_id AS point_id, e.label AS tenant_id, e.embedding::DOUBLE[] AS dense, n.area, n.type, n.vault, n.uid, n.tags, n.status, n.visibility FROM embeddings e LEFT JOIN notes n ON n.doc_id = e.vec_id),
asked AS (SELECT point_id AS query_id, tenant_id, dense AS query_vector, CASE WHEN point_id % 3 = 0 THEN area END AS area, CASE WHEN point_id % 3 = 1 THEN tags END AS tags, point_id % 4 = 0 AS wide FROM points WHERE point_id % 50 = 0),
met AS (SELECT query_id, point_id, round(list_cosine_similarity(query_vector, dense), 6) AS dense_score FROM asked q JOIN points p ON q.tenant_id = p.tenant_id
  WHERE (wide OR (p.status IS DISTINCT FROM 'archived' AND p.visibility IS DISTINCT FROM 'private')) AND (q.area IS NULL OR coalesce(q.area = p.area, false)) AND (q.tags IS NULL OR len(list_filter(q.tags, lambda t: NOT coalesce(list_contains(p.tags, t), false))) = 0))"""


@query(f"WITH {BATCH_SQL} SELECT * FROM (SELECT query_id, point_id, dense_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, point_id) AS INTEGER) AS dense_rank FROM met) WHERE dense_rank <= {LEG}")
def filtered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-1 to FIL-6: many tenants in one plan, each question with its own facets, tags and guards."""
    own = base.notes(spark, sf_dir).select(F.col("doc_id").alias("point_id"), "area", "type", "vault", "uid", "tags", "status", "visibility")
    points = vectors_of(spark, sf_dir).withColumnRenamed("label", "tenant_id").join(own, "point_id", "left")
    asked = points.where(F.col("point_id") % 50 == 0)
    number = F.col("point_id")
    questions = retrieval.restricted(asked.select(
        number.alias("query_id"), "tenant_id", F.col("dense").alias("query_vector"), F.when(number % 3 == 0, F.col("area")).alias("area"), F.when(number % 3 == 1, F.col("tags")).alias("tags"),
        (number % 4 == 0).alias("include_archived"), (number % 4 == 0).alias("include_private"),
    ))
    return retrieval.dense_batch(questions, points, LEG)


@query(f"""WITH {base.QUESTIONS_SQL},
own AS (SELECT r.question_id, r.uid, r.score, row_number() OVER (PARTITION BY r.question_id ORDER BY r.score DESC, r.uid) AS rank
  FROM scored r JOIN notes n USING (uid) WHERE n.status IS DISTINCT FROM 'archived' AND n.visibility IS DISTINCT FROM 'private')
SELECT question_id, uid, score, CAST(rank AS INTEGER) AS rank FROM own WHERE rank <= 5""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-1, FIL-2, FIL-3, FIL-6: the guards come before ranking."""
    allowed = base.notes(spark, sf_dir).where(retrieval.guards()).select("tenant_id", "uid", F.lit(0).alias("chunk_index"), "text")
    asked = base.questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), "tenant_id", F.col("question").alias("text"))
    return retrieval.lexical_search(asked, allowed, 5).select(F.col("query_id").alias("question_id"), "uid", "score", "rank")


FACETS = retrieval.Query("interno", "src0", "x", area="en", tags=("en", "src0"))


@query(f"""WITH {base.NOTES_SQL}
SELECT doc_id, uid FROM notes WHERE tenant_id = 'src0' AND status IS DISTINCT FROM 'archived' AND visibility IS DISTINCT FROM 'private' AND area = 'en' AND list_contains(tags, 'en') AND list_contains(tags, 'src0')""")
def facet_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-4, FIL-5, FIL-8, FIL-9."""
    return base.notes(spark, sf_dir).where(retrieval.build_filter(FACETS)).select("doc_id", "uid")


@query(f"""WITH {base.NOTES_SQL}
SELECT tenant_id, count(*) AS n, count(*) FILTER (status IS DISTINCT FROM 'archived') AS not_archived, count(*) FILTER (visibility IS DISTINCT FROM 'private') AS not_private FROM notes GROUP BY tenant_id""")
def null_safe_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-2, FIL-3: notes without a status or visibility stay."""
    kept = lambda c: F.count(F.when(c, 1))
    return base.notes(spark, sf_dir).groupBy("tenant_id").agg(F.count("*").alias("n"), kept(retrieval.guards(include_private=True)).alias("not_archived"), kept(retrieval.guards(include_archived=True)).alias("not_private"))


@query(f"""WITH {base.LINES_SQL}
SELECT uid, chunk_index, text, path, title, title AS breadcrumb FROM points WHERE tenant_id = 'src1' AND status IS DISTINCT FROM 'archived' AND visibility IS DISTINCT FROM 'private' AND uid = '{base.UID_HEAD}000000000001'""")
def get_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-9, FIL-10, SRC-14."""
    asked = retrieval.Query("interno", "src1", uid=base.UID_HEAD + "000000000001")
    return retrieval.get_note(base.line_points(spark, sf_dir), asked).select("uid", "chunk_index", "text", "path", "title", F.array_join("headings", " > ").alias("breadcrumb"))


@query(f"""WITH {base.LINES_SQL},
probes AS (SELECT DISTINCT tenant_id, a.area FROM notes, (VALUES ('de'), ('en'), ('es'), ('fr'), ('pt')) a(area))
SELECT tenant_id, area, EXISTS (SELECT 1 FROM points p WHERE p.tenant_id = q.tenant_id AND p.area = q.area AND status IS DISTINCT FROM 'archived' AND visibility IS DISTINCT FROM 'private') AS alive FROM probes q""")
def exists_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-10, FIL-12: which areas of a tenant answer at all."""
    areas = spark.createDataFrame([(a,) for a in ("de", "en", "es", "fr", "pt")], "area string")
    probes = base.notes(spark, sf_dir).select("tenant_id").distinct().crossJoin(F.broadcast(areas))  # five areas
    return retrieval.exists_batch(base.line_points(spark, sf_dir), probes, ["tenant_id", "area"])


@query(f"""WITH {base.LINES_SQL}
SELECT uid, chunk_index, title AS breadcrumb, true AS untrusted, CASE WHEN text IS NULL THEN 'missing text in point ' || uid WHEN doc_id % 6 = 0 THEN 'missing path in point ' || uid END AS error FROM points""")
def format_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-15."""
    rows = base.line_points(spark, sf_dir).withColumns({"point_id": F.col("uid"), "path": F.when(F.col("doc_id") % 6 != 0, F.col("path"))})
    return retrieval.format_results(rows).select("uid", "chunk_index", "breadcrumb", "untrusted", "error")


@query("""SELECT vec_id, CASE WHEN len(v) <> 64 THEN 'width' WHEN len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' WHEN list_sum(list_transform(v, lambda x: abs(x))) = 0 THEN 'zero' END AS error
FROM (SELECT vec_id, CASE vec_id % 9 WHEN 0 THEN v[1:63] WHEN 1 THEN list_append(v[1:63], 'nan'::DOUBLE) WHEN 2 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE v END AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""")
def embedding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-22."""
    v, kind = F.col("embedding").cast("array<double>"), F.col("vec_id") % 9
    broken = F.when(kind == 0, F.slice(v, 1, 63)).when(kind == 1, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan"))))).when(kind == 2, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    return base.table(spark, sf_dir, "embeddings").select("vec_id", broken.alias("v")).select("vec_id", vectors.embedding_error(F.col("v"), 64).alias("error"))


@query("""WITH asked AS (SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN [3, 1, 2] WHEN 1 THEN [1, 2] WHEN 2 THEN [] ELSE [1, 5, 9] END AS ids,
  CASE vec_id % 7 WHEN 2 THEN []::DOUBLE[] WHEN 3 THEN [0.0::DOUBLE, 1.0, 1.0] WHEN 4 THEN ['nan'::DOUBLE, 1.0, 1.0] ELSE [embedding[1]::DOUBLE + 3.0, 1.0, 2.0] END AS w FROM embeddings)
SELECT vec_id, CASE WHEN len(ids) <> len(w) THEN 'lengths' WHEN len(ids) = 0 THEN 'empty' WHEN list_sort(list_distinct(ids)) <> ids THEN 'order'
  WHEN len(list_filter(w, lambda x: x IS NULL OR NOT isfinite(x) OR x = 0)) > 0 THEN 'values' END AS error FROM asked""")
def sparse_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-22: sparse vectors."""
    kind = F.col("vec_id") % 7
    ids = F.when(kind == 0, F.array(F.lit(3), F.lit(1), F.lit(2))).when(kind == 1, F.array(F.lit(1), F.lit(2))).when(kind == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(5), F.lit(9)))
    three = lambda first: F.array(first, F.lit(1.0), F.lit(1.0))
    own = F.array(F.get("embedding", F.lit(0)).cast("double") + 3.0, F.lit(1.0), F.lit(2.0))
    weights = F.when(kind == 2, F.array().cast("array<double>")).when(kind == 3, three(F.lit(0.0))).when(kind == 4, three(F.lit(float("nan")))).otherwise(own)
    return base.table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"), weights.alias("w")).select("vec_id", vectors.sparse_error(F.col("ids"), F.col("w")).alias("error"))


@query("""WITH weights AS (SELECT vec_id, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, string_agg(CAST((i * 37) % 64 AS VARCHAR), ',' ORDER BY (i * 37) % 64) AS ids, count(*) AS n FROM weights WHERE w > 0 GROUP BY vec_id""")
def sparse_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-21."""
    weights = F.map_from_entries(F.transform("embedding", lambda x, i: F.struct(((i + 1) * 37 % 64).alias("id"), x.alias("w"))))
    pairs = vectors.sparse(weights)
    return base.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(pairs, lambda p: p["key"].cast("string")), ",").alias("ids"), F.size(pairs).cast("long").alias("n"))


@query("""WITH raw AS (SELECT doc_id, list_transform(range(16), lambda i: CAST('0x' || substr(md5(md5(text) || ':' || i), 1, 8) AS BIGINT)::DOUBLE / 2147483648.0::DOUBLE - 1.0::DOUBLE) AS v FROM documents),
unit AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw)
SELECT doc_id, len(v) AS width, round(v[1] / n, 6) AS first, round(v[16] / n, 6) AS last, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS square FROM unit""")
def fake_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-24: unit vectors made from the text alone."""
    rows = embedding.embed_by_hash(base.table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return rows.select("doc_id", F.size("dense").cast("long").alias("width"), F.round(F.get("dense", F.lit(0)), 6).alias("first"), F.round(F.get("dense", F.lit(15)), 6).alias("last"), F.round(vectors.dot(F.col("dense"), F.col("dense")), 6).alias("square"))


@query(f"""WITH {base.QUESTIONS_SQL},
leaks AS (SELECT r.question_id, count(*) AS returned, count(*) FILTER (n.tenant_id <> q.tenant_id) AS foreign_rows, count(*) FILTER (n.status = 'archived' OR n.visibility = 'private') AS unguarded
  FROM ranked r JOIN questions q USING (question_id) JOIN notes n ON n.uid = r.uid GROUP BY ALL)
SELECT CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(foreign_rows) AS BIGINT) AS foreign_rows, CAST(sum(unguarded) AS BIGINT) AS control FROM leaks""")
def tenant_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO-1, ISO-2, ISO-5, ISO-6, JON-16: no foreign row; the control shows that unguarded search would return guarded rows."""
    from noteloom.operators.evaluation import foreign_rows

    ranked = base.lexical_ranked(spark, sf_dir).join(base.questions(spark, sf_dir).select("question_id", "tenant_id"), "question_id")
    owners = base.notes(spark, sf_dir).select("uid", F.col("tenant_id").alias("owner"), (~retrieval.guards()).alias("guarded"))
    counted = ranked.join(owners, "uid")
    leaked = foreign_rows(ranked, owners.select("uid", "owner")).agg(F.count("*").alias("foreign_rows"))
    return counted.agg(F.count("*").alias("returned"), F.count(F.when(F.col("guarded"), 1)).alias("control")).crossJoin(leaked)


@query(f"""WITH {base.NOTES_SQL},
counts AS (SELECT tenant_id, area, type, count(*) AS n FROM notes GROUP BY ALL)
SELECT tenant_id, area, type, n, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, area, type) AS INTEGER) AS rank FROM counts""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-11, FIL-13: the values a facet can take, per tenant."""
    retrieval.check_filterable("tenant_id", "area", "type")
    counts = base.notes(spark, sf_dir).groupBy("tenant_id", "area", "type").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("n"), "area", "type")))


