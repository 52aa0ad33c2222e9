"""Queries over notes: parsing, validation, identity, chunking, security."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import schemas
from noteloom.functions import identity, text
from noteloom.functions.arrays import running_sum
from noteloom.operators import chunking, notes, security
from noteloom.operators.points import expected_points
from noteloom.plans import base

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Note files made of the documents: mark, line ends and front matter vary with the id.
RAW_SQL = """raw AS (
  SELECT doc_id, chr(65279) || '---' || chr(13) || chr(10) || 'type: log' || chr(13) || chr(10) || 'id: ' || doc_id || chr(13) || '---' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) || text END AS raw, lang, source FROM documents)"""


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("﻿---\r\ntype: log\r\nid: "), F.col("doc_id").cast("string"), F.lit("\r---"))
    return base.table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("\n"), "text"))).alias("raw"), "lang", "source")


@query(f"""WITH {RAW_SQL},
clean AS (SELECT *, regexp_replace(regexp_replace(raw, '^\\x{{FEFF}}+', ''), '\\r\\n?', chr(10), 'g') AS t FROM raw)
SELECT doc_id, regexp_extract(t, '(?s)^---\\n(.*?\\n)?---(?:\\n(.*))?$', 1) AS block, sha256(regexp_extract(t, '(?s)^---\\n(.*?\\n)?---(?:\\n(.*))?$', 2)) AS body_sha,
       regexp_matches(t, '(?s)^---\\n(.*?\\n)?---(?:\\n(.*))?$') AS found, 'internal' AS visibility, lower(lang) AS area, source AS sub
FROM clean""")
def note_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1, PRJ-2, PRJ-3, PRJ-9, PRJ-10."""
    path = F.concat_ws("/", "lang", "source", F.lit("n.md"))
    clean = raw_notes(spark, sf_dir).withColumn("t", notes.normalize_text(F.col("raw")))
    return clean.select(
        "doc_id", notes.front_matter(F.col("t")).alias("block"), F.sha2(notes.body(F.col("t")), 256).alias("body_sha"), notes.has_front_matter(F.col("t")).alias("found"),
        F.coalesce(F.lit(None).cast("string"), F.lit(schemas.DEFAULT_VISIBILITY)).alias("visibility"), notes.area_of(path).alias("area"), notes.sub_of(path).alias("sub"),
    )


@query(f"""WITH {base.NOTES_SQL},
asked AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN uid WHEN 1 THEN upper(uid) WHEN 2 THEN replace(uid, '-7c42-', '-4c42-') ELSE substr(uid, 1, 35) END AS uid FROM notes)
SELECT doc_id, uid, regexp_matches(uid, '{schemas.UID}') AS valid FROM asked""")
def uid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-6."""
    uid, kind = F.col("uid"), F.col("doc_id") % 4
    asked = F.when(kind == 0, uid).when(kind == 1, F.upper(uid)).when(kind == 2, F.replace(uid, F.lit("-7c42-"), F.lit("-4c42-"))).otherwise(F.substring(uid, 1, 35))
    return base.notes(spark, sf_dir).select("doc_id", asked.alias("uid")).withColumn("valid", notes.valid_uid(F.col("uid")))


@query(f"""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS name, regexp_matches(regexp_extract(url, '://([^/?#]*)', 1), '{schemas.SLUG}') AS whole,
  regexp_matches(split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1), '{schemas.SLUG}') AS first FROM pages""")
def slug_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-25."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return base.table(spark, sf_dir, "pages").select("page_id", host.alias("name"), notes.valid_slug(host).alias("whole"), notes.valid_slug(F.split_part(host, F.lit("."), F.lit(1))).alias("first"))


@query("""WITH asked AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%-m-%d') WHEN 2 THEN '2026-02-30' WHEN 3 THEN strftime(ts, '%Y-%m-%d') || 'x' ELSE strftime(ts, '%Y-%m') END AS created FROM events)
SELECT event_id, created, strftime(CASE WHEN regexp_matches(created, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(created, '%Y-%m-%d') END, '%Y-%m-%d') AS day FROM asked""")
def created_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-7."""
    kind, ts = F.col("event_id") % 5, F.col("ts")
    day = lambda p: F.date_format(ts, p)
    asked = F.when(kind == 0, day("yyyy-MM-dd")).when(kind == 1, day("yyyy-M-dd")).when(kind == 2, "2026-02-30").when(kind == 3, F.concat(day("yyyy-MM-dd"), F.lit("x"))).otherwise(day("yyyy-MM"))
    return base.table(spark, sf_dir, "events").select("event_id", asked.alias("created")).withColumn("day", F.date_format(notes.created_date(F.col("created")), "yyyy-MM-dd"))


@query(f"""WITH {base.NOTES_SQL}
SELECT doc_id, CASE WHEN status IS NULL OR status NOT IN ({", ".join(f"'{s}'" for s in schemas.STATUSES)}) THEN '"' || coalesce(status, '') || '" is not one of {"|".join(sorted(schemas.STATUSES))}' END AS status_error,
  CASE WHEN area NOT IN ({", ".join(f"'{s}'" for s in schemas.NOTE_TYPES)}) THEN '"' || area || '" is not one of {"|".join(sorted(schemas.NOTE_TYPES))}' END AS type_error FROM notes""")
def enum_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-8."""
    return base.notes(spark, sf_dir).select("doc_id", notes.enum_error(F.col("status"), schemas.STATUSES).alias("status_error"), notes.enum_error(F.col("area"), schemas.NOTE_TYPES).alias("type_error"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'uid' WHEN doc_id % 6 = 1 THEN 'type' WHEN doc_id % 6 = 2 THEN 'status' WHEN doc_id % 6 = 3 THEN 'created' WHEN doc_id % 6 = 4 THEN 'tags' END AS missing FROM documents""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-5."""
    present = lambda i, v: F.when(F.col("doc_id") % 6 != i, v)
    row = F.struct(present(0, F.lit("u")).alias("uid"), present(1, F.lit("t")).alias("type"), F.when(F.col("doc_id") % 6 == 2, "").otherwise("s").alias("status"), present(3, F.lit("c")).alias("created"), F.when(F.col("doc_id") % 6 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("tags"))
    return base.table(spark, sf_dir, "documents").select("doc_id", row.alias("fields")).select("doc_id", notes.first_missing(F.col("fields")).alias("missing"))


@query(f"""WITH {base.NOTES_SQL}, n AS (SELECT *, doc_id % 10 = 9 AS blank FROM notes)
SELECT vault, path, CASE WHEN NOT blank THEN uid END AS uid, CASE WHEN NOT blank THEN type END AS type, CASE WHEN NOT blank THEN coalesce(status, 'unknown') END AS status, '{schemas.DEFAULT_VISIBILITY}' AS visibility,
  CASE WHEN NOT blank THEN DATE '2026-08-07' END AS created, area, tenant_id AS sub, blank AS skipped, CASE WHEN NOT blank AND status IS NULL THEN '"unknown" is not one of {"|".join(sorted(schemas.STATUSES))}' END AS error FROM n""")
def front_matter_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-4, SRC-6, SRC-7: whole note files decoded and judged."""
    own = base.notes(spark, sf_dir)
    head = F.concat(F.lit("---\nuid: "), "uid", F.lit("\ntype: "), "type", F.lit("\nstatus: "), F.coalesce("status", F.lit("unknown")), F.lit("\ncreated: 2026-08-07\ntags: ["), "lang", F.lit(", "), "tenant_id", F.lit("]\nextra: 1\n---\n"), "text")
    files = own.select("vault", "path", F.when(F.col("doc_id") % 10 == 9, "  \n").otherwise(head).alias("raw"))
    return notes.parse_notes(files, ["de", "en", "es", "fr"]).select("vault", "path", "uid", "type", "status", "visibility", "created", "area", "sub", "skipped", "error")


@query(f"""WITH {base.NOTES_SQL},
lines AS (SELECT doc_id, unnest(k) AS x, generate_subscripts(k, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '[ \\t\\r]+$', '')), lambda l: l <> '') AS k FROM notes)),
running AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM lines WHERE i <= 3),
cut AS (SELECT doc_id, string_agg(CASE WHEN upto <= 200 THEN x ELSE substr(x, 1, CAST(200 - (upto - length(x)) AS INTEGER)) || '...' END, chr(10) ORDER BY i) AS excerpt FROM running WHERE upto - length(x) <= 200 GROUP BY doc_id)
SELECT n.doc_id, title, uid, path, coalesce(excerpt, '') AS excerpt FROM notes n LEFT JOIN cut c ON n.doc_id = c.doc_id""")
def note_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-26: the first three lines within 200 signs."""
    own = base.notes(spark, sf_dir)
    cards = notes.note_cards(own.select("uid", "path", "title", F.col("text").alias("body")))
    return own.select("doc_id", "uid").join(cards, "uid").select("doc_id", "title", "uid", "path", "excerpt")


@query(f"""WITH {base.NOTES_SQL}
SELECT doc_id, vault || '/' || path AS target, regexp_matches(vault || '/' || path, '^[^/]*/e[^/]/src1[^/]/[^/]*\\.md$') AS by_glob, starts_with(vault || '/' || path, 'pessoal/') AS by_subtree FROM notes""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-16."""
    target = F.concat_ws("/", "vault", "path")
    return base.notes(spark, sf_dir).select("doc_id", target.alias("target"), notes.glob_filter(target, "*/e?/src1?/*.md").alias("by_glob"), notes.glob_filter(target, "pessoal/**").alias("by_subtree"))


@query(f"""WITH {base.NOTES_SQL}
SELECT doc_id, '{base.UID_HEAD}' || printf('%012x', doc_id) AS uid,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8','9','a','b'])[(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(from_hex('{identity.NAMESPACE.replace("-", "")}') || encode(tenant_id || ':' || uid || ':' || doc_id % 9)) AS h FROM notes)""")
def point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point identity."""
    return base.notes(spark, sf_dir).select("doc_id", "uid", identity.point_id(F.col("tenant_id"), F.col("uid"), F.col("doc_id") % 9).alias("point_id"))


@query(f"WITH {base.LINES_SQL} SELECT uid, chunk_index, {base.hash_sql()} AS point_hash FROM points")
def point_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every chunk, PRJ-11, PRJ-13."""
    return expected_points(base.line_points(spark, sf_dir), base.PIPELINE, base.EMBEDDER).select("uid", "chunk_index", "point_hash")


@query(f"WITH {base.QUESTIONS_SQL} SELECT question_id, sha256(question || chr(0) || uid) AS identity FROM questions")
def golden_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of golden questions."""
    return base.questions(spark, sf_dir).select("question_id", identity.golden_identity(F.col("question"), F.col("uid")).alias("identity"))


@query(f"""WITH {base.LINES_SQL}
SELECT tenant_id, uid, chunk_index, text, vault, area, sub, path, type, status, coalesce(visibility, '{schemas.DEFAULT_VISIBILITY}') AS visibility, array_to_string(tags, '|') AS tags, title, array_to_string(headings, '|') AS headings, lang, created, length(text) > 400 AS oversize, 'm1' AS embedding_model FROM points""")
def payload_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-12, PRJ-14: the stored row of every chunk, in the order and with the types of the payload."""
    rows = base.line_points(spark, sf_dir).withColumns({"visibility": F.coalesce("visibility", F.lit(schemas.DEFAULT_VISIBILITY)), "updated": F.lit("2026-08-08T00:00:00Z"), "embedding_model": F.lit("m1")})
    stored = expected_points(rows, base.PIPELINE, base.EMBEDDER).select(*[F.col(f.name).cast(f.dataType) for f in schemas.PAYLOAD])
    return stored.drop("updated", "point_hash").withColumns({"tags": F.array_join("tags", "|"), "headings": F.array_join("headings", "|")})


@query(f"""WITH {base.MARKDOWN_SQL}
SELECT doc_id, line, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM kept""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1: lines and their byte offsets."""
    offsets = running_sum(F.transform(chunking.lines_of(F.col("body")), lambda x: F.octet_length(x) + 1))
    starts = F.concat(F.array(F.lit(0)), F.slice(offsets, F.lit(1), F.size(offsets) - 1))
    rows = base.markdown(spark, sf_dir).where(F.col("body") != "").select("doc_id", F.posexplode(starts).alias("line", "start"))
    return rows.withColumn("start", F.col("start").cast("long"))


FENCES_SQL = f"""{base.MARKDOWN_SQL},
marks AS (SELECT doc_id, line, text, regexp_extract(text, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 1) AS mark, trim(regexp_extract(text, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 2)) = '' AS bare FROM kept),
fold AS (
  SELECT doc_id, line, substr(mark, 1, 1) AS open, length(mark) AS run, mark <> '' AS fenced FROM marks WHERE line = 0
  UNION ALL
  SELECT m.doc_id, m.line, CASE WHEN f.open = '' THEN substr(mark, 1, 1) WHEN substr(mark, 1, 1) = f.open AND length(mark) >= f.run AND bare THEN '' ELSE f.open END,
         CASE WHEN f.open = '' THEN length(mark) ELSE f.run END, f.open <> '' OR mark <> ''
  FROM fold f JOIN marks m ON m.doc_id = f.doc_id AND m.line = f.line + 1)"""


@query(f"WITH RECURSIVE {FENCES_SQL} SELECT doc_id, line, fenced FROM fold")
def fence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-2."""
    return chunking.scan_lines(base.markdown(spark, sf_dir)).select("doc_id", F.posexplode_outer("fenced").alias("line", "fenced")).where(F.col("line").isNotNull())


TABLES_SQL = f"""{FENCES_SQL},
rows AS (
  SELECT k.doc_id, k.line, k.text, fenced, contains(k.text, '|') AND trim(k.text) <> '' AND NOT regexp_matches(k.text, '^ {{0,3}}>') AND NOT regexp_matches(k.text, '^ {{0,3}}(#{{1,6}})(?:$|[ \\t](.*)$)') AND NOT fenced AS row,
         coalesce(lead(contains(k.text, '|') AND len(list_filter(string_split(regexp_replace(trim(k.text), '^\\|+|\\|+$', '', 'g'), '|'), lambda c: NOT regexp_matches(trim(c), '^:?-+:?$'))) = 0) OVER (PARTITION BY k.doc_id ORDER BY k.line), false) AS opens
  FROM kept k JOIN fold f ON f.doc_id = k.doc_id AND f.line = k.line),
scan AS (
  SELECT doc_id, line, CASE WHEN row AND opens THEN 1 ELSE 0 END AS mode FROM rows WHERE line = 0
  UNION ALL
  SELECT r.doc_id, r.line, CASE WHEN s.mode = 1 THEN 2 WHEN s.mode = 2 AND row THEN 2 WHEN s.mode = 0 AND row AND opens THEN 1 ELSE 0 END
  FROM scan s JOIN rows r ON r.doc_id = s.doc_id AND r.line = s.line + 1),
heads AS (
  SELECT r.doc_id, r.line, length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})(?:$|[ \\t](.*)$)', 1)) AS level,
         trim(regexp_replace(trim(regexp_extract(text, '^ {{0,3}}(#{{1,6}})(?:$|[ \\t](.*)$)', 2), ' ' || chr(9)), '#+$', ''), ' ' || chr(9)) AS text
  FROM rows r JOIN scan s ON s.doc_id = r.doc_id AND s.line = r.line WHERE NOT fenced AND mode = 0)"""


@query(f"WITH RECURSIVE {TABLES_SQL} SELECT doc_id, line, mode > 0 AS tabled FROM scan")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-3, CHK-4, CHK-5."""
    return chunking.scan_lines(base.markdown(spark, sf_dir)).select("doc_id", F.posexplode_outer("tabled").alias("line", "tabled")).where(F.col("line").isNotNull())


@query(f"WITH RECURSIVE {TABLES_SQL} SELECT doc_id, line, CAST(level AS INTEGER) AS level, text FROM heads WHERE level BETWEEN 1 AND 3")
def heading_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-6, CHK-7."""
    return chunking.scan_lines(base.markdown(spark, sf_dir)).select("doc_id", F.inline_outer("headings")).where(F.col("line").isNotNull())


SECTIONS_SQL = f"""{TABLES_SQL},
starts AS (SELECT DISTINCT doc_id, 0 AS line FROM kept UNION SELECT doc_id, line FROM heads WHERE level = 2),
crumbs AS (
  SELECT s.doc_id, s.line, coalesce(lead(s.line) OVER (PARTITION BY s.doc_id ORDER BY s.line), (SELECT count(*) FROM kept k WHERE k.doc_id = s.doc_id)) AS stop,
    coalesce((SELECT arg_max(h.text, h.line) FROM heads h WHERE h.doc_id = s.doc_id AND h.level = 1 AND h.line <= s.line), '') AS h1,
    coalesce((SELECT arg_max(h.text, h.line) FROM heads h WHERE h.doc_id = s.doc_id AND h.level = 2 AND h.line <= s.line), '') AS h2,
    NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = s.doc_id AND h.level = 2 AND h.line = 0) AND s.line = 0 AS preamble,
    (SELECT arg_min(struct_pack(level := h.level, text := h.text), h.line) FROM heads h WHERE h.doc_id = s.doc_id AND h.level IN (1, 2)) AS first
  FROM starts s)"""


@query(f"""WITH RECURSIVE {SECTIONS_SQL}
SELECT doc_id, CAST(line AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CASE WHEN preamble THEN CASE WHEN first.level = 1 THEN first.text ELSE '' END ELSE array_to_string(list_filter([h1, h2], lambda x: x <> ''), ' > ') END AS breadcrumb FROM crumbs""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-8, CHK-9, CHK-10."""
    scanned = chunking.scan_lines(base.markdown(spark, sf_dir)).where(F.size("lines") > 0).withColumn("starts", chunking.section_starts(F.col("headings")))
    sections = chunking.sections_of(F.col("headings"), F.col("starts"), F.col("counts"), F.size("lines"))
    return scanned.select("doc_id", F.explode_outer(sections).alias("s")).where(F.col("s").isNotNull()).select("doc_id", "s.start", F.col("s.end").alias("stop"), F.array_join("s.breadcrumb", " > ").alias("breadcrumb"))


SMALL = chunking.ChunkConfig(floor=40, ceiling=120)


@query(f"""WITH RECURSIVE pieces AS (
  SELECT doc_id, line, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS words
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)),
ordered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, words FROM pieces WHERE words > 0),
fold AS (
  SELECT doc_id, i, words AS now, 1 AS chunk FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.i, CASE WHEN f.now < {SMALL.floor} AND f.now + o.words <= {SMALL.ceiling} THEN f.now + o.words ELSE o.words END,
         CASE WHEN f.now < {SMALL.floor} AND f.now + o.words <= {SMALL.ceiling} THEN f.chunk ELSE f.chunk + 1 END
  FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
SELECT doc_id, CAST(chunk - 1 AS INTEGER) AS chunk_index, CAST(max(now) AS INTEGER) AS tokens FROM fold GROUP BY doc_id, chunk""")
def merge_below_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-13, CHK-19: lines as pieces."""
    rows = base.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines")).withColumn("counts", chunking.running_fields(F.col("lines")))
    pieces = F.transform("lines", lambda x, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.array().cast("array<string>").alias("breadcrumb"), (F.get("counts", i + 1) - F.get("counts", i)).alias("tokens")).cast(chunking.PIECE))
    merged = chunking.merge_below_floor(F.filter(pieces, lambda p: p["tokens"] > 0), F.col("counts"), SMALL)
    return rows.select("doc_id", F.posexplode(merged).alias("chunk_index", "p")).select("doc_id", "chunk_index", "p.tokens")


#: Sections as in section_split; children of those over the ceiling; then the merge as a recursion over the pieces of a note.
CHUNKS_SQL = f"""{SECTIONS_SQL},
sections AS (SELECT doc_id, line, stop, CASE WHEN preamble THEN CASE WHEN first.level = 1 THEN [first.text] ELSE [] END ELSE list_filter([h1, h2], lambda x: x <> '') END AS crumbs FROM crumbs),
counted AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS words FROM kept),
running AS (SELECT doc_id, line + 1 AS line, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM counted UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM counted),
measured AS (SELECT s.*, e.before - b.before AS own, len(list_filter(regexp_split_to_array(array_to_string(crumbs, ' > '), '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS head
  FROM sections s JOIN running b ON b.doc_id = s.doc_id AND b.line = s.line JOIN running e ON e.doc_id = s.doc_id AND e.line = s.stop),
thirds AS (SELECT m.doc_id, m.line AS section, m.stop, m.crumbs, h.line, h.text FROM measured m JOIN heads h ON h.doc_id = m.doc_id AND h.level = 3 AND h.line >= m.line AND h.line < m.stop WHERE m.own + m.head > {SMALL.ceiling}),
children AS (
  SELECT doc_id, line AS start, coalesce(lead(line) OVER (PARTITION BY doc_id, section ORDER BY line), stop) AS stop, list_append(crumbs, text) AS crumbs FROM thirds
  UNION ALL SELECT doc_id, section, min(line), any_value(crumbs) FROM thirds GROUP BY doc_id, section HAVING min(line) > section),
pieces AS (
  SELECT doc_id, line AS start, stop, crumbs FROM measured m WHERE own > 0 AND NOT EXISTS (SELECT 1 FROM thirds t WHERE t.doc_id = m.doc_id AND t.section = m.line)
  UNION ALL SELECT c.doc_id, c.start, c.stop, c.crumbs FROM children c JOIN running b ON b.doc_id = c.doc_id AND b.line = c.start JOIN running e ON e.doc_id = c.doc_id AND e.line = c.stop
    JOIN measured m ON m.doc_id = c.doc_id AND c.start >= m.line AND c.start < m.stop WHERE e.before > b.before AND m.own > 0),
placed AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY start) AS i, b.before AS from_words, e.before AS to_words
  FROM pieces p JOIN running b ON b.doc_id = p.doc_id AND b.line = p.start JOIN running e ON e.doc_id = p.doc_id AND e.line = p.stop),
merged AS (
  SELECT doc_id, i, start, stop, crumbs, from_words, to_words, 0 AS chunk FROM placed WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN joins THEN start ELSE next_start END, next_stop, CASE WHEN joins THEN shared ELSE next_crumbs END, CASE WHEN joins THEN from_words ELSE next_from END, next_to, CASE WHEN joins THEN chunk ELSE chunk + 1 END
  FROM (SELECT *, to_words - from_words + {{head_now}} < {SMALL.floor} AND next_to - from_words + {{head_shared}} <= {SMALL.ceiling} AS joins
    FROM (SELECT m.doc_id, p.i, m.start, m.crumbs, m.from_words, m.to_words, m.chunk, p.start AS next_start, p.stop AS next_stop, p.crumbs AS next_crumbs, p.from_words AS next_from, p.to_words AS next_to,
        CASE WHEN m.crumbs[1] IS DISTINCT FROM p.crumbs[1] OR len(m.crumbs) = 0 THEN [] WHEN m.crumbs[2] IS DISTINCT FROM p.crumbs[2] OR len(m.crumbs) = 1 THEN m.crumbs[1:1] WHEN m.crumbs[3] IS DISTINCT FROM p.crumbs[3] OR len(m.crumbs) = 2 THEN m.crumbs[1:2] ELSE m.crumbs[1:3] END AS shared
      FROM merged m JOIN placed p ON p.doc_id = m.doc_id AND p.i = m.i + 1))),
chunked AS (SELECT doc_id, chunk, arg_max(start, i) AS start, arg_max(stop, i) AS stop, arg_max(crumbs, i) AS crumbs, arg_max(to_words - from_words, i) AS words FROM merged GROUP BY doc_id, chunk),
texts AS (SELECT c.*, array_to_string(crumbs, ' > ') AS breadcrumb, (SELECT string_agg(k.text, chr(10) ORDER BY k.line) FROM kept k WHERE k.doc_id = c.doc_id AND k.line >= c.start AND k.line < c.stop)
    || CASE WHEN c.stop < (SELECT count(*) FROM kept k WHERE k.doc_id = c.doc_id) OR (SELECT body LIKE '%' || chr(10) FROM markdown m WHERE m.doc_id = c.doc_id) THEN chr(10) ELSE '' END AS own FROM chunked c),
chunks AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, breadcrumb, CASE WHEN breadcrumb = '' THEN own ELSE breadcrumb || chr(10) || chr(10) || own END AS text,
  CAST(words + len(list_filter(regexp_split_to_array(breadcrumb, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM texts)"""
FIELDS_OF = "len(list_filter(regexp_split_to_array(array_to_string({0}, ' > '), '[\\s\\p{{Z}}]+'), lambda w: w <> ''))"
CHUNKS_SQL = CHUNKS_SQL.replace("{head_now}", FIELDS_OF.format("crumbs")).replace("{head_shared}", FIELDS_OF.format("shared"))


@query(f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT doc_id, chunk_index, breadcrumb, sha256(text) AS text_sha, tokens, tokens > {SMALL.ceiling} AS oversize, CASE WHEN tokens > {chunking.HARD_LIMIT} THEN 'chunk over the hard limit' END AS error FROM chunks""")
def chunk_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1 to CHK-18: the whole chain."""
    chunks = chunking.chunk_notes(base.markdown(spark, sf_dir), SMALL)
    return chunks.select("doc_id", "chunk_index", F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.sha2("text", 256).alias("text_sha"), "tokens", "oversize", "error")


@query(f"""WITH RECURSIVE {CHUNKS_SQL},
ends AS (SELECT *, max(chunk_index) OVER (PARTITION BY doc_id) AS last, tokens < {SMALL.floor} AS below FROM chunks),
of_notes AS (SELECT count(*) AS chunked, count(*) FILTER (n = 1) AS single, min(n) AS per_note_min, quantile_disc(n, 0.5)::DOUBLE AS per_note_p50, quantile_disc(n, 0.95)::DOUBLE AS per_note_p95, max(n) AS per_note_max, CAST(sum(n) AS BIGINT) AS per_note_sum
  FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)),
of_chunks AS (SELECT count(*) AS chunks, min(tokens) AS tokens_min, quantile_disc(tokens, 0.5)::DOUBLE AS tokens_p50, quantile_disc(tokens, 0.95)::DOUBLE AS tokens_p95, max(tokens) AS tokens_max, CAST(sum(tokens) AS BIGINT) AS tokens_sum,
  count(*) FILTER (tokens > {SMALL.ceiling}) AS oversize, count(*) FILTER (below) AS below_floor, count(*) FILTER (below AND last = 0) AS below_alone, count(*) FILTER (below AND chunk_index = last AND last > 0) AS below_last, count(*) FILTER (below AND chunk_index < last) AS below_rest FROM ends),
largest AS (SELECT doc_id AS largest_note, chunk_index AS largest_chunk FROM chunks ORDER BY tokens DESC, doc_id DESC, chunk_index DESC LIMIT 1)
SELECT (SELECT count(*) FROM documents) AS notes, of_notes.*, of_chunks.*, (SELECT count(*) FROM documents) - chunked AS empty, largest.* FROM of_notes, of_chunks, largest""")
def chunk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-21."""
    notes_ = base.markdown(spark, sf_dir)
    return chunking.calibration(notes_, chunking.chunk_notes(notes_, SMALL), "doc_id", SMALL)


#: How often a long note says its text.
LIMIT_TIMES = 30


@query(f"""WITH {base.NOTES_SQL}, c AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS words FROM notes)
SELECT tenant_id, uid, 'chunk over the hard limit' AS error FROM c WHERE words * (CASE WHEN doc_id % 3 = 0 THEN {LIMIT_TIMES} ELSE 1 END) > {chunking.HARD_LIMIT}""")
def hard_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-17: a note with a chunk over the hard limit fails; every third note says its text many times."""
    text_ = F.translate(F.regexp_replace("text", "[#|`~]", "x"), "\n", " ")
    again = F.array_join(F.array_repeat(text_, LIMIT_TIMES), " ")
    notes_ = base.notes(spark, sf_dir).select("doc_id", "tenant_id", "uid", F.when(F.col("doc_id") % 3 == 0, again).otherwise(text_).alias("body"))
    return chunking.failed_notes(chunking.chunk_notes(notes_), ["tenant_id", "uid"])


@query(f"""WITH {base.NOTES_SQL},
hostile AS (SELECT doc_id, path, '<untrusted_<untrusted_content>content>' || text || '</untrusted_content>' AS text FROM notes),
once AS (SELECT doc_id, path, replace(replace(text, '{security.OPEN_TAG}', '&lt;untrusted_content&gt;'), '{security.CLOSE_TAG}', '&lt;/untrusted_content&gt;') AS text FROM hostile),
safe AS (SELECT doc_id, path, replace(replace(text, '{security.OPEN_TAG}', '&lt;untrusted_content&gt;'), '{security.CLOSE_TAG}', '&lt;/untrusted_content&gt;') AS text FROM once)
SELECT doc_id, text AS sanitized, '{security.OPEN_TAG}' || chr(10) || '{security.WARNING}' || chr(10) || 'path: ' || path || chr(10) || 'breadcrumb: A > B' || chr(10) || 'uid: u | chunk_index: 0 | score: 0.2500' || chr(10) || chr(10) || text || chr(10) || '{security.CLOSE_TAG}' AS block FROM safe""")
def sanitize_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-17, PRJ-18, PRJ-20."""
    hostile = F.concat(F.lit("<untrusted_<untrusted_content>content>"), F.col("text"), F.lit("</untrusted_content>"))
    return base.notes(spark, sf_dir).select("doc_id", security.sanitize(hostile).alias("sanitized"), security.render_block(F.col("path"), F.lit(""), F.lit("A > B"), F.lit("u"), F.lit(0), F.lit(0.25), hostile).alias("block"))


PATHS = ("a/b.md", "/a/b.md", "a//b.md", "../a.md", "a/../b.md", "./a.md", "", "a/b/", "..", ".")
PATH_ERRORS = (None, "absolute", "not clean", "escapes", "not clean", "not clean", "empty", "not clean", "escapes", None)


@query(f"""SELECT page_id, ([{", ".join(f"'{p}'" for p in PATHS)}])[page_id % {len(PATHS)} + 1] AS path, ([{", ".join("NULL" if e is None else f"'{e}'" for e in PATH_ERRORS)}])[page_id % {len(PATHS)} + 1] AS error FROM pages""")
def path_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-19."""
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("page_id") % len(PATHS) + 1).cast("int"))
    return base.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("error", security.path_error(F.col("path")))


@query(f"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS fields,
  len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> ''))) AS tokens FROM documents""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, CHK-19, CON-3."""
    return base.table(spark, sf_dir, "documents").select("doc_id", text.count_fields(F.col("text")).cast("long").alias("fields"), F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"))
