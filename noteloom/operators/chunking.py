"""Heading-aware chunking as array expressions: one row in, one row out, no shuffle.

Lines are folded once for fences and once for tables; headings outside both cut sections (level 2) and children
(level 3); sections over the ceiling give way to their children, pieces below the floor absorb what follows. Tokens are
white-space fields, so a range is measured by the difference of two running counts instead of cutting its text again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.arrays import fold, let, running_sum
from noteloom.functions.stats import nearest_rank
from noteloom.functions.text import SPACE, count_fields, is_blank, trim_space

FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
HEADING = r"^ {0,3}(#{1,6})(?:$|[ \t](.*)$)"
SECTION_LEVEL, CHILD_LEVEL, HARD_LIMIT = 2, 3, 8192
PIECE = "struct<start:int,end:int,breadcrumb:array<string>,tokens:int>"


@dataclass(frozen=True)
class ChunkConfig:
    floor: int = 256
    ceiling: int = 1024

    def __post_init__(self):
        if not 0 < self.floor <= self.ceiling <= HARD_LIMIT:
            raise ValueError(f"need 0 < floor <= ceiling <= {HARD_LIMIT}, got {self.floor} and {self.ceiling}")


def lines_of(body: Column) -> Column:
    """Lines without their newline; a final newline makes no line."""
    lines = F.split(body, "\n", -1)
    return F.when(body == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def in_fence(lines: Column) -> Column:
    """Whether each line belongs to a fence; an open one runs to the end."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("run"), F.lit(False).alias("inside"))
    marks = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, FENCE, 1).alias("mark"), is_blank(F.regexp_extract(x, FENCE, 2)).alias("bare")))

    def step(s: Column, m: Column) -> Column:
        sign, size = F.substring(m["mark"], 1, 1), F.length(m["mark"])
        closes = (sign == s["open"]) & (size >= s["run"]) & m["bare"]
        opened = F.when(s["open"] == "", sign).when(closes, "").otherwise(s["open"])
        return F.struct(opened.alias("open"), F.when(s["open"] == "", size).otherwise(s["run"]).alias("run"), ((s["open"] != "") | (sign != "")).alias("inside"))

    return fold(marks, start, "struct<open:string,run:int,inside:boolean>", step, lambda s: s["inside"], "boolean")


def is_heading(line: Column) -> Column:
    return F.regexp_like(line, F.lit(HEADING))


def heading_text(line: Column) -> Column:
    """Text without any trailing number signs."""
    return trim_space(F.regexp_replace(trim_space(F.regexp_extract(line, HEADING, 2)), "#+$", ""))


def is_table_row(line: Column) -> Column:
    return F.contains(line, F.lit("|")) & ~is_blank(line) & ~F.regexp_like(line, F.lit("^ {0,3}>")) & ~is_heading(line)


def is_delimiter_row(line: Column) -> Column:
    inner = F.regexp_replace(trim_space(line), r"^\|+|\|+$", "")
    return F.contains(line, F.lit("|")) & F.forall(F.split(inner, r"\|", -1), lambda c: F.regexp_like(trim_space(c), F.lit("^:?-+:?$")))


def in_table(lines: Column, fenced: Column) -> Column:
    """Whether each line belongs to a table: a row, a delimiter row, then rows, outside fences."""
    # Arrays are zipped instead of indexed: a column named once inside a lambda would be computed for every element.
    after = F.slice(lines, F.lit(2), F.size(lines))
    pairs = F.zip_with(lines, after, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    marks = F.zip_with(pairs, fenced, lambda p, f: F.struct((is_table_row(p["x"]) & ~f).alias("row"), F.coalesce(is_delimiter_row(p["y"]), F.lit(False)).alias("opens")))

    def step(mode: Column, m: Column) -> Column:
        return F.when(mode == 1, 2).when((mode == 2) & m["row"], 2).when((mode == 0) & m["row"] & m["opens"], 1).otherwise(0)

    return fold(marks, F.lit(0), "int", step, lambda mode: mode > 0, "boolean")


def headings_of(lines: Column, fenced: Column, tabled: Column) -> Column:
    """array<struct<line, level, text>> of levels 1 to 3 outside fences and tables."""
    held = F.zip_with(fenced, tabled, lambda a, b: a | b)
    every = F.transform(F.zip_with(lines, held, lambda x, h: F.struct(x.alias("x"), h.alias("h"))), lambda z, i: F.struct(i.alias("line"), F.length(F.regexp_extract(z["x"], HEADING, 1)).alias("level"), heading_text(z["x"]).alias("text"), z["h"].alias("held")))
    return F.transform(F.filter(every, lambda h: h["level"].between(1, 3) & ~h["held"]), lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["text"].alias("text")))


Counter = Callable[[Column], Column]


def running_fields(lines: Column, count: Counter = count_fields) -> Column:
    """Tokens before line 0, 1, ... and after the last. count: tokens of a text, as a column; the white-space counter if
    none is given. A counter must give the sum of its lines for a text."""
    return F.concat(F.array(F.lit(0)), running_sum(F.transform(lines, count)))


def breadcrumb_prefix(breadcrumb: Column, text: Column) -> Column:
    """`A > B`, an empty line and the text; an empty breadcrumb adds nothing."""
    return F.when(F.size(breadcrumb) > 0, F.concat(F.array_join(breadcrumb, " > "), F.lit("\n\n"), text)).otherwise(text)


def _measured(counts: Column, breadcrumb: Column, start: Column, end: Column, count: Counter = count_fields) -> Column:
    head = F.when(F.size(breadcrumb) > 0, count(F.array_join(breadcrumb, " > "))).otherwise(0)
    return F.get(counts, end) - F.get(counts, start) + head


def _piece(counts: Column, start: Column, end: Column, breadcrumb: Column, count: Counter = count_fields) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), breadcrumb.alias("breadcrumb"), _measured(counts, breadcrumb, start, end, count).alias("tokens")).cast(PIECE)


def section_starts(headings: Column) -> Column:
    own = F.transform(F.filter(headings, lambda h: h["level"] == SECTION_LEVEL), lambda h: h["line"])
    return F.when(F.coalesce(F.get(own, F.lit(0)) == 0, F.lit(False)), own).otherwise(F.concat(F.array(F.lit(0)), own))


#: A section before it is measured: its line, the last headings of levels 1 and 2 up to there, and the place of its first
#: heading in the list of headings.
OPENING = "struct<line:int,h1:string,h2:string,at:int>"


def openings_of(headings: Column) -> Column:
    """One for each heading of level 2, in one pass over the headings."""
    state = F.struct(F.lit("").alias("h1"), F.lit("").alias("h2"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("line"))

    def step(s: Column, h: Column) -> Column:
        section = h["level"] == SECTION_LEVEL
        return F.struct(F.when(h["level"] == 1, h["text"]).otherwise(s["h1"]).alias("h1"), F.when(section, h["text"]).otherwise(s["h2"]).alias("h2"), (s["at"] + 1).alias("at"), F.when(section, h["line"]).alias("line"))

    def opening(s: Column) -> Column:
        return F.when(s["line"].isNotNull(), F.struct(s["line"].alias("line"), s["h1"].alias("h1"), s["h2"].alias("h2"), s["at"].alias("at")))

    return fold(headings, state, "struct<h1:string,h2:string,at:int,line:int>", step, opening, OPENING)


def sections_of(headings: Column, starts: Column, counts: Column, n_lines: Column, count: Counter = count_fields) -> Column:
    """Sections as pieces: each starts at a level-2 heading, the first possibly at the top of the note."""
    return F.transform(_placed_sections(headings, starts, counts, n_lines, count), lambda s: s["piece"])


def _placed_sections(headings: Column, starts: Column, counts: Column, n_lines: Column, count: Counter) -> Column:
    """Sections and the places of their headings: array<struct<piece, first, last>>."""
    none = F.array().cast("array<string>")

    def whole(opened: Column) -> Column:
        first = F.get(F.filter(headings, lambda h: h["level"] <= SECTION_LEVEL), F.lit(0))
        preamble = F.when(first["level"] == 1, F.array(first["text"])).otherwise(none)
        top = F.struct(F.lit(0).alias("line"), F.lit("").alias("h1"), F.lit("").alias("h2"), F.lit(-1).alias("at")).cast(OPENING)
        has_top = F.size(starts) > F.size(opened)

        def one(o: Column, i: Column, every: Column) -> Column:
            following = F.get(every, i + 1)
            crumbs = F.when(o["at"] < 0, preamble).otherwise(F.filter(F.array(o["h1"], o["h2"]), lambda x: x != ""))
            piece = _piece(counts, o["line"], F.coalesce(following["line"], n_lines), crumbs, count)
            return F.struct(piece.alias("piece"), (o["at"] + 1).alias("first"), F.coalesce(following["at"], F.size(headings)).alias("last"))

        every = F.when(has_top, F.concat(F.array(top), opened)).otherwise(opened)
        return let(every, lambda e: F.transform(e, lambda o, i: one(o, i, e)))

    return F.when(F.size(starts) > 0, let(openings_of(headings), whole))


def children_of(headings: Column, section: Column, counts: Column, count: Counter = count_fields) -> Column:
    """Pieces of a section (with the places of its headings) that its level-3 headings cut; none if it has none."""
    none, s = F.array().cast(f"array<{PIECE}>"), section["piece"]

    def whole(own: Column) -> Column:
        first = F.get(own, F.lit(0))["line"]
        head = F.when(first > s["start"], F.array(_piece(counts, s["start"], first, s["breadcrumb"], count))).otherwise(none)
        rest = F.transform(own, lambda h, i: _piece(counts, h["line"], F.coalesce(F.get(own, i + 1)["line"], s["end"]), F.concat(s["breadcrumb"], F.array(h["text"])), count))
        return F.when(F.size(own) > 0, F.concat(head, rest)).otherwise(none)

    return let(F.filter(F.slice(headings, section["first"] + 1, section["last"] - section["first"]), lambda h: h["level"] == CHILD_LEVEL), whole)


def split_over_ceiling(sections: Column, headings: Column, counts: Column, ceiling: int, count: Counter = count_fields) -> Column:
    """Pieces: each section, or its children if it is over the ceiling and has some; blank ones are dropped."""
    filled = lambda p: F.get(counts, p["end"]) > F.get(counts, p["start"])

    def one(s: Column) -> Column:
        whole = F.array(s["piece"])
        children = let(children_of(headings, s, counts, count), lambda c: F.when(F.size(c) == 0, whole).otherwise(F.filter(c, filled)))
        return F.when(s["piece"]["tokens"] <= ceiling, whole).otherwise(children)

    return F.flatten(F.transform(F.filter(sections, lambda s: filled(s["piece"])), one))


def common_prefix(a: Column, b: Column) -> Column:
    same = [F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False)) for i in range(3)]
    return F.slice(a, F.lit(1), F.when(~same[0], 0).when(~same[1], 1).when(~same[2], 2).otherwise(3))


def merge_below_floor(pieces: Column, counts: Column, config: ChunkConfig, count: Counter = count_fields) -> Column:
    """Greedy left fold: a piece below the floor absorbs the next as long as the union stays within the ceiling."""
    none = F.lit(None).cast(PIECE)
    start = F.struct(none.alias("now"), none.alias("full"))

    def step(s: Column, p: Column) -> Column:
        union = _piece(counts, s["now"]["start"], p["end"], common_prefix(s["now"]["breadcrumb"], p["breadcrumb"]), count)
        return let(
            union,
            lambda u: F.when(s["now"].isNull(), F.struct(p.alias("now"), none.alias("full")))
            .when((s["now"]["tokens"] < config.floor) & (u["tokens"] <= config.ceiling), F.struct(u.alias("now"), none.alias("full")))
            .otherwise(F.struct(p.alias("now"), s["now"].alias("full"))),
        )

    return fold(pieces, start, f"struct<now:{PIECE},full:{PIECE}>", step, lambda s: s["full"], PIECE, lambda s: s["now"])


def scan_lines(notes: DataFrame, body: str = "body", count: Counter = count_fields) -> DataFrame:
    """Adds lines, fenced, tabled, headings and counts."""
    out = notes.withColumn("lines", lines_of(F.col(body)))
    out = out.withColumn("fenced", in_fence(F.col("lines")))
    out = out.withColumn("tabled", in_table(F.col("lines"), F.col("fenced")))
    return out.withColumns({"headings": headings_of(F.col("lines"), F.col("fenced"), F.col("tabled")), "counts": running_fields(F.col("lines"), count)})


def chunk_notes(notes: DataFrame, config: ChunkConfig | None = None, body: str = "body", count: Counter = count_fields) -> DataFrame:
    """One row per chunk: the columns of notes without the body, chunk_index, breadcrumb, text, tokens, oversize, error.
    A note with an error in any chunk must not be stored (`failed_notes`)."""
    config = config or ChunkConfig()
    keep = [c for c in notes.columns if c != body]
    scanned = scan_lines(notes, body, count)
    parts = scanned.withColumn("starts", F.when(F.size("lines") > 0, section_starts(F.col("headings"))).otherwise(F.array().cast("array<int>")))
    parts = parts.withColumn("sections", _placed_sections(F.col("headings"), F.col("starts"), F.col("counts"), F.size("lines"), count))
    parts = parts.withColumn("pieces", split_over_ceiling(F.col("sections"), F.col("headings"), F.col("counts"), config.ceiling, count))
    parts = parts.withColumn("pieces", merge_below_floor(F.col("pieces"), F.col("counts"), config, count))
    # Outer, because an inner explode adds a filter on the array, which pushes the whole chain below the scan columns and
    # computes it once more for every element.
    rows = parts.select(*keep, body, "lines", F.posexplode_outer("pieces").alias("chunk_index", "p")).where(F.col("p").isNotNull())
    ended = (F.col("p.end") < F.size("lines")) | F.col(body).endswith("\n")
    text = F.concat(F.array_join(F.slice("lines", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")), "\n"), F.when(ended, "\n").otherwise(""))
    return rows.select(
        *keep, "chunk_index", F.col("p.breadcrumb").alias("breadcrumb"), breadcrumb_prefix(F.col("p.breadcrumb"), text).alias("text"), F.col("p.tokens").alias("tokens"),
        (F.col("p.tokens") > config.ceiling).alias("oversize"), F.when(F.col("p.tokens") > HARD_LIMIT, "chunk over the hard limit").alias("error"),
    )


def scan_sections(notes: DataFrame, body: str = "body") -> DataFrame:
    """Adds lines, ends (whether the body ends its last line) and sections: pieces that are not blank, each with those that
    its level-3 headings cut, before anything is measured: array<struct<piece, children>>."""
    scanned = scan_lines(notes, body)
    starts = F.when(F.size("lines") > 0, section_starts(F.col("headings"))).otherwise(F.array().cast("array<int>"))
    placed = scanned.withColumn("placed", _placed_sections(F.col("headings"), starts, F.col("counts"), F.size("lines"), count_fields))
    filled = lambda p: F.get(F.col("counts"), p["end"]) > F.get(F.col("counts"), p["start"])
    children = lambda s: F.filter(children_of(F.col("headings"), s, F.col("counts")), filled)
    sections = F.transform(F.filter("placed", lambda s: filled(s["piece"])), lambda s: F.struct(s["piece"].alias("piece"), children(s).alias("children")))
    none = F.array().cast(f"array<struct<piece:{PIECE},children:array<{PIECE}>>>")
    return placed.select(*[c for c in notes.columns], "lines", F.col(body).endswith("\n").alias("ends"), F.coalesce(sections, none).alias("sections"))


def failed_notes(chunks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Notes with a chunk over the hard limit, and why."""
    return chunks.where(F.col("error").isNotNull()).groupBy(*key).agg(F.min("error").alias("error"))


def calibration(notes: DataFrame, chunks: DataFrame, key: str, config: ChunkConfig) -> DataFrame:
    """What a configuration does to a corpus, in one row: distributions of chunks per note and tokens per chunk, oversize
    chunks, the largest one, and chunks below the floor by cause (alone in their note, last, or where merging stopped)."""
    last = Window.partitionBy(key).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = chunks.withColumn("_last", F.max("chunk_index").over(last))
    below = F.col("tokens") < config.floor
    alone, final = F.col("_last") == 0, F.col("chunk_index") == F.col("_last")
    counted = lambda c: F.count(F.when(c, 1))
    # The last chunk of a note stands for it.
    placed = placed.withColumn("_n", F.when(final, F.col("_last") + 1))
    of_both = placed.agg(
        F.count("*").alias("chunks"), *_spread("tokens", "tokens"), counted(F.col("oversize")).alias("oversize"), counted(below).alias("below_floor"),
        counted(below & alone).alias("below_alone"), counted(below & final & ~alone).alias("below_last"), counted(below & ~final).alias("below_rest"),
        F.max(F.struct("tokens", F.col(key).alias("k"), F.col("chunk_index").alias("i"))).alias("_largest"),
        F.count("_n").alias("chunked"), counted(F.col("_n") == 1).alias("single"), *_spread("_n", "per_note"),
    )
    total = notes.agg(F.count("*").alias("notes"))
    out = total.crossJoin(of_both)  # one row each
    return out.withColumn("empty", F.col("notes") - F.col("chunked")).withColumns({"largest_note": F.col("_largest.k"), "largest_chunk": F.col("_largest.i")}).drop("_largest")


def _spread(column: str, name: str) -> list[Column]:
    return [F.min(column).alias(f"{name}_min"), *[nearest_rank(column, p).alias(f"{name}_p{int(p * 100)}") for p in (0.5, 0.95)], F.max(column).alias(f"{name}_max"), F.sum(column).alias(f"{name}_sum")]


__all__ = ["SPACE", "ChunkConfig", "calibration", "chunk_notes", "failed_notes", "scan_lines"]
