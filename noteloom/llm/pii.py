"""PII: weak-supervision aggregation, in DataFrame functions only.

Candidates are the strict (base) spans of the contract and looser spans (bracketed or spelled-out e-mail addresses, phone
numbers without a country code, card numbers with dots, IPv6). Five labelers vote +1, -1 or 0 on each: the strict
pattern, a gazetteer (top-level domains, card issuers, area codes, reserved addresses), words in the context before, the
signs next to the span, and a shape or checksum test. Expectation-maximisation over the counts of vote patterns (at most
4 * 3^5 rows) estimates each labeler's reliability; its posteriors train a logistic span classifier, whose linear form is
evaluated as column arithmetic. Base spans always stay; loose spans are added if the classifier accepts them and they
overlap no base span and begin in no earlier accepted span.

Positions come from splitting at the pattern: the lengths of gaps and matches before a match add up to its start, in
code points. Running sums and maxima over the matches of a text are taken in blocks, and no text is cut by position once
for every match, so a long text with many matches takes nearly linear time. Patterns are possessive and anchored at run
starts, so long runs cost linear time and no recursion.

Nulls: a null text is empty; null ids are kept. Repeated rows are judged row by row. Spans that begin together are
ordered by kind. Empty tables give no rows; further columns, of any name, are kept by `redact` and not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns of the contract, written so that a failed start is not tried again inside its run, and
#: so that runs with too few or too many digits for a card or a phone number do not match at all.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
GATES = {"email": "(?i)@|[\\[(]at[\\])]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "dev", "app", "eu", "de", "fr", "es", "it", "uk", "us", "ch", "at", "nl", "be", "pt", "br", "mx", "ca", "jp", "cn", "in")
CARD_ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CONTEXT_FOR = "(?i)(?:mail|contact|call|phone|fax|mobile|card|visa|host|address|name|reach|adresse|correo|tel)[^A-Za-z]{0,3}$"
CONTEXT_AGAINST = "(?i)(?:version|isbn|order|invoice|release|item|page|build|rfc)[^A-Za-z]{0,3}$"
CONTEXT_CHARS = 24
#: Elements of a block of a running sum.
RUN_BLOCK = 128
#: Texts with more spans than this are cut as arrays of signs.
MANY_SPANS = 32
LABELERS = ("strict", "gazetteer", "context", "boundary", "shape")
SPAN = "struct<start:int,kind:int,end:int>"


def _found(text: Column, pattern: str, gate: str) -> tuple[Column, Column]:
    """Matches and the gaps before, between and after them."""
    open_ = F.regexp_like(text, F.lit(gate))
    none = F.array().cast("array<string>")
    return F.when(open_, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(open_, F.split(text, pattern, -1)).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once. Lambdas would compute a column that they name for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """Of each element, what it and all before it combine to (array<int>), in blocks, since folds copy the array they build."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(zero).alias("at"), none.alias("out"))

    def step(s: Column, v: Column) -> Column:
        return _let(combine(s["at"], v).cast("int"), lambda x: F.struct(x.alias("at"), F.concat(s["out"], F.array(x)).alias("out")))

    def before(s: Column, block: Column) -> Column:
        return F.struct(combine(s["at"], F.element_at(block, -1)).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN_BLOCK).cast("int")), lambda i: F.slice(v, i * RUN_BLOCK + 1, F.lit(RUN_BLOCK)))
        inner = F.transform(blocks, lambda b: F.aggregate(b, start, step, lambda s: s["out"]))
        offsets = lambda done: F.aggregate(done, start, before, lambda s: s["out"])
        return _let(inner, lambda done: F.flatten(F.zip_with(done, offsets(done), lambda b, o: F.transform(b, lambda x: combine(o, x).cast("int")))))

    return _let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def _placed(matches: Column, gaps: Column) -> Column:
    """array<struct<start, end, text, before, after>>: the lengths before each match add up to its place."""

    def whole(z: Column) -> Column:
        m, g = z["m"], z["g"]
        sizes = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, gap: F.length(x) + F.length(gap))
        near = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
        place = lambda ends: F.transform(
            m,
            lambda x, i: F.struct(
                (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("text"),
                F.right(F.concat(near(m, i - 1), near(g, i)), F.lit(CONTEXT_CHARS)).alias("before"),
                F.left(F.concat(near(g, i + 1), near(m, i + 1)), F.lit(1)).alias("after"),
            ),
        )
        return _let(_running(sizes, lambda a, b: a + b, 0), place)

    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")
    return F.when(F.size(matches) > 0, _let(F.struct(matches.alias("m"), gaps.alias("g")), whole)).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    """What a base match must pass beside its pattern."""
    if kind == "ip":
        return F.forall(F.split(text, "\\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        n = F.length(_digits(text))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(text))
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(kind: str, strict: bool, s: Column) -> Column:
    """struct of a span and its votes."""
    digits, before, after = _digits(s["text"]), s["before"], s["after"]
    gazetteer = {
        "email": F.lower(F.regexp_extract(s["text"], "([A-Za-z0-9-]+)$", 1)).isin(*TOP_LEVEL),
        "ip": ~F.regexp_like(s["text"], F.lit("^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\.")),
        "card": F.regexp_like(digits, F.lit(CARD_ISSUERS)),
        "phone": F.regexp_like(digits, F.lit("^(?:1[2-9]|[2-9])")),
    }[kind]
    shape = {
        "email": F.regexp_like(s["text"], F.lit("^[^@\\[(]*[A-Za-z]")),
        "card": luhn(digits),
    }.get(kind, F.size(F.array_distinct(F.split(digits, ""))) >= 3)
    glued = F.regexp_like(before, F.lit("[A-Za-z0-9]$")) | F.regexp_like(after, F.lit("^[A-Za-z0-9]"))
    return F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"),
        F.lit(1 if strict else 0).alias("strict"), _vote(gazetteer, ~gazetteer).alias("gazetteer"),
        _vote(F.regexp_like(before, F.lit(CONTEXT_FOR)), F.regexp_like(before, F.lit(CONTEXT_AGAINST))).alias("context"),
        _vote(~glued, glued).alias("boundary"), _vote(shape, ~shape).alias("shape"),
    )


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["text"])


def _judge(kind: str, strict: bool) -> Callable[[Column], Column]:
    return lambda s: _candidate(kind, strict, s)


def _is_kind(number: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == number


def candidates(documents: DataFrame, keep: list[str]) -> DataFrame:
    """`row` with the columns `keep`, and `found`: candidate spans with votes, base spans of each kind first."""
    out = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    arrays = []
    for kind in KINDS:
        for name, pattern in (("base", BASE[kind]), ("loose", LOOSE[kind])):
            m, g, c = f"_m_{kind}_{name}", f"_g_{kind}_{name}", f"_c_{kind}_{name}"
            matches, gaps = _found(F.col("_text"), pattern, GATES[kind])
            out = out.withColumns({m: matches, g: gaps})
            arrays.append((kind, name, m, g, c))
    for kind, name, m, g, c in arrays:
        placed = _placed(F.col(m), F.col(g))
        if name == "base":
            placed = F.filter(placed, _check(kind))
        out = out.withColumn(c, F.transform(placed, _judge(kind, name == "base")))
    out = out.withColumn("_base", F.concat(*[F.col(c) for *_, c in arrays if "_base" in c]))
    loose = F.concat(*[F.col(c) for *_, c in arrays if "_loose" in c])
    found = _let(loose, lambda x: F.when(F.size(x) == 0, F.col("_base")).otherwise(F.concat(F.col("_base"), _clear_of(F.col("_base"), x))))
    return out.select("row", found.alias("found"))


def _clear_of(base: Column, loose: Column) -> Column:
    """The loose spans that overlap no base span: in the order of starts, none before may end, and none after begin, inside."""
    later = 1 << 30

    def whole(spans: Column) -> Column:
        ends = _running(F.transform(spans, lambda s: F.when(s["strict"] == 1, s["end"]).otherwise(-1)), F.greatest, -1)
        starts = F.reverse(_running(F.reverse(F.transform(spans, lambda s: F.when(s["strict"] == 1, s["start"]).otherwise(later))), F.least, later))
        fits = lambda z: F.filter(spans, lambda s, i: (s["strict"] == 0) & (F.get(z["e"], i) <= s["start"]) & (F.get(z["s"], i) >= s["end"]))
        return _let(F.struct(ends.alias("e"), starts.alias("s")), fits)

    return _let(F.array_sort(F.concat(base, loose)), whole)


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights per kind and per vote."""

    bias: float
    kinds: tuple[float, ...]
    votes: dict[str, tuple[float, float]]  # for +1 and for -1
    reliability: dict[str, float]

    def accepts(self, s: Column) -> Column:
        z = F.lit(self.bias) + F.element_at(F.array(*[F.lit(k) for k in self.kinds]), s["kind"] + 1)
        for name, (plus, minus) in self.votes.items():
            z = z + F.when(s[name] == 1, plus).when(s[name] == -1, minus).otherwise(0.0)
        return z >= 0


def fit_classifier(found: DataFrame, rounds: int = 50, steps: int = 400) -> SpanClassifier:
    """found: a column `found` of candidates. Only counts of vote patterns come to the driver."""
    spans = found.select(F.explode("found").alias("s"))
    rows = spans.groupBy("s.kind", *[F.col(f"s.{x}").alias(x) for x in LABELERS]).count().collect()
    patterns = sorted((r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in rows)
    right, prior = [0.8] * len(LABELERS), 0.5
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (_, votes, _) in enumerate(patterns):
            yes, no = math.log(prior), math.log(1 - prior)
            for r, v in zip(right, votes, strict=True):
                if v:
                    yes, no = yes + math.log(r if v > 0 else 1 - r), no + math.log(r if v < 0 else 1 - r)
            posterior[i] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(n for *_, n in patterns)
        prior = min(0.99, max(0.01, (sum(p * n for p, (*_, n) in zip(posterior, patterns, strict=True)) + 5) / (total + 10)))
        for j in range(len(LABELERS)):
            # A prior of ten votes at 0.8 keeps labelers apart from 0 and 1, and better than chance.
            hit = sum(n * (p if v[j] > 0 else 1 - p) for p, (_, v, n) in zip(posterior, patterns, strict=True) if v[j])
            cast = sum(n for _, v, n in patterns if v[j])
            right[j] = min(0.99, max(0.55, (hit + 8) / (cast + 10)))
    width = 1 + len(KINDS) + 2 * len(LABELERS)
    theta = [0.0] * width

    def active(kind: int, votes: tuple[int, ...]) -> list[int]:
        return [0, 1 + kind, *(1 + len(KINDS) + 2 * j + (v < 0) for j, v in enumerate(votes) if v)]

    total = sum(n for *_, n in patterns) or 1
    for _ in range(steps):
        slope = [1e-3 * t for t in theta]
        for p, (kind, votes, n) in zip(posterior, patterns, strict=True):
            at = active(kind, votes)
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(theta[i] for i in at)))))
            for i in at:
                slope[i] += n / total * (q - p)
        theta = [t - 1.0 * s for t, s in zip(theta, slope, strict=True)]
    votes = {x: (theta[1 + len(KINDS) + 2 * j], theta[2 + len(KINDS) + 2 * j]) for j, x in enumerate(LABELERS)}
    return SpanClassifier(theta[0], tuple(theta[1 : 1 + len(KINDS)]), votes, dict(zip(LABELERS, right, strict=True)))


def _named(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(found: Column) -> Column:
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def accepted_spans(found: DataFrame, classifier: SpanClassifier) -> DataFrame:
    """Adds `base` and `spans`: sorted arrays of (start, kind, end). Added spans overlap nothing, the earlier one wins."""
    base = _plain(F.filter("found", lambda s: s["strict"] == 1))
    extra = _plain(F.filter("found", lambda s: (s["strict"] == 0) & classifier.accepts(s)))
    return found.withColumns({"base": base, "_extra": _apart(extra)}).withColumn("spans", F.array_sort(F.concat("base", "_extra"))).drop("_extra")


def _apart(spans: Column) -> Column:
    """Sorted spans without those that begin before an earlier one ends."""

    def whole(x: Column) -> Column:
        ends = _running(F.transform(x, lambda s: s["end"]), F.greatest, 0)
        return _let(ends, lambda e: F.filter(x, lambda s, i: (i == 0) | (F.get(e, i - 1) <= s["start"])))

    return _let(spans, lambda x: F.when(F.size(x) < 2, x).otherwise(whole(x)))


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. The counts are of base spans."""
    found = materialize(candidates(documents, ["doc_id"]), "spans")
    judged = accepted_spans(found, fit_classifier(found))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return judged.select("row.doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def _replaced(spans: Column, size: Column, part: Callable[[Column, Column], Column]) -> Column:
    """The text, of `size` signs, with each span's kind in its place. part(place, length) cuts the text; of overlapping spans the first counts."""
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def whole(ends: Column) -> Column:
        at = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        piece = lambda s, i: F.when(s["start"] >= at(i), F.concat(part(at(i), s["start"] - at(i)), F.element_at(kind, s["kind"] + 1))).otherwise("")
        return F.concat(F.array_join(F.transform(spans, piece), ""), part(F.element_at(ends, -1), size))

    return _let(_running(F.transform(spans, lambda s: s["end"]), F.greatest, 0), whole)


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars follows the text, other columns stay."""
    found = materialize(candidates(documents, documents.columns), "spans")
    judged = accepted_spans(found, fit_classifier(found))
    text = F.coalesce("row.text", F.lit(""))
    found_any = F.size("spans") > 0
    cut = F.when(F.size("spans") <= MANY_SPANS, _replaced(F.col("spans"), F.length(text), lambda at, n: F.substring(text, at + 1, n)))
    many = _let(F.split(text, ""), lambda signs: _replaced(F.col("spans"), F.size(signs), lambda at, n: F.array_join(F.slice(signs, at + 1, n), "")))
    changed = judged.withColumn("new", F.when(found_any, cut.otherwise(many)).otherwise(F.col("row.text")))
    replaced = {"text": F.col("new")}
    if "n_chars" in documents.columns:
        replaced["n_chars"] = F.when(found_any, F.length("new").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return changed.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
