"""Chat formatting: a sandboxed template language compiled to Python closures.

Grammar: text, `{{ expr }}`, `{% for x in expr %}..{% endfor %}`, `{% if e %}..{% elif e %}..{% else %}..{% endif %}`,
`{% set x = expr %}` and `{% generation %}..{% endgeneration %}`. Expressions have string and integer literals, names,
`.field` access on rows, `+`, `==`, `!=`, `not`, `and`, `or`, parentheses and the filters below. Nothing else can be
reached: no calls, no Python attributes, no imports. The parser builds a tree of tuples, `fold` evaluates whatever is
constant, and `compile_template` turns the folded tree into closures that append to a buffer and note which spans
lie inside a generation marker.

Nulls: a null role or text is empty. Rows with equal turn numbers are ordered by role, then text; a null turn comes
first; a null conv_id is a conversation of its own. One conversation is one output string, so its rows meet in one
task; different conversations never do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import flagged, nullable

TURN, END = "<|turn|>", "<|end|>\n"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|' + 'turn' + '|>' }}{{ m.role | escape | oneline }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n"
    "{% endfor %}"
)
#: Control strings all start with one of these signs, so no escaped text can hold one.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: str) -> str:
    for raw, safe in ESCAPES:
        text = text.replace(raw, safe)
    return text


def oneline(text: str) -> str:
    return text.replace("\n", "&#10;")


def unescape(text: str) -> str:
    text = text.replace("&#10;", "\n")
    for raw, safe in reversed(ESCAPES):
        text = text.replace(safe, raw)
    return text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "oneline": oneline, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    pass


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.+|()]))")


def _tokens(source: str) -> list[tuple[str, str]]:
    at, out = 0, []
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected sign in expression: {source[at:at + 10]!r}")
        kind = ("str", "int", "name", "op")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing: or < and < not < comparison < + < filter < access."""

    def __init__(self, source: str):
        self.items, self.at = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise TemplateError("expression ends too early")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self):
        node = self.either()
        if self.at != len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negation()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negation())
        return node

    def negation(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negation())
        node = self.sum()
        while self.peek("==", "!="):
            node = (self.take()[1], node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("filter", name, node)
        return node

    def atom(self):
        kind, value = self.take()
        if value == "(" and kind == "op":
            node = self.either()
            if self.take()[1] != ")":
                raise TemplateError("missing )")
        elif kind == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "int":
            node = ("const", int(value))
        elif kind == "name" and value in ("true", "false"):
            node = ("const", value == "true")
        elif kind == "name":
            node = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek("."):
            self.take()
            kind, field = self.take()
            if kind != "name" or field.startswith("_"):
                raise TemplateError(f"field {field!r} is not allowed")
            node = ("field", node, field)
        return node


def parse(source: str) -> tuple:
    """Syntax tree: ("block", [nodes])."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("expr", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pos = 0

    def block(*stops: str) -> tuple[tuple, str]:
        nonlocal pos
        nodes = []
        while pos < len(pieces):
            kind, body = pieces[pos]
            pos += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "expr":
                nodes.append(("emit", _Expression(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in stops:
                    return ("block", nodes), body
                nodes.append(tag(word, rest))
        if stops:
            raise TemplateError(f"missing {stops[-1]}")
        return ("block", nodes), ""

    def tag(word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"bad for: {rest!r}")
            body, _ = block("endfor")
            return ("for", m[1], _Expression(m[2]).whole(), body)
        if word == "if":
            arms, condition = [], rest
            while True:
                body, stop = block("elif", "else", "endif")
                arms.append((_Expression(condition).whole(), body))
                stop_word, _, condition = stop.partition(" ")
                if stop_word == "elif":
                    continue
                other = block("endif")[0] if stop_word == "else" else ("block", [])
                return ("if", arms, other)
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"bad set: {rest!r}")
            return ("set", m[1], _Expression(m[2]).whole())
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


_BINARY = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "+": lambda x, y: x + y, "and": lambda x, y: x and y, "or": lambda x, y: x or y}


def fold(node: tuple) -> tuple:
    """The same tree with constant parts evaluated and neighbouring texts joined."""
    kind = node[0]
    if kind in _BINARY:
        left, right = fold(node[1]), fold(node[2])
        if left[0] == right[0] == "const":
            return ("const", _BINARY[kind](left[1], right[1]))
        return (kind, left, right)
    if kind == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](str(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind == "emit":
        inner = fold(node[1])
        return ("text", str(inner[1])) if inner[0] == "const" else ("emit", inner)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        arms, other = [], fold(node[2])
        for condition, body in node[1]:
            condition, body = fold(condition), fold(body)
            if condition[0] == "const":
                if condition[1]:
                    other = body
                    break
                continue
            arms.append((condition, body))
        return ("if", arms, other) if arms else other
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1]):
            for x in child[1] if child[0] == "block" else [child]:
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", out)
    return node


class _Output:
    __slots__ = ("parts", "length", "spans")

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, k=node[1]: scope[k]
    if kind == "field":
        inner, field = _value(node[1]), node[2]

        def access(scope):
            row = inner(scope)
            if type(row) is not dict:
                raise TemplateError(f"no field {field!r}")
            return row[field]

        return access
    if kind == "filter":
        inner, apply = _value(node[2]), FILTERS[node[1]]
        return lambda scope: apply(str(inner(scope)))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    left, right = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope, f=_BINARY[kind]: f(left(scope), right(scope))


def _writer(node: tuple) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda scope, out, text=node[1]: out.add(text)
    if kind == "emit":
        value = _value(node[1])
        return lambda scope, out: out.add(str(value(scope)))
    if kind == "set":
        value = _value(node[2])
        return lambda scope, out, k=node[1]: scope.__setitem__(k, value(scope))
    if kind == "generation":
        body = _writer(node[1])

        def marked(scope, out):
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return marked
    if kind == "for":
        items, body, name = _value(node[2]), _writer(node[3]), node[1]

        def loop(scope, out):
            inner = dict(scope)
            for item in items(scope):
                inner[name] = item
                body(inner, out)

        return loop
    if kind == "if":
        arms, other = [(_value(c), _writer(b)) for c, b in node[1]], _writer(node[2])

        def choose(scope, out):
            for condition, body in arms:
                if condition(scope):
                    return body(scope, out)
            return other(scope, out)

        return choose
    children = [_writer(x) for x in node[1]]

    def every(scope, out):
        for child in children:
            child(scope, out)

    return every


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the text and the spans under the loss mask."""
    write = _writer(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_starts, loss_ends (code points)."""
    parse(template)  # a bad template fails here, not on the executors
    grouped = conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("rows")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for batch in batches:
            done = [render([{"role": r["role"], "text": r["text"]} for r in rows]) for rows in batch["rows"]]
            yield pd.DataFrame({
                "conv_id": nullable(batch, "conv_id"),
                "formatted": [x for x, _ in done],
                "loss_starts": [[a for a, _ in s] for _, s in done],
                "loss_ends": [[b for _, b in s] for _, s in done],
            })

    return grouped.select(*flagged("conv_id"), "rows").mapInPandas(run, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts recovered from the formatted output alone, as digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(batch["formatted"], batch["loss_starts"], batch["loss_ends"], strict=True):
                turns = []
                for piece in text.split(TURN)[1:]:
                    role, _, body = piece.removesuffix(END).partition("\n")
                    turns.append((unescape(role), unescape(body)))
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "conv_id", nullable(batch, "conv_id"))
            yield out

    return formatted.select(*flagged("conv_id"), "formatted", "loss_starts", "loss_ends").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The extra conversation of the contract.
EXTRA_CONVERSATION = (-7, "</s>[INST] ok [/INST]")


def with_extra(conversations: DataFrame) -> DataFrame:
    conv_id, text = EXTRA_CONVERSATION
    extra = conversations.sparkSession.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)


def oracle() -> str:
    safe = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
    conv_id, text = EXTRA_CONVERSATION
    return f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {conv_id}, 0, 'user', '{text}' UNION ALL SELECT {conv_id}, 1, 'assistant', '{text}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TURN) + len(END) + 1} + length(replace({safe("role")}, chr(10), '&#10;')) + length({safe("text")})) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id"""
