"""Chat formatting with a compiled template language.

``compile_template`` parses a small sandboxed language (text, ``{{ value }}``, ``{% if %}``, ``{% for m in messages %}``, ``{% generation %}``) into a syntax
tree, folds constants and turns the tree into Python closures. Expressions know names, attributes of messages and the loop,
string and number literals, ``+``, comparisons, ``and``, ``or``, ``not`` and the filters below; there are no calls, imports or other attributes.
The loop over messages must be at the top level: what stands before it, its body and what follows it become three closures, so a
conversation is rendered message by message and never held as a whole.

Control strings inside texts are escaped: the first character of a control string, any backslashes and its rest get one more
backslash. No control string's rest holds another's first character, so undoing it is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches

CONTROL = ("<|turn|>", "<|end|>", "<|bos|>", "<s>", "</s>", "[INST]", "[/INST]")
TURNS = (
    "{% for m in messages %}{% if loop.first %}{{ '<|bos|>' }}{% endif %}{{ '<|turn|>' + (m.role | line) + '\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|end|>\n' }}{% endfor %}"
)
TURN_ROWS = 4096

_CONTROL = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def escape_line(text: str) -> str:
    """For a field that ends at a line break: backslashes and line breaks are escaped as well."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|()+<>]))")
_UNQUOTE = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


# Syntax tree: ("const", v), ("name", n), ("attr", node, n), ("op", symbol, a, b), ("not", a), ("filter", node, n);
# statements: ("emit", expression), ("if", [(condition, body)], otherwise), ("for", name, body), ("generation", body)


class _Expression:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _UNQUOTE.get(x[1], x[1]), m[1][1:-1], flags=re.S)))
            elif m[2]:
                self.tokens.append(("const", int(m[2])))
            else:
                self.tokens.append(("name", m[3]) if m[3] else ("sign", m[4]))
        self.tokens.append(("end", ""))

    def take(self, *wanted: tuple[str, str]) -> tuple | None:
        return self.tokens.pop(0) if self.tokens[0] in wanted else None

    def parse(self) -> tuple:
        tree = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take(("name", "or")):
            tree = ("op", "or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take(("name", "and")):
            tree = ("op", "and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self) -> tuple:
        tree = self.added()
        if sign := self.take(*(("sign", s) for s in ("==", "!=", "<", ">"))):
            tree = ("op", sign[1], tree, self.added())
        return tree

    def added(self) -> tuple:
        tree = self.filtered()
        while self.take(("sign", "+")):
            tree = ("op", "+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.value()
        while self.take(("sign", "|")):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", tree, name)
        return tree

    def value(self) -> tuple:
        kind, what = self.tokens.pop(0)
        if kind == "const":
            return ("const", what)
        if (kind, what) == ("sign", "("):
            tree = self.either()
            if not self.take(("sign", ")")):
                raise TemplateError("missing )")
            return tree
        if kind != "name":
            raise TemplateError(f"unexpected {what!r}")
        tree: tuple = ("name", what)
        while self.take(("sign", ".")):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no attribute {name!r}")
            tree = ("attr", tree, name)
        return tree


def parse(template: str) -> list[tuple]:
    """Syntax tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at:m.start()]))
        parts.append(("emit", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        while parts:
            kind, what = parts.pop(0)
            word = what.split(None, 1)[0] if kind == "tag" and what else ""
            if kind == "text":
                out.append(("emit", ("const", what)))
            elif kind == "emit":
                out.append(("emit", _Expression(what).parse()))
            elif word in ends:
                return out, what
            elif word == "if":
                arms, otherwise, head = [], [], what[2:]
                while True:
                    inner, end = body(("elif", "else", "endif"))
                    arms.append((_Expression(head).parse(), inner))
                    if end.startswith("elif"):
                        head = end[4:]
                        continue
                    if end == "else":
                        otherwise, _ = body(("endif",))
                    break
                out.append(("if", arms, otherwise))
            elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+messages", what)):
                out.append(("for", m[1], body(("endfor",))[0]))
            elif word == "generation":
                out.append(("generation", body(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unknown tag {what!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return body(())[0]


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def fold_value(tree: tuple) -> tuple:
    """Expression with its constant parts computed."""
    if tree[0] in ("attr", "not", "filter"):
        inner = fold_value(tree[1])
        if inner[0] == "const" and tree[0] == "not":
            return ("const", not inner[1])
        if inner[0] == "const" and tree[0] == "filter":
            return ("const", FILTERS[tree[2]](str(inner[1])))
        return (tree[0], inner, *tree[2:])
    if tree[0] == "op":
        a, b = fold_value(tree[2]), fold_value(tree[3])
        if a[0] == b[0] == "const":
            return ("const", _OPS[tree[1]](a[1], b[1]))
        return ("op", tree[1], a, b)
    return tree


def fold(body: list[tuple]) -> list[tuple]:
    """Statements with constants computed, dead branches removed and neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "emit":
            value = fold_value(node[1])
            if value[0] == "const" and out and out[-1][0] == "emit" and out[-1][1][0] == "const":
                out[-1] = ("emit", ("const", str(out[-1][1][1]) + str(value[1])))
            else:
                out.append(("emit", value))
        elif node[0] == "if":
            arms, otherwise = [], fold(node[2])
            for condition, inner in node[1]:
                condition = fold_value(condition)
                if condition[0] == "const" and condition[1]:
                    otherwise = fold(inner)
                    break
                if condition[0] != "const":
                    arms.append((condition, fold(inner)))
            out += [("if", arms, otherwise)] if arms else otherwise
        else:
            out.append((*node[:-1], fold(node[-1])))
    return out


@dataclass
class Output:
    """Rendered pieces of one message and the spans (code points) under the generation marker."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def emit(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda names, v=tree[1]: v
    if kind == "name":
        return lambda names, n=tree[1]: names.get(n, "")
    if kind == "attr":
        of = _value(tree[1])
        return lambda names, n=tree[2]: held.get(n, "") if isinstance(held := of(names), dict) else ""
    if kind == "not":
        of = _value(tree[1])
        return lambda names: not of(names)
    if kind == "filter":
        of, run = _value(tree[1]), FILTERS[tree[2]]
        return lambda names: run(str(of(names)))
    a, b, sign = _value(tree[2]), _value(tree[3]), tree[1]
    if sign == "and":
        return lambda names: a(names) and b(names)
    if sign == "or":
        return lambda names: a(names) or b(names)
    run = _OPS[sign]
    return lambda names: run(a(names), b(names))


Closure = Callable[[dict, Output], None]


def _statements(body: list[tuple]) -> Closure:
    steps = [_statement(node) for node in body]

    def run(names: dict, out: Output) -> None:
        for step in steps:
            step(names, out)

    return steps[0] if len(steps) == 1 else run


def _statement(node: tuple) -> Closure:
    if node[0] == "emit":
        value = _value(node[1])
        return lambda names, out: out.emit(str(value(names)))
    if node[0] == "if":
        arms, otherwise = [(_value(c), _statements(b)) for c, b in node[1]], _statements(node[2])

        def choose(names: dict, out: Output) -> None:
            for condition, inner in arms:
                if condition(names):
                    return inner(names, out)
            return otherwise(names, out)

        return choose
    if node[0] == "generation":
        inner = _statements(node[1])

        def marked(names: dict, out: Output) -> None:
            start = out.size
            inner(names, out)
            out.spans.append((start, out.size))

        return marked
    raise TemplateError("a loop over messages must be at the top level")


@dataclass(frozen=True)
class Template:
    before: Closure
    name: str
    each: Closure
    after: Closure

    def message(self, row: dict, index: int, last: bool) -> Output:
        """One message, with what stands before the loop for the first and after it for the last."""
        out, loop = Output(), {"first": index == 0, "last": last, "index": index + 1}
        if index == 0:
            self.before({}, out)
        self.each({self.name: row, "loop": loop}, out)
        if last:
            self.after({}, out)
        return out


def compile_template(text: str) -> Template:
    body = fold(parse(text))
    loops = [i for i, node in enumerate(body) if node[0] == "for"]
    if len(loops) != 1:
        raise TemplateError("a template has one loop over messages")
    at = loops[0]
    return Template(_statements(body[:at]), body[at][1], _statements(body[at][2]), _statements(body[at + 1:]))


def _flushes(rows: Iterator[dict], schema: pa.Schema, size: int = TURN_ROWS) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += len(row.get("formatted") or "")
        if len(held) >= size or weight > 1 << 24:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, TURN_ROWS):
            yield from batch.slice(at, TURN_ROWS).to_pylist()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED = "conv_id {id}, part long, formatted string, spans array<struct<start:long,end:long>>"


def format_conversations(rows: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, part, formatted, spans): each conversation's text in message order, one row per message, in order within a partition.

    ``rows`` has conv_id, turn, role and text. Messages are ordered by turn (nulls first), ties by role and text. A null role or text is empty;
    a null conv_id is a conversation of its own. Spans count code points from the row's start and cover what stands between generation
    markers. Repeated rows are repeated messages. Other columns are not read. A conversation of any length is streamed, one message in memory.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    chosen = bound_batches(rows).select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template)

        def messages() -> Iterator[dict]:
            index, held = 0, None
            for row in _rows(batches):
                if held is not None:
                    last = row["conv_id"] != held["conv_id"]
                    yield show(held, index, last)
                    index = 0 if last else index + 1
                held = row
            if held is not None:
                yield show(held, index, True)

        def show(row: dict, index: int, last: bool) -> dict:
            out = compiled.message(row, index, last)
            return {"conv_id": row["conv_id"], "part": index, "formatted": "".join(out.parts), "spans": [{"start": a, "end": b} for a, b in out.spans]}

        id_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
        yield from _flushes(messages(), pa.schema([("conv_id", id_kind), ("part", pa.int64()), ("formatted", pa.string()), ("spans", _SPANS)]))

    return dealt.mapInArrow(render, FORMATTED.format(id=kind))


_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output of :func:`format_conversations` with the default template says: turns, loss text and sizes per conversation.

    Works on that output as it comes (parts in order within a partition), message by message.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[dict]:
            state: dict | None = None
            for row in _rows(batches):
                if row["part"] == 0:
                    if state:
                        yield close(state)
                    state = {"conv_id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                text = row["formatted"]
                state["chars"] += len(text)
                for role, said in _TURN.findall(text):
                    state["n"] += 1
                    state["turns"].update(f"{unescape_line(role)}\n{unescape(said)}\n".encode("utf-8", "replace"))
                for span in row["spans"]:
                    said = unescape(text[span["start"]:span["end"]])
                    state["loss_chars"] += len(said)
                    state["loss"].update(said.encode("utf-8", "replace"))
            if state:
                yield close(state)

        def close(s: dict) -> dict:
            return {"conv_id": s["conv_id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["chars"]}

        yield from _flushes(conversations(), pa.schema([
            ("conv_id", id_kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    kind = formatted.schema["conv_id"].dataType.simpleString()
    id_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
