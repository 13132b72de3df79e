"""Turtle and N3 as raw statements. A file has prefixes that count for what follows, so it is read by one task; many
files are read side by side."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import BNODE, LITERAL, RAW, RAW_COLUMNS, RDF, RDF_TYPE, RESOURCE

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<uri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<at>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)"""
    r"""|(?P<number>[+-]?(?:\d+\.\d*|\.?\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<name>[\w.-]*:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*)|(?P<word>[A-Za-z]+)|(?P<sign>[.;,()\[\]])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}

Node = tuple[str, str]  # kind and URI, label or value


def unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), s)


class Reader:
    """Triples of a text, in the order of the text. ValueError where the text is no Turtle."""

    def __init__(self, text: str, scope: str = "") -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {text[at : at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.made, self.scope = 0, 0, scope
        self.prefixes: dict[str, str] = {"rdf": RDF}
        self.base = ""
        self.out: list[tuple[Node, str, Node]] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, want: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or (want is not None and token[1] != want):
            raise ValueError(f"{want or 'something'} is missing before {token[1]!r}")
        self.at += 1
        return token

    def fresh(self) -> Node:
        self.made += 1
        return BNODE, f"{self.scope}anon{self.made}"

    def uri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "uri":
            uri = unescape(text[1:-1])
            return uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else self.base + uri
        if kind == "name":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"prefix {prefix!r} is unknown")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"{text!r} is no URI")

    def node(self) -> Node:
        kind, text = self.peek()
        if text == "[":
            self.take()
            node = self.fresh()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if text == "(":
            return self.listed()
        self.take()
        if kind == "blank":
            return BNODE, self.scope + text[2:]
        if kind in ("text", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                self.take()
            elif self.peek()[0] == "type":
                self.take()
                self.uri(self.take())
            return LITERAL, value
        if kind == "number" or (kind == "word" and text in ("true", "false")):
            return LITERAL, text
        return RESOURCE, self.uri((kind, text))

    def listed(self) -> Node:
        self.take("(")
        items = []
        while self.peek()[1] != ")":
            items.append(self.node())
        self.take(")")
        rest: Node = (RESOURCE, RDF + "nil")
        for item in reversed(items):
            cell = self.fresh()
            self.out += [(cell, RDF + "first", item), (cell, RDF + "rest", rest)]
            rest = cell
        return rest

    def properties(self, subject: Node) -> None:
        while True:
            token = self.take()
            predicate = RDF_TYPE if token == ("word", "a") else self.uri(token)
            while True:
                self.out.append((subject, predicate, self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.tokens[self.at - 1][1] != ";":
                return

    def read(self) -> list[tuple[Node, str, Node]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            low = text.lower().lstrip("@")
            if (kind == "at" or kind == "word") and low in ("prefix", "base"):
                self.take()
                if low == "prefix":
                    name = self.take()[1].split(":")[0]
                    self.prefixes[name] = self.uri(self.take())
                else:
                    self.base = self.uri(self.take())
                if kind == "at":
                    self.take(".")
                continue
            alone = text == "["
            subject = self.node()
            if not (alone and self.peek()[1] == "."):
                self.properties(subject)
            self.take(".")
        return self.out


def parse(text: str, scope: str = "") -> list[tuple[Node, str, Node]]:
    return Reader(text, scope).read()


def read(spark: SparkSession, path: str, model: str | None) -> DataFrame:
    """Raw statements of Turtle files. Labels of blank nodes count within their file. An unreadable file is an error that
    names what stands there."""
    types = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for k, ((sk, s), p, (ok, o)) in enumerate(parse(data.decode("utf-8-sig"), f"{name}|")):
                    literal = ok == LITERAL
                    rows.append((model, None, k + 1, sk, s, p, ok, None if literal else o, o if literal else None, None, None, None, None))
                cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 13
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], RAW_COLUMNS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RAW)
