"""RDF text as quads: N-Triples and N-Quads line by line with Spark, small Turtle and TriG documents with
a parser on the driver.

Blank-node labels belong to their source: they are prefixed with its name, so that equal labels of two
sources are different nodes.  Triples without a graph go into ``graph`` (the source's own IRI by default).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import LANG_STRING, STRING, TYPE, XSD, key_of
from .mapping import COLUMNS

#: Bytes of Turtle or TriG that the driver parses at most.
MOST_BYTES = 64 << 20
SCHEMA = "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def as_quads(terms: DataFrame) -> DataFrame:
    """Quads (a set) of rows in SCHEMA."""
    language = F.lower("o_lang")
    datatype = F.when(F.col("o_kind") == "literal", F.when(language.isNotNull(), F.lit(LANG_STRING)).otherwise(F.coalesce("o_dt", F.lit(STRING))))
    rows = terms.withColumns({"o_dt": datatype, "o_lang": language})
    return rows.withColumn("o_key", key_of(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))).select(*COLUMNS).dropDuplicates(["g", "s", "s_kind", "p", "o_key"])


_IRI, _NODE = r"<([^>\x00-\x20]*)>", r"_:([^\s\x1f]*[^\s\x1f.])"
_SUBJECT = rf"(?:{_IRI}|{_NODE})"
#: Groups: subject (2), property, object (2), its quotes, text, datatype, language, graph (2).
_LINE = rf"^\s*{_SUBJECT}\s*{_IRI}\s*(?:{_IRI}|{_NODE}|(\")((?:[^\"\\]|\\.)*)\"(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*(?:{_IRI}|{_NODE})?\s*\.\s*(?:#.*)?$"
#: What the line becomes: the groups in this order, the text last, since only it may hold the sign between them.
_ORDER = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 7)
_BETWEEN = "\x1f"
_ESCAPES = r"(\\[uU][dD][89abAB][0-9a-fA-F]{2}\\[uU][dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\.|[^\\]+)"
#: Escapes of one character.
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text):
    """A text without escapes: short ones, \\u (pairs of surrogates too) and \\U of any plane."""

    def plain(t):
        sign = F.substring(t, 2, 1)
        short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _SHORT.items() for x in pair]), sign), sign)
        pair = F.decode(F.unhex(F.concat(F.substring(t, 3, 4), F.substring(t, 9, 4))), "UTF-16BE")
        four = F.decode(F.unhex(F.substring(t, 3, 4)), "UTF-16BE")
        eight = F.decode(F.unhex(F.substring(t, 3, 8)), "UTF-32")
        return F.when(~t.startswith("\\"), t).when(F.length(t) == 12, pair).when(F.length(t) == 10, eight).when(F.length(t) == 6, four).otherwise(short)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ESCAPES), F.lit(1)), plain), "")).otherwise(text)


def read_lines(spark: SparkSession, path: str, graph: str | None = None, strict: bool = True) -> DataFrame:
    """N-Triples or N-Quads, any size.  A line that is neither, nor empty, nor a comment is an error, or
    with ``strict`` false left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    # one match of the line, whatever its number of terms
    parts = F.split(F.regexp_replace("value", _LINE, _BETWEEN.join(f"${k}" for k in _ORDER) + _BETWEEN), _BETWEEN, len(_ORDER))
    lines = lines.select("file", "value", parts.alias("x"))
    fits = F.size("x") == len(_ORDER)
    if strict:
        lines = lines.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.col("value"))).cast("boolean")))
    else:
        lines = lines.where(fits)
    part = lambda k: F.nullif(F.col("x")[_ORDER.index(k)], F.lit(""))
    iri = lambda k: _unescaped(part(k))
    node = lambda label: F.concat(F.substring(F.md5("file"), 1, 8), F.lit("_"), label)
    literal, last = part(6).isNotNull(), F.col("x")[len(_ORDER) - 1]
    text = _unescaped(F.substring(last, F.lit(1), F.length(last) - 1))  # the sign after it
    rows = lines.select(
        F.coalesce(iri(10), F.concat(F.lit("_:"), node(part(11))), F.lit(graph) if graph else F.col("file")).alias("g"),
        F.coalesce(iri(1), node(part(2))).alias("s"),
        F.when(part(1).isNotNull(), "iri").otherwise("bnode").alias("s_kind"),
        iri(3).alias("p"),
        F.when(literal, text).otherwise(F.coalesce(iri(4), node(part(5)))).alias("o"),
        F.when(literal, "literal").when(part(4).isNotNull(), "iri").otherwise("bnode").alias("o_kind"),
        iri(8).alias("o_dt"),
        part(9).alias("o_lang"),
    )
    return as_quads(rows)


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<node>_:[\w][\w.-]*(?<!\.))
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[\w](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:%.-]|\\.)*(?:[\w:%-]|\\.))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>\^\^|[.;,\[\](){}=])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


class TurtleParser:
    """Turtle and TriG: prefixes and bases, ``a``, ``;`` and ``,``, blank-node property lists, collections,
    typed and tagged literals, numbers, booleans, graph blocks."""

    def __init__(self, text: str, graph: str, scope: str):
        self.tokens = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"not understood: {text[at : at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.graph, self.scope = 0, graph, scope
        self.prefixes: dict[str, str] = {}
        self.base, self.fresh = "", 0
        self.rows: list[tuple] = []

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or (sign and token[1] != sign):
            raise ValueError(f"expected {sign or 'a term'}, found {token[1]!r}")
        self.at += 1
        return token

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("prefix", "base", "@prefix", "@base"):
                self.directive()
            elif text == "{" or text.lower() == "graph":
                if text != "{":
                    self.take()
                self.block(self.graph if self.peek()[1] == "{" else self.node()[0])
            elif kind in ("iri", "name", "node") and self.peek(1)[1] == "{":
                self.block(self.node()[0])
            else:
                self.triples(self.graph)
                self.take(".")
        return self.rows

    def directive(self) -> None:
        word = self.take()[1].lower()
        if word.endswith("prefix"):
            name = self.take()[1]
            self.prefixes[name.rstrip(":")] = self.iri(self.take()[1])
        else:
            self.base = self.iri(self.take()[1])
        if word[0] == "@":
            self.take(".")

    def block(self, graph: str) -> None:
        self.take("{")
        while self.peek()[1] != "}":
            self.triples(graph)
            if self.peek()[1] == ".":
                self.take()
        self.take("}")

    def iri(self, text: str) -> str:
        iri = _plain(text[1:-1])
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri

    def blank(self, label: str | None = None) -> tuple[str, str]:
        if label is None:
            self.fresh += 1
            label = f"gen{self.fresh}"
        return f"{self.scope}_{label}", "bnode"

    def node(self) -> tuple[str, str]:
        kind, text = self.take()
        if kind == "iri":
            return self.iri(text), "iri"
        if kind == "node":
            return self.blank(text[2:])
        if kind == "name":
            prefix, _, rest = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest), "iri"
        raise ValueError(f"expected a node, found {text!r}")

    def triples(self, graph: str) -> None:
        if self.peek()[1] == "[":
            s = self.object(graph)[:2]
            if self.peek()[1] in (".", "}"):
                return
        elif self.peek()[1] == "(":
            s = self.object(graph)[:2]
        else:
            s = self.node()
        self.properties(graph, s)

    def properties(self, graph: str, s: tuple[str, str]) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.take()
                p = TYPE
            else:
                p, kind = self.node()
                if kind != "iri":
                    raise ValueError("a property has to be an IRI")
            while True:
                self.rows.append((graph, *s, p, *self.object(graph)))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                more = self.peek()[1] not in (".", "]", "}", ";")
                if more:
                    break
            else:
                return
            if not more:
                return

    def object(self, graph: str) -> tuple[str, str, str | None, str | None]:
        kind, text = self.peek()
        if text == "[":
            self.take()
            node = self.blank()
            if self.peek()[1] != "]":
                self.properties(graph, node)
            self.take("]")
            return (*node, None, None)
        if text == "(":
            return (*self.collection(graph), None, None)
        if kind in ("text", "long"):
            self.take()
            quotes = 3 if kind == "long" else 1
            value = _plain(text[quotes:-quotes])
            if self.peek()[0] == "lang":
                return value, "literal", None, self.take()[1][1:]
            if self.peek()[1] == "^^":
                self.take()
                return value, "literal", self.node()[0], None
            return value, "literal", STRING, None
        if kind == "number":
            self.take()
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if kind == "word" and text in ("true", "false"):
            self.take()
            return text, "literal", XSD + "boolean", None
        return (*self.node(), None, None)

    def collection(self, graph: str) -> tuple[str, str]:
        from ..functions.vocabulary import RDF

        self.take("(")
        head = previous = None
        while self.peek()[1] != ")":
            cell = self.blank()
            if previous is None:
                head = cell
            else:
                self.rows.append((graph, *previous, RDF + "rest", *cell, None, None))
            self.rows.append((graph, *cell, RDF + "first", *self.object(graph)))
            previous = cell
        self.take(")")
        if previous is None:
            return RDF + "nil", "iri"
        self.rows.append((graph, *previous, RDF + "rest", RDF + "nil", "iri", None, None))
        return head


def parse(text: str, graph: str = "file:", scope: str = "b") -> list[tuple]:
    """Rows in SCHEMA of a Turtle or TriG document."""
    return TurtleParser(text, graph, scope).parse()


def read_document(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Small Turtle or TriG documents, read through Spark, parsed on the driver.  One of more than
    ``MOST_BYTES``, or many that come to more, is refused: such data belong into N-Quads."""
    import hashlib

    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length"), F.count("*")).first()
    if not size[1]:
        raise ValueError(f"no document at {path}")
    if size[0] > MOST_BYTES:
        raise ValueError(f"{size[0]} bytes of Turtle or TriG at {path} are more than {MOST_BYTES}; convert them to N-Triples or N-Quads")
    found = files.select("path", "content").collect()
    rows = [row for f in found for row in parse(bytes(f.content).decode(), graph or f.path, hashlib.md5(f.path.encode()).hexdigest()[:8])]
    return as_quads(spark.createDataFrame(rows, SCHEMA))


def read(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads by the path's extension: nt, nq (with or without gz), ttl, trig, parquet or json."""
    ending = re.sub(r"\.(gz|bz2)$", "", path.rstrip("/")).rpartition(".")[2].lower()
    if ending in ("nt", "nq"):
        return read_lines(spark, path, graph)
    if ending in ("ttl", "trig"):
        return read_document(spark, path, graph)
    if ending == "json":
        return as_quads(spark.read.schema(SCHEMA).json(path))
    return spark.read.parquet(path).select(*COLUMNS)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, **options) -> DataFrame:
    """Quads of a relational table in SCHEMA, e.g. split by ``column``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``."""
    return as_quads(spark.read.jdbc(url, table, properties=properties or {}, **options))


def ntriples(rows: DataFrame) -> DataFrame:
    """One column of N-Triples lines (N-Quads with a column ``g``) of rows with s, s_kind, p, o, o_kind,
    o_dt and maybe o_lang."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    node = lambda kind, v: F.when(kind == "iri", F.concat(F.lit("<"), v, F.lit(">"))).otherwise(F.concat(F.lit("_:"), v))
    language = F.col("o_lang") if "o_lang" in rows.columns else F.lit(None).cast("string")
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), F.when(language.isNotNull(), F.concat(F.lit("@"), language)).when(F.col("o_dt") == STRING, "").otherwise(F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))))
    end = F.concat(F.lit(" "), node(F.lit("iri"), F.col("g")), F.lit(" .")) if "g" in rows.columns else F.lit(" .")
    return rows.select(F.concat(node(F.col("s_kind"), F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o_kind"), F.col("o"))), end).alias("value"))


def turtle(rows: Iterator[tuple], prefixes: dict[str, str]) -> str:
    """A Turtle document of (s, s_kind, p, o, o_kind, o_dt, o_lang) rows, grouped by subject."""
    used = sorted(prefixes.items(), key=lambda e: -len(e[1]))

    def name(iri: str) -> str:
        if iri == TYPE:
            return "a"
        for prefix, ns in used:
            rest = iri[len(ns) :]
            if iri.startswith(ns) and re.fullmatch(r"[A-Za-z_][\w-]*", rest):
                return f"{prefix}:{rest}"
        return f"<{iri}>"

    def term(value: str, kind: str, datatype: str | None = None, language: str | None = None) -> str:
        if kind == "iri":
            return name(value).replace("a", f"<{TYPE}>", 1) if value == TYPE else name(value)
        if kind == "bnode":
            return f"_:{value}"
        text = '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
        if language:
            return f"{text}@{language}"
        if datatype == XSD + "integer" and re.fullmatch(r"[+-]?\d+", value):
            return value
        return text if datatype in (None, STRING) else f"{text}^^{name(datatype)}"

    out = [f"@prefix {p}: <{ns}> .\n" for p, ns in prefixes.items()] + ["\n"]
    by: dict[tuple[str, str], dict[str, list[str]]] = {}
    for s, s_kind, p, o, o_kind, datatype, language in rows:
        by.setdefault((s, s_kind), {}).setdefault(p, []).append(term(o, o_kind, datatype, language))
    for (s, s_kind), properties in sorted(by.items()):
        order = sorted(properties.items(), key=lambda e: (e[0] != TYPE, e[0]))
        out.append(term(s, s_kind) + " " + " ;\n    ".join(f"{name(p)} {', '.join(sorted(objects))}" for p, objects in order) + " .\n")
    return "".join(out)
