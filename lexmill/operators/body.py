"""Statute text to structure: the clause tree, and citations in preambles and running text.

The tree of a text is made in three steps, each over all lines: every line is classified by one table of line forms;
the classified lines are cut into the main part, the closing block and the annexes; then the main part's headings take
their places on a spine of seven levels. A node comes out with its path, so no later step has to look for ancestors.
Texts are read where they lie, on Arrow batches, and nothing is shuffled. Citations are found by Column expressions.
``legacy`` gives the parity form of the rules that the default form corrects.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexmill.functions import citations
from lexmill.functions.hashing import node_hash, stable_id
from lexmill.functions.text import roman_value

#: fixed values: the levels of nesting, outermost first
LEVELS = ("phan", "chuong", "muc", "tieu_muc", "dieu", "khoan", "diem")
_LEVEL = {kind: i for i, kind in enumerate(LEVELS)}
ARTICLE, CLAUSE, POINT = (LEVELS.index(k) for k in ("dieu", "khoan", "diem"))
#: fixed values: kind of a heading, its word, and the form of its number
HEADINGS = [
    ("phu_luc", "Phụ lục", "roman or none"),
    ("dieu", "Điều", "digits and letter"),
    ("phan", "Phần", "roman or digits"),
    ("chuong", "Chương", "roman or digits"),
    ("tieu_muc", "Tiểu mục", "digits"),
    ("muc", "Mục", "digits"),
]
#: fixed values: how the closing block begins, and the whole lines that end it
CLOSING = ("Nơi nhận", "TM. ", "KT. ", "Q. ", "THAY MẶT")
STATE_HEADER = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"
FORM_WORDS = ("Biểu số", "Biểu mẫu", "Mẫu số", "QCVN", "TCVN")
TEMPLATE_WORDS = "mẫu số"
_HEADS = {kind for kind, *_ in HEADINGS}
_BEGINS = _HEADS | {"closing", "khoan", "diem"}


class Line(NamedTuple):
    """A line's kind, the word and number of its heading, and what follows them; ``text`` is the whole line."""

    kind: str
    word: str
    number: str
    rest: str
    text: str


def _spaced(words: str) -> str:
    return re.escape(words).replace(r"\ ", r"\s+")


@cache
def _forms(legacy: bool) -> list[tuple[str, re.Pattern]]:
    """(kind, form of the line) in the order in which they are tried. In the parity form a number ends at an ASCII word edge, so a letter with marks may follow it."""
    edge = r"(?![0-9A-Za-z_])" if legacy else r"(?!\w)"
    numbers = {
        "roman or none": rf"\s*(?P<number>[IVXLCDM]*){edge}",
        "roman or digits": rf"\s+(?P<number>[IVXLCDM]+|\d+){edge}",
        "digits": rf"\s+(?P<number>\d+){edge}",
        "digits and letter": r"\s+(?P<number>\d+[a-zđ]?)\s*",
    }
    opening = "|".join(_spaced(w.strip()) + (r"\s" if w.endswith(" ") else r"(?![0-9A-Za-z_])" if w.isupper() else "") for w in CLOSING)
    forms = {kind: rf"(?P<word>{_spaced(word)}){numbers[number]}[.:]?\s*(?P<rest>.*)" for kind, word, number in HEADINGS}
    order = [("phu_luc", forms.pop("phu_luc")), ("closing", rf"(?P<word>(?:{opening}))(?P<number>)(?P<rest>.*)"), *forms.items()]
    out = [(kind, re.compile(form, re.IGNORECASE)) for kind, form in order]
    out.append(("khoan", re.compile(r"(?P<word>)(?P<number>\d+[a-zđ]?)\s*\.\s*(?P<rest>.*)")))
    out.append(("diem", re.compile(r"(?P<word>)(?P<number>[a-zđ])\)\s*(?P<rest>.*)", re.IGNORECASE)))
    return out


_REOPENS = re.compile(rf"(?:{_spaced(STATE_HEADER)}|(?:{'|'.join(map(_spaced, FORM_WORDS))})\s*[\dA-ZĐ][\dA-ZĐ.:/-]*)\s*", re.IGNORECASE)
#: what the forms' lines begin with
_FIRSTS = {kind: re.compile(re.escape(word[0]), re.IGNORECASE) for kind, word, _ in HEADINGS} | {"closing": re.compile("|".join(w[0] for w in CLOSING), re.IGNORECASE), "khoan": re.compile(r"\d"), "diem": re.compile("[a-zđ]", re.IGNORECASE)}


@lru_cache(1 << 16)
def _forms_at(first: str, legacy: bool) -> list[tuple[str, Callable]]:
    """The forms that a line with that first character can have."""
    return [(kind, form.fullmatch) for kind, form in _forms(legacy) if _FIRSTS[kind].match(first)]


@lru_cache(1 << 15)
def _line(line: str, legacy: bool) -> Line:
    """A line that isn't blank, with its kind. Lines that texts share are classified once."""
    for kind, fits in _forms_at(line[0], legacy):
        if m := fits(line):
            word, number, rest = m.group("word", "number", "rest")
            return Line(kind, word, number, rest.strip(), line)
    return Line("text", "", "", "", line)


def classify(text: str | None, legacy: bool = False) -> list[Line]:
    """The lines of a text that aren't blank, each with its kind; ``text`` where no form fits."""
    return [_line(line, legacy) for raw in (text or "").split("\n") if (line := raw.strip())]


def _titles(lines: list[Line], legacy: bool) -> dict[int, str]:
    """Titles that stand on the line after their heading, by the number of that line. Headings end the search, in the
    default form also clauses, points and the closing block; so do lines in parentheses."""
    begins = _HEADS if legacy else _BEGINS
    return {i + 1: after.text for i, (line, after) in enumerate(zip(lines, lines[1:])) if not line.rest and line.kind in _HEADS and after.kind not in begins and not after.text.startswith("(")}


def _regions(lines: list[Line], titles: dict[int, str]) -> tuple[int, list[int]]:
    """(end of the main part, first lines of the annexes). The main part ends at the first annex or closing block; after
    a closing block the first annex may also be a form or a restated state header."""
    end = next((i for i, line in enumerate(lines) if line.kind == "phu_luc" or (line.kind == "closing" and i not in titles)), len(lines))
    closed = end < len(lines) and lines[end].kind == "closing"
    first = next((i for i in range(end, len(lines)) if lines[i].kind == "phu_luc" or (closed and i > end and _REOPENS.fullmatch(lines[i].text))), len(lines))
    return end, [i for i in range(first, len(lines)) if i == first or lines[i].kind == "phu_luc"]


def _main(lines: list[Line], end: int, titles: dict[int, str]) -> list[tuple]:
    """Nodes of the main part, with their parents' numbers: kind, ordinal, label, heading, lines, content class, parent.
    The spine holds the last node of each level that is still open."""
    spine: list[int | None] = [None] * len(LEVELS)
    deepest, out, parts = -1, [], None
    for i, (kind, word, number, rest, text) in enumerate(lines[:end]):
        if i in titles:
            continue
        level = _LEVEL.get(kind, -1)
        if level < 0 or (level > ARTICLE and deepest < level - 1):
            if parts is not None:
                parts.append(text)
            continue
        above = next((p for p in spine[level - 1 :: -1] if p is not None), None) if level else None
        if level > ARTICLE:
            ordinal, label, heading, parts = number, f"{'Khoản' if level == CLAUSE else 'Điểm'} {number}", None, [rest] if rest else []
        else:
            ordinal, label = (number, f"Điều {number}") if level == ARTICLE else (roman_value(number), f"{word} {number}")
            heading, parts = rest or titles.get(i + 1) or None, []
        spine[level:] = [len(out)] + [None] * (len(LEVELS) - level - 1)
        deepest = level
        out.append((kind, ordinal, label, heading, parts, None, above))
    return out


def _annexes(lines: list[Line], firsts: list[int], titles: dict[int, str]) -> Iterator[tuple]:
    for n, (first, stop) in enumerate(zip(firsts, [*firsts[1:], len(lines)]), 1):
        line = lines[first]
        if line.kind == "phu_luc":
            heading = line.rest or titles.get(first + 1) or None
            parts = [lines[i].text for i in range(first + 1, stop) if line.rest or i != first + 1 or i not in titles]
            named = f"{line.word} {line.number}" if line.number else line.word
            kind = "template" if heading and re.search(_spaced(TEMPLATE_WORDS), heading, re.IGNORECASE) else "normative"
            yield "phu_luc", roman_value(line.number) if line.number else str(n), named, heading, parts, kind, None
        else:
            yield "phu_luc", str(n), f"Phụ lục {n}", None, [x.text for x in lines[first:stop]], "normative", None


@lru_cache(1 << 12)
def _segment(kind: str, ordinal: str, legacy: bool) -> str:
    return kind + re.sub("[^A-Za-z0-9_]", "", ordinal if legacy else re.sub("[đĐ]", "dd", ordinal))


def parse_body(text: str | None, legacy: bool = False) -> list[dict]:
    """The nodes of a text in document order: seq, parent_seq, node_type, ordinal, label, heading, text_content,
    content_class, path, parent_path. Later siblings of one name get a suffix in their paths, but not in the parity form.

    Lines before the first heading are left out, and so is the closing block up to an annex."""
    columns: list[list] = [[] for _ in TREE.names]
    _put(text, legacy, columns)
    return [dict(zip(TREE.names, row)) for row in zip(*columns)]


def _put(text: str | None, legacy: bool, columns: list[list]) -> int:
    """Appends the nodes' values to the columns of TREE; returns how many nodes there are."""
    lines = classify(text, legacy)
    titles = _titles(lines, legacy)
    end, firsts = _regions(lines, titles)
    nodes = _main(lines, end, titles)
    nodes += _annexes(lines, firsts, titles)
    seen: dict = {}
    paths: list[str] = []
    seqs, ups, kinds, ordinals, labels, headings, contents, classes, full, heads = columns
    for seq, (kind, ordinal, label, heading, parts, content_class, up) in enumerate(nodes):
        name = _segment(kind, ordinal, legacy)
        n = seen[up, name] = seen.get((up, name), 0) + 1
        if n > 1 and not legacy:
            name = f"{name}_{n}"
        above = None if up is None else paths[up]
        path = f"{above}.{name}" if above else name
        paths.append(path)
        seqs.append(seq)
        ups.append(up)
        kinds.append(kind)
        ordinals.append(ordinal)
        labels.append(label)
        headings.append(heading)
        contents.append("\n".join(parts) or None)
        classes.append(content_class)
        full.append(path)
        heads.append(above)
    return len(nodes)


TREE = T.StructType([T.StructField(n, T.IntegerType() if n in ("seq", "parent_seq") else T.StringType()) for n in ("seq", "parent_seq", "node_type", "ordinal", "label", "heading", "text_content", "content_class", "path", "parent_path")])


def clause_nodes(docs: DataFrame, key: str = "document_id", text: str = "full_text", legacy: bool = False) -> DataFrame:
    """The key and the nodes of each text. Texts don't leave the worker."""
    schema = T.StructType([docs.schema[key], *TREE.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in TREE.names]
            sizes = [_put(t, legacy, columns) for t in batch.column(1).to_pylist()]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys.cast(arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


#: a node within its text: where it stands, its ancestors and itself by number, and the last node below it
SPAN = T.StructType([*TREE.fields, T.StructField("line", T.ArrayType(T.IntegerType())), T.StructField("stop", T.IntegerType())])


def _spans(ups: list[int | None]) -> tuple[list[list[int]], list[int]]:
    """Of the nodes of a text, told by their parents' numbers: ancestors and itself, outermost first, and the last node of the
    subtree. Nodes come depth first, so a subtree is a run of them."""
    lines: list[list[int]] = []
    stops = list(range(len(ups)))
    for i, up in enumerate(ups):
        lines.append([i] if up is None else [*lines[up], i])
    for i in range(len(ups) - 1, -1, -1):
        if ups[i] is not None:
            stops[ups[i]] = max(stops[ups[i]], stops[i])
    return lines, stops


def clause_trees(docs: DataFrame, key: str = "document_id", text: str = "full_text", legacy: bool = False) -> DataFrame:
    """(key, nodes): a row per text with its nodes in document order as an array of SPAN, so that what is asked of one text
    alone needs no shuffle. Texts that share a key stay apart."""
    schema = T.StructType([docs.schema[key], T.StructField("nodes", T.ArrayType(SPAN))])
    arrow = to_arrow_schema(schema)
    kinds = {f.name: f for f in arrow.field(1).type.value_type}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in TREE.names]
            sizes = [_put(t, legacy, columns) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *sizes])
            lines, stops = [], []
            for a, b in zip(ends, ends[1:]):
                line, stop = _spans(columns[1][a:b])
                lines += line
                stops += stop
            parts = [pa.array(c, kinds[name].type) for name, c in zip(SPAN.names, [*columns, lines, stops])]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kinds.values())))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), nodes.cast(arrow.field(1).type)], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def with_paths(nodes: DataFrame, key: str = "document_id", legacy: bool = False) -> DataFrame:
    """Nodes with id, parent_id and content_hash, all from columns of their own rows: no join, no shuffle."""
    name = lambda path, seq: stable_id(F.col(key).cast("string"), F.col(path), F.col(seq) if legacy else F.lit(None))
    above = F.when(F.col("parent_path").isNotNull(), name("parent_path", "parent_seq"))
    return nodes.withColumns({"id": name("path", "seq"), "parent_id": above, "content_hash": node_hash(F.col("label"), F.col("heading"), F.col("text_content"))}).drop("parent_path")


def references_sql(text: str, own: str, legacy: bool = False) -> str:
    """SQL for an array of (citation, context): the citations after the first chapter heading, each once, in order, with
    the words around its first place; the document's own is left out.

    The body is cut at its citations once. What stands around one is made of the cuts next to it, of each of which no more
    than a window is kept, so the work grows with the text, not with text times citations."""
    form, w = citations.LEGACY_BODY_CITATION if legacy else citations.BODY_CITATION, citations.WINDOW
    near = w // citations.SHORTEST + 1
    body = f"transform(filter(array(split({text}, r'{citations.CHAPTER_START}', 2)), p -> size(p) > 1), p -> p[1])"
    cut = f"struct(regexp_extract_all(b, r'{form}', 0) as hits, split(b, r'{form}') as gaps)"
    ends = f"struct(c.hits as hits, transform(c.gaps, g -> left(g, {w})) as heads, transform(c.gaps, g -> right(g, {w})) as tails, array_sort(transform(c.hits, (h, i) -> struct(h, i))) as named)"
    firsts = f"array_sort(transform(filter(d.named, (x, k) -> not (x.h <=> {own}) and (k = 0 or d.named[k - 1].h <> x.h)), x -> x.i))"
    before = f"array_join(flatten(transform(sequence(greatest(0, i - {near}), i), j -> array(if(j > 0, d.hits[j - 1], ''), d.tails[j]))), '')"
    after = f"array_join(flatten(transform(sequence(i + 1, least(i + {near}, size(d.hits))), j -> array(d.heads[j], if(j < size(d.hits), d.hits[j], '')))), '')"
    around = f"regexp_replace(lower(concat(right({before}, {w}), d.hits[i], left({after}, {w}))), r'(?U)^\\s+|\\s+$', '')"
    found = f"transform({firsts}, i -> struct(d.hits[i] as citation, {around} as context))"
    steps = f"flatten(transform(array({cut}), c -> flatten(transform(array({ends}), d -> {found}))))"
    return f"flatten(transform({body}, b -> {steps}))"


def basis_references(docs: DataFrame, key: str = "document_id", text: str = "full_text") -> DataFrame:
    """(key, reference_type, change_type, citation, raw_citation_text) from the preamble's basis lines."""
    lines = docs.select(key, F.explode(F.split(citations.preamble(F.col(text)), "\n")).alias("line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    basis = lines.filter(F.lower("line").startswith(citations.BASIS_WORDS)).withColumn("citation", citations.citation_in_text(F.col("line"))).filter("citation is not null")
    return basis.select(key, F.lit("has_basis").alias("reference_type"), F.lit(None).cast("string").alias("change_type"), "citation", F.col("line").alias("raw_citation_text"))


def body_references(docs: DataFrame, key: str = "document_id", text: str = "full_text", own: str = "citation_id", legacy: bool = False) -> DataFrame:
    """The same columns from the body; no reference of it is a basis."""
    found = docs.select(key, F.explode(F.expr(references_sql(f"`{text}`", f"`{own}`", legacy))).alias("r"))
    return found.select(key, citations.classify_reference(F.col("r.context")).alias("reference_type"), F.lit(None).cast("string").alias("change_type"), "r.citation", F.col("r.context").alias("raw_citation_text"))


def text_references(docs: DataFrame, key: str = "document_id", text: str = "full_text", own: str = "citation_id", legacy: bool = False) -> DataFrame:
    """(key, reference_type, change_type, citation, raw_citation_text) from the preamble's basis lines and the body."""
    return basis_references(docs, key, text).unionByName(body_references(docs, key, text, own, legacy))


def register(spark: SparkSession) -> None:
    """Table functions of SQL: parse_document_body(text) and extract_body_references(text, own citation)."""

    class ParseBody:
        def eval(self, text: str):
            for r in parse_body(text):
                yield tuple(r.values())

    spark.udtf.register("parse_document_body", F.udtf(ParseBody, returnType=TREE))
    spark.sql(
        "create or replace temporary function extract_body_references(t string, own string) returns table (citation string, context string) "
        f"return select r.citation, r.context from (select explode({references_sql('t', 'own')}) as r)"
    )
