"""What retrieval indexes of a clause tree: materialised nodes, chunks and search documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import blank_to_null, node_header
from lexmill.operators.tree import below, joined_texts, lineage, own_text

CONTAINERS = ("phan", "chuong", "muc", "tieu_muc")


def materialised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles always; clauses, points and normative annexes where an edge ends at them; containers and templates never."""
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).filter("id is not null").select(_packed(F.col("id")).alias("end")).distinct()
    asked = nodes.filter(F.col("node_type").isin("khoan", "diem", "phu_luc") & ~F.coalesce(F.col("content_class") == "template", F.lit(False)))
    return nodes.filter("node_type = 'dieu'").unionByName(asked.join(ends, _packed(asked["id"]) == F.col("end"), "left_semi"))


def _packed(name: Column) -> Column:
    """An id as bytes, two hexadecimal digits in one; others as they are. A first byte tells them apart."""
    return F.when(name.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\x01"), F.unhex(name))).otherwise(F.concat(F.lit(b"\x00"), name.cast("binary")))


def _own(heading: bool = True) -> Column:
    header = node_header(F.col("label"), F.col("heading")) if heading else F.col("label")
    return F.concat_ws("\n", blank_to_null(header), blank_to_null(F.col("text_content")))


def chunks(nodes: DataFrame) -> DataFrame:
    """(id, document_id, path, text, content_hash): a chunk for each clause with its points, each article without
    clauses and each normative annex, after the headings of what it stands in. Containers and templates have none."""
    kind, own = F.col("node_type"), F.col("path")
    parent = F.regexp_extract(own, r"^(.*)\.[^.]*$", 1)
    lined = nodes.select("document_id", "path", "seq", "node_type", "content_class", _own().alias("own"), lineage(h=node_header(F.col("label"), F.col("heading"))).alias("line"))
    above = F.array_join(F.transform(F.filter("line", lambda a: a["path"] != own), lambda a: a["h"]), "\n")
    base = kind.isin("khoan", "dieu") | ((kind == "phu_luc") & (F.coalesce("content_class", F.lit("normative")) == "normative"))
    top = F.when(base, F.struct(own.alias("at"), "seq", above.alias("above"), "own", (kind == "dieu").alias("article"), F.lit(None).cast("string").alias("point"), F.lit(False).alias("clause")))
    none = F.lit(None).cast("string")
    below = F.when(kind.isin("khoan", "diem"), F.struct(parent.alias("at"), "seq", none.alias("above"), none.alias("own"), F.lit(None).cast("boolean").alias("article"), F.when(kind == "diem", F.col("own")).alias("point"), (kind == "khoan").alias("clause")))
    parts = lined.select("document_id", F.explode(F.filter(F.array(top, below), lambda p: p.isNotNull())).alias("p")).select("document_id", "p.*")
    # a base row and what stands right below it meet by the path
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("seq", F.col("point").alias("t"))))), lambda p: p["t"]), "\n")
    agg = parts.groupBy("document_id", F.col("at").alias("path")).agg(F.collect_list(F.when(F.col("article").isNotNull(), F.struct("seq", "above", "own", "article"))).alias("bases"), points.alias("points"), F.max("clause").alias("clauses"))
    rows = agg.withColumn("b", F.explode("bases")).filter(~(F.col("b.article") & F.col("clauses")))
    text = F.concat_ws("\n", blank_to_null(F.col("b.above")), blank_to_null(F.col("b.own")), blank_to_null(F.col("points")))
    return rows.select(F.concat_ws(":", "document_id", "path").alias("id"), "document_id", "path", "b.seq", text.alias("text")).withColumn("content_hash", F.sha2("text", 256))


def search_documents(nodes: DataFrame) -> DataFrame:
    """One row per article or normative annex: its heading, its clauses as an array in order, and all its text."""
    top = (F.col("node_type") == "dieu") | ((F.col("node_type") == "phu_luc") & (F.coalesce("content_class", F.lit("normative")) == "normative"))
    lined = nodes.withColumn("__line", lineage(top=F.coalesce(top, F.lit(False)), label=F.col("label"), heading=F.col("heading")))
    each = lined.withColumn("t", F.explode(F.filter("__line", lambda a: a["top"]))).withColumns({"__top": F.col("t.path"), "top_label": F.col("t.label"), "top_heading": F.col("t.heading")})
    clause = F.when(F.col("node_type") == "khoan", F.struct("seq", "ordinal", "text_content"))
    agg = each.groupBy("document_id", "__top", "top_label", "top_heading").agg(F.array_sort(F.collect_list(clause)).alias("khoan"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", _own().alias("t")))), lambda p: p["t"]), "\n").alias("body"))
    return agg.select(F.concat_ws(":", "document_id", "__top").alias("id"), "document_id", F.col("top_label").alias("label"), F.col("top_heading").alias("heading"), "khoan", "body")


def _normative(x: Column) -> Column:
    return (x["node_type"] == "phu_luc") & (F.coalesce(x["content_class"], F.lit("normative")) == "normative")


def tree_chunks(trees: DataFrame) -> DataFrame:
    """``chunks`` over the rows of ``body.clause_trees``: each text's chunks come from its own row, nothing is shuffled."""
    n = F.col("nodes")

    def chunk(x: Column) -> Column:
        above = F.array_join(F.transform(F.filter(x["line"], lambda i: i != x["seq"]), lambda i: node_header(F.get(n, i)["label"], F.get(n, i)["heading"])), "\n")
        points = joined_texts(F.filter(below(n, x), lambda y: (y["parent_seq"] == x["seq"]) & (y["node_type"] == "diem")))
        text = F.concat_ws("\n", blank_to_null(above), blank_to_null(own_text(x["label"], x["heading"], x["text_content"])), blank_to_null(points))
        return F.struct(x["path"].alias("path"), x["seq"].alias("seq"), text.alias("text"))

    clauses = lambda x: F.exists(below(n, x), lambda y: (y["parent_seq"] == x["seq"]) & (y["node_type"] == "khoan"))
    kept = F.filter(n, lambda x: (x["node_type"] == "khoan") | _normative(x) | ((x["node_type"] == "dieu") & ~clauses(x)))
    rows = trees.select("document_id", F.inline(F.transform(kept, chunk)))
    return rows.select(F.concat_ws(":", "document_id", "path").alias("id"), "document_id", "path", "seq", "text").withColumn("content_hash", F.sha2("text", 256))


def tree_search_documents(trees: DataFrame) -> DataFrame:
    """``search_documents`` over the rows of ``body.clause_trees``: nothing is shuffled."""
    n = F.col("nodes")

    def whole(x: Column) -> Column:
        inner = F.filter(below(n, x), lambda y: y["node_type"] == "khoan")
        khoan = F.transform(inner, lambda y: F.struct(y["seq"].alias("seq"), y["ordinal"].alias("ordinal"), y["text_content"].alias("text_content")))
        return F.struct(x["path"].alias("path"), x["label"].alias("label"), x["heading"].alias("heading"), khoan.alias("khoan"), joined_texts(below(n, x)).alias("body"))

    rows = trees.select("document_id", F.inline(F.transform(F.filter(n, lambda x: (x["node_type"] == "dieu") | _normative(x)), whole)))
    return rows.select(F.concat_ws(":", "document_id", "path").alias("id"), "document_id", "label", "heading", "khoan", "body")
