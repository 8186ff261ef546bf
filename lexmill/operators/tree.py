"""Clause trees kept flat: paths as arrays of labels, whole-subtree texts, pruning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import blank_to_null, node_header


def path_array(path: Column) -> Column:
    """Compared as arrays, paths order label by label."""
    return F.split(path, r"\.")


def ancestors(path: Column, itself: bool = False) -> Column:
    """All paths above a path, nearest last."""
    parts = path_array(path)
    n = F.size(parts) if itself else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, 1, k), "."))).otherwise(F.array().cast("array<string>"))


#: labels of a path, at most: seven of a text's main part
LEVELS = 8


def lineage(doc: str = "document_id", order: str = "seq", levels: int = LEVELS, **values: Column) -> Column:
    """Array of structs (path and the values) of a node's ancestors and itself, outermost first, as a window over its document.

    Nodes stand in document order, so of each level the last one up to a node is its ancestor if it is on the node's
    path. A document is sorted once; nothing is joined. A path of more than ``levels`` labels fails the query."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.col("path")
    depth = F.size(path_array(path))
    one = F.struct(path.alias("path"), *(v.alias(k) for k, v in values.items()))
    last = F.array(*(F.last(F.when(depth == n, one), True).over(w) for n in range(1, levels + 1)))
    own = F.filter(last, lambda a: (a["path"] == path) | path.startswith(F.concat(a["path"], F.lit("."))))
    return F.when(depth <= levels, own).otherwise(F.raise_error(F.concat(F.lit(f"more than {levels} labels: "), path)))


def full_texts(nodes: DataFrame, doc: str = "document_id", order: str = "seq") -> DataFrame:
    """Each node with the text of its whole subtree: headers and own texts, in order, one per line.

    A node's text goes to each of its ancestors, of which there are at most eight levels, and meets them in one grouping:
    no join is made. order is ``seq`` for document order or ``path`` for label order."""
    own = own_text(F.col("label"), F.col("heading"), F.col("text_content"))
    by = path_array(F.col("path")) if order == "path" else F.col(order)
    each = nodes.withColumn("__at", F.explode(ancestors(F.col("path"), itself=True)))
    parts = each.select(F.col(doc).alias("__doc"), "__at", F.struct(by.alias("by"), own.alias("text")).alias("part"), F.when(F.col("__at") == F.col("path"), F.struct(*nodes.columns)).alias("node"))
    texts = parts.groupBy("__doc", "__at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "\n").alias("full_text"), F.collect_list("node").alias("nodes"))
    return texts.select(F.explode("nodes").alias("node"), "full_text").select("node.*", "full_text").select(doc, "path", *(c for c in nodes.columns if c not in (doc, "path")), "full_text")


def own_text(label: Column, heading: Column, text: Column) -> Column:
    """A node's header and own text, one per line; empty if it has neither."""
    return F.concat_ws("\n", blank_to_null(node_header(label, heading)), blank_to_null(text))


def below(nodes: Column, node: Column) -> Column:
    """A node of ``body.clause_trees`` and all below it, in order: a slice of its text's nodes."""
    return F.slice(nodes, node["seq"] + 1, node["stop"] - node["seq"] + 1)


def joined_texts(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: own_text(x["label"], x["heading"], x["text_content"])), "\n")


def matched_texts(trees: DataFrame, match: Callable[[Column], Column], doc: str = "document_id") -> DataFrame:
    """(doc, path, full_text): ``full_texts`` of what ``pruned`` leaves, over the rows of ``body.clause_trees``. A text's row holds
    all that is needed, so nothing is shuffled; the work is at most nodes times levels."""
    n = F.col("nodes")
    kept = F.filter(n, lambda x: F.exists(x["line"], lambda i: F.coalesce(match(F.get(n, i)), F.lit(False))))
    return trees.select(doc, F.inline(F.transform(kept, lambda x: F.struct(x["path"].alias("path"), joined_texts(below(n, x)).alias("full_text")))))


def subtree(nodes: DataFrame, path: str, doc: str = "document_id", document_id: str | None = None) -> DataFrame:
    """A node and all below it, as a prefix filter that the scan can take."""
    rows = nodes if document_id is None else nodes.filter(F.col(doc) == document_id)
    return rows.filter((F.col("path") == path) | F.col("path").startswith(f"{path}."))


def matched_tops(nodes: DataFrame, match: Column, doc: str = "document_id") -> DataFrame:
    """The topmost matches: nodes that match while no node above them does."""
    hits = nodes.filter(match)
    above = hits.select(F.col(doc), F.col("path").alias("__above"))
    below = hits.select(doc, "path", F.explode(ancestors(F.col("path"))).alias("__above"))
    covered = below.join(above, [doc, "__above"], "left_semi").select(doc, "path").distinct()
    return hits.join(covered, [doc, "path"], "left_anti")


def pruned(nodes: DataFrame, match: Column, doc: str = "document_id", order: str | None = None) -> DataFrame:
    """All nodes of the matched subtrees; ancestors and siblings that don't match are left out. With a document order
    nothing is joined."""
    if order is not None:
        marked = nodes.withColumn("__line", lineage(doc, order, hit=F.coalesce(match, F.lit(False))))
        return marked.filter(F.exists("__line", lambda a: a["hit"])).drop("__line")
    tops = matched_tops(nodes, match, doc).select(F.col(doc), F.col("path").alias("__top"))
    each = nodes.withColumn("__top", F.explode(ancestors(F.col("path"), itself=True)))
    return each.join(tops, [doc, "__top"]).drop("__top")


def node_filter(node_type: str | None = None, ordinal: str | None = None, of: Callable[[str], Column] = F.col) -> Column:
    """Whether a node has that type and ordinal; ``of`` gives its fields, by name."""
    cond = F.lit(True)
    if node_type is not None:
        cond = cond & (of("node_type") == node_type)
    if ordinal is not None:
        cond = cond & (of("ordinal") == ordinal)
    return cond


def retrieve_nodes(nodes: DataFrame, document_id: str, node_id: str | None = None, node_type: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Nodes of one document with their full texts: a node's subtree, the matched subtrees, or the whole tree. An id that isn't the document's fails."""
    own = nodes.filter(F.col("document_id") == document_id)
    if node_id is not None:
        at = own.filter(F.col("id") == node_id).select("path").first()
        if at is None:
            raise LookupError(f"no node {node_id} in document {document_id}")
        own = subtree(own, at["path"])
    elif node_type is not None or ordinal is not None:
        own = pruned(own, node_filter(node_type, ordinal))
    return full_texts(own).orderBy("seq")


def parents(nodes: DataFrame, doc: str = "document_id", order: str = "seq", **carried: Column) -> DataFrame:
    """Each node with its parent's id, from the stack order: the last node before it whose path is its path's head. What is
    carried are the parent's values of these Columns."""
    lined = nodes.withColumn("__line", lineage(doc, order, parent_id=F.col("id"), **carried))
    found = lined.withColumn("__up", F.when(F.size(path_array(F.col("path"))) > 1, F.try_element_at(F.filter("__line", lambda a: F.size(path_array(a["path"])) == F.size(path_array(F.col("path"))) - 1), F.lit(1))))
    return found.drop("parent_id", "__line").withColumns({k: F.col(f"__up.{k}") for k in ("parent_id", *carried)}).drop("__up")


def unique_paths(nodes: DataFrame, doc: str = "document_id") -> DataFrame:
    """Paths with a suffix _2, _3, ... for the later ones of equal paths in a document."""
    w = Window.partitionBy(doc, "path").orderBy("seq")
    return nodes.withColumn("__n", F.row_number().over(w)).withColumn("path", F.when(F.col("__n") > 1, F.concat("path", F.lit("_"), F.col("__n").cast("string"))).otherwise(F.col("path"))).drop("__n")
