"""Queries of the legal core over texts and pages made from the supplied tables.

An order is a statute: its customer gives the preamble, its priority the chapter, its lines the articles. A document's
sentences are parted by citations. A customer is a fetched page. Both engines make the text by the same concatenation;
the operator reads it, while the SQL states the rows from the tables, without looking into the text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import authority, citations
from lexmill.operators import body, chunks, ingest, relations, tree
from lexmill.plans.catalog import query, spread, table
from lexmill.scratch import written


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Statutes

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"]


def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, full_text, citation_id) of all orders, with an article for each of their lines."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = F.col("n")
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)))
    title = _text("Điều ", n, F.when(F.col("l_returnflag") == "R", "\n").otherwise(". "), "Hàng ", F.col("l_partkey"))
    points = F.when(F.col("l_linestatus") == "F", _text("\na) Bên ", F.col("l_suppkey"), ";\nđ) Ngày ", F.col("l_shipdate").cast("date"), ".")).otherwise("")
    clauses = _text("\n1. Theo Nghị định ", F.col("l_partkey") % 900 + 1, "/2020/NĐ-CP.", points, "\n2. Số lượng ", F.col("l_quantity").cast("int"), "\ntiếp theo")
    article = _text(F.when(n == 3, "Mục 1. Riêng\n").otherwise(""), title, F.when(F.col("l_quantity") % 5 == 0, "\nChữ của điều.").otherwise(clauses))
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", article.alias("t")))), lambda a: a["t"]), "\n").alias("articles"))
    head = _text("LUẬT\nCăn cứ Hiến pháp;\nCăn cứ Luật số ", F.col("o_custkey") % 900 + 1, "/2019/QH14;\nChương I. ", F.col("o_orderpriority"))
    annex = F.when(F.col("o_orderstatus") == "P", "Phụ lục II\n(Kèm theo)\nnội dung").otherwise(_text("Phụ lục I\nMẫu số ", F.col("o_orderkey") % 90, "\nbảng"))
    whole = F.concat_ws("\n", head, "articles", F.lit("Nơi nhận:\n- Lưu"), annex)
    # merged, whatever the sizes: texts are never broadcast, and are read by as many tasks as the shuffle has
    return o.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("document_id"), whole.alias("full_text"), _text(F.col("o_orderkey"), "/2024/QH15").alias("citation_id"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.with_paths(body.clause_nodes(_statutes(spark, sf_dir)))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.clause_trees(_statutes(spark, sf_dir))


_NODE_SQL = f"""with l as (select *, l_orderkey as k, row_number() over (partition by l_orderkey order by {', '.join(_LINE_ORDER)}) as n from lineitem join orders on o_orderkey = l_orderkey),
a as (select *, 'chuong1.' || case when n >= 3 then 'muc1.' else '' end || 'dieu' || n as up, l_quantity::int % 5 <> 0 as long, case when n >= 3 then 'Mục 1 Riêng' || chr(10) else '' end as section from l),
parts as (select o_orderkey as k, 0 as n, 0 as s, 'chuong' as node_type, '1' as ordinal, 'Chương I' as label, o_orderpriority as heading, null as text_content, null as content_class, 'chuong1' as path from orders
union all select k, n, 0, 'muc', '1', 'Mục 1', 'Riêng', null, null, 'chuong1.muc1' from a where n = 3
union all select k, n, 1, 'dieu', n::varchar, 'Điều ' || n, 'Hàng ' || l_partkey, case when not long then 'Chữ của điều.' end, null, up from a
union all select k, n, 2, 'khoan', '1', 'Khoản 1', null, 'Theo Nghị định ' || (l_partkey % 900 + 1) || '/2020/NĐ-CP.', null, up || '.khoan1' from a where long
union all select k, n, 3, 'diem', 'a', 'Điểm a', null, 'Bên ' || l_suppkey || ';', null, up || '.khoan1.diema' from a where long and l_linestatus = 'F'
union all select k, n, 4, 'diem', 'đ', 'Điểm đ', null, 'Ngày ' || l_shipdate::date || '.', null, up || '.khoan1.diemdd' from a where long and l_linestatus = 'F'
union all select k, n, 5, 'khoan', '2', 'Khoản 2', null, 'Số lượng ' || l_quantity::int || chr(10) || 'tiếp theo', null, up || '.khoan2' from a where long
union all select o_orderkey, 1000000, 0, 'phu_luc', case when o_orderstatus = 'P' then '2' else '1' end, case when o_orderstatus = 'P' then 'Phụ lục II' else 'Phụ lục I' end, case when o_orderstatus <> 'P' then 'Mẫu số ' || (o_orderkey % 90) end,
  case when o_orderstatus = 'P' then '(Kèm theo)' || chr(10) || 'nội dung' else 'bảng' end, case when o_orderstatus = 'P' then 'normative' else 'template' end, case when o_orderstatus = 'P' then 'phu_luc2' else 'phu_luc1' end from orders),
nodes as (select k as document_id, (row_number() over (partition by k order by n, s) - 1)::int as seq, node_type, ordinal, label, heading, text_content, content_class, path from parts)"""


@query(f"{_NODE_SQL} select * from nodes")
def clause_tree(spark, sf_dir):
    return _nodes(spark, sf_dir).select("document_id", "seq", "node_type", "ordinal", "label", "heading", "text_content", "content_class", "path")


@query(f"{_NODE_SQL} select n.document_id, n.path, u.label as parent_label, true as same from nodes n left join nodes u on u.document_id = n.document_id and u.path = regexp_extract(n.path, '^(.*)[.][^.]*$', 1)")
def tree_parents(spark, sf_dir):
    """Parents found by path, beside those that the parser put out."""
    n = body.with_paths(body.clause_nodes(_statutes(spark, sf_dir)).repartition("document_id")).withColumn("put_out", F.col("parent_id"))  # ids are made after the shuffle
    return tree.parents(n, parent_label=F.col("label")).select("document_id", "path", "parent_label", F.col("put_out").eqNullSafe(F.col("parent_id")).alias("same"))


@query(f"""{_NODE_SQL} select document_id, path, label || chr(10) || text_content || coalesce(chr(10) || points, '') as full_text from nodes left join (
select k as document_id, up || '.khoan1' as path, 'Điểm a' || chr(10) || 'Bên ' || l_suppkey || ';' || chr(10) || 'Điểm đ' || chr(10) || 'Ngày ' || l_shipdate::date || '.' as points from a where l_linestatus = 'F') using (document_id, path)
where node_type = 'khoan' and ordinal = '1' union all select document_id, path, label || chr(10) || text_content from nodes where node_type = 'diem'""")
def node_filter(spark, sf_dir):
    """The first clauses of all articles with what stands below them."""
    return tree.matched_texts(_trees(spark, sf_dir), lambda x: tree.node_filter("khoan", "1", x.getField))


_POINTS_SQL = "case when l_linestatus = 'F' then chr(10) || 'Điểm a' || chr(10) || 'Bên ' || l_suppkey || ';' || chr(10) || 'Điểm đ' || chr(10) || 'Ngày ' || l_shipdate::date || '.' else '' end"
_FIRST_SQL = f"'Khoản 1' || chr(10) || 'Theo Nghị định ' || (l_partkey % 900 + 1) || '/2020/NĐ-CP.' || {_POINTS_SQL}"
_SECOND_SQL = "'Khoản 2' || chr(10) || 'Số lượng ' || l_quantity::int || chr(10) || 'tiếp theo'"
_ABOVE_SQL = "'Chương I ' || o_orderpriority || chr(10) || section"
_ARTICLE_SQL = "'Điều ' || n || ' Hàng ' || l_partkey || chr(10)"
_ANNEX_SQL = "'Phụ lục II' || chr(10) || '(Kèm theo)' || chr(10) || 'nội dung'"


@query(f"""{_NODE_SQL} select k || ':' || up || '.khoan1' as id, {_ABOVE_SQL} || {_ARTICLE_SQL} || {_FIRST_SQL} as text from a where long
union all select k || ':' || up || '.khoan2', {_ABOVE_SQL} || {_ARTICLE_SQL} || {_SECOND_SQL} from a where long
union all select k || ':' || up, {_ABOVE_SQL} || {_ARTICLE_SQL} || 'Chữ của điều.' from a where not long
union all select o_orderkey || ':phu_luc2', {_ANNEX_SQL} from orders where o_orderstatus = 'P'""")
def clause_chunks(spark, sf_dir):
    return chunks.tree_chunks(_trees(spark, sf_dir)).select("id", "text")


@query(f"""{_NODE_SQL} select k || ':' || up as id, 'Hàng ' || l_partkey as heading, case when long then 2 else 0 end::int as clauses,
  {_ARTICLE_SQL} || case when long then {_FIRST_SQL} || chr(10) || {_SECOND_SQL} else 'Chữ của điều.' end as body from a
union all select o_orderkey || ':phu_luc2', null, 0, {_ANNEX_SQL} from orders where o_orderstatus = 'P'""")
def search_documents(spark, sf_dir):
    return chunks.tree_search_documents(_trees(spark, sf_dir)).select("id", "heading", F.size("khoan").alias("clauses"), "body")


@query(f"""{_NODE_SQL} select document_id, path from nodes where node_type = 'dieu' or (document_id % 2 = 0 and (path like '%.khoan1' or path = 'phu_luc2'))""")
def materialised_nodes(spark, sf_dir):
    """Edges end at every chapter, first clause and annex of every other statute; containers and templates stay out."""
    n = body.with_paths(written(body.clause_nodes(_statutes(spark, sf_dir)), "nodes"))  # texts are read once
    ends = n.filter("document_id % 2 = 0 and (path like '%.khoan1' or node_type in ('phu_luc', 'chuong'))").select(F.col("id").alias("source_node_id"), F.lit(None).cast("string").alias("target_node_id"))
    return chunks.materialised(n, ends).select("document_id", "path")


# Citations in running text

#: words before a citation, by its number
_WORDS = ["sửa đổi", "bãi bỏ", "theo", "thay thế", "đính chính", "hướng dẫn", "và"]
#: forms of citations, by their number
_FORMS = ["/NĐ-CP", "/TTLT-BTC-BKHĐT", "/QH14", "/QĐ-UBND", "/UBTVQH12"]


def _pick(number: str, values: list[str]) -> str:
    """SQL for the value that a number selects, in both engines."""
    return f"case {number} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def _citation(number: str) -> str:
    return f"concat(cast({number} % 900 + 1 as varchar(9)), '/', cast(2000 + {number} // 900 as varchar(9)), {_pick(number, _FORMS)})"


#: every seventh citation of a text is its first one again
_NUMBER = "(case when i % 7 = 6 then 0 else i end)"
_SEPARATOR = f"concat('. ', {_pick('i', _WORDS)}, ' ', {_citation(_NUMBER)}, ' ')"
_HEAD = "concat('LUẬT\nCăn cứ Luật số ', cast(doc_id % 900 + 1 as varchar(9)), '/2019/QH14;\nCăn cứ Thông tư liên tịch ', cast(doc_id % 900 + 1 as varchar(9)), '/2015/TTLT/BTC-BTP;\nChương I.')"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences are parted by citations, of which the fourth is the document's own."""
    separator = _SEPARATOR.replace("//", "div")
    parts = f"transform(split(coalesce(text, ''), '[.] '), (p, i) -> concat(p, case when i < size(split(coalesce(text, ''), '[.] ')) - 1 then {separator} else '' end))"
    d = table(spark, sf_dir, "documents").withColumn("n", F.size(F.split(F.coalesce("text", F.lit("")), "[.] ")))
    parts = parts.replace("size(split(coalesce(text, ''), '[.] '))", "n")
    return d.select("doc_id", F.expr(f"concat({_HEAD}, ' A\n', array_join({parts}, ''))").alias("full_text"), F.expr(_citation("3").replace("//", "div")).alias("own"))


_CITED_SQL = f"""with p as (select doc_id, string_split(coalesce(text, ''), '. ') as l from documents),
s as (select doc_id, unnest(range(0, len(l))) as i, unnest(l) as piece, len(l) as n from p),
t as (select doc_id, i, n, piece, {_pick('i', _WORDS)} as word, {_citation(_NUMBER)} as citation, case when i < n - 1 then {_SEPARATOR} else '' end as separator from s),
placed as (select *, 3 + sum(length(piece) + length(separator)) over (partition by doc_id order by i) - length(citation) - 1 as start from t),
whole as (select doc_id, ' A' || chr(10) || string_agg(piece || separator, '' order by i) as body from t group by doc_id),
around as (select doc_id, citation, regexp_replace(lower(substr(body, greatest(1, start + 1 - 80)::bigint, (least(80, start) + length(citation) + 80)::bigint)), '^\\s+|\\s+$', '', 'g') as context
  from placed join whole using (doc_id) where i < n - 1 and i % 7 <> 6 and i <> 3),
cited as (select *, case when context like '%sửa đổi%' then 'amends' when context like '%bãi bỏ%' then 'repeals' when context like '%thay thế%' then 'amends' when context like '%đính chính%' then 'corrects'
  when context like '%hướng dẫn%' then 'guides' else 'cites' end as reference_type from around)"""


def _references(spark, sf_dir):
    return body.body_references(_cited(spark, sf_dir), "doc_id", "full_text", "own")


@query(f"{_CITED_SQL} select doc_id, reference_type, citation from cited")
def body_refs(spark, sf_dir):
    return _references(spark, sf_dir).select("doc_id", "reference_type", "citation")


@query(f"{_CITED_SQL} select doc_id, citation, context, reference_type from cited")
def context_window(spark, sf_dir):
    """What stands within 80 characters of each citation's first place."""
    return _references(spark, sf_dir).select("doc_id", "citation", F.col("raw_citation_text").alias("context"), "reference_type")


@query("""select doc_id, (doc_id % 900 + 1) || '/2019/QH14' as citation, 'Căn cứ Luật số ' || (doc_id % 900 + 1) || '/2019/QH14;' as raw_citation_text from documents
union all select doc_id, (doc_id % 900 + 1) || '/2015/TTLT/BTC-BTP', 'Căn cứ Thông tư liên tịch ' || (doc_id % 900 + 1) || '/2015/TTLT/BTC-BTP;' from documents""")
def preamble_refs(spark, sf_dir):
    return body.basis_references(_cited(spark, sf_dir), "doc_id").select("doc_id", "citation", "raw_citation_text")


#: what stands around an order's number in a title: before, after, whether the number word introduces it, and what is left of it in plain form
_TITLES = [
    ("Luật số ", "/2024/QH15", True, ("", "/2024/QH15")), ("Số: ", "/2025/NĐ-CP", False, ("", "/2025/NĐ-CP")), ("Nghị quyết số hiệu: ", "/NQ", False, ("", "/NQ")), ("Không có gì ", "", False, ("Không có gì ", "")),
    ("  Thông tư liên tịch số ", "/2010/TTLT ", True, ("", "/2010/TTLT")), ("số AB và số ", "/CP", True, ("AB và số ", "/CP")), ("Nghị định số số ", "/2001/NĐ-CP", True, ("", "/2001/NĐ-CP")),
]


def _titles(column: int) -> str:
    quoted = [(before, after, *plain) for before, after, _, plain in _TITLES]
    return _pick("k", [q[column] for q in quoted])


@query(f"""select k, concat({_titles(0)}, k, {_titles(1)}) as raw, case when k % {len(_TITLES)} in ({', '.join(str(i) for i, t in enumerate(_TITLES) if t[2])}) then concat(k, trim({_titles(1)})) end as in_title,
concat({_titles(2)}, k, {_titles(3)}) as plain from (select o_orderkey as k from orders)""")
def citation_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("raw", F.expr(f"concat({_titles(0)}, cast(k as string), {_titles(1)})"))
    return rows.select("k", "raw", citations.citation_from_title(F.col("raw")).alias("in_title"), citations.normalize_citation(F.col("raw")).alias("plain"))


_ISSUED = [
    ("Hiến pháp", "Quốc hội", 1, 2), ("Luật", "Quốc hội", 2, 2), ("Nghị quyết", "Quốc hội", 2, 2), ("Nghị quyết", "Ủy ban thường vụ Quốc hội", 3, 3), ("Pháp lệnh", "Ủy ban thường vụ Quốc hội", 3, 3),
    ("Lệnh", "Chủ tịch nước", 4, 4), ("Quyết định", "Chủ tịch nước", 4, 4), ("Nghị định", "Chính phủ", 5, 5), ("Quyết định", "Thủ tướng Chính phủ", 6, 6), ("Thông tư", "Bộ Y tế", 8, 8),
    ("Thông tư liên tịch", "Bộ Y tế", 9, 8), ("Nghị quyết", "Hội đồng nhân dân tỉnh", 10, 8), ("Quyết định", "Ủy ban nhân dân tỉnh", 11, 8), ("Công văn", "Bộ Y tế", None, 8),
]
_ISSUED_SQL = ", ".join(f"({i}, '{d}', '{b}', {'null' if t is None else t}, {r})" for i, (d, b, t, r) in enumerate(_ISSUED))


@query(f"""select c_custkey, r.d || ' ' || c_mktsegment as document_type, r.b || ' ' || c_name as issuing_body, r.t::int as tier, r.r::int as authority_rank
from customer join (values {_ISSUED_SQL}) r(i, d, b, t, r) on r.i = c_custkey % {len(_ISSUED)}""")
def tiers_and_ranks(spark, sf_dir):
    """Types and bodies with a customer's words behind them."""
    k = "c_custkey"
    c = table(spark, sf_dir, "customer").withColumns({"document_type": F.expr(f"concat({_pick(k, [r[0] for r in _ISSUED])}, ' ', c_mktsegment)"), "issuing_body": F.expr(f"concat({_pick(k, [r[1] for r in _ISSUED])}, ' ', c_name)")})
    return c.select(k, "document_type", "issuing_body", authority.classify_tier(F.col("document_type"), F.col("issuing_body"))["tier"].alias("tier"), authority.authority_rank(F.col("issuing_body")).alias("authority_rank"))


@query(f"""select c_custkey, r.r::int as authority_rank from customer join (values {_ISSUED_SQL}) r(i, d, b, t, r) on r.i = c_custkey % {len(_ISSUED)}""")
def body_ranks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("name", F.upper(F.expr(f"concat(c_name, ' ', {_pick('c_custkey', [r[1] for r in _ISSUED])})")))
    return c.select("c_custkey", authority.authority_rank(F.col("name")).alias("authority_rank"))


# Fetched pages

#: what is wrong with a customer's page, by the number modulo 9: no citation, no issuing body, no date, an unknown heading, an unknown status
_BAD = {1: "citation", 2: "body", 3: "date", 4: "heading", 5: "status"}
_HEADINGS = [lab for passive, active, *_ in relations.RELATIONS for lab in (passive, active)]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer; every eleventh is a local one."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey").withColumn("k", F.col("c_custkey"))
    bad = lambda what: F.col("k") % 9 == next(i for i, w in _BAD.items() if w == what)
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    pairs = F.array(
        F.when(~bad("citation"), pair("Số hiệu", _text("Luật số ", F.col("k"), "/2024/QH15"))), pair("Loại văn bản", F.lit("Luật")), pair("Cơ quan ban hành", F.when(~bad("body"), F.col("c_mktsegment"))),
        pair("Ngày ban hành", F.when(bad("date"), "--").otherwise(_text(F.col("k") % 28 + 1, "/2/2024"))), pair("Tình trạng hiệu lực", F.when(bad("status"), "Lạ").when(F.col("k") % 2 == 0, "Còn hiệu lực")),
    )
    card = lambda heading, *entries: F.struct(heading.alias("categoryLabel"), F.array(*entries).alias("entries"))
    heading = F.element_at(F.array(*map(F.lit, _HEADINGS)), (F.col("k") % len(_HEADINGS) + 1).cast("int"))
    cards = F.array(
        card(_text(heading, " (2)"), _text("Nghị định số ", F.col("k"), "/2025/NĐ-CP"), F.lit("--")), card(F.when(bad("heading"), "Lạ (1)").otherwise(relations.IGNORED), F.lit("x")),
        card(F.lit(relations.CONSOLIDATES), _text("Luật số ", F.col("k") + 1, "/2020/QH14")),
    )
    return c.select(
        _text("https://h/", F.col("k")).alias("sourceUrl"), F.when(F.col("k") % 11 == 0, "dia-phuong").otherwise("trung-uong").alias("scope"), F.col("c_name").alias("title"),
        _text("LUẬT\nChương I. A\nĐiều 1. ", F.col("c_name")).alias("fullText"), F.filter(pairs, lambda p: p.isNotNull()).alias("attributes"), cards.alias("relations"), "k",
    )


_GOOD = f"k % 9 not in ({', '.join(map(str, _BAD))})"


@query(f"""select k, k || '/2024/QH15' as citation, 'Luật' as document_type, c_mktsegment as issuing_body, (k % 28 + 1) || '/2/2024' as issued_date_raw, case when k % 2 = 0 then 'Còn hiệu lực' end as validity_status_raw
from (select *, c_custkey as k from customer) where {_GOOD}""")
def page_attributes(spark, sf_dir):
    good, _ = ingest.parted(_pages(spark, sf_dir))
    return relations.parse_attributes(good).select("k", "citation", "document_type", "issuing_body", "issued_date_raw", "validity_status_raw")


_RELATION_SQL = ", ".join(f"({i}, '{kind}', {'null' if change is None else repr(change)}, {str(bool(i % 2)).lower()})" for i, (kind, change) in enumerate((k, c) for *_, k, c in relations.RELATIONS for _ in range(2)))


@query(f"""select k, r.kind as reference_type, r.change as change_type, r.source as this_is_source, k || '/2025/NĐ-CP' as citation from (select c_custkey as k from customer)
join (values {_RELATION_SQL}) r(i, kind, change, source) on r.i = k % {len(_HEADINGS)} where {_GOOD}""")
def page_relations(spark, sf_dir):
    good, _ = ingest.parted(_pages(spark, sf_dir))
    return relations.parse_relations(good, "k").select("k", "reference_type", "change_type", "this_is_source", "citation")


_LABELS = "'Loại văn bản, Cơ quan ban hành, Ngày ban hành, Tình trạng hiệu lực'"


@query(f"""select 'https://h/' || k as source, case k % 9 when 1 then 'no citation among: ' || {_LABELS} when 2 then 'no issuing_body among: Số hiệu, ' || {_LABELS} when 3 then 'no issue date: ' || k || '/2024/QH15'
  when 4 then 'unknown relation heading: Lạ' else 'unknown validity status: Lạ' end as message from (select c_custkey as k from customer) where k % 11 <> 0 and not {_GOOD}
union all select 'synced ' || k || '/2024/QH15', 'inserted' from (select c_custkey as k from customer) where k % 11 <> 0 and {_GOOD}""")
def batch_errors(spark, sf_dir):
    """A batch with broken pages: the good ones are synced, the others reported one by one."""
    _, outcomes, errors = ingest.sync(ingest.Tables.empty(spark), _pages(spark, sf_dir).drop("k"), datetime(2026, 1, 2))
    return errors.select(F.col("sourceUrl").alias("source"), "message").unionByName(outcomes.select(F.concat(F.lit("synced "), "citation_id").alias("source"), F.col("outcome").alias("message")))
