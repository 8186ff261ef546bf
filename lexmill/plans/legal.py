"""More named queries: deletes by filters, amendments, lookups, chunk changes and tiers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import authority
from lexmill.operators import corpus, edges, graph, search, versions
from lexmill.sources import pages as page_source
from lexmill.sources import paging
from lexmill.plans.catalog import _EDGE_SQL, _bodies, _documents, _edges, query, table
from lexmill.streaming import feed


_DELETED = search.Filters(document_types=["1-URGENT"], issuing_bodies=["BUILDING"], issued_from="01/01/1995", issued_to="31/12/1996")


@query(f"""{_EDGE_SQL}, m as (select o_orderkey::varchar as id from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT' and c_mktsegment = 'BUILDING' and o_orderdate::date between date '1995-01-01' and date '1996-12-31')
select (select count(*) from m)::bigint as matched, (select count(*) from m)::bigint as deleted, 0::bigint as not_found, (select count(*) from orders where o_orderkey::varchar not in (from m))::bigint as documents_left,
  (select count(*) from lineitem where l_orderkey::varchar not in (from m))::bigint as nodes_left, (select count(*) from e where s not in (from m) and t not in (from m))::bigint as references_left""")
def delete_by_filter(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"))
    d, n, e, counts = edges.delete_matching(_documents(spark, sf_dir), _bodies(spark, sf_dir), nodes, _edges(spark, sf_dir), _DELETED)
    for name, rows in (("documents_left", d), ("nodes_left", n), ("references_left", e)):
        counts = counts.join(F.broadcast(rows.agg(F.count("*").alias(name))))  # single rows
    return counts


@query(f"""{_EDGE_SQL} select id, a.o_custkey::varchar as source_body, b.o_custkey::varchar as target_body from e join orders a on a.o_orderkey::varchar = s join orders b on b.o_orderkey::varchar = t
where reference_type = 'amends' and a.o_custkey <> b.o_custkey""")
def foreign_amendments(spark, sf_dir):
    return graph.foreign_amendments(_edges(spark, sf_dir), _documents(spark, sf_dir)).select("id", "source_body", "target_body")


@query(f"""{_EDGE_SQL} select id, 'O-' || o_orderkey as citation, (o_orderdate::date + 30)::varchar as effective from e join orders on o_orderkey::varchar = s
where t = '17' and reference_type = 'amends' and o_orderdate::date + 30 <= date '1998-01-01'""")
def amendment_history(spark, sf_dir):
    rows = graph.amendment_history(_edges(spark, sf_dir), _documents(spark, sf_dir), "17", F.lit(date(1998, 1, 1)))
    return rows.select("id", "citation", F.col("effective").cast("string").alias("effective"))


@query("with k as (select distinct l_suppkey + 5 as s_suppkey from lineitem) select k.s_suppkey, s_name from k left join supplier using (s_suppkey)")
def lookup_many(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 5).alias("s_suppkey")).distinct()
    return search.lookup_many(table(spark, sf_dir, "supplier"), keys, "s_suppkey").select("s_suppkey", "s_name")


@query("""with o as (select doc_id::varchar as id, sha256(coalesce(text, '')) as content_hash from documents where doc_id % 10 <> 3),
n as (select doc_id::varchar as id, sha256(coalesce(text, '') || case when doc_id % 7 = 0 then '!' else '' end) as content_hash from documents where doc_id % 10 <> 4)
select coalesce(n.id, o.id) as id, case when n.id is null then 'delete' else 'upsert' end as action from n full join o using (id) where n.content_hash is distinct from o.content_hash""")
def chunk_changes(spark, sf_dir):
    """Two states of an index that differ in rows left out, added and changed; what has to be written and removed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    state = lambda keep, text: d.filter(keep).select(F.col("doc_id").cast("string").alias("id"), F.sha2(text, 256).alias("content_hash"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return feed.chunk_diff(state("doc_id % 10 <> 3", F.col("text")), state("doc_id % 10 <> 4", changed)).select("id", "action")


_FOLDERS = ", ".join(f"({t}, '{name}')" for t, name in authority.TIER_FOLDERS.items())


@query(f"""with f(tier, folder) as (values {_FOLDERS}) select f.tier::int as tier, folder, count(c_custkey)::bigint as files, coalesce(sum(c_custkey * 10), 0)::bigint as bytes
from f left join customer on c_custkey % 20 = f.tier and c_custkey % 20 <> 7 group by f.tier, folder""")
def tier_overview(spark, sf_dir):
    """Customers as files, dealt out over the tiers' folders; tier 7 has none."""
    names = spark.createDataFrame([(int(t), n) for t, n in authority.TIER_FOLDERS.items()], "tier int, folder string")
    c = table(spark, sf_dir, "customer").withColumn("tier", (F.col("c_custkey") % 20).cast("int")).filter("tier <> 7").join(F.broadcast(names), "tier")  # one row a tier
    return corpus.tier_overview(c.select(F.concat_ws("/", "folder", "c_name").alias("path"), (F.col("c_custkey") * 10).alias("bytes")))


_CHANGE_SQL = f"""{_EDGE_SQL}, c as (select l_partkey as d, case when l_returnflag = 'R' and l_quantity >= 48 then 'chuong1' else 'chuong1.dieu' || l_linenumber end as path, case l_returnflag when 'R' then 'repeal' when 'A' then 'replace' else 'insert' end as action,
  case when l_returnflag <> 'R' then 'Lần ' || l_orderkey end as text, l_orderkey || '-' || l_suppkey || '-' || l_extendedprice::decimal(18,2) as source, l_shipdate::date as day from lineitem),
p as (select distinct d, path from c), all_events as (select *, case when path = 'chuong1' then 1 else 2 end as depth, true as own from c
  union all select p.d, p.path, action, null, source, day, 1, false from p join c on c.d = p.d and c.path = 'chuong1' and p.path <> 'chuong1'),
r as (select *, lead(day) over w as until, lead(source) over w as by_whom from all_events window w as (partition by d, path order by day, source, depth, action, text nulls first)),
v as (select d, path, (row_number() over (partition by d, path order by day))::int as version, text, day as valid_from, until as valid_to, source, by_whom as superseded_by from r where own and action <> 'repeal' and (until is null or until > day))"""


def _versions(spark, sf_dir):
    """Lines as changes of the articles of their part; large returns repeal the whole chapter."""
    chapter = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48)
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("document_id"), F.when(chapter, "chuong1").otherwise(F.concat(F.lit("chuong1.dieu"), F.col("l_linenumber").cast("string"))).alias("path"),
        authority.first_rule([(F.col("l_returnflag") == "R", versions.REPEAL), (F.col("l_returnflag") == "A", versions.REPLACE)], versions.INSERT).alias("action"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("Lần "), F.col("l_orderkey").cast("string"))).alias("text"),
        F.concat_ws("-", "l_orderkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")).alias("source"), F.col("l_shipdate").cast("date").alias("effective"),
    )
    return versions.intervals(li)


@query(f"{_CHANGE_SQL} select d as document_id, path, version, text, valid_from::varchar as valid_from, valid_to::varchar as valid_to, source, superseded_by from v")
def provision_versions(spark, sf_dir):
    return _versions(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


@query(f"""{_CHANGE_SQL} select d as document_id, o_orderdate::date::varchar as day, count(*)::bigint as provisions, string_agg(text, chr(10) order by path) as full_text
from v join orders on o_orderkey = d and valid_from <= o_orderdate::date and (valid_to is null or valid_to > o_orderdate::date) group by all""")
def text_as_of(spark, sf_dir):
    """Every order asks for the text of the document of its number as it stood on its own day."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").cast("date").alias("day"))
    return versions.texts_as_of(_versions(spark, sf_dir), asked).withColumn("day", F.col("day").cast("string"))


@query("""with recursive e as (select distinct l_orderkey as s, l_partkey as t from lineitem where l_returnflag = 'R' and l_orderkey <> l_partkey), p as (select s as start, [s, t] as path, t as last from e
union all select start, list_append(path, e.t), e.t from p join e on e.s = p.last where len(path) <= 3 and not list_contains(path, e.t))
select start, array_to_string(path, '>') as path from p""")
def guidance_paths(spark, sf_dir):
    """All chains of up to three returned lines, from every order."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return graph.path_lists(li, hops=3, source="l_orderkey", target="l_partkey").withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("""with p as (select regexp_extract(url, '^https?://([^/?#:]+)', 1) as listing, row_number() over (partition by regexp_extract(url, '^https?://([^/?#:]+)', 1) order by page_id) as page, regexp_extract_all(html, 'href="([^"]*)"', 1) as rows from pages),
f as (select listing, len(rows) as size from p where page = 1),
w as (select p.*, coalesce(sum(len(rows)) over (partition by listing order by page rows between unbounded preceding and 1 preceding), 0) as taken, lag(len(rows)) over (partition by listing order by page) as before, f.size from p join f using (listing) where page <= 50),
s as (select listing, min(page) as stop from w where page > 1 and (before = 0 or taken >= 25 or page > ceil(25 / greatest(size, 1)) + 1) group by 1),
k as (select w.listing, taken, unnest(rows) as link, generate_subscripts(rows, 1) - 1 as place from w left join s using (listing) where stop is null or page < stop)
select listing, (taken + place)::bigint as position, link as "row" from k where taken + place < 25 and listing <> ''""")
def paged_listing(spark, sf_dir):
    """A host's pages as the pages of a listing whose rows are their links; 25 rows of each are wanted."""
    p = table(spark, sf_dir, "pages").withColumn("listing", F.try_parse_url("url", F.lit("HOST")))
    page = F.row_number().over(Window.partitionBy("listing").orderBy("page_id")).alias("page")
    return paging.listed(p.select("listing", page, F.lit(1000).cast("long").alias("total"), page_source.link_list(F.col("html")).alias("rows")), 25)
