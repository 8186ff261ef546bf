"""Named queries of the engine over the supplied tables, and their DuckDB equivalents.

Supplied tables stand in for the engine's: orders for documents, customers and nations for issuing bodies, lineitem for
edges, events for the change log, conversations for clauses in order, embeddings for chunk vectors.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import authority, dates, hashing, text
from lexmill.operators import corpus, edges, graph, outcomes, retrieval, search, tree, upsert
from lexmill.sources import pages as page_source
from lexmill.streaming import feed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table whose file is small, for all cores: what is made of a row costs far more than to move it."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of the engine's schema, as far as searches need it."""
    o = table(spark, sf_dir, "orders")
    status = authority.first_rule([(F.col("o_orderstatus") == "F", "con_hieu_luc"), (F.col("o_orderstatus") == "O", "het_hieu_luc")], "chua_co_hieu_luc")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("citation_id"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderpriority").alias("document_type"), F.col("o_custkey").cast("string").alias("issuing_body_id"), F.col("o_orderdate").cast("date").alias("enacted_date"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("effective_date"), status.alias("status"), "o_totalprice",
    )


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("authority_rank"), F.lit("national").alias("scope"))


FILTERS = search.Filters(document_types=["1-URGENT", "2-HIGH"], issuing_bodies=["BUILDING", "MACHINERY"], validity_status="Còn hiệu lực", issued_from="01/03/1996", issued_to="31/12/1999", page=2)
_SEARCH_SQL = """from orders o join customer c on o_custkey = c_custkey where o_orderpriority in ('1-URGENT', '2-HIGH') and c_mktsegment in ('BUILDING', 'MACHINERY')
  and o_orderstatus = 'F' and o_orderdate::date between date '1996-03-01' and date '1999-12-31'"""


@query(f"select 'O-' || o_orderkey as citation_id, c_mktsegment as issuing_body, o_orderpriority as document_type, strftime(o_orderdate, '%d/%m/%Y') as enacted, 'Còn hiệu lực' as status {_SEARCH_SQL} order by o_orderdate::date desc, 'O-' || o_orderkey limit 10 offset 10")
def search_page(spark, sf_dir):
    rows = search.search_page(_documents(spark, sf_dir), _bodies(spark, sf_dir), FILTERS)
    return rows.select("citation_id", "issuing_body", "document_type", dates.display_date(F.col("enacted_date")).alias("enacted"), authority.status_label(F.col("status")).alias("status"))


@query(f"select count(*) as total {_SEARCH_SQL}")
def search_total(spark, sf_dir):
    return search.search_total(_documents(spark, sf_dir), _bodies(spark, sf_dir), FILTERS)


@query("select doc_id, source from documents where text ilike '%license%version%'")
def search_by_keyword(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(search.keyword_predicate("license%version", search.CONTENT, text=F.col("text"))).select("doc_id", "source")


@query("select p_partkey, p_name from part where p_name ilike 'small ring'")
def search_exact_phrase(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"title": F.col("p_name"), "citation_id": F.col("p_brand")})
    return p.filter(search.keyword_predicate("Small Ring", exact=True)).select("p_partkey", "p_name")


@query("select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') ilike '7_'")
def search_json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").filter(k.ilike("7_")).select("event_id", k.alias("k"))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 77")
def point_lookup(spark, sf_dir):
    return search.point_lookup(table(spark, sf_dir, "orders"), "o_orderkey", 77, "o_orderkey", "o_orderstatus", "o_totalprice")


@query("select n_name as name, n_regionkey as authority_rank, count(c_custkey)::bigint as document_count from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name, n_regionkey")
def issuing_body_counts(spark, sf_dir):
    bodies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("authority_rank"), F.lit("national").alias("scope"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("issuing_body_id"))
    return search.issuing_bodies(bodies, docs).select("name", "authority_rank", "document_count")


def _edges(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Lineitem, or a stream of its rows, as edges from orders to orders (the part's number taken as an order's)."""
    li = table(spark, sf_dir, "lineitem") if lines is None else lines
    kind = authority.first_rule([(F.col("l_returnflag") == "R", "repeals"), (F.col("l_returnflag") == "A", "amends")], "cites")
    return li.select(  # a line's numbers don't identify it; its amount and day tell equal ones apart
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_shipdate").cast("date")).alias("id"),
        F.col("l_orderkey").cast("string").alias("source_document_id"), F.col("l_partkey").cast("string").alias("target_document_id"), kind.alias("reference_type"),
        F.when(F.col("l_linestatus") == "F", "replace").alias("change_type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("raw_citation_text"),
        F.concat(F.lit("O-"), F.col("l_partkey").cast("string")).alias("citation"), F.col("l_shipdate").cast("date").alias("created_at"),
    )


_EDGE_SQL = """with e as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice::decimal(18,2) || '-' || l_shipdate::date as id, l_orderkey::varchar as s, l_partkey::varchar as t,
  case l_returnflag when 'R' then 'repeals' when 'A' then 'amends' else 'cites' end as reference_type, case when l_linestatus = 'F' then 'replace' end as change_type, l_shipdate::date as created_at from lineitem)"""


def _reference_sql(cond: str) -> str:
    return f"""{_EDGE_SQL} select {"distinct" if " or " in cond else ""} id, reference_type, 'O-' || a.o_orderkey as source_citation, 'O-' || b.o_orderkey as target_citation, b.o_orderpriority as target_title
from e left join orders a on a.o_orderkey::varchar = s left join orders b on b.o_orderkey::varchar = t where {cond}"""


def _all_references(spark, sf_dir, direction):
    docs = _documents(spark, sf_dir)
    rows = edges.references(_edges(spark, sf_dir), docs, docs, direction)
    return rows.select("id", "reference_type", "source_citation", "target_citation", "target_title")


_KNOWN = "in (select o_orderkey::varchar from orders)"


@query(_reference_sql(f"s {_KNOWN}"))
def edge_outgoing(spark, sf_dir):
    return _all_references(spark, sf_dir, edges.OUTGOING)


@query(_reference_sql(f"t {_KNOWN}"))
def edge_incoming(spark, sf_dir):
    return _all_references(spark, sf_dir, edges.INCOMING)


@query(_reference_sql(f"(s {_KNOWN} or t {_KNOWN})"))
def edge_all(spark, sf_dir):
    return _all_references(spark, sf_dir, edges.ALL)


@query(f"""{_EDGE_SQL} select id, 'O-' || a.o_orderkey as source_citation, 'O-' || b.o_orderkey as target_citation from e left join orders a on a.o_orderkey::varchar = s left join orders b on b.o_orderkey::varchar = t
where reference_type = 'amends' order by created_at desc, id limit 20 offset 40""")
def edge_page(spark, sf_dir):
    """The third page of all amending edges, newest first."""
    rows = edges.references(_edges(spark, sf_dir), _documents(spark, sf_dir), reference_type="amends")
    return edges.page_of(rows, 3, 20, newest_first=True).select("id", "source_citation", "target_citation")


def _labelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as edges: the label is the target, bound where there is one."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality")
    e = d.join(lab, d["doc_id"] == F.col("l"), "left")
    return e.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("source_document_id"), F.col("quality").cast("string").alias("target_document_id"), F.col("lang").alias("reference_type"), F.lit(None).cast("string").alias("change_type"), F.concat(F.lit("số "), F.col("doc_id").cast("string"), F.lit("/"), "source").alias("raw_citation_text"), F.col("source").alias("citation"), F.col("doc_id").alias("created_at"))


@query("select doc_id::varchar as id, lang as reference_type from documents where doc_id not in (select doc_id from labels) and lang = 'en' and source ilike '%1%'")
def edge_dangling(spark, sf_dir):
    return edges.dangling(_labelled_edges(spark, sf_dir), reference_type="en", raw="/%1").select("id", "reference_type")


@query("select d.doc_id::varchar as id, 'D-' || d.doc_id as source_citation, d.source as source_title from documents d left join labels l using (doc_id) where l.quality is null and lang = 'de'")
def dangling_list(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("citation_id"), F.col("source").alias("title"))
    return edges.dangling_list(_labelled_edges(spark, sf_dir), docs, reference_type="de").select("id", "source_citation", "source_title")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with an even number as documents that can be cited."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("citation_id")).distinct()
    return d.filter(F.regexp_extract("citation_id", r"(\d+)$", 1).cast("int") % 2 == 0).withColumn("id", F.concat(F.lit("S:"), "citation_id"))


@query("""select d.doc_id::varchar as id, coalesce(l.quality::varchar, case when regexp_extract(source, '(\\d+)$', 1)::int % 2 = 0 then 'S:' || source end) as target_document_id,
  l.quality is null and regexp_extract(source, '(\\d+)$', 1)::int % 2 = 0 as healed from documents d left join labels l using (doc_id)""")
def heal_bind(spark, sf_dir):
    return edges.heal(_labelled_edges(spark, sf_dir), _sources(spark, sf_dir)).select("id", "target_document_id", "healed")


@query("""with c as (select unnest(['src0', 'src1', 'src2', 'nowhere']) as citation), k as (select distinct source from documents where regexp_extract(source, '(\\d+)$', 1)::int % 2 = 0),
u as (select source, doc_id::varchar as id from documents where doc_id not in (select doc_id from labels))
select citation, case when k.source is null then 'unknown citation' end as error, count(u.id)::bigint as healed, coalesce(string_agg(u.id, ',' order by u.id), '') as edge_ids
from c left join k on citation = k.source left join u on u.source = k.source group by citation, k.source""")
def bulk_heal_report(spark, sf_dir):
    asked = spark.createDataFrame([("src0",), ("src1",), ("src2",), ("nowhere",)], "citation string")
    return edges.heal_report(_labelled_edges(spark, sf_dir), _sources(spark, sf_dir), asked).withColumn("edge_ids", F.array_join("edge_ids", ","))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old orders, and new ones of which some repeat old keys with other contents."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    versioned = lambda df: df.withColumn("content_version", hashing.joined_sha256(F.col("k"), F.col("o_orderstatus"), F.col("price")))
    old = versioned(o.filter(F.col("day") < F.lit(date(1998, 1, 1))))
    new = versioned(o.filter(F.col("day") >= F.lit(date(1997, 1, 1))).withColumn("o_orderstatus", F.when(F.col("k") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return old, new


_SNAP_SQL = """with o as (select o_orderkey as k, o_orderstatus, o_totalprice::decimal(18,2)::varchar as price, o_orderdate::date as day from orders),
old as (select *, sha256(k::varchar || o_orderstatus || price) as content_version from o where day < date '1998-01-01'),
new0 as (select k, case when k % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus, price, day from o where day >= date '1997-01-01'),
new as (select *, sha256(k::varchar || o_orderstatus || price) as content_version from new0)"""


@query(f"""{_SNAP_SQL} select coalesce(new.k, old.k) as k, case when new.k is null then old.o_orderstatus else new.o_orderstatus end as o_orderstatus, coalesce(new.content_version, old.content_version) as content_version,
  case when new.k is null then null when old.k is null then 'inserted' when old.content_version = new.content_version then 'unchanged' else 'changed' end as outcome from old full join new on old.k = new.k""")
def upsert_snapshot(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return upsert.upsert(old, new, "k", "content_version").select("k", "o_orderstatus", "content_version", "outcome")


@query(f"""{_SNAP_SQL} select new.k as k, case when old.k is null then 'notFound' when old.content_version = new.content_version then 'unchanged' else 'changed' end as outcome from new left join old on old.k = new.k""")
def update_only_outcome(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return upsert.update_outcomes(old, new, "k", "content_version")


@query("""select sha256('v' || source) as id, source as name, 8 as authority_rank from (select distinct source from documents where source not in (select distinct source from documents where lang = 'fr' and doc_id < 5))
union all select 'known', source, 1 from (select distinct source from documents where lang = 'fr' and doc_id < 5)""")
def get_or_create_dim(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.filter("lang = 'fr' and doc_id < 5").select(F.lit("known").alias("id"), F.col("source").alias("name"), F.lit(1).alias("authority_rank"), F.lit("national").alias("scope")).distinct()
    return upsert.get_or_create_issuing_bodies(known, d.select(F.col("source").alias("name"))).select("id", "name", "authority_rank")


@query(f"""{_EDGE_SQL}, n as (select *, case when t::bigint % 2 = 0 then null else t end as target from e)
select reference_type, change_type, count(*)::bigint as n, count(target)::bigint as bound from (select distinct s, reference_type, change_type, target, case when target is null then t end as raw from n) group by all""")
def dedup_edges_nullsafe(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("target_document_id", F.when(F.col("target_document_id").cast("long") % 2 != 0, F.col("target_document_id")))
    return edges.dedup_edges(e, stored=True).groupBy("reference_type", "change_type").agg(F.count("*").alias("n"), F.count("target_document_id").alias("bound"))


@query(f"""{_EDGE_SQL}, ids as (select unnest(range(0, 40))::varchar as id union all select 'none'),
n as (select l_orderkey::varchar as id, count(*) as c from lineitem group by 1), r as (select id, count(distinct eid) as c from (select s as id, id as eid from e union all select t, id from e) group by 1)
select ids.id, case when o_orderkey is null then 'notFound' else 'deleted' end as outcome, case when o_orderkey is null then 0 else coalesce(n.c, 0) end::bigint as nodes_deleted, case when o_orderkey is null then 0 else coalesce(r.c, 0) end::bigint as references_deleted
from ids left join orders on o_orderkey::varchar = ids.id left join n using (id) left join r using (id)""")
def cascade_delete(spark, sf_dir):
    docs, e = _documents(spark, sf_dir), _edges(spark, sf_dir)
    ids = spark.range(40).select(F.col("id").cast("string").alias("id")).unionByName(spark.range(1).select(F.lit("none").alias("id")))
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"))
    return edges.delete_documents(docs, nodes, e, ids)[3]


@query("select count(*)::bigint as total, " + ", ".join(f"count(*) filter (where event_type = '{k}')::bigint as \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " from events")
def outcome_counters(spark, sf_dir):
    return outcomes.counters(table(spark, sf_dir, "events"), "event_type", ["click", "error", "purchase", "signup", "view"])


@query("select l_orderkey, count(*)::bigint as n, bool_and(l_linestatus = 'F') as all_done from lineitem group by 1")
def all_flag(spark, sf_dir):
    return outcomes.all_flag(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F", "all_done")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def distinct_first_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return outcomes.first_seen(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""with f as (select r_name as a, n_name as b, c_custkey, c_acctbal::decimal(18,2) as v from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select coalesce(concat_ws('/', a, b), '') as folder, (2 - grouping(a) - grouping(b))::int as depth, count(*)::bigint as files, round(sum(v)::double, 2) as bytes from f group by grouping sets ((), (a), (a, b))""")
def folder_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    f = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    f = f.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.col("c_acctbal").cast("decimal(18,2)").alias("bytes"))
    return corpus.rollup(f).withColumn("bytes", F.round(F.col("bytes").cast("double"), 2))


@query("select p_partkey, p_name, p_brand, 0.0::double as score from part where lower(trim(p_brand)) = 'brand#7' and p_size >= 10 order by p_size desc, p_partkey limit 1")
def best_match(spark, sf_dir):
    day = F.when(F.col("p_size") >= 10, F.format_string("01/01/%04d", F.col("p_size") + 1900))  # small parts have no date
    p = table(spark, sf_dir, "part").withColumns({"citation": F.concat(F.col("p_brand"), F.lit(" ")), "title": F.col("p_name"), "date": day, "position": F.col("p_partkey")})
    return corpus.best_match(p, citation="brand#7", date_from="1900-01-01").select("p_partkey", "p_name", "p_brand", "score")


@query("select doc_id, n_chars from documents where doc_id not in (select doc_id from documents order by n_chars desc, doc_id limit 50)")
def capped_remainder(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return outcomes.capped(d, [F.desc("n_chars"), F.col("doc_id")], 50, "doc_id")[1]


@query("select doc_id, sha256(coalesce(text, '') || source || lang) as content_version, sha256(lang || coalesce(text, '')) as node_hash from documents")
def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select("doc_id", hashing.content_version(F.col("text"), F.col("source"), F.col("lang"), none, none, none).alias("content_version"), hashing.node_hash(F.col("lang"), none, F.col("text")).alias("node_hash"))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1 and event_type <> 'error'")
def latest_version(spark, sf_dir):
    e = upsert.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return e.filter("event_type <> 'error'").select("user_id", "event_id", "event_type", "value")


@query("""select page_id, regexp_extract(url, '^https://([^/?#:]+)', 1) as host from pages where url like 'https://%' and regexp_matches(regexp_extract(url, '^https://([^/?#:]+)', 1), '(^|\\.)example\\.(com|org)$') and not regexp_matches(regexp_extract(url, '^https://[^/]+(/[^?#]*)', 1), '^/(de|es)/')""")
def host_allowlist(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    ok = page_source.allowed(F.col("url"), suffixes=["example.com", "example.org"], forbidden=["/de/", "/es/"])
    return p.filter(ok).select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("""select page_id, count(*)::bigint as links, count(distinct l)::bigint as distinct_links, min(l) as first_link from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as l from pages) group by 1""")
def html_links(spark, sf_dir):
    return page_source.links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("link").alias("distinct_links"), F.min("link").alias("first_link"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def html_parsed(spark, sf_dir):
    """The full parser on raw pages: scope, title, text and tables; a Python parser, so rows only."""
    return page_source.parse_document_pages(table(spark, sf_dir, "pages").select(F.col("url").alias("sourceUrl"), "html")).select("sourceUrl", "scope", "title", F.length("fullText").alias("n_chars"), F.size("attributes").alias("n_attributes"))


@query("""select doc_id, line_no::int as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents) where line ilike 'licensed%'""")
def line_explode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.filter(F.col("line").ilike("licensed%")).select("doc_id", "line_no", "line")


_RULES = [("promo", "repeals"), ("economy", "amends"), ("standard", "guides")]


@query("select p_partkey, case when contains(lower(p_type), 'promo') then 'repeals' when contains(lower(p_type), 'economy') then 'amends' when contains(lower(p_type), 'standard') then 'guides' else 'cites' end as kind, 8 as authority_rank from part")
def keyword_class(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rules = [(F.lower("p_type").contains(k), v) for k, v in _RULES]
    return p.select("p_partkey", authority.first_rule(rules, "cites").alias("kind"), authority.authority_rank(F.col("p_name")).alias("authority_rank"))


@query("""select p_partkey, trim(regexp_replace(lower(strip_accents(p_name || ' (' || p_brand || ')')), '[^a-z0-9]+', '-', 'g'), '-') as slug, replace(p_brand, '/', '-') || '_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-2.doc' as file_name from part""")
def slug(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = text.file_name(F.col("p_brand"), F.col("p_name"), F.lit("https://files.example.org/a/b.doc"), F.lit(1), F.lit(3))
    return p.select("p_partkey", text.slugify(F.concat(F.col("p_name"), F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), named.alias("file_name"))


@query("select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as shown, substr(o_orderdate::varchar, 1, 10) as day from orders")
def date_display(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.display_date(F.col("o_orderdate")).alias("shown"), dates.date_of_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"))


@query("""with t as (select o_orderkey, (o_orderkey % 40)::varchar || '/' || (o_orderkey % 15)::varchar || '/20' || lpad((o_orderkey % 30)::varchar, 2, '0') as raw from orders)
select o_orderkey, try_strptime(lpad(split_part(raw, '/', 1), 2, '0') || '/' || lpad(split_part(raw, '/', 2), 2, '0') || '/' || split_part(raw, '/', 3), '%d/%m/%Y')::date::varchar as parsed,
  lpad(split_part(raw, '/', 1), 2, '0') || '/' || lpad(split_part(raw, '/', 2), 2, '0') || '/' || split_part(raw, '/', 3) as listed from t""")
def date_parse_safe(spark, sf_dir):
    raw = F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit("/"), (F.col("o_orderkey") % 15).cast("string"), F.lit("/20"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.source_date(raw).cast("string").alias("parsed"), dates.listed_date(F.replace(raw, F.lit("/"), F.lit("-"))).alias("listed"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a tree: its turns stand below its first one."""
    c = table(spark, sf_dir, "conversations")
    path = F.when(F.col("turn") == 0, "t0").otherwise(F.concat(F.lit("t0.t"), F.col("turn").cast("string")))
    return c.select(F.col("conv_id").alias("document_id"), path.alias("path"), F.col("turn").alias("seq"), F.col("role").alias("label"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("text_content"))


@query("select conv_id as document_id, length(t)::bigint as n_chars, sha256(t) as digest from (select conv_id, string_agg(role || chr(10) || text, chr(10) order by turn) as t from conversations group by conv_id)")
def tree_fulltext(spark, sf_dir):
    rows = tree.full_texts(_turns(spark, sf_dir)).filter("path = 't0'")
    return rows.select("document_id", F.char_length("full_text").cast("long").alias("n_chars"), F.sha2("full_text", 256).alias("digest"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat_ws(".", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("path"), F.col("c_acctbal").alias("balance"))
    above = n.select(F.concat_ws(".", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("path"), (F.col("n_nationkey") * 1000.0).alias("balance"))
    return rows.unionByName(above).withColumn("document_id", F.lit(1))


_PLACES_SQL = """with p as (select 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey as path, c_acctbal as balance from customer join nation on c_nationkey = n_nationkey
union all select 'r' || n_regionkey || '.n' || n_nationkey, n_nationkey * 1000.0 from nation)"""


@query(f"{_PLACES_SQL} select path from p where path = 'r1.n1' or path like 'r1.n1.%'")
def tree_subtree(spark, sf_dir):
    return tree.subtree(_places(spark, sf_dir), "r1.n1").select("path")


@query(f"""{_PLACES_SQL}, h as (select path from p where balance > 8000), tops as (select path from h where not exists (select 1 from h g where h.path like g.path || '.%'))
select p.path, tops.path as top from p join tops on p.path = tops.path or p.path like tops.path || '.%'""")
def tree_prune(spark, sf_dir):
    places = _places(spark, sf_dir)
    tops = tree.matched_tops(places, F.col("balance") > 8000)
    kept = tree.pruned(places, F.col("balance") > 8000).select("path", F.explode(tree.ancestors(F.col("path"), itself=True)).alias("top"))
    return kept.join(tops.select(F.col("path").alias("top")), "top", "left_semi").select("path", "top")


@query("select conv_id, round(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) / sum(length(text)), 6) as coverage from conversations group by conv_id")
def coverage_ratio(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    whole = c.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("size"))
    return outcomes.coverage(c.filter("role = 'assistant'"), whole, "conv_id", "text", F.col("size")).select("conv_id", F.round("coverage", 6).alias("coverage"))


@query("""select o_orderkey from (select o_orderkey, o_orderdate::date as start, case when o_orderkey % 4 > 0 then o_orderdate::date + (o_orderkey % 900)::int end as stop from orders where o_orderstatus = 'F')
where start <= date '1998-06-01' and (stop is null or stop > date '1998-06-01')""")
def valid_at(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    start = F.col("o_orderdate").cast("date")
    stop = F.when(F.col("o_orderkey") % 4 > 0, F.date_add(start, (F.col("o_orderkey") % 900).cast("int")))
    return o.filter(dates.valid_at(F.lit(date(1998, 6, 1)), start, stop)).select("o_orderkey")


@query("""select l_orderkey, l_linenumber, l_partkey, lag_days::int as lag_days, case when lag_days < 0 then 'retroactive' else 'too_early' end as rule from (
select *, date_diff('day', o_orderdate::date, l_shipdate::date) as lag_days from lineitem join orders on l_orderkey = o_orderkey)
where lag_days < 0 or (lag_days < (case when l_returnflag = 'N' then 10 else 45 end) and o_orderpriority <> '1-URGENT')""")
def rule_violations(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "o_orderpriority", F.col("o_orderdate").cast("date").alias("enacted_date"), F.col("l_shipdate").cast("date").alias("effective_date"))
    return graph.effect_violations(rows, F.col("l_returnflag") == "N", F.col("o_orderpriority") == "1-URGENT").select("l_orderkey", "l_linenumber", "l_partkey", "lag_days", "rule")


@query("""select a.o_orderkey as source, b.o_orderkey as target, a.o_orderpriority[1]::int as source_rank, b.o_orderpriority[1]::int as target_rank, count(*)::bigint as n
from lineitem join orders a on a.o_orderkey = l_orderkey join orders b on b.o_orderkey = l_partkey where a.o_orderpriority[1] > b.o_orderpriority[1] group by all""")
def rank_conflict(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    ranks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    return graph.rank_conflicts(li, ranks).groupBy("source", "target", "source_rank", "target_rank").agg(F.count("*").alias("n"))


@query("""with recursive e as (select distinct l_orderkey as s, l_partkey as t from lineitem), p as (select s as start, s as node, 0 as hops from (values (5), (17), (300)) v(s)
union all select p.start, e.t, p.hops + 1 from p join e on e.s = p.node where p.hops < 3)
select start::bigint as start, node::bigint as node, min(hops)::int as hops from p where not (start = node) group by start, node""")
def path_1_3(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return graph.paths(li, spark.createDataFrame([(5,), (17,), (300,)], "start long"), 3)


@query("select o_custkey, o_orderkey, o_orderdate::date as day from (select *, row_number() over (partition by o_custkey order by o_orderdate::date desc, o_orderkey desc) as n from orders where o_orderdate::date <= date '1998-06-01') where n = 1")
def as_of_edge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    return graph.as_of(o, ["o_custkey"], "day", F.lit(date(1998, 6, 1))).select("o_custkey", "o_orderkey", "day")


TERMS = ["license", "version", "the", "und", "que"]
_BM25_SQL = f"""w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from documents),
s as (select count(*) as n, avg(len(w)) as avgdl from w), q as (select unnest({TERMS}) as t),
tf as (select doc_id, len(w) as dl, t, len(list_filter(w, lambda x: x = t)) as tf from w, q), df as (select t, count(*) filter (where tf > 0) as df from tf group by t),
bm as (select doc_id as id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join df using (t), s where tf > 0 group by doc_id)"""


@query(f"with {_BM25_SQL} select id, round(score, 6) as score from bm order by bm.score desc, id limit 20")
def bm25_topk(spark, sf_dir):
    return retrieval.top(retrieval.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id"), 20).select("id", F.round("score", 6).alias("score"))


QUERY_VECTOR = [round(((7 * i) % 13 - 6) / 6, 4) for i in range(64)]
_VEC_SQL = f"""v as (select vec_id as id, list_sum(list_transform(list_zip(embedding, {QUERY_VECTOR}), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * {sum(x * x for x in QUERY_VECTOR) ** 0.5!r}) as score from embeddings where label in (1, 3))"""


@query(f"with {_VEC_SQL} select id, round(score, 6) as score from v order by v.score desc, id limit 15")
def vector_topk_filtered(spark, sf_dir):
    return retrieval.vector_top(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 15, F.col("label").isin(1, 3)).select("id", F.round("score", 6).alias("score"))


@query(f"""with {_BM25_SQL}, {_VEC_SQL}, a as (select id, row_number() over (order by score desc, id) as r from (select * from bm order by score desc, id limit 30)),
b as (select id, row_number() over (order by score desc, id) as r from (select * from v order by score desc, id limit 30))
select id, round(sum(1.0 / (60 + r)), 9) as score from (select * from a union all select * from b) group by id""")
def rrf_fusion(spark, sf_dir):
    words = retrieval.top(retrieval.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id"), 30)
    near = retrieval.vector_top(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 30, F.col("label").isin(1, 3))
    return retrieval.rrf([words, near]).select("id", F.round("score", 9).alias("score"))


@query("""select conv_id, count(*)::bigint as parts, string_agg(role || ':' || length(text), ',' order by turn) as shape, sha256(string_agg(text, chr(10) order by turn)) as digest from conversations where turn > 0 group by conv_id""")
def chunk_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("turn > 0")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("k"))
    shape = F.array_join(F.transform("k", lambda t: F.concat(t["role"], F.lit(":"), F.char_length(t["text"]).cast("string"))), ",")
    return rows.select("conv_id", F.size("k").cast("long").alias("parts"), shape.alias("shape"), F.sha2(F.array_join(F.transform("k", lambda t: t["text"]), "\n"), 256).alias("digest"))


@query("""select o_orderkey as document_id, target, case when status is null then 'missing' when status = 'failed' then 'failed' else 'stale' end as reason from (
select o_orderkey, target, sha256(o_orderkey::varchar || o_orderstatus) as v, case when o_orderkey % 5 > 0 then sha256(o_orderkey::varchar || case when o_orderkey % 7 = 0 then 'old' else o_orderstatus end) end as sv,
case when o_orderkey % 5 = 0 then null when o_orderkey % 11 = 0 then 'failed' when o_orderkey % 13 = 0 then 'not_applicable' else 'synced' end as status from orders, (values ('graph'), ('search')) t(target))
where coalesce(status, '') <> 'not_applicable' and (status is null or status = 'failed' or sv <> v)""")
def sync_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("id"), hashing.joined_sha256(F.col("o_orderkey"), F.col("o_orderstatus")).alias("content_version"))
    k = F.col("o_orderkey")
    seen = F.when(k % 7 == 0, F.lit("old")).otherwise(F.col("o_orderstatus"))
    status = F.when(k % 11 == 0, "failed").when(k % 13 == 0, "not_applicable").otherwise("synced")
    one = o.filter(k % 5 > 0).select(k.alias("document_id"), hashing.joined_sha256(k, seen).alias("synced_version"), status.alias("status"))
    state = one.withColumn("target", F.explode(F.array(F.lit("graph"), F.lit("search"))))
    return feed.reconcile(docs, state, ["graph", "search"]).select("document_id", "target", "reason")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def stream_projector(spark, sf_dir):
    """The change log read as a stream and projected batch by batch; equals the batch's latest versions."""
    return feed.project_log(spark, f"{sf_dir}/events.parquet", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")
