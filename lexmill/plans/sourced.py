"""Queries of the sources and of the file corpus, over pages, responses and manifests made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import dates, files
from lexmill.operators import corpus, edges, ingest, tree, upsert
from lexmill.plans.catalog import _EDGE_SQL, _PLACES_SQL, _documents, _edges, _places, query, spread, table
from lexmill.plans.statutes import _pages, _text
from lexmill.scratch import fresh_path
from lexmill.sources import feeds
from lexmill.sources import pages as page_source


@query("""select 'https://h/' || c_custkey as url, case c_custkey % 3 when 0 then 'trung-uong' when 1 then 'dia-phuong' else 'unknown' end as scope, c_name as title, 'Điều 1. ' || c_mktsegment || chr(10) || c_custkey || ' & B' as full_text,
'Số hiệu=' || c_custkey || '/2020;Cơ quan=' || c_mktsegment as attributes, 'Văn bản bãi bỏ (1)=' || c_name || ',Luật ' || c_custkey as relations from customer""")
def document_pages(spark, sf_dir):
    """The parser on a fetched page of each customer."""
    k, c = F.col("c_custkey"), spread(table(spark, sf_dir, "customer"), "c_custkey")
    scope = F.when(k % 3 == 0, "trung-uong").when(k % 3 == 1, "dia-phuong").otherwise("khac")
    item = lambda label, value: _text('<div class="ant-descriptions-item-container"><span class="ant-descriptions-item-label">', label, ' </span><span class="x ant-descriptions-item-content"> ', value, "</span></div>")
    html = F.concat(
        _text('<html><nav class="ant-breadcrumb"><ol><li class="ant-breadcrumb-item"><a href="/van-ban/', scope, '">A</a></li><li class="ant-breadcrumb-item"> ', F.col("c_name"), " </li></ol></nav>"),
        _text('<div class="ant-tabs-tabpane-active"><p>Điều 1.&nbsp;', F.col("c_mktsegment"), "</p><p>", k, " &amp; B</p><script>x</script></div>"), item("Số hiệu", _text(k, "/2020")), item("Cơ quan", F.col("c_mktsegment")),
        _text('<div class="ant-card"><span class="font-bold">Văn bản bãi bỏ (1)</span><ul><li><a>', F.col("c_name"), "</a><li><a> </a><li><a>Luật ", k, "</a></ul></div></html>"),
    )
    rows = page_source.parse_document_pages(c.select(_text("https://h/", k).alias("sourceUrl"), html.alias("html")))
    pairs = F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["label"], a["value"])), ";")
    cards = F.array_join(F.transform("relations", lambda r: F.concat(r["categoryLabel"], F.lit("="), F.array_join(r["entries"], ","))), ";")
    return rows.select(F.col("sourceUrl").alias("url"), "scope", "title", F.col("fullText").alias("full_text"), pairs.alias("attributes"), cards.alias("relations"))


@query("""select 'https://h/' || c_custkey as doc, o_orderkey || '/2020/NĐ-CP' as citation, 'Về ' || o_orderpriority as title, strftime(o_orderdate, '%d/%m/%Y') as day, 'https://l.org/d?id=' || o_orderkey as url, 'https://f/' || o_orderkey || '.pdf' as files,
n::int as total from orders join customer on c_custkey = o_custkey join (select o_custkey as c, count(*) as n from orders group by 1) on c = o_custkey""")
def listing_pages(spark, sf_dir):
    """A customer's orders as the rows of a listing page."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    row = _text('<tr><td><a href="/d?id=', k, '"><span class="code">', k, '/2020/NĐ-CP</span></a></td><td><span class="issued-date">', dates.display_date(F.col("o_orderdate")), '</span></td><td><span class="substract">Về ', F.col("o_orderpriority"),
                '</span><div class="bl-doc-file"><a href="https://f/', k, '.pdf">f</a></div></td></tr>')
    each = o.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"), F.count("*").alias("n"))
    html = _text('<form><input type=hidden name=v value="1"><table id="ctl_grvDocument"><tr><th>h</th></tr>', F.col("rows"), '<tr><td>x</td></tr></table><span id="document_page_info">1 - ', F.col("n"), " | ", F.col("n"), "</span></form>")
    parsed = page_source.parse_listing_pages(each.select(_text("https://l.org/", F.col("o_custkey")).alias("url"), html.alias("html")))
    rows = page_source.listed_rows(parsed.withColumn("rows", F.transform("rows", lambda r: r.withField("total", F.col("totalCount")))))
    owner = o.select(_text(k, "/2020/NĐ-CP").alias("citation"), _text("https://h/", F.col("o_custkey")).alias("doc"))
    return rows.join(owner, "citation").select("doc", "citation", "title", F.col("date").alias("day"), F.col("docUrl").alias("url"), F.array_join("fileUrls", ",").alias("files"), "total")


@query("""select 'https://l.org/' || o_orderkey as url, o_orderkey || '/CP' as citation, case when o_orderkey % 2 = 0 then 'Về ' || o_orderpriority else '' end as title, strftime(o_orderdate, '%d/%m/%Y') as day, o_orderstatus as kind, 'f' || o_orderkey || ',g' as files from orders where o_orderkey % 7 <> 0""")
def detail_pages(spark, sf_dir):
    """An order's detail page; without a number there is no document."""
    k = F.col("o_orderkey")
    pair = lambda label, value: _text('<tr><td class="col1">', label, "</td><td>", value, "</td></tr>")
    html = F.concat(
        F.lit('<div class="Content"><table>'), F.when(k % 7 != 0, pair("Số ký hiệu", _text(k, "/CP"))).otherwise(""), F.when(k % 2 == 0, pair("Trích yếu", _text("Về ", F.col("o_orderpriority")))).otherwise(""),
        pair("Ngày ban hành", F.date_format("o_orderdate", "d-M-yyyy")), pair("Loại văn bản", F.col("o_orderstatus")), _text('</table><a class="view-file" href="f', k, '">v</a><a class="view-file" href="g">v</a><a class="view-file" href="f', k, '">v</a></div>'),
    )
    rows = page_source.parse_detail_pages(spread(table(spark, sf_dir, "orders"), "o_orderkey").select(_text("https://l.org/", k).alias("url"), html.alias("html")))
    return rows.select(F.col("sourceUrl").alias("url"), "citation", "title", F.col("date").alias("day"), F.col("docType").alias("kind"), F.array_join("fileUrls", ",").alias("files"))


@query("select n_name, 'https://h/' || c_custkey as location from customer join nation on c_nationkey = n_nationkey where c_custkey % 2 = 0")
def sitemap_locations(spark, sf_dir):
    """A nation's sitemap: customers with even numbers stand in the part that is asked for."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    loc = _text("<loc> https://h/", F.col("c_custkey"), " </loc>")
    part = lambda even: F.array_join(F.collect_list(F.when((F.col("c_custkey") % 2 == 0) == even, loc)), "\n")
    xml = c.groupBy("n_name").agg(F.concat(F.lit("<u><!--A-->"), part(True), F.lit("<!--B-->"), part(False), F.lit("</u>")).alias("xml"))
    return xml.select("n_name", F.explode(feeds.sitemap_locations(F.col("xml"), "<!--A-->", "<!--B-->")).alias("location"))


@query("""select 1 as total, 'https://h/' || o_orderkey as source_url, o_orderkey || '/CP' as citation, case when o_orderkey % 3 = 0 then '' else o_orderpriority end as document_type, o_orderdate::date::varchar as issued_date,
case when o_orderkey % 5 > 0 then (o_orderdate::date + 30)::varchar end as effective_date, o_orderstatus as validity_status from orders""")
def search_responses(spark, sf_dir):
    """A streamed response for each order: lines with other payloads before the object."""
    k = F.col("o_orderkey")
    day = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00"))
    item = F.struct(
        k.cast("string").alias("id"), F.lit('t "q"').alias("title"), _text(k, "/CP").alias("docNum"), F.when(k % 3 != 0, F.struct(F.col("o_orderpriority").alias("name"))).alias("docType"), day(F.col("o_orderdate")).alias("issueDate"),
        F.when(k % 5 > 0, day(F.date_add(F.col("o_orderdate").cast("date"), 30))).alias("effFrom"), F.struct(F.col("o_orderstatus").alias("name")).alias("effStatus"),
    )
    body = F.concat(F.lit("0:[1]\n1:{bad\n2:"), F.to_json(F.struct(F.lit(1).alias("total"), F.lit(1).alias("pageNumber"), F.array(item).alias("items"))), F.lit("\n3:x"))
    rows = feeds.search_results(table(spark, sf_dir, "orders").select(body.alias("b")), "b", "https://h/")
    return rows.select("total", "source_url", "citation", "document_type", "issued_date", "effective_date", "validity_status")


@query(f"""{_EDGE_SQL} select id, case when change_type is null then s else o_orderkey::varchar end as source_document_id, case when change_type is null then o_orderkey::varchar else s end as target_document_id, reference_type
from e left join orders on o_orderkey * 2 = t::bigint where change_type is null or o_orderkey is not null""")
def relations_split(spark, sf_dir):
    """Lines as relation cards: outbound ones always stay, inbound ones if the other side, one of every second number, is known."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), _text("O-", F.col("o_orderkey") * 2).alias("citation_id"))
    cards = _edges(spark, sf_dir).select(F.col("source_document_id").alias("document_id"), "reference_type", "change_type", F.col("change_type").isNull().alias("this_is_source"), F.col("id").alias("raw_citation_text"), "citation")
    return edges.split_relations(cards, docs).select(F.col("raw_citation_text").alias("id"), "source_document_id", "target_document_id", "reference_type")


@query("""select p_partkey, case when p_size > 40 then p_size + 100 else p_size end as version, case when p_size > 40 then 'new' else 'old' end as state, case when p_partkey % 10 = 3 then 'moved' else p_brand end as subdir from part
union all select p_partkey + 10000000, 1, 'new', case when p_partkey % 10 = 3 then 'moved' else p_brand end from part where p_size < 5""")
def manifest_upserts(spark, sf_dir):
    """Parts as a manifest's entries: some come again in a later version, some are new; each third of ten of a brand is moved."""
    p = table(spark, sf_dir, "part")
    entry = lambda rows, key, version, state: rows.select(F.col("p_brand").alias("subdir"), (key % 10).cast("string").alias("folder"), key.cast("string").alias("filename"), version.alias("version"), F.lit(state).alias("state"))
    old = entry(p, F.col("p_partkey"), F.col("p_size"), "old")
    new = entry(p.filter("p_size > 40"), F.col("p_partkey"), F.col("p_size") + 100, "new").unionByName(entry(p.filter("p_size < 5"), F.col("p_partkey") + 10_000_000, F.lit(1), "new"))
    rows = upsert.upsert_manifest(old, new)
    for brand in sorted(r[0] for r in p.select("p_brand").distinct().collect()):  # a closed list
        rows = upsert.move_entry(rows, brand, "3", "moved")
    return rows.select(F.col("filename").cast("long").alias("p_partkey"), "version", "state", "subdir")


@query("select '\"' || o_orderkey || '\", x' as citation, o_orderpriority || chr(10) || 'y' as filename, (o_orderkey % 600)::int as http_code, o_custkey::bigint as bytes from orders")
def download_log(spark, sf_dir):
    """Outcomes with quotes, commas and line breaks, appended to a log and read back."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(_text('"', k, '", x').alias("citation"), F.lit("d").alias("subdir"), _text(F.col("o_orderpriority"), "\ny").alias("filename"), (k % 600).cast("int").alias("http_code"), F.col("o_custkey").alias("bytes"))
    path = fresh_path(spark, "log")
    feeds.write_log(rows.filter(k % 2 == 0), path)
    feeds.write_log(rows.filter(k % 2 == 1), path)
    return feeds.read_log(spark, path).select("citation", "filename", "http_code", "bytes")


@query("""with m as (select p_brand as b from part where contains(lower(p_name), 'small ring') order by p_size desc, p_partkey limit 1)
select p_partkey, p_size % 2 = 0 as "exists" from part join m on b = p_brand""")
def siblings_status(spark, sf_dir):
    """All parts of the brand of the best match for a title, and whether their file is there."""
    day = F.format_string("01/01/%04d", F.col("p_size") + 1900)
    p = table(spark, sf_dir, "part").withColumns({"citation": F.col("p_brand"), "title": F.col("p_name"), "date": day, "position": F.col("p_partkey"), "subdir": F.lit("s"), "folder": F.col("p_brand"), "filename": F.col("p_partkey").cast("string")})
    there = p.filter("p_size % 2 = 0").select(F.concat_ws("/", "subdir", "folder", "filename").alias("path"))
    return corpus.document_status(p, there, title="small ring").select("p_partkey", "exists")


@query(f"{_PLACES_SQL} select path, (row_number() over (partition by split_part(path, '.', 1) order by string_split(path, '.')))::int as place from p")
def nodes_by_path(spark, sf_dir):
    """Each region's paths numbered in the order of their labels: n10 comes before n2."""
    order = Window.partitionBy("region").orderBy(tree.path_array(F.col("path")))
    return _places(spark, sf_dir).withColumn("region", tree.path_array(F.col("path"))[0]).select("path", F.row_number().over(order).alias("place"))


@query("""select p_partkey, case p_size % 4 when 0 then 'application/pdf' when 1 then 'application/msword' when 2 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'application/octet-stream' end as media,
'attachment; filename="' || p_name || ' __' || case p_size % 4 when 0 then '.PDF' when 1 then '.doc' when 2 then '.docx' else '.txt' end || '"; filename*=UTF-8''''' || replace(p_name, ' ', '%20') || '%20%C4%91%E1%BA%A5' || case p_size % 4 when 0 then '.PDF' when 1 then '.doc' when 2 then '.docx' else '.txt' end as header from part""")
def file_headers(spark, sf_dir):
    n = F.col("p_size") % 4
    name = _text(F.col("p_name"), " đấ", F.when(n == 0, ".PDF").when(n == 1, ".doc").when(n == 2, ".docx").otherwise(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", files.media_type(name).alias("media"), files.content_disposition(name).alias("header"))


@query("select o_orderkey, (case when o_orderkey % 3 = 0 then o_orderdate::date else o_orderdate::date + 30 end)::varchar as valid_from from orders")
def valid_from_dates(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("effective_date", F.when(F.col("id").cast("long") % 3 != 0, F.col("effective_date")))
    return d.select(F.col("id").cast("long").alias("o_orderkey"), dates.valid_from(F.col("effective_date"), F.col("enacted_date")).cast("string").alias("valid_from"))


@query("select 'https://h/' || c_custkey as url, 'scope is dia-phuong' as reason from customer where c_custkey % 11 = 0")
def skipped_pages(spark, sf_dir):
    return ingest.skipped(_pages(spark, sf_dir)).select(F.col("sourceUrl").alias("url"), "reason")


@query(f"""{_EDGE_SQL}, n as (select *, case when t::bigint % 3 = 0 then null else t end as target from e), h as (select id, coalesce(target, case when t in ('3', '30', '300') then o_orderkey::varchar end) as target_document_id, target is null and t in ('3', '30', '300') and o_orderkey is not null as healed
from n left join orders on o_orderkey::varchar = t) select reference_type, healed, count(*)::bigint as n, count(h.target_document_id)::bigint as bound from h join (select distinct id, reference_type from e) using (id) group by all""")
def heal_named(spark, sf_dir):
    """Dangling edges to three citations are bound, the others stay. Lines of one order and part are kept apart by their texts."""
    e = _edges(spark, sf_dir).withColumn("raw_citation_text", F.col("id")).withColumn("change_type", F.col("id"))
    e = e.withColumn("target_document_id", F.when(F.col("target_document_id").cast("long") % 3 != 0, F.col("target_document_id")))
    rows = edges.heal(e, _documents(spark, sf_dir), ["O-3", "O-30", "O-300"])
    return rows.groupBy("reference_type", "healed").agg(F.count("*").alias("n"), F.count("target_document_id").alias("bound"))
