"""Sitemaps, search responses and the file corpus as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions.dates import date_of_timestamp

SEARCH_RESPONSE = "total int, pageNumber int, pageSize int, items array<struct<id:string, title:string, docNum:string, docType:struct<name:string>, issueDate:string, effFrom:string, effTo:string, effStatus:struct<name:string>, agencyName:string>>"


def sitemap_locations(xml: Column, start: str, end: str) -> Column:
    """The addresses between two markers; without the end marker to the end, without the start marker a failure."""
    a, b = F.instr(xml, start), F.instr(xml, end)
    part = F.substring(xml, a, F.when(b > a, b - a).otherwise(F.length(xml)))
    found = F.regexp_extract_all(part, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), 1)
    return F.when(a > 0, found).otherwise(F.raise_error(F.lit(f"no marker {start!r} in the sitemap")))


def stream_payload(body: Column) -> Column:
    """The first payload of ``id:payload`` lines that is a JSON object; a body without one fails the query."""
    payloads = F.transform(F.filter(F.split(body, "\n"), lambda x: F.instr(x, ":") > 0), lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))))
    objects = F.filter(payloads, lambda p: p.startswith("{") & F.try_parse_json(p).isNotNull())
    return F.coalesce(F.get(objects, F.lit(0)), F.raise_error(F.lit("no JSON object in the response")).cast("string"))


def search_results(bodies: DataFrame, body: str, base: str) -> DataFrame:
    """A row per found item: total, page, page_size and the item's fields; base is the address before an item's id."""
    parsed = bodies.select(F.from_json(stream_payload(F.col(body)), SEARCH_RESPONSE).alias("r"))
    rows = parsed.select(F.col("r.total").alias("total"), F.col("r.pageNumber").alias("page"), F.col("r.pageSize").alias("page_size"), F.explode_outer("r.items").alias("i"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    day = lambda c: date_of_timestamp(F.col(c))
    return rows.select("total", "page", "page_size", F.concat(F.lit(base), F.col("i.id")).alias("source_url"), F.col("i.docNum").alias("citation"), F.col("i.title").alias("title"), text("i.docType.name").alias("document_type"), F.col("i.agencyName").alias("issuing_body"), day("i.issueDate").alias("issued_date"), day("i.effFrom").alias("effective_date"), day("i.effTo").alias("expiry_date"), text("i.effStatus.name").alias("validity_status"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's JSON array; a missing file is an empty manifest."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.MANIFEST)
    return spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)


def write_log(rows: DataFrame, path: str) -> None:
    """Appends download outcomes as CSV; text fields are quoted by doubling quotes."""
    rows.select(*schemas.DOWNLOAD_LOG.names).write.mode("append").option("quoteAll", True).option("escape", '"').csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows. Quoted fields may hold line breaks, so a file is read as a whole; each write appends its own files."""
    return spark.read.schema(schemas.DOWNLOAD_LOG).option("escape", '"').option("multiLine", True).csv(path)


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, bytes) of all files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    plain = F.regexp_replace("path", "^file:/+", "/")
    top = root.removeprefix("file://").rstrip("/") + "/"
    return files.select(F.substring(plain, F.lit(len(top) + 1), F.length(plain)).alias("path"), F.col("length").alias("bytes"))


def scaffold(spark: SparkSession, root: str) -> list[str]:
    """Makes the tiers' folders with a README each, where they are missing; tells what it made."""
    from lexmill.functions.authority import ASSEMBLY_RESOLUTIONS, LAWS, TIER_FOLDERS

    folders = [*TIER_FOLDERS.values(), *(f"{TIER_FOLDERS[2]}/{c}" for c in (LAWS, ASSEMBLY_RESOLUTIONS))]
    made, jvm = [], spark._jvm
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}/README.md")
        store = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(p):
            out = store.create(p, False)
            out.write(bytearray(f"# {folder}\n".encode()))
            out.close()
            made.append(folder)
    return made
