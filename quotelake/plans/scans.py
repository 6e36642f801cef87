"""Queries of scans, files, filters and small jobs: tenants, ranges, written and reread files, pages, versions, expiries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.operators import documents, filters, sinks
from quotelake.registry import register
from quotelake.sources import domain, files
from quotelake.sources.domain import sql
from quotelake.streaming.flows import scratch

#: A day on which orders were still coming in.
TODAY = "2001-06-30"
TENANTED = "SELECT *, CASE WHEN supplier_id % 7 = 0 THEN NULL ELSE 't' || (supplier_id % 5) END AS tenant_id FROM items"


def tenanted(spark, d, shared: bool):
    i = domain.items(spark, d).withColumn("tenant_id", F.when(F.col("supplier_id") % 7 == 0, None).otherwise(F.concat(F.lit("t"), (F.col("supplier_id") % 5).cast("string"))))
    return filters.TenantCatalog({"items": i}, "t2", frozenset({"items"}) if shared else frozenset()).table("items")


SUMS = "supplier_id, count(*) AS n, round(sum(item_price), 4) AS price"


def sums(df):
    return df.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("item_price"), 4).alias("price"))


@register("io02_tenant_scan", sql(f"SELECT {SUMS} FROM tenanted WHERE tenant_id = 't2' GROUP BY supplier_id", tenanted=TENANTED))
def io02(spark, d):
    """One tenant's rows only; nobody's rows are not its own."""
    return sums(tenanted(spark, d, False))


@register("io03_shared_scan", sql(f"SELECT {SUMS} FROM tenanted WHERE tenant_id = 't2' OR tenant_id IS NULL GROUP BY supplier_id", tenanted=TENANTED))
def io03(spark, d):
    """One tenant's rows, and nobody's."""
    return sums(tenanted(spark, d, True))


@register("f05_default_range", sql(f"SELECT status, count(*) AS n FROM runs WHERE CAST(created_at AS DATE) BETWEEN CAST('{TODAY}' AS DATE) - 90 AND CAST('{TODAY}' AS DATE) GROUP BY status"))
def f05(spark, d):
    """Without valid dates: the last 90 days."""
    start, end = filters.default_range("not a date", None, TODAY)
    return domain.runs(spark, d).filter(F.to_date("created_at").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("f06_optional_predicates", sql("SELECT reason, count(*) AS n FROM runs WHERE status = 'approved' AND outcome = 'won' GROUP BY reason"))
def f06(spark, d):
    """Only what is given filters."""
    return domain.runs(spark, d).filter(filters.optional({"status": "approved", "outcome": "won", "client_id": None})).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("io04_price_csv", sql("SELECT 'M-' || material_id AS material_code, CASE WHEN material_id % 10 = 0 THEN NULL ELSE base_cost END AS base_cost, nullif(trim(name), '') AS notes FROM materials"))
def io04(spark, d):
    """Prices written as CSV, with costs that are no numbers and blanks around texts, and read again."""
    m = domain.materials(spark, d)
    cost = F.when(F.col("material_id") % 10 == 0, "n/a").otherwise(F.col("base_cost").cast("string"))
    path = scratch(spark)
    m.select(F.concat(F.lit("M-"), F.col("material_id").cast("string")).alias("material_code"), cost.alias("base_cost"), F.concat(F.lit(" "), "name", F.lit(" ")).alias("notes")).write.option("header", True).csv(path)
    return files.read_prices(spark, path).select("material_code", "base_cost", "notes")


@register("io10_flat_export", sql("SELECT run_id::VARCHAR AS run_id, n::VARCHAR AS totals_n, floor(p)::BIGINT::VARCHAR AS totals_price, '[1,2]' AS tags FROM (SELECT run_id, count(*) AS n, sum(item_price) AS p FROM items GROUP BY run_id)"))
def io10(spark, d):
    """Nested rows as CSV: structs by prefix, arrays as JSON."""
    t = domain.items(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("item_price").cast("decimal(18,4)")).alias("p"))  # exact in any order: a whole total stays whole
    path = scratch(spark)
    files.export_flat(t.select("run_id", F.struct("n", F.floor("p").alias("price")).alias("totals"), F.array(F.lit(1), F.lit(2)).alias("tags")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@register("io12_json_export", sql("SELECT run_id, client_id, outcome FROM runs"))
def io12(spark, d):
    """Features as JSON lines; nulls are written too."""
    path = scratch(spark)
    files.export_json(domain.runs(spark, d).select("run_id", "client_id", "outcome"), path)
    return spark.read.schema("run_id long, client_id long, outcome string").json(path)


@register("io06_pages", "SELECT doc_id, CAST(page AS INTEGER) AS page, length(p) AS chars FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS page FROM documents)")
def io06(spark, d):
    """Texts cut at form feeds (lines of the documents stand for pages)."""
    t = domain.read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return documents.pages(t, "doc_id", "text").select("doc_id", F.col("page").cast("int").alias("page"), F.length("text").cast("long").alias("chars"))


@register("w06_next_version", sql("SELECT client_id, count(DISTINCT status) + 1 AS next_version FROM runs GROUP BY client_id"))
def w06_next(spark, d):
    """The version after the newest of each client (its states stand for versions), 1 where there is none yet."""
    r = domain.runs(spark, d).select("client_id", "status").distinct()
    ranked = r.groupBy("client_id").agg(F.count(F.lit(1)).alias("version"))
    return sinks.next_versions(ranked, ["client_id"], "version")


@register("t10_expiring", sql(f"SELECT run_id, CAST(created_at AS DATE) + 90 AS valid_until, datediff('day', CAST('{TODAY}' AS DATE), CAST(created_at AS DATE) + 90) AS days_left FROM runs WHERE status = 'approved' AND CAST(created_at AS DATE) + 90 BETWEEN CAST('{TODAY}' AS DATE) AND CAST('{TODAY}' AS DATE) + 30"))
def t10(spark, d):
    """The daily look at what expires within 30 days (offers hold for 90)."""
    until = F.date_add(F.to_date("created_at"), 90)
    return filters.expiring(domain.runs(spark, d).filter("status = 'approved'").withColumn("valid_until", until), "valid_until", TODAY, 30).select("run_id", "valid_until", F.col("days_left").cast("long").alias("days_left"))


SHEETS = "SELECT 'Offer ' || (supplier_id % 5) AS title, 'month ' || (supplier_id % 3) AS sheet, count(*) AS n, sum(CAST(floor(quantity) AS BIGINT))::BIGINT AS quantity, count(*) FILTER (line_number > 2) AS noted FROM items GROUP BY ALL"


#: Rows of a sheet here, about.
SHEET_ROWS = 20_000


@register("io05_sheets", sql(SHEETS))
def io05(spark, d):
    """Workbooks with three sheets of each offer, headers at different rows and columns in different places; read again by sheet, rows by header.

    A sheet is full at 1,048,576 rows and is written by one task: an offer's rows are dealt over as many workbooks as keep its sheets at about SHEET_ROWS.
    """
    i = domain.items(spark, d).select((F.col("supplier_id") % 5).alias("offer"), (F.col("supplier_id") % 3).alias("month"), F.floor("quantity").alias("quantity"), "line_number", "material_id", "run_id")
    books = i.groupBy("offer").agg(F.ceil(F.count(F.lit(1)) / (3 * SHEET_ROWS)).alias("books"))
    i = i.join(F.broadcast(books), "offer").withColumn("book", F.pmod(F.xxhash64("run_id", "material_id"), "books"))
    own = ["offer", "book", "month"]
    offer, head = F.concat(F.lit("Offer "), F.col("offer").cast("string")), 2 + F.col("month")
    number = F.row_number().over(Window.partitionBy(*own).orderBy("material_id", "line_number", "quantity"))
    cells = lambda item, qty, note: F.when(F.col("month") == 1, F.array(qty, F.lit(""), item, note)).otherwise(F.array(item, qty, note))
    body = i.withColumn("n", number).select(*own, (head + F.col("n")).alias("row"), cells(F.col("material_id").cast("string"), F.col("quantity").cast("string"), F.when(F.col("line_number") > 2, "late").otherwise("")).alias("cells"))
    every = i.select(*own).distinct()
    above = every.select(*own, F.lit(1).alias("row"), F.array(offer).alias("cells")).unionByName(every.select(*own, head.alias("row"), cells(F.lit("Item"), F.lit("Qty"), F.lit("Note")).alias("cells")))
    path = scratch(spark)
    name = F.concat_ws(" ", "offer", "book", F.lit("month"), F.col("month").cast("string"))
    n = books.agg(F.sum("books")).first()[0] or 1
    files.write_sheets(body.unionByName(above).withColumn("sheet", name).repartition(n, "offer", "book"), path)  # every sheet lies whole in one file
    back = files.keyed_sheets(files.read_sheets(spark, path), ["item", "qty"], tops=files.read_sheets(spark, path, 20))
    sheet = F.regexp_extract("sheet", "month.*$", 0)
    return back.groupBy("title", sheet.alias("sheet")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cells")["qty"].cast("long")).alias("quantity"), F.count_if(F.coalesce(F.col("cells")["note"], F.lit("")) != "").alias("noted"))
