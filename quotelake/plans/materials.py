"""Similarity, parsing, matching and document queries. Descriptions are derived from parts, tables from items, pages from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions import parse, similarity
from quotelake.functions import text as tx
from quotelake.operators import documents, joins, matching
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

DESCRIBED = """SELECT material_id, name, category, CASE material_id % 5 WHEN 0 THEN 'W' || size || 'x' || (material_id % 300 + 10) || ' beam' WHEN 1 THEN 'HEA ' || (size * 10) || ' EN 10025-2 S355J2' WHEN 2 THEN 'Tubular ' || (600 + material_id % 900) || 'x' || (size + 5) || 'x6000'
 WHEN 3 THEN 'Plate PL' || size || ' EN 10025 S275' ELSE 'Pipe ' || size || '" SCH 40 ASTM A106 GR B SMLS' END AS description FROM materials"""


def described(spark: SparkSession, d: str) -> DataFrame:
    m, n, size = F.col("material_id"), F.col("material_id") % 5, F.col("size").cast("string")
    text = (
        F.when(n == 0, F.concat(F.lit("W"), size, F.lit("x"), (m % 300 + 10).cast("string"), F.lit(" beam")))
        .when(n == 1, F.concat(F.lit("HEA "), (F.col("size") * 10).cast("string"), F.lit(" EN 10025-2 S355J2")))
        .when(n == 2, F.concat(F.lit("Tubular "), (600 + m % 900).cast("string"), F.lit("x"), (F.col("size") + 5).cast("string"), F.lit("x6000")))
        .when(n == 3, F.concat(F.lit("Plate PL"), size, F.lit(" EN 10025 S275")))
        .otherwise(F.concat(F.lit("Pipe "), size, F.lit('" SCH 40 ASTM A106 GR B SMLS')))
    )
    return domain.materials(spark, d).select("material_id", "name", "category", text.alias("description"))


NAMES = "SELECT DISTINCT name FROM materials"
GRAMS = "list_distinct([lower(replace({0}, ' ', ''))[i:i + 1] FOR i IN range(1, length(replace({0}, ' ', '')))])"
JACCARD = "len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE)"
FIRST = "split_part({}, ' ', 1)"
PAIRS = "SELECT a.name AS a, b.name AS b FROM names a JOIN names b ON split_part(a.name, ' ', 2) = split_part(b.name, ' ', 2) AND a.name < b.name"


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part names that share their last word: blocking comes before scoring."""
    n = domain.materials(spark, d).select("name").distinct().withColumn("block", F.split_part("name", F.lit(" "), F.lit(2)))
    return n.select("block", F.col("name").alias("a")).join(n.select("block", F.col("name").alias("b")), "block").filter("a < b").select("a", "b")


@register("s02_edit_similarity", sql("SELECT a, b, levenshtein(lower(a), lower(b)) AS distance, round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 6) AS similarity FROM pairs", names=NAMES, pairs=PAIRS))
def s02(spark, d):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, d).select("a", "b", similarity.distance(a, b).cast("long").alias("distance"), F.round(similarity.similarity(a, b), 6).alias("similarity"))


@register("s05_gram_jaccard", sql(f"SELECT a, b, round({JACCARD.format(GRAMS.format('a'), GRAMS.format('b'))}, 6) AS grams, round({JACCARD.format("string_split(a, ' ')", "string_split(b, ' ')")}, 6) AS tokens FROM pairs", names=NAMES, pairs=PAIRS))
def s05(spark, d):
    a, b = F.col("a"), F.col("b")
    j = similarity.jaccard
    return name_pairs(spark, d).select("a", "b", F.round(j(similarity.grams(a), similarity.grams(b)), 6).alias("grams"), F.round(j(similarity.tokens(a), similarity.tokens(b)), 6).alias("tokens"))


@register("s03_jaro_winkler")
def s03(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(similarity.jaro_winkler("a", "b"), 6).alias("jw"))


def sound(x: str) -> str:
    """Letters as digits, equal ones next to each other as one, behind the first letter."""
    letters = f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')"
    digits = f"translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '111122222222334556')"
    for i in range(1, 7):
        digits = f"regexp_replace({digits}, '{i}+', '{i}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE rpad((left({letters}, 1) || CASE WHEN contains('AEIOUYHW', left({letters}, 1)) THEN {digits} ELSE substr({digits}, 2) END)[1:4], 4, '0') END"


@register("s08_soundex", sql(f"SELECT client_id, {sound('client')} AS code, {sound('client')} = {sound('segment')} AS same FROM clients"))
def s08(spark, d):
    return domain.clients(spark, d).select("client_id", similarity.soundex(F.col("client")).alias("code"), (similarity.soundex(F.col("client")) == similarity.soundex(F.col("segment"))).alias("same"))


def close_names(names: DataFrame, least: float) -> DataFrame:
    """a, b, score: all pairs of different names, both ways, that score `least` or more; `names` has name, distinct.

    Candidates share a key, exactly for any `least` from 0.55 on. Who shares no bigram and no token (and doesn't lack them
    alike) scores at most 0.3 edit + 0.35: from 0.55 on an edit similarity of 2/3 at least, so at most a third of the longer
    name's L characters differ. Then L - 1 - 2L/3 > 0 bigrams with the spaces are shared where L > 3, else one character is.
    """
    if least < 0.55:
        raise ValueError("least is 0.55 at least")
    low, g, t = F.lower("name"), similarity.grams(F.col("name")), similarity.tokens(F.col("name"))
    every = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    marked = lambda mark, values: F.transform(values, lambda x: F.concat(F.lit(mark), x))
    lacks = lambda mark, values: F.when(F.size(values) == 0, F.array(F.lit(mark))).otherwise(F.array().cast("array<string>"))
    short = F.when(F.length(low) <= 3, every(1)).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(marked("g", g), lacks("-g", g), marked("t", t), lacks("-t", t), marked("r", every(2)), marked("c", short)))
    one = names.select("name", F.explode(keys).alias("key"))
    pairs = one.select("key", F.col("name").alias("a")).join(one.select("key", F.col("name").alias("b")), "key").filter("a <> b").select("a", "b").distinct()
    a, b = F.col("a"), F.col("b")
    pairs = pairs.filter(similarity.weighted(a, b, F.lit(1.0)) >= least - 1e-9)  # Jaro-Winkler is at most 1: Python sees only the rest
    return pairs.withColumn("score", F.round(similarity.weighted(a, b, similarity.jaro_winkler("a", "b")), 9)).filter(F.col("score") >= least)


@register("s11_best_match")
def s11(spark, d, least: float = 0.6):
    """For each name the best other one, strictly over the threshold; ties go to the first in order."""
    scored = close_names(domain.materials(spark, d).select("name").distinct(), least).filter(F.col("score") > least)
    return joins.latest(scored, ["a"], [F.desc("score"), F.asc("b")])


@register("s12_all_matches")
def s12(spark, d, least: float = 0.6):
    """For each name all others from the threshold on, best first."""
    scored = close_names(domain.materials(spark, d).select("name").distinct(), least)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("b").alias("b"))))
    return scored.groupBy("a").agg(F.array_join(F.transform(ranked, lambda x: x["b"]), "|").alias("matches"), F.count(F.lit(1)).alias("n"))


@register("m01_parsed", sql(r"""SELECT material_id, CASE WHEN u SIMILAR TO '.*(W[0-9]+X[0-9]|HEA |BEAM).*' THEN 'BEAM' WHEN contains(u, 'TUBULAR') THEN 'TUBULAR' WHEN contains(u, 'PLATE') THEN 'PLATE' ELSE 'PIPE' END AS kind,
 round(CASE WHEN material_id % 5 = 0 THEN regexp_extract(u, 'W([0-9]+)X', 1)::DOUBLE * 25.4 WHEN material_id % 5 = 1 THEN regexp_extract(u, 'HEA ([0-9]+)', 1)::DOUBLE END, 6) AS depth_mm,
 round(CASE WHEN material_id % 5 = 0 THEN regexp_extract(u, 'X([0-9]+)', 1)::DOUBLE * 1.488 END, 6) AS weight_kg_m,
 CASE WHEN material_id % 5 = 2 THEN regexp_extract(u, 'TUBULAR ([0-9]+)', 1)::DOUBLE - 2 * regexp_extract(u, 'X([0-9]+)X', 1)::DOUBLE END AS id_mm,
 CASE WHEN material_id % 5 = 3 THEN regexp_extract(u, 'PL([0-9]+)', 1)::DOUBLE END AS thickness_mm, CASE WHEN material_id % 5 = 4 THEN regexp_extract(u, 'PIPE ([0-9]+)', 1)::DOUBLE END AS nps,
 CASE WHEN material_id % 5 = 1 THEN 'S355J2' WHEN material_id % 5 = 3 THEN 'S275' END AS grade FROM (SELECT *, upper(description) AS u FROM described)""", described=DESCRIBED))
def m01(spark, d):
    a = matching.attributes(described(spark, d), "description")
    k = F.col("kind")
    return a.select(
        "material_id", "kind", F.round("beam.depth_mm", 6).alias("depth_mm"), F.round("beam.weight_kg_m", 6).alias("weight_kg_m"), F.when(k == "TUBULAR", F.col("tubular.id_mm")).alias("id_mm"),
        F.when(k == "PLATE", F.col("plate.thickness_mm")).alias("thickness_mm"), F.when(k == "PIPE", F.col("pipe.nps")).alias("nps"), F.col("en.grade").alias("grade"),
    )


@register("m25_sku", sql("SELECT material_id, upper(split_part(category, ' ', 1)) || '-STEEL-' || CASE material_id % 5 WHEN 1 THEN '10025' || '-2' WHEN 3 THEN '10025' ELSE 'XX' END || '-' || size || '-' || upper(replace(name, ' ', '')) || '-XX' AS sku, CASE WHEN material_id % 5 = 1 THEN 'segments' ELSE '' END AS errors FROM materials"))
def m25(spark, d):
    """Six segments; a standard that holds the separator is found by the check."""
    m = domain.materials(spark, d)
    n = F.col("material_id") % 5
    parts = {"category": F.split_part("category", F.lit(" "), F.lit(1)), "material": F.lit("steel"), "size": F.col("size").cast("string"), "variant": F.col("name"), "standard": F.when(n == 3, "10025")}
    made = F.when(n == 1, F.replace(parse.sku(parts | {"standard": F.lit("S1")}), F.lit("-S1-"), F.lit("-10025-2-"))).otherwise(parse.sku(parts))
    return m.select("material_id", made.alias("sku")).select("material_id", "sku", F.array_join(parse.sku_errors(F.col("sku")), ",").alias("errors"))


@register("s29_quantities", sql("SELECT material_id, floor(base_cost + 0.5)::BIGINT AS q, CASE WHEN material_id % 2 = 0 THEN 'KG' ELSE 'EA' END AS unit FROM materials"))
def s29(spark, d):
    """Prices written in two ways and read again."""
    m = domain.materials(spark, d)
    written = F.when(F.col("material_id") % 2 == 0, F.replace(F.col("base_cost").cast("string"), F.lit("."), F.lit(","))).otherwise(F.col("base_cost").cast("string"))
    return m.select("material_id", tx.quantity(written).alias("q"), tx.unit(F.when(F.col("material_id") % 2 == 0, "Kgs.").otherwise("unknown")).alias("unit"))


@register("s24_weighted_search", r"SELECT doc_id, round((CASE WHEN contains(list_aggregate(w, 'string_agg', ' '), 'x') THEN 0 ELSE 0 END) + 0.1 * len(list_intersect(w, ['the', 'license'])) + 1.0 * len(list_intersect([lower(source)], ['the', 'license'])), 6) AS score FROM (SELECT doc_id, source, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS w FROM documents) WHERE len(list_intersect(w, ['the', 'license'])) > 0")
def s24(spark, d):
    """Words of a term in fields of different weight."""
    s = tx.weighted_search([(F.col("source"), 1.0), (F.col("text"), 0.1)], "the license")
    return domain.read(spark, d, "documents").select("doc_id", F.round(s, 6).alias("score")).filter("score > 0")


@register("s20_page_scores", r"""SELECT doc_id, greatest(least(40, 3 * (contains(low, 'price')::INT + contains(low, 'total')::INT + contains(low, 'item')::INT)) + CASE WHEN coalesce(length(regexp_replace(low, '[^0-9]', '', 'g')) / CAST(nullif(length(low), 0) AS DOUBLE), 0) >= 0.15 THEN 30 ELSE 0 END
 + CASE WHEN regexp_matches(low, '(\t|\|| {3,})') THEN 20 ELSE 0 END + CASE WHEN len(string_split(low, chr(10))) > 30 THEN 10 ELSE 0 END - CASE WHEN contains(low, 'copyright') THEN 50 ELSE 0 END, 0) AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)""")
def s20(spark, d):
    return domain.read(spark, d, "documents").select("doc_id", tx.page_relevance(F.col("text"), ["price", "total", "item"], ["copyright"]).alias("score"))


def tables(spark: SparkSession, d: str) -> DataFrame:
    """Extracted tables of runs: headers by shape, one row for each item."""
    rows = domain.items(spark, d).groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.array(F.col("line_number").cast("string"), F.col("material_id").cast("string"), F.col("quantity").cast("string")))).alias("rows")
    )
    heads = F.when(F.col("run_id") % 3 == 0, F.array(*map(F.lit, ["Item", "Description", "Qty", "Unit"]))).when(F.col("run_id") % 3 == 1, F.array(*map(F.lit, ["Revision", "Date", "Remarks"]))).otherwise(F.array(*map(F.lit, ["Vendor", "Document No", "Item"])))
    return rows.withColumn("headers", heads)


@register("s16_table_scores", sql("SELECT run_id, CASE run_id % 3 WHEN 0 THEN 140 WHEN 1 THEN -35 ELSE -100 END AS score, run_id % 3 = 0 AS accepted FROM (SELECT DISTINCT run_id FROM items)"))
def s16(spark, d):
    return documents.scored_tables(tables(spark, d), "headers", "rows").select("run_id", "score", (F.col("score") >= documents.ACCEPT).alias("accepted"))


@register("d01_chunks", "SELECT doc_id, coalesce(k, 0) AS n, coalesce(pages, 0) AS pages, CASE WHEN p > 200 THEN 'more than 200 pages' END AS error FROM (SELECT doc_id, CAST(1 + coalesce(n_chars, 0) // 500 AS INTEGER) AS p FROM documents) LEFT JOIN (SELECT doc_id, count(*) AS k, sum(last - first + 1)::BIGINT AS pages FROM (SELECT doc_id, s AS first, least(s + CASE WHEN n <= 3 THEN 2 ELSE 3 END, n) AS last FROM (SELECT doc_id, n, unnest(CASE WHEN n <= 3 THEN [1] ELSE range(1, n + 1, 3) END) AS s FROM (SELECT doc_id, CAST(1 + coalesce(n_chars, 0) // 500 AS INTEGER) AS n FROM documents) WHERE n <= 200)) GROUP BY doc_id) USING (doc_id)")
def d01(spark, d):
    """Documents of one page for each 500 characters, in overlapping chunks; those of more than 200 pages are reported, not cut."""
    n = (1 + F.floor(F.coalesce(F.col("n_chars"), F.lit(0)) / 500)).cast("int")
    c = domain.read(spark, d, "documents").select("doc_id", documents.chunks(n).alias("chunks"))
    pages = F.aggregate(F.coalesce("chunks", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    error = F.when(F.col("chunks").isNull(), "more than 200 pages")
    return c.select("doc_id", F.when(F.col("chunks").isNull(), 0).otherwise(F.size("chunks")).cast("long").alias("n"), pages.alias("pages"), error.alias("error"))


@register("w12_page_neighbours", "SELECT DISTINCT doc_id, p AS page FROM (SELECT doc_id, unnest(range(greatest(CAST(hit AS INTEGER) - 2, 1), least(CAST(hit AS INTEGER) + 2, CAST(n AS INTEGER)) + 1)) AS p FROM (SELECT doc_id, 1 + n_chars // 1000 AS n, 1 + doc_id % (1 + n_chars // 1000) AS hit FROM documents))")
def w12(spark, d):
    n = 1 + F.floor(F.col("n_chars") / 1000)
    hits = domain.read(spark, d, "documents").select("doc_id", n.alias("n"), (1 + F.col("doc_id") % n).alias("page"))
    return documents.with_neighbours(hits, "doc_id", "page", "n")


CHUNKED = "SELECT material_id, run_id % 9 AS chunk, quantity, supplier_id::VARCHAR AS note FROM items"


@register("d03_merged_items", sql("""SELECT material_id, island, min(CASE WHEN quantity > 0 THEN quantity END) AS quantity, count(*) AS n_merged FROM (SELECT *, sum(gap) OVER (PARTITION BY material_id ORDER BY chunk RANGE UNBOUNDED PRECEDING)::BIGINT AS island FROM
 (SELECT *, CASE WHEN chunk - lag(chunk) OVER (PARTITION BY material_id ORDER BY chunk) <= 1 THEN 0 ELSE 1 END AS gap FROM chunked)) GROUP BY material_id, island""", chunked=CHUNKED))
def d03(spark, d):
    """The same item in adjacent chunks is one; chains count, gaps part."""
    rows = domain.items(spark, d).select("material_id", (F.col("run_id") % 9).alias("chunk"), "quantity", F.col("quantity").alias("length"), F.col("supplier_id").cast("string").alias("note"), F.lit("x").alias("text"))
    return documents.merged(documents.islands(rows, ["material_id"], "chunk"), ["material_id"], "chunk", ["text"], "quantity", "length", "note").select("material_id", "island", "quantity", "n_merged")


@register("d05_quantity_repair", sql("""SELECT material_id, CASE WHEN q > 100 AND l <= 20 THEN l WHEN q = l AND q > 12 THEN ceil(l / 12) ELSE q END AS quantity, CASE WHEN q > 100 AND l <= 20 THEN 'swap' WHEN q = l AND q > 12 THEN 'pieces' ELSE 'none' END AS method FROM (SELECT material_id, floor(base_cost - 890) * 1.0::DOUBLE AS q, CASE WHEN material_id % 3 = 0 THEN floor(base_cost - 890) * 1.0::DOUBLE ELSE size::DOUBLE END AS l FROM materials)"""))
def d05(spark, d):
    q = F.floor(F.col("base_cost") - 890).cast("double")
    m = domain.materials(spark, d).select("material_id", q.alias("q"), F.when(F.col("material_id") % 3 == 0, q).otherwise(F.col("size").cast("double")).alias("l"))
    r = documents.repaired_quantity(F.col("q"), F.col("l"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return m.select("material_id", r["quantity"].alias("quantity"), r["method"].alias("method"))


@register("d07_weight_checks", sql("SELECT 'item' AS level, 'all' AS name, count(*) FILTER (abs(item_price - c) > 0.01) AS off FROM w UNION ALL SELECT 'subsection', run_id || '/' || line_number, (abs(sum(item_price) - sum(c)) > 0.1)::BIGINT FROM w GROUP BY run_id, line_number UNION ALL SELECT 'section', run_id::VARCHAR, (abs(sum(item_price) - sum(c)) > 0.5)::BIGINT FROM w GROUP BY run_id", w="SELECT *, floor(item_price) + 0.25 AS c FROM items"))
def d07(spark, d):
    w = domain.items(spark, d).withColumn("c", F.floor("item_price") + 0.25)
    return documents.weight_checks(w, "run_id", "line_number", "item_price", "c")


@register("w13_carry_down", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations QUALIFY role <> 'user'")
def w13(spark, d):
    """Answers with the turn of the question above them."""
    c = domain.read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("t"))
    return documents.carried_down(c, "conv_id", "turn", F.col("role") == "user", "t", "question").select("conv_id", "turn", "role", "question")


@register("d13_warnings", sql("SELECT run_id, line_number, material_id, quantity, array_to_string([x FOR x IN [CASE WHEN quantity > 45 THEN 'large quantity' END, CASE WHEN unit_price > 1900 THEN 'high price' END, CASE WHEN discount = 0 THEN 'no discount' END] IF x IS NOT NULL], ',') AS warnings FROM items"))
def d13(spark, d):
    w = documents.warnings({"large quantity": F.col("quantity") > 45, "high price": F.col("unit_price") > 1900, "no discount": F.col("discount") == 0})
    return domain.items(spark, d).select("run_id", "line_number", "material_id", "quantity", F.array_join(w, ",").alias("warnings"))
