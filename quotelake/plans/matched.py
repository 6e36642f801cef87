"""Matching queries: descriptions of items, written independently of the catalogue's, parsed and matched with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions import parse
from quotelake.operators import matching
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

#: Of a catalogue entry (k: material_id, s: size) and of an item (k from supplier and line number, s: quantity); the same text in Spark and DuckDB.
ENTRY = """CASE k % 8 WHEN 0 THEN 'W' || s || 'x' || (k % 90 + 10) || ' beam' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'HEB ' ELSE 'HEA ' END || (s * 10) || ' x 300 x ' || (k % 20 + 5) || ' EN 10025-2 S355J2'
 WHEN 2 THEN 'Tubular ' || (600 + k % 900) || 'x' || (s % 30 + 5) || 'x6000' || CASE WHEN k % 3 = 0 THEN ' EN 10225 S355' ELSE '' END WHEN 3 THEN 'Plate PL' || s || ' EN 10025 S' || CASE WHEN k % 3 = 0 THEN '275' ELSE '355' END
 WHEN 4 THEN 'Pipe ' || s || '" SCH ' || CASE k % 3 WHEN 0 THEN '40' WHEN 1 THEN '80' ELSE '160' END || ' ASTM A106 GR B SMLS' || CASE WHEN k % 5 = 0 THEN ' carbon steel' ELSE '' END
 WHEN 5 THEN 'Flange ' || s || '" ' || (150 * (1 + k % 3)) || '# ASTM A105 RF' WHEN 6 THEN 'Gasket ring ' || s || '"' ELSE 'Valve ' || s || '" API 5L GR X' || (k % 40 + 30) END"""
LINE = """CASE k % 9 WHEN 0 THEN 'w' || s || ' x ' || (k % 70 + 12) WHEN 1 THEN 'Beam HEA ' || (s * 10 + k % 2) || ' x 300 EN 10025-2' WHEN 2 THEN 'TUBE ' || (590 + k % 950) || ' x ' || (s % 40 + 4) || '.5'
 WHEN 3 THEN 'plate ' || (s + 1) || ' mm EN 10025 S355' WHEN 4 THEN 'pipe DN' || (25 * s) || ' sch 40 A106B seamless CS' WHEN 5 THEN 'Spectacle blind ' || s || ' inch' WHEN 6 THEN 'flange ' || s || '" 300# A105 GR N'
 WHEN 7 THEN 'ring gasket ' || s || '" spiral' ELSE 'copper washer no ' || k END"""
ENTRIES = f"SELECT material_id, {ENTRY} AS description FROM (SELECT material_id, material_id AS k, size AS s FROM materials)"
LINES = f"SELECT run_id, line_number, material_id, quantity, item_price, {LINE} AS description FROM (SELECT *, supplier_id * 31 + line_number * 7 + run_id % 3 AS k, CAST(quantity AS INT) AS s FROM items)"


def entries(spark: SparkSession, d: str) -> DataFrame:
    return domain.materials(spark, d).withColumns({"k": F.col("material_id"), "s": F.col("size")}).select("material_id", F.expr(ENTRY).alias("description"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    i = domain.items(spark, d).withColumns({"k": F.expr("supplier_id * 31 + line_number * 7 + run_id % 3"), "s": F.col("quantity").cast("int")})
    return i.select("run_id", "line_number", "material_id", "quantity", "item_price", F.expr(LINE).alias("description"))


NUM, BY = r"([0-9]+(?:\.[0-9]+)?)", r"\s*[X×]\s*"


def _x(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(u, '{pattern}', {group}), '')"


def _case(column: str, names: dict) -> str:
    return "CASE " + " ".join(f"WHEN {column.format(k)} THEN {v!r}" for k, v in names.items()) + " END"


W, HE, PL, MM = rf"\bW\s*{NUM}{BY}{NUM}", rf"\b(HE[AB])\s*{NUM}", r"\bPL(?:ATE)?\s*([0-9]+(?:\.[0-9]+)?)", rf"{NUM}\s*MM\b"
TUB = rf"(?:^|[^0-9.W]){NUM}{BY}{NUM}(?:{BY}{NUM})?"
INCH = f"""coalesce({_x(NUM + r'\s*(?:"|INCH\b|IN\b)')}::DOUBLE, {_case("regexp_matches(u, '\\b{}\\s*(INCH|IN)\\b')", parse.SIZE_WORDS)}, {_case(_x(r'\bDN\s*([0-9]+)').replace('{', '{{').replace('}', '}}') + " = '{}'", parse.DN_INCHES)}, floor({_x(r'\bDN\s*([0-9]+)')}::DOUBLE / 25 * 2 + 0.5) / 2)"""
SCH = _x(r"\bSCH(?:EDULE)?\.?\s*([0-9]+S?|STD|XS|XXS)\b")
PARSED = f"""SELECT *,
 CASE WHEN regexp_matches(u, '\\bW\\s*[0-9.]+{BY}[0-9]|\\bHE[AB]\\s*[0-9]|\\bBEAM\\b') THEN 'BEAM' WHEN regexp_matches(u, '\\b(TUBULAR|TUBE)\\b') THEN 'TUBULAR' WHEN regexp_matches(u, '\\bPL(ATE)?\\s*[0-9]|\\bPLATE\\b') THEN 'PLATE' WHEN regexp_matches(u, '\\bPIPE\\b|\\bSCH') THEN 'PIPE' ELSE 'OTHER' END AS kind,
 CASE WHEN regexp_matches(u, '{W}') THEN 'W' ELSE {_x(HE)} END AS family, CASE WHEN regexp_matches(u, '{W}') THEN {_x(W)}::DOUBLE * 25.4 ELSE {_x(HE, 2)}::DOUBLE END AS depth, {_x(W, 2)}::DOUBLE * 1.488 AS weight,
 {_x(TUB)}::DOUBLE AS od, {_x(TUB, 2)}::DOUBLE AS wall,
 coalesce({_x(PL)}::DOUBLE, {_x(MM)}::DOUBLE, CASE WHEN contains(u, 'PLATE') AND {_x(r'\b([0-9]{1,3})\b')}::DOUBLE BETWEEN 6 AND 200 THEN {_x(r'\b([0-9]{1,3})\b')}::DOUBLE END) AS thickness,
 {_x(r'\bEN\s*([0-9]{5}(?:-[0-9])?)')} AS en, {_x(r'\b(S[0-9]{3}[A-Z0-9]*)\b')} AS en_grade,
 {INCH} AS nps, {SCH} AS schedule, {_case("regexp_matches(u, '{}')", {v: k for k, v in parse.FAMILIES.items()})} AS steel, {_x(r'\b(A[0-9]{2,3}[A-Z]?)\b')} AS astm, {_x(r'\bGR(?:ADE)?\.?\s*([A-Z0-9]+)\b')} AS grade,
 CASE WHEN regexp_matches(u, '\\b(SMLS|SEAMLESS)\\b') THEN 'S' WHEN regexp_matches(u, '\\b(WELDED|ERW|SAW)\\b') THEN 'W' END AS form,
 {_case("regexp_matches(u, '{}')", {v: k for k, v in parse.PRODUCTS.items()})} AS product, {_x(r'\b(?:ASTM\s*)?(A[0-9]{2,3}[A-Z]?|B16\.[0-9]+|API\s?5L)\b')} AS standard, coalesce({SCH}, {_x(r'\b([0-9]+#)')}) AS rating
 FROM (SELECT *, upper(description) AS u FROM _texts_)"""
PARTLY = "CASE WHEN l.{0} = c.{0} THEN {1} WHEN contains(l.{0}, c.{0}) OR contains(c.{0}, l.{0}) THEN {2} ELSE 0 END"
SAME = "CASE WHEN l.{0} = c.{0} THEN {1} ELSE 0 END"
BOTH = " + ".join(f"CASE WHEN contains(l.u, '{w}') AND contains(c.u, '{w}') THEN 2 ELSE 0 END" for w in ("SEAMLESS", "WELDED", "PIPE", "SCH"))
POINTS = f"""least(100, CASE l.kind WHEN 'BEAM' THEN {SAME.format('family', 40)} + CASE WHEN l.depth = c.depth THEN 30 WHEN abs(l.depth - c.depth) <= 1 THEN 20 ELSE 0 END
 + CASE WHEN l.weight = c.weight THEN 30 WHEN abs(l.weight - c.weight) / c.weight <= 0.05 THEN 20 ELSE 0 END + {SAME.format('en', 10)}
 WHEN 'TUBULAR' THEN CASE WHEN l.od = c.od THEN 50 WHEN abs(l.od - c.od) / c.od <= 0.01 THEN 40 WHEN abs(l.od - c.od) / c.od <= 0.05 THEN 25 ELSE 0 END + {SAME.format('en', 10)}
 + CASE WHEN l.wall = c.wall THEN 50 WHEN abs(l.wall - c.wall) <= 0.5 OR abs(l.wall - c.wall) / c.wall <= 0.05 THEN 40 WHEN abs(l.wall - c.wall) <= 2 OR abs(l.wall - c.wall) / c.wall <= 0.1 THEN 25 ELSE 0 END
 WHEN 'PLATE' THEN CASE WHEN l.thickness = c.thickness THEN 60 WHEN abs(l.thickness - c.thickness) <= 0.5 THEN 50 WHEN abs(l.thickness - c.thickness) <= 2 THEN 35 ELSE 0 END + {SAME.format('en', 20)} + {SAME.format('en_grade', 20)}
 WHEN 'PIPE' THEN CASE WHEN l.nps = c.nps THEN 30 WHEN abs(l.nps - c.nps) <= 0.5 THEN 20 ELSE 0 END + {PARTLY.format('schedule', 25, 15)} + {SAME.format('steel', 15)} + {PARTLY.format('astm', 15, 10)} + {PARTLY.format('grade', 10, 5)} + {SAME.format('form', 5)} + {BOTH}
 ELSE {PARTLY.format('standard', 30, 20)} + {PARTLY.format('grade', 25, 15)} + {SAME.format('nps', 25)} + {PARTLY.format('rating', 20, 10)} + {SAME.format('product', 10)} END)"""
MARKS = " + ".join(f"CASE WHEN contains(l.u, '{w}') AND contains(c.u, '{w}') THEN 5 ELSE 0 END" for w in ("SPADE", "SPECTACLE", "RING"))


@register("m17_best_matches", sql(f"""SELECT run_id, line_number, i.material_id AS item_material, quantity, item_price, f.material_id, score, rank, coalesce(strategy, 'none') AS strategy, coalesce(score >= 90 AND rank = 1, false) AS auto
 FROM lines i LEFT JOIN f USING (description)""", entries=ENTRIES, lines=LINES, texts="SELECT DISTINCT description FROM lines", l=PARSED.replace("_texts_", "texts"), c=PARSED.replace("_texts_", "entries"),
 scored=f"SELECT l.description, c.material_id, {POINTS} AS score FROM l JOIN c ON l.kind = c.kind",
 best="SELECT description, material_id, score, 'match' AS strategy FROM scored WHERE score >= 40 QUALIFY row_number() OVER (PARTITION BY description ORDER BY score DESC, material_id) <= 3",
 missed="SELECT * FROM l WHERE description NOT IN (SELECT description FROM best)",
 pipes="SELECT l.description, c.material_id, 55 AS score, 'pipe fallback' AS strategy FROM missed l JOIN c ON c.kind = 'PIPE' AND l.kind = 'PIPE' AND l.nps = c.nps QUALIFY row_number() OVER (PARTITION BY l.description ORDER BY coalesce(TRY_CAST(c.schedule AS INT), 999), c.material_id) = 1",
 fallen=f"SELECT * FROM (SELECT l.description, c.material_id, least(40, 20 + {SAME.format('nps', 10)} + {MARKS}) AS score, 'product fallback' AS strategy FROM missed l JOIN c ON l.kind = 'OTHER' AND l.product = c.product AND c.product IN ('FLANGE', 'GASKET')) WHERE score >= 25 QUALIFY row_number() OVER (PARTITION BY description ORDER BY score DESC, material_id) <= 3",
 f="SELECT *, row_number() OVER (PARTITION BY description ORDER BY score DESC, material_id) AS rank FROM (SELECT * FROM best UNION ALL SELECT * FROM pipes UNION ALL SELECT * FROM fallen)"))
def m17(spark, d):
    """Up to three catalogue entries of each item, against all pairs of descriptions in the SQL; lines without any stay for review."""
    i = lines(spark, d).withColumn("line", F.struct("run_id", "line_number", F.col("material_id").alias("item_material"), "quantity", "item_price"))
    out = matching.best_matches(i, entries(spark, d), "description", "line", "material_id")
    return out.select("line.*", "material_id", "score", F.col("rank").cast("long").alias("rank"), "strategy", "auto")


@register("m05_best_parser", sql(f"""SELECT description, CASE WHEN top = 0 THEN NULL WHEN b = top THEN 'BEAM' WHEN t = top THEN 'TUBULAR' ELSE 'PLATE' END AS kind, CASE WHEN top = 0 THEN 0.0 ELSE greatest(top, e) END::DOUBLE AS confidence, ambiguous FROM (SELECT *, greatest(b, t, p) AS top FROM (
 SELECT description, CASE WHEN family = 'W' THEN 0.95 WHEN family IS NOT NULL THEN 0.9 WHEN regexp_matches(u, '\\bI(?:PE)?\\s*[0-9]') THEN 0.7 WHEN regexp_matches(u, '\\bBEAM\\b') THEN 0.5 ELSE 0 END AS b,
 CASE WHEN od IS NULL THEN 0 WHEN od > 500 OR regexp_matches(u, '\\b(TUBULAR|TUBE)\\b') THEN 0.9 WHEN od BETWEEN 50 AND 500 THEN 0.7 ELSE 0.4 END AS t,
 CASE WHEN regexp_matches(u, '{PL}') THEN 0.95 WHEN regexp_matches(u, '{MM}') THEN 0.85 WHEN thickness IS NOT NULL THEN 0.6 ELSE 0 END AS p,
 CASE WHEN en IS NULL THEN 0 WHEN regexp_matches(u, '\\bEN\\s*[0-9]{{5}}(?:-[0-9])?\\s+S[0-9]{{3}}[A-Z0-9]*\\s+[A-Z][0-9][A-Z0-9]+\\b') THEN 0.95 WHEN en_grade IS NOT NULL THEN 0.85 ELSE 0.7 END AS e,
 regexp_matches(u, 'W\\s*[0-9]+{BY}[0-9]|HE[AB]')::INT + contains(u, 'TUBULAR')::INT + regexp_matches(u, 'PL\\s*[0-9]')::INT + regexp_matches(u, '[0-9]\\s*"\\s*SCH')::INT > 1 AS ambiguous FROM l))""",
 entries=ENTRIES, lines=LINES, texts="SELECT DISTINCT description FROM lines UNION SELECT DISTINCT description FROM entries UNION SELECT DISTINCT description || ' on ' || lower(description) FROM entries", l=PARSED.replace("_texts_", "texts")))
def m05(spark, d):
    """The surest parser of each description, and whether it looks like several kinds."""
    e = entries(spark, d).select("description")
    texts = lines(spark, d).select("description").union(e).union(e.select(F.concat("description", F.lit(" on "), F.lower("description")))).distinct()
    b = parse.best(*map(F.col, ("beam", "tubular", "plate", "en")))
    return matching.attributes(texts, "description").select("description", b["kind"].alias("kind"), b["confidence"].cast("double").alias("confidence"), parse.ambiguous(F.col("description")).alias("ambiguous"))
