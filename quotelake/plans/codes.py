"""Queries of SKU parts, take-off codes and specifications, over the matching queries' descriptions and over words put together by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions import sku
from quotelake.plans.matched import ENTRIES, LINES, entries, lines
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

#: Words that catalogues use; which meet is up to the keys.
KINDS = ["Seamless Pipe", "tubes", "Elbow 90", "steel plate", "Weld neck flange", "FRP grating", "hex bolts", "Gate valve", "H-beam", "gasket", "", "Washers"]
STEELS = ["Carbon Steel", "ltcs", "Low Temperature Carbon Steel", "SS 316", "stainless", "Chrome Moly", "pultruded resin", "mild steel A36", "unobtainium", "", "copper", "304L"]
CODES = ["BOLT-A193B7M-ZP", "bolt a193b7 hdg", "NUT-A194 2H", "STUD A320L7M BLACK", "SCREW SAE J429 zinc", "WASHER plain", "A325 HOT-DIP", "A490"]
NOTES = ["molded panel", "finish: galvanised (HDG)", "", "bitumen coat"]


def _pick(pool: list[str], by: str) -> str:
    return "list_value(" + ", ".join(f"'{x}'" for x in pool) + f")[1 + ({by}) % {len(pool)}]"


WORDED = f"SELECT material_id, {_pick(KINDS, 'material_id')} AS kind, {_pick(STEELS, 'material_id // 3')} AS steel, {_pick(CODES, 'material_id // 5')} AS code, {_pick(NOTES, 'material_id // 7')} AS notes FROM materials"


def worded(spark, d):
    m = F.col("material_id")
    pick = lambda pool, by: F.get(F.array(*map(F.lit, pool)), (F.floor(by) % len(pool)).cast("int"))
    return domain.materials(spark, d).select("material_id", pick(KINDS, m).alias("kind"), pick(STEELS, m / 3).alias("steel"), pick(CODES, m / 5).alias("code"), pick(NOTES, m / 7).alias("notes"))


def _case(text: str, codes: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {text} = '{k}' THEN '{v}'" for k, v in codes.items()) + " " + " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in codes.items()) + " END"


def _finish(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper({text}), '{p}') THEN '{k}'" for k, p in sku.FINISHES.items()) + " END"


@register("m24_sku_codes", sql(f"""SELECT material_id, CASE WHEN kind = '' THEN 'UNK' ELSE coalesce({_case('lower(kind)', sku.CATEGORIES)}, rpad(upper(kind)[1:4], 4, 'X')) END AS category,
 coalesce(CASE WHEN steel <> '' THEN {_case('lower(steel)', sku.MATERIALS)} END, CASE WHEN regexp_matches(lower(kind), 'frp|grating') THEN CASE WHEN contains(lower(steel), 'pultruded') THEN 'FRPP' WHEN contains(lower(steel), 'molded') THEN 'FRPM' WHEN contains(lower(notes), 'pultruded') THEN 'FRPP' WHEN contains(lower(notes), 'molded') THEN 'FRPM' END END, 'UNK') AS material,
 nullif(regexp_extract(upper(code), '{sku.FASTENER_GRADES}', 1), '') AS grade, coalesce({_finish('code')}, {_finish('notes')}) AS finish FROM worded""", worded=WORDED))  # fmt: skip
def m24_sku(spark, d):
    """Parts of SKUs from what catalogues say: category, material, grade and finish of fasteners."""
    c = F.col
    return worded(spark, d).select(
        "material_id", sku.category_code(c("kind")).alias("category"), sku.material_code_of(c("steel"), c("kind"), c("notes")).alias("material"), sku.fastener_grade(c("code")).alias("grade"), sku.finish(c("code"), c("notes")).alias("finish")
    )


CONES = "SELECT DISTINCT 'Cone ' || (600 + material_id % 900) || '.5 -> ' || (400 + material_id % 700) || ' x ' || size AS description FROM materials UNION SELECT DISTINCT (300 + material_id % 1500) || 'x' || (2 + size) || CASE WHEN material_id % 3 = 0 THEN ' rolled' ELSE '' END FROM materials"
TEXTS = "SELECT DISTINCT description FROM entries UNION SELECT DISTINCT description FROM lines UNION SELECT description FROM cones"
N = r"([0-9]+(?:\.[0-9]+)?)"
CONE, TUBE = rf"{N}\s*(?:→|->|>|-)\s*{N}\s*[×X]\s*{N}", rf"{N}\s*[×X]\s*{N}"


def texts(spark, d):
    m = domain.materials(spark, d)
    cones = m.select(F.expr("'Cone ' || (600 + material_id % 900) || '.5 -> ' || (400 + material_id % 700) || ' x ' || size").alias("description"))
    tubes = m.select(F.expr("(300 + material_id % 1500) || 'x' || (2 + size) || CASE WHEN material_id % 3 = 0 THEN ' rolled' ELSE '' END").alias("description"))
    return entries(spark, d).select("description").union(lines(spark, d).select("description")).union(cones).union(tubes).distinct()


def _code(pattern: str, group: int = 1) -> str:
    return f"replace(regexp_replace(CAST(CAST(regexp_extract(u, '{pattern}', {group}) AS DOUBLE) AS VARCHAR), '\\.0$', ''), '.', '_')"


@register("m21_takeoff_codes", sql(f"""SELECT description, 'M-CS-' || CASE WHEN regexp_matches(u, 'W[0-9]+X[0-9]+') THEN 'BEAM-' || regexp_extract(u, 'W[0-9]+X[0-9]+') || '-ROLL' WHEN regexp_matches(u, 'PL[0-9]+') THEN 'PLATE-T' || regexp_extract(u, 'PL([0-9]+)', 1) || '-PLAT'
 WHEN regexp_matches(u, '{CONE}') THEN 'CONE-' || {_code(CONE)} || '_' || {_code(CONE, 2)} || '_T' || {_code(CONE, 3)} || '-FABR'
 WHEN regexp_matches(u, '{TUBE}') THEN CASE WHEN seamless THEN 'PIPE-' ELSE 'TUBROLLED-' END || 'OD' || {_code(TUBE)} || '_WT' || {_code(TUBE, 2)} || CASE WHEN seamless THEN '-SEAM' ELSE '-ROLL' END END || '-A106GRB' AS code FROM (
 SELECT *, regexp_matches(u, 'SEAMLESS|SMLS|PIPE') OR (NOT regexp_matches(u, 'ROLLED|TUBULAR|TUBE') AND TRY_CAST(nullif(regexp_extract(u, '{TUBE}', 1), '') AS DOUBLE) < 1000) AS seamless FROM (SELECT description, upper(trim(description)) AS u FROM texts))""", entries=ENTRIES, lines=LINES, cones=CONES, texts=TEXTS))  # fmt: skip
def m21(spark, d):
    """Codes of take-off lines by shape."""
    return texts(spark, d).select("description", sku.takeoff_code(F.col("description"), F.lit("cs"), F.lit("ASTM A106 Gr.B")).alias("code"))


BEAM = r"(?i)^(W|HEA|HEB|HEM|IPE|UB|UC|WF)\s*([0-9]+)\s*[xX×]\s*([0-9]+)"
SPEC_TUBE = rf"^{N}\s*[xX×]\s*{N}\s*[xX×]?\s*{N}?"


@register("m22_specifications", sql(rf"""SELECT description, CASE WHEN b THEN 'BEAM' WHEN t THEN 'TUBULAR' WHEN p THEN 'PLATE' WHEN i THEN 'PIPE' WHEN e THEN 'STANDARD' END AS kind,
 CASE WHEN b THEN regexp_extract(description, '{BEAM}', 2)::DOUBLE WHEN t THEN od WHEN p THEN regexp_extract(description, '(?i)^PL\s*([0-9]+)', 1)::DOUBLE WHEN i THEN regexp_extract(description, '(?i)([0-9]+)\s*["'']\s*(?:SCH|Schedule|DN|NPS)', 1)::DOUBLE WHEN e THEN regexp_extract(description, '(?i)EN\s*([0-9]+)', 1)::DOUBLE END AS first,
 CASE WHEN b THEN regexp_extract(description, '{BEAM}', 3)::DOUBLE WHEN t THEN wall END AS second, CASE WHEN b THEN 0.9 WHEN t THEN CASE WHEN len IS NULL THEN 0.85 ELSE 0.95 END WHEN p THEN 0.9 WHEN i THEN 0.85 WHEN e THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence FROM (
 SELECT *, coalesce(od > 100 AND od < 50000 AND wall > 1 AND wall < 500, false) AS t FROM (SELECT description, regexp_matches(description, '{BEAM}') AS b, regexp_matches(description, '(?i)^PL\s*([0-9]+)') AS p, regexp_matches(description, '(?i)([0-9]+)\s*["'']\s*(?:SCH|Schedule|DN|NPS)') AS i, regexp_matches(description, '(?i)EN\s*([0-9]+)') AS e,
 TRY_CAST(nullif(regexp_extract(description, '{SPEC_TUBE}', 1), '') AS DOUBLE) AS od, TRY_CAST(nullif(regexp_extract(description, '{SPEC_TUBE}', 2), '') AS DOUBLE) AS wall, nullif(regexp_extract(description, '{SPEC_TUBE}', 3), '') AS len FROM texts))""", entries=ENTRIES, lines=LINES, cones=CONES, texts=TEXTS))  # fmt: skip
def m22(spark, d):
    """Specifications by how they begin."""
    s = sku.specification(F.col("description"))
    return texts(spark, d).select("description", s["kind"].alias("kind"), s["first"].alias("first"), s["second"].alias("second"), s["confidence"].alias("confidence"))
