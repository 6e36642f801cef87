"""SKUs of catalogue records put together by key from what catalogues say, one query for each category, with SQL that restates the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions import sku_parts as s
from quotelake.functions.sku import CATEGORIES, FASTENER_GRADES, FINISHES, MATERIALS
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

#: Which meet is up to the keys.
POOLS = {
    "category": ["PIPE", "FITG", "FLNG", "FAST", "GRAT", "Seamless Pipe", "FRP Grating", "Gate valve", "", "FITTING 45"],
    "code": ["PIPE-A106B-SCH40", "ELB90-A234-SCH STD", "TEE-A420", "WNRF-300-A105", "BLRF-A182-PN16", "BOLT-A193B7M-ZP", "HEXBOLT-A325", "ANCHORBOLT-NUT M20 HDG", "TA-305-40-S-G", "KGSB-TA-25-3-P-B", "RECC-A234 SCH 80",
        "NUT-A194 2H BLACK", "", "PIPE X52 GR.B", "150-SORF", "STUD-BOLT A320L7 zinc", "ELBOW 45 SCHXXS", "COUPLING 3000"],
    "material_type": ["Carbon Steel", "SS 316", "", "pultruded resin", "LTCS", ""],
    "spec_standard": ["ASTM A106 Gr.B", "API 5L X42", "B16.9", "ASTM B444", "api 600", "ASME B31.3", "EN 10204", "", "din 2448", "a-1", ""],
    "size": ['4" SCH40', "0.75IN", "dn 50", "30x5", "12", "2.50", '1.5"', "M20-A", "", "12.5 x", "", "sch xs", "0.5 in pipe", "½"],
    "grade": ["Gr.B", "TP316L", "", "non-China", "Serrated surface", "X60", "unknown", "", "ERW"],
    "notes": ['{"standard":"ASTM A333 Gr.6","form":"Seamless"}', '{"nps_inch":4,"schedule":"40"}', '{"load_bar_width_mm":30,"load_bar_thickness_mm":5,"surface":"smooth"}', '{"fastener_type":"Hex bolt","finish":"hot dip galvanized"}',
        '{"material_family":"carbon steel","size":"DN 50"}', "no json, molded and galvanised", "", '{"fitting_type":"Long elbow","spec_standard":"A53"}'],
    "origin": ["china", "non_china", "", "Vietnam"],
}
STEPS = {"category": (1, 3), "code": (7, 3), "material_type": (3, 5), "spec_standard": (5, 7), "size": (11, 2), "grade": (2, 9), "notes": (13, 4), "origin": (1, 11)}


def records(spark, d):
    m = F.col("material_id")
    pick = lambda n: F.get(F.array(*map(F.lit, POOLS[n])), ((m * STEPS[n][0] + F.floor(m / STEPS[n][1])) % len(POOLS[n])).cast("int"))
    return domain.materials(spark, d).select("material_id", *[pick(n).alias(n) for n in POOLS])


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


RECORDS = "SELECT material_id, " + ", ".join(f"nullif({_list(p)}[(material_id * {STEPS[n][0]} + material_id // {STEPS[n][1]}) % {len(p)} + 1], '') AS {n}" for n, p in POOLS.items()) + " FROM materials"


def _words(text: str, words: dict, exact: bool = True) -> str:
    whole = " ".join(f"WHEN {text} = '{k}' THEN '{v}'" for k, v in words.items()) if exact else ""
    return f"CASE {whole} " + " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in words.items()) + " END"


def _match(text: str, rules: dict) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{k}') THEN '{v}'" for k, v in rules.items()) + " END"


def _x(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _decimal(n: str) -> str:
    short = f"regexp_replace(regexp_replace({n}, '0+$', ''), '\\.$', '')"
    return f"coalesce(CASE {short} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in s.FRACTIONS.items())} END, replace({short}, '.', ''))"


NOTED = "SELECT *, CASE WHEN json_valid(notes) THEN notes END AS j, upper(coalesce(code, '')) AS c, upper(coalesce(category, '')) AS kind FROM records"
N = lambda *names: "coalesce(" + ", ".join(f"nullif(json_extract_string(j, '$.{n}'), '')" for n in names) + ")"
HX = {k: v for k, v in s.CODE_WORDS.items() if v in ("HX", "ST")}
REST = {k: v for k, v in s.CODE_WORDS.items() if k != "NUT"}
FIELDS = f"""SELECT *, coalesce(material_type, {N('material_family', 'material_type')}) AS r_material, coalesce(spec_standard, {N('standard', 'spec_standard')}) AS r_std, coalesce(grade, {N('form', 'finish', 'surface', 'grade')}, origin) AS r_grade,
  coalesce(size, {N('nps_inch')} || '"' || coalesce(' SCH' || {N('schedule')}, ''), {N('load_bar_width_mm')} || 'x' || {N('load_bar_thickness_mm')}, {N('size', 'size_description')}) AS r_size,
  coalesce({_match('c', HX)}, CASE WHEN contains(c, 'NUT') AND NOT contains(c, 'ANCHOR') THEN 'NT' END, {_match('c', REST)}, 'S' || {_x('c', s.SERIES)} || CASE WHEN regexp_matches(c, '-S-|SERR') THEN '_SERR' ELSE '_SMOOTH' END,
    {", ".join(_match(f"upper({N(f)})", rules) for f, rules in s.NOTE_WORDS.items())}) AS r_sub,
  {_x("upper(concat_ws(' ', coalesce(code, ''), coalesce(size, '')))", s.SCHEDULE)} AS schedule, coalesce({_x('c', f'-({s.RATINGS})-')}, {_x('c', f'^({s.RATINGS})-')}, {_x('c', rf'\b({s.RATINGS})\b')}, 'PN' || {_x('c', 'PN([0-9]+)')}) AS rating,
  nullif(concat_ws('_', {_match('c', s.SURFACES)}, {_match("upper(concat_ws(' ', coalesce(code, ''), coalesce(notes, '')))", s.COATINGS)}), '') AS face,
  CASE WHEN contains(kind, 'FAST') THEN 1 WHEN contains(kind, 'FLNG') THEN 2 WHEN contains(kind, 'FITG') THEN 3 WHEN contains(kind, 'PIPE') THEN 4 WHEN contains(kind, 'GRAT') THEN 5 END AS branch FROM noted"""
FIN = lambda t: "CASE " + " ".join(f"WHEN regexp_matches(upper({t}), '{p}') THEN '{k}'" for k, p in FINISHES.items()) + " END"
RULED = f"""SELECT *, lower(trim(std)) AS ls, trim(r_size) AS z, upper(trim(sub)) AS us FROM (SELECT *,
  coalesce(CASE WHEN branch = 1 THEN {_x('c', FASTENER_GRADES)} WHEN branch = 2 THEN coalesce(r_std, 'UNK') || 'R' || rating WHEN branch IN (3, 4) THEN coalesce(r_std, 'UNK') || 'S' || schedule END, r_std) AS std,
  coalesce(CASE WHEN branch = 1 AND code IS NOT NULL THEN coalesce({FIN('c')}, {FIN("coalesce(notes, '')")}) WHEN branch = 4 THEN {_match("upper(concat_ws(' ', coalesce(code, ''), coalesce(grade, '')))", s.PIPE_GRADES)} WHEN branch = 5 THEN face END, r_grade) AS variety,
  coalesce(r_sub || CASE WHEN branch = 3 THEN {_match('c', s.ANGLES)} END, r_sub) AS sub FROM fields)"""
WITH_DECIMAL = lambda t: f"CASE WHEN regexp_matches({t}, '[0-9]+\\.[0-9]') THEN regexp_extract({t}, '^(.*?)[0-9]+\\.[0-9]+', 1) || {_decimal(f"regexp_extract({t}, '([0-9]+\\.[0-9]+)', 1)")} || regexp_extract({t}, '^.*?[0-9]+\\.[0-9]+(.*)$', 1) END"
QUOTE, CLEAN = _x("z", '([0-9]+(?:\\.[0-9]+)?)\\s*"'), "regexp_replace(z, '[^A-Za-z0-9X._-]', '', 'g')"
PARTS = f"""SELECT material_id, branch, coalesce(CASE WHEN category IS NOT NULL THEN coalesce({_words('lower(trim(category))', CATEGORIES)}, rpad(upper(category)[1:4], 4, 'X')) END, 'UNK') AS category,
  coalesce({_words('lower(trim(r_material))', MATERIALS)}, CASE WHEN regexp_matches(lower(coalesce(category, '')), 'frp|grating') THEN CASE WHEN contains(lower(r_material), 'pultruded') THEN 'FRPP' WHEN contains(lower(r_material), 'molded') THEN 'FRPM' WHEN contains(lower(notes), 'pultruded') THEN 'FRPP' WHEN contains(lower(notes), 'molded') THEN 'FRPM' END END, 'UNK') AS material,
  coalesce(CASE WHEN regexp_matches(kind, 'FAST') THEN {_match('us', s.KIND_WORDS['FAST'])} END, CASE WHEN regexp_matches(kind, 'FITG|FITTING') THEN {_match('us', s.KIND_WORDS['FITG|FITTING'])} END, CASE WHEN regexp_matches(kind, 'FLNG|FLANGE') THEN {_match('us', s.KIND_WORDS['FLNG|FLANGE'])} END,
    CASE WHEN contains(kind, 'GRAT') THEN CASE WHEN regexp_matches(us, '^S[0-9]+[_-](SERR|SMOOTH)$') THEN replace(us, '-', '_') ELSE 'S' || {_x('us', 'S([0-9]+)')} || CASE WHEN regexp_matches(us, 'SERR|S-') THEN '_SERR' ELSE '_SMOOTH' END END END,
    CASE WHEN contains(kind, 'PIPE') THEN {_match('us', s.KIND_WORDS['PIPE'])} END, CASE WHEN length(us) <= 10 AND regexp_matches(us, '^[A-Z0-9-]+$') THEN us END, 'NCN') AS subcategory,
  CASE WHEN std IS NULL THEN 'UNK' ELSE coalesce({_words('ls', s.STANDARDS)}, upper({_x('ls', r'astm\s*([a-z0-9]+)')}), 'API' || upper({_x('ls', r'api\s*([a-z0-9]+)')}), upper(replace({_x('ls', r'asme\s*([a-z0-9.]+)')}, '.', '')), (CASE WHEN length(regexp_replace(upper(ls[1:6]), '[^A-Z0-9]', '', 'g')) < 4 THEN rpad(regexp_replace(upper(ls[1:6]), '[^A-Z0-9]', '', 'g'), 4, 'X') ELSE regexp_replace(upper(ls[1:6]), '[^A-Z0-9]', '', 'g') END)) END AS std,
  CASE WHEN r_size IS NULL THEN 'UNK' ELSE coalesce({_decimal(_x('z', r'(?i)([0-9]+\.[0-9]+)\s*IN'))} || 'IN', {_decimal(_x('z', r'^([0-9]+\.[0-9]+)$'))}, coalesce({WITH_DECIMAL(QUOTE)}, {QUOTE}) || 'IN', 'DN' || {_x('z', r'(?i)dn\s*([0-9]+)')}, 'SCH' || upper({_x('z', r'(?i)sch\s*([0-9]+|[a-z]+)')}),
    {_x('z', r'(?i)([0-9]+)\s*x\s*[0-9]+')} || 'X' || {_x('z', r'(?i)[0-9]+\s*x\s*([0-9]+)')}, {_x('z', '^([0-9]+)$')}, upper(nullif(replace(coalesce({WITH_DECIMAL(CLEAN)}, replace({CLEAN}, '.', '')), '-', '')[1:10], '')), 'UNK') END AS size,
  coalesce({_words('lower(trim(variety))', s.VARIANTS)}, {_words('lower(notes)', s.VARIANTS, False)}, CASE WHEN origin = 'china' THEN 'CN' WHEN origin = 'non_china' THEN 'NCN' END, 'UNK') AS variant FROM ruled"""
ALL = {"records": RECORDS, "noted": NOTED, "fields": FIELDS, "ruled": RULED, "parts": PARTS}
BAD = ", ".join(f"CASE WHEN length({k}) = 0 OR length({k}) > {n} OR {f"NOT regexp_matches({k}, '^[{s.ALLOWED[k]}]+$')" if k in s.ALLOWED else f"contains({k}, '-')"} THEN '{k}' END" for k, n in s.LIMITS.items())
BRANCHES = {"fastener": 1, "flange": 2, "fitting": 3, "pipe": 4, "grating": 5, "other": None}


def skus(spark, d):
    """material_id, the six parts, sku, problems, category_text."""
    r = records(spark, d)
    said = r.select("material_id", F.col("category").alias("_text"), F.explode(F.array(F.struct(*[c.alias(k) for k, c in s.raw({n: F.col(n) for n in POOLS}).items()]))).alias("said"))
    parts = s.parts({k: F.col(f"said.{k}") for k in said.schema["said"].dataType.fieldNames()})
    out = said.select("material_id", F.upper(F.coalesce("_text", F.lit(""))).alias("_text"), F.explode(F.array(F.struct(*[c.alias(k) for k, c in parts.items()]))).alias("p"))
    own = {k: F.col(f"p.{k}") for k in s.LIMITS}
    return out.select("material_id", "_text", "p.*", s.sku(own).alias("sku"), F.array_join(s.problems(own), ",").alias("problems"))


def _register(name: str, branch: int | None) -> None:
    kinds = [k for k, b in (("FAST", 1), ("FLNG", 2), ("FITG", 3), ("PIPE", 4), ("GRAT", 5))]
    where = f"branch = {branch}" if branch else "branch IS NULL"

    @register(f"m24_{name}_skus", sql(f"SELECT material_id, category, material, subcategory, std, size, variant, concat_ws('-', category, material, subcategory, std, size, variant) AS sku, concat_ws(',', {BAD}) AS problems FROM parts WHERE {where}", **ALL))
    def query(spark, d):
        first = F.coalesce(*[F.when(F.contains("_text", F.lit(k)), i) for i, k in enumerate(kinds, 1)])
        return skus(spark, d).filter(first == branch if branch else first.isNull()).drop("_text")


for _name, _branch in BRANCHES.items():
    _register(_name, _branch)
