"""Line items against a catalogue: what a description says, the points of agreement, the best few entries of each line.

Points depend on the parsed attributes only, so lines and entries are reduced to distinct attributes first, and entries
with equal attributes to the first k. Pairs come from equality joins on keys that every pair of the least score shares.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions import parse
from quotelake.functions.parse import equal_points, first_points, text_points
from quotelake.operators.joins import latest

PARTS = ["kind", "beam", "tubular", "plate", "pipe", "en", "generic"]
LEAST, AUTO = 40, 90


def attributes(df: DataFrame, text: str) -> DataFrame:
    """`df` with kind and the parsed structs beam, tubular, plate, pipe, en, generic.

    They come out of a generator of just one row, so that the optimiser can't repeat these long expressions wherever a field is used.
    """
    t = F.col(text)
    parsed = {"kind": parse.kind(t), "beam": parse.beam(t), "tubular": parse.tubular(t), "plate": parse.plate(t), "pipe": parse.pipe(t), "en": parse.european(t), "generic": parse.generic(t)}
    one = F.struct(*[c.alias(n) for n, c in parsed.items()])
    return df.select("*", F.explode_outer(F.array(one)).alias("_parsed")).select(*[f"`{c}`" for c in df.columns], "_parsed.*")


def step(x: Column, share: float) -> Column:
    """The number of the range that x stands in; what is within `share` of x stands in it or next to it."""
    return F.floor(F.log(F.nullif(F.greatest(x, F.lit(0.0)), F.lit(0.0))) / F.lit(ratio(share)).cast("double")).cast("long")


def near(number: Column, reach: int) -> Column:
    return F.sequence(number - reach, number + reach)


def keys(prefix: str, *parts: Column) -> Column:
    """array<string> of one key; none where a part is missing."""
    return F.array_compact(F.array(reduce(lambda a, b: F.concat(a, F.lit(":"), b.cast("string")), parts, F.lit(prefix))))


def each(prefix: str, values: Column, *parts: Column) -> Column:
    """A key for each of an array's values; none where something is missing."""
    return F.coalesce(F.transform(values, lambda i: reduce(lambda a, b: F.concat(a, F.lit(":"), b.cast("string")), [*parts, i], F.lit(prefix))), F.array().cast("array<string>"))


def both(prefix: str, first: Column, second: Column) -> Column:
    """A key for each pair of two arrays' values; none where something is missing."""
    return F.coalesce(F.flatten(F.transform(first, lambda i: each(prefix, second, i))), F.array().cast("array<string>"))


def characters(x: Column) -> Column:
    """Of two texts, one of which contains the other, some character is in both."""
    return F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))


def ratio(share: float) -> float:
    """The length on a scale of logarithms of what lies within a share of a value: so long that values within it stand in ranges next to each other."""
    return -log(1 - share) * (1 + 1e-9)


def all_keys(reach: int) -> dict[str, dict[str, Column]]:
    """kind -> name -> keys. What reaches LEAST agrees in one of them, if lines look in ranges around their values (reach 1) and entries stand in one (reach 0).

    Beams: depth, weight, or the family (alone, or with the standard). Tubulars: diameter within 1 %, a wall within 0.5 mm or 5 %, or a diameter within 5 % with a wall
    within 2 mm or 10 %. Plates: thickness within
    2 mm, or standard and grade. Pipes: size, schedule, or family and standard. Others: standard, grade, or size and schedule. FP and FF are where
    pipes, and flanges and gaskets, fall back to.
    """
    c = F.col
    whole = lambda x, r: near(F.floor(x).cast("long"), r * reach)
    within = lambda x, share=0.05: near(step(x, share), reach)
    wide = within(c("tubular.od_mm"))
    thirds = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substr(x, i, F.lit(3)))
    return {
        "BEAM": {"B": each("B", whole(c("beam.depth_mm"), 1)), "BW": each("BW", within(c("beam.weight_kg_m"))), "BF": keys("BF", c("beam.family")), "BE": keys("BE", c("beam.family"), c("en.standard"))},
        "TUBULAR": {"T": each("T", within(c("tubular.od_mm"), 0.01)), "TB": both("TB", wide, whole(c("tubular.wall_mm") / 2, 1)), "TC": both("TC", wide, within(c("tubular.wall_mm"), 0.1)), "TW": each("TW", whole(c("tubular.wall_mm"), 1)), "TR": each("TR", within(c("tubular.wall_mm")))},
        "PLATE": {"P": each("P", whole(c("plate.thickness_mm"), 2)), "PE": keys("PE", c("en.standard"), c("en.grade"))},
        "PIPE": {"N": each("N", whole(c("pipe.nps") * 2, 1)), "NS": each("NS", characters(c("pipe.schedule"))), "NF": each("NF", thirds(c("pipe.standard")), c("pipe.family")), "FP": keys("FP", c("pipe.nps"))},
        "OTHER": {"GS": each("GS", thirds(c("generic.standard"))), "GG": each("GG", characters(c("generic.grade"))), "GZ": each("GZ", characters(c("generic.schedule")), c("generic.size")),
            "FF": keys("FF", F.when(c("generic.product").isin("FLANGE", "GASKET"), c("generic.product")))},
    }


def line_keys() -> Column:
    return F.array_distinct(reduce(lambda w, x: w.when(F.col("kind") == x[0], F.concat(*x[1].values())), all_keys(1).items(), F))


def entry_keys() -> Column:
    """array<struct<key, alike>>: of entries with one key and alike only the first k are needed, as those behind them differ in nothing else
    that gives points there, or stand under another key too (null: all are needed)."""
    wall = F.concat_ws("/", F.col("tubular.wall_mm").cast("string"), "en.standard")
    size = F.concat_ws("/", F.col("generic.size").cast("string"), F.col("generic.marks").cast("string"))
    across = F.concat_ws("/", F.col("tubular.od_mm").cast("string"), "en.standard")  # walls that give points meet under TB or TC
    alike = {"BF": F.lit(""), "BE": F.lit(""), "PE": F.lit(""), "T": across, "TW": wall, "TR": wall, "FF": size}
    mark = lambda name, values: F.transform(values, lambda k: F.struct(k.alias("key"), alike.get(name, F.lit(None).cast("string")).alias("alike")))
    return reduce(lambda w, x: w.when(F.col("kind") == x[0], F.concat(*[mark(n, v) for n, v in x[1].items()])), all_keys(0).items(), F)


def score(line: str = "l", cat: str = "c") -> Column:
    """Points out of 100 for attributes that agree, by the line's kind; line and catalogue are aliased frames with attributes."""
    a = lambda p: F.col(f"{line}.{p}")
    b = lambda p: F.col(f"{cat}.{p}")
    off = lambda p: F.abs(a(p) - b(p))
    share = lambda p: F.abs(a(p) - b(p)) / F.nullif(b(p), F.lit(0.0))
    standard = equal_points(a("en.standard"), b("en.standard"), 10)
    d, w, od, wall, t, nps = "beam.depth_mm", "beam.weight_kg_m", "tubular.od_mm", "tubular.wall_mm", "plate.thickness_mm", "pipe.nps"
    beam = equal_points(a("beam.family"), b("beam.family"), 40) + first_points((off(d) == 0, 30), (off(d) <= 1, 20)) + first_points((share(w) == 0, 30), (share(w) <= 0.05, 20)) + standard
    tubular = first_points((share(od) == 0, 50), (share(od) <= 0.01, 40), (share(od) <= 0.05, 25)) + standard
    tubular = tubular + first_points((off(wall) == 0, 50), ((off(wall) <= 0.5) | (share(wall) <= 0.05), 40), ((off(wall) <= 2) | (share(wall) <= 0.1), 25))
    plate = first_points((off(t) == 0, 60), (off(t) <= 0.5, 50), (off(t) <= 2, 35)) + 2 * standard + equal_points(a("en.grade"), b("en.grade"), 20)
    pipe = first_points((off(nps) == 0, 30), (off(nps) <= 0.5, 20)) + text_points(a("pipe.schedule"), b("pipe.schedule"), 25, 15) + equal_points(a("pipe.family"), b("pipe.family"), 15)
    pipe = pipe + text_points(a("pipe.standard"), b("pipe.standard"), 15, 10) + text_points(a("pipe.grade"), b("pipe.grade"), 10, 5) + equal_points(a("pipe.form"), b("pipe.form"), 5)
    pipe = pipe + 2 * F.bit_count(a("pipe.words").bitwiseAND(b("pipe.words")))
    g = "generic"
    other = text_points(a(f"{g}.standard"), b(f"{g}.standard"), 30, 20) + text_points(a(f"{g}.grade"), b(f"{g}.grade"), 25, 15) + equal_points(a(f"{g}.size"), b(f"{g}.size"), 25)
    other = other + text_points(a(f"{g}.schedule"), b(f"{g}.schedule"), 20, 10) + equal_points(a(f"{g}.product"), b(f"{g}.product"), 10)
    k = a("kind")
    return F.least(F.when(k == "BEAM", beam).when(k == "TUBULAR", tubular).when(k == "PLATE", plate).when(k == "PIPE", pipe).otherwise(other), F.lit(100)).cast("long")


def fallback_score(line: str = "l", cat: str = "c") -> Column:
    """Points out of 40 for an entry of a line's product: its size and the words that both use."""
    a = lambda p: F.col(f"{line}.generic.{p}")
    b = lambda p: F.col(f"{cat}.generic.{p}")
    return F.least(20 + equal_points(a("size"), b("size"), 10) + 5 * F.bit_count(a("marks").bitwiseAND(b("marks"))), F.lit(40)).cast("long")


def best_matches(lines: DataFrame, catalogue: DataFrame, text: str, line_id: str, cat_id: str, k: int = 3, least: int = LEAST) -> DataFrame:
    """line_id, cat_id, score, rank, strategy, auto: up to k entries of each line; 90 points or more on rank 1 are taken without review.

    Where none has `least` points (40 or more), a pipe falls back to the first pipe of its size (55 points), and a flange or gasket to entries of its product
    (25 points or more). A line without any keeps one row without an entry, for review.
    """
    if least < LEAST:
        raise ValueError(f"least is {LEAST} at least: keys are made for it")
    tuples = lambda df, text: attributes(df, text).withColumn("same", F.to_json(F.struct(*PARTS)))
    # lines by their distinct attributes
    # few bytes, but long expressions on each: a stated number of partitions isn't merged for their size
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = tuples(lines.select(F.col(text)).distinct().repartition(parts, text), text)
    # outer generators and points under an aggregate keep the optimiser from repeating these long expressions in filters
    own = texts.groupBy("same").agg(*[F.first(p).alias(p) for p in PARTS]).repartition(parts, "same").withColumn("key", F.explode_outer(line_keys()))
    entries = latest(tuples(catalogue.select(cat_id, F.col(text).alias("_text")).repartition(parts, cat_id), "_text"), ["same"], [F.asc(cat_id)], k).select(cat_id, *PARTS, F.inline_outer(entry_keys()).alias("key", "alike"))
    alone = F.coalesce("alike", F.concat(F.lit("="), F.col(cat_id).cast("string")))
    some = latest(entries.withColumn("_alike", alone), ["key", "_alike"], [F.asc(cat_id)], k).drop("_alike")
    pairs = own.alias("l").join(some.alias("c"), "key").filter("l.kind = c.kind")
    falls = F.startswith("key", F.lit("F"))
    points = F.when(F.startswith("key", F.lit("FP")), 55).when(falls, fallback_score()).otherwise(score()).cast("long")
    later = F.when(F.startswith("key", F.lit("FP")), F.coalesce(F.col("c.pipe.schedule").try_cast("int"), F.lit(999))).otherwise(0)
    scored = pairs.select("l.same", F.col(f"c.{cat_id}"), falls.cast("int").alias("falls"), points.alias("score"), later.alias("later"), F.when(F.startswith("key", F.lit("FP")), 1).otherwise(k).alias("most"))
    scored = scored.groupBy("same", cat_id, "falls", "later", "most").agg(F.max("score").alias("score"))  # a pair may share several keys
    scored = scored.filter(F.col("score") >= F.when(F.col("falls") == 1, max(least - 15, 20)).otherwise(least))
    by = Window.partitionBy("same")
    rank = F.row_number().over(by.orderBy("falls", F.desc("score"), "later", cat_id))
    found = scored.select("*", rank.alias("rank"), F.min("falls").over(by).alias("_falls")).filter((F.col("falls") == F.col("_falls")) & (F.col("rank") <= F.col("most")))
    strategy = F.when(F.col("falls") == 0, "match").when(F.col("most") == 1, "pipe fallback").otherwise("product fallback")
    found = found.select("same", cat_id, "score", "rank", strategy.alias("strategy"))
    by_text = texts.select(text, "same").join(found, "same", "left").drop("same")
    auto = F.coalesce((F.col("score") >= AUTO) & (F.col("rank") == 1), F.lit(False))
    return lines.select(line_id, text).join(by_text, text, "left").select(line_id, cat_id, "score", "rank", F.coalesce("strategy", F.lit("none")).alias("strategy"), auto.alias("auto"))
