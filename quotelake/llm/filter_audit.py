"""Operator 13: filter interaction audit by long-form window evaluation. DataFrame functions only.

Every document gets a mask, one bit for each filter whose failure condition holds. Documents are counted by part and mask
(mask cells, at most 2 ** filters for a part), so that only cells meet orders: each cell is unpivoted against the
steps of all orders. A running bit-or over the steps before names what a cell has failed already; conditional sums over cells give the
figures of a step, and a window over a part's steps of one filter its total over all orders.

Null texts count as empty, null languages as an empty string. Copies are judged table-wide by id: a row fails E if a smaller id has
its text; rows that repeat an id are no copies of each other, and a null id is neither smaller nor larger than any. A row of no label
has neither. Of several labels of one id any counts. Rows that repeat an id count each. An empty table gives no rows. Extra columns of
any name play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.llm.common import table
from quotelake.llm.words import once

LETTERS = "ABCDE"
#: Failure conditions: words, percentage of distinct words, percentage of capitals, characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
COPY = 1 << LETTERS.index("E")


def text_mask(text: Column, words: Column) -> Column:
    """Bits of A to D."""
    n = F.size(words)
    failed = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0))


def labelled(labels: DataFrame) -> DataFrame:
    """_l (an id, once), good, toxic."""
    any_of = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_l")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by mask, with the labelled ones among them.

    Rows are summed before each shuffle. The copies of a text are told from its first by sums alone: a text's rows come down to one for each part and
    label, with the smallest id and its rows, and the smallest of all ids then says how many rows are copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    split = read.select("_id", "part", "_t", once(F.array_remove(F.split("_t", BLANKS), "")).alias("_w"))
    rows = split.select("_id", "part", F.unhex(F.sha2("_t", 256)).alias("_text"), text_mask(F.col("_t"), F.col("_w")).alias("mask"))
    rows = rows.groupBy("_id", "part", "_text", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = rows.join(labelled(labels), F.col("_id") == F.col("_l"), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    kinds = known.select("_id", "part", "_text", "mask", "n", *flags).groupBy("_text", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))).alias("first"),
    )
    smallest = F.min("first._id").over(Window.partitionBy("_text"))
    kinds = kinds.withColumn("copies", F.col("n") - F.col("unnamed") - F.when(F.col("first._id") == smallest, F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), F.col("copies").alias("n")), F.struct("mask", (F.col("n") - F.col("copies")).alias("n")))
    cells = kinds.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def unpivoted(cells: DataFrame, orders: list[str]) -> DataFrame:
    """Each cell with filter_order, step and bit of all steps of all orders."""
    each = cells.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    bit = F.expr(f"shiftleft(1, locate(substr(filter_order, step, 1), '{LETTERS}') - 1)")
    return each.withColumn("step", F.explode(F.sequence(F.lit(1), F.length("filter_order")))).withColumn("bit", bit)


def audit(cells: DataFrame, orders: list[str] | None = None) -> DataFrame:
    """part, filter_order, step and the figures of each; `cells`: see mask_cells."""
    orders = orders or ["".join(p) for p in permutations(LETTERS)]
    long = unpivoted(cells.select("part", "mask", "n", "good", "toxic"), orders)
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumn("hit", hit).withColumn("gone", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    fails, there = F.col("hit") != 0, F.col("gone") == 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0))
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        total(there & ~fails).alias("kept"), total(there & fails).alias("removed"), total(~there & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(there & fails, "good").alias("good_lost"), total(there & fails, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
        len({_WORDS}) < {LEAST_WORDS},
        100 * len(list_distinct({_WORDS})) < {LEAST_DISTINCT} * len({_WORDS}),
        100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS} * length(t),
        regexp_matches(t, '{SYMBOLS}'),
        coalesce(d.doc_id > first_id, false)] AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT p, list_aggregate(list_transform(p, lambda i: '{LETTERS}'[i]), 'string_agg', '') AS filter_order, i AS step, p[i] AS f FROM o, x),
r AS (SELECT part, filter_order, step, f,
        sum(CASE WHEN NOT earlier AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT earlier AND failing THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN earlier AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failing AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT earlier AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT earlier AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM (SELECT c.*, s.filter_order, s.step, s.f, fails[s.f] AS failing, len(list_filter(fails, lambda v: v)) AS failures,
              len(list_filter(s.p[1:s.step - 1], lambda i: fails[i])) > 0 AS earlier FROM c, s)
      GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
