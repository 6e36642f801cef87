"""Set-based pricing: agreement conditions, rules, unit prices, logistics, tax, duty, risk."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions.money import nearest, safe_div, sum_if


def evaluate(conditions: DataFrame, key: list[str], kind: str = "condition_type", rate_type: str = "rate_type", rate: str = "rate") -> DataFrame:
    """One row for each key: base, discount, surcharge, freight, tax, lme and net, to four places.

    All base prices are summed before any percentage is taken; tax is on base - discount + surcharge + freight;
    lme comes after tax.
    """
    k, r, pct = F.col(kind), F.col(rate).cast("double"), F.col(rate_type) == "PERCENT"
    sums = [sum_if(k == "BASE_PRICE", r).alias("base")]
    for name in ("DISCOUNT", "SURCHARGE", "FREIGHT", "TAX", "LME"):
        sums += [sum_if((k == name) & ~pct, r).alias(f"_{name}_amount"), sum_if((k == name) & pct, r).alias(f"_{name}_pct")]
    s = conditions.groupBy(*key).agg(*sums)
    part = lambda name, of: F.col(f"_{name}_amount") + of * F.col(f"_{name}_pct") / 100
    base = F.col("base")
    s = s.select(*key, "base", part("DISCOUNT", base).alias("discount"), part("SURCHARGE", base).alias("surcharge"), part("FREIGHT", base).alias("freight"), part("LME", base).alias("lme"), "_TAX_amount", "_TAX_pct")
    taxed = F.col("base") - F.col("discount") + F.col("surcharge") + F.col("freight")
    s = s.withColumn("tax", part("TAX", taxed)).withColumn("net", taxed + F.col("tax") + F.col("lme"))
    return s.select(*key, *[F.round(c, 4).alias(c) for c in ("base", "discount", "surcharge", "freight", "tax", "lme", "net")])


def most_specific(items: DataFrame, rules: DataFrame, dims: list[str], tie: list[Column]) -> DataFrame:
    """Each item with the rule that fits it on most dimensions, the first of `dims` counting most. A rule's null dimension fits all.

    One equality join for each pattern of given dimensions, with one rule for each key: items are never multiplied or
    ranked, and not shuffled where the rules are small. Items without a rule stay.
    """
    values = [c for c in rules.columns if c not in dims]
    out, best = items, []
    for n, given in enumerate(sorted(product((True, False), repeat=len(dims)), reverse=True)):
        on = [c for c, g in zip(dims, given) if g]
        fits = reduce(and_, [F.col(c).isNotNull() if g else F.col(c).isNull() for c, g in zip(dims, given)])
        w = Window.partitionBy(*(on or [F.lit(1)])).orderBy(*tie)
        own = rules.filter(fits).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*on, F.struct(*values).alias(f"_rule{n}"))
        out = out.join(own, on if on else F.lit(True), "left")
        best.append(f"_rule{n}")
    rule = F.coalesce(*best)
    return out.select(*items.columns, *[rule[v].alias(v) for v in values])


def unit_price(cost: Column, break_pct: Column, markup: Column, logistics: Column, risk: Column, floor: Column, region: Column, industry: Column) -> Column:
    """cost with its quantity break, times 1 + markup (at least the floor) + logistics + risk, adjusted by region and industry, to the nearest 10."""
    own = cost * (1 + break_pct / 100)
    return nearest(own * (1 + F.greatest(markup, floor) + logistics + risk) * (1 + region) * (1 + industry), 10.0)


def freight(weight: Column, value: Column, volume: Column, method: Column, rate: Column, least: Column) -> Column:
    amount = F.when(method == "weight", weight * rate).when(method == "value", value * rate).when(method == "volume", volume * rate).otherwise(rate)
    return F.greatest(amount, least)


def insurance(value: Column, freight_cost: Column, rate: Column, origin_factor: Column, category_factor: Column, least: Column) -> Column:
    return F.greatest((value + freight_cost) * rate * origin_factor * category_factor, least)


def shared_cost(per_item: Column, fixed: Column, run: str) -> Column:
    """A cost of the item and its share of what the run pays once."""
    return per_item + fixed / F.count(F.lit(1)).over(Window.partitionBy(run))


def duty(final_amount: Column, final_rate: Column, base_rate: Column, value: Column) -> Column:
    """A final amount, else a final rate, else the base rate (both in per cent); else none."""
    return F.coalesce(final_amount, value * final_rate / 100, value * base_rate / 100, F.lit(0.0))


def tax(subtotal: Column, rate: Column) -> Column:
    """To cents, halves up; no rule: none."""
    return F.floor(subtotal * F.coalesce(rate, F.lit(0.0)) * 100 + 0.5) / 100


def item_margin_pct(price: Column, cost: Column) -> Column:
    """In per cent of cost; 0 without a cost."""
    return F.coalesce(100 * safe_div(price - cost, cost), F.lit(0.0))


def deviation_score(margin: Column, usual: Column, quotes: Column) -> Column:
    return F.when(F.coalesce(quotes, F.lit(0)) < 3, 40.0).otherwise(F.least(F.abs(margin - usual) * 10, F.lit(100.0)))


def credit_risk(months: Column, value: Column, quotes: Column, win_rate: Column, terms: Column) -> Column:
    """100 less a score of 70, moved by age, lifetime value, win rate and terms; 50 for an unknown client."""
    s = F.lit(70.0) + F.when(months > 12, 10).when(months < 3, -10).otherwise(0)
    s = s + F.when(value > 100_000, 15).when(value.isNull() | (value < 10_000), -10).otherwise(0)
    s = s + F.when((quotes >= 5) & (win_rate > 0.8), 10).when((quotes >= 5) & (win_rate < 0.5), -15).otherwise(0) + F.when(terms == "NET90", -5).otherwise(0)
    return F.when(months.isNull(), 50.0).otherwise(100 - F.greatest(F.lit(0.0), F.least(s, F.lit(100.0))))


def anomaly(items: DataFrame, run: str, price: str, cost: str, total: str) -> DataFrame:
    """run, anomaly: points of items and of the run, 100 at most. A missing cost counts as such and as a margin of 0."""
    m = item_margin_pct(F.col(price), F.col(cost))
    missing = F.coalesce(F.col(cost), F.lit(0.0)) == 0
    points = F.when(m < 0, 30).when(m < 5, 15).when(m > 50, 20).otherwise(0) + F.when(F.col(price) > 50_000, 10).otherwise(0) + F.when(missing, 25).otherwise(0)
    each = items.groupBy(run).agg(F.sum(points).alias("_p"), F.stddev_pop(m).alias("_sd"), F.sum(total).alias("_t"))
    whole = F.when(F.col("_t") > 500_000, 15).when(F.col("_t") < 1_000, 10).otherwise(0) + F.when(F.col("_sd") > 15, 10).otherwise(0)
    return each.select(run, F.least(F.col("_p") + whole, F.lit(100)).cast("double").alias("anomaly"))


def overall_risk(margin: Column, credit: Column, anomalies: Column, availability: Column) -> Column:
    return 0.30 * margin + 0.25 * credit + 0.35 * anomalies + 0.10 * availability


def risk_level(score: Column) -> Column:
    return F.when(score < 30, "LOW").when(score < 60, "MEDIUM").otherwise("HIGH")


def local_charges(value: Column, run: str, flat: float, value_pct: float | None, documents: float, bank: float, misc_pct: float) -> Column:
    """A flat rate (or a share of the value), the item's part of what the run pays for documents and to the bank, and miscellaneous charges by value; to cents."""
    n = F.count(F.lit(1)).over(Window.partitionBy(run))
    own = F.lit(flat) if value_pct is None else value * value_pct
    return F.floor((own + (documents + bank) / n + value * misc_pct) * 100 + 0.5) / 100


def tax_breakdown(subtotal: Column, amount: Column, rate: Column, name: Column) -> Column:
    """array<struct<label, formatted>> of subtotal, tax and total, in dollars."""
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 2))
    part = lambda label, x: F.struct(label.alias("label"), money(x).alias("formatted"))
    tax_label = F.concat(name, F.lit(" ("), F.format_number(F.coalesce(rate, F.lit(0.0)) * 100, 2), F.lit("%)"))
    return F.array(part(F.lit("Subtotal"), subtotal), part(tax_label, amount), part(F.lit("Total (incl. tax)"), subtotal + amount))


def availability(items: DataFrame, run: str, code: str) -> DataFrame:
    """run, availability (15 points for each item without a code, 100 at most), n_issues."""
    missing = F.count(F.when(F.coalesce(F.trim(F.col(code)), F.lit("")) == "", 1))
    return items.groupBy(run).agg(F.least(missing * 15, F.lit(100)).cast("double").alias("availability"), missing.alias("n_issues"))


def failed_checks(checks: dict[str, tuple[DataFrame, Column, str]]) -> DataFrame:
    """check, result (pass, or what a failure means), n: for each check its rows, the condition of a bad one, and fail or warn."""
    out = [rows.agg(F.count(F.when(bad, 1)).alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "pass").otherwise(verdict).alias("result"), "n") for name, (rows, bad, verdict) in checks.items()]
    return reduce(DataFrame.unionByName, out)
