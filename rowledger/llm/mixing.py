"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters, times ``epochs``, over the share it has. Every
document draws how often it appears from a Poisson distribution with that mean, by inverting the distribution
at a number from 0 to 1 that is hashed from its id and the seed; it is exploded by the count, and all copies are
dealt out by a second hash and sorted by it in each partition, which shuffles them globally. The draw of a
document depends on nothing but its id, its source's rate and the seed, so lost tasks repeat it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import write_once

SEED = 17
EPOCHS = 1.0
# without given weights, a source's share is its characters to this power: large sources give way to small ones
TEMPER = 0.5
BITS = 52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 sum."""
    digits = F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << BITS))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """(source, rate): how often a document of the source appears on average.

    With ``weights``, sources that they don't name get rate 0. Sources without a character get rate 0.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(TEMPER)))
    else:
        pick = F.lit(0.0)
        for source, weight in weights.items():
            pick = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(pick)
        size = size.withColumn("weight", pick)
    # weights are rounded so that the order of summing doesn't matter; a row per source, written once
    size = write_once(size.withColumn("weight", F.col("weight").cast("decimal(30,6)")), "sources")
    chars, weight = (float(x or 0) for x in size.agg(F.sum("chars"), F.sum("weight")).first())
    share = F.col("weight").cast("double") / F.lit(weight or 1.0)
    rate = F.when(F.col("chars") > 0, F.lit(float(epochs)) * share * F.lit(chars) / F.col("chars").cast("double"))
    return size.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def distribution(rate: Column) -> Column:
    """Chances that a Poisson count is at most 0, 1, 2, ... with this mean, as far as 52 bits can tell."""
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(state["sums"], total).alias("sums"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["sums"])).otherwise(F.array(F.lit(1.0)))


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS, seed: int = SEED, most_sources: int = 10_000
) -> DataFrame:
    """All columns of ``docs``, with ``copy`` (from 1) and ``shuffle_key`` (hexadecimal); rows in random order.

    Each document appears as often as its draw says. Rows that share an id share the draw; a null id draws as
    an empty one. Null sources are one source. Null and empty texts count no characters but are drawn like others of
    their source. Input columns named copy or shuffle_key are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    names = docs.columns
    by_source = rates(docs, weights, epochs).select(F.col("source").alias("__source"), distribution(F.col("rate")).alias("__sums"))
    # a row per source: sent to all tasks if few, else joined by Spark's own choice
    if by_source.limit(most_sources + 1).count() <= most_sources:
        by_source = F.broadcast(by_source)
    drawn = docs.join(by_source, F.col("source").eqNullSafe(F.col("__source")))
    # the draw inverts the distribution: the number of its steps that lie at or below the hashed number
    at = uniform(F.col("doc_id"), F.lit(seed))
    drawn = drawn.withColumn("__at", at).withColumn("__count", F.size(F.filter("__sums", lambda s: s <= F.col("__at"))))
    copies = drawn.where("__count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"), F.lit(f"order {seed}")))
    return copies.select(*names, "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def oracle() -> str:
    """``mix_sources`` with its default parameters in DuckDB's SQL."""
    return f"""
with size as (select source, coalesce(sum(coalesce(length(text), 0)), 0)::bigint as chars from documents group by source),
weighed as (select source, chars, pow(chars::double, {TEMPER})::decimal(30,6) as weight from size),
total as (select sum(chars) as all_chars, sum(weight) as all_weights from weighed),
rated as (
  select source, case when chars > 0 then {EPOCHS!r}::double * (weight::double / all_weights::double) * all_chars::double / chars::double else 0.0 end as rate
  from weighed, total),
steps as (
  select source, rate, unnest(range(0, case when rate > 0 then ceil(rate + 12.0 * sqrt(rate) + 30.0)::bigint + 1 else 1 end)) as k from rated),
logs as (
  select source, rate, k, case when k = 0 or rate = 0 then -rate else -rate + k * ln(rate) - (sum(case when k > 0 then ln(k::double) else 0 end)
    over (partition by source order by k)) end as log_p from steps),
sums as (select source, k, sum(exp(log_p)) over (partition by source order by k) as at_most from logs),
drawn as (
  select doc_id, any_value(d.source) as source, d.ctid as ctid, count(*) filter (where s.at_most <=
    ('0x' || substr(md5(concat(coalesce(doc_id::varchar, ''), ':{SEED}')), 1, {BITS // 4}))::bigint::double / {float(1 << BITS)!r}) as n
  from (select doc_id, source, row_number() over () as ctid from documents) d join sums s on d.source is not distinct from s.source
  group by doc_id, d.ctid),
kept as (select row_number() over () as ctid, * from documents)
select k.doc_id, k.text, k.lang, k.source, k.n_chars, c.copy::int as copy,
  md5(concat(coalesce(k.doc_id::varchar, ''), ':', c.copy, ':order {SEED}')) as shuffle_key
from kept k join drawn using (ctid), unnest(range(1, n + 1)) as c(copy)
"""
