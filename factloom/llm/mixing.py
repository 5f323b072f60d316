"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, materialize, partitions
from factloom.llm.line_dedup import _free

#: Digits of a rate that count; it makes rates equal wherever the sums were added in another order.
DIGITS = 9
#: 13 hex digits of a hash make a fraction.
FRACTION = float(16**13)
#: Copies of the rates that a join of more than ``BROADCAST_ROWS`` sources is salted with.
SALT = 64


def poisson_table(rate: float) -> list[float]:
    """Distribution function of the Poisson distribution with this mean, up to where it rounds to one."""
    out, total, k = [], 0.0, 0
    while k <= rate or total < 1.0 - 1e-15:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1.0)) if rate > 0 else float(k == 0)
        out.append(total)
        k += 1
        if k > rate + 40 * math.sqrt(rate + 1) + 40:
            break
    return out


def hashed_fraction(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from an MD5 hash of the seed and the parts; nulls count as empty text."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(FRACTION)


def mixing_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """Mean repetition rate of each source: ``source, size, rate``.

    Sizes are code points of text.  A source's share of the output is its weight: the given one (sources
    without a weight get none), else its size to the power ``temperature``.  The output has ``epochs``
    times the input's size on average.  Null sources are a source of their own.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        table = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "name string, weight double")
        sizes = sizes.join(table, sizes["source"] == table["name"], "left").drop("name")
        weight = F.coalesce("weight", F.lit(0.0))
    sizes = materialize(sizes.withColumn("weight", weight), "sizes")
    total = sizes.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("weight")))).first()
    size, weight_sum = float(total[0] or 0), float(total[1] or 0)
    rate = F.when((F.col("size") > 0) & F.lit(weight_sum > 0), F.col("weight") / F.lit(weight_sum or 1.0) * F.lit(size * epochs) / F.col("size")).otherwise(0.0)
    return sizes.select("source", "size", F.round(rate, DIGITS).alias("rate"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rates = batch.column(batch.schema.get_field_index("rate")).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([poisson_table(r) for r in rates], pa.list_(pa.float64()))], ["source", "cdf"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """Each document as often as a Poisson variable with its source's rate says, in a global random order.

    The variable is the inverse of the distribution at a hash of the seed and the doc_id, so it does not
    depend on partitions or retries; rows of equal doc_id repeat equally often.  All columns are kept, then
    ``replica`` (0, 1, ..) and ``shuffle_key``, by whose order the result is partitioned and sorted; columns
    of these names are replaced.  Null and empty texts count as size 0: a source of them has rate 0 and
    vanishes, as one without weight does.  An empty table stays empty.

    A hot source is no hot task: rates of up to 1000 sources (counted) are broadcast, more are joined under
    a salt, and the shuffle is by hashed key.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("replica", "shuffle_key")])
    kinds = mixing_rates(docs, weights, temperature, epochs).mapInArrow(_tables, "source string, cdf array<double>")
    kinds = materialize(kinds, "rates")
    cdf, source, salt, at = (_free(n, docs.columns) for n in ("cdf", "name", "salt", "at"))
    kinds = kinds.select(F.col("source").alias(source), F.col("cdf").alias(cdf))
    same = F.col("source").cast("string").eqNullSafe(F.col(source))
    if kinds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(kinds), same)
    else:
        spread = kinds.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        number = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")
        joined = docs.withColumn(at, number).join(spread, same & (F.col(at) == F.col(salt))).drop(salt, at)
    u = hashed_fraction(seed, F.col("doc_id"))
    copies = F.size(F.filter(F.col(cdf), lambda p: p <= u))
    many = joined.withColumn(cdf, copies).filter(F.col(cdf) > 0)
    replicas = many.select(*docs.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col(cdf).cast("long") - 1)).alias("replica"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("replica").cast("string")))
    keyed = replicas.withColumn("shuffle_key", key)
    n = partitions(docs.sparkSession)
    # keys are uniform, so equal ranges of keys are equal partitions; no sampling pass is needed
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / F.lit(float(16**8)) * F.lit(n)).cast("int")
    return keyed.repartitionById(n, place).sortWithinPartitions("shuffle_key")
