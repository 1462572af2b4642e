"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm._session import materialize, units, without

SEED = 20240
#: A table of sources up to this many rows is broadcast; a larger one is joined by source.
BROADCAST_SOURCES = 10_000
#: Stored bytes of an output partition.
PARTITION_BYTES = 64 << 20


def rates(docs: DataFrame, weights: dict[str, float] | DataFrame | None, source_col: str, size: str, epochs: float) -> DataFrame:
    """``(source, rate)``: how often a document of each source is to appear on average.

    rate = weight / sum of weights x epochs x size of all / size of the source.
    """
    own = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.expr(size).cast("double").alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        own = own.withColumn("weight", F.lit(1.0))
    else:
        if isinstance(weights, dict):
            weights = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w string, weight double")
        else:
            weights = weights.select(F.col("source").cast("string").alias("w"), F.col("weight").cast("double"))
        own = own.join(weights, F.col("source").eqNullSafe(F.col("w")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    own = materialize(own, "sources")
    whole = own.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not whole["size"] or not whole["weight"]:
        return own.select("source", F.lit(0.0).alias("rate"))
    return own.select("source", (F.col("weight") / F.lit(whole["weight"]) * F.lit(float(epochs)) * F.lit(whole["size"]) / F.col("size")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``(source, cdf)``: the distribution function at 0, 1, ... of each positive rate, as far as it can be told from 1."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    term = steps.withColumn("p", F.exp(-F.col("rate") + F.col("k") * F.log("rate") - F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto)))
    return term.withColumn("c", F.sum("p").over(upto)).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def uniform(*parts):
    """A number inside (0, 1) of 52 bits from the MD5 of the parts joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, epochs: float = 1.0, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id", size: str = "greatest(1, coalesce(octet_length(text), 0))") -> DataFrame:
    """Each document as often as its id's hash makes of a Poisson distribution with its source's rate, in a global shuffled order.

    ``weights`` (default: equal) are the sources' target shares of ``size``, a SQL expression, and ``epochs`` the size of the
    result over the input's.  A count is the least k whose distribution function exceeds a uniform number hashed from id
    and seed.  Returns the columns of ``docs`` with ``replica`` (from 1) and ``shuffle_key``, partitioned by ranges of the key
    and sorted by it; the key is a hash of id, replica and seed, so its ranges are known without a sample.  Rows of one id
    share their keys; among these ties rows stand in no set order.  Long texts move as they are.

    A null source is a source of its own (with ``weights``: of weight 0 unless they name it).  Sources without a weight
    and weights of 0 give no rows.  Null ids hash as "null"; rows with one id share their count and their keys.  Null texts
    count as size 1.  Empty input: no rows.  Columns of ``docs`` with an output's name give way to it.
    """
    docs = without(docs, "replica", "shuffle_key", "__source", "__cdf")
    table = materialize(poisson_tables(rates(docs, weights, source_col, size, epochs)).select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf")), "poisson")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    u = uniform(F.col(f"`{id_col}`"), F.lit(seed))
    counted = docs.join(table, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__source"))).withColumn("__n", F.size(F.filter("__cdf", lambda c: c <= u))).where("__n > 0")
    copies = counted.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.col("replica").cast("string"), F.lit(str(seed + 1)))), 1, 16)
    out = copies.withColumn("shuffle_key", key).select(*docs.columns, "replica", "shuffle_key")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), units(docs, int(PARTITION_BYTES / max(1e-3, epochs))))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 32)).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs)


ORACLE = f"""
WITH own AS (
  SELECT source, CAST(sum(greatest(1, coalesce(strlen(text), 0))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM own) * (SELECT sum(size) FROM own) / size AS rate FROM own),
steps AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS k FROM rates),
facts AS (SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k) AS lf FROM steps),
cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lf)) OVER (PARTITION BY source ORDER BY k) AS c FROM facts),
u AS (SELECT *, (CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':{SEED}')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT doc_id, u.source, text, count(*) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND c <= u.u GROUP BY ALL)
SELECT doc_id, source, text, CAST(replica AS INTEGER) AS replica, substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', replica, ':{SEED + 1}')), 1, 16) AS shuffle_key
FROM (SELECT doc_id, source, text, unnest(generate_series(1, n)) AS replica FROM n)
"""
