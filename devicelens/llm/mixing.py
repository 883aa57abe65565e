"""Operator 8: mix sources to target weights by Poisson replication (DataFrame functions only).

A source's target repetition rate is its target share of the mixture's size over its own size.  A
document's number of copies inverts the Poisson distribution of that mean at a uniform number
hashed from its id; the copies are then dealt out and ordered by a hash, which shuffles globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.llm.common import cut

SEED = 17
#: Sources up to which their table (some 0.5 KB each) is broadcast; beyond, a shuffled join takes over.
MAX_BROADCAST_SOURCES = 10_000
SPREAD = 12  # standard deviations of the distribution that are tabulated


def hashed(salt: str, *parts: Column, digits: int = 13) -> Column:
    """A hash of the parts as a long of 4 * ``digits`` bits."""
    text = F.concat_ws(":", F.lit(salt), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, n_docs, size): characters and one end sign per document; null is a source of its own."""
    return docs.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_docs"),
        F.sum(F.coalesce(F.length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
    )


def source_rates(sizes: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, size, weight, rate): the mean number of copies of a source's documents.

    ``weights`` gives target shares (a source it leaves out gets 0); by default a share grows with the
    square root of the size.  The mixture is ``epochs`` times as large as all sources together.
    """
    if weights is None:
        share = F.sqrt(F.col("size").cast("double"))
    else:
        share = F.lit(0.0)
        for name, value in weights.items():
            if not value >= 0:
                raise ValueError(f"weight of {name} is negative or not a number")
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(share)
    shared = sizes.withColumn("share", share)
    shares, total = shared.agg(F.sum("share")).scalar(), shared.agg(F.sum("size")).scalar()
    return (
        shared.withColumn("weight", F.when(shares > 0, F.col("share") / shares).otherwise(0.0))
        .withColumn("rate", F.col("weight") * F.lit(float(epochs)) * total / F.col("size"))
        .select("source", "n_docs", "size", "weight", "rate")
    )


def poisson_table(rates: DataFrame) -> DataFrame:
    """``rates`` with ``least``, the smallest tabulated count, and ``cdf``, the chances of at most that, one more, ...

    Chances are computed in logarithms relative to the likeliest count, so no mean is too large.
    """
    reach = F.lit(SPREAD) * (F.sqrt("rate") + 1)
    spans = rates.withColumn(
        "least", F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("bigint")
    ).withColumn("most", F.ceil(F.col("rate") + reach).cast("bigint"))
    along = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    step = F.when(F.col("k") == F.col("least"), 0.0).otherwise(F.ln(F.col("rate") / F.col("k")))
    counts = (
        spans.where("rate > 0")
        .withColumn("k", F.explode(F.sequence("least", "most")))
        .withColumn("height", F.sum(step).over(along))
        .withColumn("mass", F.exp(F.col("height") - F.max("height").over(whole)))
        .withColumn("cdf", F.sum("mass").over(along) / F.sum("mass").over(whole))
        .groupBy(F.struct("source").alias("key"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda r: r["cdf"]).alias("cdf"))
    )
    return (
        spans.withColumn("key", F.struct("source"))
        .join(counts, "key", "left")
        .withColumn("cdf", F.coalesce("cdf", F.array(F.lit(1.0))))
        .drop("most")
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled; ``copy``, ``copies``, ``rate`` and
    ``shuffle_key`` come beside its columns and replace any of these names.

    A document may come 0 times; the rows of one doc_id (repeated rows, or rows without id) get
    the same number.  Null texts count as empty, a null source is a source.  Copies are dealt out by
    ``shuffle_key`` and lie in its order in every partition, whatever their source.  ``options`` are
    ``epochs``, ``seed`` and the column names ``source``, ``text`` and ``doc_id``.
    """
    added = ["copy", "copies", "rate", "shuffle_key"]
    return _replicated(docs.drop(*added), weights, **options).select("row.*", *added)


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """:func:`mix` with the columns of ``docs`` alone, as they came."""
    return _replicated(docs, weights, **options).select("row.*")


def _replicated(
    docs: DataFrame,
    weights: dict[str | None, float] | None,
    epochs: float = 1.0,
    seed: int = SEED,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(row, copy, copies, rate, shuffle_key): the rows travel as one struct, so no name can clash."""
    sizes = cut(source_sizes(docs, source, text))
    plan = cut(poisson_table(source_rates(sizes, weights, epochs)))
    plan = plan.select("key", "rate", "least", "cdf")
    if plan.count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    above = F.size(F.filter("cdf", lambda c: c <= F.col("uniform")))
    most = F.col("least") + F.size("cdf") - 1
    return (
        docs.select(
            F.struct(F.col(source).alias("source")).alias("key"),
            F.col(doc_id).alias("id"),
            (hashed(f"{seed}", F.col(doc_id)) / F.lit(float(1 << 52))).alias("uniform"),
            F.struct("*").alias("row"),
        )
        .join(plan, "key")
        .withColumn("copies", F.least(F.col("least") + above, most).cast("bigint"))
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .withColumn("shuffle_key", hashed(f"{seed}/order", F.col("id"), F.col("copy"), digits=15))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )
