"""Operator 9: exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its content says so, at sentence or line ends.  Every chunk gets a 64-bit hash,
and the equal-hash chunks are compared as text once: the table of distinct (hash, chunk) pairs is
built with partial aggregation, so a chunk's text moves at most once per task.  A hash that
stands for one text is its verified identifier; for any other the texts of that hash are numbered
and (hash, number) is the identifier.  Documents are then equal exactly when their ordered
identifier lists are, and only these short lists are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.llm.common import cut, keep_rows

LEAST, MOST = 400, 4000


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """At least ``least`` characters up to the next sentence or line end, else up to ``most``."""
    return rf"(?s).{{{least},{most}}}?(?<=[.!?]\s|\n)|.{{1,{most}}}"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; joined they are the text.  An empty text has none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks), one row per document.

    Null counts as the empty text; all empty texts are one group.  Of equal texts the largest
    doc_id stays.  A row that repeats a doc_id with the same text is the same document; a doc_id with
    two texts is two documents.  Rows without doc_id are one document per text, which
    stays only if no other row has the text.  Other columns are not read.
    """
    texts = _texts(docs, doc_id, text)
    hashed = texts.select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunks(F.col("text"), least, most), lambda c: chunk_hash(c)).alias("recipe"),
    )
    recipes = cut(hashed.dropDuplicates(["doc_id", "text_sha256", "recipe"]))

    distinct = (
        texts.select(F.explode(chunks(F.col("text"), least, most)).alias("chunk"))
        .select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
        .distinct()
    )
    ambiguous = cut(distinct.groupBy("h").count().where("count > 1").select("h"))
    if ambiguous.isEmpty():
        lists = recipes.withColumn("identifiers", F.col("recipe"))
    else:
        lists = _numbered(texts, recipes, distinct, ambiguous, chunk_hash, least, most)

    groups = lists.groupBy("identifiers").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    return lists.join(groups, "identifiers").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("bigint").alias("n_chunks"),
    )


def _numbered(texts, recipes, distinct, ambiguous, chunk_hash, least, most) -> DataFrame:
    """Recipes whose hashes that stand for several texts carry the text's number as well."""
    numbers = (
        distinct.join(ambiguous, "h", "left_semi")
        .withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    )
    places = (
        texts.select(
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.posexplode(chunks(F.col("text"), least, most)).alias("place", "chunk"),
        )
        .withColumn("h", chunk_hash(F.col("chunk")))
        .join(ambiguous, "h", "left_semi")
        .join(numbers, ["h", "chunk"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_set(F.struct("place", "number"))).alias("numbers"))
    )
    key = F.struct("doc_id", "text_sha256").alias("key")
    empty = F.array().cast("array<struct<place:int,number:int>>")
    return (
        recipes.withColumn("key", key)
        .join(places.select(key, "numbers"), "key", "left")
        .withColumn("identifiers", F.struct("recipe", F.coalesce("numbers", empty).alias("numbers")))
        .drop("key", "numbers")
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns as they came; repeated rows come once."""
    kept = (
        exact_groups(docs, doc_id, text)
        .where("kept")
        .select(F.struct("doc_id", "text_sha256").alias("key"))
    )
    key = F.struct(
        F.col(doc_id).alias("doc_id"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"),
    )
    return keep_rows(docs, kept, key, once=True)
