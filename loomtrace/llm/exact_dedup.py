"""Exact duplicates by content-defined chunk recipes, with DataFrame operations only.

A text is cut where its own content says so, each chunk gets a verified identifier, and two texts are
equal exactly when their ordered identifier lists are. Whole texts are never shuffled: the distinct
chunks move once, to verify identifiers, and after that only lists of integers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_of

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Cut after white space that follows two letters of fixed classes, at least `least` characters on.

    The cut depends on the content before it alone, so copies and shifted copies are cut alike. A stretch
    without such a place is cut after `most` characters. The chunks of a text, joined, are the text.
    """
    cut = rf"(?s).{{{least},{most}}}?(?<=[a-m][n-z]\s)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def clashing_chunks(texts: DataFrame) -> DataFrame:
    """Chunks (h, chunk, rank) whose 64-bit hash also belongs to another content; as a rule there are none.

    Every distinct chunk is compared by its content: it is a grouping key itself.
    """
    distinct = (
        texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
        .select(F.xxhash64("chunk").alias("h"), "chunk")
        .groupBy("h", "chunk")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    several = saved(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h"), "clash")
    if several.isEmpty():
        return several.select("h", F.lit("").alias("chunk"), F.lit(0).alias("rank")).limit(0)
    by_content = Window.partitionBy("h").orderBy("chunk")  # the few contents of one 64-bit hash
    return saved(distinct.join(several, "h", "left_semi").select("h", "chunk", F.row_number().over(by_content).alias("rank")), "clash-rank")


def recipes(texts: DataFrame) -> DataFrame:
    """Add `recipe`: the verified identifiers (hash, rank among the contents of that hash) of the chunks in order."""
    clash = clashing_chunks(texts)
    plain = F.transform(chunks_of(F.col("text")), lambda c: F.struct(F.xxhash64(c).alias("h"), F.lit(0).alias("rank")))
    made = texts.withColumn("recipe", plain)
    if clash.isEmpty():
        return made
    pieces = made.select("row", F.posexplode(chunks_of(F.col("text"))).alias("pos", "chunk")).withColumn("h", F.xxhash64("chunk"))
    ranked = pieces.join(clash, ["h", "chunk"], "left_outer").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("all"))
    exact = ranked.select("row", F.transform("all", lambda x: F.struct(x["h"].alias("h"), x["rank"].alias("rank"))).alias("exact"))
    return made.join(exact, "row", "left_outer").withColumn("recipe", F.coalesce("exact", "recipe")).drop("exact")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays. Repeated
    rows of one id form one group and are kept or dropped alike; a null id never displaces another, and a
    group of null ids keeps all its rows with a null keep_id. An empty table gives an empty result; other
    columns of docs are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    known = saved(recipes(texts).select("doc_id", "recipe", F.sha2("text", 256).alias("text_sha256")), "recipes")
    groups = saved(known.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return known.join(groups, "recipe", "left_outer").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
