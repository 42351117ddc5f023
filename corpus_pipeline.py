"""The corpus pipeline: five stages, each an operator of the llm subpackage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import common, decontamination, line_dedup, packing, similar, toxicity

#: SQL can't express the learned and iterative stages; the tests compare the stages and the whole pipeline with brute force.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of a hash of the text, null as empty: stages decide by text, so rows of one id with other texts stay apart."""
    key = common.fresh("text_key", docs)
    return docs.withColumn(key, F.xxhash64(common.text_of("text"))), key


def without(docs: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    """The rows of docs whose text is not among the keys (one column)."""
    rows, key = keyed(docs)
    gone = common.saved(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), tag)
    return rows.join(gone, key, "left_anti").select(*map(common.named, docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The model is fitted on the labelled rows of these documents that aren't held out.

    Equal texts have equal scores and go or stay together, whatever their ids, null ones too. Null texts count
    as empty and are scored like any other. An empty table stays empty; other columns, whatever their names, stay.
    """
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    rows, key = keyed(docs)
    return without(docs, toxicity.score(rows, model, id_col=key).where("predicted = 1").select("doc_id"), "toxic")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has go, and documents of which nothing else is left; n_chars follows the text.

    Rows of one id are one document; rows with a null id lose nothing; null, empty and blank texts stay. Of
    equal lines those of the smallest id stay. An empty table stays empty; other columns, whatever their names, stay.
    """
    lost = common.fresh("lines_lost", docs)
    out = line_dedup.line_dedup(docs, dropped_col=lost)
    out = out.where((F.col(lost) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    columns = [F.when(F.col(lost) > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else common.named(c) for c in docs.columns]
    return out.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that of the smallest id: texts link at a similarity of 0.8 or more of their runs of five words.

    SimHash fingerprints and Golay keys find the first candidates, as in op2, but each link is checked by that
    similarity; what fingerprints can't tell (at 0.8 some ten of 64 bits differ) is searched without loss after them.
    Rows that repeat both id and text are one document and stay together; of one id with other texts each
    text is a document; a null id stays only if its group has no other. Texts without words, null ones
    included, are one group. An empty table stays empty; other columns, whatever their names, stay.
    """
    rows, key = keyed(docs)
    found = similar.near_texts(rows, id_col=key, words=5, similarity=0.8).distinct()
    known = rows.select(F.col("doc_id").alias("id"), F.col(key).alias("key")).distinct().join(found.withColumnRenamed("doc_id", "key"), "key")
    known = common.saved(known, "grouped")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    extra = known.join(known.groupBy("component_id").agg(first), "component_id").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))))
    extra = common.saved(extra.select("id", F.col("key").alias("other")), "near-duplicates")
    return rows.join(extra, (rows[key] == extra["other"]) & rows["doc_id"].eqNullSafe(extra["id"]), "left_anti").select(*map(common.named, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text.

    Null and empty texts hold none; equal texts go or stay together, whatever their ids; an empty table stays
    empty; other columns, whatever their names, stay.
    """
    rows, key = keyed(docs)
    return without(docs, decontamination.contaminated(rows, common.table(spark, sf_dir, "benchmark"), id_col=key).select("doc_id"), "leaks")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences.

    Null text counts as empty and is one piece; repeated rows and null ids are documents like any other; pieces
    of one length are interchangeable; an empty table gives no piece; other columns are ignored.
    """
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
