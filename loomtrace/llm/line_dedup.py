"""Recurring lines by a fixed-depth tree of line templates, with DataFrame operations only.

The tree sends a line first by its number of words, then by its leading words, to a leaf. Fields that
vary are generalised: words with a digit, an @ or a scheme always, and in a leaf any word that no other
line of the leaf has at that place. Lines with the same template are one; of templates that recur across
documents the lines of the first document stay and those of the others are dropped. A line or a template is
known by two 64-bit hashes, of its leaf and of itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, saved, table, text_of

DEPTH = 3
#: Lines of fewer words stay unless the caller sets another least number. Of a template at least this share of words must be constant.
LEAST_WORDS, CONSTANT = 1, 0.6
WILD = "<*>"
#: A word with a field that always varies, once words are separated by one space.
FIELD = "[^ ]*(?:[0-9@]|://)[^ ]*"


def count_of(line: Column, what: str) -> Column:
    return ((F.length(line) - F.length(F.replace(line, F.lit(what), F.lit("")))) / len(what)).cast("int")


def normal(lines: DataFrame) -> DataFrame:
    """Bring `line` to its normal form, words parted by one space and fields masked, and add n (its words), leaf and id.

    Nothing is filtered by n here: Catalyst would work out the whole form once more for the filter.
    """
    spaced = F.col("line")
    for c in "\t\r\x0b\x0c":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    lines = lines.withColumn("line", F.trim(spaced))
    lines = lines.withColumn("line", F.when(F.contains("line", F.lit("  ")), F.regexp_replace("line", " +", " ")).otherwise(F.col("line")))
    lines = lines.withColumn("n", F.when(F.col("line") == "", 0).otherwise(1 + count_of(F.col("line"), " ")))
    lines = lines.withColumn("masked", F.when(F.col("line").rlike("[0-9@:]"), F.regexp_replace("line", FIELD, WILD)).otherwise(F.col("line")))
    constant = F.col("n") - count_of(F.col("masked"), WILD)
    lines = lines.withColumn("line", F.when(constant >= CONSTANT * F.col("n"), F.col("masked")).otherwise(F.col("line"))).drop("masked")
    return lines.withColumns({"leaf": F.xxhash64("n", F.substring_index("line", " ", DEPTH)), "id": F.xxhash64("line")})


def split_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(named(id_col).alias("doc_id"), F.split(text_of(text_col), "\n", -1).alias("lines")).where("doc_id IS NOT NULL")


def templates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(leaf, id, template) of the distinct lines in leaves that hold several, where generalising changes the line.

    docs has doc_id and lines. Each distinct line is fetched from the first document that has it; that join
    is by sorting at every size, so that its cost follows the input.
    """
    leaves = saved(found.groupBy("leaf").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("leaf"), "leaves")
    ones = found.join(leaves, "leaf", "left_semi").groupBy("leaf", "id").agg(F.min(F.struct("doc_id", "pos")).alias("one"))
    asked = ones.groupBy("one.doc_id").agg(F.collect_list(F.struct("one.pos", F.col("id").alias("wanted"))).alias("asked"))
    fetched = docs.join(asked.hint("merge"), "doc_id").select(F.explode(F.transform("asked", lambda a: F.struct(F.get(F.col("lines"), a["pos"]).alias("line"), a["wanted"].alias("wanted")))).alias("x")).select("x.*")
    distinct = normal(fetched.where("line IS NOT NULL")).where("id = wanted").dropDuplicates(["leaf", "id"])
    words = saved(distinct.select("leaf", "id", F.posexplode(F.split("line", " ")).alias("at", "word")), "words")
    constant = saved(words.groupBy("leaf", "at", "word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf", "at", "word", F.lit(True).alias("constant")), "constant")
    marked = words.join(constant, ["leaf", "at", "word"], "left_outer").select("leaf", "id", "at", F.when(F.col("constant") & (F.col("word") != WILD), F.col("word")).alias("word"))
    made = marked.groupBy("leaf", "id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(WILD)).alias("word")))).alias("all"), F.count("word").alias("kept"), F.count(F.lit(1)).alias("n"))
    made = made.where(F.col("kept") >= CONSTANT * F.col("n"))
    return made.select("leaf", "id", F.xxhash64(F.lit("template"), F.array_join(F.transform("all", lambda x: x["word"]), " ")).alias("template"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, dropped): for documents that lose lines, the numbers of those lines, from 0."""
    texts = split_texts(docs, id_col, text_col)
    found = saved(normal(texts.select("doc_id", F.posexplode("lines").alias("pos", "line"))).select("doc_id", "pos", "n", "leaf", "id"), "lines").where(F.col("n") >= least_words).drop("n")
    made = saved(templates(texts, found), "templates")
    known = found.join(made, ["leaf", "id"], "left_outer").select("doc_id", "pos", "leaf", F.coalesce("template", "id").alias("template"))
    firsts = saved(known.groupBy("leaf", "template").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("leaf", "template", "first"), "firsts")
    again = known.join(firsts, ["leaf", "template"]).where(F.col("doc_id") > F.col("first"))
    return again.groupBy("doc_id").agg(F.collect_set("pos").alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the recurring lines taken out of the text; all rows and columns stay.

    A template recurs if documents of two ids have it; the lines of the smallest id stay. Lines repeated
    within one document only, blank lines and lines of fewer than `least_words` words stay. Rows repeated
    under one id are one document and lose the same lines; rows with a null id lose none and count for
    nothing; a null text stays null. With `dropped_col` the number of lines taken out is added there.
    """
    lines, key, numbers = (fresh(name, docs) for name in ("lines", "line_key", "line_numbers"))
    gone = dropped_lines(docs, id_col, text_col, max(1, least_words)).select(F.col("doc_id").alias(key), F.col("dropped").alias(numbers))
    # Split below the join, so that the lines are a column of it and not worked out anew for each line.
    split = docs.select(*(F.split(named(c).cast("string"), "\n", -1).alias(lines) if c == text_col else named(c) for c in docs.columns))
    joined = split.join(gone, named(id_col) == F.col(key), "left_outer")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    left = F.when(F.col(numbers).isNull(), F.col(lines)).otherwise(F.transform(stay, lambda i: F.get(F.col(lines), i)))
    columns = [F.array_join(left, "\n").alias(c) if c == text_col else named(c) for c in docs.columns]
    extra = [F.when(F.col(numbers).isNull(), 0).otherwise(F.size(numbers)).cast("long").alias(dropped_col)] if dropped_col else []
    return joined.select(*columns, *extra)


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, dropped_col="n_dropped")
    text = text_of("text")
    return out.select("doc_id", "n_dropped", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text, 256).alias("kept_sha256"))


SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM raw),
split AS (
  SELECT doc_id, pos, trim(regexp_replace(line, '[ \t\r\x0b\x0c]+', ' ', 'g')) AS line FROM numbered),
wild AS (
  SELECT doc_id, pos, string_split(line, ' ') AS words, list_transform(string_split(line, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9@]|://') THEN '<*>' ELSE w END) AS wild
  FROM split WHERE line <> ''),
lines AS (
  SELECT doc_id, pos, CASE WHEN len(list_filter(wild, lambda w: w <> '<*>')) >= 0.6 * len(wild) THEN wild ELSE words END AS words FROM wild),
leafed AS (
  SELECT *, len(words) || ' ' || array_to_string(words[1:3], ' ') AS leaf, array_to_string(words, ' ') AS line FROM lines),
contents AS (
  SELECT DISTINCT leaf, line, words FROM leafed
  WHERE leaf IN (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT line) > 1)),
each AS (
  SELECT leaf, line, unnest(range(len(words))) AS place, unnest(words) AS word FROM contents),
constant AS (
  SELECT leaf, place, word FROM each GROUP BY leaf, place, word HAVING count(*) > 1),
marked AS (
  SELECT e.line, e.leaf, e.place, CASE WHEN c.word IS NOT NULL AND e.word <> '<*>' THEN e.word END AS word
  FROM each e LEFT JOIN constant c ON e.leaf = c.leaf AND e.place = c.place AND e.word = c.word),
made AS (
  SELECT line, string_agg(coalesce(word, '<*>'), ' ' ORDER BY place) AS template
  FROM marked GROUP BY line, leaf HAVING count(word) >= 0.6 * count(*)),
known AS (
  SELECT l.doc_id, l.pos, coalesce('t' || m.template, 'l' || l.line) AS template FROM leafed l LEFT JOIN made m ON l.line = m.line),
firsts AS (
  SELECT template, min(doc_id) AS first FROM known GROUP BY template HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT k.doc_id, k.pos FROM known k JOIN firsts f ON k.template = f.template WHERE k.doc_id > f.first),
kept AS (
  SELECT n.doc_id, count(g.pos) AS n_dropped, coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
SELECT doc_id, CAST(n_dropped AS BIGINT) AS n_dropped, CAST(strlen(text) AS BIGINT) AS kept_bytes, sha256(text) AS kept_sha256 FROM kept
"""
