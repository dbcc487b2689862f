"""Lines that many documents share: found by hash, dropped from all documents but the last that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, hash128, read_table

#: At most so many keys (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def candidate_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(__h1, __h2, __last): hashes of the keys that at least min_docs rows hold, and the largest id among them.

    Keys are made distinct inside each row before the explode, so the count is a plain sum with a partial
    aggregate on the map side: a line in every document costs one row a task. Rows are documents or more, so no key
    that enough documents hold is missed.
    """
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.char_length(k) >= min_chars))
    each = docs.select(F.col(id_col).alias("__id"), F.explode(keys).alias("__key")).select("__id", *hash128(F.col("__key")))
    return each.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__last")).where(F.col("__n") >= min_docs).drop("__n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text rewritten, and the columns n_lines and n_dropped (replacing any of these names).

    Null text is one empty line and becomes an empty text. Rows of one id are one document, those of a null id one too;
    rows that share the largest id holding a key all keep its lines, and so does a null id where no other
    holds the key. An empty table gives an empty table.
    """
    common = checkpoint(candidate_lines(docs, id_col, text_col, min_chars, min_docs))
    row = [F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__text")]
    lines = (
        docs.select(*row, F.posexplode(lines_of(F.col(text_col))).alias("__pos", "__line"))
        .select("__id", "__text", "__pos", line_key(F.col("__line")).alias("__key"))
        .where(F.char_length("__key") >= min_chars)
        .select("__id", "__text", "__pos", *hash128(F.col("__key")))
    )
    hits = checkpoint(lines.join(common, ["__h1", "__h2"]))
    # Of the few keys left, documents are counted: first once a document, then by key.
    sure = hits.select("__h1", "__h2", "__id").distinct().groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_docs)
    sure = checkpoint(sure.select("__h1", "__h2"))
    drops = (
        hits.where(~F.col("__id").eqNullSafe(F.col("__last")))
        .join(F.broadcast(sure) if sure.count() <= BROADCAST_ROWS else sure, ["__h1", "__h2"], "left_semi")
        .groupBy(F.col("__id").alias("__drop_id"), F.col("__text").alias("__drop_text"))
        .agg(F.collect_set("__pos").alias("__drops"))
    )
    here = docs.withColumn("__text", F.xxhash64(F.col(text_col)))
    joined = here.join(drops, F.col(id_col).eqNullSafe(F.col("__drop_id")) & (F.col("__text") == F.col("__drop_text")), "left")
    joined = joined.withColumn("__lines", lines_of(F.col(text_col)))  # after the exchange, which moves each text once
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops")), lambda i: F.col("__lines")[i])
    return joined.withColumns(
        {
            text_col: F.when(F.col("__drops").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long"),
        }
    ).drop("__lines", "__text", "__drop_id", "__drop_text", "__drops")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_OP5 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> last AS dropped
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
