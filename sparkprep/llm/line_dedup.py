"""Line dedup: lines found in many documents go.

Each text is split at ``\\n`` and exploded to (document, position, digest of the
normalised line). Documents are counted per digest with partial aggregates, so a
line that a third of all documents hold costs one row per task. Positions of lines
over the threshold come back to their documents, which are put together again by
position. The commonest lines, a bounded number of them, come back by broadcast, so no
task gets all rows of a line that most documents hold. Lines are normalised and hashed once.

A row's identity is (id, digest of its text): repeated rows and rows that share an
id are cleaned each by its own lines, and rows of one id count as one document;
null ids count as one document. A null or empty text is one empty line. Lines
whose key is empty are never dropped. A text of very many lines is handled whole, its
lines by their positions; an empty table gives an empty result. Extra columns are kept, whatever their names; one
that is called like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import common as c


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10, min_key_chars: int = 1) -> DataFrame:
    """docs with ``text`` cleaned and the columns ``n_lines`` and ``n_dropped`` added.

    A line's key is the line stripped of white space at both ends with A-Z in
    lower case. A key of at least ``min_key_chars`` code points that is in at
    least ``min_documents`` documents loses all its lines in every document.
    """
    sealed = c.Sealed(docs)
    rows = sealed.df.withColumn("_doc", F.coalesce(F.col(sealed[id_col]).cast("string"), F.lit(""))).withColumn("_text", F.coalesce(F.col(sealed[text_col]), F.lit("")))
    lines = rows.select("_doc", F.xxhash64("_text").alias("_row"), F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    key = c.ascii_lower(F.trim(F.col("_line"), F.lit(c.BLANKS)))
    lines = (
        lines.select("_doc", "_row", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_key_chars)
        .select("_doc", "_row", "_pos", F.unhex(F.md5("_key")).alias("_digest"))
    )
    lines = c.durable(lines)
    common = c.durable(lines.groupBy("_digest").agg(F.count_distinct("_doc").alias("_n")).where(F.col("_n") >= min_documents))
    dropped = c.join_hot_apart(lines, common, "_digest", "_n", "left_semi").groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_gone"))
    rows = rows.withColumn("_row", F.xxhash64("_text")).join(dropped, ["_doc", "_row"], "left")
    rows = rows.withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_n_lines", F.size("_lines").cast("long"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rows = rows.withColumn("_keep", F.when(F.col("_gone").isNotNull(), keep))
    kept = F.array_join(F.transform("_keep", lambda i: F.col("_lines")[i]), "\n")
    return sealed.reopen(
        rows,
        {text_col: F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept)},
        {"n_lines": F.col("_n_lines"), "n_dropped": F.coalesce(F.col("_n_lines") - F.size("_keep"), F.lit(0)).cast("long")},
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
