"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last
return the columns of docs, extra ones included, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import Sealed, shared_folder
from sparkprep.llm.jaccard_join import near_duplicates
from sparkprep.llm.language_id import UNDETERMINED, fit_language_model, identify_language
from sparkprep.llm.line_dedup import line_dedup
from sparkprep.llm.mixing import mix_sources
from sparkprep.llm.piece_dropout import encode_pieces

#: Below this share of the best language a document counts as of no language.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or of no clear language, go. Where no language can be learned all documents stay."""
    sealed = Sealed(docs)
    model = fit_language_model(sealed.df, sealed["text"], sealed["lang"])
    if not model.languages:
        return docs
    found = identify_language(sealed.df, model, sealed["text"], "_lang", "_score")
    return sealed.reopen(found.where((F.col("_lang") != UNDETERMINED) & (F.col("_score") >= MIN_LANGUAGE_SCORE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents and more go; ``n_chars`` follows the text."""
    sealed = Sealed(docs)
    text = sealed["text"]
    kept = line_dedup(sealed.df, sealed["doc_id"], text)
    return sealed.reopen(kept, {"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else None)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, and repeated rows stay once. Different texts of one id are judged apart."""
    sealed = Sealed(docs)
    doc, text = F.col(sealed["doc_id"]), sealed["text"]
    keep = near_duplicates(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    kept = sealed.df.join(keep, doc.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left_semi")
    return sealed.reopen(kept.dropDuplicates([sealed["doc_id"], text]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; repeated rows are told apart by a number.

    Null, empty and blank texts have no words and are not taken. A null source is a source of its
    own. Rows of one id and different texts are taken each by its own draw. An empty table stays empty.
    """
    sealed = Sealed(docs)
    doc, source = sealed["doc_id"], sealed["source"]
    mix = mix_sources(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"), "copies")
    mix = mix.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_source", F.desc("copies")))).where("copies > 0").drop("_source")
    rows = sealed.df.withColumn("_k", F.xxhash64(sealed["text"]))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(doc, "_k").orderBy(source)))
    taken = rows.join(mix, F.col(doc).eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")) & (F.col("_n") == F.col("_nth")))
    return sealed.reopen(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces: copy (from 0), ids and n_pieces. Repeats of one document take different segmentations.

    A null text has null ids and no pieces, an empty one no pieces. An empty table stays empty. A column
    of the data called copy, ids or n_pieces is replaced.
    """
    sealed = Sealed(docs)
    doc, text = sealed["doc_id"], sealed["text"]
    order = Window.partitionBy(doc, F.xxhash64(text)).orderBy(sealed["source"])
    numbered = sealed.df.withColumn("_copy", F.row_number().over(order) - 1).withColumn("_seed", F.concat_ws(":", doc, "_copy"))
    encoded = encode_pieces(numbered, "_seed", text, ids_out="_ids")
    return sealed.reopen(encoded, added={"copy": F.col("_copy"), "ids": F.col("_ids"), "n_pieces": F.coalesce(F.size("_ids"), F.lit(0)).cast("long")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("mix_sources", mixture),
    ("piece_dropout", pieces),
]

#: Hashing, sampling and segmentation have no SQL form here; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate tables go to the folder that the cluster shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
