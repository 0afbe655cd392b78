"""From raw documents to packed training sequences: language ID, near-dedup, repeated-string removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet and read again. Null, empty and very long texts, ties, repeated rows and empty
tables are treated as the stages' operators state; extra columns of documents pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language, near, packing, repeats
from tallyspark.llm.common import read, stored
from tallyspark.llm.queries import tokenizer_path

#: The least mean probability of a document's language.
SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages that documents are labelled with.

    A null text, a text without letters and a text of no clear language go. If no document is labelled, nothing is
    known, and all documents with letters would be undetermined: they go.
    """
    judged = language.identify(docs, language.fit(docs.select("text", "lang")))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of documents of similar 5-word shingles (0.8 or more).

    Rows that repeat a kept doc_id with different texts all stay; of rows equal in doc_id and text, the least stays.
    Rows without a doc_id all stay.
    """
    kept = near.near_components(docs, size=5, percent=80).where("kept and doc_id is not null")
    ids = stored(kept.groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # the hints make small tables take the same way as large ones
    single = docs.join(ids.where("n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    several = docs.join(ids.where("n > 1").select("doc_id").hint("merge"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(rest).alias("row"))
    return single.unionByName(several.select("doc_id", "text", "row.*")).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove strings of 50 bytes or more that an earlier document has; documents of which nothing is left go."""
    rest = repeats.without_repeats(docs, texts=True).where("n_removed = 0 or trim(text) <> ''")
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into as few sequences of 2048 as minimum bin slack finds."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, hold=False)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", suffix_array_dedup), ("best-fit packing", best_fit_packing)]

#: SQL can't train a network, tokenise or pack; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: one row per piece of a document, with its sequence and place."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
