"""A training corpus from `documents`: five stages, each an operator of `placegrid.llm`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder as Parquet and reads
it again as the next stage's docs. All stages but the last return the columns of documents:

1. quality_classifier: documents above their language's quantile of perplexity or of repeated words go, so do texts
   without a character.
2. line_dedup: lines frequent on their source go from the texts; documents without any word left go.
3. near_dedup: of each class of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest id stays;
   rows that bear the same id and text are one document. Rows without an id stay if no other row has their text's set.
4. decontamination: benchmark passages are cut out, documents mostly made of them go.
5. tokens: doc_id, source, lang, the ids, their number, and whether decoding gives back the text.

Rows of a null id or source, null texts and repeated rows follow the operators' rules; an empty table stays empty. Input
columns that bear the name of a column an operator adds are carried along under their own name up to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegrid.llm import decontaminate, kneser_ney, lines, neardup, pieces
from placegrid.llm.common import stored
from placegrid.llm.queries import Query, piece_model, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # texts are stored with their scores and not moved
    judged = kneser_ney.judged(_columns(docs), table(spark, sf_dir, "labels"), carry=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = _counted(lines.drop_boilerplate(_columns(docs)).drop("n_lines", "n_dropped"))
    return left.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the numbers of rows are stored, so that they are the same whenever they are read
    rows = stored(_columns(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = neardup.near_duplicates(rows, k=5, carry=["_row"])
    # repeated rows of one id and text are copies too: the first stays
    first = classes.where("kept").groupBy("doc_id", "text_key").agg(F.min("_row").alias("_row")).select("_row")
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(_columns(docs), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.tokenized(docs.select("doc_id", "source", "lang", "text"), piece_model())
    return found.select(
        "doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL cannot say the perplexity model and the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERY = Query("pipeline", run, ORACLE_SQL)
