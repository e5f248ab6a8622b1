"""A corpus pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
every stage's rows as Parquet in the shared folder and reads them again, so a
lost executor never sends the job back across a stage.

Cases, for every stage: columns beside the five are not read and do not come out;
a null text counts as empty, and stays in all stages but the removal of repeated
strings and the encoder, which give an empty text; null language, source and length
are values of their own; ids may be null or repeated, and rows are then told apart
by what they hold; very long texts are handled whole; an empty table gives an empty
table. How ties and repeated rows are settled is said at each stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm import bpe, mixing, neardup, quality, suffixes
from bandloom.llm.queries import vocabulary
from bandloom.storage import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for neither low quality nor toxic.

    Repeated rows get the same verdict; without labels all documents stay.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, whole=True).where("_bl_keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (five words, similarity 0.8): the one with the smallest id, null before all.

    A row is known by a hash of all its columns (64 bits), so that repeated rows
    are one, and rows that share an id or have none are documents of their own.
    """
    key = F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])
    rows = docs.select(*COLUMNS, key.alias("_bl_row"))
    classes = neardup.near_duplicates(rows, id_col="_bl_row").select(F.col("doc_id").alias("_bl_row"), "component_id").distinct()
    first = F.min(F.struct("doc_id", "_bl_row"))
    stay = rows.select("_bl_row", "doc_id").join(classes, "_bl_row").groupBy("component_id").agg(first.alias("first")).select("first._bl_row")
    return rows.dropDuplicates(["_bl_row"]).join(stay, "_bl_row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes (about 50 tokens) that stand in several places; no row goes.

    Rows equal in id and text repeat each other (the stage before leaves none). A
    character that a cut halves goes as a whole.
    """
    out = suffixes.remove_repeats(docs, length=200, as_text=True, carry=["lang", "source"])
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights; none is cut.

    The document at the edge of a source's fractional repetition is taken whole
    or not at all, whichever brings the source nearer to its target. Documents are
    ordered by a seeded digest of the id, then id and size; rows that tie in all are
    taken or left alike. A text without words comes as often as its source does in
    whole repetitions.
    """
    nearer = F.when(F.col("part") * 2 >= F.col("size"), F.col("size")).otherwise(0).cast("long")
    out = mixing.expand(mixing.mix(docs, carry=["text", "lang"]).withColumn("part", nearer))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from them; a row for each row."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", bpe_round_trip),
]

#: SQL can express neither the classifier nor the encoder; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")

    def stored(docs: DataFrame, stage: tuple) -> DataFrame:
        path = f"{folder}/{STAGES.index(stage)}"
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(stored, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
