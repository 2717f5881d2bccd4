"""A corpus pipeline of five stages over `documents`; each stage's rows are written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import language_id, line_dedup, mixing, near_dedup, packing
from typeloom.llm.common import discard, row_key, stored
from typeloom.llm.queries import tokenizer_path

#: SQL cannot express cross-parsing, SuperMinHash or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None
#: Tokens packed together: documents of one sequence are at most so far apart in the mix, and one document.
GROUP_TOKENS = 262_144


def _rows(docs: DataFrame) -> DataFrame:
    """key (128 bits over doc_id and text), row (all of docs' columns, so that none clashes with what a stage adds)."""
    return docs.select(row_key("doc_id", "text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. lang becomes the prediction where it was null, and stays null where no label is there to learn from.

    Null, empty and letterless texts go; repeated rows and null ids stay as they are; no rows give none.
    """
    samples = language_id.learn(docs.select("doc_id", "text", "lang"))
    if not samples:
        return docs.where("text rlike '\\\\p{L}'")
    # Numbered names clash with none that the operator adds, and the text goes through it once.
    numbered = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    told = language_id.identify(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in numbered.items())), samples).where(F.col("lang_pred") != language_id.UNKNOWN)
    return told.select(*((F.coalesce(n, "lang_pred") if c == "lang" else F.col(n)).alias(c) for c, n in numbered.items()))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site lines of any length but for their first occurrence; n_chars follows the text.

    Null and empty texts stay (n_chars null and 0); repeated rows are cleaned alike; no rows give none.
    """
    cleaned = line_dedup.without_boilerplate(docs)
    return cleaned.select(*((F.length("text").cast("long") if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): that with the smallest id, null ids last.

    Rows are linked under their row keys, so rows with null ids take part; of rows equal in doc_id and text the
    least in all columns stays. Texts without words are linked with nothing and stay. No rows give none.
    """
    keyed = _rows(docs)
    name = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("doc_id"), "key").alias("doc_id")  # the least of a group is the row that stays
    told = near_dedup.near_duplicates(keyed.select(name, "row.text")).where("kept").groupBy("doc_id.key").agg(F.count("*").alias("n"))
    kept = stored(told)
    if kept.where("n > 1").limit(1).count():
        keyed = keyed.groupBy("key").agg(F.min("row").alias("row"))  # before anything is shuffled by its key
    return keyed.join(kept.select("key").hint("merge"), "key", "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _placed(docs: DataFrame) -> DataFrame:
    """place, row: docs in the order of the Pfair mix of their sources, in partitions that hold a range of places each."""
    keyed = _rows(docs)
    places = mixing.mixed(keyed.select(F.col("key").alias("doc_id"), "row.source")).groupBy(F.col("doc_id").alias("key")).agg(F.min("place").alias("place"))
    return keyed.join(places.hint("merge"), "key").select("place", "row").repartitionByRange("place").sortWithinPartitions("place")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the Pfair mix of their sources; a null source counts as one named ''.

    Repeated rows share the place of their first; null ids and texts are placed like others; no rows give none.
    """
    return _placed(docs).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in training sequences, numbered in the order of the mix.

    Files are reread in any order, so the places are rebuilt from the documents. Each partition packs a range
    of places, in runs of about GROUP_TOKENS tokens. Null and empty texts are the end token alone; repeated
    rows are packed each; no rows give no pieces.
    """
    return packing.packed(_placed(docs).select("row.doc_id", "row.text"), tokenizer_path(), group_tokens=GROUP_TOKENS, in_order=True)


STAGES = [("language_id", identify_language), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
