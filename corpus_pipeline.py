"""The corpus pipeline: stages over documents, each one operator, each written before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetime.llm import line_dedup, mixing, toxicity
from placetime.llm.ngram_join import jaccard_components
from placetime.llm.packing import pack
from placetime.llm.queries import read, tokenizer
from placetime.llm.registry import query
from placetime.llm.tables import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below 0.7; rows without an id are scored like any other."""
    grammar = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    numbered = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return toxicity.score(numbered, grammar, id_col="row").filter("score < 0.7").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; those of which no line is left go, and
    those that had none stay. A document that takes at least half of its words from one earlier document keeps
    these, so the next stage meets near copies, not what would be left of them."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS), copies=0.5)
    left = cleaned.filter((F.col("n_dropped") == 0) | (F.col("clean_text") != ""))
    n_chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("clean_text").cast("long"))
    return left.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", n_chars.cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: word shingles of five,
    similarity 0.8. Rows without an id are in no group. Of rows that share an id, a text that
    doesn't lead its group goes with it only if all of the id's rows do."""
    groups = jaccard_components(docs, size=5, percent=80)
    leaders = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).join(leaders, "doc_id", "left_semi")
    return named.select(*COLUMNS).unionAll(docs.filter("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix of sources takes them."""
    mixed = mixing.mix(docs).select(
        F.col("doc_id").alias("_d"), F.col("row_hash").alias("_t"), F.col("source").alias("_s"), F.col("copies").cast("int").alias("copies")
    ).filter("copies > 0").dropDuplicates(["_d", "_t", "_s"])
    same = (
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))
    )
    taken = docs.select(*COLUMNS).join(mixed, same)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens; a document taken several times is packed several times."""
    pieces = pack(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1, added_tokens=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned weights, components, Newton iterations and token ids have no SQL form.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder and read by the next."""
    tables = Tables(spark, "pipeline")
    docs, written = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = tables.settle(stage(spark, docs, sf_dir))
        tables.drop(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
