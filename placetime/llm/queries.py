"""One query per operator over its whole table; digest columns are derived from the operator's results."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetime.llm import chat, collocations, cotraining, fertility, licenses, line_dedup, merkle, mixing, oracles, token_counts, topk, toxicity
from placetime.llm.ngram_join import jaccard_components
from placetime.llm.packing import pack
from placetime.llm.registry import query
from placetime.llm.tables import Tables


def tokenizer(name: str) -> str:
    """Where a public vocabulary's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; Python workers started from now on also look for this package where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1, added_tokens=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), size=3, percent=90)


@query("op8_tokenizer_fertility")
def op8_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = Tables(spark, "fertility").settle(fertility.measures(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model")))
    return fertility.judged(measured, fertility.bands(measured))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(documents(spark, sf_dir), min_words=1, near_words=5)
    return cleaned.select("doc_id", "n_lines", "n_dropped", "n_near", F.md5("clean_text").alias("clean_md5"))


@query("op3_va_file_topk")
def op3_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


@query("op6_toxicity_grammar")
def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    grammar = toxicity.learn(docs, read(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, grammar)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op9_source_mixing")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=(1, 2, 3))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies", "rate")


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = {**licenses.TEMPLATES, **licenses.TEXTS}
    return licenses.scan(documents(spark, sf_dir), templates=templates, across_lines=True)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_counts.recounted(docs, token_counts.cleaning_edits(docs), tokenizer("byte_bpe_50k.json"), added_tokens=True)


@query("op4_quality_cotraining")
def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a third of the rows are held out, as for toxicity."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    labels = read(spark, sf_dir, "labels").filter(~held_out)
    scored = cotraining.classify(documents(spark, sf_dir), labels, rounds=3)
    kept = F.col("score") >= 0.5
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text_score", "page_score", "score",
        kept.cast("int").alias("predicted"), kept.alias("kept"),
    )


@query("op11_merkle_manifest", oracles.MERKLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document is claimed with the text it has after its line ends are lost."""
    docs = documents(spark, sf_dir)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    claimed = merkle.leaf([text if name == "text" else F.col(name) for name in merkle.FIELDS])
    proofs = merkle.manifest(docs, carried={"claimed": claimed})
    folded = merkle.folded(F.col("claimed"), F.col("path"))
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    told = proofs.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Conversation -7: both turns hold the control strings of the template.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op12_chat_formatting", oracles.CHAT)
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render(turns.unionAll(more)))


@query("op13_collocations", oracles.COLLOCATIONS)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), min_count=100, top=2000)
