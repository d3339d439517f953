"""The registered queries, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import table
from tidegraph.runtime import scratch_path

WORD_BPE = "word_bpe_49k.json"
# Tokens of a sequence that may bear loss; some 60 of 100 tokens of the documents do.
MAX_LOSS = 1280


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read them back and give each document's place and checksum."""
    from tidegraph.llm.token_files import read_token_files, write_token_files

    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, word_bpe(), end_id=2)
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents, half of whose lines bear loss, into sequences of 2048 tokens; one row for each piece."""
    from tidegraph.llm.packing import pack_texts, with_prompts

    documents = with_prompts(table(spark, sf_dir, "documents"))
    pieces = pack_texts(documents, word_bpe(), end_id=1, max_loss=MAX_LOSS, prompt="prompt")
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    from tidegraph.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of the quality rules for all documents."""
    from tidegraph.llm.line_frequency import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("host", "text_hash")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of the benchmark, and the items they are from."""
    from tidegraph.llm.decontaminate import hit_words, items_digest, mark_contaminated

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(documents, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        hit_words("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        items_digest("items").alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that line dedup drops from all documents."""
    from tidegraph.llm.line_templates import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of all documents under a class bigram model of nine tenths of them."""
    from tidegraph.llm.brown import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op8_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 16 MiB of text at most for all documents."""
    from tidegraph.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), max_bytes=1 << 24)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of all documents, learnt from the labelled ones."""
    from tidegraph.llm.ordinal import expected_grades, grade, train_ordinal

    documents = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade().alias("grade"))
    found = expected_grades(documents, train_ordinal(documents, ratings))
    tails = F.col("tails")
    return found.select("doc_id", "expected_grade", tails[0].alias("p_not_toxic"), tails[1].alias("p_good"), "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from three quarters of them."""
    from tidegraph.llm.langid import identify_languages, train_language_model

    documents = table(spark, sf_dir, "documents")
    return identify_languages(documents, train_language_model(documents))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    from tidegraph.llm.reply_trees import chat_digests, format_conversations, reply_paths

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    # A turn replies to the one before it; rows without a turn come first.
    rows = rows.withColumn("turn", F.coalesce("turn", F.lit(-(1 << 63)).cast("long")))
    turns = rows.select("conv_id", "turn").distinct()
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    names = {"tree": "conv_id", "message": "turn"}
    paths = reply_paths(turns.withColumn("reply_to", before), best=1, parent="reply_to", score=None, **names)
    return chat_digests(format_conversations(rows, paths, **names))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the words of all documents, with planted misspellings."""
    from tidegraph.llm.spelling import count_words, group_variants

    return group_variants(count_words(table(spark, sf_dir, "documents"), every=97))


def op13_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four parts for all vectors, with their errors."""
    from tidegraph.llm.laesa import encode_vectors, errors_by_label, train_codebooks, whole_vectors

    books, placed = train_codebooks(whole_vectors(table(spark, sf_dir, "embeddings")))
    found = errors_by_label(encode_vectors(placed, books))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_vector_packing": op2_vector_packing,
    "op3_simhash": op3_simhash,
    "op4_line_frequency": op4_line_frequency,
    "op5_decontamination": op5_decontamination,
    "op6_line_templates": op6_line_templates,
    "op7_brown_scores": op7_brown_scores,
    "op8_extendible_hashing": op8_extendible_hashing,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_language_id": op10_language_id,
    "op11_reply_trees": op11_reply_trees,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_laesa_codes": op13_laesa_codes,
}
