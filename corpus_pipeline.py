"""Training-data pipeline over ``documents``: language, near copies, repeated passages, mix, tokens.

Each stage takes the documents that the one before it kept and returns documents again, the
last one returns tokens. What a stage returns is written before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.bpe import encode
from corpuscope.llm.jaccard import Join, similar_sets
from corpuscope.llm.langid import UNKNOWN, fit_languages, identify
from corpuscope.llm.mixing import mix, quality_weights, word_sizes
from corpuscope.llm.registry import prepared, table
from corpuscope.llm.suffix_dedup import repeated_bytes
from corpuscope.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The columns of ``documents``, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(function: Stage) -> Stage:
    """A stage that runs with the settings the operators count on."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(prepared(spark), docs.select(*COLUMNS), sf_dir)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: those without letters go, and those that no language clearly fits.

    The classifier is fitted on the documents' own ``lang``. If no document has one,
    none is rejected for its language.
    """
    model = fit_languages(docs)
    judged = identify(docs, model, extra=COLUMNS[1:])
    if not model.languages:
        return judged.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group that shares 80 percent of its shingles of five words.

    Rows are compared by their texts: rows that repeat an id with different texts are
    documents of their own, and so are rows without an id, which stand behind those that have one. Rows
    of one id and text are one document, known by a 64-bit hash of both.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    groups = similar_sets(keyed.select(F.col("_row").alias("doc_id"), "text"), Join(5, 80, 100))
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")
    first = keyed.select("_row", "doc_id").distinct().join(groups, "_row").groupBy("component_id").agg(F.min(place).alias("_first"))
    kept = keyed.join(first.select(F.col("_first._row").alias("_row")), "_row", "left_semi")
    # rows of one id and text may differ in the rest; the least is the same one in every rerun
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    return kept.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest")).select("doc_id", "text", "_rest.*").select(*COLUMNS)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every string of 200 bytes that stands anywhere else too; characters cut in part go whole."""
    cut = repeated_bytes(docs, with_text=True, extra=("lang", "source"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their weights: a document stands as often as the mix takes it, one without words never."""
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    sizes = word_sizes(keyed, extra=("_hash",))
    weighted = quality_weights(sizes, table(spark, sf_dir, "labels"))
    taken = mix(weighted).filter("taken > 0").groupBy("doc_id", "_hash").agg(F.max("copies").alias("_copies"))
    taken = taken.select(F.col("doc_id").alias("_doc_id"), F.col("_hash").alias("_text"), "_copies")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("_text"))
    return keyed.join(taken, same).select(
        *COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    ).select(*COLUMNS)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to."""
    return encode(docs, with_ids=True).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's documents are written to the shared folder."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stored(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages hold trained classifiers and a tokenizer, which SQL does not express.
ORACLE_SQL: str | None = None
