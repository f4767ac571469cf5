"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.registry import query, table
from corpuscope.llm.running import running_totals

#: Weights of the sources in order of name, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so many times at most.
MOST = 3
#: Sampling weights by quality label; no label lies between.
QUALITY_WEIGHTS = {1: 4.0, 0: 1.0}
UNLABELLED_WEIGHT = 2.0

#: White space that separates words: a space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The words each source is to give: ``source``, ``source_size``, ``target``.

    Sources stand in order of code points, null last, and weigh ``weights`` in turn.
    They share the sum of all sizes by weight; a target stops at ``most`` times the
    source's size, and the excess is shared again by weight until none is above. Taken
    in order of cap over weight, the sources that stop come first, so one running sum
    finds the last share. One row per source is all that meets in one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int")).cast("long")
    ranked = sources.withColumns({"_weight": weight, "_cap": F.col("source_size") * most})
    by_cap = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    ahead = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(ahead), F.lit(0))
    shared = ranked.withColumns({"_left": left, "_weight_left": weight_left})
    # the first source that its share does not fill sets the share of all behind it
    fits = F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_weight_left")
    share = F.struct("_left", "_weight_left")
    first = F.first(F.when(fits, share), ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, 0))
    shared = shared.withColumn("_share", first)
    target = (F.col("_share._left") * F.col("_weight")).cast("double") / F.col("_share._weight_left").cast("double")
    return shared.select(
        "source", "source_size", F.coalesce(target, F.col("_cap").cast("double")).alias("target")
    )


def unit_hash(value: Column) -> Column:
    """A number in (0, 1) that depends on the value alone."""
    digits = F.substring(F.md5(value.cast("string")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How often the mix takes each document: the columns of ``docs`` and those below.

    ``docs`` has ``doc_id``, ``source``, ``size`` (words, null counts as 0) and
    ``weight`` (its quality, above 0; null counts as 1), and may have ``text_key``, a digest of the text. A target of k sizes of its
    source and a rest takes every document k times; the rest goes to documents in the order of
    the exponential keys -ln(u) / weight, u being a hash of the id: sampling without
    replacement in proportion to the weights. A document is taken for the rest if its
    middle word lies within it, so a source misses its target by half a document at
    most. Reruns agree, as keys depend on ids alone. An empty source has the target 0
    and is taken 0 times; repeated rows are documents of their own. Rows with a null id are drawn by their
    ``text_key``; those without one too share one key.

    The order is one global range sort by source and key, so a source that holds a
    third of all rows is spread over many tasks. Adds ``source_size``, ``target``,
    ``copies`` (times taken) and ``taken`` (words taken).
    """
    draws = [unit_hash(F.col(c)) for c in ("doc_id", "text_key") if c in docs.columns]
    keyed = docs.withColumns(
        {
            "size": F.coalesce(F.col("size"), F.lit(0)).cast("long"),
            "_key": -F.log(F.coalesce(*draws, F.lit(0.5))) / F.coalesce(F.col("weight"), F.lit(1.0)),
        }
    )
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")]
    placed = running_totals(keyed, order, ["size"])
    targets = source_targets(placed, weights, most)
    starts = placed.groupBy("source").agg(F.min("before_size").alias("_start"))
    plan = targets.join(starts, targets["source"].eqNullSafe(starts["source"])).select(
        targets["source"].alias("_source"), "source_size", "target", "_start"
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    middle = F.col("before_size") - F.col("_start") + F.col("size") / 2
    copies = F.col("_epochs") + F.when((middle < rest) & (F.col("_epochs") < most), 1).otherwise(0)
    return (
        placed.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_epochs", epochs)
        .withColumn("copies", copies.cast("long"))
        .select(
            *docs.columns,
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``weight``, a document's sampling weight by its quality label."""
    weight = F.lit(UNLABELLED_WEIGHT)
    for label, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("_quality") == label, value).otherwise(weight)
    known = labels.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.max("quality").alias("_quality"))
    return (
        docs.join(known, F.col("doc_id") == F.col("_doc_id"), "left")
        .withColumn("weight", weight)
        .drop("_doc_id", "_quality")
    )


def word_sizes(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``size``, the number of words of the text (null: 0), ``text_key``, then ``extra`` columns.

    ``text_key`` is a digest of the text where the id is null, and null elsewhere.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text_key = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", "source", size.alias("size"), text_key.alias("text_key"), *extra)


@query(
    "op7_mix_sources",
    r"""
    WITH docs AS (
        SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS drawn,
            coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
        FROM documents
    ), known AS (
        SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id
    ), keyed AS (
        SELECT docs.*, -ln((('0x' || substr(md5(drawn), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / CASE quality WHEN 1 THEN 4.0 WHEN 0 THEN 1.0 ELSE 2.0 END AS k
        FROM docs LEFT JOIN known USING (doc_id)
    ), placed AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
        FROM keyed
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
            [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
        FROM docs GROUP BY source
    ), ratios AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
            (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS w_rest,
            row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place
        FROM sources
    ), share AS (
        SELECT rest, w_rest, place FROM ratios WHERE rest * w <= cap * w_rest ORDER BY place LIMIT 1
    ), targets AS (
        SELECT source, source_size,
            CASE WHEN ratios.place >= share.place THEN (share.rest * w)::DOUBLE / share.w_rest::DOUBLE
                ELSE cap::DOUBLE END AS target
        FROM ratios, share
    ), epochs AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS e FROM targets
    )
    SELECT doc_id, size, source_size, target,
        (e + CASE WHEN middle < target - e * source_size AND e < 3 THEN 1 ELSE 0 END) * size AS taken
    FROM placed JOIN epochs ON placed.source IS NOT DISTINCT FROM epochs.source
    """,
)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the weights 5, 2, 1 of their sources."""
    sized = word_sizes(table(spark, sf_dir, "documents"))
    weighted = quality_weights(sized, table(spark, sf_dir, "labels"))
    return mix(weighted).select("doc_id", "size", "source_size", "target", "taken")
