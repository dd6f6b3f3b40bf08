"""From raw documents to packed sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of ``docs``. Stages are cut from each other by written tables, so a lost executor
costs the stage it was in only. Rows without an id go through every stage; only their own text decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, jaccard, linededup, packing, simhash, toxicity
from lexweave.llm.columns import sheltered
from lexweave.session import table, written

#: SQL cannot express the stages (a trained chain, rolling hashes, tiling); tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labels of ``docs``, does not reject.

    Null and empty texts are scored as texts without words. Without labels nothing is rejected. Repeated rows
    share their fate; an empty table stays empty; other columns keep their names and values.
    """
    docs, back = sheltered(docs)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where(~toxicity.rejected()).select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; ``n_chars`` follows the text.

    Null texts stay null. Rows without an id lose their own repeats only; rows that share an id do not remove
    each other's chunks. A text of repeated chunks only becomes empty. An empty table stays empty; other
    columns keep their names and values.
    """
    docs, back = sheltered(docs)
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_lost") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Groups are linked by SimHash fingerprints of three-word shingles first; those that are left, by five-word
    shingles of which they share 0.8, taken from the whole texts. Rows without an id stay, and so do rows that
    share an id but are unlike; of repeated rows one stays. Null and empty texts are one group. An empty
    table stays empty; other columns keep their names and values.
    """
    docs, back = sheltered(docs)
    left = written(simhash.representatives(docs).withColumn("_row", F.monotonically_increasing_id()), "representatives")
    gone = jaccard.later_copies(left.select(F.col("_row").alias("doc_id"), "text", F.col("doc_id").alias("_of")), "_of")
    stay = left.join(gone.select(F.col("doc_id").alias("_row")), "_row", "left_anti").drop("_row")
    return stay.unionByName(docs.where("doc_id is null")).select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item has leaked into.

    Null and empty texts stay. Repeated rows share their fate. An empty benchmark removes nothing; an empty
    table stays empty; other columns keep their names and values.
    """
    docs, back = sheltered(docs)
    out = decontaminate.coverages(docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.col("_coverage") < decontaminate.THRESHOLD).select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences.

    Every row is packed, with a null text as an empty one, rows without an id and repeated rows too. An empty
    table gives an empty result; only ids and texts are read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; odd rows are treated as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
