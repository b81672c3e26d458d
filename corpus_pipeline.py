"""A cleaning pipeline over documents: toxicity, near copies, benchmark leaks, secrets, mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as
the docs of the next one. All but the last keep the columns of documents; the last adds copies, how often the mix
takes a document, and leaves out those it never takes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import saved, table, temporary
from chronoframe.llm.decontaminate import drop_leaking
from chronoframe.llm.mixing import mix_sources
from chronoframe.llm.ngram_join import drop_near_copies
from chronoframe.llm.secrets import mask_secrets
from chronoframe.llm.toxicity import drop_toxic, trained_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the score is learned from the labelled rows of the tables."""
    return drop_toxic(docs, *trained_on(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked documents stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with copies, which replaces a column of that name. Rows are told apart by their file and
    their place in it, so rows that repeat an id, a text or both each have their own copies; docs that are no written table
    are written first."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place)
    except AnalysisException:
        docs = saved(docs, "unmixed")
        place = docs.metadataColumn("_metadata")
    free = "mix"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    file, row, n = f"{free}1", f"{free}2", f"{free}3"
    placed = docs.withColumns({file: F.xxhash64(place["file_path"]), row: place["row_index"]})
    taken = mix_sources(placed, carry=(file, row)).where("copies > 0").select(file, row, F.col("copies").alias(n))
    own = [c for c in docs.columns if c.lower() != "copies"]
    return placed.join(saved(taken, "mix"), [file, row]).select(*own, F.col(n).alias("copies"))


STAGES = [("toxicity", toxicity), ("near copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]
#: SQL can't express the fitted stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
