"""From raw documents to packed training sequences: quality, toxicity, near duplicates, mixture, packing.

Rows and edge cases, for every stage: a null text is an empty one; a null id is a document of its own,
never a near duplicate of another, and is mixed by a draw from its text; rows that repeat whole are judged
each, and one of them is left after the near duplicates; an id that comes with several texts stands for
the smallest of them when near duplicates are sought, and its row with that text is left; a domain that is
labelled but has no target gets the target 0, so its documents go; columns of any name pass through the filtering stages, packing returns its own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import table, write_shared
from lucerna.llm.mixing import LANGUAGE_TARGETS, resample
from lucerna.llm.ngram_join import ngram_components
from lucerna.llm.packing import pack_documents
from lucerna.llm.quality import fit_quality, quality_score
from lucerna.llm.toxicity import fit_toxicity, toxicity_score

#: A document stays when its quality score reaches this.
LEAST_QUALITY = 0.5
#: A document goes when its toxicity score reaches this.
TOXIC = 0.3
#: Documents are near duplicates when the Jaccard similarity of their shingles of so many words reaches so many hundredths.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  It learns from the labelled rows of the corpus."""
    score = quality_score(fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text")) >= LEAST_QUALITY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic.  The model learns from the labelled rows of the corpus."""
    score = toxicity_score(fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text")) < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, for each group of near duplicates; rows without id stay."""
    found = ngram_components(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    rows = docs.join(kept, docs["doc_id"] == F.col("__kept"), "left_semi")
    # Of an id with several rows that with the smallest text stays, by which the id was judged; a hot id combines before the shuffle.
    rest = [c for c in docs.columns if c != "doc_id"]
    told = F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*rest)))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), told).alias("__row"))
    one = one.select("doc_id", *(F.col(f"__row.`{c}`").alias(c) for c in rest)).select(*docs.columns)
    return one.unionByName(docs.filter(docs["doc_id"].isNull()))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates ask for, so that expected tokens by language meet the targets."""
    covered = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id", "left_semi")
    return resample(docs, labelled, LANGUAGE_TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack_documents(docs, added_tokens=True)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Two stages are trained classifiers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
