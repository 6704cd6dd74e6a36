"""documents -> quality classifier -> exact dedup -> near-dedup -> packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of docs.
Rows are told apart by their place, so rows that repeat a doc_id, or have none, are judged each by its own text.
"""

from quadloom.llm import exact_dedup, near_dedup, packing, quality


def quality_classifier(spark, docs, sf_dir):
    """Drops what importance resampling rejects."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark, docs, sf_dir):
    """Keeps one row of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near(spark, docs, sf_dir):
    """Keeps one row of each component of near-duplicates, on shingles of five words."""
    return near_dedup.deduplicated(docs, width=5)


def packed(spark, docs, sf_dir):
    """Pieces of padded-free sequences with their ids."""
    return packing.packed(docs)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact), ("near-dedup", near), ("packing", packed)]

#: Importance resampling, MinHash and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES over documents; each stage's rows are stored in the shared folder before the next reads them."""
    from quadloom.llm.common import Scratch

    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{k}")
    return docs
