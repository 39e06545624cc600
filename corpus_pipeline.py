"""A training-corpus pipeline over ``documents``: filter, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, and further columns of ``docs``, whatever their
names, go along.  ``run`` writes each stage to the shared folder as Parquet and reads it
again for the next.  An empty table stays empty in every stage; a text is always taken
whole, and one row must fit a task at about 60 times its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import discard, free_name, materialise, scratch_dir, scratch_scope, table
from quayside.llm.jaccard import one_of_each
from quayside.llm.packing import pack
from quayside.llm.perplexity import row_key, verdicts
from quayside.llm.substrings import remove_repeats
from quayside.llm.weaklabels import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps.

    A null text is judged like an empty one; rows that repeat each other share a verdict;
    a score just at the threshold stays.
    """
    return keep_good(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band.

    A null or empty text fails the base rules; a null language is a language of its own;
    rows that repeat each other share a verdict; the band's ends belong to it.
    """
    name = free_name(docs, "row")
    # tells rows apart that repeat a doc_id
    good = verdicts(docs).where("kept").select(F.col("row").alias(name))
    return docs.withColumn(name, row_key()).join(good, name, "left_semi").drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id.

    Null and empty texts are groups of their own; rows that repeat doc_id and text are
    one; a null doc_id is larger than any.
    """
    return one_of_each(docs, k=5, percent=75)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; a document of which nothing is left goes.

    So do null and empty texts.  All copies of a passage go, also those in repeated rows.
    """
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text = docs.columns.index("text")
    carried = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()])
    cut = remove_repeats(carried, text=f"c{text}", keep=[n for n, c in own.items() if c not in ("text", "n_chars")], window=35, layout=True)
    cut = cut.where("n_words > n_removed")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col(n)).alias(c) for n, c in own.items()])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the documents left, one row per piece.

    A null or empty text is its end token; rows that repeat each other are packed each.
    """
    return pack(docs, capacity=2048, end_id=1)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The stages train models and hash n-grams, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's scratch tables and its predecessor's output go when it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        to = scratch_dir(spark)
        with scratch_scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), to)
        if before:
            discard(spark, before)
        before = to
    return docs
