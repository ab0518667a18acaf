"""Documents to packed training sequences: quality, language, near-duplicates, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplumb.llm import langid, mixing, neardup, packing, quality
from veriplumb.llm.queries import tokenizer_files
from veriplumb.llm.shared import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that no operator uses, and these names by the columns' own."""
    name = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*name.values()), name


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is at least one half.

    A null text, and one without words, goes; rows that repeat are judged alike; nulls in other columns are groups of
    their own; no documents give none. Columns that ``docs`` has besides stay, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    own, name = numbered(docs)
    judged = quality.judge(own, labels, id_col=name["doc_id"], text_col=name["text"], host_col=name["source"], path_col=name["lang"], carry=True)
    return judged.filter("kept").select(*own.columns).toDF(*docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those taught; the prediction takes the place of a null ``lang``.

    Texts without letters go, and null ones. Where no row has a language, nothing is taught and nothing rejected.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs
    own, name = numbered(docs)
    said = langid.with_language(own, model, name["text"]).filter(F.col("lang_pred") != langid.UNKNOWN)
    return said.withColumn(name["lang"], F.coalesce(name["lang"], "lang_pred")).select(*own.columns).toDF(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles: the least id, null last.

    Of rows that repeat id and text one stays. A text that shares its id with another is judged on its own; texts without
    words are no near-duplicates.
    """
    return neardup.distinct(docs, repeats=False)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole repetitions as rows, and one part per source.

    Null sources are a source; texts without words are repeated as whole rows; no documents give none.
    """
    return mixing.materialise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 ids; a null or empty text is one piece. No documents give none."""
    return packing.pack(docs, *tokenizer_files())


STAGES: list[tuple[str, Stage]] = [("quality", good), ("language", in_a_language), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]
#: The stages are a fitted classifier, suffix automata, MinHash, a regular-expression mix and a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
