"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is stored and read again as the next one's docs. All but the last return the
columns of docs, whatever these are called. Stages:

toxicity: documents marked toxic go. quality: documents marked bad go. near duplicates:
one document of each component stays, that of the least id; rows of equal id and text
are one document, texts without words stay. decontamination: documents of which a
benchmark covers a twentieth go. pieces: ids of what is left.

Null texts are empty texts: scored for toxicity as texts without n-grams, judged by the
quality model as one empty line, never linked, never contaminated, without ids. Texts of
any length are read whole by every stage. Repeated rows are judged alike, and one of them
stays. Ties: a score of the threshold itself is toxic, or good; of documents with equal
ids in a component, that of the lesser hash stays. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicewatch.llm import line_crf, ngram_join, sp_wfst, suffix_arrays, toxicity
from sluicewatch.llm.queries import table
from sluicewatch.llm.scratch import stored


def _apart(docs: DataFrame) -> DataFrame:
    """Docs under names that no operator uses, but for ``doc_id`` and ``text``."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"__column{i}" for i, c in enumerate(docs.columns)))


def _kept(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return marked.select(*(F.col(n).alias(c) for n, c in zip(_apart(docs).columns, docs.columns)))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, toxicity.score(_apart(docs), model).where("predicted = 0"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = line_crf.fit_model(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, line_crf.score(_apart(docs), model).where("predicted = 1"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, ngram_join.deduplicated(_apart(docs)))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_arrays.find_matches(_apart(docs), table(spark, sf_dir, "benchmark"))
    return _kept(docs, suffix_arrays.contaminated(found).where(~F.col("contaminated")))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sp_wfst.encode(docs.select("doc_id", "text"), path)
    return encoded.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", without_copies),
    ("decontamination", decontaminated),
    ("pieces", as_pieces),
]

#: The first two stages fit models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
