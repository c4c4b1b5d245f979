"""A corpus pipeline of five stages, each an operator of ``sleepsignal.llm``.

Each stage takes the documents its predecessor kept, is written as Parquet in the shared folder and read again.
All but the last return the columns of ``documents``; the last returns the packed pieces.

* toxicity: documents scored 0.5 or more go. The model learns from the stage's own documents and ``labels``.
* language ID: documents without a letter, or like no learned language at all, go.
* near duplicates: of each class of linked documents the first row stays (smallest doc_id, then smallest text).
* decontamination: documents that overlap a benchmark item go.
* packing: what is left is packed into sequences of 2048 ids.

Nulls and edge cases: a null or empty text is not toxic, has no letter and goes in the second stage; texts are read
whole, however long; rows of equal id and text are judged alike, and one of them stays; a null doc_id is kept like any
other; extra columns stay, whatever their names; empty ``documents`` give no row, empty ``benchmark`` drops nothing,
empty ``labels`` call nothing toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleepsignal.llm import decontaminate, jaccard, langid, packing, toxicity
from sleepsignal.llm.common import read_table
from sleepsignal.session import cut

#: A text is unlike every learned language if fewer of its trigrams were met in the texts learned from.
LANGUAGE_LEAST = 0.25
TOKENIZER = "word_bpe_49k.json"


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = _free(docs, "_toxicity")
    scored = toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels"), score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = _free(docs, "_language")
    known = langid.identify(docs, found)
    good = (F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.known") >= LANGUAGE_LEAST)
    return known.filter(good).drop(found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), size=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
