"""Corpus pipeline: toxicity, near copies, repeated passages, benchmark contamination, token ids.

Each stage takes the documents its predecessor kept and returns a DataFrame; all but the last return
the columns of documents. Stages are written as Parquet and read again, so each starts from a table
in the shared folder and a lost executor costs part of one stage.

In every stage: a null text counts as empty; texts may be of any length; repeated rows and ids that occur
several times are handled row by row, but the near-copy stage keeps one row of those equal in id and text;
columns besides doc_id and text are kept as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import bpe_tree, decontaminate, near_copies, suffix_dedup, toxicity
from taskloom.llm.common import discard, fresh, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model learns from labels of the documents at hand; without labels all stay."""
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "toxicity")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links at a five-word Jaccard similarity of 0.8 or more stays, the one of the least id.

    Operator 6's vantage-point forest over SimHash fingerprints links first; every link is confirmed by the whole sets, and pairs that
    are alike enough but lie farther apart in bits are found by min-hash bands. Null ids come last. Texts that are null, empty or without words are one group.
    """
    return near_copies.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of 50 words or more are cut out of the texts; a document that loses all its words goes."""
    return suffix_dedup.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover to a twentieth or more go. Texts without words stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``token_ids``, and ``round_trip``: whether these decode to the text's bytes.

    Columns of documents of these names give way.
    """
    return bpe_tree.with_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Training a model, suffix order and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
