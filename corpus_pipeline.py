"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before kept; :func:`run` writes what a
stage gives as Parquet into the cluster's shared folder and reads it again.
Columns of ``documents`` beyond :data:`COLUMNS` are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velarium.llm import mixing, neardup, packing, toxicity
from velarium.llm.common import cut, table
from velarium.llm.queries import WORD_BPE, tokenizer_path

#: What the stages but the last one return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts get the score of the bias alone, which is that of
    clean ones unless most labels are toxic; rows without an id and repeated
    rows are judged like others; without labels of both classes nothing is
    learnt and the base rate decides; an empty table stays empty.
    """
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id.

    Texts without words are in no group and stay, and so do rows without an id;
    rows that repeat an id and its text count once; an empty table stays empty.
    """
    return neardup.deduplicated(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words take no part in the mix's words and are taken as
    often as their source's whole part has it; a null source is one of its
    own, the last; equal rows are taken one by one; an empty table stays empty.
    """
    return mixing.expanded(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences.

    Null and empty texts are a piece of the end id alone; copies, and rows
    without an id, are pieces of their own; an empty table gives no pieces.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path(WORD_BPE), end_id=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained model, MinHash and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
