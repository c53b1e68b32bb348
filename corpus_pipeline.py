"""The training-data pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one. All but
the last return the columns of documents.

Rows are told apart by doc_id and text. A row without a doc_id is a document like any other and comes after those with one; rows
that share a doc_id but not the text are different documents. Of rows equal in both the near-dedup stage keeps one. Null and
empty texts go in the first stage, as do texts without a letter. Empty tables give no rows, and columns other than those of
documents pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.catalog.inputs import table
from lakeloom.llm import decontaminate, langid, line_dedup, near_dups, packing
from lakeloom.llm.queries import token_file
from lakeloom.llm.shared import crc_mod
from lakeloom.sources.lake import committed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no text or no letter, or whose text is clearly in another language than they state. A null
    lang states none."""
    model = langid.train(docs.filter(crc_mod("doc_id", 3) != 1))
    return langid.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document or line has, within one word, and without documents of such lines alone. Lines of
    rows that share a doc_id, or have none, stand at one place if they have the same number: neither drops the other."""
    return line_dedup.without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, and rows without one last."""
    return near_dups.one_of_each(docs, threshold=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a copy of a benchmark item. Items without words, also null ones, are in no document."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of at most 2048 ids."""
    return packing.pack(docs, token_file(), length=2048, end_id=1)


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near_copies), ("decontamination", benchmark),
          ("packing", sequences)]

# Tokens, alignments and similarities are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = committed(stage(spark, docs, sf_dir), f"stage-{at}")
    return docs
