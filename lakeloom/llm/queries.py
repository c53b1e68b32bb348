"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.catalog.inputs import table
from lakeloom.llm import (
    collocations, decontaminate, html_text, langid, licences, line_dedup, near_dups, packing, quality, token_links, topk, toxicity, warc)
from lakeloom.llm.shared import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, with the SQL that gives the same rows, if SQL can express it."""
    def register(job):
        QUERIES[job.__name__] = job
        if sql is not None:
            ORACLE[job.__name__] = sql
        return job
    return register


def token_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document: five-word shingles, similarity 0.8 or more."""
    return near_dups.classes(table(spark, sf_dir, "documents"), threshold=0.8)


@query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold copies of benchmark items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(licences.oracle())
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in each document that names any."""
    return licences.scan(table(spark, sf_dir, "documents"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from labelled ones whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    return quality.score(docs, quality.train(docs, labels, ~held_out), held_out, threshold=0.3)


@query()
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from documents whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    return langid.predict(docs, langid.train(docs.filter(~held_out)), held_out)


@query(warc.ORACLE)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), token_file(), length=2048, end_id=1)


@query(topk.ORACLE)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query(line_dedup.ORACLE)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents that an earlier line repeats, within one word."""
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from labelled ones whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    return toxicity.score(docs, toxicity.train(docs, labels, ~held_out), held_out, threshold=0.5)


@query(collocations.ORACLE)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language: phrases of 2 to 5 words that occur 100 times or more."""
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


@query()
def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in two vocabularies: where their tokens end together, and how common these links are."""
    return token_links.described(table(spark, sf_dir, "documents"), token_file("byte_bpe_50k.json"),
                                 token_file("piece_bpe_32k.model"))
