"""A training corpus from raw documents: clean, one of each near-duplicate, no repeats, mixed, as token ids."""

from pyspark.sql import DataFrame, functions as F

from dayloom.llm import mixing, nearcopies, pieces, quality, repeats
from dayloom.llm.common import stage, table


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failed lines."""
    return quality.cleaned(docs)


def simhash_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash within 3 bits, or 0.8 of the five-word shingles in common."""
    return nearcopies.one_of_each(docs)


def suffix_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words, or 400 bytes, that repeat; every copy goes.

    50 words of any language here have 150 bytes, so strings of that length are looked for.
    """
    return repeats.deduplicated(docs, length=150, gram=48, min_words=50)


def source_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them; one taken twice is two rows."""
    return mixing.mix(docs)


def token_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and the digest of what they decode to."""
    return pieces.there_and_back(docs).select(
        "row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_ids"), "ids",
        F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", source_mixing),
    ("sentencepiece encoding and decoding", token_ids),
]

#: Fingerprints, repeats and pieces have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written before the next reads them.

    A null, empty or short text is no clean document and goes in the first stage, as the quality rules
    have it.  Of repeated rows, and of texts that are near copies, the smallest doc_id's row stays, a
    null id last; ties between equal rows leave one.  A null source is a source of its own.  Long
    texts are processed whole.  Further columns, whatever their names, pass every stage but the last.
    An empty table gives an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
