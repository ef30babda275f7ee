"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction and source mixing over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
one; all but the last return the columns of documents, further ones too, whatever their names.

Rows: null, empty and wordless texts have no language and go in the first stage; a null language label isn't learned from;
a null source is a source of its own; rows with a null id stay, each for itself; rows that share an id are one document, of
which near-dedup keeps one row; ties and repeated rows go to the smallest id; texts may be of any length; an empty table
gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import decontaminate, language_id, minhash_dedup, mixing, secret_scan
from heliograph.llm.common import materialize, table


def languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, a calibrated score too low, or subwords of no language learned."""
    model = language_id.fit(docs, F.col("text").isNotNull())
    return language_id.accepted(docs, model)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 or more on five-word shingles, the smallest id stays, once."""
    linked = minhash_dedup.near_duplicates(docs, words_a_shingle=5, percent=80)
    return minhash_dedup.keep_one(docs, linked)


def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars is that of the new texts."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with how many, and where each stretch goes (shard, place).

    Columns of theirs that are named as the mix's own are left out.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    return mixing.mix(docs, carry=rest).filter("taken > 0")


STAGES = [
    ("language_id", languages),
    ("minhash_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("secret_scan", secrets),
    ("source_mix", mixed),
]
#: Language models, CGK walks and keyed permutations aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs)  # Parquet in the shared folder
    return docs
