"""A corpus pipeline: language, exact and near copies, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

Cases: a null or empty text has no letters and is rejected by the first stage, as is a text in no
recognised language; a null id is never learnt from and is kept like any other; a null lang teaches
nothing, a null source is a source of its own in the mixture; repeated rows are exact copies, of which
one stays; ties go to the least id, then to the first row; an empty table gives an empty mixture;
texts are read whole; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm import decontamination, exact_dedup, language_id, minhash_dedup, source_mixing
from polyglint.llm.common import free_name, held_out, materialise, ship

#: Texts whose best language has a lower probability are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.4


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a model learnt from the labelled ones."""
    model = language_id.train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    lang, score = free_name(docs, "__lang"), free_name(docs, "__score")
    found = language_id.identify(docs, model, predicted=lang, score=score)
    return found.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    return decontamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The uses of documents in the training mixture: which epoch, block and place in the block."""
    return source_mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: SQL can't express the language model; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
