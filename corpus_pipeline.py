"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut, sources are mixed, texts are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further
columns are allowed: rows without an id are kept and not compared, null texts stay null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.llm.common import drop_tables, materialize, read_table, tables_made
from kinsieve.llm.mixing import mix
from kinsieve.llm.neardup import one_of_each_group
from kinsieve.llm.packing import pack
from kinsieve.llm.queries import BLOCK_CHARS, WEIGHTS, WINDOW_TOKENS
from kinsieve.llm.records import count_tokens
from kinsieve.llm.suffixes import remove_repeats
from kinsieve.llm.toxicity import drop_toxic, fit_on

#: Passages of over 50 words have 100 bytes or more.
PASSAGE_BYTES = 100

#: The method of near copies and the boosted or trained parts can't be said in SQL.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that earlier stages wrote for themselves and that may still be read.
_WRITTEN: list[str] = []


def own_tables(stage: Stage) -> Stage:
    """The tables that stages write for themselves go when a later stage starts on rows that do not read them, as rows written and read again do not.

    Until then every plan made of a stage's output works, also of some of its columns or of stages chained without writing.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _WRITTEN:
            folders = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
            if not any(path.rsplit("/", 1)[-1] in folders for path in _WRITTEN):  # their names are unique
                drop_tables(spark, _WRITTEN)
                _WRITTEN.clear()
        with tables_made() as made:
            out = stage(spark, docs, sf_dir)
        _WRITTEN.extend(made)
        return out

    return run


@own_tables
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    return drop_toxic(docs, fit_on(docs, read_table(spark, sf_dir, "labels")))


@own_tables
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over shingles of five words the one with the least id stays."""
    return one_of_each_group(docs, width=5, similarity=0.8)


@own_tables
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id also has are cut, by whole characters; every document stays, and ``n_chars`` is counted again."""
    mark = "_" * max(map(len, docs.columns)) + "null"  # no column of docs
    flagged = docs.withColumn(mark, F.col("text").isNull())
    got = remove_repeats(flagged, PASSAGE_BYTES, characters=True)
    cut = F.size("spans") > 0
    out = got.withColumn("text", F.when(~F.col(mark), F.col("kept").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


@own_tables
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    return mix(docs, WEIGHTS, BLOCK_CHARS).orderBy("mix_slot", "mix_start", "doc_id").select(docs.columns)


def _written_order(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``written``, the place of each row in the files it is read from, whose names stand in the order of writing; None if it is not read from files."""
    try:
        return docs.withColumn("written", F.struct("_metadata.file_path", "_metadata.row_index")) if docs.inputFiles() else None
    except AnalysisException:
        return None


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their windows of token ids, which by name follow the order in which the mixing wrote them.

    Files need not be read in that order, so a row's place is that of its file and its row there. Rows that come from no file are mixed first.
    """
    import public_tokenizers

    columns = ["doc_id", "source", F.md5("text").alias("cluster"), F.length("text").cast("bigint").alias("chars"), "text"]
    written = _written_order(docs.select("doc_id", "source", "text"))
    rows = docs.select(*columns) if written is None else written.select(*columns, "written")
    rows = materialize(count_tokens(rows, public_tokenizers.path("word_bpe_49k.json")), "pack-lengths")
    if written is None:
        rows = mix(rows, WEIGHTS, BLOCK_CHARS, length=F.col("chars"))
    order = ["mix_slot", "mix_start", "doc_id"] if written is None else ["written"]
    return pack(rows, WINDOW_TOKENS, per_source=2, cluster=F.col("cluster"), length=F.col("n_ids"), order=order)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``; each stage before it is written in the shared folder and read again.

    A stage's own tables go when the next one starts; those of the last, and the stages' outputs, stay for the plan that is returned.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
