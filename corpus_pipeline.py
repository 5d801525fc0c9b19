"""Training-data pipeline over ``documents``: five stages, each over all that the one before kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``.  Its result is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import langid, mixing, ngram_join, packing, trie_dedup
from linkweave.llm.common import one_row_per_text, table, text_of
from linkweave.session import checkpoint_dir


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a determinable language (no letter, null text) go.

    Where no document names a language there is nothing to learn; then only
    those without a letter go.  All columns stay, repeated rows are judged
    alike, a null doc_id makes no difference, an empty table stays empty.
    """
    model = langid.train(docs)
    if not model.labels:
        return docs.where(langid.has_letter(text_of()))
    tagged = docs.withColumn("_lw_language", langid.predictor(model)(text_of()))
    return tagged.where(F.col("_lw_language.lang") != langid.UNDETERMINED).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of texts equal up to A-Z case the row with the largest doc_id stays.

    Null text counts as empty, a null doc_id never wins against an id; of equal
    rows one stays.  An empty table stays empty.
    """
    found = trie_dedup.exact_dedup(docs, keep="max")
    return one_row_per_text(docs, found.where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of linked documents the least doc_id stays (a null one is the greatest).

    A text without words (null, empty, punctuation) is linked to nothing and
    stays; of equal rows one stays.  An empty table stays empty.
    """
    return ngram_join.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's repetition rate says.

    A null source is a source; a source without words has rate 0 and goes, as
    its documents add nothing to the mix.  Repeated rows are drawn alike.  An
    empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a training sequence.

    Null text counts as empty and gives its end id; repeated rows are packed
    each.  An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and tokenising have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; intermediate tables go to the session's shared checkpoint folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{base}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            _delete(spark, before)  # the stage that read it is written; the last table stays for the result
            before = path
    return docs


def _delete(spark: SparkSession, path: str | None) -> None:
    if path is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
