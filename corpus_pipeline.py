"""From raw documents to packed training sequences, one operator after another.

STAGES: (name, function) in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, langid, near_dup, packing, toxicity
from factloom.llm._io import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Languages that go on; und never does.
LEAST_POSTERIOR = 0.5
#: Bytes of a worker's cache of word lengths: the executors hold the pipeline's other stages too.
CACHE_BYTES = 48 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, and those whose best language is less likely than LEAST_POSTERIOR, go.

    ``lang`` stays as it was given. Null and empty texts have no letter and go; of repeated
    rows all stay or go. An empty table, or one without languages to learn, gives no rows.
    Columns other than COLUMNS go.
    """
    docs = docs.select(*COLUMNS)
    trees = langid.fit(langid.training_rows(docs))
    found = langid.language(docs["text"], trees, CACHE_BYTES)
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LEAST_POSTERIOR))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls toxic go; without toxic labels in the sample none does.

    Null and empty texts are judged by the share of toxic labels, and so mostly stay; of
    repeated rows all stay or go. An empty table gives no rows. Columns other than COLUMNS go.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.toxic(docs["text"], model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, the first stored.

    Rows without words (null, empty, punctuation only) are unlike all others and stay. An
    empty table gives no rows. Columns other than COLUMNS go.
    """
    return near_dup.deduplicate(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a test string of the benchmark go.

    Null and empty texts stay; of repeated rows all stay or go. An empty table gives no
    rows, an empty benchmark drops none. Columns other than COLUMNS go.
    """
    return decontaminate.uncontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and its place there (see packing.pack).

    A null or empty text is one piece of the end id alone, repeated rows are packed each by
    itself, an empty table gives no rows. Other columns aren't read.
    """
    return packing.pack(docs)


STAGES = (
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
)

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
