"""The corpus pipeline: five stages over ``documents``, each reread from Parquet.

1. quality_model: documents that the quality classifier rejects go;
2. jaccard_join: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays;
3. decontaminate: documents that hold a benchmark window go;
4. secret_scan: secrets in the texts are replaced by a mask;
5. pieces: the texts are encoded and decoded; returns the digests per document.

A stage gets what its predecessor kept and works on all of it. Stages 2 and 3 judge
rows, not ids: where doc_ids repeat or are NULL the rows are numbered first, in the
order of doc_id (NULL last) and a hash of the row. Of near-duplicate rows the one
that is first in this order stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.llm.common import stored, table
from keyedit.llm.decontaminate import decontaminate
from keyedit.llm.jaccard_join import jaccard_components
from keyedit.llm.pieces import piece_digests
from keyedit.llm.quality_model import document_statistics, fit_quality, held_out, keep_quality
from keyedit.llm.secret_scan import learn_secrets, redact

#: Ids dropped by a stage are sent to the tasks up to this number (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000

#: What makes near-duplicates of the corpus; operator 9 by itself has figures of its own.
SHINGLE, THRESHOLD = 5, (4, 5)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` (NULL equals NULL) is not in ``ids`` (doc_id)."""
    ids = stored(ids.select(F.col("doc_id").alias("gone")).distinct(), "dropped")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(ids["gone"]), "left_anti")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``: the doc_id where that names one row each, else a number in the order of doc_id and row hash.

    Only rows that are equal in every column may change places.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64(*docs.columns).asc()]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = fit_quality(document_statistics(docs), labels)
    return keep_quality(docs.select(COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs.select(COLUMNS))
    groups = jaccard_components(docs, id_col="row", shingle=SHINGLE, threshold=THRESHOLD)
    return without(docs, groups.where("doc_id <> component_id"), "row").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs.select(COLUMNS))
    judged = decontaminate(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, judged.where("contaminated"), "row").select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    return redact(docs, *learn_secrets(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_digests(docs)


STAGES = [("quality_model", quality), ("jaccard_join", near_duplicates), ("decontaminate", decontaminated),
          ("secret_scan", secrets), ("pieces", pieces)]

#: Stages learn models and call a tokeniser: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
