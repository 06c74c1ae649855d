"""A target kept bucketed and sorted by its key, so that change sets of any size join it without shuffling it.

``write`` lays the target out once in ``buckets`` buckets by key (a catalog table over
files of its own). Joins then read bucket by bucket: only the changes are dealt out, to the
same number of partitions, and Spark adds no exchange above the target's scan. Beyond the
broadcast bound this saves the shuffle of the whole target for every check and every run.

All rows of a key share a bucket, so a key with a large share of the rows would make one
bucket, and one task, as large. Such *hot* keys (``keyedit.skew.hotRows`` rows or more, found by a
map-side-combined count while writing) go to a plain table beside it. There are at most
``rows / hotRows`` of them, and a change set has one row for each, so that side is joined with the
few changes of hot keys. Rows with a NULL key match nothing and are kept there, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.operators import apply as ap
from keyedit.operators.joins import _conf_int, hot_keys, keyed_join
from keyedit.operators.staging import KEY, KEY_CAST, ROW_NUM


@dataclass(frozen=True)
class BucketedTarget:
    """``name`` holds the buckets, ``<name>_apart`` the rows of hot and NULL keys."""

    spark: SparkSession
    name: str
    key: str
    buckets: int

    @classmethod
    def write(cls, target: DataFrame, name: str, key_column: str, path: str, buckets: int | None = None) -> "BucketedTarget":
        """Lay ``target`` out below ``path`` and name it in the catalog.

        ``buckets``: as many as tasks are wanted for a join with the whole target
        (``spark.sql.shuffle.partitions`` by default).
        """
        spark = target.sparkSession
        key = ap._target_name(target, key_column)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = target.where(F.col(f"`{key}`").isNotNull())
        hot = hot_keys(keyed.select(f"`{key}`"), [key], _conf_int(target, "keyedit.skew.hotRows", 1_000_000))
        apart = target.where(F.col(f"`{key}`").isNull())
        if hot is not None:
            apart = apart.unionByName(keyed_join(keyed, hot.select(key), [key], "left_semi"))
            keyed = keyed_join(keyed, hot.select(key), [key], "left_anti")
        # one file for each bucket: dealt by the same hash as the buckets are
        (keyed.repartition(buckets, F.col(f"`{key}`")).write.bucketBy(buckets, key).sortBy(key)
         .option("path", f"{path.rstrip('/')}/buckets").saveAsTable(name))
        apart.write.option("path", f"{path.rstrip('/')}/apart").saveAsTable(f"{name}_apart")
        return cls(spark, name, key, buckets)

    def frame(self) -> DataFrame:
        return self.spark.table(self.name).unionByName(self.spark.table(f"{self.name}_apart"))

    def _changes(self, changes: DataFrame) -> DataFrame:
        return changes.where(F.col(self.key).isNotNull()).repartition(self.buckets, F.col(f"`{self.key}`"))

    def join(self, changes: DataFrame, how: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The target's rows joined with ``changes`` (one row per key at most, key named as in the target).

        ``how``: ``left``, ``inner``, ``left_semi`` or ``left_anti``, the target on the left.
        """
        def side(name: str) -> DataFrame:
            t = self.spark.table(name)
            return t if columns is None else t.select(*[F.col(f"`{c}`") for c in columns])
        apart = side(f"{self.name}_apart")
        few = keyed_join(changes, apart.select(self.key).distinct(), [self.key], "left_semi")
        # hinted to a merge of the sorted buckets: the planner may still broadcast a side that it knows to be small
        return (side(self.name).join(self._changes(changes).hint("merge"), [self.key], how)
                .unionByName(keyed_join(apart, few, [self.key], how)))

    def apply_updates(self, coerced: DataFrame, update_columns: Sequence[str]) -> DataFrame:
        """As ``operators.apply.apply_updates``: the target is not shuffled, whatever the number of changes."""
        ap.assert_unique_keys(coerced)
        columns = self.spark.table(self.name).columns
        names = [next(t for t in columns if t.lower() == c.lower()) for c in update_columns]
        good = ap.passing_changes(coerced).select(
            F.col(KEY_CAST).alias(self.key), *[F.col(f"`{c}`").alias(f"__new_{c}") for c in names], F.lit(True).alias("__hit"))
        hit = F.coalesce(F.col("__hit"), F.lit(False))
        return self.join(good, "left").select(*[
            F.when(hit, F.col(f"`__new_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`")
            for c in columns])

    def matched_key_counts(self, coerced: DataFrame) -> DataFrame:
        """``key_cast, rows_matched`` of the change keys that the target has; counted within the buckets."""
        keys = coerced.select(F.col(KEY_CAST).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        return (self.join(keys, "left_semi", [self.key]).groupBy(F.col(self.key).alias(KEY_CAST))
                .agg(F.count(F.lit(1)).alias("rows_matched")))

    def row_outcomes(self, coerced: DataFrame, unmatched: str = "ignore") -> DataFrame:
        return ap.judged(coerced, self.matched_key_counts(coerced), unmatched, False)

    def missing_keys(self, coerced: DataFrame) -> DataFrame:
        """Change rows whose key the target lacks; repeats kept."""
        present = self.matched_key_counts(coerced).select(KEY_CAST)
        return keyed_join(coerced.select(ROW_NUM, KEY, KEY_CAST), present, [KEY_CAST], "left_anti", small_fits=False).select(
            ROW_NUM, KEY)

    def present_keys(self, coerced: DataFrame) -> DataFrame:
        """Change rows whose key the target has."""
        present = self.matched_key_counts(coerced).select(KEY_CAST)
        return keyed_join(coerced.select(ROW_NUM, KEY, KEY_CAST), present, [KEY_CAST], "left_semi", small_fits=False).select(
            ROW_NUM, KEY)
