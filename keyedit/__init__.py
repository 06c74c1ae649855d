"""keyedit: keyed bulk changes applied to large tables with Spark.

A change set is a table of ``(row_num, key_value, <value columns>...)``; the
package checks it, previews it, snapshots the target, applies every listed
column to each matching target row in one distributed join, classifies the
outcome of every change, and keeps audit and history tables.
"""

from keyedit.spec import UpdateSpec, normalize_columns

__all__ = ["UpdateSpec", "normalize_columns"]
