"""Index maintenance: what changed, what goes, what is written, and whether a candidate may replace an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gates of a candidate index.
LEAST_RECALL, MOST_REGRESSION, LEAST_OVERLAP = 0.40, 0.05, 0.80


def changes(incoming: DataFrame, stored: DataFrame, model: str, revision: str, id_col: str = "doc_id") -> DataFrame:
    """``incoming`` with ``change``: current, metadata_only, changed or new.

    Both hold ``document, content_hash, metadata_hash``; ``stored`` holds ``model, revision`` too.  Another
    model or another known revision is changed; so is a row whose hash and document both differ; a
    current row needs the revision and the metadata hash as well.
    """
    old = stored.select(F.col(id_col), *[F.col(c).alias("_" + c) for c in ("document", "content_hash", "metadata_hash", "model", "revision")], F.lit(True).alias("_known"))
    both = incoming.join(old, id_col, "left")
    revised = F.col("_revision").isNotNull() & (F.col("_revision") != revision)
    same = F.coalesce(F.col("_content_hash") == F.col("content_hash"), F.lit(False)) | F.coalesce(F.col("_document") == F.col("document"), F.lit(False))
    tagged = F.coalesce((F.col("_revision") == revision) & (F.col("_metadata_hash") == F.col("metadata_hash")), F.lit(False))
    kind = (
        F.when(F.col("_known").isNull(), "new")
        .when(~F.col("_model").eqNullSafe(model) | revised | ~same, "changed")
        .when(tagged, "current")
        .otherwise("metadata_only")
    )
    return both.withColumn("change", kind).select(*incoming.columns, "change")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """``stored`` with the latest incoming row of each key instead of or beside its own."""
    last = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_r = 1").drop("_r")
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


def really_changed(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows that are new or differ from the stored one in any column, nulls alike."""
    rest = [c for c in incoming.columns if c != key]
    old = stored.select(F.col(key), F.struct(*rest).alias("_old"))
    return incoming.join(old, key, "left").where(~F.col("_old").eqNullSafe(F.struct(*rest))).select(incoming.columns)


def without(stored: DataFrame, ids: DataFrame | None, key: str, where: Column | None = None) -> DataFrame:
    """``stored`` without the selected rows; a call without any selector is refused."""
    if ids is None and where is None:
        raise ValueError("deleting needs ids or a condition")
    gone = stored if where is None else stored.where(where)
    gone = gone.select(key) if ids is None else gone.select(key).join(ids.select(key), key, "left_semi")
    return stored.join(gone.distinct(), key, "left_anti")


def stale(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Stored keys that a full scan did not see."""
    return stored.select(key).join(seen.select(key), key, "left_anti").distinct()


def rekeyed(stored: DataFrame, source_col: str, old: str, new: str, key: str) -> DataFrame:
    """Rows of one source under another; where that one has the key already, its row stays."""
    moving = stored.where(F.col(source_col) == old)
    rest = stored.where(~F.col(source_col).eqNullSafe(old))
    taken = rest.where(F.col(source_col) == new).select(key)
    return rest.unionByName(moving.join(taken, key, "left_anti").withColumn(source_col, F.lit(new)).select(rest.columns))


def gate_failures(rows: int, expected: int, recall: float, active_recall: float | None, overlap: float) -> list[str]:
    """Why a candidate index may not replace the active one; empty if it may."""
    checks = {
        "row count differs": rows != expected,
        "recall too low": recall < LEAST_RECALL,
        "recall fell": active_recall is not None and active_recall - recall > MOST_REGRESSION,
        "keyword results differ": overlap < LEAST_OVERLAP,
    }
    return [name for name, failed in checks.items() if failed]
