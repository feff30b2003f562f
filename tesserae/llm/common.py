"""What the corpus operators share: inputs, and tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters between separators is a word: space and the controls \\t \\n \\v \\f \\r separate.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none need be configured."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        where = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_PATHS: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables that ``written`` made since that many were there, but for the files of ``keep``.

    What reads them must be finished: a query's result is lazy and reads its tables until it is written.
    """
    kept = {f.rsplit("/", 1)[0] for f in keep.inputFiles()} if keep is not None else set()
    rest = []
    for path in _PATHS[since:]:
        if any(k.endswith(path.split(":", 1)[-1]) for k in kept):
            rest.append(path)
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _PATHS[since:] = rest


def tables_written() -> int:
    return len(_PATHS)


#: Rows, about, in which hot keys are looked for.
HOT_SAMPLE = 200_000


def join_unique(left: DataFrame, right: DataFrame, on: str, how: str = "inner", slack: int = 4) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key at most, safe for keys that hold much of ``left``.

    A key is hot if it holds more than 1/(slack * partitions) of the rows, so at most that many are
    hot: their rows of ``right`` are broadcast and meet ``left`` where it lies; only the other keys are
    shuffled.  ``left`` should be a table that was written, as it is read three times.  A null key joins
    nothing.
    """
    spark = left.sparkSession
    parts = slack * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = left.count()
    share = min(1.0, HOT_SAMPLE / max(rows, 1))  # where work is done may rest on a sample; what is found may not
    least = max(int(rows * share) // parts, 100)
    seen = left.select(on) if share == 1.0 else left.select(on).sample(share, seed=7)
    keys = seen.groupBy(on).agg(F.count("*").alias("held")).where((F.col("held") > least) & F.col(on).isNotNull()).select(on)
    found = keys.collect()  # at most about ``parts`` keys
    if not found:
        return left.join(right, on, how)
    hot = spark.createDataFrame(found, keys.schema)
    cold = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    few = right.join(F.broadcast(hot), on, "left_semi")
    return cold.unionByName(left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))


def expanded(rows: DataFrame, count: str, index: str) -> DataFrame:
    """Each row as often as ``count`` says, numbered from 0 in ``index``; a row of very many goes out in blocks to all tasks."""
    block = 10_000
    few = rows.where(F.col(count) <= block).withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    many = rows.where(F.col(count) > block).withColumn("first of a block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(block).cast("long"))))
    spread = many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("first of a block"))
    start = F.col("first of a block")
    many = spread.withColumn(index, F.explode(F.sequence(start, F.least(start + block, F.col(count)) - 1))).drop("first of a block")
    return few.unionByName(many)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column, gap: str = WORD_GAP) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(v, component)``, the smallest vertex of each.

    Every vertex takes the smallest label among itself and its neighbours, then the label of its
    label, until nothing changes.  Each round is written to the shared folder; only the number of
    changes comes to the driver.  Vertices are those that have an edge.  A vertex with very many edges
    and a component with very many vertices are hot keys of these joins, and are broadcast.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), what)
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("component")), what)
    while True:
        near = join_unique(both, labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        step = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        step = written(step, what)
        jump = labels.select(F.col("v").alias("label"), F.col("component").alias("next"))
        step = written(join_unique(step, jump, "label").select("v", "old", F.least("label", "next").alias("component")), what)
        labels = step.select("v", "component")
        if step.where("old <> component").isEmpty():
            return labels
