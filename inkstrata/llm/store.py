"""Tables kept between stages, and connected components over an edge table.

Intermediate results live as Parquet under the shared folder that the session
names in ``spark.checkpoint.dir``: a lost executor costs a re-read, never a
recomputation of the whole lineage. Operators delete tables that nothing reads
any more; those that a returned frame reads stay until the caller is done with it:
``mark`` before and ``sweep`` after, as the pipeline does, delete them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
#: Folders of the tables that are still there, oldest first.
_shelves: list[str] = []


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores until it clashes with none of ``columns`` (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without a setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="inkstrata-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def shelve(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/inkstrata/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._shelf = path  # noqa: SLF001
    _shelves.append(path)
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete shelved tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, getattr(df, "_shelf", None))


def _delete(spark: SparkSession, path: str | None) -> None:
    if path in _shelves:
        _shelves.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """A point in time, for ``sweep``."""
    return len(_shelves)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete all tables shelved after ``since`` but ``keep``'s; frames that read them are spent."""
    for path in _shelves[since:]:
        if keep is None or path != getattr(keep, "_shelf", None):
            _delete(spark, path)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)``: ``(node, component)``.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A
    component is named by its least node. Self loops and null ends are dropped.
    Every round aggregates before it joins, and the aggregate is shelved, so both
    join inputs are plain exchanges that adaptive execution can split when one
    node holds a large share of the edges.
    """
    tidy = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    now = shelve(tidy, "edges")
    mark = _mark(now)
    while mark[0]:
        around = now.select(F.col("hi").alias("lo"), F.col("lo").alias("v")).unionByName(
            now.select("lo", F.col("hi").alias("v"))
        )
        least = shelve(around.groupBy("lo").agg(F.least(F.min("v"), F.col("lo")).alias("m")), "least")
        large = shelve(
            now.join(least, "lo").where("hi <> m").select("hi", F.col("m").alias("lo")).distinct(), "large"
        )
        roots = shelve(large.groupBy("hi").agg(F.min("lo").alias("m")), "roots")
        moved = large.join(roots, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = shelve(moved.unionByName(roots.select("hi", F.col("m").alias("lo"))).distinct(), "small")
        after = _mark(small)
        discard(now, least, large, roots)
        now = small
        if after == mark:
            break
        mark = after
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
    found._shelf = now._shelf  # noqa: SLF001  # the last table of edges, for the caller to discard
    return found
