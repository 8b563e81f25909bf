"""Table access by folder: one Parquet file or folder per table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is kept in memory on every executor only up to this many rows.
BROADCAST_LIMIT_ROWS = 200_000


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table `name` of `folder`, pruned to `columns` where given."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `limit` rows; beyond that as it is, for a shuffled join.

    The rows are counted, so `df` should be cheap to read: a table, or cut by `checkpointed`.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _shared_folder(session: SparkSession) -> str:
    """The checkpoint folder of this application, made from spark.checkpoint.dir.

    Where that is unset, as in local tests, a temporary folder is used; on a cluster it is an error.
    """
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="steploom-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage by a reliable checkpoint in the session's spark.checkpoint.dir."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a Parquet table beside the checkpoints, and read back from there.

    Unlike a checkpoint it can be read in part: by column, and by the statistics of its row groups.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written_to(df, name))


def _written_to(df: DataFrame, name: str) -> str:
    path = f"{_shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _path(spark: SparkSession, text: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def table_version(spark: SparkSession, folder: str, *names: str) -> str:
    """A digest of paths, sizes and times of the files of some tables; it changes when a table does."""
    seen = []
    for name in names:
        path, files = _path(spark, f"{folder}/{name}.parquet")
        files = files.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


_SHARED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared_table(spark: SparkSession, folder: str, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` makes of the tables `sources`, written once for all queries of this application.

    It is made anew when a file of the sources has changed, or the table is no longer there.
    """
    key = (spark.sparkContext.applicationId, name, table_version(spark, folder, *sources))
    if key in _SHARED:
        done, files = _path(spark, f"{_SHARED[key][0]}/_SUCCESS")
        if not files.exists(done):
            del _SHARED[key]
    if key not in _SHARED:
        df = build()
        _SHARED[key] = (_written_to(df, name), df.schema)
    path, schema = _SHARED[key]
    return spark.read.schema(schema).parquet(path)
