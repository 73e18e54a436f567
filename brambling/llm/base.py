"""Helpers shared by the training-data operators.

Words: UTF-8 bytes, A-Z lower-cased, every ASCII byte that is neither a digit nor
a letter is a separator. Bytes from 0x80 up always belong to words.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table: lower-cases A-Z and blanks ASCII separators.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(WORD_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting
    (a test) gets a temporary folder of its own; on a cluster its lack is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brambling-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: The folders of the jobs under way, the innermost last.
_FOLDERS: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the innermost ``scratch`` folder; ``keep``: in the one around it."""
    folders = _FOLDERS.get()[: -1 if keep else None]
    return f"{folders[-1] if folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within goes to a folder that is deleted at the end, but for tables
    stored with ``keep``. Frames that leave the block must read kept tables only."""
    folder = shared_path(spark, "scratch")
    token = _FOLDERS.set((*_FOLDERS.get(), folder))
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        _remove(spark, [folder])


def stored(df: DataFrame, name: str, path: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the
    lineage, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = path or shared_path(spark, name, keep)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folders) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def delete(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of stored frames that nothing reads any more."""
    for df in frames:
        _remove(spark, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def arrow_limits(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound the Arrow batches that Python workers get: by rows and by bytes, as
    one text may be longer than thousands of others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def uncollected(batches: Iterator) -> Iterator:
    """The batches, with Python's search for reference cycles off between the first and the
    last: there are none in these loops, and each search walks all of a worker's caches."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if was:
            gc.enable()


#: What empties the caches that operators keep in a worker between its tasks, by operator.
_CACHES: dict[str, Callable[[], None]] = {}


def sole(operator: str, empty: Callable[[], None] | None = None) -> None:
    """At the start of a worker's task: empties what other operators have kept in this
    process, as a worker that lives through several would hold all of it. ``empty`` does
    so for this one."""
    for other in [o for o in _CACHES if o != operator]:
        _CACHES.pop(other)()
    if empty:
        _CACHES[operator] = empty


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, a null text as an empty one; other columns are left out,
    so that their names can't clash with the operators' own."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


#: Up to so many ids (8 bytes each) are broadcast; beyond that both sides are shuffled.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` of rows by the one column of ids, which must be stored."""
    own = free_name(rows, "__id")
    ids = ids.select(F.col(ids.columns[0]).alias(own))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(ids, F.col(id_col).cast("long") == F.col(own), how)
