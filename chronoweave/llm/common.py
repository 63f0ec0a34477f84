"""Shared helpers: scratch tables in the shared folder, hashing, Arrow loops."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is what the session names in ``spark.checkpoint.dir``; only where that
    is unset (tests on one machine) a temporary folder of our own is used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir()
    if named is not None and not isinstance(named, str):  # scala.Option
        named = named.get() if named.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="chronoweave-")
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A table survives lost executors, since it lies in the shared folder.  Call
    :meth:`drop` as soon as nothing reads a table any more; what is left goes
    when the driver ends.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cw-{what}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._quiet)

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cw_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._cw_path)
        self.sweep()

    def sweep(self) -> None:
        """Spark's cleaner deletes shuffle files once what refers to them is collected."""
        for _ in range(2):  # Python's hold on the JVM's objects goes first
            gc.collect()
            self.spark._jvm.System.gc()

    def _quiet(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may have gone before us
            pass


def id_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads; null text becomes the empty text.

    Extra columns, whatever their names, never reach the operator.
    """
    cols = [docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")]
    return docs.select(*cols, *[docs[c].alias(c) for c in more])


def rows_in(batches: Iterator[pa.RecordBatch], chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds much more than ``chars`` text bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= chars:
            yield batch
            continue
        step = max(1, n * chars // batch.nbytes)
        for at in range(0, n, step):
            yield batch.slice(at, step)


_held: dict = {}


def worker_cache(owner: str, key, make: Callable):
    """What a worker keeps between tasks: one object of one operator at a time."""
    if (owner, key) not in _held:
        _held.clear()
        _held[owner, key] = make()
    return _held[owner, key]


def give_back() -> None:
    """Return freed memory of this process to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets no Arrow batch of the session hold much more than ``most`` bytes, on its way to Python included.

    Rows may hold long texts, of which Spark's own bound gathers 64 MB a task.
    A session that asks for less keeps its setting.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if now.rstrip("b").isdigit() and not 0 < int(now.rstrip("b")) <= most:
        spark.conf.set(key, str(most))


def map_docs(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over bounded batches; ``fn(batch)`` yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)

    def run(batches):
        arrow = to_arrow_schema(out)
        for batch in rows_in(batches):
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, out)


def ddl(df: DataFrame, col: str) -> str:
    """The DDL type of a column."""
    return df.schema[col].dataType.simpleString()


def crc_mod(col: Column, n: int) -> Column:
    """``crc32(id as text) mod n``, the split rule of the contracts."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))

