"""What the operators share: written tables in the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


_OPEN: list[list["Tables"]] = []


@contextmanager
def dropped_after() -> Iterator[None]:
    """Deletes, at its end, the tables that operators wrote inside; what they returned must have been written by then."""
    made: list[Tables] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for tables in made:
            tables.drop_all()


#: Bytes of an Arrow batch between an executor and its Python worker. By default 10,000 rows, some 35 MB of texts of usual
#: length, which each task holds several times: as buffers on both sides, as Python objects, and with what is made of them.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are of about ``BATCH_BYTES``, whatever the length of texts; a setting of
    the session's own holds. Rows and results are the same."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def kept_setting(spark: SparkSession, name: str) -> Iterator[None]:
    """Puts a setting of the session back at the end."""
    before = spark.conf.get(name, None)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, lengthened until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Written tables of one operator run; they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        for made in _OPEN:
            made.append(self)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again. What was shuffled for it goes at once; by itself Spark keeps it until the
        driver happens to collect its garbage."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        with kept_setting(self.spark, CLEANUP_SETTING):
            self.spark.conf.set(CLEANUP_SETTING, "true")
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.written_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that this object wrote and nothing reads any more."""
        self._delete(df.written_path)

    def drop_all(self) -> None:
        """Delete all tables of this object."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
