"""Shared plumbing of the training-data operators.

Every operator reads its tables through Spark's readers, keeps no state on the driver
but bounded models, and cuts lineage only through files in the shared checkpoint folder.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows handed to a text function at once: bounds the Python objects alive per worker.
SLICE = 256


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with `stem` that `df` does not have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in have:
        k += 1
        name = f"{stem}_{k}"
    return name


def crc_fold(col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(sc, "_celltide_dir", None) or tempfile.mkdtemp(prefix="celltide-")
        sc._celltide_dir = path
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/celltide-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder, once their results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_text(
    df: DataFrame,
    factory: Callable[[], Callable[[list], list]],
    fields: T.StructType,
    text: str = "text",
    out: str = "result",
) -> tuple[DataFrame, str]:
    """Append a struct column computed from whole texts, all other columns passing through.

    `factory` runs once per task and gives a function from a list of texts (None for null)
    to a list of tuples in the order of `fields`. Returns the frame and the new column's name.
    """
    name = fresh(df, out)
    at = df.columns.index(text)
    kind = to_arrow_type(fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                rows = work(part.column(at).to_pylist())
                made = [
                    pa.array([r[i] for r in rows], type=kind.field(n).type) for i, n in enumerate(names)
                ]
                struct = pa.StructArray.from_arrays(made, fields=[kind.field(n) for n in names])
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, fields)])
    return df.mapInArrow(run, schema), name


def released() -> None:
    """Give the memory that a task has freed back to the system: its Python worker waits for the next task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def relieved(spark: SparkSession) -> None:
    """Free what finished queries leave on the driver: after many of them, broadcasts and shuffles that nothing refers to any more.

    Spark drops these only after the JVM has collected their handles, and the JVM would rather enlarge its heap first. Memory that
    its native parts (compiler, class data, threads, network buffers) have freed goes back to the system, where the JVM can do that.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    gc.collect()  # plans are kept as long as Python has their frames
    jvm.System.gc()
    try:
        bean = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(kinds):
            types[i] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the bean's own class is not open to reflection
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(bean, values)
    except Py4JError:  # a JVM without that command
        pass


def slices(values: Iterable, size: int) -> Iterator[list]:
    out: list = []
    for v in values:
        out.append(v)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
