"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

#: ASCII white space that separates words: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def doc_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, null texts as empty ones; whatever other columns there are stays out of the plan.

    All operators take integer doc_ids and refuse others alike.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id is {kind.simpleString()}; the operators take integers")
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))


def id_type(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. A local one is made only on a local master, where the session names none, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        top = f"file://{tempfile.mkdtemp(prefix='tidepool-shared-')}"
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return top


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read back: lineage ends here, and a lost executor costs a read.

    The table outlives the shuffles it was made by. Their files go as soon as it is written: the session is set to clean up
    after each query once, at the first cut, and stays so.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidepool-{uuid.uuid4().hex}"
    if spark.conf.get(_CLEAN, "false") != "true":
        spark.conf.set(_CLEAN, "true")
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


#: Bytes of an Arrow batch that goes to Python, in jobs that run many operators in one session.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bound of Arrow batches: Python holds a batch, its strings and what is made of them at once, so that batches bound its memory whatever the length of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives back what earlier tasks of this Python worker have freed: workers outlive their tasks, and allocators keep what they once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def discard(*tables: DataFrame) -> None:
    """Empties tables that cut() wrote and nothing will read again: what was made from them has been cut in its turn."""
    for table in tables:
        table.sparkSession.createDataFrame([], "gone int").coalesce(1).write.mode("overwrite").parquet(table.cut_path)


def map_batches(df: DataFrame, schema: StructType | str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Arrow batches of df by a function that make() gives in each task, to lists of arrays by the schema's columns.

    Columns that only pass through stay Arrow: 64-bit ids beside nulls keep their values, which pandas would make floats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in one(b)], names=names)

    shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = shape.names
    return df.mapInArrow(run, shape)


def add_columns(df: DataFrame, reads: list[str], shape: str, make: Callable[[], Callable[..., list]]) -> DataFrame:
    """df with further columns, ``shape`` their DDL. make() gives, in each task, a function from lists of the columns read to the arrays of the new ones."""

    def wrapped():
        one = make()
        return lambda b: [*b.columns, *one(*[b.column(b.schema.get_field_index(r)).to_pylist() for r in reads])]

    return map_batches(df, StructType([*df.schema.fields, *StructType.fromDDL(shape).fields]), wrapped)


def fresh(taken: list[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to be no column of ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def unsigned_hex(col) -> F.Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def held_out(doc_id, mod: int, at: int) -> F.Column:
    return F.crc32(doc_id.cast("string")) % mod == at
