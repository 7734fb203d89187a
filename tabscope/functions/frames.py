"""Small driver-side results as local relations, and the folder that a cluster shares."""
from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def schema_of(ddl: "str | T.StructType") -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)


def local_rows(spark: SparkSession, rows: list[tuple], schema: "str | T.StructType") -> DataFrame:
    """Rows whose number the schemas set (not the data) as a DataFrame that needs no job to read."""
    fields = schema_of(schema).fields
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]), schema_of(schema))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a local session without that
    setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"{(base or tempfile.mkdtemp(prefix='tabscope-')).rstrip('/')}/tabscope-{uuid.uuid4().hex}"
