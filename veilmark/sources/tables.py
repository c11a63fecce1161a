"""Reading and writing tables: typed parquet, CSV without inference, idempotent cells, an isolated workspace."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started from."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    old = env.get("PYTHONPATH", "")
    if root not in old.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, old) if x)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, a temporary one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilmark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what is used more than once is made once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, all strings, so that zeros and hyphens stay; quotes are doubled inside quotes."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("quote", '"').option("escape", '"')
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def flags(df: DataFrame, *columns: str) -> DataFrame:
    """``true``/``false`` in any case as booleans."""
    return df.withColumns({c: F.lower(F.trim(F.col(c))).cast("boolean") for c in columns})


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same schema."""
    return df.sparkSession.createDataFrame([], df.schema)


class Workspace:
    """Named tables in one database, stored as parquet.

    Cells (stage and backend) are partitions: writing one replaces it alone, so a rerun changes nothing else.
    """

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table, self.database)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def replace(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("overwriteSchema", True).saveAsTable(self.name(table))

    def append(self, table: str, df: DataFrame) -> None:
        """Append with casts to the table's own types; a new table takes the frame's."""
        if not self.exists(table):
            df.write.saveAsTable(self.name(table))
            return
        target = self.table(table).schema
        df.select(*(F.col(f.name).cast(f.dataType) for f in target.fields)).write.mode("append").insertInto(self.name(table))

    def merge_append(self, table: str, df: DataFrame) -> None:
        """Append; columns that only one side has are null in the other's rows, and new ones are added to the table."""
        if not self.exists(table):
            df.write.saveAsTable(self.name(table))
            return
        known = {f.name.lower() for f in self.table(table).schema.fields}
        if new := [f for f in df.schema.fields if f.name.lower() not in known]:
            self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        there = {c.lower() for c in df.columns}
        rows = df.select(*((F.col(f.name) if f.name.lower() in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.table(table).schema.fields))
        rows.write.mode("append").insertInto(self.name(table))

    def leaked_rows(self, table: str, prefixes: tuple[str, ...], column: str = "doc_id") -> int:
        """How many rows of a table have a key that begins with one of the prefixes: rows that belong elsewhere."""
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col(column).startswith(p)
        return self.table(table).filter(hit).count()

    def replace_cells(self, table: str, df: DataFrame, cells: tuple[str, ...] = ("stage", "backend")) -> None:
        """Replace the partitions that ``df`` holds, and no others."""
        rest = [c for c in df.columns if c not in cells]
        ordered = df.select(*rest, *cells)
        if not self.exists(table):
            ordered.write.partitionBy(*cells).saveAsTable(self.name(table))
            return
        old = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            ordered.write.mode("overwrite").insertInto(self.name(table))
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)

    def view(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def latest(self, table: str, column: str, by: str = "ts") -> Column:
        """The value of a column in the row with the largest ``by``; null if the table is empty."""
        return self.table(table).agg(F.max_by(column, by).alias(column)).first()[column]


def preflight(spark: SparkSession, folder: str, needed: tuple[str, ...] = TABLES) -> DataFrame:
    """check, result: which of the needed tables can be read."""
    rows = []
    for name in needed:
        try:
            rows.append((name, "PASS" if read(spark, folder, name).columns else "WARN"))
        except Exception as e:  # the report is the point, whatever is wrong with a table
            rows.append((name, f"WARN: {type(e).__name__}"))
    return spark.createDataFrame(rows, "check string, result string")
