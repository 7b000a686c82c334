"""Tables in a folder of Parquet, with keys, replacement of rows and a schema version.

Every write makes a new snapshot of its table and then points to it, so a lost job leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork import schemas


def newest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, a new one in place of an old one with its key; of equal new ones any one, the same each time."""
    rows = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    order = Window.partitionBy(*keys).orderBy("__age", *(F.col(c).desc_nulls_last() for c in old.columns if c not in keys))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__age")


def upserted_dialogs(old: DataFrame, new: DataFrame) -> DataFrame:
    """New dialogs over old ones: a known access hash and user name are never lost, and the larger count stays."""
    o = old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns))
    both = new.withColumn("__new", F.lit(True)).join(o, F.col("id") == F.col("o_id"), "full_outer")
    fresh = F.col("__new").isNotNull()
    out = []
    for c in old.columns:
        mine, theirs = F.col(c), F.col(f"o_{c}")
        if c in ("access_hash", "username"):
            value = F.coalesce(mine, theirs)
        elif c == "msg_count":
            value = F.greatest(mine, theirs)
        else:
            value = F.when(fresh, mine).otherwise(theirs)
        out.append(value.alias(c))
    return both.select(*out)


def with_access_hashes(dialogs: DataFrame, found: DataFrame) -> DataFrame:
    """Known dialogs with the hashes of ``found`` (id, access_hash); ids that are not known are left out."""
    hashes = found.groupBy("id").agg(F.max("access_hash").alias("__hash"))
    return dialogs.join(hashes, "id", "left").withColumn("access_hash", F.coalesce("__hash", "access_hash")).drop("__hash")


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        found = self._read("_version", "version int, owner long")
        if found is not None and (version := found.first()["version"]) != schemas.SCHEMA_VERSION:
            raise ValueError(f"the store has schema version {version}; this is {schemas.SCHEMA_VERSION}: ingest again")
        if found is None:
            spark.createDataFrame([(schemas.SCHEMA_VERSION, None)], "version int, owner long").coalesce(1).write.parquet(f"{self.path}/_version/0")
            self._point("_version", "0")

    def _pointer(self, table: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/_current")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _point(self, table: str, to: str) -> None:
        path, fs = self._pointer(table)
        out = fs.create(path, True)
        out.write(bytearray(to.encode()))
        out.close()

    def _read(self, table: str, schema: str) -> DataFrame | None:
        path, fs = self._pointer(table)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{name}")

    def table(self, name: str) -> DataFrame:
        found = self._read(name, schemas.ALL[name])
        return self.spark.createDataFrame([], schemas.ALL[name]) if found is None else found

    def overwrite(self, name: str, rows: DataFrame) -> None:
        to = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], schemas.ALL[name]).schema
        rows.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.parquet(f"{self.path}/{name}/{to}")
        self._point(name, to)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Insert rows, each in place of one with the same key."""
        self.overwrite(name, newest(self.table(name), rows, schemas.KEYS[name]))

    def clear(self, name: str) -> None:
        self.overwrite(name, self.spark.createDataFrame([], schemas.ALL[name]))

    def upsert_dialogs(self, rows: DataFrame) -> None:
        self.overwrite("dialogs", upserted_dialogs(self.table("dialogs"), rows))

    def ingest(self, found) -> None:
        """Dialogs and messages of an export; messages that come again lose their protection until the next scan."""
        self.upsert_dialogs(found.dialogs)
        self.replace("messages", found.messages)

    def log_intent(self, chunk: DataFrame, batch_id: str, state: str, at: int, error: str | None = None) -> None:
        """Note the state of messages (dialog_id, msg_id): pending before a call, done or error after it."""
        if state not in ("pending", "done", "error"):
            raise ValueError(f"unknown state: {state}")
        noted = chunk.select("dialog_id", "msg_id").withColumns({"batch_id": F.lit(batch_id), "state": F.lit(state), "attempted_at": F.lit(at).cast("long"), "error": F.lit(error).cast("string")})
        self.replace("deletions", noted)
