"""Versioned tables: publishing, reconciling, comparing and collecting garbage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, change): added, removed or edited rows between two tables with one row per key."""
    a, b = old.select(*keys, F.col(content).alias("_a"), F.lit(1).alias("_in")), new.select(*keys, F.col(content).alias("_b"), F.lit(1).alias("_on"))
    both = a.join(b, keys, "full")
    kind = F.when(F.col("_in").isNull(), "added").when(F.col("_on").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "edited")
    return both.select(*keys, kind.alias("change")).where("change IS NOT NULL")


def reconcile_ids(old: DataFrame, identities: DataFrame, identity: str, id_col: str) -> DataFrame:
    """(identity, id): an identity keeps its id, new ones get the next, vanished ones go.

    New ids follow the largest old one in the order of the identity. Repeated identities count once.
    """
    now = identities.select(identity).where(F.col(identity).isNotNull()).distinct()
    kept = now.join(old.select(identity, id_col).groupBy(identity).agg(F.min(id_col).alias(id_col)), identity)
    fresh = now.join(old.select(identity).distinct(), identity, "left_anti")
    top = old.agg(F.max(id_col)).first()[0] or 0
    # spread by hash: ranked within each part and offset by the parts before it
    parts = fresh.withColumn("part", F.substring(F.sha2(identity, 256), 1, 2))
    n = parts.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    n = n.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(identity))
    made = parts.withColumn("r", local).join(F.broadcast(n), "part")  # 256 rows
    return kept.unionByName(made.select(identity, (F.lit(top) + F.col("base") + F.col("r")).cast(old.schema[id_col].dataType).alias(id_col)))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, digest): a digest of the rows in canonical order; repeats count, nulls differ from all texts.

    Rows are hashed, the hashes sorted within 65,536 ranges by their first four digits, and the digests
    of the ranges hashed in order, so no task holds more than a range.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    rows = df.select(F.sha2(F.concat_ws("\x1f", *text), 256).alias("h"))
    part = rows.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x.b, x.d)), "")
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(whole, 256).alias("digest"))


class SnapshotStore:
    """Tables under ``root``: every version is a folder, every generation a file that names the versions.

    A generation's file is created only if it is not there yet, which is atomic on shared file systems, so
    of two writers of one generation the second fails, and readers always find the largest whole one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _generations(self) -> list[int]:
        folder = self._path("generations")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[4:-5]) for n in names if n.startswith("gen-") and n.endswith(".json"))

    def current(self) -> dict:
        """{generation, tables: name -> version, notes}; generation 0 where nothing is published."""
        found = self._generations()
        if not found:
            return {"generation": 0, "tables": {}, "notes": {}}
        stream = self._fs.open(self._path(f"generations/gen-{found[-1]:09d}.json"))
        try:
            raw = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def has(self, table: str) -> bool:
        return table in self.current()["tables"]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()['tables'][table]}")

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None, notes: dict | None = None) -> int:
        """Write the tables as the next generation; others keep their version.

        ``expected`` refuses the change if another generation has been published before or meanwhile.
        Tables that lose the race are deleted again.
        """
        now = self.current()
        if expected is not None and now["generation"] != expected:
            raise RuntimeError(f"generation is {now['generation']}, not {expected}")
        made = dict(now["tables"])
        written = []
        for name, df in tables.items():
            made[name] = f"{name}/v{now['generation'] + 1}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.root}/{made[name]}")
            written.append(made[name])
        new = {"generation": now["generation"] + 1, "tables": made, "notes": {**now.get("notes", {}), **(notes or {})}}
        try:
            out = self._fs.create(self._path(f"generations/gen-{new['generation']:09d}.json"), False)
        except Exception as e:
            for name in written:
                self._fs.delete(self._path(name), True)
            raise RuntimeError("another generation was published meanwhile") from e
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        return new["generation"]

    def prune(self, keep: int = 1) -> list[str]:
        """Delete the versions that none of the newest ``keep`` generations names; returns their names."""
        found = self._generations()[-keep:]
        live: set[str] = set()
        for n in found:
            live |= set(json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/generations/gen-{n:09d}.json").collect()))["tables"].values())
        gone = []
        for table in {v.split("/")[0] for v in live}:
            for f in self._fs.listStatus(self._path(table)):
                name = f"{table}/{f.getPath().getName()}"
                if name not in live:
                    self._fs.delete(f.getPath(), True)
                    gone.append(name)
        return sorted(gone)
