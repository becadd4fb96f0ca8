"""A search index that is built beside the live one: layers of Parquet, and numbered lists of the layers that readers see.

A build writes one new layer and then a list that names only it; updates and deletions write a small layer and a list that
ends with it. A list appears by a rename that fails where its number is taken, so that readers see the old index or the
new one and never a part, a build that fails leaves the old one, and of two writers one is refused. Layers are never
changed: a DataFrame that was read before goes on seeing what it saw.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layers that a reader merges at most; one more update writes them as one.
MOST_LAYERS = 8


class IndexConflict(RuntimeError):
    """Another writer was faster."""


class SearchIndex:
    """Rows (id, content_hash, embedding, any fields) under a shared folder; embed: rows (id, ...) to rows with a column embedding."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.embed = spark, folder, embed

    def _names(self) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lists")
        system = place.getFileSystem(conf)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def current(self) -> tuple[int, list[str]]:
        """The number of the newest list and its layers, the oldest first."""
        numbers = [int(n) for n in self._names() if n.isdigit()]
        if not numbers:
            return 0, []
        rows = self.spark.read.text(f"{self.folder}/lists/{max(numbers):012d}").collect()  # MOST_LAYERS lines at most
        return max(numbers), [layer for _, layer in sorted(r["value"].split(" ", 1) for r in rows)]

    def _publish(self, number: int, layers: list[str]) -> None:
        lines = self.spark.createDataFrame([(f"{i:04d} {layer}",) for i, layer in enumerate(layers)], "value string").coalesce(1)
        fresh, to = f"{self.folder}/new/{uuid.uuid4().hex}", f"{self.folder}/lists/{number:012d}"
        lines.write.text(fresh)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files, path = jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf), jvm.org.apache.hadoop.fs.Path
        path(to).getFileSystem(conf).mkdirs(path(f"{self.folder}/lists"))
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(path(path(fresh).getFileSystem(conf).makeQualified(path(fresh)).toString()), path(path(to).getFileSystem(conf).makeQualified(path(to)).toString()), kinds)
        except Exception as e:
            if int(number) in [int(n) for n in self._names() if n.isdigit()]:
                raise IndexConflict(f"list {number} is there already") from e
            raise

    def _layer(self, rows: DataFrame) -> str:
        path = f"{self.folder}/layers/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _merged(self, layers: list[str]) -> DataFrame:
        """The newest row of each id of several layers, deletions included."""
        parts = [self.spark.read.parquet(layer).withColumn("_layer", F.lit(i)) for i, layer in enumerate(layers)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in ("id", "_layer")]
        if len(layers) == 1:  # ids are unique in a layer
            return rows.drop("_layer")
        return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "_layer").alias("row")).select("id", "row.*")

    def read(self) -> DataFrame | None:
        """The live rows as they are now; None before the first build."""
        _, layers = self.current()
        return self._merged(layers).where("not deleted").drop("deleted") if layers else None

    def _extended(self, number: int, layers: list[str], layer: str) -> None:
        layers = [*layers, layer]
        if len(layers) > MOST_LAYERS:
            layers = [self._layer(self._merged(layers).where("not deleted"))]
        self._publish(number + 1, layers)

    def build(self, rows: DataFrame) -> None:
        """Every row embedded anew beside the live index, which it then replaces; ids that come twice stop it."""
        number, _ = self.current()
        layer = self._layer(self.embed(rows).withColumn("deleted", F.lit(False)))
        written = self.spark.read.parquet(layer)
        twice = written.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
        if not twice.isEmpty() or written.count() != rows.count():
            raise ValueError("the build doesn't hold every row once; the live index stays")
        self._publish(number + 1, [layer])

    def update(self, rows: DataFrame) -> None:
        """Rows whose content changed, or that the index doesn't hold, are embedded; of others only the fields change."""
        number, layers = self.current()
        held = self._merged(layers).where("not deleted").select("id", F.col("content_hash").alias("_held"), F.col("embedding").alias("_embedding"))
        asked = rows.join(held, "id", "left")
        same = F.col("_held").eqNullSafe(F.col("content_hash")) & F.col("_embedding").isNotNull()
        partial = asked.where(same).withColumn("embedding", F.col("_embedding")).drop("_held", "_embedding")
        full = self.embed(asked.where(~same).drop("_held", "_embedding"))
        self._extended(number, layers, self._layer(full.unionByName(partial).withColumn("deleted", F.lit(False))))

    def delete(self, ids: DataFrame) -> None:
        """Ids (id) that go; those that aren't there change nothing."""
        number, layers = self.current()
        gone = ids.select("id").distinct().withColumn("deleted", F.lit(True))
        self._extended(number, layers, self._layer(gone))
