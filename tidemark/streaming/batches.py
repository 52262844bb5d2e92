"""Tables that a stream writes batch by batch, each batch whole or not at all, and only once.

A batch is written to a hidden folder and moved to its place by renaming, so the file system must
rename folders in one step. A batch that is run again finds its folder and leaves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STAGING = "_staging"


class Folder:
    """A folder of any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str) -> Folder:
        return Folder(self._spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._files.exists(self._at)

    def names(self) -> list[str]:
        """Subfolders that readers see."""
        if not self.exists():
            return []
        found = [s.getPath().getName() for s in self._files.listStatus(self._at) if s.isDirectory()]
        return sorted(n for n in found if n[0] not in "_.")

    def move_to(self, target: Folder) -> None:
        self._files.mkdirs(target._at.getParent())
        if not self._files.rename(self._at, target._at):
            raise OSError(f"could not rename {self.path} to {target.path}")

    def remove(self) -> None:
        self._files.delete(self._at, True)


def publish(frame: DataFrame, path: str, batch_id: int, *, by: tuple[str, ...] = ()) -> bool:
    """Write ``frame`` as batch ``batch_id`` of the table at ``path``; False if it was there."""
    table = Folder(frame.sparkSession, path)
    target = table.child(f"batch_id={batch_id}")
    if target.exists():
        return False
    staged = table.child(f"{_STAGING}/{batch_id}")
    frame.write.mode("overwrite").partitionBy(*by).parquet(staged.path)
    staged.move_to(target)
    return True
