"""Published generations: Parquet tables under gen=<id>, a pointer file that is swapped last, one writer."""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

VERSIONS = {"schema": 1, "parser": 1, "chunker": 1, "ranker": 1}


class Store:
    """A folder on a file system that the driver can rename in. Readers open what the pointer names and stay with it."""

    def __init__(self, root: str):
        self.root = Path(root)

    @contextmanager
    def writing(self):
        """The one writer's lock."""
        self.root.mkdir(parents=True, exist_ok=True)
        lock = self.root / "writer.lock"
        try:
            fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise RuntimeError(f"{lock} is held by another writer") from None
        try:
            os.write(fd, str(os.getpid()).encode())
            yield self
        finally:
            os.close(fd)
            lock.unlink()

    def pointer(self) -> dict | None:
        try:
            return json.loads((self.root / "current.json").read_text())
        except FileNotFoundError:
            return None

    def publish(self, tables: dict[str, DataFrame], **facts) -> str:
        """Write a generation, then swap the pointer: a reader sees the old one or the new one, whole."""
        gen = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(str(self.root / f"gen={gen}" / name))
        old = self.pointer()
        new = {"generation": gen, "previous": old and old["generation"], "tables": sorted(tables), "versions": VERSIONS, **facts}
        tmp = self.root / f"current.{uuid.uuid4().hex}"
        tmp.write_text(json.dumps(new))
        os.replace(tmp, self.root / "current.json")
        return gen

    def open(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The current generation's tables, read lazily; an error names what is missing."""
        at = self.pointer()
        if at is None:
            raise FileNotFoundError(f"no index in {self.root}")
        if at["versions"] != VERSIONS:
            raise ValueError(f"index versions {at['versions']} are not {VERSIONS}: index again")
        return {t: spark.read.parquet(str(self.root / f"gen={at['generation']}" / t)) for t in at["tables"]}

    def retain(self, leased: tuple[str, ...] = ()) -> list[str]:
        """Remove generations but the current, the previous and leased ones."""
        import shutil

        at = self.pointer() or {}
        keep = {at.get("generation"), at.get("previous"), *leased}
        gone = [p for p in self.root.glob("gen=*") if p.name[4:] not in keep]
        for p in gone:
            shutil.rmtree(p)
        return [p.name[4:] for p in gone]

    def status(self, spark: SparkSession) -> dict:
        t = self.open(spark)
        return {**self.pointer(), "rows": {n: df.count() for n, df in t.items()}}

    def compact(self, spark: SparkSession, files: int = 1) -> str:
        """The same rows in fewer files, as a new generation."""
        return self.publish({n: df.coalesce(files) for n, df in self.open(spark).items()}, compacted=True)
