"""M1: continuous price refresh -- a stream of captured prices upserted into the
price catalogue, one micro-batch at a time.

The catalogue is plain parquet files, clustered by key: each generation (the first load, then one
folder a batch) is range-partitioned and sorted on the key. A micro-batch reads the catalogue's key
columns with ``_metadata.file_path`` to find the files that hold its keys, rewrites the rows of
those files together with its own into a new generation, and removes the files it
replaced; all other files stay as they are. Keys that no file holds are in the new
generation too. Work per batch follows the files it touches and the
key columns; "latest wins" is decided by the observation order carried in the table (time, then the feed's
tie-break columns), so the result does not depend on the order in which files arrive.

A batch that is spread over the catalogue (of more rows than a file has, or in more than a quarter of the files)
rewrites nothing: it is put beside the others as it came, and readers take the latest row of each key. So
does every batch after it, until there are as many rows beside as in the clustered files: then all
are settled into one new clustered generation. What is written in all follows what has arrived, however many
batches it came in.

A batch is applied once, whatever fails: its generation is staged, the list of the
files it replaces is written, then the folder is renamed into place (from here on
readers leave the listed files out), then they are removed. A replayed batch whose generation is
in place only finishes the removal; one whose generation is not starts anew, as nothing was removed
yet. There is one writer, the stream.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import stored

ROWS_PER_FILE = 100_000
FEW_FILES = 4  # as many may always be rewritten


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Per key, the row with the greatest ``order``. One struct, not a pair of them, is carried by a row."""
    best = F.max(F.struct(*dict.fromkeys([*order, *rest]))).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_r")[c].alias(c) for c in dict.fromkeys([*rest, *order])])


class Catalogue:
    """Key-clustered parquet files under ``root``, a URI or path that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.root, self.keys, self.rows = spark, root.rstrip("/"), list(keys), rows_per_file
        self.fs, self.path = pafs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def _names(self, folder: str) -> list[str]:
        """Files below a folder of the catalogue, relative to it."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/{folder}".rstrip("/"), recursive=True, allow_not_found=True))
        return [x.path[len(self.path) + 1:] for x in found if x.is_file]

    def _replaced(self, generation: str) -> list[str] | None:
        """The files that a generation replaces, as listed before it was put in place; None without a list."""
        name = f"{self.path}/_replaced/{generation}"
        if self.fs.get_file_info(name).type == pafs.FileType.NotFound:
            return None
        return self._json(f"_replaced/{generation}")

    def files(self) -> list[str]:
        """The data files that count, relative to the root."""
        names = [n for n in self._names("") if n.startswith("gen-") and n.endswith(".parquet")]
        there = {n.split("/")[0] for n in names}
        gone = {x for n in self._names("_replaced") if n.split("/")[1] in there for x in self._replaced(n.split("/")[1])}
        return [n for n in names if n not in gone]

    def _json(self, name: str):
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def _note(self, folder: str, generation: str, what) -> None:
        self.fs.create_dir(f"{self.path}/{folder}", recursive=True)
        with self.fs.open_output_stream(f"{self.path}/{folder}/{generation}") as f:
            f.write(json.dumps(what).encode())

    def beside(self, live: Sequence[str]) -> dict[str, dict]:
        """The generations among these files that lie beside the clustered ones: their order, schema and rows."""
        there = {n.split("/")[0] for n in live}
        return {g: self._json(f"_beside/{g}") for g in (n.split("/")[1] for n in self._names("_beside")) if g in there}

    def read(self, schema, names: Sequence[str] | None = None) -> DataFrame:
        """The catalogue's rows, one a key; with ``names`` the rows of these files as they are."""
        live = self.files() if names is None else list(names)
        beside = self.beside(live) if names is None else {}
        if beside:
            fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
            return self._settled(live, beside).select(*[F.col(f.name).cast(f.dataType) for f in fields])
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.root}/{n}" for n in live]) if live else self.spark.createDataFrame([], schema)

    def _settled(self, live: Sequence[str], beside: dict[str, dict]) -> DataFrame:
        note = next(iter(beside.values()))
        schema = T.StructType.fromJson(note["schema"])
        return newest(self.read(schema, live), self.keys, note["order"], [c for c in schema.names if c not in self.keys])

    def _write(self, rows: DataFrame, generation: str, n: int) -> None:
        """Stage a generation of ``n`` rows and put it in place."""
        staged = f"{self.path}/_staged/{generation}"
        (rows.repartitionByRange(max(1, -(-n // self.rows)), *self.keys).sortWithinPartitions(*self.keys)
         .write.mode("overwrite").parquet(f"{self.root}/_staged/{generation}"))
        self.fs.move(staged, f"{self.path}/{generation}")

    def load(self, rows: DataFrame, n: int | None = None) -> None:
        """The first load of an empty catalogue; ``n``, if known, is about how many rows there are."""
        if n is None:
            rows = stored(rows, "catalogue-load")
            n = rows.count()
        self._write(rows, "gen-load", n)

    def upsert(self, batch: DataFrame, batch_id: int, order: Sequence[str], cols: Sequence[str]) -> list[str]:
        """Apply a batch (once for each ``batch_id``); returns the files that it replaced."""
        generation = f"gen-{batch_id}"
        if self.fs.get_file_info(f"{self.path}/{generation}").type == pafs.FileType.NotFound:
            rest = list(dict.fromkeys([*cols, *order]))
            batch.select(*self.keys, *rest).write.mode("overwrite").parquet(f"{self.root}/_staged/{generation}")
            came = self.spark.read.schema(batch.select(*self.keys, *rest).schema).parquet(f"{self.root}/_staged/{generation}")
            n, live = came.count(), self.files()
            spread, touched, new = bool(live) and (n > self.rows or bool(self.beside(live))), [], None
            if not spread:
                new = stored(newest(came, self.keys, order, rest), "catalogue-batch")
                by_name = {x.rsplit("/", 1)[1]: x for x in live}  # Spark's file names are unique
                held = self.read(new.schema, live).select(*self.keys, F.col("_metadata.file_name").alias("file")) if live else None
                # one row for each touched file reaches the driver
                touched = [by_name[r["file"]] for r in held.join(new.select(*self.keys), self.keys, "left_semi").select("file").distinct().collect()] if live else []
                spread = len(touched) > max(FEW_FILES, len(live) // 4)
            if spread:
                self._note("_beside", generation, {"order": list(order), "schema": came.schema.jsonValue(), "rows": n})
                self.fs.move(f"{self.path}/_staged/{generation}", f"{self.path}/{generation}")
            else:
                rows = stored(newest(self.read(new.schema, touched).unionByName(new), self.keys, order, rest), "catalogue-rows")
                self._note("_replaced", generation, sorted(touched))
                self._write(rows, generation, rows.count())
        return self._finish(generation) + self._settle(f"{generation}-settled")

    def _settle(self, generation: str) -> list[str]:
        """Once there are as many rows beside the clustered files as in them, one clustered generation of all."""
        live = self.files()
        beside = self.beside(live)
        if beside:
            more = sum(x["rows"] for x in beside.values())
            n = self.rows * sum(x.split("/")[0] not in beside for x in live)  # about that many are clustered
            if more < n:
                return []
            self._note("_replaced", generation, sorted(live))
            self._write(self._settled(live, beside), generation, more + n)
        return self._finish(generation)

    def _finish(self, generation: str) -> list[str]:
        gone = self._replaced(generation) or []
        for name in gone:
            if self.fs.get_file_info(f"{self.path}/{name}").type != pafs.FileType.NotFound:
                self.fs.delete_file(f"{self.path}/{name}")
        return gone


def refresh_stream(stream: DataFrame, catalogue: Catalogue, checkpoint: str, cols=("price", "url", "last_updated"), order=("last_updated",)) -> None:
    """Upsert all that ``stream`` has now, batch by batch."""
    q = (stream.writeStream.foreachBatch(lambda batch, batch_id: catalogue.upsert(batch, batch_id, order, cols) and None)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def staging_path(spark: SparkSession, name: str) -> str:
    from ..session import scratch_path
    return scratch_path(spark, f"stream-{name}")
