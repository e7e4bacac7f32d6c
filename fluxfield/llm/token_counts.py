"""Token counts: additive rollups by source, language and tokenizer version, kept by signed deltas.

The store keeps totals: one table of signed sums per group for its latest version. A batch of changes inserts documents
(+), deletes them (-), or revises their counts (- old, + new); it is summed to its groups' deltas, which are added to
the totals, and the new totals are written as the next version. Readers and writers start at the last settled version:
a file's name tells it, and it moves on whenever SPAN later ones are there. So they read at most some SPAN files of the
log and one table of totals, however many batches there were, and older versions can be vacuumed.

Commits are idempotent and take turns. A version is a file of the log, named by its number, that names the batch and
the folder of its totals; it is created only if no such file is there, so of two writers one gets the number and the
other adds its deltas to the winner's totals and tries the next. A batch id that was committed is ignored: it is among
the unsettled versions, or has a file of its own, which it gets before its version is settled. A folder that no log file
names (of a failed or late commit) is never read. A batch that would leave fewer than no documents, tokens or characters
in a group is refused: it deletes what was never inserted.

Each batch's documents are read once and only their counts are shuffled, after partial sums, so a source that holds a
third of all rows costs no more than others. Null texts count no tokens but one document; null sources, languages and
versions are groups of their own. Repeated rows count as often as they occur. Empty batches commit and change nothing;
groups whose documents are all gone are dropped; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .secret_scan import load_encoding

GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
#: Versions that are read one by one before the starting point moves on.
SPAN = 32
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"


def _counts(files: dict[str, str], pattern: str) -> Callable:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = [load_encoding(file, pattern) for file in files.values()]
        for batch in batches:
            found = []
            for k, encoding in enumerate(encodings):
                wanted = batch.column(1 + k)
                n = (len(encoding.encode_ordinary(t.as_py() or "")) if w.as_py() else None for t, w in zip(batch.column(0), wanted))
                found.append(pa.array(n, pa.int64()))
            first = 1 + len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], *found], [*batch.schema.names[first:], *files])

    return counts


def with_tokens(docs: DataFrame, ranks_file: str, pattern: str, keep: list[str], text_col: str = "text", name: str = "n_tokens", other: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """The kept columns and the tokens by a tiktoken vocabulary as `name`; texts do not leave the task that reads them.

    other: further counts in the same pass, as name: (vocabulary, which rows have it); null in all other rows."""
    counts = {name: (ranks_file, F.lit(True))} | (other or {})
    rows = docs.select(F.col(text_col).alias("_"), *[where.alias(f"_{k}") for k, (_, where) in enumerate(counts.values())], *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1 + len(counts) :]]
    return rows.mapInArrow(_counts({k: file for k, (file, _) in counts.items()}, pattern), ", ".join([*fields, *[f"`{k}` bigint" for k in counts]]))


def delta(counted: DataFrame, sign: Column | int, tokenizer: str) -> DataFrame:
    """Signed sums by group of rows (source, lang, n_chars, n_tokens)."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    rows = counted.withColumn("tokenizer", F.lit(tokenizer)).withColumn("_sign", sign.cast("long"))
    return rows.groupBy(*GROUP).agg(
        F.sum("_sign").alias("n_docs"), F.sum(F.col("_sign") * F.col("n_tokens")).alias("n_tokens"), F.sum(F.col("_sign") * F.coalesce("n_chars", F.lit(0))).alias("n_chars")
    )


class Rollup:
    """A store of totals and of the log of committed batches, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[int]:
        """The numbers that files of a folder are named by, in order."""
        path, system = self._path(f"{folder}/[0-9]*")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in system.globStatus(path) or [])

    def _read(self, version: int) -> Row | None:
        """What the log says of a version, if there is one."""
        path, system = self._path(f"log/{version:012d}.json")
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return Row(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def tail(self) -> list[Row]:
        """The last settled version and all after it, in order: version, batch_id, totals (a folder's name)."""
        rows, version = [], max([1, *self._names("settled")])
        while row := self._read(version):
            rows.append(row)
            version += 1
        return rows

    def _batch(self, batch_id: str):
        """The file that a batch of a settled version has."""
        name = hashlib.sha256(batch_id.encode()).hexdigest()
        return self._path(f"batches/{name[:3]}/{name}")

    def committed(self, batch_id: str, tail: list[Row] | None = None) -> bool:
        """Whether a batch is in the totals. The tail is read first, as batches go from it to files and never back."""
        if batch_id in {r["batch_id"] for r in (self.tail() if tail is None else tail)}:
            return True
        path, system = self._batch(batch_id)
        return system.exists(path)

    def _settle(self, tail: list[Row]) -> None:
        """Move the point that readers start at to the end of the tail, once all its batches have files."""
        for r in tail:
            path, system = self._batch(r["batch_id"])
            system.create(path, True).close()
        before = self._names("settled")
        path, system = self._path(f"settled/{tail[-1]['version']:012d}")
        system.create(path, True).close()
        for version in before:
            if version < tail[-1]["version"]:
                system.delete(self._path(f"settled/{version:012d}")[0], False)

    def log(self) -> list[Row]:
        """Versions whose log files are there, in order; for inspection, as it reads all of them."""
        return [row for version in self._names("log") if (row := self._read(version))]

    def batches(self) -> set[str]:
        """Ids of the batches that the log has; those of vacuumed versions are only known to committed()."""
        return {r["batch_id"] for r in self.log()}

    def _claim(self, version: int, batch_id: str, totals: str) -> bool:
        """Make the log file of a version; false if another writer has."""
        path, system = self._path(f"log/{version:012d}.json")
        if system.exists(path):
            return False
        entry = json.dumps({"version": version, "batch_id": batch_id, "totals": totals})
        draft, _ = self._path(f"log/.{totals}")
        out = system.create(draft, True)
        out.write(bytearray(entry.encode()))
        out.close()
        # Readers never see half a file; of two renames to one name a file system like HDFS lets one through.
        return system.rename(draft, path)

    def _totals(self, log: list[Row]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{log[-1]['totals']}")

    def commit(self, batch_id: str, *deltas: DataFrame) -> bool:
        """Add a batch of deltas to the totals; false, and no change, if it has been added before."""
        if self.committed(batch_id):
            return False
        rows = deltas[0].select(*GROUP, *MEASURES)
        for d in deltas[1:]:
            rows = rows.unionByName(d.select(*GROUP, *MEASURES))
        batch = stored(rows.groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES]), "delta")
        while True:
            log = self.tail()
            if self.committed(batch_id, log):
                return False
            if len(log) > SPAN:
                self._settle(log)
            name, seen = f"totals-{uuid.uuid4().hex}", Observation()
            sums = self._totals(log).unionByName(batch).groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES])
            sums = sums.where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")
            sums.observe(seen, F.min(F.least(*MEASURES)).alias("least")).write.parquet(f"{self.folder}/{name}")
            if (seen.get["least"] or 0) < 0:
                raise ValueError(f"batch {batch_id} deletes what was never inserted")
            if self._claim(log[-1]["version"] + 1 if log else 1, batch_id, name):
                return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches."""
        return self._totals(self.tail())

    def vacuum(self) -> None:
        """Delete totals of all but the latest version, and log files before the last settled one. Writers and readers
        must be done with them."""
        settled = max([0, *self._names("settled")])
        for version in self._names("log")[:-1]:
            path, system = self._path(self._read(version)["totals"])
            system.delete(path, True)
            if version < settled:
                system.delete(self._path(f"log/{version:012d}.json")[0], False)
