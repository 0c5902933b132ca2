"""Shared helpers: durable intermediate tables, text access, 64-bit mixing."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir

#: The ASCII white space of the word contracts: space and \x09-\x0D. bytes.split() splits at exactly these.
WHITE = b" \t\n\x0b\x0c\r"
_U64 = np.uint64


#: The scopes that are open in this thread; each holds the paths of the tables written in it.
_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("scopes", default=())


class Scratch:
    """The tables of a job. When its scope closes, all but the kept ones are deleted; these pass to the scope around it."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Let a table of this scope outlive it."""
        self.kept.add(df.scratch_path)
        return df

    def close(self, around: Scratch | None = None) -> None:
        for path, spark in self.paths.items():
            if around is not None and path in self.kept:
                around.paths[path] = spark
            else:
                _delete(spark, path)
        self.paths = {}


#: Tables that no open scope holds: results that may still be read. They go when the driver ends.
_rest = Scratch()


@atexit.register
def release() -> None:
    """Delete the tables that results of this process still read, once none of these is to run any more."""
    with contextlib.suppress(Exception):  # a session that has ended can't delete any more
        _rest.close()


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """A scope for intermediate tables; scopes of other threads don't see them."""
    own, outer = Scratch(), _scopes.get()
    token = _scopes.set((*outer, own))
    try:
        yield own
    finally:
        _scopes.reset(token)
        own.close(outer[-1] if outer else _rest)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: the lineage ends at a table that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    (scopes[-1] if scopes else _rest).paths[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing lazy reads it any more."""
    _delete(df.sparkSession, df.scratch_path)
    for scope in (*_scopes.get(), _rest):
        scope.paths.pop(df.scratch_path, None)


def named(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def text_hash(text: Column) -> Column:
    """With a document's id it tells rows apart; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 62) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
    """Batches sorted by their first column -> (parts, False): rows of whole runs of equal keys, or (parts, True): a piece of one run of more than `most` rows."""
    held: list[pa.RecordBatch] = []  # the last run, which may go on
    rows, at, cut = 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if cut:
            end = int(np.searchsorted(keys, at, "right")) if keys[0] == at else 0
            if end:
                held.append(batch.slice(0, end))
                rows += end
            if end < len(keys) or rows > most:
                if held:
                    yield held, True
                held, rows = [], 0
            if end == len(keys):
                continue
            cut, batch, keys = False, batch.slice(end), keys[end:]
        last = int(np.searchsorted(keys, keys[-1]))
        if last or keys[0] != at:
            whole = [*held, batch.slice(0, last)] if last else held
            if whole:
                yield whole, False
            held, rows = [], 0
        held.append(batch.slice(last))
        rows += len(keys) - last
        at = keys[-1]
        if rows > most:
            yield held, True
            held, rows, cut = [], 0, True
    if held:
        yield held, cut


def text_bytes(df: DataFrame, text: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null is the empty text."""
    return F.coalesce(named(df, text), F.lit("")).cast("binary")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (splitmix64's finaliser)."""
    x = np.asarray(x, dtype=_U64).copy()
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
