"""What the operators share: the shared folder, stored tables, slices of Arrow batches, piece memos."""

from __future__ import annotations

import ctypes
import gc
import string
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnline.session import shared_folder

#: Bytes of text that a worker handles at a time, whatever the size of the Arrow batch.
SLICE_BYTES = 8 << 20

_shipped: set[str] = set()

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  another C library may have none
except (OSError, AttributeError):
    _libc = None


#: Rows of an Arrow batch, where the session leaves it at Spark's 10,000: documents are long, and a batch is held by
#: the JVM and by the worker at once.
BATCH_ROWS = 2000
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let executors import this package, as ``--py-files`` would, once per application; and set the size of Arrow batches."""
    if spark.conf.get(ROWS_SETTING) == "10000":
        spark.conf.set(ROWS_SETTING, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(spark.sparkContext._temp_dir) / "turnline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{folder}/turnline-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: its lineage ends there."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Remove the files of stored frames that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        files = frame.inputFiles()
        if not files:
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/turnline-llm/" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    It does so once the driver has collected its garbage, and a driver with little to do collects too rarely for that.
    What the first collection frees still refers to the shuffles; the second one finds them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no taken column is called so (Spark ignores case)."""
    held, out = {name.lower() for name in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def as_bytes(name: str) -> F.Column:
    """The whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def release() -> None:
    """Give memory that Arrow and the C library hold for later back to the machine: an executor's workers share it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
            release()


def numbered_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space, A-Z lower-cased if wanted; the number of each word in turn; and
    where each text begins in them (and the last one ends).  ``texts`` is a binary array without nulls."""
    plain = texts.view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    coded = split.flatten().dictionary_encode()
    number, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    distinct = coded.dictionary.cast(pa.binary())
    blank = pc.index(distinct, pa.scalar(b"", pa.binary())).as_py()
    if blank >= 0:  # white space at either end
        kept = number != blank
        number, bounds = number[kept], np.r_[0, np.cumsum(kept)][bounds]
    return distinct, number, bounds


def words_of(texts: pa.Array, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``numbered_words`` with the distinct words as a list."""
    distinct, number, bounds = numbered_words(texts, lower)
    return distinct.to_pylist(), number, bounds


#: Which bytes are ASCII letters or digits; and which follow 0xC3 in a letter of Latin-1 (U+00C0 to U+00FF but two signs).
ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
LATIN = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])


def heads_and_tails(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct parts of binary pieces (UTF-8, no nulls), and each piece's head and tail as numbers of parts.

    The tail is the run of ASCII punctuation that ends a piece, if an ASCII or Latin-1 letter or an ASCII digit stands
    before it; else it is empty.  A tokenizer that parts letters and digits from punctuation gives for a piece what it
    gives for its head and for its tail.
    """
    plain = pieces.cast(pa.string())
    trimmed = pc.binary_length(pc.ascii_rtrim(plain, string.punctuation)).to_numpy(zero_copy_only=False)
    if not len(pieces) or not plain.buffers()[2]:
        none = np.zeros(len(pieces), np.int32)
        return pa.array([b""], pa.binary()), none, none
    offsets = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset:][: len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2], np.uint8)
    cut = offsets[:-1] + trimmed
    last, before = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
    parted = (trimmed > 0) & ALNUM[last] | (trimmed > 1) & (before == 0xC3) & LATIN[last]
    bounds = np.empty(2 * len(plain) + 1, np.int32)
    bounds[0::2], bounds[1::2] = offsets, np.where(parted, cut, offsets[1:])
    coded = pa.Array.from_buffers(pa.binary(), 2 * len(plain), [None, pa.py_buffer(bounds), plain.buffers()[2]]).dictionary_encode()
    number = coded.indices.to_numpy()
    return coded.dictionary, number[0::2], number[1::2]


def hashed(words: list[bytes], hash_function: Callable[[bytes], int]) -> np.ndarray:
    return np.fromiter(map(hash_function, words), np.uint64, len(words))


def out_schema(frame: DataFrame, kept: list[str], added: list[tuple[str, T.DataType]]) -> T.StructType:
    """The kept columns as they are, then the added ones."""
    fields = [T.StructField(f.name, f.dataType, True) for f in frame.schema.fields if f.name in kept]
    return T.StructType(sorted(fields, key=lambda f: kept.index(f.name)) + [T.StructField(n, t, True) for n, t in added])


def arrow_map(
    frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str, remembers: bool = False,
) -> DataFrame:
    """``mapInArrow``; a function that does not use ``per_worker`` frees what an earlier one has left in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        try:
            yield from function(batches)
        finally:
            release()

    return frame.mapInArrow(run, schema)


class Memo:
    """Values of text pieces, worked out once per worker while there is room.

    ``make`` gets a list of new pieces and returns their values in order.  Two
    generations of ``limit`` pieces or ``limit_bytes`` each are held: a full one
    replaces the old one, and what is still in use moves to the new one.  Results
    never depend on what is remembered.
    """

    def __init__(self, make: Callable[[list], list], limit: int = 300_000, limit_bytes: int = 16 << 20):
        self.make, self.limit, self.limit_bytes = make, limit, limit_bytes
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def look(self, pieces: list) -> list:
        """The values of distinct pieces, in order; no value is None."""
        values = list(map(self.young.get, pieces))
        missing = [i for i, v in enumerate(values) if v is None]
        if not missing:
            return values
        keys = [pieces[i] for i in missing]
        size = sum(len(k[0]) if type(k) is tuple else len(k) for k in keys)
        if self.young and (len(self.young) + len(keys) > self.limit or self.held + size > self.limit_bytes):
            self.old, self.young, self.held = self.young, {}, 0
        found = list(map(self.old.get, keys))
        made = iter(self.make([k for k, v in zip(keys, found) if v is None]))
        found = [next(made) if v is None else v for v in found]
        self.young.update(zip(keys, found))
        self.held += size
        for i, v in zip(missing, found):
            values[i] = v
        return values


_worker: dict = {}


def forget() -> None:
    """Drop what this worker remembers, and its memory at once: a coder and its memo refer to each other."""
    if _worker:
        _worker.clear()
        gc.collect()
        release()


def per_worker(key, build: Callable[[], object]):
    """One object per worker process, such as a loaded tokenizer with its memo; only the last is kept."""
    if key not in _worker:
        forget()
        _worker[key] = build()
    return _worker[key]
