"""Raw on-time CSV extracts: one header contract, typed by column name."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnline.operators.rotation import computed_once
from turnline.schema import FLIGHT_COLUMNS, FLIGHT_NAMES, MONTH_COLUMNS, SOURCE_NAMES
from turnline.sources.tables import months_of, read_table, with_month, write_by_month


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The column names in the first line of a file, compressed or not."""
    jvm = spark.sparkContext._jvm
    conf, file = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return tuple(next(csv.reader([(reader.readLine() or "").removeprefix("\ufeff")]), []))
    finally:
        reader.close()


def _by_header(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """The files as text columns, those of one header together; only first lines are read here."""
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda path: _header(spark, path), paths))
    found = []
    for header in sorted(set(headers)):
        own = [path for path, names in zip(paths, headers) if names == header]
        missing = [name for name in SOURCE_NAMES if name not in header]
        if missing:
            raise ValueError(f"columns missing from {own[0]}: {', '.join(missing)}")
        found.append(spark.read.option("header", True).option("enforceSchema", False).csv(own))
    return found


def _together(frames: list[DataFrame]) -> DataFrame:
    whole, *rest = frames
    for frame in rest:
        whole = whole.unionByName(frame)
    return whole


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The contract's columns as text; ``path`` may be a glob over monthly files.

    Columns are found by name in the header of each file, so their order is free, from file to file too, and extra
    columns are left out.  A file without one of the columns fails the job, and is never read by position.
    """
    paths = [row.path for row in spark.read.format("binaryFile").load(path).select("path").collect()]  # file names only
    if not paths:
        raise ValueError(f"no files in {path}")
    return _together([raw.select(*SOURCE_NAMES) for raw in _by_header(spark, paths)])


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _checked(name: str, text: Column, number: Column) -> Column:
    bad = text.isNotNull() & (number.isNull() | (number != F.rint(number)))
    message = F.concat(F.lit(f"{name} holds no whole number: "), text)
    return F.when(bad, F.raise_error(message)).otherwise(number).cast("int")


def whole_number(name: str) -> Column:
    """Text such as ``23.0`` as an integer; a fraction or other text fails the job."""
    text = _text(name)
    return _checked(name, text, text.try_cast("double"))


def flag(name: str) -> Column:
    """``1.0`` as true, other numbers as false, nothing as null."""
    return whole_number(name) == 1


# Columns checked in one step: the checks of all of them are too long a method for the JVM to compile.
STEP_COLUMNS = 8


def with_whole_numbers(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The text columns ``names`` as ``whole_number`` gives them, each text trimmed and parsed once."""
    trimmed = rows.withColumns({name: F.trim(F.col(name)) for name in names})
    texts = trimmed.withColumns({name: F.when(F.col(name) != "", F.col(name)) for name in names})
    for first in range(0, len(names), STEP_COLUMNS):
        own = names[first:first + STEP_COLUMNS]
        parsed = computed_once(texts.withColumns({f"_{name}_number": F.col(name).try_cast("double") for name in own}))
        texts = parsed.withColumns({name: _checked(name, F.col(name), F.col(f"_{name}_number")) for name in own}).select(*rows.columns)
    return texts


def _date(name: str) -> Column:
    """``yyyy-MM-dd`` as a date; text of that shape needs no formatter."""
    text = F.col(name)
    plain = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))
    return F.coalesce(plain, F.to_date(text, "yyyy-MM-dd"))


def typed_flights(raw: DataFrame, *others: Column) -> DataFrame:
    """The flights table of raw text columns, with other columns of the raw rows beside it."""
    chosen = raw.select(*SOURCE_NAMES, *others)
    kept = chosen.columns[len(SOURCE_NAMES):]
    texts = {source: _text(source) for source, _, kind in FLIGHT_COLUMNS if kind in ("date", "text")}
    numbered = with_whole_numbers(
        chosen.withColumns(texts), [source for source, _, kind in FLIGHT_COLUMNS if kind in ("int", "flag")]
    )
    typed = {"date": _date, "text": F.col, "int": F.col, "flag": lambda name: F.col(name) == 1}
    return numbered.select(*[typed[kind](source).alias(name) for source, name, kind in FLIGHT_COLUMNS], *kept)


SOURCE_FILE = "source_file"


def _plain(path: Column) -> Column:
    """A file's path without scheme, as listing and reading both give it."""
    return F.regexp_replace(path, "^[A-Za-z0-9]+:/*", "/")


def ingest(spark: SparkSession, path: str, target: str, skip_present: bool = True) -> DataFrame:
    """Load the raw files into the stored flights table and return that table.

    What a load is about is the file, never the month of a row: files that the
    target holds are not read again; without ``skip_present`` they are replaced.
    Rows of whatever month are appended, so late rows in a later file are kept,
    and a repeated load leaves one copy of each file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", _plain(F.col("path")).alias(SOURCE_FILE))
    held = None
    if _holds_table(spark, target):
        held = read_table(spark, target).select(F.col(SOURCE_FILE).cast("string")).distinct()
    wanted = files.join(held, SOURCE_FILE, "left_anti") if skip_present and held is not None else files
    paths = [row.path for row in wanted.select("path").collect()]  # file names only
    if not paths:
        return read_table(spark, target)
    name = _plain(F.url_decode(F.col("_metadata.file_path"))).alias(SOURCE_FILE)
    flights = with_month(_together([typed_flights(raw, name) for raw in _by_header(spark, paths)]))
    replaced = [] if skip_present or held is None else [
        row[SOURCE_FILE] for row in files.join(held, SOURCE_FILE).select(SOURCE_FILE).distinct().collect()
    ]
    into = f"{target}/_loading-{uuid.uuid4().hex}" if replaced else target
    (
        flights.hint("rebalance", SOURCE_FILE, *MONTH_COLUMNS)
        .sortWithinPartitions(SOURCE_FILE, *MONTH_COLUMNS, "origin", "dest")
        .write.mode("append").partitionBy(SOURCE_FILE, *MONTH_COLUMNS).parquet(into)
    )
    if replaced:
        _swap(spark, target, into, replaced)
    return read_table(spark, target)


def _swap(spark: SparkSession, target: str, loaded: str, replaced: list[str]) -> None:
    """Put freshly written files' folders in the place of the old ones.

    Everything new is written before anything old goes: a load that fails leaves the table as it was.  Folders move one
    by one; what is moved out is deleted at the end.  Readers do not see folders that begin with an underscore.
    """
    jvm = spark.sparkContext._jvm
    path, escape = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    new, gone = path(loaded), path(f"{target}/_replaced-{uuid.uuid4().hex}")
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(gone)
    names = {f"{SOURCE_FILE}={escape(name)}" for name in replaced}
    fresh = {status.getPath().getName() for status in fs.listStatus(new) if status.isDirectory() and "=" in status.getPath().getName()}
    for name in sorted(names | fresh):
        old = path(f"{target}/{name}")
        if fs.exists(old):
            fs.rename(old, path(gone, name))
        if name in fresh:
            fs.rename(path(new, name), old)
    fs.delete(gone, True)
    fs.delete(new, True)


def _holds_table(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def write_raw(flights: DataFrame, path: str) -> None:
    """Write flights the way the raw extracts look: source names, ``23.0`` numbers, one folder per month."""
    def as_text(name: str, kind: str) -> Column:
        if kind in ("int", "flag"):
            number = F.col(name).cast("int")
            exponent = (number <= -10_000_000) | (number >= 10_000_000)
            return F.when(exponent, number.cast("double").cast("string")).otherwise(F.concat(number.cast("string"), F.lit(".0")))
        return F.col(name).cast("string")

    columns = [as_text(name, kind).alias(source) for source, name, kind in FLIGHT_COLUMNS]
    # Dealt out as numbers, which are smaller than their text.
    spread = flights.select(*FLIGHT_NAMES, F.date_format("flight_date", "yyyy_MM").alias("month")).hint("rebalance", "month")
    spread.select(*columns, "month").write.mode("overwrite").partitionBy("month").option("header", True).csv(path)
