"""A path or a DataFrame to its data dictionary."""

from __future__ import annotations

import gzip
import io
import posixpath
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulore.operators.leaves import SCHEMA, record_leaves, table_leaves
from tabulore.operators.profile import as_frame, profiles
from tabulore.plans.shared import shared_folder
from tabulore.sources import columnar, lines, records, registry, tables

Profiles = dict[str, list[dict]]
LOGS = ("common_log", "combined_log", "syslog", "syslog5424")


def zstd():
    try:
        import zstandard
    except ImportError as e:
        raise ValueError("zstd input needs the zstandard library; install it with: pip install zstandard") from e
    return zstandard


def decompressed(spark: SparkSession, path: str, codec: str, logical: str) -> str:
    """A plain copy in the shared folder, for readers of lines and of Parquet; one executor writes it, as a stream."""
    target = f"{shared_folder(spark)}/plain-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                fs, to = pyarrow.fs.FileSystem.from_uri(target)
                fs.create_dir(to, recursive=True)
                with fs.open_output_stream(f"{to}/{posixpath.basename(logical)}", compression=None) as out:
                    try:
                        if codec == "gzip":
                            shutil.copyfileobj(gzip.GzipFile(fileobj=io.BytesIO(data)), out)
                        else:
                            zstd().ZstdDecompressor().copy_stream(io.BytesIO(data), out)
                    except Exception as e:
                        raise ValueError(f"failed to decompress {path}: {e}") from e
                yield pd.DataFrame({"n": [len(data)]})

    spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "n long").collect()
    return f"{target}/{posixpath.basename(logical)}"


def plain_bytes(data: bytes, codec: str | None) -> bytes:
    if codec == "gzip":
        return gzip.decompress(data)
    return zstd().ZstdDecompressor().decompressobj().decompress(data) if codec == "zstd" else data


def decoded(spark: SparkSession, path: str, table: str, name: str, codec: str | None, nrows: int | None) -> DataFrame:
    """Leaves of a file that is decoded whole, on an executor."""

    def leaves(data: bytes) -> Iterator[pd.DataFrame]:
        if name == "arrow_ipc":
            yield from columnar.ipc_leaves(data, table, nrows)
        elif name in tables.DECODERS:
            for of, header, types, rows in tables.DECODERS[name](data, table, nrows):
                yield from table_leaves(of, header, types, rows)
        else:
            for of, found in records.avro(data, table, nrows) if name == "avro" else records.DECODERS[name](data, table):
                kept = found if nrows is None or name in records.WHOLE else found[:nrows]
                yield from record_leaves(of, enumerate(kept))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield from leaves(plain_bytes(bytes(data), codec))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def load(spark: SparkSession, path: str, fmt: str | None = None, nrows: int | None = None, delimiter: str | None = None, widths: list[int] | None = None, one_line: bool = False):
    """Leaves, columns by table (None where the leaves have the headers), format name."""
    codec, logical = registry.codec_of(path)
    name, table = registry.detect(logical, fmt), registry.stem_of(logical)
    by_line = name in ("csv", "tsv", "fixed_width", *LOGS, "json")
    if by_line and codec and not path.endswith(".gz"):  # which Spark reads itself
        path = decompressed(spark, path, codec, logical)
    if name in ("csv", "tsv"):
        leaves, columns = lines.csv(spark, path, table, nrows, delimiter or ("\t" if name == "tsv" else ","), one_line)
    elif name == "fixed_width":
        leaves, columns = lines.fixed_width(lines.lines(spark, path), table, nrows, widths or [])
    elif name in ("common_log", "combined_log"):
        leaves, columns = lines.weblog(lines.lines(spark, path), table, nrows, name == "combined_log")
    elif name in ("syslog", "syslog5424"):
        leaves, columns = lines.syslog(lines.lines(spark, path), table, nrows, name == "syslog5424")
    elif name == "json" and not lines.starts_with_array(spark, path):
        leaves, columns = lines.json_lines(spark, path, table, nrows)[0], None
    elif name == "parquet" and not codec:
        df = spark.read.parquet(path)
        # one file has an order of rows; parts of many are taken as they are read
        rec = F.col("_metadata.row_index") if len(df.inputFiles()) == 1 else F.monotonically_increasing_id()
        if nrows is not None:
            df = df.filter(F.col("_metadata.row_index") < nrows) if len(df.inputFiles()) == 1 else df.limit(nrows)
            rec = rec if len(df.inputFiles()) == 1 else F.monotonically_increasing_id()
        leaves, columns = columnar.frame_leaves(df, table, rec)
    elif name == "parquet":
        df = spark.read.parquet(decompressed(spark, path, codec, logical))
        leaves, columns = columnar.frame_leaves(df if nrows is None else df.limit(nrows), table)
    else:
        leaves, columns = decoded(spark, path, table, name, None if by_line else codec, nrows), None
    return leaves, None if columns is None else {table: columns}, name


def profile_path(spark: SparkSession, path: str, samples: int = 3, **options) -> tuple[Profiles, str]:
    leaves, columns, name = load(spark, path, **options)
    spell = columnar.spelled if name == "parquet" else (lambda kind, text: text)
    try:
        return profiles(leaves, samples, columns, spell), name
    except Exception as e:
        said = lines.with_line_number(spark, path, e) if name in LOGS else e
        if said is e:
            raise
        raise said from e


def profile(spark: SparkSession, path: str, samples: int = 3, **options) -> DataFrame:
    """The dictionary of a file: a row for each column or path. options: those of load()."""
    return as_frame(spark, profile_path(spark, path, samples, **options)[0])


def profile_df(df: DataFrame, table: str = "table", samples: int = 3, rec=None) -> DataFrame:
    """The dictionary of a DataFrame."""
    leaves, columns = columnar.frame_leaves(df, table, rec)
    return as_frame(df.sparkSession, profiles(leaves, samples, {table: columns}, columnar.spelled))
