"""Table sources and sinks: parquet scans with path checks, JSON batches,
schema listings, codec conversion and versioned (never in-place) rewrites."""

from __future__ import annotations

import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import checkpoint_dir

PARQUET_SUFFIXES = (".parquet", ".pq")
CODECS = ("zstd", "snappy", "gzip", "lz4", "none")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table by name (``{sf_dir}/{name}.parquet``)."""
    return scan_parquet(spark, table_path(sf_dir, name))


def file_system(spark: SparkSession, path: str):
    """(file system, path) of any path that Spark can read, whatever its scheme."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def version_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, latest change) of a file, or of a dataset folder and its part files."""
    fs, own = file_system(spark, path)
    return size_bytes(spark, path), max([fs.getFileStatus(own).getModificationTime(),
                                         *(f.getModificationTime() for f in fs.listStatus(own))])


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, by its own file system."""
    fs, own = file_system(spark, path)
    return fs.getContentSummary(own).getLength()


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Lazy parquet scan with the catalogue's path checks.

    Empty path -> ValueError; missing path -> FileNotFoundError; a file must
    end in .parquet/.pq. Directories are accepted (a Spark dataset is a
    directory of part files).
    """
    if not path or not str(path).strip():
        raise ValueError("path must not be empty")
    fs, own = file_system(spark, path)
    if not fs.exists(own):
        raise FileNotFoundError(path)
    if fs.getFileStatus(own).isFile() and not path.endswith(PARQUET_SUFFIXES):
        raise ValueError(f"not a parquet file: {path}")
    return spark.read.parquet(path)


def select_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All columns, or the named ones in the given order; unknown names raise."""
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Unknown column(s) {missing}. Available columns: {df.columns}")
    return df.select(*columns)


def describe_columns(df: DataFrame) -> DataFrame:
    """(position, column, dtype, rows, filled): the schema with each column's count of non-null values.

    One aggregate over the table, then an unpivot to one row per column.
    """
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)))
    return counts.select("rows", F.inline(F.array(*(
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"c{i}").alias("filled"))
        for i, f in enumerate(fields))))).select("position", "column", "dtype", "rows", "filled")


def read_json_batch(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    multi_line: bool = True) -> DataFrame:
    """JSON recipes: by default files holding a list of recipes or one object
    (multi-line JSON, one document per file); ``multi_line=False`` reads JSON
    lines (one recipe per line, splittable)."""
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", mode: str = "errorifexists") -> str:
    """Write with one of the supported codecs (zstd, snappy, gzip, lz4, none)."""
    if codec not in CODECS:
        raise ValueError(f"Unknown codec {codec!r}; choose one of {CODECS}")
    df.write.mode(mode).option("compression", codec).parquet(path)
    return path


def convert_codec(spark: SparkSession, src: str, dst: str, codec: str = "zstd",
                  src_format: str = "parquet") -> DataFrame:
    """Re-encode a json/csv/parquet dataset as parquet; returns a one-row report.

    Report: rows, columns, input bytes, output bytes, size reduction percent.
    Counting happens on the written output (one pass over it), not the driver.
    """
    if src_format == "parquet":
        df = spark.read.parquet(src)
    elif src_format == "json":
        df = spark.read.option("multiLine", True).json(src)
    elif src_format == "csv":
        df = spark.read.option("header", True).csv(src)
    else:
        raise ValueError(f"Unsupported source format {src_format!r}")
    write_parquet(df, dst, codec)
    out = spark.read.parquet(dst)
    in_bytes, out_bytes = size_bytes(spark, src), size_bytes(spark, dst)
    reduction = (1 - out_bytes / in_bytes) * 100 if in_bytes else 0.0
    return out.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(out.columns)).alias("columns"),
        F.lit(in_bytes).cast("long").alias("input_bytes"),
        F.lit(out_bytes).cast("long").alias("output_bytes"),
        F.lit(reduction).alias("size_reduction_pct"),
        F.lit(codec).alias("codec"),
    )


def new_version_path(base: str) -> str:
    """A fresh version directory under ``base`` (never the path being read)."""
    return f"{base.rstrip('/')}/v-{_uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a fresh table in the shared folder and read it back: cuts the lineage at files that every
    executor can reach, and several branches of a plan then read the same rows."""
    spark = df.sparkSession
    path = new_version_path(f"{checkpoint_dir(spark)}/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _quoted(name: str) -> str:
    """A name as an SQL text literal."""
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def restructure_wide(df: DataFrame, value_schema: str | None = None) -> DataFrame:
    """Wide -> long: columns named by recipe id, one value per column, become rows, in the columns' order per input row.

    With a ``value_schema`` (DDL of the per-recipe value) the values come in as JSON text and are parsed once they are rows;
    struct values are unnested into columns, other values stay in ``recipe_data``. A null or unreadable value gives a row of
    nulls; a frame without columns gives no rows. Columns of one type are one ``stack``, a single generator however many
    there are; ``unpivot``, which widens mixed types but plans a projection per column, takes the rest.
    """
    cols = df.columns
    if not cols:
        return df.sparkSession.createDataFrame([], "recipe_id string, recipe_data string")
    if len({f.dataType.simpleString() for f in df.schema.fields}) == 1:
        pairs = ", ".join(f"{_quoted(c)}, `{c.replace('`', '``')}`" for c in cols)
        long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (recipe_id, recipe_data)")
    else:
        long = df.unpivot([], [F.col(f"`{c.replace('`', '``')}`") for c in cols], "recipe_id", "recipe_data")
    if value_schema is not None:
        long = long.withColumn("recipe_data", F.from_json("recipe_data", value_schema))
    if isinstance(long.schema["recipe_data"].dataType, T.StructType):
        return long.select("recipe_id", "recipe_data.*")
    return long


def json_map_rows(df: DataFrame, json_col: str) -> DataFrame:
    """One row per entry of a flat JSON object text column: the other columns, ``key`` and ``value``."""
    others = [c for c in df.columns if c != json_col]
    return df.select(*others, F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "value"))


def restructure_json_map(df: DataFrame, json_col: str, value_schema: str) -> DataFrame:
    """Same restructure for a JSON object text column ``{id: {...}, ...}``."""
    parsed = df.select(F.explode(F.from_json(F.col(json_col), f"map<string,{value_schema}>"))
                       .alias("recipe_id", "recipe_data"))
    return parsed.select("recipe_id", "recipe_data.*")
