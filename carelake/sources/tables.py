"""Reading tables with declared schemas; text files are coerced column by column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.columns import finite, to_number
from carelake.plans import clinical as cfg

FEEDBACK_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in cfg.FEATURES]
    + [
        T.StructField("feedback_risk", T.IntegerType()),
        T.StructField("original_prediction", T.StringType()),
        T.StructField("user_confirmation", T.BooleanType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("trained", T.BooleanType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric reading of columns; text that does not parse, NaN and the infinities become null."""

    def read(field: T.StructField):
        if isinstance(field.dataType, T.FractionalType) and not isinstance(field.dataType, T.DecimalType):
            return finite(F.col(field.name)).cast("double")
        if isinstance(field.dataType, T.NumericType):
            return F.col(field.name).cast("double")
        return to_number(F.col(field.name))

    return df.withColumns({f.name: read(f) for f in df.schema if f.name in columns})


def read_csv_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    numeric: Sequence[str],
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV with a header, read as text in one scan (no inference pass) and then coerced.

    A spreadsheet is read the same way once saved as CSV or Parquet.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return coerce_numbers(df.withColumnsRenamed(dict(renames or {})), numeric)


def read_json_requests(spark: SparkSession, path: str) -> DataFrame:
    """Scoring requests as JSON lines with the fixed feature schema."""
    return spark.read.schema(T.StructType([T.StructField(c, T.DoubleType()) for c in cfg.FEATURES])).json(path)


def _has_files(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop) and fs.getContentSummary(hadoop).getLength() > 0


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The feedback log; a missing or empty path gives the typed empty table."""
    if not _has_files(spark, path):
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in FEEDBACK_SCHEMA])
    raw = spark.read.schema(text).option("header", True).csv(path)
    typed = {
        f.name: (
            to_number(F.col(f.name)).cast(f.dataType)
            if isinstance(f.dataType, T.NumericType)
            else F.col(f.name).try_cast(f.dataType)
        )
        for f in FEEDBACK_SCHEMA
        if not isinstance(f.dataType, T.StringType)
    }
    return raw.withColumns(typed)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append rows as CSV part files; earlier files are not touched."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    df.withColumn("timestamp", stamp).select(FEEDBACK_SCHEMA.names).write.mode("append").option("header", True).csv(path)


def assemble_documents(
    pages: DataFrame, doc: str, page: str, text: str, sep: str = "\n\n"
) -> DataFrame:
    """One text per document from its pages in order; pages without text are skipped.

    The grouped list is no larger than the text it is joined into.
    """
    return (
        pages.where(F.length(text) > 0)
        .groupBy(doc)
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))).alias("pages")
        )
        .select(
            doc,
            F.size("pages").cast("bigint").alias("n_pages"),
            F.array_join(F.transform("pages", lambda x: x["t"]), sep).alias("text"),
        )
    )


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was committed; an empty or broken folder does not count."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_index(chunks: DataFrame, path: str, force_rebuild: bool = False) -> None:
    """Write the chunk index once; a committed index is kept unless a rebuild is forced."""
    if force_rebuild or not _is_complete(chunks.sparkSession, path):
        chunks.write.mode("overwrite").parquet(path)
