"""Reading reports in batch or as a stream, and bringing them to one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = T.StructType(
    [
        T.StructField("report_id", T.LongType()),
        T.StructField("report_type", T.StringType()),
        T.StructField("narrative", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("location", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("asset", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("reporter", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("barrier", T.StringType()),
        T.StructField("sif_label", T.IntegerType()),
        T.StructField("lsr_labels", T.ArrayType(T.StringType())),
    ]
)

#: How CSV is written and read, so that texts with quotes, line ends and spaces at their ends come back as they were.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}
#: An empty field is null when read and a quoted empty one an empty text; no text is this mark.
READ_CSV = {**CSV, "nullValue": "\0"}

#: Report families. Their spelling in a source is upper-cased; anything else becomes null.
FAMILIES = ("UA", "UC", "NEAR_MISS", "INCIDENT")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = REPORT, **options: str) -> DataFrame:
    """A batch of report files. The schema is always given, so no pass is spent on guessing it.

    CSV is read as :func:`hazlens.sources.sinks.export` writes it: with a header, quotes doubled, and line ends within quotes. Such
    files can't be split, so large ones should come as many; where no text holds a line end, ``multiLine="false"`` lets Spark split them.
    """
    return spark.read.format(fmt).options(**{**(READ_CSV if fmt == "csv" else {}), **options}).schema(schema).load(path)


def stream(spark: SparkSession, path: str, schema: T.StructType = REPORT, fmt: str = "parquet", files_per_trigger: int = 100, **options: str) -> DataFrame:
    """Report files as they arrive; CSV as in :func:`read`."""
    return spark.readStream.format(fmt).options(**{**(READ_CSV if fmt == "csv" else {}), **options}).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def normalised(raw: DataFrame, mapping: dict[str, str | F.Column], report_type: str | None = None) -> DataFrame:
    """``raw`` in the canonical schema: named columns or expressions are cast, the rest are typed nulls.

    A timestamp that can't be read becomes null instead of ending the job.
    """
    columns = []
    for field in REPORT:
        value = mapping.get(field.name)
        if value is None:
            column = F.lit(report_type if field.name == "report_type" else None)
        else:
            column = F.col(value) if isinstance(value, str) else value
            if field.name == "event_ts":
                column = F.try_to_timestamp(column.cast("string"))
        if field.name == "report_type" and value is not None:
            column = F.upper(column)
            column = F.when(column.isin(*FAMILIES), column)
        columns.append(column.cast(field.dataType).alias(field.name))
    return raw.select(*columns)


def merged(*families: DataFrame) -> DataFrame:
    """All families below each other; columns that one lacks are null there."""
    out = families[0]
    for family in families[1:]:
        out = out.unionByName(family, allowMissingColumns=True)
    return out


def corpus(**sources: DataFrame) -> DataFrame:
    """A training corpus of several sources, with the name of each in ``provenance``."""
    return merged(*(df.withColumn("provenance", F.lit(name)) for name, df in sources.items()))


def labelled(reports: DataFrame, labels: DataFrame, key: str = "report_id") -> DataFrame:
    """Reports with their labels, where there are any."""
    return reports.join(labels, key, "left")
