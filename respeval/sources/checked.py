"""Result files in which some records are broken: good rows and rejects, from one reading.

A record that does not fit the schema is neither an error nor a row of nulls: it becomes a reject with its file, its
text and the reason, and all others are read as ever. Tables and streams are checked alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.sources.results import CSV_OPTIONS
from respeval.streaming.streams import Sink

REJECT = "__reject"
FILE = "__file"


def _options(fmt: str, multi_line: bool, header: bool) -> dict[str, object]:
    kept = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT, "multiLine": multi_line}
    if fmt == "csv":
        kept |= CSV_OPTIONS | {"header": header, "columnPruning": False, "enforceSchema": True}
    return kept


def _schema(schema: T.StructType | str) -> T.StructType:
    whole = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*whole.fields, T.StructField(REJECT, T.StringType())])


def _marked(read: DataFrame) -> DataFrame:
    """Tie the mark of a broken record to all columns: a reader that skips some would not see what is wrong there."""
    fields = [f for f in read.schema.fields if f.name != REJECT]
    named = [F.size(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in fields]
    always = F.xxhash64(*named) >= F.lit(-(1 << 63))
    return read.withColumns({FILE: F.col("_metadata.file_path"), REJECT: F.when(always, F.col(REJECT))})


def read_checked(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", multi_line: bool | None = None,
    header: bool = True,
) -> DataFrame:
    """All records of CSV or JSON files, the broken ones marked; ``good_rows`` and ``rejects`` tell them apart.

    CSV records may span lines unless ``multi_line`` is False, JSON records are one per line unless it is True. In a
    file of one JSON value a broken record is the whole file.
    """
    multi_line = fmt == "csv" if multi_line is None else multi_line
    reader = spark.read.schema(_schema(schema)).options(**_options(fmt, multi_line, header))
    return _marked(reader.format(fmt).load(path))


def stream_checked(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", multi_line: bool | None = None,
    header: bool = True, files_per_batch: int | None = None,
) -> DataFrame:
    """``read_checked`` of a folder as a stream."""
    multi_line = fmt == "csv" if multi_line is None else multi_line
    reader = spark.readStream.schema(_schema(schema)).options(**_options(fmt, multi_line, header))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _marked(reader.format(fmt).load(path))


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col(REJECT).isNull()).drop(REJECT, FILE)


def _csv_reason(checked: DataFrame) -> Column:
    """How many fields a record has if not as many as the schema, or the first field of another type."""
    fields = [f for f in checked.schema.fields if f.name not in (REJECT, FILE)]
    # One field more than the schema has shows that there are too many.
    names = ", ".join(f"f{i} string" for i in range(len(fields) + 1))
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}
    given = F.from_csv(F.col(REJECT), names, options | {"mode": "PERMISSIVE", "multiLine": "true", "nullValue": "\u0000"})
    texts = [given[f"f{i}"] for i in range(len(fields) + 1)]
    short = F.lit(None).cast("string")
    for i in reversed(range(1, len(fields))):
        short = F.when(texts[i].isNull(), F.lit(f"{i} of {len(fields)} fields")).otherwise(short)
    wrong = F.lit(None).cast("string")
    for i in reversed(range(len(fields))):
        f = fields[i]
        if not isinstance(f.dataType, T.StringType):
            odd = F.col(f"`{f.name}`").isNull() & (F.coalesce(texts[i], F.lit("")) != "")
            said = F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), texts[i])
            wrong = F.when(odd, said).otherwise(wrong)
    long = F.when(texts[-1].isNotNull(), F.lit(f"more than {len(fields)} fields"))
    return F.coalesce(long, short, wrong, F.lit("not readable"))


def _json_reason(checked: DataFrame) -> Column:
    is_json = F.try_parse_json(F.col(REJECT)).isNotNull()
    return F.when(is_json, F.lit("a field of another type")).otherwise("no JSON")


def rejects(checked: DataFrame, fmt: str = "csv") -> DataFrame:
    """file, text and reason of every broken record."""
    reason = _csv_reason(checked) if fmt == "csv" else _json_reason(checked)
    broken = checked.filter(F.col(REJECT).isNotNull())
    return broken.select(F.col(FILE).alias("file"), F.col(REJECT).alias("text"), reason.alias("reason"))


def checked_sink(path: str, fmt: str = "csv") -> Sink:
    """A ``foreachBatch`` function that stores good rows under ``path/good`` and rejects under ``path/rejects``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good_rows(batch).write.mode("overwrite").parquet(f"{path}/good/batch_id={batch_id}")
            rejects(batch, fmt).write.mode("overwrite").parquet(f"{path}/rejects/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return on_batch
