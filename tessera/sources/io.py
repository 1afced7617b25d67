"""Sources, sinks and the catalog."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from pathlib import PurePath
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options as switches
from ..table import Tbl

#: Suffixes and the formats that read them; statistical files with their pandas reader.
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "geoparquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc", "arrow": "arrow", "feather": "arrow"}
STATISTICAL = {"sas7bdat": "read_sas", "xpt": "read_sas", "sav": "read_spss", "zsav": "read_spss", "por": "read_spss", "dta": "read_stata"}

#: Words that standard SQL reserves and statements are made of.
RESERVED = frozenset("all alter and any as asc between by case cast check constraint create cross default delete desc distinct drop else end except exists false fetch for foreign from full grant group having in inner insert intersect into is join left like limit natural not null offset on or order outer primary references right select set table then to true union unique update using values view when where window with".split())


def suffix(path: str) -> str:
    return re.sub(r"[?#].*$", "", path).rstrip("/").rpartition(".")[2].lower()


def stem(path: str) -> str:
    """A table's name from its path."""
    if "*" in path:
        return "data"
    return PurePath(re.sub(r"[?#].*$", "", path)).stem.replace("-", "_")


def fetched(spark: SparkSession, url: str, kind: str | None = None) -> str:
    """Where the web resource has been copied to, in a folder that all executors see; read from there in parallel."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tessera-web-{uuid4().hex}/{stem(url) or 'data'}.{kind or suffix(url)}")
    source = jvm.java.net.URI(url).toURL().openStream()
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, path.getFileSystem(hadoop).create(path), 1 << 16, True)
    return path.toString()


def sheet_url(url: str) -> str:
    """The CSV export of a shared sheet, from the address that the browser shows."""
    m = re.search(r"/spreadsheets/d/([^/?#]+)", url)
    if not m:
        raise ValueError("no sheet's address")
    page = re.search(r"[?&#]gid=(\d+)", url)
    return f"https://docs.google.com/spreadsheets/d/{m[1]}/export?format=csv&gid={page[1] if page else 0}"


def _lines(spark: SparkSession, paths: list[str]) -> bool:
    """Whether JSON files hold a value on each line, told by the first line with text: an array, or an object that
    goes on, is read as one value a file."""
    first = spark.read.text(paths).filter(F.trim("value") != "").first()
    try:
        return first is None or isinstance(json.loads(first[0]), dict)
    except ValueError:
        return False


def _arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow files, each read by the task that has it; the first one's schema holds."""
    import pyarrow as pa
    from pyarrow import feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(paths).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from feather.read_table(pa.BufferReader(content.as_buffer())).select(names).to_batches()

    schema = feather.read_table(pa.BufferReader(bytes(files.first()[0]))).schema
    names = schema.names
    return files.mapInArrow(read, from_arrow_schema(schema))


def _frame(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
    kind = options.pop("format", None) or FORMATS.get(suffix(paths[0])) or suffix(paths[0])
    paths = [fetched(spark, p) if re.match("https?://", p) else p for p in paths]
    if kind in STATISTICAL:
        import pandas as pd

        return spark.createDataFrame(pd.concat([getattr(pd, STATISTICAL[kind])(p, **options) for p in paths], ignore_index=True))
    if kind == "arrow":
        return _arrow(spark, paths)
    if kind == "csv":
        options = {"header": True, "inferSchema": "schema" not in options, "sep": "\t" if suffix(paths[0]) == "tsv" else ","} | options
    if kind == "json" and "multiLine" not in options:
        options = {"multiLine": not _lines(spark, paths)} | options
    schema = options.pop("schema", None)
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(paths if len(paths) > 1 else paths[0])


def _warn_of_keywords(df: DataFrame) -> None:
    if switches.warn and (found := [c for c in df.columns if c.lower() in RESERVED]):
        warnings.warn(f"columns {found} are named by SQL keywords; quote them in SQL text", stacklevel=3)


def dt(spark: SparkSession, source, name: str | None = None, *, alias: str | None = None, iceberg: bool = False, delta: bool = False, **options) -> Tbl:
    """A lazy table from a table's name, one or several paths, a DataFrame, or a pandas or Arrow table.

    Several paths are of one kind, csv, parquet or json. Web addresses are copied to the shared folder first, a shared
    sheet as CSV. Iceberg and Delta need their connector's jar."""
    if isinstance(source, Tbl):
        return source
    if isinstance(source, DataFrame):
        df, called = source, name
    elif isinstance(source, (list, tuple)):
        if len({FORMATS.get(suffix(p)) for p in source}) != 1 or FORMATS.get(suffix(source[0])) not in ("csv", "parquet", "json", "orc"):
            raise ValueError("several paths must be of one kind: csv, parquet, json or orc")
        df, called = _frame(spark, list(source), options), "data"
    elif not isinstance(source, str):
        df, called = spark.createDataFrame(source), name
        _warn_of_keywords(df)
        if name:
            df.createOrReplaceTempView(name)
    elif iceberg or delta:
        df = spark.read.format("iceberg" if iceberg else "delta").options(**options).load(source)
        called = stem(source)
    elif "docs.google" in source:
        df, called = _frame(spark, [fetched(spark, sheet_url(source), "csv")], options), "data"
    elif re.search(r"[:/\\]", source):
        df, called = _frame(spark, [source], options), stem(source)
    else:
        df, called = spark.table(source), source.rpartition(".")[2]
    called = alias or name or called
    return Tbl(df, scopes={called: {c: c for c in df.columns}} if called else {})


db_table = dt


def read(spark: SparkSession, kind: str, path: str, **options) -> Tbl:
    """A named reader with its options: read(spark, 'csv', path, sep=';')."""
    return dt(spark, path, alias=options.pop("alias", "data"), format=kind, **options)


def jdbc(spark: SparkSession, url: str, table: str, alias: str | None = None, **properties) -> Tbl:
    """A table of a database; filters and aggregates are pushed down. partitionColumn, lowerBound, upperBound and
    numPartitions deal the reading over executors."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **properties).load()
    return dt(spark, df, alias or table.rpartition(".")[2])


#: Formats of warehouses' connectors and how they call the table, or their JDBC drivers.
WAREHOUSES = {"bigquery": ("bigquery", "table"), "snowflake": ("snowflake", "dbtable")}
DRIVERS = {"athena": "com.amazon.athena.jdbc.AthenaDriver", "databricks": "com.databricks.client.jdbc.Driver", "postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mariadb": "org.mariadb.jdbc.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver", "sqlite": "org.sqlite.JDBC", "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver"}


def warehouse(spark: SparkSession, kind: str, table: str, alias: str | None = None, url: str | None = None, **options) -> Tbl:
    """A table of a warehouse or database through its connector or JDBC driver, whose jar the session must have."""
    if kind in DRIVERS:
        return jdbc(spark, url, table, alias, driver=DRIVERS[kind], **options)
    form, key = WAREHOUSES[kind]
    df = spark.read.format(form).options(**options, **{key: table}).load()
    return dt(spark, df, alias or table.rpartition(".")[2])


def attach(spark: SparkSession, database: str, *tables: str) -> dict[str, Tbl]:
    """Tables of a DuckDB database file (or "md:…" with its token in the environment), registered as views under
    their names; all of them, if none is named. They are read on the driver: for large ones use `jdbc`."""
    import duckdb

    out = {}
    with duckdb.connect(database, read_only=not database.startswith("md:")) as c:
        for name in tables or [r[0] for r in c.execute("SHOW TABLES").fetchall()]:
            out[name] = dt(spark, c.table(name).to_arrow_table(), name)
    return out


def write(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    kind = FORMATS.get(suffix(path), suffix(path))
    if kind == "csv":
        options = {"header": True, "sep": "\t" if suffix(path) == "tsv" else ","} | options
    df.write.format(kind).mode(mode).options(**options).save(path)


def copy_to(spark: SparkSession, source, name: str, overwrite: bool = False, **options) -> Tbl:
    """A saved table from a frame or a file."""
    dt(spark, source, **options).df.write.mode("overwrite" if overwrite else "errorifexists").saveAsTable(name)
    return dt(spark, name)


def show_tables(spark: SparkSession):
    return spark.catalog.listTables()


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def connect(spark: SparkSession, store: str, **keys) -> SparkSession:
    """Credentials of an object store: connect(spark, 's3', access_key=…, secret_key=…, endpoint=…) or 'gcs'."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    prefix = {"s3": "fs.s3a.", "aws": "fs.s3a.", "gcs": "fs.gs.", "gbq": "fs.gs."}[store]
    for k, v in keys.items():
        conf.set(prefix + k.replace("_", "."), str(v))
    return spark


#: Credentials that have expired are replaced as they were given.
update_con = connect
