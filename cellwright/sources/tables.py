"""Sources and sinks: tables of strings with a row number, cells, constraints, catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, plain_read

INDEX = "__ind"
FORMATS = ("csv", "parquet", "orc", "json")


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, index: bool = False, longest: int | None = None) -> DataFrame:
    """A table by the path's ending. CSV has a header and strings throughout unless a schema is given; empty fields are null.

    index: add the row number from 1 as the last column, __ind. longest: drop columns that hold a longer string."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)
    df = df if longest is None else without_long_columns(df, longest)
    return with_index(df) if index else df


def with_index(df: DataFrame, name: str = INDEX, order: list[str] | None = None, start: int = 1) -> DataFrame:
    """Number the rows from `start`, in the order given or else the order read, as the last column.

    A row's number is its place in its partition plus the sizes of the partitions before, so nothing meets in one task; one row per
    partition is added up and broadcast. A plain read of files is read twice; anything else is written to the shared folder first,
    as its rows needn't come in the same order again."""
    names = [f"c{i}" for i in range(len(df.columns))]  # a file takes no names that differ in case alone
    kept = df.toDF(*names)
    if order:
        places = [names[df.columns.index(c)] for c in order]
        kept = kept.repartitionByRange(*places).sortWithinPartitions(*places)
    kept = kept.withColumn("__m", F.monotonically_increasing_id())
    if order or not plain_read(df):
        kept = cut(kept, "rows")
    part = F.shiftright("__m", 33)
    sizes = kept.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    ahead = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__a"))
    joined = kept.withColumn("__q", part).join(F.broadcast(ahead), F.col("__q") == F.col("__p"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)], (F.col("__a") + place + start).cast("long").alias(name))


def without_long_columns(df: DataFrame, longest: int = 255) -> DataFrame:
    """df without the columns that hold a string longer than `longest`; one pass."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    row = df.agg(*[F.max(F.length(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(text)]).first()
    return df.drop(*[c for i, c in enumerate(text) if (row[i] or 0) > longest])


def attributes(df: DataFrame, ind: str = INDEX) -> list[str]:
    return [c for c in df.columns if c != ind]


def flatten(df: DataFrame, ind: str = INDEX, attrs: list[str] | None = None) -> DataFrame:
    """One row per cell: ind, attr, val (as a string, null kept)."""
    attrs = attrs or attributes(df, ind)
    return df.select(F.col(f"`{ind}`").alias("ind"), F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"`{a}`").cast("string").alias("val")) for a in attrs])).alias("c")).select("ind", "c.attr", "c.val")


def cells(df: DataFrame, ind: str = INDEX, attrs: list[str] | None = None) -> DataFrame:
    return flatten(df, ind, attrs).select("ind", "attr")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of labelled cells (ind, attr)."""
    return spark.read.csv(path, header=True, schema="ind long, attr string")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of true values (tid, attr_name, attr_val)."""
    return spark.read.csv(path, header=True, schema="tid long, attr_name string, attr_val string")


def map_schema(df: DataFrame, ind: str = INDEX) -> DataFrame:
    """(attr_id, attribute): the attributes from 1, without the row number."""
    return df.sparkSession.createDataFrame(list(enumerate(attributes(df, ind), 1)), "attr_id int, attribute string")


def whole(df: DataFrame) -> DataFrame:
    """df for a join that must not broadcast it, nor what it meets unless that is marked as small: joins are planned by the sizes of
    compressed files, a small part of what the rows take in the driver."""
    return df.hint("merge")


#: Rows of statistics that a join may broadcast, if their file is small enough for that, too.
FEW = 50_000


def few_or_whole(df: DataFrame) -> DataFrame:
    """df, which stands in files, for joins: `whole` if it has more than FEW rows, however small its files are."""
    return df if df.limit(FEW + 1).count() <= FEW else whole(df)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


class Catalog:
    """Tables of one session, under names that no other session uses."""

    def __init__(self, spark: SparkSession):
        self.spark, self.id, self.tables = spark, uuid.uuid4().hex, {}

    def name(self, table: str) -> str:
        return f"{table}_{self.id}"

    def add(self, table: str, df: DataFrame, append: bool = False, persist: bool = False) -> DataFrame:
        """persist: save it as a table of the warehouse, else keep its plan."""
        if persist:
            df.write.mode("append" if append else "overwrite").saveAsTable(self.name(table))
            df = self.spark.table(self.name(table))
        elif append and table in self.tables:
            df = self.tables[table].unionByName(df)
        self.tables[table] = df
        df.createOrReplaceTempView(self.name(table))
        return df

    def get(self, table: str) -> DataFrame:
        return self.tables[table]

    def schema(self, table: str) -> T.StructType:
        return self.tables[table].schema

    def query(self, sql: str) -> DataFrame:
        """Spark SQL in which {name} stands for a table of this session."""
        return self.spark.sql(sql.format(**{t: self.name(t) for t in self.tables}))

    def reset(self) -> None:
        for t in self.tables:
            self.spark.catalog.dropTempView(self.name(t))
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(t)}")
        self.tables = {}
