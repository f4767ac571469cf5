"""Tables that are dealt by a key once, for many lookups."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.lookups import one_per_key

#: Parts that the rows of one key are dealt to.
SALTS = 8


class Dealt(NamedTuple):
    """A table in buckets of a key and a salt."""

    table: str
    key: str
    salts: int


def deal(df: DataFrame, key: str, path: str, buckets: int, salts: int = SALTS) -> Dealt:
    """Write a table in buckets, sorted within; one shuffle, and none in the lookups that follow.

    A key that holds a third of all rows would fill one bucket, which a join of buckets cannot split. So rows are
    dealt by key and salt; a catalog has one row per key and is small beside them, so a lookup repeats its rows per salt.
    The salt is a hash of the whole row: a rerun deals alike. Columns that have no hash (maps) take no part in it.
    """
    spark = df.sparkSession
    hashed = [F.col(name) for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    name = f"corpuscope_{uuid.uuid4().hex}"
    ranged = salted.repartition(buckets, key, "_salt")
    writer = ranged.write.option("path", path).bucketBy(buckets, key, "_salt").sortBy(key, "_salt")
    writer.saveAsTable(name)
    return Dealt(name, key, salts)


def drop_dealt(spark: SparkSession, dealt: Dealt) -> None:
    """Forget the table; its files stay where they were written."""
    spark.sql(f"DROP TABLE IF EXISTS {dealt.table}")


def dealt_rows(spark: SparkSession, dealt: Dealt) -> DataFrame:
    return spark.table(dealt.table).drop("_salt")


class Lookups:
    """Several catalogs looked up by the key of one dealt table, in a single pass over it."""

    def __init__(self, spark: SparkSession, dealt: Dealt) -> None:
        self.dealt = dealt
        self.rows = spark.table(dealt.table)
        self.columns = [c for c in self.rows.columns if c != "_salt"]

    def _salted(self, right: DataFrame) -> DataFrame:
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.dealt.salts - 1))).alias("_salt")
        return right.select("*", salts)

    def add(self, catalog: DataFrame, found: str, *columns: Column) -> Lookups:
        """Add a flag ``found`` and aggregated ``columns`` of a catalog that has the same key column.

        The catalog's side is dealt to the buckets; the table's rows stay where they are.
        """
        one = one_per_key(catalog, self.dealt.key, *columns).withColumnRenamed("_found", found)
        names = [c for c in one.columns if c != self.dealt.key]
        joined = self.rows.join(self._salted(one), [self.dealt.key, "_salt"], "left")
        self.rows = joined.withColumn(found, F.col(found).isNotNull())
        self.columns = [*self.columns, *names]
        return self

    def result(self) -> DataFrame:
        return self.rows.select(*self.columns)
