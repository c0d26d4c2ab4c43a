"""Tables that are looked up by a key: rows in order of the key's hash, with a list of the files' hashes, so that a lookup opens few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.operators import lookup
from parcelgraph.plans.tables import ENTITIES, PROPERTIES, Packages

#: Most keys of one lookup; more are a join.
MOST_KEYS = 1_000
#: About how many bytes a file holds.
FILE_BYTES = 256 << 20
_HASH = "key_hash"
TABLES = ("entities", "properties", "values")
_VALUES = "crate_id string, pos int, id string, key string, path string, origin string, tag string, text string"


def write_clustered(rows: DataFrame, folder: str, key: Column, files: int, within: tuple[str, ...] = ("crate_id", "pos")) -> None:
    """Writes rows to ``files`` files, by the hash of ``key`` and then ``within``, so that a key that many rows have is in many files.

    Row groups have their least and largest hash, and a bloom filter.  Rows are read
    twice, as Spark samples them for the files' bounds first.
    """
    hashed = rows.withColumn(_HASH, F.xxhash64(key))
    order = (_HASH, *within)
    hashed.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{_HASH}", "true").parquet(f"{folder}/rows")
    of_file = rows.sparkSession.read.schema(f"{_HASH} bigint").parquet(f"{folder}/rows").groupBy(F.col("_metadata.file_name").alias("file"))
    of_file.agg(F.min(_HASH).alias("least"), F.max(_HASH).alias("largest")).coalesce(1).write.parquet(f"{folder}/files")


def find(spark: SparkSession, folder: str, schema: str, column: str, keys: list[str]) -> DataFrame:
    """The rows whose ``column``, by which they were written, is one of ``keys``; only files that may have one are opened, and of those the row groups.

    A missing key gives no row; a null has no rows.  Takes at most ``MOST_KEYS`` keys.
    """
    wanted = sorted({k for k in keys if k is not None})
    if len(wanted) > MOST_KEYS:
        raise ValueError(f"a lookup takes {MOST_KEYS} keys; join with the table for more")
    hashes = [r["h"] for r in spark.createDataFrame([(k,) for k in wanted], "k string").select(F.xxhash64("k").alias("h")).collect()] if wanted else []
    may = F.lit(False)
    for h in hashes:
        may = may | F.lit(h).between(F.col("least"), F.col("largest"))
    names = [r["file"] for r in spark.read.schema("file string, least bigint, largest bigint").parquet(f"{folder}/files").filter(may).select("file").collect()] if hashes else []
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {_HASH} bigint").parquet(*(f"{folder}/rows/{n}" for n in sorted(names)))
    return rows.filter(F.col(_HASH).isin(hashes) & F.col(column).isin(wanted)).drop(_HASH)


class PackageIndex:
    """Packages written for lookups: entities and properties by id, and values by their text."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def write(cls, packages: Packages, folder: str, files: int, tables: tuple[str, ...] = TABLES) -> PackageIndex:
        """``files`` for each table: about its bytes by ``FILE_BYTES``.  Of ``tables`` those that will be looked up."""
        made = cls(packages.entities.sparkSession, folder)
        if "entities" in tables:
            write_clustered(packages.entities, f"{made.folder}/entities", F.col("id"), files)
        if "properties" in tables:
            write_clustered(packages.properties, f"{made.folder}/properties", F.col("id"), files)
        if "values" in tables:
            said = packages.properties.filter(F.col("origin").isin("dynamic", "nested")).withColumn("text", _text())
            write_clustered(said.select(*(c.split(" ")[0] for c in _VALUES.split(", "))), f"{made.folder}/values", F.col("text"), files)
        return made

    def entities(self, ids: list[str]) -> DataFrame:
        """The entities with one of these ids in all packages, repeated ones too."""
        return find(self.spark, f"{self.folder}/entities", ENTITIES, "id", ids)

    def properties(self, ids: list[str]) -> DataFrame:
        return find(self.spark, f"{self.folder}/properties", PROPERTIES, "id", ids)

    def first_entity(self, id_: str) -> DataFrame:
        """As ``lookup.first_entity``."""
        return lookup.first_entity(self.entities([id_]), id_)

    def entities_with_value(self, needle: str) -> DataFrame:
        """As ``lookup.entities_with_value``."""
        tag, text = lookup.parse_needle(needle)
        rows = find(self.spark, f"{self.folder}/values", _VALUES, "text", [lookup.needle_text(tag, text)])
        return lookup.entities_with_value(rows.withColumns({"s": F.col("text"), "json": F.col("text")}), needle)


def _text() -> Column:
    """What a value is looked up by: a text itself, anything else as JSON."""
    return F.when(F.col("tag") == "string", F.col("s")).otherwise(F.col("json"))
