"""Lookups in tables written for them: the same rows, from few files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parcelgraph.operators import lookup
from parcelgraph.plans.tables import ENTITIES, PROPERTIES, Packages
from parcelgraph.sources import clustered


@pytest.fixture(scope="module")
def packages(spark):
    ids = spark.range(6000).withColumn("crate_id", F.concat(F.lit("c"), (F.col("id") % 400).cast("string")))
    entities = ids.select("crate_id", (F.col("id") / 400).cast("int").alias("pos"), F.when(F.col("id") % 3 == 0, "./").otherwise(F.concat(F.lit("#e é "), F.col("id").cast("string"))).alias("id"), F.lit("data").alias("kind"), F.array(F.lit("File")).alias("types"), F.lit(False).alias("types_is_array"))
    given = {"key": F.lit("x"), "path": F.lit("x"), "depth": F.lit(0), "origin": F.lit("dynamic"), "owner": F.col("id"), "tag": F.when(F.col("pos") % 2 == 0, "string").otherwise("int")}
    values = {"s": F.when(F.col("pos") % 2 == 0, F.concat(F.lit("v"), F.col("crate_id"))), "i": F.col("pos").cast("bigint"), "json": F.when(F.col("pos") % 2 == 0, F.concat(F.lit('"v'), "crate_id", F.lit('"'))).otherwise(F.col("pos").cast("string"))}
    row = given | values
    properties = entities.select(*(row.get(c, F.col(c) if c in ("crate_id", "pos", "id") else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ") for x in PROPERTIES.split(", "))))
    none = spark.createDataFrame([], "crate_id string")
    return Packages(none, none, entities.select(*(x.split(" ")[0] for x in ENTITIES.split(", "))), properties)


def rows(df):
    return sorted(map(str, df.collect()))


def test_lookups_open_few_files(spark, packages, tmp_path):
    index = clustered.PackageIndex.write(packages, f"file://{tmp_path}/in dex", files=16)
    for ids in (["#e é 7"], ["#e é 7", "#e é 8", "#e é 7", None, "absent"], ["./"], ["absent"], [], [None]):
        assert rows(index.entities(ids)) == rows(packages.entities.filter(F.col("id").isin([i for i in ids if i]))), ids
        assert rows(index.properties(ids)) == rows(packages.properties.filter(F.col("id").isin([i for i in ids if i]))), ids
    assert rows(index.first_entity("./")) == rows(lookup.first_entity(packages.entities, "./"))
    for needle in ("vc7", "3", "no"):
        assert rows(index.entities_with_value(needle)) == rows(lookup.entities_with_value(packages.properties, needle)), needle
    one = index.entities(["#e é 7"])
    assert len(one.inputFiles()) <= 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "key_hash" in plan.split("PushedFilters")[1].split("]")[0]
    # An id that a third of all rows have is spread over files.
    assert 4 <= len(index.entities(["./"]).inputFiles()) <= 8
    with pytest.raises(ValueError, match="keys"):
        index.entities([str(i) for i in range(clustered.MOST_KEYS + 1)])


def test_empty_tables_are_looked_up(spark, packages, tmp_path):
    none = Packages(packages.crates, packages.context_items, packages.entities.filter("false"), packages.properties.filter("false"))
    index = clustered.PackageIndex.write(none, str(tmp_path / "none"), files=4)
    assert index.entities(["./"]).isEmpty() and index.entities_with_value("x").isEmpty()


def test_only_tables_that_are_looked_up_are_written(spark, packages, tmp_path):
    bare = packages.with_tables(properties=None)
    index = clustered.PackageIndex.write(bare, str(tmp_path / "e"), files=4, tables=("entities",))
    assert rows(index.entities(["#e é 7"])) == rows(packages.entities.filter("id = '#e é 7'"))
    index = clustered.PackageIndex.write(packages, str(tmp_path / "v"), files=4, tables=("values",))
    assert rows(index.entities_with_value("vc7")) == rows(lookup.entities_with_value(packages.properties, "vc7"))
    assert [x.name for x in sorted((tmp_path / "v").iterdir())] == ["values"]
    assert "owner" not in spark.read.parquet(str(tmp_path / "v" / "values" / "rows")).columns
