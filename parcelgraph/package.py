"""One package at hand: a thin face over the tables for interactive use.

Everything is kept as tables; methods that edit give a new Package.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.operators import edit, edit_log, frame, lookup, rdf, validate
from parcelgraph.plans.storage import written
from parcelgraph.plans.tables import Packages
from parcelgraph.sources import packages as sources
from parcelgraph.sources import sinks


class NotReadable(OSError):
    """A document that isn't a package."""


class Package:
    def __init__(self, tables: Packages, crate_id: str) -> None:
        self.tables, self.crate_id = tables, crate_id

    def _with(self, **tables: DataFrame) -> Package:
        """A package with these tables, written so that edits don't pile up in one plan."""
        return Package(self.tables.with_tables(**{k: written(v) for k, v in tables.items()}), self.crate_id)

    @staticmethod
    def _checked(tables: Packages, crate_id: str | None, level: int, terms: DataFrame | None) -> Package:
        bad = tables.rejects.limit(1).collect()
        if bad:
            raise NotReadable(f"{bad[0]['crate_id']}: {bad[0]['reason']}")
        out = Package(tables, crate_id or tables.crates.first()["crate_id"])
        if level and terms is not None:
            validate.enforce(out.validate(terms), level)
        return out

    @classmethod
    def read(cls, spark: SparkSession, path: str, level: int = 0, terms: DataFrame | None = None) -> Package:
        return cls._checked(sources.parse(sources.read_texts(spark, path)), None, level, terms)

    @classmethod
    def read_object(cls, spark: SparkSession, text: str, level: int = 0, terms: DataFrame | None = None) -> Package:
        return cls._checked(sources.parse(sources.from_texts(spark, {"object": text})), "object", level, terms)

    @classmethod
    def read_zip(cls, spark: SparkSession, path: str, level: int = 0, terms: DataFrame | None = None) -> Package:
        return cls._checked(sources.parse(sources.read_zips(spark, path)), None, level, terms)

    @classmethod
    def default(cls, spark: SparkSession, now: str) -> Package:
        return cls(sources.default_package(spark, "object", now), "object")

    def validate(self, terms: DataFrame) -> DataFrame:
        t = self.tables
        return validate.validation_report(t.crates, t.entities, t.properties, t.context_items, terms)

    @staticmethod
    def report(spark: SparkSession, terms: DataFrame, path: str | None = None, text: str | None = None) -> dict:
        """Validation as a dict: is_valid, invalid_keys, invalid_ids, invalid_types, error_type, error_message; what can't be read has an error_type."""
        out = {"is_valid": False, "invalid_keys": [], "invalid_ids": [], "invalid_types": [], "error_type": None, "error_message": None}
        try:
            if text is not None:
                package = Package.read_object(spark, text)
            else:
                package = Package.read_zip(spark, path) if path.endswith(".zip") else Package.read(spark, path)
        except NotReadable as e:
            return out | {"error_type": "JsonError", "error_message": str(e)}
        except AnalysisException as e:
            return out | {"error_type": "IoError", "error_message": str(e)}
        row = package.validate(terms).first()
        if row["status"] == "error":
            return out | {"error_type": "SchemaError", "error_message": "the context names no known version"}
        return out | {"is_valid": row["status"] == "valid"} | {k: row[k] for k in ("invalid_keys", "invalid_ids", "invalid_types")}

    def contexts(self) -> list[str]:
        """The context's references and the values of its embedded terms."""
        return [r["value"] for r in lookup.all_context(self.tables.context_items).orderBy("pos", "value").collect()]

    def context_value(self, key: str) -> str | None:
        row = lookup.context_value(self.tables.context_items, key).first()
        return row["value"] if row else None

    def urn_uuid(self) -> str | None:
        return self.tables.crates.select(lookup.urn_uuid(F.col("base")).alias("uuid")).first()["uuid"]

    def set_links(self, id_: str, key: str, targets: list[str], single: bool = False) -> Package:
        """Sets a property of the first entity with the id to a link or a list of links."""
        t = self.tables
        value = {"@id": targets[0]} if single else [{"@id": x} for x in targets]
        doc = t.entities.sparkSession.createDataFrame([(self.crate_id, id_, json.dumps({key: value}))], "crate_id string, id string, text string")
        rows = sources.flatten(doc.select("crate_id", F.lit(0).alias("pos"), "id", F.lit("contextual").alias("kind"), F.parse_json("text").alias("doc"))).filter("depth = 0")
        return self._with(properties=edit.set_property(t.entities, t.properties, rows.drop("pos")))

    def remove_field(self, id_: str, key: str) -> Package:
        gone = self.tables.entities.sparkSession.createDataFrame([(self.crate_id, id_, key)], "crate_id string, id string, key string")
        return self._with(properties=edit.remove_property(self.tables.entities, self.tables.properties, gone))

    def apply(self, edits: DataFrame) -> Package:
        """The package after a log of edits (``edit_log.EDITS``, whose ``crate_id`` doesn't count)."""
        edits = edits.withColumn("crate_id", F.lit(self.crate_id)).select(*(c.split(" ")[0] for c in edit_log.EDITS.split(", ")))
        entities, properties = edit_log.apply_edits(self.tables.entities, self.tables.properties, edits)
        return self._with(entities=entities, properties=properties)

    def set_values(self, id_: str, values: list[tuple[str, str, str]]) -> Package:
        """Sets properties, each a key, a type of ``edit_log.VALUE_TYPES`` and a text; raises if a text isn't of its type."""
        rows = [(self.crate_id, n, id_, *v) for n, v in enumerate(values)]
        edits = edit_log.typed_edits(self.tables.entities.sparkSession.createDataFrame(rows, "crate_id string, seq bigint, id string, key string, type string, text string"))
        bad = edit_log.bad_edits(edits).orderBy("seq").first()
        if bad:
            raise ValueError(f"{values[bad['seq']]}: {bad['reason']}")
        return self.apply(edits)

    def add_context(self, references: list[str], terms: dict[str, str]) -> Package:
        """References and, as one embedded context, terms behind the package's own context."""
        rows = [(self.crate_id, "reference", None, r) for r in references] + [(self.crate_id, "embedded", k, v) for k, v in terms.items()]
        new = self.tables.entities.sparkSession.createDataFrame(rows, "crate_id string, kind string, key string, value string")
        return self._with(context_items=edit.add_context(self.tables.context_items, new))

    def append(self, id_: str, type_: str) -> Package:
        """Appends a data entity, whether or not there is one with the id."""
        t, spark = self.tables, self.tables.entities.sparkSession
        last = t.entities.agg(F.max("pos")).first()[0]
        new = spark.createDataFrame([(self.crate_id, -1 if last is None else last, id_, "data", [type_], False)], "crate_id string, pos int, id string, kind string, types array<string>, types_is_array boolean")
        return self._with(entities=t.entities.unionByName(new.withColumn("pos", F.col("pos") + 1)))

    def get_entity(self, id_: str) -> dict | None:
        """The first entity with the id as a dict, ``id`` and ``type`` without ``@``."""
        for entity in self._entities(self.tables.entities.filter(F.col("id") == id_)):
            return entity
        return None

    def to_list(self) -> list[dict]:
        return list(self._entities(self.tables.entities))

    def _entities(self, which: DataFrame) -> Iterator[dict]:
        one = self.tables.with_tables(entities=which, properties=self.tables.properties.join(which.select("crate_id", "pos"), ["crate_id", "pos"], "left_semi"))
        for row in sinks.documents(one, indent=None).collect():
            for entity in json.loads(row["text"])["@graph"]:
                yield {{"@id": "id", "@type": "type"}.get(k, k): v for k, v in entity.items()}

    def update(self, entity: dict) -> Package:
        """Replaces the first entity with this id, or appends it."""
        doc = {{"id": "@id", "type": "@type"}.get(k, k): "None" if v is None else v for k, v in entity.items()}
        spark, t = self.tables.entities.sparkSession, self.tables
        types = doc["@type"] if isinstance(doc["@type"], list) else [doc["@type"]]
        new = spark.createDataFrame([(self.crate_id, doc["@id"], types, isinstance(doc["@type"], list))], "crate_id string, id string, types array<string>, types_is_array boolean")
        new = new.withColumn("kind", sources.kind(F.col("id"), F.col("types")))
        entities = written(edit.upsert(t.entities, new))
        placed = entities.filter(F.col("id") == doc["@id"]).orderBy("pos").limit(1)
        text = spark.createDataFrame([(json.dumps(doc),)], "text string").select(F.parse_json("text").alias("doc"))
        rows = sources.flatten(placed.select("crate_id", "pos", "id", "kind").crossJoin(text))  # one row and one row
        kept = t.properties.join(placed.select("crate_id", "pos"), ["crate_id", "pos"], "left_anti")
        return self._with(entities=entities, properties=kept.unionByName(rows))

    def delete_entity(self, id_: str, recursive: bool = False) -> Package:
        gone = self.tables.entities.sparkSession.createDataFrame([(self.crate_id, id_)], "crate_id string, id string")
        rows = self.tables.properties.join(gone, ["crate_id", "id"], "left_anti").select(*self.tables.properties.columns)
        return self._with(entities=edit.remove(self.tables.entities, gone), properties=edit.remove_links(rows, gone) if recursive else rows)

    def replace_id(self, old: str, new: str) -> Package:
        names = self.tables.entities.sparkSession.createDataFrame([(self.crate_id, old, new)], "crate_id string, old string, new string")
        entities, properties = edit.rename(self.tables.entities, self.tables.properties, names)
        return self._with(entities=entities, properties=properties)

    def prefix_ids(self, root: str) -> Package:
        entities, properties = edit.to_object_store(self.tables.entities, self.tables.properties, root)
        return self._with(entities=entities, properties=properties)

    def add_urn_uuid(self, uuid: str) -> Package:
        uuids = self.tables.entities.sparkSession.createDataFrame([(self.crate_id, uuid)], "crate_id string, uuid string")
        items = edit.add_urn_uuid(self.tables.context_items, uuids)
        base = items.filter("key = '@base'").groupBy("crate_id").agg(F.min_by("value", "pos").alias("base"))
        crates = self.tables.crates.drop("base").join(base, "crate_id", "left")
        return self._with(context_items=items, crates=crates)

    def archive(self, root: str, folder: str, flatten: bool = False) -> DataFrame:
        """Writes a zip of the metadata and all files below ``root`` to ``folder``; ids that are paths of files become their names in it."""
        spark = self.tables.entities.sparkSession
        files = sinks.listed_files(spark, spark.createDataFrame([(self.crate_id, root)], "crate_id string, root string"))
        plan = written(sinks.archive_plan(files, flatten))
        names = sinks.archived_ids(self.tables.entities, plan)
        entities, properties = edit.rename(self.tables.entities, self.tables.properties, names)
        return sinks.write_zips(sinks.documents(self._with(entities=entities, properties=properties).tables), plan, folder)

    def frame(self) -> DataFrame:
        t = self.tables
        return frame.eav_frame(t.crates, t.context_items, t.entities, t.properties)

    def triples(self, terms: DataFrame, base: str | None = None, strict: bool = True, contexts: DataFrame | None = None) -> DataFrame:
        t = self.tables
        return rdf.export_triples(t.crates, t.entities, t.properties, terms, base, strict, t.context_items, contexts)

    def links(self) -> DataFrame:
        return lookup.edges(self.tables.properties)

    def text(self, indent: int | None = 2) -> str:
        return sinks.documents(self.tables, indent).first()["text"]

    def __repr__(self) -> str:
        return f"Package({self.crate_id})"
