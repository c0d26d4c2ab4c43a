"""Command line: ``python -m parcelgraph read fields PATH KEY`` and the like."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.operators import counts, edit_log, validate
from parcelgraph.package import Package


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parcelgraph")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, names in {
        "init": ("out",), "add": ("path", "id", "type", "out"), "delete": ("path", "id", "out"), "rename": ("path", "old", "new", "out"), "crate": ("path",), "entity": ("path", "id"),
        "fields": ("path", "key"), "value": ("path", "text"), "validate": ("path", "vocabulary"), "frame": ("path", "uuid", "out"),
        "add-id-value": ("path", "id", "key", "value", "out"), "add-id-vec-values": ("path", "id", "key", "values", "out"), "remove-field": ("path", "id", "key", "out"), "add-multiple": ("path", "id", "out"), "edit": ("path", "log", "out"), "zip": ("path", "root", "uuid", "out"),
    }.items():
        p = verbs.add_parser(verb)
        for name in names:
            p.add_argument(name, **({"type": lambda x: x.split(",")} if name == "values" else {}))
        if verb == "init":
            p.add_argument("--reference", action="append", default=[], help="another context's URL")
            p.add_argument("--term", nargs=2, action="append", default=[], metavar=("NAME", "IRI"))
        if verb == "add-multiple":
            p.add_argument("--set", nargs=3, action="append", required=True, metavar=("KEY", "TYPE", "VALUE"), help=f"types: {', '.join(edit_log.VALUE_TYPES)}")
    return top


def _show(rows: DataFrame) -> None:
    """Every row, a line each; rows come to the driver a partition at a time."""
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join(map(str, row)))


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("parcelgraph").getOrCreate()

    def load() -> Package:
        return Package.read_zip(spark, a.path) if a.path.endswith(".zip") else Package.read(spark, a.path)

    def save(package: Package) -> None:
        if a.path.endswith(".zip"):
            raise SystemExit("archives are not changed")
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(package.text())

    match a.verb:
        case "init":
            with open(a.out, "w", encoding="utf-8") as f:
                new = Package.default(spark, spark.range(1).select(F.current_timestamp().cast("string")).first()[0])
                f.write((new.add_context(a.reference, dict(a.term)) if a.reference or a.term else new).text())
        case "add":
            save(load().append(a.id, a.type))
        case "delete":
            save(load().delete_entity(a.id, recursive=True))
        case "rename":
            save(load().replace_id(a.old, a.new))
        case "crate":
            print(load().text())
        case "entity":
            print(load().get_entity(a.id))
        case "fields":
            _show(counts.field_value_counts(load().tables.properties, a.key))
        case "value":
            _show(counts.value_search_counts(load().tables.properties, a.text))
        case "validate":
            terms = validate.vocabulary(spark, {"1.1": a.vocabulary, "1.2": a.vocabulary})
            _show(validate.enforce(load().validate(terms), 2))
        case "add-id-value":
            save(load().set_links(a.id, a.key, [a.value], single=True))
        case "add-id-vec-values":
            save(load().set_links(a.id, a.key, a.values))
        case "remove-field":
            save(load().remove_field(a.id, a.key))
        case "add-multiple":
            save(load().set_values(a.id, [tuple(v) for v in a.set]))
        case "edit":
            save(load().apply(spark.read.schema(edit_log.EDITS).json(a.log, mode="FAILFAST")))
        case "zip":
            _show(load().add_urn_uuid(a.uuid).archive(a.root, a.out))
        case "frame":
            load().add_urn_uuid(a.uuid).frame().write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
