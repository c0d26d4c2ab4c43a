"""Packages whose one document is too large for a task: its entities are found by position and parsed in parallel.

A document is read in pieces that end at a closing brace, wherever that is.  How
many quotes precede a piece says whether it begins inside a text; how many brackets
outside of texts precede it says how deep.  Where ``@graph`` begins and the depth
comes back to it, an entity ends, and the pieces between two ends are one entity.
What is left without the entities is a small document with the package's context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.functions.links import let
from parcelgraph.plans.storage import written
from parcelgraph.plans.tables import Packages
from parcelgraph.sources.ordered import read_pieces, with_sums_before
from parcelgraph.sources.packages import parse_parts, tolerant_json

_GRAPH = r'"@graph"\s*:\s*\['
#: Stands for the key of the graph once texts are gone.
_MARK = "\x01"
_PLACE = F.struct  # (block, n): places compare in a file's order


def _outside(unescaped: Column, in_text: bool) -> Column:
    """What of a piece without escapes lies outside of texts, given where it begins."""
    first = F.regexp_replace(unescaped, r'^[^"]*+("|$)', "") if in_text else unescaped
    return F.regexp_replace(F.replace(first, F.lit('"@graph"'), F.lit(_MARK)), r'"[^"]*+("|$)', "")


def _depth(outside: Column) -> Column:
    """By how much brackets lead down."""
    count = lambda chars: F.length(outside) - F.length(F.translate(outside, chars, ""))
    return count("{[") - count("}]")


def _levels(pieces: DataFrame) -> DataFrame:
    """Adds to pieces of a document: in_text (whether it begins in one), depth (where it begins), after (where it ends, its brace counted if it is one) and starts (whether the graph begins in it)."""
    unescaped = F.regexp_replace("piece", r"(?s)\\.", "")
    quotes = F.length(unescaped) - F.length(F.replace(unescaped, F.lit('"'), F.lit("")))

    def ways(text: Column) -> Column:
        """For either way to begin: the change of depth, and of that the part before the graph's key; null where it isn't there."""
        key = F.regexp_extract(text, rf"^([^{_MARK}]*){_MARK}\s*:\s*\[", 1)
        return F.struct(_depth(text).alias("change"), F.when(text.rlike(rf"^[^{_MARK}]*{_MARK}\s*:\s*\["), _depth(key)).alias("to_key"))

    rows = pieces.withColumn("seen", let(unescaped, lambda u: F.struct(let(_outside(u, False), ways).alias("even"), let(_outside(u, True), ways).alias("odd")))).withColumn("quotes", quotes)
    rows = with_sums_before(written(rows), before=F.col("quotes"))
    in_text = F.col("before") % 2 == 1
    closes = ((F.col("before") + F.col("quotes")) % 2 == 0).cast("int")
    own = F.when(in_text, F.col("seen.odd")).otherwise(F.col("seen.even"))
    rows = rows.withColumns({"in_text": in_text, "own": own, "closes": closes}).drop("seen", "before", "quotes")
    rows = rows.withColumn("change", F.col("own.change") - F.col("closes"))
    rows = with_sums_before(rows, depth=F.col("change"))
    return rows.withColumns({"after": F.col("depth") + F.col("change"), "starts": F.coalesce(F.col("depth") + F.col("own.to_key") == 1, F.lit(False))}).drop("own", "change")


def document_parts(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pieces (crate_id, size, block, n, piece) of documents: (crate_id, rest, whole) and (crate_id, pos, text).

    ``rest`` is a document without its entities, ``whole`` whether its brackets and
    quotes match, and ``text`` each entity's JSON by its position in the graph.
    """
    rows = written(_levels(pieces).filter(~((F.col("depth") == 0) & F.trim(F.translate("piece", "\n\r\t", "   ")).isin("") & (F.col("closes") == 1))))
    place = _PLACE("block", "n")
    begin = rows.filter("starts").groupBy("crate_id").agg(F.min(place).alias("begin"))
    split = F.split("piece", _GRAPH, 2)
    rows = rows.join(begin, "crate_id", "left").withColumn("at_begin", F.coalesce(place == F.col("begin"), F.lit(False)))
    rows = rows.withColumn("inner", F.when(F.col("at_begin"), F.element_at(split, 2)).when(place > F.col("begin"), F.col("piece")))
    level = (F.col("depth") == 2) & ~F.col("in_text") | F.col("at_begin")  # between entities
    ended = rows.filter(level & F.col("inner").rlike(r"^\s*\]")).groupBy("crate_id").agg(F.min(place).alias("end"))
    rows = rows.join(ended, "crate_id", "left")
    in_graph = F.col("inner").isNotNull() & F.coalesce(place < F.col("end"), F.lit(True))
    rows = rows.withColumn("in_graph", in_graph)
    last = F.col("in_graph") & (F.col("after") == 2) & (F.col("closes") == 1)
    rows = written(with_sums_before(rows, pos=last.cast("int")))
    texts = rows.filter("in_graph").groupBy("crate_id", "pos").agg(F.sort_array(F.collect_list(F.struct("block", "n", F.concat("inner", F.lit("}")).alias("t")))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: x["t"]), "")
    entities = texts.select("crate_id", F.col("pos").cast("int").alias("pos"), F.regexp_replace(joined, r"^\s*,", "").alias("text"), (F.col("pos") > 0).alias("later"), joined.rlike(r"^\s*,").alias("comma"))
    # A comma stands before every entity but the first.
    entities = entities.select("crate_id", "pos", F.when(F.col("later") == F.col("comma"), F.col("text")).alias("text"))
    head = F.concat(F.element_at(split, 1), F.lit('"@graph":['))
    outer = F.when(F.col("in_graph"), F.when(F.col("at_begin"), head)).when(F.col("at_begin"), F.concat(head, "inner", F.lit("}"))).otherwise(F.concat("piece", F.lit("}")))
    rest = rows.select("crate_id", "size", "block", "n", "after", outer.alias("t"), (F.octet_length("piece") + 1).alias("bytes"), F.when(F.col("closes") == 0, 1).otherwise(0).alias("open"))
    rest = rest.groupBy("crate_id").agg(F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("block", "n", "t")))).alias("all"), F.max_by(F.struct("after", "open"), _PLACE("block", "n")).alias("end"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    whole = (F.col("end.after") == 0) & (F.col("end.open") == 0) & (F.col("bytes") <= F.col("size"))  # one byte more is a last brace that isn't there
    return rest.select("crate_id", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("rest"), whole.alias("whole")), entities


def read_large(spark: SparkSession, paths: str | list[str]) -> Packages:
    """The packages of JSON files of any size, a document a file: as ``parse`` gives them, but no task holds a document.

    An entity, and what a document holds beside its graph, must fit a row.  A
    document whose brackets don't match, or one of whose entities isn't JSON, is rejected.
    """
    rest, entities = document_parts(read_pieces(spark, paths, "}"))
    entities = written(entities.withColumn("doc", F.expr(tolerant_json("text"))).drop("text"))
    broken = entities.filter("doc IS NULL").select("crate_id").distinct().withColumn("broken", F.lit(True))
    docs = rest.join(broken, "crate_id", "left").select("crate_id", F.col("crate_id").alias("source"), F.expr(f"CASE WHEN whole AND broken IS NULL THEN {tolerant_json('rest')} END").alias("v"))
    return parse_parts(written(docs), entities.filter("doc IS NOT NULL"))
