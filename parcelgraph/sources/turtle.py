"""Turtle read by many tasks: lines, then tokens, then statements, each a table.

Statements and long texts span lines, so what a line means depends on what lies
before it.  For a line with long quotes it is worked out in which state it ends for
each state in which it may begin; such maps are composed in order, over 256 lines,
over blocks and over files, which tells each line's true state.  Tokens are numbered
by the full stops before them, which are statements, and within a statement
brackets make groups; windows over a group find its subject, verbs and objects.
Prefixes and bases are a small table of the stretches in which they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelgraph.functions.links import is_absolute_iri, let, resolved
from parcelgraph.operators.rdf import RDF_TYPE, XSD, unescaped
from parcelgraph.plans.storage import written
from parcelgraph.sources.ordered import read_pieces, with_sums_before

#: Lines whose states are composed in one row.
CHUNK_LINES = 256

# The tokens of Turtle, and the vocabulary of lists.
_LONG, _LONG_SINGLE = r'"""(?:[^"\\]|\\.|"(?!""))*+"""', r"'''(?:[^'\\]|\\.|'(?!''))*+'''"
_SHORT, _SHORT_SINGLE = r'"(?:[^"\\\r\n]|\\.)*+"', r"'(?:[^'\\\r\n]|\\.)*+'"
_IRI = r'<(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+>'
_COMMENT = r"#[^\r\n]*+"
_PREFIX = r"(?:\p{L}(?:[\p{L}\p{N}_\-·]|\.(?=\.*[\p{L}\p{N}_\-·]))*+)?"
_LOCAL_CHAR = r"[\p{L}\p{N}_:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_NAME = rf"{_PREFIX}:(?:{_LOCAL_CHAR}|\.(?=\.*(?:{_LOCAL_CHAR})))*+"
_STRING = f"(?:{_LONG}|{_LONG_SINGLE}|{_SHORT}|{_SHORT_SINGLE})"
_LITERAL = rf"{_STRING}(?:\s*\^\^\s*(?:{_IRI}|{_NAME})|@[A-Za-z]+(?:-[A-Za-z0-9]+)*+)?"
_BLANK = r"_:[\p{L}\p{N}_](?:[\p{L}\p{N}_\-·]|\.(?=\.*[\p{L}\p{N}_\-·]))*+"
_NUMBER = r"[+\-]?(?:[0-9]+\.[0-9]*[eE][+\-]?[0-9]+|\.?[0-9]+[eE][+\-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)"
_SPARQL = rf"(?i:prefix)\s+{_PREFIX}:\s*{_IRI}|(?i:base)\s+{_IRI}"
_TOKEN = rf"(?s){_COMMENT}|{_LITERAL}|{_IRI}|{_SPARQL}|@prefix\b|@base\b|{_BLANK}|\[\s*\]|{_NAME}|{_NUMBER}|(?:true|false|a)(?![\p{{L}}\p{{N}}_:\-])|[.;,\[\]()]"
#: What may hide a long quote, then the open ones.
_SCAN = rf"(?s){_LONG}|{_LONG_SINGLE}|(\"\"\".*)|('''.*)|{_SHORT}|{_SHORT_SINGLE}|{_IRI}|\\.|{_COMMENT}"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_NORMAL, _DOUBLE, _SINGLE = 0, 1, 2
_SAME = (_NORMAL, _DOUBLE, _SINGLE)


def _end_of_normal(line: Column) -> Column:
    """The state in which a line ends that begins outside of texts."""
    left_open = lambda group: F.exists(F.regexp_extract_all(line, F.lit(_SCAN), F.lit(group)), lambda x: x != "")
    return F.when(left_open(1), _DOUBLE).when(left_open(2), _SINGLE).otherwise(_NORMAL)


def _ends(line: Column) -> Column:
    """The states in which a line ends, by the state in which it begins."""
    ways = [_end_of_normal(line)]
    for state, inside in ((_DOUBLE, r'^(?:[^"\\]|\\.|"(?!""))*+"""'), (_SINGLE, r"^(?:[^'\\]|\\.|'(?!''))*+'''")):
        ways.append(F.when(line.rlike(f"(?s){inside}"), let(F.regexp_replace(line, f"(?s){inside}", ""), _end_of_normal)).otherwise(state))
    return F.array(*ways)


def _composed(maps: Column) -> Column:
    """One map from maps in order."""
    return F.aggregate(maps, F.array(*map(F.lit, _SAME)), lambda done, m: F.transform(done, lambda state: F.get(m, state)))


def _starts(maps: Column, first: Column) -> Column:
    """The state before each of maps in order, as long an array."""
    begin = F.struct(first.cast("int").alias("now"), F.array().cast("array<int>").alias("met"))
    return F.aggregate(maps, begin, lambda a, m: F.struct(F.get(m, a["now"]).alias("now"), F.concat(a["met"], F.array(a["now"])).alias("met")), lambda a: a["met"])


def _line_states(lines: DataFrame) -> DataFrame:
    """crate_id, block, n, state: how lines with long quotes begin."""
    marked = lines.filter(F.col("piece").contains('"""') | F.col("piece").contains("'''"))
    marked = written(marked.select("crate_id", "block", "n", _ends(F.col("piece")).alias("map")).withColumn("chunk", F.floor(F.col("n") / CHUNK_LINES)))

    def level(rows: DataFrame, home: list[str], by: str) -> DataFrame:
        return rows.groupBy(*home).agg(F.sort_array(F.collect_list(F.struct(by, "map"))).alias("all")).withColumn("map", _composed(F.col("all.map")))

    def down(rows: DataFrame, home: list[str], by: str) -> DataFrame:
        """A row for each member of rows, with the state before it."""
        return rows.withColumn("x", F.explode(F.arrays_zip(F.col(f"all.{by}").alias("at"), _starts(F.col("all.map"), F.col("state")).alias("state")))).select(*home, F.col("x.at").alias(by), F.col("x.state").alias("state"))

    chunks = written(level(marked, ["crate_id", "block", "chunk"], "n"))
    blocks = written(level(chunks.select("crate_id", "block", "chunk", "map"), ["crate_id", "block"], "chunk"))
    files = level(blocks.select("crate_id", "block", "map"), ["crate_id"], "block").withColumn("state", F.lit(_NORMAL))
    of_blocks = down(files, ["crate_id"], "block")
    of_chunks = down(blocks.join(of_blocks, ["crate_id", "block"]), ["crate_id", "block"], "chunk")
    return down(chunks.join(of_chunks, ["crate_id", "block", "chunk"]), ["crate_id", "block"], "n")


def _whole_lines(lines: DataFrame) -> DataFrame:
    """Lines as crate_id, block, n, text, those that a long text joins as one."""
    states = _line_states(lines)
    if states.isEmpty():
        return lines.select("crate_id", "block", "n", F.col("piece").alias("text"))
    known = lines.join(states, ["crate_id", "block", "n"], "left")
    # A line without long quotes begins as the last line with some ends.
    ends = F.when(F.col("state").isNotNull(), F.get(_ends(F.col("piece")), F.col("state")))
    known = written(known.withColumn("ends", ends))
    inside = Window.partitionBy("crate_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = known.filter("ends IS NOT NULL").groupBy("crate_id", "block").agg(F.max_by("ends", "n").alias("left"))
    blocks = Window.partitionBy("crate_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = known.select("crate_id", "block").distinct().join(last, ["crate_id", "block"], "left")
    entered = every.select("crate_id", "block", F.coalesce(F.last("left", ignorenulls=True).over(blocks), F.lit(_NORMAL)).alias("entered"))
    rows = known.join(entered, ["crate_id", "block"]).withColumn("begins", F.coalesce("state", F.last("ends", ignorenulls=True).over(inside), "entered"))
    rows = rows.withColumn("ends", F.coalesce("ends", "begins"))
    alone = rows.filter(f"begins = {_NORMAL} AND ends = {_NORMAL}").select("crate_id", "block", "n", F.col("piece").alias("text"))
    joined = with_sums_before(rows.filter(f"begins <> {_NORMAL} OR ends <> {_NORMAL}").drop("entered"), group=(F.col("begins") == _NORMAL).cast("int"))
    joined = joined.withColumn("group", F.col("group") + (F.col("begins") == _NORMAL).cast("int")).groupBy("crate_id", "group").agg(F.sort_array(F.collect_list(F.struct("block", "n", "piece"))).alias("all"))
    first = F.element_at("all", 1)
    return alone.unionByName(joined.select("crate_id", first["block"].alias("block"), first["n"].alias("n"), F.array_join(F.transform("all", lambda x: x["piece"]), "\n").alias("text")))


def _tokens(lines: DataFrame) -> DataFrame:
    """crate_id, stmt, block, n, k, token: the tokens in order with the number of the statement; ``token`` is null, and ``bad`` set, for a line with something else in it."""
    text = F.col("text")
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, _TOKEN, " "), r"[\s﻿]+", " "))
    found = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.startswith("#"))
    bad = F.when(rest != "", F.concat(F.lit("not Turtle: "), rest))
    rows = lines.select("crate_id", "block", "n", F.posexplode(F.when(rest != "", F.array(F.lit(None).cast("string"))).otherwise(found)).alias("k", "token"), bad.alias("bad"))
    ends = F.coalesce((F.col("token") == ".") | F.col("token").rlike(r"(?i)^(prefix|base)\s"), F.lit(False))
    return with_sums_before(written(rows), order=("n", "k"), stmt=ends.cast("int"))


def _stretches(directives: DataFrame, base: str | None) -> tuple[DataFrame, DataFrame]:
    """(crate_id, prefix, since, until, ns) and (crate_id, since, until, base) of (crate_id, stmt, prefix (null for a base), iri).

    Directives of a file are worked through in order, as a base may be relative to the one before.
    """
    now = F.lit(base).cast("string")
    absolute = lambda a, iri: F.when(is_absolute_iri(iri) | a["base"].isNull(), iri).otherwise(resolved(a["base"], iri))
    kind = "array<struct<stmt: bigint, prefix: string, iri: string>>"
    begin = F.struct(now.alias("base"), F.array().cast(kind).alias("done"))

    def step(a: Column, x: Column) -> Column:
        iri = absolute(a, x["iri"])
        return F.struct(F.when(x["prefix"].isNull(), iri).otherwise(a["base"]).alias("base"), F.concat(a["done"], F.array(F.struct(x["stmt"].alias("stmt"), x["prefix"].alias("prefix"), iri.alias("iri")))).alias("done"))

    listed = directives.groupBy("crate_id").agg(F.sort_array(F.collect_list(F.struct("stmt", "prefix", "iri"))).alias("all"))
    done = written(listed.select("crate_id", F.explode(F.aggregate("all", begin, step)["done"]).alias("d")).select("crate_id", "d.*"))
    until = lambda *home: F.coalesce(F.lead("stmt").over(Window.partitionBy(*home).orderBy("stmt")), F.lit((1 << 63) - 1))
    spaces = done.filter("prefix IS NOT NULL").select("crate_id", "prefix", F.col("stmt").alias("since"), until("crate_id", "prefix").alias("until"), F.col("iri").alias("ns"))
    bases = done.filter("prefix IS NULL").select("crate_id", F.col("stmt").alias("since"), until("crate_id").alias("until"), F.col("iri").alias("base"))
    return spaces, bases


def _inside(token: Column) -> Column:
    """What stands between a literal's quotes."""
    string = F.regexp_extract(token, f"(?s)^({_STRING})", 1)
    return let(string, lambda s: let(F.when(s.startswith('"""') | s.startswith("'''"), 3).otherwise(1), lambda n: s.substr(n + 1, F.length(s) - 2 * n)))


def _typed_tokens(tokens: DataFrame, base: str | None) -> DataFrame:
    """Tokens of statements without the directives' and full stops, as crate_id, stmt, i, token, kind, value, datatype, lang, bad."""
    order = Window.partitionBy("crate_id", "stmt").orderBy("block", "n", "k")
    numbered = tokens.withColumn("i", F.row_number().over(order) - 1).withColumn("head", F.first("token").over(order))
    rows = written(numbered.drop("block", "n", "k"))
    is_directive = F.coalesce(F.col("head").rlike(r"(?i)^(@prefix|@base|prefix\s|base\s)"), F.lit(False))
    part = lambda i: F.max(F.when(F.col("i") == i, F.col("token")))
    said = rows.filter(is_directive).groupBy("crate_id", "stmt").agg(F.max("head").alias("head"), part(1).alias("one"), part(2).alias("two"))
    sparql, of_prefix = ~F.col("head").startswith("@"), F.col("head").rlike("(?i)^@?prefix")
    prefix = F.when(of_prefix, F.when(sparql, F.regexp_extract("head", rf"(?i)^prefix\s+({_PREFIX}):", 1)).otherwise(F.regexp_replace("one", ":$", "")))
    iri = F.when(sparql, F.regexp_extract("head", rf"({_IRI})$", 1)).when(of_prefix, F.col("two")).otherwise(F.col("one"))
    said = said.select("crate_id", "stmt", prefix.alias("prefix"), iri.alias("iri")).withColumn("iri", unescaped(F.substring("iri", F.lit(2), F.length("iri") - 2)))
    spaces, bases = _stretches(said, base)

    rows = rows.filter(~is_directive & F.coalesce(F.col("token") != ".", F.lit(True)))
    token = F.col("token")
    is_literal = token.rlike("^[\"']")
    suffix = F.when(is_literal, F.trim(F.regexp_replace(token, f"(?s)^{_STRING}", "")))
    rows = rows.withColumn("type", F.when(suffix.startswith("^^"), F.trim(F.substring(suffix, F.lit(3), F.length(suffix)))))
    rows = rows.withColumn("lang", F.when(suffix.startswith("@"), F.substring(suffix, F.lit(2), F.length(suffix))))
    named = F.coalesce("type", F.when(~is_literal, token))
    rows = rows.withColumn("name", F.when(~named.startswith("<") & ~named.startswith("_:") & named.contains(":"), named))
    rows = rows.withColumn("ref", F.when(named.startswith("<"), unescaped(F.substring(named, F.lit(2), F.length(named) - 2))))
    rows = rows.withColumn("prefix", F.substring_index("name", ":", 1))
    at = (F.col("t.crate_id") == F.col("d.crate_id")) & (F.col("t.stmt") >= F.col("d.since")) & (F.col("t.stmt") < F.col("d.until"))
    rows = rows.alias("t").join(spaces.alias("d"), at & (F.col("t.prefix") == F.col("d.prefix")), "left").select("t.*", "d.ns")
    rows = rows.alias("t").join(bases.alias("d"), at & F.col("t.ref").isNotNull() & ~is_absolute_iri(F.col("t.ref")), "left").select("t.*", F.coalesce("d.base", F.lit(base)).alias("base"))
    local = F.regexp_replace(F.substring(F.col("name"), F.length("prefix") + 2, F.length("name")), r"\\(.)", "$1")
    iri = F.coalesce(F.concat("ns", local), F.when(is_absolute_iri(F.col("ref")) | F.col("base").isNull(), F.col("ref")).otherwise(resolved(F.col("base"), F.col("ref"))))
    rows = rows.withColumn("iri", iri)
    bad = F.coalesce("bad", F.when(F.col("name").isNotNull() & F.col("ns").isNull(), F.concat(F.lit("unknown prefix: "), "name")))
    number = F.when(token.rlike("[eE]"), "double").when(token.contains("."), "decimal").otherwise("integer")
    is_number, is_bool = token.rlike(r"^[+\-]?\.?[0-9]"), token.isin("true", "false")
    kind = F.when(is_literal | is_number | is_bool, "literal").when(token.rlike(r"^\[\s*\]$"), "anon").when(token.startswith("_:"), "blank").when(token.isin("[", "]", "(", ")", ",", ";"), "mark").otherwise("iri")
    value = F.when(is_literal, unescaped(_inside(token))).when(is_number | is_bool | token.startswith("_:"), token).when(token == "a", RDF_TYPE).otherwise(F.col("iri"))
    datatype = F.when(is_literal, F.col("iri")).when(is_number, F.concat(F.lit(XSD), number)).when(is_bool, f"{XSD}boolean")
    return rows.select("crate_id", "stmt", "i", "token", kind.alias("kind"), value.alias("value"), F.when(F.col("type").isNotNull() | ~is_literal, datatype).alias("datatype"), "lang", bad.alias("bad"))


def _grouped(tokens: DataFrame) -> DataFrame:
    """Adds to tokens the bracket that they stand in (``inside``, its place, -1 for the statement itself), and to brackets the kind of what they open and whether it is empty."""
    home = Window.partitionBy("crate_id", "stmt").orderBy("i")
    opens, closes = F.col("token").isin("[", "("), F.col("token").isin("]", ")")
    step = F.when((F.col("kind") == "mark") & opens, 1).when((F.col("kind") == "mark") & closes, -1).otherwise(0)
    rows = tokens.withColumn("step", step).withColumn("run", F.sum("step").over(home)).withColumn("next", F.lead("token").over(home))
    level = F.when(F.col("step") == 1, F.col("run") - 1).when(F.col("step") == -1, F.col("run") + 1).otherwise(F.col("run"))
    # An opening bracket is a member of what it stands in, and the head of what it opens.
    roles = F.when(F.col("step") == 1, F.array(F.struct(F.lit(False).alias("heads"), level.alias("level")), F.struct(F.lit(True).alias("heads"), F.col("run").alias("level")))).otherwise(F.array(F.struct(F.lit(False).alias("heads"), level.alias("level"))))
    rows = rows.withColumn("role", F.explode(roles)).select("*", "role.*").drop("role")
    at_level = Window.partitionBy("crate_id", "stmt", "level").orderBy("i", F.col("heads").desc())
    head = F.last(F.when(F.col("heads"), F.struct("i", "token")), ignorenulls=True).over(at_level)
    balanced = Window.partitionBy("crate_id", "stmt")
    depth = F.sum(F.when(~F.col("heads"), F.col("step"))).over(balanced)
    rows = rows.withColumns({"head": head, "total": depth, "least": F.min("run").over(balanced)})
    mismatch = (F.col("step") == -1) & (F.col("token") != F.when(F.col("head.token") == "[", "]").otherwise(")"))
    rows = rows.withColumn("mismatch", F.coalesce(mismatch, F.lit(False))).withColumn("mismatch", F.max("mismatch").over(balanced))
    unbalanced = F.when((F.col("total") != 0) | (F.col("least") < 0) | F.col("mismatch"), "brackets don't match")
    rows = rows.filter("NOT heads").withColumns({"inside": F.when(F.col("level") > 0, F.col("head.i")).otherwise(-1), "of": F.when(F.col("level") > 0, F.col("head.token")).otherwise(".")})
    return rows.withColumn("bad", F.coalesce("bad", unbalanced))


def _statements(tokens: DataFrame, strict: bool) -> DataFrame:
    """Triples of typed tokens, with ``bad`` for what isn't one; with ``strict`` that raises."""
    label = lambda place: F.concat(F.lit("_:genid-"), F.substring(F.sha2("crate_id", 256), 1, 32), F.lit("-"), F.col("stmt").cast("string"), F.lit("-"), place.cast("string"))
    rows = _grouped(tokens)
    is_empty_list = (F.col("token") == "(") & (F.col("next") == ")") & (F.col("kind") == "mark")
    opened = (F.col("kind") == "mark") & F.col("token").isin("[", "(")
    value = F.when(F.col("kind") == "anon", label(F.col("i"))).when(is_empty_list, f"{RDF}nil").when(opened & (F.col("token") == "("), F.concat(label(F.col("i")), F.lit("-0"))).when(opened, label(F.col("i"))).otherwise(F.col("value"))
    kind = F.when((F.col("kind") == "anon") | opened & ~is_empty_list, "blank").when(is_empty_list, "iri").otherwise(F.col("kind"))
    rows = rows.withColumns({"value": value, "kind": kind}).filter("NOT (kind = 'mark' AND step = -1)")
    group = ["crate_id", "stmt", "inside"]
    in_order = Window.partitionBy(*group).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"seg": F.sum(F.when((F.col("token") == ";") & (F.col("kind") == "mark"), 1).otherwise(0)).over(in_order), "is_item": F.col("kind") != "mark"})
    before = Window.partitionBy(*group, "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.coalesce(F.sum(F.col("is_item").cast("int")).over(before), F.lit(0))
    rows = rows.withColumns({"nth": nth, "before": F.lag("token").over(Window.partitionBy(*group, "seg").orderBy("i"))})
    has_subject = (F.col("of") == ".") & (F.col("seg") == 0)
    rows = rows.withColumn("rank", F.when(has_subject, F.col("nth")).otherwise(F.col("nth") + 1))  # 0 subject, 1 verb, more objects
    whole = Window.partitionBy(*group)
    at = lambda rank, w: F.max(F.when(F.col("is_item") & (F.col("rank") == rank), F.struct("value", "kind"))).over(w)
    rows = rows.withColumns({"subject": at(0, whole), "verb": at(1, Window.partitionBy(*group, "seg")), "n_items": F.sum(F.col("is_item").cast("int")).over(whole), "most": F.max("rank").over(Window.partitionBy(*group, "seg"))})
    rows = rows.filter("of <> '(' OR is_item")
    s = F.when(F.col("of") == ".", F.col("subject")).otherwise(F.struct(label(F.col("inside")).alias("value"), F.lit("blank").alias("kind")))
    comma = (F.col("token") == ",") & (F.col("kind") == "mark")
    wrong = (
        F.when((F.col("of") == ".") & F.col("subject.kind").isin("literal"), "a subject that is a text").when((F.col("of") != "(") & (F.col("verb.kind") != "iri"), "a verb that is no IRI")
        .when((F.col("of") != "(") & F.col("is_item") & (F.col("rank") > 2) & (F.coalesce(F.col("before"), F.lit("")) != ","), "no comma between objects")
        .when((F.col("of") != "(") & comma & ((F.col("rank") <= 2) | (F.col("before") == ",")), "a comma without an object")
        .when((F.col("of") != "(") & comma & F.lead("token").over(Window.partitionBy(*group).orderBy("i")).isNull(), "a comma without an object")
        .when((F.col("of") != "(") & (F.col("rank") == 1) & F.col("is_item") & (F.col("most") == 1), "a verb without an object")
        .when((F.col("of") == ".") & (F.col("n_items") == 1) & F.col("is_item") & ((F.col("token") != "[") | (F.col("kind") != "blank")), "a subject alone")
    )
    bad = F.coalesce("bad", wrong)
    rows = rows.withColumn("bad", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("statement "), F.col("stmt").cast("string"), F.lit(": "), bad))) if strict else bad)
    node = lambda k: F.concat(label(F.col("inside")), F.lit("-"), k.cast("string"))
    triple = lambda s, sk, p, o, ok, d, l: F.struct(s.alias("s"), sk.alias("s_kind"), p.alias("p"), o.alias("o"), ok.alias("o_kind"), d.cast("string").alias("datatype"), l.cast("string").alias("lang"))  # noqa: E731, E741
    none, iri, blank = F.lit(None), F.lit("iri"), F.lit("blank")
    own = F.array(triple(s["value"], s["kind"], F.col("verb.value"), F.col("value"), F.col("kind"), F.col("datatype"), F.col("lang")))
    k = F.col("nth")
    last = k == F.col("n_items") - 1
    listed = F.array(
        triple(node(k), blank, F.lit(f"{RDF}first"), F.col("value"), F.col("kind"), F.col("datatype"), F.col("lang")),
        triple(node(k), blank, F.lit(f"{RDF}rest"), F.when(last, f"{RDF}nil").otherwise(node(k + 1)), F.when(last, iri).otherwise(blank), none, none),
    )
    made = F.when(F.col("of") == "(", listed).when(F.col("is_item") & (F.col("rank") >= 2), own)
    return rows.select("crate_id", "stmt", "bad", F.explode_outer(made).alias("said")).select("crate_id", "stmt", "bad", "said.*")


def parse_turtle(lines: DataFrame, base: str | None = None, strict: bool = True) -> DataFrame:
    """Triples of lines (crate_id, block, n, piece) of Turtle documents: crate_id, s, s_kind, p, o, o_kind, datatype, lang.

    A document's ``@base`` counts before ``base``.  Blank nodes without a label get
    one of their own; those with one keep it, within the document.  Statements of
    which anything isn't Turtle raise, or without ``strict`` give no triples
    (``malformed_statements`` has them).  A text, and what one statement says, are
    as large as they are; a statement's tokens are sorted by one task.
    """
    rows = _statements(_typed_tokens(_tokens(_whole_lines(lines)), base), strict)
    if strict:
        rows = rows.filter("bad IS NULL")
    else:
        rows = written(rows)
        rows = rows.join(rows.filter("bad IS NOT NULL").select("crate_id", "stmt").distinct(), ["crate_id", "stmt"], "left_anti")
    return rows.filter("s IS NOT NULL").drop("stmt", "bad")


def malformed_statements(lines: DataFrame, base: str | None = None) -> DataFrame:
    """crate_id, stmt (its number, from 0, directives included), reason."""
    return _statements(_typed_tokens(_tokens(_whole_lines(lines)), base), False).filter("bad IS NOT NULL").groupBy("crate_id", "stmt").agg(F.min("bad").alias("reason"))


def read_turtle(spark: SparkSession, paths: str | list[str], base: str | None = None, strict: bool = True) -> DataFrame:
    """Triples of Turtle files, each a document by its path; a large file is read by a task a block."""
    return parse_turtle(read_pieces(spark, paths), base, strict)
