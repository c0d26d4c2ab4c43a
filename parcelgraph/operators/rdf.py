"""Packages to RDF triples and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.functions.links import base_parts, has_relative_component, is_absolute_iri, with_parts
from parcelgraph.functions.values import number_text
from parcelgraph.plans.storage import grown, small, written

# IRIs of the RDF and XML Schema vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
INTEGER_TYPES = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
FLOAT_TYPES = ("double", "float", "decimal")
# Spellings of the types that make an entity a data entity.
DATA_TYPE_SPELLINGS = ("File", "Dataset", "MediaObject", "schema:Dataset", "schema:MediaObject", "http://schema.org/Dataset", "http://schema.org/MediaObject", "https://schema.org/Dataset", "https://schema.org/MediaObject")
# Of terms that share an IRI, the one that compaction takes.
PREFERRED_TERMS = ("File", "Journal", "contentUrl")
# Fixed value: characters that no IRI has (RFC 3987).
NOT_IN_IRI = r"[\x00-\x20<>\"{}|\\^`]"
# What the URLs of the profile's own contexts hold; their terms are the vocabulary.
PROFILE_CONTEXTS = ("ro/crate/1.1", "ro/crate/1.2")
#: Most terms that are broadcast, some 100 bytes each.
BROADCAST_TERMS = 200_000
#: Names of contexts that are broadcast to their triples: those that so many triples have, and at most so many, the most used ones.
COMMON_USES, COMMON_NAMES = 1_000, 50_000


def prefixes(terms: DataFrame) -> DataFrame:
    """version, prefix, ns: terms whose IRI ends in a slash or ``#``."""
    return terms.filter(F.col("iri").rlike("[/#]$")).select("version", F.col("term").alias("prefix"), F.col("iri").alias("ns"))


def _own_terms(context_items: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """crate_id, term, iri of embedded contexts and of references that ``contexts`` (url, term, iri) knows; of two items the later one counts."""
    terms = context_items.filter("kind = 'embedded'").select("crate_id", "pos", F.col("key").alias("term"), F.col("value").alias("iri"))
    if contexts is not None:
        references = context_items.filter("kind = 'reference'").select("crate_id", "pos", F.col("value").alias("url"))
        terms = terms.unionByName(references.join(contexts, "url").select("crate_id", "pos", "term", "iri"))
    return terms.groupBy("crate_id", "term").agg(F.max_by("iri", "pos").alias("iri"))


def unknown_references(context_items: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """crate_id, url: references to contexts that are neither the profile's own nor in ``contexts`` (url, term, iri)."""
    urls = context_items.filter("kind = 'reference'").select("crate_id", F.col("value").alias("url"))
    for own in PROFILE_CONTEXTS:
        urls = urls.filter(~F.col("url").contains(own))
    return (urls if contexts is None else urls.join(contexts.select("url").distinct(), "url", "left_anti")).select("crate_id", "url").distinct()


def package_contexts(crates: DataFrame, context_items: DataFrame | None = None, contexts: DataFrame | None = None, base: str | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages by the context that they share: (crate_id, ctx), (ctx, version, base, vocab), and the contexts' own terms (ctx, term, iri).

    Own terms are those of embedded contexts, and of references that ``contexts``
    (url, term, iri) knows.  ``base`` is for packages without an ``@base``.  With
    ``strict`` a reference that is unknown raises; otherwise its terms are missing.
    A package's terms are together once, to name its context by their digest.
    """
    home = crates.select("crate_id", F.coalesce("schema_version", F.lit("1.2")).alias("version"), F.coalesce("base", F.lit(base)).alias("base"))
    if context_items is None:
        terms = home.select("crate_id", F.lit("").alias("term"), F.lit("").alias("iri")).filter("false")
    else:
        terms = written(_own_terms(context_items, contexts))
        if strict:
            unknown = unknown_references(context_items, contexts).groupBy("crate_id").agg(F.min("url").alias("unknown"))
            refused = F.when(F.col("unknown").isNotNull(), F.raise_error(F.concat(F.lit("unknown context: "), F.col("unknown")))).otherwise(F.col("version"))
            home = home.join(grown(unknown), "crate_id", "left").withColumn("version", refused).drop("unknown")
    said = terms.groupBy("crate_id").agg(F.max(F.when(F.col("term") == "@vocab", F.col("iri"))).alias("vocab"), F.sort_array(F.collect_list(F.struct("term", "iri"))).alias("all"))
    digest = F.sha2(F.to_json(F.struct("version", "base", "all")), 256)
    named = written(home.join(grown(said), "crate_id", "left").select("crate_id", digest.alias("ctx"), "version", "base", "vocab"))
    shared = named.groupBy("ctx").agg(F.min_by(F.struct("version", "base", "vocab"), "crate_id").alias("c"), F.min("crate_id").alias("crate_id"))
    own = terms.filter(~F.col("term").startswith("@")).join(grown(shared.select("crate_id", "ctx")), "crate_id").select("ctx", "term", "iri")
    return named.select("crate_id", "ctx"), shared.select("ctx", "c.*"), own


def expand(names: DataFrame, terms: DataFrame, column: str = "name", out: str = "iri", own: DataFrame | None = None) -> DataFrame:
    """Adds ``out``, the IRI of ``column``, to a table with version, base and vocab: exact term, known prefix, absolute, path against base, vocab, base, else unchanged.

    Terms of ``own`` (ctx, term, iri) count before the vocabulary's, for names with
    that ctx.  Null where a path leads above the base's root.  The vocabulary is
    broadcast if it is small.  ``_parts`` of the names, if they have them, are their
    bases' parts, and stay.
    """
    given = "_parts" in names.columns
    name = F.col(column)
    rows = names.withColumn("_prefix", F.when(name.contains(":"), F.substring_index(name, ":", 1)))
    known = [("version", small(terms, BROADCAST_TERMS).select(F.col("version").alias("_of"), F.col("term").alias("_term"), F.col("iri").alias("_iri")))]
    if own is not None:
        known.insert(0, ("ctx", own.select(F.col("ctx").alias("_of"), F.col("term").alias("_term"), F.col("iri").alias("_iri"))))
    for i, (of, table) in enumerate(known):
        spaces = table.filter(F.col("_iri").rlike("[/#]$"))
        rows = rows.join(table.withColumnRenamed("_iri", f"_exact{i}"), (F.col(of) == F.col("_of")) & (name == F.col("_term")), "left").drop("_of", "_term")
        rows = rows.join(spaces.withColumnRenamed("_iri", f"_space{i}"), (F.col(of) == F.col("_of")) & (F.col("_prefix") == F.col("_term")), "left").drop("_of", "_term")
    which = range(len(known))
    spaced = F.concat(F.coalesce(*(F.col(f"_space{i}") for i in which)), F.substring(name, F.length("_prefix") + 2, F.length(name)))
    relative, vocab = has_relative_component(name), F.col("vocab")
    found = F.coalesce(*(F.col(f"_exact{i}") for i in which), spaced, F.when(is_absolute_iri(name), name))
    by_vocab = ~relative & vocab.isNotNull()
    rest = F.when(by_vocab, F.concat(vocab, name)).when(F.col("base").isNull(), name).otherwise(with_parts(F.col("_parts"), name))
    rows = rows if given else rows.withColumn("_parts", base_parts(F.col("base")))
    return rows.withColumn(out, F.coalesce(found, rest)).drop("_prefix", *(() if given else ("_parts",)), *(f"_exact{i}" for i in which), *(f"_space{i}" for i in which))


def expansion_error(iri: Column, name: Column) -> Column:
    """Why a name has no absolute IRI: null if it has one."""
    return F.when(iri.isNull(), F.concat(F.lit("leads above the base: "), name)).when(~is_absolute_iri(iri), F.concat(F.lit("relative IRI without a base: "), name)).when(
        iri.rlike(NOT_IN_IRI), F.concat(F.lit("not an IRI: "), iri)
    )


def raw_triples(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """crate_id, s, p, o, o_kind, datatype with names as the package has them: a row per type, scalar, link, and element of a list, mixed lists and lists in lists too."""
    inner = F.substring(F.col("path"), F.length("key") + 1, F.length("path")).rlike(r"^(\[[0-9]+\])+$") & F.col("path").startswith(F.col("key"))
    top = properties.filter((F.col("depth") == 0) & F.col("origin").isin("fixed", "dynamic") | (F.col("origin") == "item") & inner)
    node, literal = F.lit("iri"), F.lit("literal")
    one = lambda o, kind, t: F.array(F.struct(o.alias("o"), kind.alias("o_kind"), t.cast("string").alias("datatype")))
    tag = F.col("tag")
    links = F.transform("ids", lambda x: F.struct(x.alias("o"), F.when(x.startswith("_:") & (F.col("origin") != "fixed"), "blank").otherwise(node).alias("o_kind"), F.lit(None).cast("string").alias("datatype")))
    texts = lambda t: F.transform("items", lambda x: F.struct(x.alias("o"), literal.alias("o_kind"), t.cast("string").alias("datatype")))
    values = (
        F.when((tag == "string") & ~((F.col("origin") == "fixed") & (F.col("s") == "")), one(F.col("s"), literal, F.lit(None))).when(tag == "bool", one(F.col("json"), literal, F.lit(f"{XSD}boolean")))
        .when(tag == "int", one(F.col("i").cast("string"), literal, F.lit(f"{XSD}integer"))).when(tag == "float", one(number_text(F.col("d")), literal, F.lit(f"{XSD}double")))
        .when(tag.isin("id", "ids"), links).when(tag == "strings", texts(F.lit(None))).when(tag == "ints", texts(F.lit(f"{XSD}integer"))).when(tag == "floats", texts(F.lit(f"{XSD}double")))
    )
    rows = top.select("crate_id", F.col("id").alias("s"), F.col("key").alias("p"), F.explode(values).alias("v")).select("crate_id", "s", "p", "v.*")
    types = entities.select("crate_id", F.col("id").alias("s"), F.lit(RDF_TYPE).alias("p"), F.explode("types").alias("o")).withColumns({"o_kind": node, "datatype": F.lit(None).cast("string")})
    return rows.unionByName(types)


def expanded_names(rows: DataFrame, shared: DataFrame, own: DataFrame, terms: DataFrame) -> DataFrame:
    """ctx, name, uses, iri, why: each name that raw triples with a ctx have, once, with its IRI or the reason why it has none.  A table of its own."""
    name = F.explode(F.array_compact(F.array(F.when(~F.col("s").startswith("_:"), F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))))
    names = rows.select("ctx", name.alias("name")).groupBy("ctx", "name").agg(F.count("*").alias("uses")).join(shared, "ctx")
    found = expand(names, terms, own=own).select("ctx", "name", "uses", "iri")
    return written(found.withColumn("why", expansion_error(F.col("iri"), F.col("name"))))


def with_names(rows: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``, the IRI of ``column`` by (ctx, name, uses, iri), null where it has none.

    Names that many triples share, such as properties, would each be one task's: the
    most used ones are broadcast, and triples that have theirs are dealt by a hash of
    themselves in the shuffle that looks up the others.
    """
    common = names.filter(F.col("uses") >= COMMON_USES).orderBy(F.desc("uses")).limit(COMMON_NAMES).select("ctx", F.col("name").alias(column), F.col("iri").alias("_common"))
    rest = names.select("ctx", F.col("name").alias("_name"), F.col("iri").alias("_rest"), F.lit(False).alias("_met"))
    rows = rows.join(F.broadcast(common), ["ctx", column], "left").withColumn("_met", F.col("_common").isNotNull() | F.col(column).isNull())
    dealt = F.when(F.col("_met"), F.xxhash64("s", "o").cast("string")).otherwise(F.col(column))
    found = rows.withColumn("_name", dealt).join(rest, ["ctx", "_name", "_met"], "left")
    return found.withColumn(out, F.coalesce("_common", "_rest")).drop("_name", "_met", "_common", "_rest")


def _named_rows(crates: DataFrame, entities: DataFrame, properties: DataFrame, terms: DataFrame, base: str | None, context_items: DataFrame | None, contexts: DataFrame | None, strict: bool) -> tuple[DataFrame, DataFrame]:
    home, shared, own = package_contexts(crates, context_items, contexts, base, strict)
    rows = raw_triples(entities, properties).join(home, "crate_id")
    return rows, expanded_names(rows, shared, own, terms)


def name_errors(crates: DataFrame, entities: DataFrame, properties: DataFrame, terms: DataFrame, base: str | None = None, context_items: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """crate_id, name, reason: what keeps packages from being exported: names without an absolute IRI, and references to unknown contexts."""
    rows, names = _named_rows(crates, entities, properties, terms, base, context_items, contexts, False)
    bad = names.filter("why IS NOT NULL").select("ctx", "name", "why")
    said = rows.select("crate_id", "ctx", F.explode(F.array_compact(F.array(F.when(~F.col("s").startswith("_:"), F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o"))))).alias("name"))
    found = said.join(bad, ["ctx", "name"]).select("crate_id", "name", F.col("why").alias("reason"))
    if context_items is not None:
        found = found.unionByName(unknown_references(context_items, contexts).select("crate_id", F.col("url").alias("name"), F.lit("unknown context").alias("reason")))
    return found.distinct()


def export_triples(crates: DataFrame, entities: DataFrame, properties: DataFrame, terms: DataFrame, base: str | None = None, strict: bool = True, context_items: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """The set of triples of every package, as crate_id, s, s_kind, p, o, o_kind, datatype, lang.

    A type triple per type; texts as plain literals (empty ones of a root's required
    properties are skipped), numbers and booleans read from RDF typed, links as
    nodes.  Nested objects, nulls and JSON booleans give none.  Names are expanded by
    the vocabulary of the package's version and its own context (``context_items``,
    and ``contexts`` for references).  ``base`` is used by packages without their
    own.  With ``strict`` a name that stays relative or isn't an IRI raises, and so
    does a reference to an unknown context; a name that leads above its base always does.

    Where the terms of all contexts can be broadcast, each triple's names are expanded
    in its own row, so that triples are shuffled as they are, to their packages, and as
    IRIs, to their subjects, where equal ones meet.  Otherwise each name is expanded
    once for all packages that share a context, and triples meet their names' IRIs
    again by context and name.
    """
    home, shared, own = package_contexts(crates, context_items, contexts, base, strict)
    own = written(own)
    if own.count() <= BROADCAST_TERMS and terms.count() <= BROADCAST_TERMS:
        rows = raw_triples(entities, properties).join(grown(home.join(grown(shared), "ctx").withColumn("_parts", base_parts(F.col("base")))), "crate_id")
        return _triple_set(_expanded_rows(rows, F.broadcast(own), terms, strict))
    rows = raw_triples(entities, properties).join(grown(home), "crate_id")
    return _triple_set(_looked_up(rows, expanded_names(rows, shared, own, terms), strict))


def _triple_set(rows: DataFrame) -> DataFrame:
    """Triples without repetition, each with its subject's others."""
    return rows.repartition("crate_id", "s").distinct()


def _expanded_rows(rows: DataFrame, own: DataFrame, terms: DataFrame, strict: bool) -> DataFrame:
    """Triples of raw ones with ctx, version, base, vocab and _parts, by terms that are broadcast."""
    blank, node = F.col("s").startswith("_:"), F.col("o_kind") == "iri"
    rows = rows.withColumns({"s_kind": F.when(blank, "blank").otherwise("iri"), "s_name": F.when(~blank, F.col("s")), "o_name": F.when(node, F.col("o"))})
    for column in ("p", "s_name", "o_name"):
        rows = expand(rows, terms, column, f"{column}_iri", own)
    iri = {}
    for column in ("p", "s_name", "o_name"):
        out, name = F.col(f"{column}_iri"), F.col(column)
        why = expansion_error(out, name)
        iri[column] = F.when(name.isNotNull() & (why.isNotNull() if strict else out.isNull()), F.raise_error(why)).otherwise(out)
    return rows.select("crate_id", F.coalesce(iri["s_name"], "s").alias("s"), "s_kind", iri["p"].alias("p"), F.coalesce(iri["o_name"], "o").alias("o"), "o_kind", "datatype", F.lit(None).cast("string").alias("lang"))


def _looked_up(rows: DataFrame, names: DataFrame, strict: bool) -> DataFrame:
    """The same by a table of expanded names."""
    refused = F.col("why").isNotNull() if strict else F.col("iri").isNull()
    iri = F.when(refused, F.raise_error(F.col("why"))).otherwise(F.col("iri"))
    names = names.select("ctx", "name", "uses", iri.alias("iri"))
    blank, node = F.col("s").startswith("_:"), F.col("o_kind") == "iri"
    rows = rows.select("crate_id", "ctx", "p", "o_kind", "datatype", F.when(blank, "blank").otherwise("iri").alias("s_kind"), "s", "o", F.when(~blank, F.col("s")).alias("s_name"), F.when(node, F.col("o")).alias("o_name"))
    for column in ("p", "s_name", "o_name"):
        rows = with_names(rows, names, column, f"{column}_iri")
    return rows.select("crate_id", F.coalesce("s_name_iri", "s").alias("s"), "s_kind", F.col("p_iri").alias("p"), F.coalesce("o_name_iri", "o").alias("o"), "o_kind", "datatype", F.lit(None).cast("string").alias("lang"))


def _escaped(s: Column) -> Column:
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(code))
    return s


def _node(kind: str, x: str) -> Column:
    return F.when(F.col(kind) == "blank", F.col(x)).otherwise(F.concat(F.lit("<"), F.col(x), F.lit(">")))


def _object() -> Column:
    """A triple's object as N-Triples and Turtle write it."""
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise(""))
    return F.when(F.col("o_kind") == "literal", literal).otherwise(_node("o_kind", "o"))


def scoped_blanks(triples: DataFrame) -> DataFrame:
    """The triples with blank nodes' labels made their package's own, so that files of many packages keep them apart.

    A label gets a 128-bit digest of the package in front, so equal labels of one package stay equal.
    """
    own = F.concat(F.lit("_:b"), F.substring(F.sha2("crate_id", 256), 1, 32), F.lit("x"))
    named = lambda kind, x: F.when(F.col(kind) == "blank", F.concat(own, F.substring(F.col(x), F.lit(3), F.length(x)))).otherwise(F.col(x))
    return triples.withColumns({"s": named("s_kind", "s"), "o": named("o_kind", "o")})


def ntriples(triples: DataFrame, graph: Column | None = None) -> DataFrame:
    """crate_id, line: N-Triples, or N-Quads with a graph IRI.  Blank nodes keep their labels: ``scoped_blanks`` first makes them fit for one file."""
    tail = [F.concat(F.lit("<"), graph, F.lit(">"))] if graph is not None else []
    return triples.select("crate_id", F.concat_ws(" ", _node("s_kind", "s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), _object(), *tail, F.lit(".")).alias("line"))


# What N-Triples allows in IRIs, blank nodes and texts.
_UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI_BODY = rf"[^\x00-\x20<>\"{{}}|\\^`]*+(?:(?:{_UCHAR})[^\x00-\x20<>\"{{}}|\\^`]*+)*+"
_BLANK = r"_:[\w\-·]+(?:\.+[\w\-·]+)*+"
_TEXT = rf"\"[^\"\\]*+(?:(?:\\[tbnrf\"'\\]|{_UCHAR})[^\"\\]*+)*+\""
_LINE = rf"(?U)^\s*(<{_IRI_BODY}>|{_BLANK})\s+<({_IRI_BODY})>\s+(<{_IRI_BODY}>|{_BLANK}|{_TEXT})(?:\^\^<({_IRI_BODY})>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*+))?\s*(?:<{_IRI_BODY}>|{_BLANK})?\s*\.\s*(?:#.*)?$"
# The escapes of N-Triples and what they stand for.
_ESCAPES = (("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'"))


def unescaped(s: Column) -> Column:
    """A text without its escapes.

    Doubled backslashes divide it first, so that no other escape can begin with one
    of theirs; of each part, code points are 8 hex digits behind ``\\U``.
    """

    def part(x: Column) -> Column:
        for code, raw in _ESCAPES:
            x = F.replace(x, F.lit(code), F.lit(raw))
        points = F.split(F.regexp_replace(x, r"\\u([0-9A-Fa-f]{4})", r"\\U0000$1"), r"\\U(?=[0-9A-Fa-f]{8})", -1)
        return F.array_join(F.transform(points, lambda y, i: F.when(i == 0, y).otherwise(F.concat(F.decode(F.unhex(F.substring(y, 1, 8)), "UTF-32"), F.substring(y, 9, 1 << 30)))), "")

    return F.when(s.contains("\\"), F.array_join(F.transform(F.split(s, r"\\\\", -1), part), "\\")).otherwise(s)


def _parts(line: Column) -> Column:
    """Subject, predicate, datatype, language and object of a line; one part if it is none."""
    return F.split(F.regexp_replace(line, _LINE, "$1\n$2\n$4\n$5\n$3"), "\n", 5)


def _said(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("line").rlike(r"^\s*(#.*)?$"))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """crate_id, line: the lines that are neither a triple nor blank nor a comment."""
    return _said(lines).filter(F.size(_parts(F.col("line"))) != 5).select("crate_id", "line")


def parse_ntriples(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Triples of (crate_id, line) in N-Triples or N-Quads, whose graph names are dropped; blank lines and comments give none.

    A malformed line raises, or with ``strict`` off gives no triple (``malformed_lines`` has it).
    """
    rows = _said(lines).select("crate_id", "line", _parts(F.col("line")).alias("parts"))
    if not strict:
        rows = rows.filter(F.size("parts") == 5)
    s, p, datatype, lang, o = (F.try_element_at("parts", F.lit(i)) for i in range(1, 6))
    kind = lambda x: F.when(x.startswith("_:"), "blank").when(x.startswith("<"), "iri").otherwise("literal")
    bare = lambda x: unescaped(F.when(x.startswith("_:"), x).otherwise(F.substring(x, F.lit(2), F.length(x) - 2)))
    checked = F.when(F.size("parts") != 5, F.raise_error(F.concat(F.lit("not a triple: "), F.col("line")))).otherwise(bare(s))
    known = lambda x: F.when(x != "", x)
    return rows.select("crate_id", checked.alias("s"), kind(s).alias("s_kind"), unescaped(p).alias("p"), bare(o).alias("o"), kind(o).alias("o_kind"), unescaped(known(datatype)).alias("datatype"), known(lang).alias("lang"))


def turtle(triples: DataFrame) -> DataFrame:
    """crate_id, s, text: a Turtle block per subject, its types first and its properties in order, joined by ``;`` and ``,``.

    A block is as large as one subject; blocks of a package make its document in any order.
    """
    verb = F.when(F.col("p") == RDF_TYPE, "a").otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">")))
    objects = triples.groupBy("crate_id", _node("s_kind", "s").alias("subject"), "s", verb.alias("verb")).agg(F.array_join(F.sort_array(F.collect_set(_object())), ", ").alias("objects"))
    lines = F.sort_array(F.collect_list(F.struct(F.col("verb") != "a", F.concat_ws(" ", "verb", "objects").alias("text"))))
    blocks = objects.groupBy("crate_id", "s", "subject").agg(lines.alias("lines"))
    return blocks.select("crate_id", "s", F.concat(F.col("subject"), F.lit(" "), F.array_join(F.transform("lines", lambda x: x["text"]), " ;\n    "), F.lit(" .")).alias("text"))


# What XML 1.0 allows in a name behind its prefix, and what no XML text holds.
_LOCAL_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]*$"
_NOT_IN_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
# Names of the RDF vocabulary that are syntax and no properties.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_SYNTAX = ("RDF", "Description", "ID", "about", "parseType", "resource", "nodeID", "datatype", "li", "aboutEach", "aboutEachPrefix", "bagID")
#: What stands before and behind the blocks of an RDF/XML document.
RDFXML_HEAD, RDFXML_TAIL = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n', "</rdf:RDF>\n"


def _xml(s: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        s = F.replace(s, F.lit(raw), F.lit(code))
    return s


def _rdfxml_error() -> Column:
    """Why a triple can't be said in RDF/XML: null if it can."""
    local = F.regexp_extract("p", _LOCAL_NAME, 0)
    return (
        F.when((local == "") | (local == F.col("p")), F.concat(F.lit("no XML name ends "), F.col("p"))).when(F.col("p").isin(*(RDF + x for x in RDF_SYNTAX)), F.concat(F.lit("syntax, no property: "), F.col("p")))
        .when(F.concat("s", "p", "o").rlike(_NOT_IN_XML), "a character that XML lacks")
    )


def rdfxml_errors(triples: DataFrame) -> DataFrame:
    """crate_id, s, p, reason: triples that RDF/XML can't say."""
    return triples.withColumn("reason", _rdfxml_error()).filter("reason IS NOT NULL").select("crate_id", "s", "p", "reason")


def rdfxml(triples: DataFrame, strict: bool = True) -> DataFrame:
    """crate_id, s, text: an RDF/XML element per subject, its properties in order.

    A property's IRI is cut before the longest name that XML allows at its end; a
    subject numbers the namespaces that are left, in order, and declares them, so
    blocks make documents in any order and number, between ``RDFXML_HEAD`` and
    ``RDFXML_TAIL``.  A triple that RDF/XML can't say raises, or is left out without
    ``strict`` (``rdfxml_errors`` has it).  A block is as large as one subject.
    """
    why = _rdfxml_error()
    rows = triples.withColumn("p", F.when(why.isNotNull(), F.raise_error(why)).otherwise(F.col("p"))) if strict else triples.filter(why.isNull())
    local = F.regexp_extract("p", _LOCAL_NAME, 0)
    space = F.substring(F.col("p"), F.lit(1), F.length("p") - F.length(local))
    node = lambda x, kind: F.when(F.col(kind) == "blank", F.concat(F.lit('rdf:nodeID="b'), _xml(F.substring(F.col(x), F.lit(3), F.length(x))), F.lit('"')))
    about = F.coalesce(node("s", "s_kind"), F.concat(F.lit('rdf:about="'), _xml(F.col("s")), F.lit('"')))
    points = F.coalesce(node("o", "o_kind"), F.concat(F.lit('rdf:resource="'), _xml(F.col("o")), F.lit('"')))
    marks = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("lang"), F.lit('"'))).when(F.col("datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml(F.col("datatype")), F.lit('"'))).otherwise("")
    literal = F.col("o_kind") == "literal"
    said = F.struct(space.alias("space"), local.alias("local"), F.when(literal, marks).otherwise(F.concat(F.lit(" "), points)).alias("marks"), F.when(literal, _xml(F.col("o"))).alias("text"))
    blocks = rows.select("crate_id", "s", about.alias("about"), said.alias("x")).groupBy("crate_id", "s", "about").agg(F.sort_array(F.collect_set("x")).alias("all"))
    blocks = blocks.withColumn("spaces", F.array_sort(F.array_distinct(F.transform("all", lambda x: x["space"]))))
    declared = F.array_join(F.transform("spaces", lambda x, i: F.concat(F.lit(" xmlns:n"), i.cast("string"), F.lit('="'), _xml(x), F.lit('"'))), "")

    def element(x: Column) -> Column:
        name = F.concat(F.lit("n"), (F.array_position("spaces", x["space"]) - 1).cast("string"), F.lit(":"), x["local"])
        return F.concat(F.lit("    <"), name, x["marks"], F.when(x["text"].isNull(), "/>\n").otherwise(F.concat(F.lit(">"), x["text"], F.lit("</"), name, F.lit(">\n"))))

    body = F.array_join(F.transform("all", element), "")
    return blocks.select("crate_id", "s", F.concat(F.lit("  <rdf:Description"), declared, F.lit(" "), F.col("about"), F.lit(">\n"), body, F.lit("  </rdf:Description>\n")).alias("text"))


def typed_literal(text: Column, datatype: Column) -> Column:
    """A literal's value as struct (tag, s, i, d, b): by its XML Schema type, else by what the text looks like."""
    local = F.when(datatype.startswith(XSD), F.substring(datatype, len(XSD) + 1, 40))
    as_int = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    as_float = F.when(text.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity|nan)$"), text.try_cast("double"))
    as_bool = F.when(text == "true", True).when(text == "false", False)
    is_int, is_float, is_bool = local.isin(*INTEGER_TYPES), local.isin(*FLOAT_TYPES), local == "boolean"
    loose_bool = F.coalesce(as_bool, F.when(text == "1", True).when(text == "0", False))
    guess = ~F.coalesce(is_int | is_float | is_bool | (local == "string"), F.lit(False))
    b = F.when(F.coalesce(is_bool, F.lit(False)), loose_bool).when(guess, as_bool)
    i = F.when(F.coalesce(is_int, F.lit(False)), as_int).when(guess & b.isNull(), as_int)
    d = F.when(F.coalesce(is_float, F.lit(False)), as_float).when(guess & b.isNull() & i.isNull(), as_float)
    tag = F.when(b.isNotNull(), "bool").when(i.isNotNull(), "int").when(d.isNotNull(), "float").otherwise("string")
    return F.struct(tag.alias("tag"), F.when(tag == "string", text).alias("s"), i.alias("i"), d.alias("d"), b.alias("b"))


def _beginnings(iri: Column) -> Column:
    """Hash and length of each beginning of an IRI that ends in a slash or ``#`` and leaves something: what may be its namespace."""
    parts = F.split(iri, "(?<=[/#])", -1)
    begun = F.transform(parts, lambda x, i: F.array_join(F.slice(parts, 1, i + 1), ""))
    return F.transform(F.filter(begun, lambda x: F.length(x) < F.length(iri)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))


def _short_names(asked: DataFrame, terms: DataFrame, own: DataFrame | None) -> DataFrame:
    """version, iri (and ctx), exact, fit (n, own, prefix): the best term and the longest namespace of distinct IRIs.

    An IRI's beginnings meet namespaces by hash; a name that an own term hides
    stands for something else and is none.
    """
    key = asked.columns
    same = lambda side: (F.col("version" if side is terms else "ctx") == F.col("_of")) & (F.col("iri") == F.col("_iri"))
    begun = asked.select(*key, F.explode(_beginnings(F.col("iri"))).alias("b")).select(*key, "b.*")
    exact, fits = [], []
    for side in (terms,) if own is None else (terms, own):
        of = "version" if side is terms else "ctx"
        known = small(side.select(F.col(of).alias("_of"), F.col("term").alias("_term"), F.col("iri").alias("_iri")), BROADCAST_TERMS)
        spaces = known.filter(F.col("_iri").rlike("[/#]$")).withColumns({"_h": F.xxhash64("_iri"), "_n": F.length("_iri")})
        found = asked.join(known, same(side)).select(*key, F.lit(side is own).alias("own"), F.col("_term").alias("term"))
        fit = begun.join(spaces, (F.col(of) == F.col("_of")) & (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")))
        fit = fit.filter(F.startswith(F.col("iri"), F.col("_iri"))).select(*key, "n", F.lit(side is own).alias("own"), F.col("_term").alias("prefix"))
        if own is not None and side is terms:
            hidden = own.select("ctx", "term").distinct()
            found, fit = found.join(hidden, ["ctx", "term"], "left_anti"), fit.join(hidden.withColumnRenamed("term", "prefix"), ["ctx", "prefix"], "left_anti")
        exact.append(found.select(*key, "own", "term"))
        fits.append(fit.select(*key, "n", "own", "prefix"))
    exact, fits = (x[0] if len(x) == 1 else x[0].unionByName(x[1]) for x in (exact, fits))
    rank = F.struct(~F.col("own"), ~F.col("term").isin(*PREFERRED_TERMS), F.col("term"))
    exact = exact.groupBy(*key).agg(F.min_by("term", rank).alias("exact"))
    fits = fits.groupBy(*key).agg(F.max(F.struct("n", "own", "prefix")).alias("fit"))
    return exact.join(fits, key, "full")


def compact(iris: DataFrame, terms: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Adds ``name`` to (version, base, vocab, iri): exact term, longest namespace, vocab or base taken off, else the IRI.

    Terms of ``own`` (ctx, term, iri) count before the vocabulary's, for IRIs with
    that ctx, and hide those of the same name, so that the name expands to its IRI again.
    """
    key = ["version", "iri"] if own is None else ["version", "ctx", "iri"]
    short = _short_names(iris.select(*key).filter("iri IS NOT NULL").distinct(), terms, own)
    iri, base = F.col("iri"), F.regexp_replace("base", "#.*$", "")
    off = lambda x: F.substring(iri, F.length(x) + 1, F.length(iri))
    name = F.coalesce(
        F.col("exact"),
        F.concat(F.col("fit.prefix"), F.lit(":"), F.substring(iri, F.col("fit.n") + 1, F.length(iri))),
        F.when(iri.startswith(F.col("vocab")), off(F.col("vocab"))),
        F.when(iri == base, "./"),
        F.when(iri.startswith(base), off(base)),
        F.when(iri.startswith(F.concat(F.regexp_replace(base, "/$", ""), F.lit("#"))), off(F.regexp_replace(base, "/$", ""))),
        iri,
    )
    return iris.join(short, key, "left").withColumn("name", name).select(*iris.columns, "name")


def import_kind(id_: Column, types: Column) -> Column:
    """data or contextual, of an entity read from RDF."""
    return F.when(F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, DATA_TYPE_SPELLINGS))), F.lit(False)) & ~id_.startswith("#"), "data").otherwise("contextual")


def subject_index(triples: DataFrame) -> DataFrame:
    """crate_id, s, types, p, values (sorted), n, single: a row per subject and property; a lone value is also there by itself."""
    rest = triples.filter(F.col("p") != RDF_TYPE).groupBy("crate_id", "s", "p").agg(F.sort_array(F.collect_list("o")).alias("values"))
    types = triples.filter(F.col("p") == RDF_TYPE).groupBy("crate_id", "s").agg(F.sort_array(F.collect_set("o")).alias("types"))
    single = F.when(F.size("values") == 1, F.element_at("values", 1))
    return rest.join(types, ["crate_id", "s"], "left").select("crate_id", "s", "types", "p", "values", F.size("values").alias("n"), single.alias("single"))


def roots(triples: DataFrame, about: str = "http://schema.org/about", dataset: str = "http://schema.org/Dataset", name: str = "ro-crate-metadata.json") -> DataFrame:
    """crate_id, metadata, root: the first subject named like a descriptor whose ``about`` is a Dataset."""
    candidates = triples.filter(F.col("s").endswith(name) & (F.col("p") == about)).select("crate_id", F.col("s").alias("metadata"), F.col("o").alias("root"))
    datasets = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == dataset)).select("crate_id", F.col("s").alias("root")).distinct()
    return candidates.join(datasets, ["crate_id", "root"]).groupBy("crate_id").agg(F.min(F.struct("metadata", "root")).alias("f")).select("crate_id", "f.*")


def out_references(triples: DataFrame) -> DataFrame:
    """crate_id, src, key, dst, origin of triples that lead to a node; types don't count."""
    return triples.filter((F.col("p") != RDF_TYPE) & (F.col("o_kind") != "literal")).select("crate_id", F.col("s").alias("src"), F.col("p").alias("key"), F.col("o").alias("dst"), F.lit("rdf").alias("origin"))


def is_vocabulary(iri: Column, spaces: Column) -> Column:
    """Whether an IRI lies in one of the namespaces of the array ``spaces``."""
    return F.exists(spaces, lambda x: iri.startswith(x))


def without_vocabulary(references: DataFrame, terms: DataFrame, version: str = "1.2") -> DataFrame:
    """References (…, dst) that don't lead into a namespace of the vocabulary."""
    spaces = [r["ns"] for r in prefixes(terms).filter(F.col("version") == version).select("ns").distinct().collect()]  # some tens a vocabulary
    return references.filter(~is_vocabulary(F.col("dst"), F.array(*map(F.lit, spaces)))) if spaces else references


def dangling_references(triples: DataFrame, terms: DataFrame, version: str = "1.2") -> DataFrame:
    """crate_id, src, dst: links to nodes that are no subject of their graph and no term of the vocabulary."""
    link = (F.col("p") != RDF_TYPE) & (F.col("o_kind") != "literal")
    # Subjects and links are a table, so that the triples are made once.
    rows = written(triples.select("crate_id", F.col("s").alias("src"), F.when(link, F.col("o")).alias("dst")).distinct(), "zstd")
    out = without_vocabulary(rows.filter("dst IS NOT NULL"), terms, version)
    return out.join(grown(rows.select("crate_id", F.col("src").alias("dst")).distinct()), ["crate_id", "dst"], "left_anti").select("crate_id", "src", "dst")
