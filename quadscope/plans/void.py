"""The profile as a VoID and SPARQL Service Description document, and back.

A rule says how rows of one table become statements, in SQL expressions that Spark and other engines
share; all rules of a table are one explode over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import DCTERMS, FORMATS, PAV, PREFIXES, SD, STRING, TYPE, VOID, VOID_EXT, XSD, h8_sql, local_sql
from ..sources import rdf_text
from .profile import Options

#: Result formats of a service.
RESULT_FORMATS = ("SPARQL_Results_CSV", "SPARQL_Results_JSON", "N-Triples", "RDF_XML", "SPARQL_Results_TSV", "Turtle", "SPARQL_Results_XML")
#: Properties of the distinct counts.
_COUNTS = {
    "literal_objects": VOID_EXT + "distinctLiterals",
    "iri_objects": VOID_EXT + "distinctIRIReferenceObjects",
    "bnode_objects": VOID_EXT + "distinctBlankNodeObjects",
    "iri_subjects": VOID_EXT + "distinctIRIReferenceSubjects",
    "bnode_subjects": VOID_EXT + "distinctBlankNodeSubjects",
    "objects": VOID + "distinctObjects",
    "subjects": VOID + "distinctSubjects",
}


@dataclass(frozen=True)
class Rule:
    """``s`` and ``o`` are SQL; ``kind`` iri, bnode, long, string or date."""

    table: str
    s: str
    p: str
    o: str
    kind: str = "iri"
    when: str = "true"
    s_kind: str = "iri"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rules(options: Options) -> list[Rule]:
    base, plain = _q(options.base), _q(options.void_iri)  # no # is put before the names of sub-partitions

    def graph(g: str = "g") -> str:
        return f"{base} || '_graph_' || {local_sql(g)} || '!' || {h8_sql(g)}"

    def part(g: str, x: str) -> str:
        return f"{base} || {local_sql(g)} || '!' || {h8_sql(x)} || '!' || {local_sql(x)}"

    def sub(g: str, *xs: str) -> str:
        hashed = " || '_' || ".join([g, *xs]) + " || '_'"
        return f"{plain} || {local_sql(g)} || '!' || {h8_sql(hashed)} || '!-' || " + " || '-' || ".join(local_sql(x) for x in xs)

    def value(x: str) -> str:
        return sub("g", "class", "p", x) if options.values_by_class else sub("g", "p", x)

    def linkset(*xs: str) -> str:
        hashed = " || '_' || ".join(xs) + " || '_'"
        return f"{base} || 'linkset_' || {h8_sql(hashed)} || {local_sql('p')}"

    service, dataset = _q(options.endpoint), _q(options.endpoint + "#sparql-default-dataset")
    default, collection = _q(options.base + "sparql-default-graph"), _q(options.base + "sparql-graph-collection")
    iri = lambda s: _q(s)
    named, whole = "is_default = 0", "is_default = 1"
    to_class = "'links_' || {}".format(h8_sql("g || '_' || p || '_' || class || '_'"))
    out = [
        Rule("summary", service, TYPE, iri(SD + "Service"), when=whole),
        Rule("summary", service, SD + "defaultDataset", dataset, when=whole),
        Rule("summary", service, SD + "endpoint", service, when=whole),
        *(Rule("summary", service, SD + "resultFormat", iri(FORMATS + f), when=whole) for f in RESULT_FORMATS),
        Rule("summary", service, SD + "supportedLanguage", iri(SD + "SPARQL11Query"), when=whole),
        Rule("summary", service, SD + "feature", iri(SD + "UnionDefaultGraph"), when=whole),
        Rule("summary", service, SD + "feature", iri(SD + "BasicFederatedQuery"), when=whole),
        Rule("summary", service, SD + "availableGraphs", collection, when=whole),
        Rule("summary", dataset, TYPE, iri(SD + "Dataset"), when=whole),
        Rule("summary", dataset, SD + "defaultGraph", default, when=whole),
        Rule("summary", default, TYPE, iri(SD + "Graph"), when=whole),
        Rule("summary", default, VOID + "triples", "triples", "long", f"{whole} and triples > 0"),
        *(Rule("summary", default, p, c, "long", f"{whole} and {c} > 0") for c, p in _COUNTS.items()),
    ]
    if options.title is not None:
        out += [Rule("summary", s, DCTERMS + "title", _q(options.title), "string", whole) for s in (service, default)]
    if options.version is not None:
        out.append(Rule("summary", dataset, PAV + "version", _q(options.version), "string", whole))
    if options.release_date is not None:
        out += [Rule("summary", s, DCTERMS + "issued", _q(options.release_date), "date", whole) for s in (dataset, default)]
    out += [
        Rule("summary", dataset, SD + "namedGraph", "g", when=named),
        Rule("summary", collection, SD + "namedGraph", "g", when=named),
        Rule("summary", "g", TYPE, iri(SD + "NamedGraph"), when=named),
        Rule("summary", "g", SD + "name", "g", when=named),
        Rule("summary", "g", SD + "graph", graph(), when=named),
        Rule("summary", graph(), TYPE, iri(SD + "Graph"), when=named),
        Rule("summary", graph(), VOID + "triples", "triples", "long", named),
        Rule("summary", graph(), VOID + "classes", "classes", "long", f"{named} and classes > 0"),
        *(Rule("summary", graph(), p, c, "long", f"{named} and {c} > 0") for c, p in _COUNTS.items()),
        *(Rule("summary", "g", DCTERMS + "title", _q(text), "string", f"{named} and g = {_q(g)}") for g, text in sorted(options.graph_titles.items())),
        *(Rule("summary", "g", DCTERMS + "license", _q(iri_), "iri", f"{named} and g = {_q(g)}") for g, iri_ in sorted(options.graph_licenses.items())),
        # properties of a graph
        Rule("predicates", graph(), VOID + "propertyPartition", part("g", "p")),
        Rule("predicates", part("g", "p"), TYPE, iri(VOID + "Dataset")),
        Rule("predicates", part("g", "p"), VOID + "property", "p"),
        Rule("predicates", part("g", "p"), VOID + "triples", "triples", "long"),
        Rule("predicates", part("g", "p"), VOID + "distinctSubjects", "subjects", "long"),
        Rule("predicates", part("g", "p"), VOID + "distinctObjects", "objects", "long"),
        # the classes that they point at, with a link set each
        Rule("property_classes", part("g", "p"), VOID + "classPartition", sub("g", "p", "class")),
        Rule("property_classes", sub("g", "p", "class"), VOID + "class", "class"),
        Rule("property_classes", sub("g", "p", "class"), VOID + "entities", "triples", "long"),
        Rule("property_classes", to_class, TYPE, iri(VOID + "Linkset"), s_kind="bnode"),
        Rule("property_classes", to_class, VOID + "linkPredicate", "p", s_kind="bnode"),
        Rule("property_classes", to_class, VOID + "subjectsTarget", part("g", "p"), s_kind="bnode"),
        Rule("property_classes", to_class, VOID + "objectsTarget", sub("g", "p", "class"), s_kind="bnode"),
        Rule("property_classes", to_class, VOID + "entities", "triples", "long", s_kind="bnode"),
        # classes of a graph, and their properties
        Rule("classes", graph(), VOID + "classPartition", part("g", "class")),
        Rule("classes", part("g", "class"), TYPE, iri(VOID + "Dataset")),
        Rule("classes", part("g", "class"), VOID + "class", "class"),
        Rule("classes", part("g", "class"), VOID + "entities", "entities", "long"),
        Rule("class_property", part("g", "class"), VOID + "propertyPartition", sub("g", "class", "p")),
        Rule("class_property", sub("g", "class", "p"), TYPE, iri(VOID + "Dataset")),
        Rule("class_property", sub("g", "class", "p"), VOID + "property", "p"),
        Rule("class_property", sub("g", "class", "p"), VOID + "triples", "triples", "long"),
        Rule("class_property", sub("g", "class", "p"), VOID + "distinctSubjects", "subjects", "long"),
        Rule("class_property", sub("g", "class", "p"), VOID + "distinctObjects", "objects", "long"),
        # what class properties point at
        Rule("datatypes", sub("g", "class", "p"), VOID_EXT + "datatypePartition", value("datatype")),
        Rule("datatypes", value("datatype"), TYPE, iri(VOID + "Dataset")),
        Rule("datatypes", value("datatype"), VOID_EXT + "datatype", "datatype"),
        Rule("datatypes", value("datatype"), VOID + "triples", "triples", "long"),
        Rule("individuals", sub("g", "class", "p"), VOID_EXT + "objectPartition", value("individual")),
        Rule("individuals", value("individual"), VOID_EXT + "object", "individual"),
        Rule("individuals", value("individual"), VOID + "triples", "triples", "long"),
        Rule("links", sub("g", "class", "p"), VOID + "classPartition", sub("g", "class", "p", "tclass"), when="tg = g"),
        Rule("links", sub("g", "class", "p", "tclass"), TYPE, iri(VOID + "Dataset"), when="tg = g"),
        Rule("links", sub("g", "class", "p", "tclass"), VOID + "class", "tclass", when="tg = g"),
        Rule("links", sub("g", "class", "p", "tclass"), VOID + "triples", "triples", "long", "tg = g"),
    ]
    inside, across = linkset("p", "class", "tclass", "g", "g"), linkset("p", "class", "tclass", "tg", graph())
    for name, when in ((inside, "tg = g"), (across, "tg <> g")):
        out += [
            Rule("links", name, TYPE, iri(VOID + "Linkset"), when=when),
            Rule("links", name, VOID + "linkPredicate", "p", when=when),
            Rule("links", name, VOID + "subjectsTarget", part("g", "class"), when=when),
            Rule("links", name, VOID + "objectsTarget", part("tg", "tclass"), when=when),
            Rule("links", graph(), VOID + "subset", name, when=when),
        ]
    out.append(Rule("links", across, VOID + "triples", "triples", "long", "tg <> g"))
    return out


#: Statements of a Turtle document at most.
MOST = 1_000_000
_DATATYPES = {"long": XSD + "long", "string": STRING, "date": XSD + "date"}


def statements(tables: dict[str, DataFrame], options: Options) -> DataFrame:
    """(s, s_kind, p, o, o_kind, o_dt), distinct."""
    out = None
    by: dict[str, list[Rule]] = {}
    for rule in rules(options):
        by.setdefault(rule.table, []).append(rule)
    for name, group in by.items():
        made = []
        for r in group:
            kind = r.kind if r.kind in ("iri", "bnode") else "literal"
            datatype = f"'{_DATATYPES[r.kind]}'" if r.kind in _DATATYPES else "cast(null as string)"
            made.append(f"case when {r.when} then struct({r.s} as s, '{r.s_kind}' as s_kind, {_q(r.p)} as p, cast({r.o} as string) as o, '{kind}' as o_kind, {datatype} as o_dt) end")
        rows = tables[name].select(F.explode(F.expr(f"array({', '.join(made)})")).alias("t")).where("t is not null").select("t.*")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def statements_sql(options: Options) -> str:
    """The same over tables of the rules' names."""
    parts = [f"SELECT {r.s} AS s, {_q(r.p)} AS p, cast({r.o} AS VARCHAR) AS o FROM {r.table} WHERE {r.when}" for r in rules(options)]
    return "SELECT DISTINCT s, p, o FROM ({})".format("\nUNION ALL ".join(parts))


def document(rows: DataFrame) -> str:
    """Turtle text, made on the driver: a document describes a schema, not data.  More than ``MOST``
    statements are refused; N-Triples take any number."""
    if rows.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} statements; write N-Triples (nt), json or parquet")
    return rdf_text.turtle(((r.s, r.s_kind, r.p, r.o, r.o_kind, r.o_dt, None) for r in rows.toLocalIterator()), PREFIXES)


def write(rows: DataFrame, path: str, format: str | None = None) -> None:
    """Write the statements as ttl (one file), nt, json or parquet; by default as the path's extension says,
    else Turtle."""
    format = format or {"nt": "nt", "json": "json", "parquet": "parquet"}.get(path.rpartition(".")[2].lower(), "ttl")
    if format == "ttl":
        text = document(rows)
        rows.sparkSession.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif format == "nt":
        rdf_text.ntriples(rows).write.mode("overwrite").text(path)
    else:
        getattr(rows.write.mode("overwrite"), format)(path)


def as_quads(rows: DataFrame, graph: str) -> DataFrame:
    """The statements as quads of a graph, e.g. to be profiled with the data."""
    return rdf_text.as_quads(rows.select(F.lit(graph).alias("g"), "s", "s_kind", "p", "o", "o_kind", "o_dt", F.lit(None).cast("string").alias("o_lang")))


def replace_graph(rows: DataFrame, path: str, graph: str) -> None:
    """Put the statements into a quad table at ``path`` (parquet, partitioned by g) in place of what its
    graph held; other graphs are not touched."""
    as_quads(rows, graph).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g").parquet(path)


# --- reading back


def _pairs(rows: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return rows.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def read_class_properties(rows: DataFrame) -> DataFrame:
    """(g, class, p, triples, subjects, objects) of a document's statements."""
    found = _pairs(rows, SD + "graph", "g", "gn").join(_pairs(rows, VOID + "classPartition", "gn", "cp"), "gn").join(_pairs(rows, VOID + "class", "cp", "class"), "cp")
    found = found.join(_pairs(rows, VOID + "propertyPartition", "cp", "pp"), "cp").join(_pairs(rows, VOID + "property", "pp", "p"), "pp")
    for c, p in (("triples", "triples"), ("subjects", "distinctSubjects"), ("objects", "distinctObjects")):
        found = found.join(_pairs(rows, VOID + p, "pp", "_n").select("pp", F.col("_n").cast("long").alias(c)), "pp", "left")
    return found.select("g", "class", "p", "triples", "subjects", "objects")


def read_property_classes(rows: DataFrame) -> DataFrame:
    """(g, p, class, triples): the classes that the properties of a graph point at."""
    found = _pairs(rows, SD + "graph", "g", "gn").join(_pairs(rows, VOID + "propertyPartition", "gn", "pp"), "gn").join(_pairs(rows, VOID + "property", "pp", "p"), "pp")
    found = found.join(_pairs(rows, VOID + "classPartition", "pp", "cp"), "pp").join(_pairs(rows, VOID + "class", "cp", "class"), "cp")
    return found.join(_pairs(rows, VOID + "entities", "cp", "n"), "cp", "left").select("g", "p", "class", F.col("n").cast("long").alias("triples"))


def read_links(rows: DataFrame) -> DataFrame:
    """(g, class, p, tclass, triples) of link sets inside graphs and across; across ones carry counts."""
    ls = _pairs(rows, VOID + "subset", "gn", "ls").join(_pairs(rows, VOID + "linkPredicate", "ls", "p"), "ls")
    ls = ls.join(_pairs(rows, VOID + "subjectsTarget", "ls", "a"), "ls").join(_pairs(rows, VOID + "objectsTarget", "ls", "b"), "ls")
    ls = ls.join(_pairs(rows, SD + "graph", "g", "gn"), "gn").join(_pairs(rows, VOID + "class", "a", "class"), "a").join(_pairs(rows, VOID + "class", "b", "tclass"), "b")
    return ls.join(_pairs(rows, VOID + "triples", "ls", "n"), "ls", "left").select("g", "class", "p", "tclass", F.col("n").cast("long").alias("triples"))


def read_graphs(rows: DataFrame) -> DataFrame:
    """(g, triples, classes and the distinct counts) of every named graph; counts that are absent are null."""
    found = _pairs(rows, SD + "graph", "g", "gn")
    wanted = {VOID + "triples": "triples", VOID + "classes": "classes"} | {p: c for c, p in _COUNTS.items()}
    counts = rows.where(F.col("p").isin(*wanted)).groupBy(F.col("s").alias("gn")).agg(*[F.max(F.when(F.col("p") == p, F.col("o").cast("long"))).alias(c) for p, c in wanted.items()])
    return found.join(counts, "gn", "left").drop("gn")


def read_properties(rows: DataFrame) -> DataFrame:
    """(g, p, triples, subjects, objects) of every graph's property partitions."""
    found = _pairs(rows, SD + "graph", "g", "gn").join(_pairs(rows, VOID + "propertyPartition", "gn", "pp"), "gn").join(_pairs(rows, VOID + "property", "pp", "p"), "pp")
    for c, p in (("triples", "triples"), ("subjects", "distinctSubjects"), ("objects", "distinctObjects")):
        found = found.join(_pairs(rows, VOID + p, "pp", "_n").select("pp", F.col("_n").cast("long").alias(c)), "pp", "left")
    return found.select("g", "p", "triples", "subjects", "objects")


def read_graph_notes(rows: DataFrame) -> DataFrame:
    """(g, title, license) of every named graph; a licence may stand at the graph or its description."""
    found = _pairs(rows, SD + "graph", "g", "gn")
    notes = rows.where(F.col("p").isin(DCTERMS + "title", DCTERMS + "license")).groupBy(F.col("s").alias("node")).agg(*[F.min(F.when(F.col("p") == DCTERMS + k, F.col("o"))).alias(k) for k in ("title", "license")])
    own, other = notes.select(F.col("node").alias("g"), "title", F.col("license").alias("_own")), notes.select(F.col("node").alias("gn"), F.col("license").alias("_other"))
    return found.join(own, "g", "left").join(other, "gn", "left").select("g", "title", F.coalesce("_own", "_other").alias("license"))


def read_classes(rows: DataFrame) -> DataFrame:
    """(g, class, entities)."""
    found = _pairs(rows, SD + "graph", "g", "gn").join(_pairs(rows, VOID + "classPartition", "gn", "cp"), "gn").join(_pairs(rows, VOID + "class", "cp", "class"), "cp")
    return found.join(_pairs(rows, VOID + "entities", "cp", "n"), "cp", "left").select("g", "class", F.col("n").cast("long").alias("entities"))


def read_datatypes(rows: DataFrame) -> DataFrame:
    """(g, class, p, datatype, triples)."""
    found = _pairs(rows, SD + "graph", "g", "gn").join(_pairs(rows, VOID + "classPartition", "gn", "cp"), "gn").join(_pairs(rows, VOID + "class", "cp", "class"), "cp")
    found = found.join(_pairs(rows, VOID + "propertyPartition", "cp", "pp"), "cp").join(_pairs(rows, VOID + "property", "pp", "p"), "pp")
    found = found.join(_pairs(rows, VOID_EXT + "datatypePartition", "pp", "dp"), "pp").join(_pairs(rows, VOID_EXT + "datatype", "dp", "datatype"), "dp")
    return found.join(_pairs(rows, VOID + "triples", "dp", "n"), "dp", "left").select("g", "class", "p", "datatype", F.col("n").cast("long").alias("triples"))


def read_service(rows: DataFrame) -> dict[str, str | None]:
    """Endpoint, title, version, release date, and the total and distinct counts of the default graph, as
    one small row."""
    service = rows.where((F.col("p") == TYPE) & (F.col("o") == SD + "Service")).select(F.col("s").alias("service"))
    found = service.join(_pairs(rows, SD + "endpoint", "service", "endpoint"), "service", "left").join(_pairs(rows, DCTERMS + "title", "service", "title"), "service", "left")
    found = found.join(_pairs(rows, SD + "defaultDataset", "service", "dataset"), "service", "left").join(_pairs(rows, PAV + "version", "dataset", "version"), "dataset", "left").join(_pairs(rows, DCTERMS + "issued", "dataset", "issued"), "dataset", "left")
    found = found.join(_pairs(rows, SD + "defaultGraph", "dataset", "dg"), "dataset", "left").join(_pairs(rows, VOID + "triples", "dg", "triples"), "dg", "left")
    for p, c in _COUNTS.items():
        found = found.join(_pairs(rows, c, "dg", p), "dg", "left")
    row = found.orderBy("service").first()
    return row.asDict() if row else {}


# --- conformance


#: Fixed values of the published shapes: how a shape's nodes are found (members of a class, objects of a
#: property), and (property, least, most).
_ONCE = [(p, 0, 1) for p in (VOID + "triples", VOID + "distinctObjects", VOID + "distinctSubjects", VOID_EXT + "distinctLiterals", VOID_EXT + "distinctBlankNodeObjects", VOID_EXT + "distinctIRIReferenceSubjects", VOID_EXT + "distinctBlankNodeSubjects")]
SHAPES = {
    "service": (("class", SD + "Service"), [(SD + "endpoint", 1, 1), (SD + "resultFormat", 1, None), (SD + "supportedLanguage", 1, None), (SD + "defaultDataset", 0, 1)]),
    "default_dataset": (("objects", SD + "defaultDataset"), [(PAV + "version", 0, 1), (SD + "namedGraph", 1, None), (DCTERMS + "issued", 0, 1)]),
    "default_graph": (("objects", SD + "defaultGraph"), [*_ONCE, (DCTERMS + "issued", 0, 1)]),
    "named_graph": (("objects", SD + "namedGraph"), [(SD + "name", 1, 1), (SD + "graph", 1, 1)]),
    "graph": (("objects", SD + "graph"), [*_ONCE, (VOID + "classes", 0, 1)]),
    "class_partition": (("objects", VOID + "classPartition"), [*_ONCE, (VOID + "class", 1, 1), (VOID + "entities", 0, 1)]),
    "property_partition": (("objects", VOID + "propertyPartition"), [*_ONCE, (VOID + "property", 1, 1)]),
    "linkset": (("class", VOID + "Linkset"), [(VOID + "linkPredicate", 1, 1), (VOID + "subjectsTarget", 1, 1), (VOID + "objectsTarget", 1, 1)]),
}


def violations(rows: DataFrame, release_needed: bool = False) -> DataFrame:
    """(shape, s, p, n): nodes that have a property too seldom or too often.  With ``release_needed`` the
    default dataset and graph must have a date of issue."""
    spark: SparkSession = rows.sparkSession
    checks, targets = [], None
    for shape, ((how, what), wanted) in SHAPES.items():
        for p, least, most in wanted:
            least = 1 if release_needed and p == DCTERMS + "issued" else least
            checks.append((shape, p, least, most))
        found = rows.where((F.col("p") == TYPE) & (F.col("o") == what)).select("s") if how == "class" else rows.where(F.col("p") == what).select(F.col("o").alias("s"))
        found = found.distinct().select(F.lit(shape).alias("shape"), "s")
        targets = found if targets is None else targets.unionByName(found)
    asked = targets.join(F.broadcast(spark.createDataFrame(checks, "shape string, p string, least int, most int")), "shape")
    n = rows.select("s", "p", "o").distinct().groupBy("s", "p").agg(F.count("*").alias("n"))
    counted = asked.join(n, ["s", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.where((F.col("n") < F.col("least")) | (F.col("n") > F.col("most"))).select("shape", "s", "p", "n")
