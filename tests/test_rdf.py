"""Sources, operators, document and command line over small RDF fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadscope.functions.vocabulary import LANG_STRING, STRING, TYPE, XSD
from quadscope.operators import counts, links, schema
from quadscope.plans import void
from quadscope.plans.profile import Options, Profile
from quadscope.sources import rdf_text

#: Stars that telescopes see; counted by hand below.
TRIG = """
@prefix : <http://o.example/> . @prefix c: <http://o.example/terms#> . PREFIX owl: <http://www.w3.org/2002/07/owl#>
@prefix star: <http://o.example/star/> . @prefix tube: <http://o.example/telescope/> . @prefix island: <http://o.example/island/> .
:sky {
  star:sirius a c:Star, c:Bright ; c:magnitude -1.46 ; c:name "Sirius"@la, "Sirio"@it ; c:seen_by tube:keck .
  star:vega a c:Star ; c:magnitude 0.03 ; c:name "Vega" ; c:seen_by tube:keck, tube:palomar ; c:note [ a c:Note ; c:text "double" ] .
  star:mimosa a c:Star ; c:next star:sirius .
}
:ground {
  tube:keck a c:Telescope ; c:at island:hawaii ; c:looks_at star:vega .
  tube:palomar a c:Telescope, owl:NamedIndividual .
  island:hawaii a c:Place, owl:NamedIndividual .
}
"""
O = "http://o.example/"
SKY, GROUND, C, INDIVIDUAL = O + "sky", O + "ground", O + "terms#", "http://www.w3.org/2002/07/owl#NamedIndividual"


@pytest.fixture(scope="module")
def sky(spark):
    return rdf_text.as_quads(spark.createDataFrame(rdf_text.parse(TRIG), rdf_text.SCHEMA)).cache()


def quads(spark, text):
    return rdf_text.as_quads(spark.createDataFrame(rdf_text.parse(text, "http://x.org/g"), rdf_text.SCHEMA))


def test_golden_counts(sky):
    rows = {r.g: r for r in counts.graph_summary(sky).collect()}
    told = ("triples", "classes", "subjects", "iri_subjects", "bnode_subjects", "objects", "iri_objects", "bnode_objects", "literal_objects")
    assert [tuple(rows[g][c] for c in told) for g in (SKY, GROUND, None)] == [(16, 3, 4, 3, 1, 13, 6, 1, 6), (7, 3, 3, 3, 0, 5, 5, 0, 0), (23, 0, 7, 6, 1, 18, 11, 1, 6)]


def test_golden_schema_and_links(sky):
    assert {(r.p, r.triples, r.subjects, r.objects) for r in schema.predicate_stats(sky).where(f"g = '{GROUND}'").collect()} == {(TYPE, 5, 3, 3), (C + "at", 1, 1, 1), (C + "looks_at", 1, 1, 1)}
    rows = schema.class_triples(sky)
    short = lambda iri: iri.replace(C, "").replace(O, "").replace(INDIVIDUAL, "individual").rpartition("#")[2]
    name = lambda r: tuple(short(x) if isinstance(x, str) else x for x in r)
    assert {name(r) for r in schema.class_property_stats(rows).collect()} == {
        ("sky", "Star", "magnitude", 2, 2, 2), ("sky", "Star", "name", 3, 2, 3), ("sky", "Star", "seen_by", 3, 2, 2), ("sky", "Star", "note", 1, 1, 1), ("sky", "Star", "next", 1, 1, 1),
        ("sky", "Bright", "magnitude", 1, 1, 1), ("sky", "Bright", "name", 2, 1, 2), ("sky", "Bright", "seen_by", 1, 1, 1), ("sky", "Note", "text", 1, 1, 1),
        ("ground", "Telescope", "at", 1, 1, 1), ("ground", "Telescope", "looks_at", 1, 1, 1),
    }
    assert {name(r) for r in links.links(rows, sky).collect()} == {
        ("sky", "Star", "seen_by", "ground", "Telescope", 3), ("sky", "Star", "seen_by", "ground", "individual", 1), ("sky", "Bright", "seen_by", "ground", "Telescope", 1),
        ("sky", "Star", "note", "sky", "Note", 1), ("sky", "Star", "next", "sky", "Star", 1), ("sky", "Star", "next", "sky", "Bright", 1),
        ("ground", "Telescope", "at", "ground", "Place", 1), ("ground", "Telescope", "at", "ground", "individual", 1), ("ground", "Telescope", "looks_at", "sky", "Star", 1),
    }
    assert {name(r) for r in links.property_classes(sky).collect()} == {("sky", "note", "Note", 1), ("sky", "next", "Star", 1), ("sky", "next", "Bright", 1), ("ground", "at", "Place", 1), ("ground", "at", "individual", 1)}
    assert {name(r) for r in schema.class_property_datatypes(rows).collect()} == {("sky", "Star", "magnitude", "decimal", 2), ("sky", "Star", "name", "langString", 2), ("sky", "Star", "name", "string", 1), ("sky", "Bright", "magnitude", "decimal", 1), ("sky", "Bright", "name", "langString", 2), ("sky", "Note", "text", "string", 1)}
    assert {name(r) for r in schema.named_individuals(rows, sky).collect()} == {("ground", "Telescope", "at", "island/hawaii", 1)}


#: Names of parts of the document, made by hand: the first eight digits of the MD5 of an IRI, or of IRIs that
#: are each followed by a low line.
V = "http://o.example/void"
NAMES = {
    "sky": V + "#_graph_sky!f79bbf4a", "ground": V + "#_graph_ground!80aede23", "Telescope": V + "#ground!3609605c!Telescope", "Place": V + "#ground!ba15763e!Place", "Star": V + "#sky!1184fb63!Star", "individual": V + "#ground!bb70ba4a!NamedIndividual",
    "at": V + "#ground!15b18ab7!at", "Telescope at": V + "ground!3e00a2d2!-Telescope-at", "Telescope at Place": V + "ground!c9109409!-Telescope-at-Place", "Telescope at hawaii": V + "ground!97566526!-Telescope-at-hawaii",
    "Star magnitude": V + "sky!7d1810d9!-Star-magnitude", "Star magnitude decimal": V + "sky!d549692b!-Star-magnitude-decimal", "at Place": V + "ground!b4683cd4!-at-Place",
    "inside": V + "#linkset_d7225549at", "across": V + "#linkset_58f32e9fseen_by", "to Place": "links_b4683cd4",
}


def golden():
    v, sd, ext, n = "http://rdfs.org/ns/void#", "http://www.w3.org/ns/sparql-service-description#", "http://ldf.fi/void-ext#", NAMES
    dataset, default = O + "sparql#sparql-default-dataset", V + "#sparql-default-graph"
    return {
        (O + "sparql", TYPE, sd + "Service"), (O + "sparql", sd + "endpoint", O + "sparql"), (O + "sparql", sd + "defaultDataset", dataset), (O + "sparql", "http://purl.org/dc/terms/title", "test title"),
        (O + "sparql", sd + "availableGraphs", V + "#sparql-graph-collection"), (V + "#sparql-graph-collection", sd + "namedGraph", SKY), (dataset, sd + "namedGraph", SKY), (dataset, sd + "defaultGraph", default), (dataset, "http://purl.org/pav/version", "2022"),
        (default, v + "triples", "23"), (default, v + "distinctObjects", "18"), (default, v + "distinctSubjects", "7"), (default, ext + "distinctIRIReferenceObjects", "11"), (default, ext + "distinctLiterals", "6"), (default, ext + "distinctBlankNodeSubjects", "1"),
        (SKY, sd + "name", SKY), (SKY, sd + "graph", n["sky"]), (SKY, "http://purl.org/dc/terms/title", "The sky"), (SKY, "http://purl.org/dc/terms/license", "http://o.example/free"),
        (n["ground"], v + "triples", "7"), (n["ground"], v + "classes", "3"), (n["ground"], ext + "distinctIRIReferenceObjects", "5"), (n["ground"], v + "classPartition", n["Telescope"]), (n["ground"], v + "propertyPartition", n["at"]),
        (n["Telescope"], v + "class", C + "Telescope"), (n["Telescope"], v + "entities", "2"), (n["Telescope"], v + "propertyPartition", n["Telescope at"]), (n["individual"], v + "entities", "2"),
        (n["at"], v + "property", C + "at"), (n["at"], v + "triples", "1"), (n["at"], v + "distinctSubjects", "1"), (n["at"], v + "classPartition", n["at Place"]), (n["at Place"], v + "class", C + "Place"), (n["at Place"], v + "entities", "1"),
        (n["to Place"], TYPE, v + "Linkset"), (n["to Place"], v + "linkPredicate", C + "at"), (n["to Place"], v + "subjectsTarget", n["at"]), (n["to Place"], v + "objectsTarget", n["at Place"]), (n["to Place"], v + "entities", "1"),
        (n["Telescope at"], v + "property", C + "at"), (n["Telescope at"], v + "triples", "1"), (n["Telescope at"], v + "distinctSubjects", "1"), (n["Telescope at"], v + "distinctObjects", "1"),
        (n["Telescope at"], v + "classPartition", n["Telescope at Place"]), (n["Telescope at Place"], v + "class", C + "Place"), (n["Telescope at Place"], v + "triples", "1"),
        (n["Telescope at"], ext + "objectPartition", n["Telescope at hawaii"]), (n["Telescope at hawaii"], ext + "object", O + "island/hawaii"), (n["Telescope at hawaii"], v + "triples", "1"),
        (n["Star"], v + "propertyPartition", n["Star magnitude"]), (n["Star magnitude"], ext + "datatypePartition", n["Star magnitude decimal"]), (n["Star magnitude decimal"], ext + "datatype", XSD + "decimal"), (n["Star magnitude decimal"], v + "triples", "2"),
        (n["inside"], TYPE, v + "Linkset"), (n["inside"], v + "subjectsTarget", n["Telescope"]), (n["inside"], v + "objectsTarget", n["Place"]), (n["inside"], v + "linkPredicate", C + "at"), (n["ground"], v + "subset", n["inside"]),
        (n["across"], v + "subjectsTarget", n["Star"]), (n["across"], v + "objectsTarget", n["Telescope"]), (n["across"], v + "triples", "3"), (n["sky"], v + "subset", n["across"]),
    }


def test_golden_statements(sky):
    options = Options(title="test title", version="2022", release_date="2024-06-06", void_iri=V, endpoint=O + "sparql", graph_titles={SKY: "The sky"}, graph_licenses={SKY: O + "free"})
    rows = void.statements(Profile(sky, options).materialise(), options).cache()
    found = {(r.s, r.p, r.o) for r in rows.collect()}
    assert not golden() - found
    assert len({o for s, p, o in found if p.endswith("#propertyPartition")}) == 7 + 3 + 11 and len({s for s, p, o in found if o.endswith("#Linkset")}) == 5 + 9
    assert {(r.g, r.title, r.license) for r in void.read_graph_notes(rows).collect()} == {(SKY, "The sky", O + "free"), (GROUND, None, None)}
    service = void.read_service(rows)
    assert [int(service[c]) for c in ("triples", "iri_subjects", "bnode_subjects", "iri_objects", "bnode_objects", "literal_objects")] == [23, 6, 1, 11, 1, 6]
    shared = Options(void_iri=V, endpoint=O + "sparql", values_by_class=False)
    names = {r.s for r in void.statements(Profile(sky, shared).materialise(), shared).collect()}
    assert {V + "ground!54f67352!-at-hawaii", V + "sky!6772dfe0!-magnitude-decimal"} <= names


def test_terms_differ_by_datatype_and_language(spark):
    q = quads(spark, '<u:a> <u:p> "1", "1"@en, "1"^^<http://www.w3.org/2001/XMLSchema#integer>, "1", 1 .')
    assert {(r.o_dt, r.o_lang) for r in q.collect()} == {(STRING, None), (LANG_STRING, "en"), (XSD + "integer", None)}
    assert counts.subjects_and_objects(q).first().objects == 3


def test_empty_and_odd_graphs(spark):
    none = spark.createDataFrame([], rdf_text.SCHEMA)
    q = rdf_text.as_quads(none)
    row = counts.graph_summary(q).collect()
    assert [(r.g, r.triples, r.subjects, r.objects) for r in row] == [(None, 0, 0, 0)]
    assert all(df.count() == 0 for name, df in Profile(q).tables().items() if name != "summary")
    q = quads(spark, "<u:a> a _:c ; <u:p> <u:b> . GRAPH <urn:g> { <u:a> <u:p> <u:b> }")
    assert schema.classes(q).count() == 0
    assert {r.g: r.triples for r in counts.triples_per_graph(q).collect()} == {"http://x.org/g": 2, "urn:g": 1}
    assert counts.distinct_terms(q, "s", "iri").first().subjects == 1


def test_named_individuals_of_the_same_graph_only(spark):
    own = "@prefix owl: <http://www.w3.org/2002/07/owl#> . <u:s> a <u:C> ; <u:p> <u:i>, <u:j> . <u:i> a owl:NamedIndividual . GRAPH <u:o> { <u:j> a owl:NamedIndividual }"
    q = quads(spark, own)
    assert [(r.individual, r.triples) for r in schema.named_individuals(schema.class_triples(q), q).collect()] == [("u:i", 1)]


def test_lines(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<u:a> <u:p> "x\\n\\"y\\u00e9\\"" <u:g> .\n# note\n\n_:b <u:p> <u:a> .\n<u:a> <u:q> "h"@EN-gb .\n<u:a> <u:q> ""^^<u:d> .\n<u:a> <u:p> "x\\n\\"y\\u00e9\\"" <u:g> .\n')
    rows = rdf_text.read(spark, str(tmp_path / "a.nq"), "u:default").collect()
    assert {(r.g, r.p, r.o, r.o_kind, r.o_dt, r.o_lang) for r in rows} == {("u:g", "u:p", 'x\n"yé"', "literal", STRING, None), ("u:default", "u:p", "u:a", "iri", None, None), ("u:default", "u:q", "h", "literal", LANG_STRING, "en-gb"), ("u:default", "u:q", "", "literal", "u:d", None)}
    (tmp_path / "bad.nt").write_text("<u:a> <u:p> .\n")
    with pytest.raises(Exception, match="not a statement"):
        rdf_text.read(spark, str(tmp_path / "bad.nt")).collect()
    assert rdf_text.read_lines(spark, str(tmp_path / "bad.nt"), strict=False).count() == 0


def test_blank_nodes_of_two_files_differ(spark, tmp_path):
    for name in ("a.nt", "b.nt"):
        (tmp_path / name).write_text("_:x <u:p> _:x .\n")
    assert rdf_text.read_lines(spark, str(tmp_path), "u:g").select("s").distinct().count() == 2


def test_turtle_forms():
    rows = rdf_text.parse('@base <http://x.org/> . @prefix : <#> . :a :p [ :q 1.5, true ; ] , ( 1 2e0 ) ; :r """a "b" c""" ; a <C> . # end', "g")
    assert len(rows) == 10
    assert ("g", "http://x.org/#a", "iri", TYPE, "http://x.org/C", "iri", None, None) in rows
    assert {r[6] for r in rows if r[5] == "literal"} == {XSD + "decimal", XSD + "boolean", XSD + "integer", XSD + "double", STRING}
    for bad in ("<a> <b> ", "x:a x:b x:c .", "<a> <b> <c> ?"):
        with pytest.raises(ValueError):
            rdf_text.parse(bad)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u:a", "u:b"]), st.text(max_size=12), st.sampled_from([None, "en"])), max_size=6))
def test_turtle_round_trip(rows):
    given_ = {(s, "iri", "u:p", o, "literal", None if lang else STRING, lang) for s, o, lang in rows if not any(0xD800 <= ord(c) < 0xE000 for c in o)}
    back = {r[1:] for r in rdf_text.parse(rdf_text.turtle(iter(sorted(given_, key=repr)), {}), "g")}
    assert back == given_


def test_document(spark, sky, tmp_path, monkeypatch):
    options = Options(title="test title", version="2022", release_date="2024-06-06", void_iri="http://x.org/void", endpoint="http://x.org/sparql")
    profile = Profile(sky, options)
    tables = profile.materialise()
    rows = void.statements(tables, options).cache()
    text = void.document(rows)
    for part in ('"2024-06-06"^^xsd:date', '"test title"', 'pav:version "2022"', "sd:Service", '"16"^^xsd:long'):
        assert part in text
    back = rdf_text.as_quads(spark.createDataFrame(rdf_text.parse(text), rdf_text.SCHEMA))
    bare = lambda x: x.rpartition("links_")[2] if "links_" in x else x
    assert {(bare(r.s), r.p, r.o) for r in back.collect()} == {(bare(r.s), r.p, r.o) for r in rows.collect()}
    assert void.read_service(back)["version"] == "2022" and void.read_service(back)["triples"] == "23"
    assert {(r["class"], r.entities) for r in void.read_classes(back).collect()} == {(r["class"], r.entities) for r in tables["classes"].collect()}
    assert void.violations(rows).count() == 0 and void.violations(rows, release_needed=True).count() == 0
    void.write(rows, str(tmp_path / "void.nt"))
    assert rdf_text.read_lines(spark, str(tmp_path / "void.nt"), "u:g").count() == rows.count()
    void.write(rows, str(tmp_path / "void.ttl"))
    assert len(rdf_text.parse("\n".join(r.value for r in spark.read.text(str(tmp_path / "void.ttl")).collect()))) == rows.count()
    monkeypatch.setattr(void, "MOST", 10)
    with pytest.raises(ValueError, match="N-Triples"):
        void.document(rows)


def test_replace_graph(spark, sky, tmp_path):
    path = str(tmp_path / "quads")
    sky.write.partitionBy("g").parquet(path)
    options = Options(void_iri="http://x.org/void")
    rows = void.statements(Profile(sky, options).materialise(), options)
    for part in (rows, rows.limit(3)):
        void.replace_graph(part, path, options.void_iri)
    found = {r.g: r["count"] for r in spark.read.parquet(path).groupBy("g").count().collect()}
    assert found == {SKY: 16, GROUND: 7, options.void_iri: 3}


def test_options(sky):
    some = Profile(sky, Options(graphs=[SKY], class_filter=f"class <> '{C}Bright'", count_subjects=False, detailed=False)).tables()
    assert {r["class"] for r in some["classes"].collect()} == {C + "Star", C + "Note"}
    rows = {r.g: r for r in some["summary"].collect()}
    assert [(r.subjects, r.objects, r.classes) for r in (rows[SKY], rows[None])] == [(0, 13, 2), (0, 13, 0)] and some["links"].count() == 0
    none = Profile(sky, Options(count_subjects=False, count_objects=False, find_classes=False)).tables()["summary"]
    assert {(r.g, r.triples, r.subjects, r.objects, r.classes) for r in none.collect()} == {(SKY, 16, 0, 0, 0), (GROUND, 7, 0, 0, 0), (None, 23, 0, 0, 0)}
    assert "md5" not in none._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        Options(endpoint="")
    with pytest.raises(ValueError):
        Options(release_date="yesterday")


def test_distinct_terms_are_reused_unless_forced(spark, sky, tmp_path):
    path = str(tmp_path / "terms")
    wanted = sorted((tuple(r) for r in counts.graph_summary(sky).collect()), key=repr)
    assert sorted((tuple(r) for r in Profile(sky.where(f"g = '{SKY}'"), terms=path).summary.collect()), key=repr) == [r for r in sorted((tuple(r) for r in counts.graph_summary(sky.where(f"g = '{SKY}'")).collect()), key=repr)]
    assert sorted((tuple(r) for r in Profile(sky, terms=path).summary.collect()), key=repr) == wanted
    assert {r.g for r in spark.read.parquet(path).collect()} == {SKY, GROUND}
    fewer = sky.where("s_kind = 'iri'")
    assert {r.g: r.bnode_subjects for r in Profile(fewer, terms=path).summary.collect()}[SKY] == 1  # as it was
    assert {r.g: r.bnode_subjects for r in Profile(fewer, terms=path, force=True).summary.collect()}[SKY] == 0


def test_kept_tables_follow_their_files(spark, tmp_path):
    from quadscope.sources import store

    made = []

    def table():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "t")).selectExpr("k + 1 as k")

    for k in (1, 1, 2):
        if not made or k == 2:
            spark.createDataFrame([(k,)], "k int").write.mode("overwrite").parquet(str(tmp_path / "t"))
        assert [r.k for r in store.kept(spark, "plus", store.files_of(spark, [str(tmp_path / "t")]), table).collect()] == [k + 1]
    assert len(made) == 2


def test_bitmaps(spark):
    rows = spark.createDataFrame([(i % 70_000, i % 2) for i in range(100_000)], "id long, k int")
    assert counts.distinct_ids(rows, "id").first().n == 70_000
    assert {r.k: r.n for r in counts.distinct_ids(rows, "id", "k").collect()} == {0: 35_000, 1: 35_000}
    assert counts.merged_ids(counts.bitmaps(rows, "id", "k")).first().n == 70_000


def test_command_line(spark, tmp_path):
    from quadscope import cli

    (tmp_path / "a.trig").write_text(TRIG)
    base = ["--source", str(tmp_path / "a.trig"), "-s", str(tmp_path / "void.nt"), "-i", "http://x.org/void", "-r", "http://x.org/sparql"]
    rows = cli.run(spark, [*base, "--title", "t", "--tables", str(tmp_path / "tables"), "-a", str(tmp_path / "store")])
    assert rdf_text.read_lines(spark, str(tmp_path / "void.nt"), "u:g").count() == rows.count()
    assert {r.g for r in void.read_graphs(rows).collect()} == {SKY, GROUND, "http://x.org/void"}
    assert spark.read.parquet(str(tmp_path / "store")).count() == rows.count()
    some = cli.run(spark, [*base, "-g", SKY, "--class-filter", f"class <> '{C}Bright'", "--data-release-version", "7", "--data-release-date", "2025-01-31", "--graph-title", SKY, "Up", "--graph-license", SKY, "u:free", "--distinct-terms", str(tmp_path / "terms"), "-f"])
    assert {(r.g, r.title, r.license) for r in void.read_graph_notes(some).collect()} == {(SKY, "Up", "u:free")}
    assert {r["class"] for r in void.read_classes(some).collect()} == {C + "Star", C + "Note"}
    assert [void.read_service(some)[k] for k in ("version", "issued")] == ["7", "2025-01-31"] and spark.read.parquet(str(tmp_path / "terms")).count() > 10
    with pytest.raises(ValueError):
        cli.run(spark, [*base, "--jdbc", "jdbc:x"])
    with pytest.raises(SystemExit):
        cli.run(spark, ["-V"])


def test_other_sources(spark, sky, tmp_path):
    """JSON, parquet and a JDBC table, in the schema of terms."""
    terms = sky.select("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
    terms.write.json(str(tmp_path / "t.json"))
    sky.write.parquet(str(tmp_path / "t.parquet"))
    wanted = sorted(sky.collect())
    assert sorted(rdf_text.read(spark, str(tmp_path / "t.json")).select(sky.columns).collect()) == wanted == sorted(rdf_text.read(spark, str(tmp_path / "t.parquet")).collect())
    nq = rdf_text.ntriples(sky)
    nq.write.text(str(tmp_path / "t.nq"))
    bare = lambda df: sorted((r.g, r.p, r.o_kind, r.o_dt or "", r.o if r.o_kind != "bnode" else "") for r in df.collect())
    assert bare(rdf_text.read(spark, str(tmp_path / "t.nq"))) == bare(sky)


@pytest.fixture(scope="module")
def server():
    """A small endpoint over TRIG that knows the three kinds of questions, and fails the first time."""
    import json
    import re
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    rows, asked = rdf_text.parse(TRIG), []

    def term(value, kind, datatype=None, language=None):
        return {"type": {"iri": "uri", "bnode": "bnode", "literal": "literal"}[kind], "value": value} | ({"datatype": datatype} if datatype and datatype != STRING else {}) | ({"xml:lang": language} if language else {})

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            asked.append(query)
            if len(asked) == 1:
                return self.send_error(503)
            graph = re.search(r"GRAPH <(.*?)>", query)
            own = sorted((r for r in rows if graph and r[0] == graph[1]), key=repr)
            if "DISTINCT" in query:
                found = [{"g": term(g, "iri")} for g in sorted({r[0] for r in rows})]
            elif "COUNT" in query:
                found = [{"n": term(str(len(own)), "literal")}]
            else:
                limit, offset = map(int, re.search(r"LIMIT (\d+) OFFSET (\d+)", query).groups())
                found = [{"s": term(*r[1:3]), "p": term(r[3], "iri"), "o": term(*r[4:8])} for r in own[offset : offset + limit]]
            body = json.dumps({"results": {"bindings": found}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}/sparql", asked
    web.shutdown()


def test_endpoint(spark, sky, server, tmp_path):
    from quadscope import cli
    from quadscope.sources import endpoint

    url, asked = server
    bare = lambda df: sorted((r.g, r.p, r.o_kind, r.o_dt or "", r.o_lang or "", r.o if r.o_kind != "bnode" else "") for r in df.collect())
    found = endpoint.read(spark, url, page=5, wait=0)
    assert bare(found) == bare(sky) and sum("OFFSET" in q for q in set(asked)) == 4 + 2
    assert sorted(r.triples for r in counts.triples_per_graph(endpoint.read(spark, url, [SKY], wait=0)).collect()) == [16]
    rows = cli.run(spark, ["--void-file", str(tmp_path / "void.nt"), "-i", "http://x.org/void", "--repository", url, "--max-concurrency", "2", "--optimize-for", "sparql"])
    assert {(r.g, r.triples) for r in void.read_graphs(rows).collect()} == {(SKY, 16), (GROUND, 7)}
    with pytest.raises(Exception, match="refused|URLError|Connection"):
        endpoint.read(spark, "http://127.0.0.1:9/none", tries=1, wait=0).count()


def test_escapes_of_all_planes(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<u:\\u00e9> <u:p> "\\U0001F600 \\u00E9 \\uD83D\\uDE00 \\\\U0001F600 \\t|\\\'|\\b\\\\" .\n<u:a><u:p>"raw \x1f sign and \U0001F600" .\n_:b<u:p>_:c.d .\n')
    rows = {(r.s_kind, r.o) for r in rdf_text.read(spark, str(tmp_path / "a.nt"), "u:g").where("o_kind = 'literal'").collect()}
    assert rows == {("iri", "\U0001F600 é \U0001F600 \\U0001F600 \t|'|\b\\"), ("iri", "raw \x1f sign and \U0001F600")}
    assert rdf_text.read(spark, str(tmp_path / "a.nt"), "u:g").where("s = 'u:é'").count() == 1


def test_documents_over_the_limit_are_refused(spark, tmp_path, monkeypatch):
    for name in ("a.ttl", "b.ttl"):
        (tmp_path / name).write_text("<u:a> <u:p> <u:b> . # " + "x" * 60)
    assert rdf_text.read_document(spark, str(tmp_path), "u:g").count() == 1
    monkeypatch.setattr(rdf_text, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="N-Quads"):
        rdf_text.read_document(spark, str(tmp_path), "u:g")
    with pytest.raises(Exception, match="trig"):
        rdf_text.read_document(spark, str(tmp_path) + "/*.trig")
