"""Command line: profile a quad source and write the document.

    spark-submit -m quadscope.cli --source data.nq --output void.ttl --iri-of-void http://… --endpoint http://…
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .plans import void
from .plans.profile import Options, Profile
from .sources import endpoint, rdf_text, store


def parser() -> argparse.ArgumentParser:
    flag = {"action": argparse.BooleanOptionalAction, "default": True}
    out = argparse.ArgumentParser(prog="quadscope", description="Profile RDF quads as a VoID document.")
    out.add_argument("--source", "--from-test-file", help="a file or folder: nt, nq, ttl, trig, json or parquet quads")
    out.add_argument("--jdbc", "--virtuoso-jdbc", help="JDBC url of a quad table, instead of --source")
    out.add_argument("--jdbc-table", default="quads")
    out.add_argument("--user")
    out.add_argument("--password")
    out.add_argument("-s", "--output", "--void-file", required=True, help="document to write; its extension says the format")
    out.add_argument("-i", "--iri-of-void", required=True)
    out.add_argument("-r", "--endpoint", "--repository", required=True, help="IRI of the endpoint that the document describes; without --source and --jdbc its quads are read")
    for name in (("-p", "--predicates"), ("--max-concurrency",), ("--optimize-for",), ("--ontology-graph-name",)):
        out.add_argument(*name, action="append", help="accepted, but not needed")
    out.add_argument("-g", "--graphs", help="only these graphs, separated by commas")
    out.add_argument("--class-filter", help="SQL condition over `class` that keeps a class")
    out.add_argument("--title")
    out.add_argument("--data-release-version")
    out.add_argument("--data-release-date")
    out.add_argument("--tables", help="also write the seven tables as parquet below this folder")
    out.add_argument("--graph-title", nargs=2, action="append", default=[], metavar=("GRAPH", "TITLE"))
    out.add_argument("--graph-license", nargs=2, action="append", default=[], metavar=("GRAPH", "IRI"))
    out.add_argument("--distinct-terms", help="keep the distinct terms of every graph below this folder, and reuse those that are there")
    out.add_argument("-f", "--force", action="store_true", help="count all graphs anew")
    out.add_argument("-V", "--version", action="version", version=f"%(prog)s {__version__}")
    out.add_argument("-a", "--add-void-graph-to-store", metavar="PATH", help="put the document into the parquet quads at PATH, and count it")
    for name in ("find-distinct-classes", "count-distinct-subjects", "count-distinct-objects", "find-predicates", "count-detailed-void-statistics"):
        out.add_argument(f"--{name}", **flag)
    return out


def run(spark: SparkSession, args: Sequence[str]) -> DataFrame:
    """The statements that were written."""
    a = parser().parse_args(args)
    if a.source and a.jdbc:
        raise ValueError("either --source or --jdbc, not both")
    options = Options(
        void_iri=a.iri_of_void, endpoint=a.endpoint, graphs=a.graphs.split(",") if a.graphs else None, class_filter=a.class_filter, title=a.title, version=a.data_release_version, release_date=a.data_release_date,
        find_classes=a.find_distinct_classes, count_subjects=a.count_distinct_subjects, count_objects=a.count_distinct_objects, find_predicates=a.find_predicates, detailed=a.count_detailed_void_statistics,
        graph_titles=dict(a.graph_title), graph_licenses=dict(a.graph_license),
    )
    access = {k: v for k, v in (("user", a.user), ("password", a.password)) if v}
    if a.jdbc:
        quads = rdf_text.read_jdbc(spark, a.jdbc, a.jdbc_table, access)
    elif a.source:
        quads = rdf_text.read(spark, a.source)
    else:
        quads = endpoint.read(spark, a.endpoint, options.graphs, **access)
    rows = _profiled(quads, options, a.tables, a.distinct_terms, a.force)
    if a.add_void_graph_to_store:  # the document counts itself
        options = Options(**{**options.__dict__, "graphs": [*options.graphs, options.void_iri] if options.graphs else None})
        rows = _profiled(quads.unionByName(void.as_quads(rows, options.void_iri)), options, a.tables)
        void.replace_graph(rows, a.add_void_graph_to_store, options.void_iri)
    void.write(rows, a.output)
    return rows


def _profiled(quads: DataFrame, options: Options, tables: str | None, terms: str | None = None, force: bool = False) -> DataFrame:
    profile = Profile(quads, options, terms, force).persist()
    try:
        if tables:
            profile.write(tables)
        return store.written(void.statements(profile.materialise(), options), "statements")
    finally:
        profile.unpersist()


def main() -> None:
    import sys

    run(SparkSession.builder.appName("quadscope").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
