"""Namespaces, IRIs and IRI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of the published vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
VOID = "http://rdfs.org/ns/void#"
VOID_EXT = "http://ldf.fi/void-ext#"
SD = "http://www.w3.org/ns/sparql-service-description#"
FORMATS = "http://www.w3.org/ns/formats/"
PAV = "http://purl.org/pav/"
DCTERMS = "http://purl.org/dc/terms/"
SH = "http://www.w3.org/ns/shacl#"

# Terms of those vocabularies.
TYPE = RDF + "type"
NAMED_INDIVIDUAL = OWL + "NamedIndividual"
LANG_STRING = RDF + "langString"
STRING = XSD + "string"

#: Graphs that a quad store keeps for itself.
SYSTEM_GRAPHS = ("http://www.openlinksw.com/schemas/virtrdf#", "http://www.w3.org/ns/ldp#", "urn:activitystreams-owl:map", "urn:core:services:sparql")

#: Prefixes of a written document.
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "void": VOID, "void_ext": VOID_EXT, "sd": SD, "formats": FORMATS, "pav": PAV, "dcterms": DCTERMS}


def local_sql(iri: str) -> str:
    """SQL (Spark and others) for what follows the last / or #, without a closing /."""
    return f"regexp_extract({iri}, '([^/#]*)/?$', 1)"


def h8_sql(text: str) -> str:
    """SQL for the first eight hexadecimal digits of the MD5 of a text."""
    return f"substr(md5({text}), 1, 8)"


def key_of(kind: Column, value: Column, datatype: Column, language: Column) -> Column:
    """The identity of a term, never null for a term: its N-Triples form without escapes."""
    literal = F.when(language.isNotNull(), F.concat(F.lit('"'), value, F.lit('"@'), language)).otherwise(F.concat(F.lit('"'), value, F.lit('"^^<'), F.coalesce(datatype, F.lit(STRING)), F.lit(">")))
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(literal)
