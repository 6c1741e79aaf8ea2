"""Queries of the problems for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.llm import docpairs, mixing, packing, provenance, truncation
from loomgraph.tables import table

_PAIR = ("id", "kind", "name", "qualified_name", "signature", "docstring", "seq")


def p1_pairs(spark, folder):
    pairs = docpairs.described_functions(table(spark, folder, "nodes", *_PAIR))
    return pairs.select("id", "name", "signature", F.array_join("parameters", ",").alias("parameters"), "whole", "description")


def p1_found(spark, folder):
    return docpairs.described_functions(table(spark, folder, "nodes", *_PAIR)).select("id")


def p1_from_files(spark, folder):
    return docpairs.functions_from_files(table(spark, folder, "files", "path", "indexed_at", "content_hash", "content"))


def p4_provenance(spark, folder):
    return provenance.provenance(
        table(spark, folder, "files", "path", "indexed_at", "content_hash", "content"), table(spark, folder, "nodes", "file_path"), table(spark, folder, "modules", "root_path")
    )


def p4_found(spark, folder):
    return p4_provenance(spark, folder).where("verdict != 'hand-written'").select("path")


def p6_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "pack_capacity"))


def p6_fill(spark, folder):
    return packing.fill_report(p6_packing(spark, folder), table(spark, folder, "pack_capacity"))


def p6_mixture(spark, folder):
    return packing.mixture_report(p6_packing(spark, folder))


def p6_targets(spark, folder):
    shares = table(spark, folder, "mix_targets").select("source", F.col("weight").alias("share"))
    packed = packing.pack_documents(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "pack_capacity"), shares)
    return packing.target_report(packed)


def p7_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p7_shares(spark, folder):
    return mixing.share_report(p7_mixing(spark, folder), table(spark, folder, "mix_targets"))


def p7_memberships(spark, folder):
    return mixing.membership_report(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p8_found(spark, folder):
    judged = truncation.truncated(table(spark, folder, "documents", "doc_id", "source", "text"))
    return judged.where("state = 'cut'").select("doc_id")


def p8_rates(spark, folder):
    return truncation.truncation_rates(truncation.truncated(table(spark, folder, "documents", "doc_id", "source", "text")))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p1_from_files, p4_found, p4_provenance, p6_packing, p6_fill, p6_mixture, p6_targets, p7_mixing, p7_shares, p7_memberships, p8_found, p8_rates)
}
SQL: dict[str, str] = {}
