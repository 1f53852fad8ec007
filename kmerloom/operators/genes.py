"""Genes as weakly connected components of a splice graph, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.text import exons_of, transcript_of
from kmerloom.operators.components import connected_components
from kmerloom.storage import global_rank, materialize


def nodes(edges: DataFrame) -> DataFrame:
    """(label, seen): each node and its first appearance, sources before targets, by ``line_no``."""
    ends = F.array(
        F.struct((F.col("line_no") * 2).alias("at"), F.col("src").alias("label")),
        F.struct((F.col("line_no") * 2 + 1).alias("at"), F.col("dst").alias("label")),
    )
    return edges.select(F.explode(ends).alias("e")).groupBy("e.label").agg(F.min("e.at").alias("seen"))


def node_ids(edges: DataFrame) -> DataFrame:
    """(label, node_id): nodes numbered from 1 by first appearance."""
    return global_rank(nodes(edges), ["seen"], "node_id").select("label", (F.col("node_id") + 1).alias("node_id"))


def genes(edges: DataFrame) -> DataFrame:
    """(exon, gene): the component of each node, numbered from 1 by first appearance.

    Components are those of the nodes' numbers by first appearance: a gene's smallest one tells its place.
    """
    found = materialize(global_rank(nodes(edges), ["seen", "label"], "number").select("label", "number"))
    ends = [found.select(F.col("label").alias(end), F.col("number").alias(c)) for end, c in (("src", "u"), ("dst", "v"))]
    links = edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst").select("u", "v")
    rooted = found.join(connected_components(links), F.col("number") == F.col("node"), "left").select("label", F.coalesce("root", "number").alias("root"))
    rooted = materialize(rooted)
    numbered = global_rank(rooted.select("root").distinct(), ["root"], "gene")
    return rooted.join(numbered, "root").select(F.col("label").alias("exon"), (F.col("gene") + 1).alias("gene"))


def transcript_genes(exon_genes: DataFrame) -> DataFrame:
    """(transcript, gene), each pair once, from nodes named by their labels."""
    single = exon_genes.select(F.explode(exons_of(F.col("exon"))).alias("one"), "gene")
    return single.select(transcript_of(F.col("one")).alias("transcript"), "gene").distinct()


def member_genes(exon_genes: DataFrame, merged: DataFrame) -> DataFrame:
    """(transcript, gene), each pair once, from nodes named by their smallest exon and the merged exons (exon, node)."""
    members = merged.select("node", F.col("exon").alias("one"))
    single = exon_genes.join(members, F.col("exon") == F.col("node"), "left").select(F.coalesce("one", "exon").alias("one"), "gene")
    return single.select(transcript_of(F.col("one")).alias("transcript"), "gene").distinct()


def subgraph_edges(edges: DataFrame, exon_genes: DataFrame) -> DataFrame:
    """(gene, src, dst): distinct edges with their component."""
    return edges.select("src", "dst").distinct().join(exon_genes, F.col("src") == F.col("exon")).select("gene", "src", "dst")
