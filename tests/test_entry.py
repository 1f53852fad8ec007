"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from kmerloom.plans import files

SF = "/root/testdata/sf0.001"
NAMES = [
    "seq_revcomp", "seq_complement_iupac", "seq_mask_trim", "kmer_spectrum", "kmer_distinct", "hit_vector", "junction_gaps_l0", "exons_confident_l0",
    "splice_edges", "transcript_gene_map", "graph_nodes", "kmer_estimate", "kmer_masked", "bloom_filter", "bloom_probe", "solid_cascade", "exons_bloom", "run_metrics", "splice_extend",
    *(q.__name__ for q in files.QUERIES), "bloom_sizing", "si_format", "si_parse", "read_pair", "ambiguity_ops", "colour_space",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def rows(frame, columns):
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_quality_trim_reads_once(spark):
    """It joined three readings of the file by record number before."""
    joins = lambda name: entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins("quality_trim") == joins("fastq_scan")
