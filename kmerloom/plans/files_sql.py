"""DuckDB SQL for the queries over files: the same rows straight from the tables."""

from __future__ import annotations

from kmerloom.plans.derived import BASES, K, LETTERS
from kmerloom.plans.sql import BASE, EXONS, FILTER, GENES, HASHED, KNOWN, PLACES, PROBED, READS, TRANSCRIPTS, _bounds, _extra, _kmers, _segments

_NAMED = f"{BASE}, {READS}, named AS MATERIALIZED (SELECT *, translate(seq, 'ACGT', '!5I?') AS qual, row_number() OVER (ORDER BY doc_id, r) - 1 AS rec_no, 'r' || doc_id || '_' || r AS id FROM reads)"
_PASSAGES = f"passages AS (SELECT item_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM benchmark)"
_ORDERS = "WITH RECURSIVE edges AS (SELECT o_orderkey AS line_no, 'O' || o_orderkey || '_1_9' AS src, 'C' || o_custkey || '_9_20' AS dst FROM orders)"

# A source's contigs end to end: each with its place, and with the first bases of those after it.
_CHROMOSOMES = f"""placed AS MATERIALIZED (SELECT source, doc_id, start, seq || left(coalesce(after, ''), {K - 1}) AS seq FROM (
  SELECT source, doc_id, seq, coalesce(sum(length(seq)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    string_agg(left(seq, {K - 1}), '') OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND {K - 1} FOLLOWING) AS after
  FROM (SELECT c.doc_id, coalesce(source, '') AS source, seq FROM contigs c JOIN documents d ON c.doc_id = d.doc_id))),
windows AS MATERIALIZED (SELECT source, start + x AS x, canon FROM ({_kmers('placed', 'doc_id').replace('SELECT doc_id, x, kmer, least', 'SELECT source, start, x, kmer, least').replace('SELECT doc_id, x, substr', 'SELECT source, start, x, substr').replace('SELECT doc_id, seq, unnest', 'SELECT source, start, seq, unnest')}))"""

ORACLE: dict[str, str] = {
    "fasta_scan": f"{BASE} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rec_no, 'D' || doc_id AS id, 'of ' || length(seq) || ' bases' AS comment, seq FROM contigs",
    "fasta_packed": f"{BASE} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rec_no, 'D' || doc_id AS id, md5(seq) AS seq_md5 FROM contigs WHERE seq <> ''",
    "fastq_scan": f"{_NAMED} SELECT rec_no, id, '' AS comment, seq, qual FROM named",
    "quality_trim": f"""{_NAMED} SELECT rec_no, t AS trimmed, translate(t, 'ACGT', '!5I?') AS trimmed_qual, replace(seq, 'A', 'N') AS masked, substr(seq, 1, 25) AS capped
      FROM (SELECT *, CASE WHEN trim(seq, 'A') = '' THEN substr(seq, 1, 1) ELSE trim(seq, 'A') END AS t FROM named)""",
    "quality_shift": f"{_NAMED} SELECT id, qual FROM named",
    "casava_clean": f"{_NAMED} SELECT rec_no, id || '/1' AS id, substr(seq, 4) AS seq, substr(qual, 4) AS qual FROM named WHERE r % 3 <> 0",
    "sam_scan": f"""{_NAMED} SELECT row_number() OVER (ORDER BY rec_no) - 1 AS rec_no, id || ['', '/1', '/2'][r % 5 + 1] AS id, ['0', '1', '2'][r % 5 + 1] || ':N:0:' AS comment, [0, 65, 145][r % 5 + 1]::INT AS flag,
      CASE WHEN r % 5 = 2 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN r % 5 = 2 THEN reverse(qual) ELSE qual END AS qual FROM named WHERE r % 5 < 3""",
    "qseq_scan": f"""{_NAMED} SELECT row_number() OVER (ORDER BY rec_no) - 1 AS rec_no, 'M:1:' || doc_id || ':' || r || ':4:5' || CASE WHEN r % 2 = 1 THEN '#1' ELSE '' END || CASE WHEN r % 4 = 0 THEN '/2' ELSE '/1' END AS id,
      CASE WHEN r % 4 = 0 THEN '3:N:0:' ELSE '1:N:0:' END AS comment, seq, qual FROM named WHERE r % 3 <> 0""",
    "mixed_scan": f"""{_NAMED}, own AS (SELECT *, r % 4 AS k, doc_id % 5 AS f, translate(seq, 'ACGT', '@>#I') AS q FROM named)
      SELECT rec_no, ['fasta', 'fastq', 'sam', 'qseq'][k + 1] AS kind, CASE k WHEN 0 THEN id WHEN 1 THEN id || '/1' WHEN 2 THEN id || ['', '/1', '/2'][f + 1] ELSE 'M:1:' || doc_id || ':' || r || ':4:5/2' END AS id,
      CASE k WHEN 0 THEN 'a read' WHEN 1 THEN '1:N:0:AC' WHEN 2 THEN ['0', '1', '2'][f + 1] || ':N:0:' ELSE '3:N:0:' END AS comment,
      CASE WHEN k = 2 AND f = 2 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq,
      CASE WHEN k = 0 THEN NULL WHEN k = 2 AND f = 2 THEN reverse(q) WHEN k = 3 THEN translate(seq, 'ACGT', '@Th^') ELSE q END AS qual, CASE WHEN k = 3 THEN 64 ELSE 33 END::INT AS "offset"
      FROM own WHERE NOT (k = 2 AND f > 2) AND NOT (k = 3 AND doc_id % 3 = 0)""",
    "colour_reads": f"""{_NAMED} SELECT id, substr(seq, 1, 1) AS anchor, array_to_string(list_transform(range(1, length(seq)),
        lambda i: xor(strpos('ACGT', seq[i]) - 1, strpos('ACGT', seq[i + 1]) - 1)), '') AS seq, substr(qual, 2) AS qual FROM named WHERE length(seq) > 2""",
    "chromosome_kmers": f"{BASE}, {_CHROMOSOMES} SELECT source, count(*) AS kmers, sum(x)::BIGINT AS places, max(x)::BIGINT AS last_x, count(DISTINCT canon) AS distinct_kmers FROM windows GROUP BY source",
    "chromosome_runs": f"""{BASE}, {TRANSCRIPTS}, {_CHROMOSOMES}, known AS MATERIALIZED (SELECT DISTINCT canon FROM ({_kmers('transcripts', 'id')})),
      hit AS (SELECT source, x FROM windows JOIN known USING (canon))
      SELECT source, min(x)::BIGINT AS s, max(x)::BIGINT AS e FROM (SELECT source, x, x - row_number() OVER (PARTITION BY source ORDER BY x) AS run FROM hit) GROUP BY source, run""",
    "exon_files": f"""{PROBED}, {_bounds(0)}, {_segments(True)} SELECT row_number() OVER (ORDER BY id, exon_no) - 1 AS rec_no, id || '_' || "start" || '_' || "end" AS id, exon_seq AS seq FROM ({EXONS})""",
    "dot_scan": f"{_ORDERS} SELECT src, dst FROM edges",
    "clustered_dot": f"""{_ORDERS}, {GENES}, own AS (SELECT DISTINCT gene, src, dst FROM edges JOIN genes ON src = exon)
      SELECT 'digraph graphname {{' AS line UNION ALL SELECT '}}' UNION ALL SELECT 'subgraph graphname_cc_' || (gene - 1) || ' {{' FROM (SELECT DISTINCT gene FROM own)
      UNION ALL SELECT '}}' FROM (SELECT DISTINCT gene FROM own) UNION ALL SELECT src || '->' || dst || ';' FROM own""",
    "gene_files": f"""{_ORDERS}, {GENES} SELECT 'exon' AS kind, exon AS name, gene FROM genes
      UNION ALL SELECT DISTINCT 'transcript', regexp_replace(exon, '_[^_]*_[^_]*$', ''), gene FROM genes""",
    "filter_files": f"""{BASE}, {KNOWN}, asked AS (SELECT canon AS key, canon AS kmer FROM known), {HASHED}, {FILTER}, places AS ({PLACES})
      SELECT n AS set_bits, bits, hashes, {K} AS k, 0.01::DOUBLE AS rate FROM (SELECT count(DISTINCT place) AS n FROM places), sized""",
    "kmer_hashes": f"""WITH {_PASSAGES}, asked AS (SELECT item_id * 100000 + x AS key, kmer FROM ({_kmers('passages', 'item_id')})), {HASHED.replace('least(bit_xor(f), bit_xor(r)) AS h', 'bit_xor(f) AS f, bit_xor(r) AS r, least(bit_xor(f), bit_xor(r)) AS h')}
      SELECT key // 100000 AS item_id, (key % 100000)::INT AS x, f::VARCHAR AS forward, r::VARCHAR AS reverse, h::VARCHAR AS canonical, ({_extra('1')})::VARCHAR AS second, ({_extra('7')})::VARCHAR AS seeded FROM hashed""",
    "sequence_edits": f"""WITH {_PASSAGES} SELECT item_id, translate(seq, 'ACGT', '0123') AS codes, seq AS bases, true AS is_base, substr(seq, 1, 4) || 'N' || substr(seq, 6) AS substituted,
      substr(seq, 5, 3) || substr(seq, 1, 4) || substr(seq, 12, 3) AS overlaid, substr(seq, 1, length(seq) - 1) AS chopped, 3 AS options FROM passages WHERE length(seq) >= 20""",
    "leniency_rule": f"""SELECT l_orderkey, l_linenumber, CASE WHEN given = 10 AND factor <> 0 THEN ceil(factor * rate * {K}) ELSE given END::INT AS leniency
      FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE l_linenumber END AS given, l_tax::DOUBLE * 50 AS factor, l_discount::DOUBLE AS rate FROM lineitem)""",
    "solid_filter_counts": f"""{BASE}, {READS} SELECT coalesce(sum(n), 0)::BIGINT AS total_kmers, count(*) AS distinct_kmers, count(*) FILTER (WHERE n >= 2) AS repeated_kmers
      FROM (SELECT canon, count(*) AS n FROM ({_kmers('reads', 'doc_id')}) GROUP BY canon)""",
}
