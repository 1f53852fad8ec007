"""DuckDB SQL for the queries of this package."""

from __future__ import annotations

from kmerloom.functions.sequence import IUPAC, IUPAC_COMPLEMENT, IUPAC_MASK, MASK_IUPAC, SMALLEST_BASE
from kmerloom.functions.nthash import MULTI_SEED, MULTI_SHIFT, base_hashes
from kmerloom.plans.derived import BASES, DIGITS, EXON, K, LEFT_SIGNALS, LENIENCY, LETTERS, READ, RIGHT_SIGNALS, STEP, STRIDE

MIN_EXON = 5

CONTIGS = f"contigs AS MATERIALIZED (SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)"
READS = f"""reads AS (SELECT doc_id, r::INT AS r, substr(seq, least({STEP} * r, greatest(length(seq) - {READ}, 0)) + 1, {READ}) AS seq FROM (
  SELECT doc_id, seq, unnest(range(0, ceil(greatest(length(seq) - {READ}, 0) / {STEP}::DOUBLE)::BIGINT + 1)) AS r FROM contigs WHERE seq <> ''))"""
TRANSCRIPTS = f"""exon_cut AS (SELECT doc_id, j, substr(seq, (j - 1) * {STRIDE} + 1, {EXON}) AS e FROM (
  SELECT doc_id, seq, unnest(range(1, greatest((length(seq) - {EXON}) // {STRIDE} + 1, 1) + 1)) AS j FROM contigs WHERE seq <> '')),
transcripts AS MATERIALIZED (
  SELECT 'D' || doc_id || 'T1' AS id, string_agg(e, '' ORDER BY j) AS seq FROM exon_cut GROUP BY doc_id
  UNION ALL SELECT 'D' || doc_id || 'T2', string_agg(e, '' ORDER BY j) FROM exon_cut WHERE j % 3 <> 0 GROUP BY doc_id)"""


def _kmers(table: str, key: str) -> str:
    return f"""SELECT {key}, x, kmer, least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) AS canon FROM (
      SELECT {key}, x, substr(seq, x + 1, {K}) AS kmer FROM (
        SELECT {key}, seq, unnest(range(0, length(seq) - {K - 1})) AS x FROM {table} WHERE length(seq) >= {K}))"""


KNOWN = f"known AS MATERIALIZED (SELECT DISTINCT canon FROM ({_kmers('contigs', 'doc_id')}))"
HITS = f"""hits AS MATERIALIZED (SELECT t.id, t.x::INT AS x, t.kmer, k.canon IS NOT NULL AS hit FROM ({_kmers('transcripts', 'id')}) t LEFT JOIN known k ON t.canon = k.canon)"""
SCANNED = f"""scanned AS MATERIALIZED (SELECT * FROM (
  SELECT h.id, x, hit, length(seq)::INT AS len,
         hit AND lead(hit, 1, false) OVER w AND lead(hit, 2, false) OVER w AS triple
  FROM hits h JOIN transcripts t ON h.id = t.id WHERE length(seq) >= {K + MIN_EXON} WINDOW w AS (PARTITION BY h.id ORDER BY x)) WHERE x <= len - {K} - 2),
firsts AS (SELECT id, min(x) AS first_x FROM scanned WHERE triple GROUP BY id),
lasts AS (SELECT id, max(x + {K}) AS last_pos FROM scanned WHERE hit GROUP BY id),
events AS (SELECT id, x, triple, before FROM (
  SELECT s.id, x, triple, lag(triple) OVER (PARTITION BY s.id ORDER BY x) AS before
  FROM scanned s JOIN firsts f ON s.id = f.id WHERE x >= first_x AND (triple OR NOT hit)) WHERE triple <> before),
gaps AS MATERIALIZED (SELECT id, x AS start_x, end_x FROM (
  SELECT id, x, triple, lead(x) OVER (PARTITION BY id ORDER BY x) AS end_x FROM events) WHERE NOT triple AND end_x IS NOT NULL)"""
BASE = f"WITH RECURSIVE {CONTIGS}"
PROBED = f"{BASE}, {TRANSCRIPTS}, {KNOWN}, {HITS}, {SCANNED}"


def _bounds(leniency: int) -> str:
    middle = f"[start_x + {K} - 1, start_x + {K}]" if leniency == 0 else f"[start_x + {K} - 1, start_x + {K}, end_x - 1, end_x]"
    return f"""bounds AS MATERIALIZED (SELECT f.id, [f.first_x + 1] || coalesce(j.v, []::INT[]) || [l.last_pos] AS b
  FROM firsts f JOIN lasts l ON f.id = l.id LEFT JOIN (
    SELECT id, flatten(list(v ORDER BY start_x)) AS v FROM (
      SELECT id, start_x, CASE WHEN end_x - start_x > {K + MIN_EXON} THEN {middle}
        WHEN end_x - start_x >= {K - leniency - 2} THEN [start_x + {K} - 1, end_x] ELSE []::INT[] END AS v FROM gaps) GROUP BY id) j ON f.id = j.id)"""


def _segments(confident: bool) -> str:
    if not confident:
        inner = "SELECT t.id, seq, b FROM bounds JOIN transcripts t ON bounds.id = t.id"
    else:
        inner = """SELECT id, seq, CASE WHEN len(b) = 2 THEN (CASE WHEN b[1] <> 1 AND b[2] < length(seq) - 2 THEN b ELSE []::INT[] END)
          ELSE list_slice(b, CASE WHEN b[1] = 1 THEN 3 ELSE 1 END, CASE WHEN b[len(b)] >= length(seq) - 2 THEN len(b) - 2 ELSE len(b) END) END AS b
        FROM (SELECT t.id, seq, b FROM bounds JOIN transcripts t ON bounds.id = t.id)"""
    return f"""segs AS MATERIALIZED (SELECT id, i::INT AS exon_no, seq,
    (CASE WHEN i = 0 THEN b[1] ELSE greatest(b[2 * i], b[2 * i + 1]) END)::INT AS s,
    (CASE WHEN 2 * i + 2 = len(b) THEN b[len(b)] ELSE least(b[2 * i + 2], b[2 * i + 3]) END)::INT AS e
  FROM (SELECT id, seq, b, unnest(range(0, len(b) // 2)) AS i FROM ({inner}) WHERE len(b) >= 2))"""


EXONS = """SELECT id, exon_no, s AS "start", e AS "end", CASE WHEN e - s + 1 >= 0 THEN substr(seq, s, e - s + 1) ELSE substr(seq, s) END AS exon_seq FROM segs"""
ROWS = "SELECT id, i::INT AS exon_no, b[2 * i + 1]::INT AS raw_start, b[2 * i + 2]::INT AS raw_end FROM (SELECT id, b, unnest(range(0, len(b) // 2)) AS i FROM bounds)"

RECORDS = f"""{PROBED}, {_bounds(LENIENCY)}, {_segments(False)},
exons AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id, exon_no) - 1 AS rec_no, id AS name, id || '_' || s || '_' || e AS exon,
  CASE WHEN e - s + 1 >= 0 THEN substr(seq, s, e - s + 1) ELSE substr(seq, s) END AS seq FROM segs),
blocks AS MATERIALIZED (SELECT *, is_first OR is_last AS terminal FROM (
  SELECT rec_no, exon, name, seq, CASE WHEN lead(name) OVER o = name THEN lead(exon) OVER o END AS next_exon,
    coalesce(lag(name) OVER o <> name, true) AS is_first, coalesce(lead(name) OVER o <> name, true) AS is_last
  FROM exons WINDOW o AS (ORDER BY rec_no)) WHERE NOT (is_first AND is_last)),
ends AS MATERIALIZED (
  SELECT 'start' AS side, substr(seq, i + 1, 30) AS kmer, exon FROM (SELECT *, unnest(range(0, 10)) AS i FROM blocks WHERE length(seq) >= 39 AND NOT is_first)
  UNION ALL SELECT 'end', substr(seq, length(seq) - 30 - i + 1, 30), exon FROM (SELECT *, unnest(range(0, 10)) AS i FROM blocks WHERE length(seq) >= 39 AND NOT is_last)),
shared AS MATERIALIZED (SELECT side, kmer, count(DISTINCT exon) AS exons, min(exon) AS first_exon FROM ends GROUP BY side, kmer HAVING count(DISTINCT exon) > 1)"""


def _propagate(links: str, name: str) -> str:
    """Least node of each node's component over ``links`` (u, v), from all nodes that it reaches: for small test tables."""
    return f"""{name}_e AS MATERIALIZED (SELECT u, v FROM {links} UNION SELECT v, u FROM {links}),
{name}_r(node, other) AS (SELECT u, u FROM {name}_e UNION SELECT r.node, e.v FROM {name}_r r JOIN {name}_e e ON r.other = e.u),
{name} AS (SELECT node, min(other) AS root FROM {name}_r GROUP BY node)"""


MERGED = f"""{RECORDS}, links AS MATERIALIZED (SELECT DISTINCT e.exon AS u, s.first_exon AS v FROM ends e JOIN shared s ON e.side = s.side AND e.kmer = s.kmer WHERE e.exon <> s.first_exon),
{_propagate('links', 'comp')},
members AS MATERIALIZED (SELECT c.node AS exon, c.root AS component, b.size, b.terminal FROM comp c JOIN (
  SELECT exon, arg_max(length(seq), rec_no) AS size, arg_max(terminal, rec_no) AS terminal FROM blocks GROUP BY exon) b ON c.node = b.exon),
stats AS (SELECT component, max(size) AS most, min(size) AS least, arg_min(exon, (-size, exon)) AS big FROM members GROUP BY component),
judged AS (SELECT m.exon, m.component FROM members m JOIN stats s ON m.component = s.component WHERE s.least >= s.most - 5 OR m.terminal OR m.exon = s.big),
labels AS MATERIALIZED (SELECT j.exon, l.label FROM judged j JOIN (SELECT component, string_agg(exon, '_OR_' ORDER BY exon) AS label FROM judged GROUP BY component) l ON j.component = l.component)"""
GRAPH = f"""{MERGED}, chain AS (SELECT exon AS src, arg_max(next_exon, rec_no) AS dst, max(rec_no) AS line_no FROM blocks WHERE next_exon IS NOT NULL GROUP BY exon),
edges AS MATERIALIZED (SELECT line_no, coalesce(a.label, src) AS src, coalesce(b.label, dst) AS dst FROM chain LEFT JOIN labels a ON src = a.exon LEFT JOIN labels b ON dst = b.exon)"""
GENES = f"""seen AS (SELECT label, min(seen) AS seen FROM (SELECT src AS label, line_no * 2 AS seen FROM edges UNION ALL SELECT dst, line_no * 2 + 1 FROM edges) GROUP BY label),
ends2 AS (SELECT src AS u, dst AS v FROM edges), {_propagate('ends2', 'gene_comp')},
numbered AS (SELECT root, row_number() OVER (ORDER BY min(seen)) AS gene FROM gene_comp JOIN seen ON node = label GROUP BY root),
genes AS (SELECT node AS exon, gene FROM gene_comp JOIN numbered USING (root))"""
ORDER_EDGES = "WITH RECURSIVE edges AS (SELECT o_orderkey AS line_no, 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders)"

_forward, _reverse = base_hashes(K)
_seeds = ", ".join(f"({i}, '{'ACGT'[b]}', {_forward[i][b]}::UBIGINT, {_reverse[i][b]}::UBIGINT)" for i in range(K) for b in range(4))
_MASK = (1 << 64) - 1
#: (key, h): canonical hashes of the k-mers in ``asked`` (key, kmer), from what each base adds.
HASHED = f"""seeds(i, b, f, r) AS (VALUES {_seeds}),
hashed AS MATERIALIZED (SELECT key, least(bit_xor(f), bit_xor(r)) AS h FROM (
  SELECT key, i, substr(kmer, i + 1, 1) AS b FROM (SELECT key, kmer, unnest(range(0, {K})) AS i FROM asked)) JOIN seeds USING (i, b) GROUP BY key)"""


def _extra(i: str) -> str:
    """The i-th hash of h; ``i`` is a column from 0."""
    t = f"((h::UHUGEINT * (xor({i}::UBIGINT, {(K * MULTI_SEED) & _MASK}::UBIGINT))::UHUGEINT) & {_MASK}::UHUGEINT)::UBIGINT"
    return f"CASE WHEN {i} = 0 THEN h ELSE xor({t}, {t} >> {MULTI_SHIFT}) END"


#: Size and places of a filter of all reference k-mers.
FILTER = f"""size AS MATERIALIZED (SELECT greatest(count(*), 1) AS n, floor(-ln(0.01::DOUBLE) / ln(2::DOUBLE) / ln(2::DOUBLE) * greatest(count(*), 1))::BIGINT AS bits FROM known),
sized AS MATERIALIZED (SELECT bits, greatest(floor((bits // n) * ln(2::DOUBLE)), 1)::INT AS hashes FROM size)"""
PLACES = f"SELECT key, ({_extra('j')}) % bits AS place FROM (SELECT key, h, bits, unnest(range(0, hashes)) AS j FROM hashed, sized)"


def _walk(side: str) -> str:
    """Six greedy steps from the k-mer at one end of ``exons0``: tables {side}0 to {side}6 of (id, kmer, found)."""
    start = f"substr(seq, 1, {K})" if side == "lw" else f"substr(seq, length(seq) - {K - 1}, {K})"
    longer = f"substr(b || kmer, 1, {K})" if side == "lw" else f"substr(kmer || b, 2, {K})"
    joined = "b || found" if side == "lw" else "found || b"
    out = f"{side}0 AS MATERIALIZED (SELECT id, {start} AS kmer, '' AS found FROM exons0 WHERE length(seq) >= {K})"
    for n in range(6):
        out += f""",
{side}{n}t AS MATERIALIZED (SELECT id, arg_min(b, o) AS b FROM (SELECT id, b, o, {longer} AS nx FROM {side}{n}, (VALUES ('A', 0), ('G', 1), ('T', 2), ('C', 3)) v(b, o) WHERE length(found) = {n})
  JOIN known ON canon = least(nx, translate(reverse(nx), 'ACGT', 'TGCA')) GROUP BY id),
{side}{n + 1} AS MATERIALIZED (SELECT w.id, CASE WHEN b IS NULL THEN kmer ELSE {longer} END AS kmer, CASE WHEN b IS NULL THEN found ELSE {joined} END AS found
  FROM {side}{n} w LEFT JOIN {side}{n}t t ON w.id = t.id)"""
    return out


_signals = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"

_both = lambda s: s + s.lower()
_codes = "codes AS (SELECT item_id, regexp_replace(text, '[^ACGTMRWSYKVHDBNacgtmrwsykvhdbn]', '', 'g') AS codes FROM benchmark)"
_flat_from, _flat_to = "".join(SMALLEST_BASE), "".join(SMALLEST_BASE.values())
_mask = lambda c: "CASE upper(" + c + ") " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in IUPAC_MASK.items()) + " END"
_low = lambda c: f"regexp_matches({c}, '^[a-z]$')"
_sig = lambda x, n, unit: f"printf('%.{n}g', {x}) || '{unit}'"
_n = "floor(l_extendedprice * 1000)::BIGINT"
_quantity = lambda base: "CASE unit " + " ".join(f"WHEN '{u}' THEN size * {float(base) ** i!r}" for i, u in enumerate(["", "k", "m", "g", "t"])) + " ELSE 0.0 END"
_parts = "SELECT p_partkey, p_size::DOUBLE AS size, lower(['', 'k', 'M', 'g', 'T', 'x', 'kb'][p_partkey % 7 + 1]) AS unit FROM part"
_b = "'r' || (o_orderkey % 10) || CASE WHEN o_orderkey % 3 = 0 THEN '/1' ELSE '/2' END"

ORACLE: dict[str, str] = {
    "seq_revcomp": f"{BASE} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM contigs",
    "seq_complement_iupac": f"""WITH {_codes} SELECT item_id, translate(codes, '{_both(IUPAC)}', '{_both(IUPAC_COMPLEMENT)}') AS complement,
      translate(codes, '{_both(_flat_from)}', '{_flat_to * 2}') AS flat, regexp_matches(codes, '[MRWSYKVHDBNmrwsykvhdbn]') AS has_codes FROM codes""",
    "seq_mask_trim": """SELECT doc_id, t AS trimmed, upper(t) AS folded FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z]', '', 'g'), '^[a-z]+', ''), '[a-z]+$', '') AS t FROM documents)""",
    "kmer_explode": f"""{BASE} SELECT doc_id, count(*) AS kmers, min(canon) AS first_canon, max(x)::INT AS last_x, count(DISTINCT canon) AS distinct_kmers
      FROM ({_kmers('contigs', 'doc_id')}) GROUP BY doc_id""",
    "kmer_spectrum": f"{BASE} SELECT n, count(*) AS kmers FROM (SELECT canon, count(*) AS n FROM ({_kmers('contigs', 'doc_id')}) GROUP BY canon) GROUP BY n",
    "kmer_distinct": f"""{BASE} SELECT coalesce(sum(n), 0)::BIGINT AS total_kmers, count(*) AS distinct_kmers, count(*) FILTER (WHERE n >= 2) AS repeated_kmers
      FROM (SELECT canon, count(*) AS n FROM ({_kmers('contigs', 'doc_id')}) GROUP BY canon)""",
    "kmer_histogram": f"""{BASE}, asked AS (SELECT row_number() OVER () AS key, kmer FROM ({_kmers('contigs', 'doc_id')})), {HASHED}
      SELECT copies, count(*) AS buckets FROM (SELECT h % 4194304 AS bucket, least(count(*), 255) AS copies FROM hashed WHERE h >> 47 = 1 GROUP BY bucket) GROUP BY copies""",
    "kmer_estimate": f"""{BASE}, asked AS (SELECT row_number() OVER () AS key, kmer FROM ({_kmers('contigs', 'doc_id')})), {HASHED},
      x AS (SELECT copies FROM (SELECT h % 4194304 AS bucket, least(count(*), 255) AS copies FROM hashed WHERE h >> 47 = 1 GROUP BY bucket)),
      e AS (SELECT 4194304 - count(*) AS x0, count(*) FILTER (WHERE copies = 1) AS x1 FROM x),
      f AS (SELECT (22 * ln(2::DOUBLE) - ln(x0)) * 274877906944::DOUBLE AS f0, x1 / x0::DOUBLE * 274877906944::DOUBLE AS once FROM e)
      SELECT trunc(f0)::BIGINT AS distinct_estimate, trunc(f0)::BIGINT - trunc(once)::BIGINT AS repeated_estimate FROM f""",
    "kmer_solid": f"{BASE}, {READS} SELECT canon FROM ({_kmers('reads', 'doc_id')}) GROUP BY canon HAVING count(*) >= 2",
    "kmer_ref_set": f"{BASE}, {KNOWN} SELECT canon FROM known",
    "kmer_missing": f"{BASE}, {TRANSCRIPTS}, {KNOWN}, {HITS} SELECT id, x, kmer FROM hits WHERE NOT hit",
    "hit_vector": f"""{BASE}, {TRANSCRIPTS}, {KNOWN}, {HITS} SELECT id, count(*) AS kmers, count(*) FILTER (WHERE hit) AS hits,
      sum(CASE WHEN hit THEN x ELSE 0 END)::BIGINT AS hit_places FROM hits GROUP BY id""",
    "first_match": f'{PROBED} SELECT id, first_x + 1 AS "start" FROM firsts',
    "last_match": f"{PROBED} SELECT id, last_pos FROM lasts",
    "junction_gaps_l0": f"{PROBED} SELECT id, start_x + {K} AS gap_start, end_x + {K} AS gap_end FROM gaps",
    "boundaries_l0": f"{PROBED}, {_bounds(0)} {ROWS}",
    "boundaries_plain": f"{PROBED}, {_bounds(LENIENCY)} {ROWS}",
    "exons_all_l0": f"{PROBED}, {_bounds(0)}, {_segments(False)} {EXONS}",
    "exons_confident_l0": f"{PROBED}, {_bounds(0)}, {_segments(True)} {EXONS}",
    "exons_plain": f"{PROBED}, {_bounds(LENIENCY)}, {_segments(True)} {EXONS}",
    "exon_blocks": f"{RECORDS} SELECT rec_no, exon, next_exon, is_first, is_last, terminal FROM blocks",
    "start_end_index": f"{RECORDS} SELECT side, kmer, exon FROM ends",
    "shared_kmer_groups": f"{RECORDS} SELECT side, kmer, exons, first_exon FROM shared",
    "exon_components": f"{MERGED} SELECT node AS exon, root AS component FROM comp",
    "merge_labels": f"{MERGED} SELECT exon, label FROM labels",
    "splice_edges": f"{GRAPH} SELECT line_no, src, dst FROM edges",
    "dot_lines": f"{GRAPH} SELECT src || '->' || dst || ';' AS line FROM edges",
    "graph_nodes": f"""{ORDER_EDGES} SELECT label, row_number() OVER (ORDER BY seen) AS node_id FROM (
      SELECT label, min(seen) AS seen FROM (SELECT src AS label, line_no * 2 AS seen FROM edges UNION ALL SELECT dst, line_no * 2 + 1 FROM edges) GROUP BY label)""",
    "graph_components": f"{ORDER_EDGES}, {GENES} SELECT exon, gene FROM genes",
    "exon_gene_map": f"{GRAPH}, {GENES} SELECT exon, gene FROM genes",
    "transcript_gene_map": f"{GRAPH}, {GENES} SELECT DISTINCT regexp_replace(unnest(string_split(exon, '_OR_')), '_[^_]*_[^_]*$', '') AS transcript, gene FROM genes",
    "subgraph_edges": f"{GRAPH}, {GENES} SELECT DISTINCT gene, src, dst FROM edges JOIN genes ON src = exon",
    "bloom_sizing": f"""{BASE}, {READS}, counted AS (SELECT canon, count(*) AS n FROM ({_kmers('reads', 'doc_id')}) GROUP BY canon),
      sized AS (SELECT 'primary' AS role, count(*) AS n_keys FROM counted UNION ALL SELECT 'secondary', count(*) FILTER (WHERE n >= 2) FROM counted),
      with_bits AS (SELECT role, n_keys, floor(-ln(0.01::DOUBLE) / ln(2::DOUBLE) / ln(2::DOUBLE) * n_keys)::BIGINT AS bits FROM sized)
      SELECT role, n_keys, bits, greatest(floor((bits // greatest(n_keys, 1)) * ln(2::DOUBLE)), 1)::INT AS hashes FROM with_bits""",
    "bloom_filter": f"""{BASE}, {KNOWN}, asked AS (SELECT canon AS key, canon AS kmer FROM known), {HASHED}, {FILTER}, places AS ({PLACES})
      SELECT n AS set_bits, bits, hashes, {K} AS k, round(power(n / bits::DOUBLE, hashes), 9) AS rate FROM (SELECT count(DISTINCT place) AS n FROM places), sized""",
    "bloom_probe": f"""{BASE}, {KNOWN}, passages AS (SELECT item_id AS doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM benchmark),
      mine AS MATERIALIZED (SELECT DISTINCT canon FROM ({_kmers('passages', 'doc_id')})),
      asked AS (SELECT canon AS key, canon AS kmer FROM known UNION SELECT canon, canon FROM mine), {HASHED}, {FILTER}, places AS MATERIALIZED ({PLACES}),
      bits_set AS MATERIALIZED (SELECT DISTINCT place FROM places JOIN known ON key = canon),
      found AS (SELECT m.canon, bool_and(b.place IS NOT NULL) AS present FROM mine m JOIN places p ON m.canon = p.key LEFT JOIN bits_set b ON p.place = b.place GROUP BY m.canon)
      SELECT k.canon IS NOT NULL AS known, present, count(*) AS kmers FROM found f LEFT JOIN known k ON f.canon = k.canon GROUP BY ALL""",
    "solid_cascade": f"""{BASE}, {READS}, counted AS MATERIALIZED (SELECT canon, count(*) AS n FROM ({_kmers('reads', 'doc_id')}) GROUP BY canon), asked AS (SELECT canon AS key, canon AS kmer FROM counted),
      {HASHED}, {FILTER.replace('FROM known', 'FROM counted')}, places AS MATERIALIZED (SELECT DISTINCT key, place FROM ({PLACES})),
      planes AS MATERIALIZED (SELECT place, sum(n) AS n FROM places JOIN counted ON key = canon GROUP BY place),
      found AS (SELECT key, bool_and(p.n >= 2) AS present FROM places JOIN planes p USING (place) GROUP BY key)
      SELECT any_value(bits) AS bits, any_value(hashes) AS hashes, any_value(seen) AS seen_bits, any_value(twice) AS again_bits, count(*) FILTER (WHERE n >= 2) AS solid, count(*) FILTER (WHERE present) AS found,
        count(*) FILTER (WHERE present AND n < 2) AS false_solids, count(*) FILTER (WHERE NOT present AND n >= 2) AS lost
      FROM counted JOIN found ON key = canon, sized, (SELECT count(*) AS seen, count(*) FILTER (WHERE n >= 2) AS twice FROM planes)""",
    "exons_bloom": f"""{BASE}, {TRANSCRIPTS}, {KNOWN.replace('known AS', 'truth AS')}, mine AS MATERIALIZED (SELECT DISTINCT canon FROM ({_kmers('transcripts', 'id')})),
      asked AS (SELECT canon AS key, canon AS kmer FROM truth UNION SELECT canon, canon FROM mine), {HASHED}, {FILTER.replace('FROM known', 'FROM truth')}, places AS MATERIALIZED ({PLACES}),
      bits_set AS MATERIALIZED (SELECT DISTINCT place FROM places JOIN truth ON key = canon),
      known AS MATERIALIZED (SELECT m.canon FROM mine m JOIN places p ON m.canon = p.key LEFT JOIN bits_set b ON p.place = b.place GROUP BY m.canon HAVING bool_and(b.place IS NOT NULL)),
      {HITS}, {SCANNED}, {_bounds(0)}, {_segments(True)} {EXONS}""",
    "run_metrics": f"""{BASE}, {READS}, counted AS (SELECT canon, count(*) AS n FROM ({_kmers('reads', 'doc_id')}) GROUP BY canon)
      SELECT any_value(reads) AS reads, any_value(bases)::BIGINT AS bases, sum(n)::BIGINT AS total, count(*) AS "distinct", count(*) FILTER (WHERE n >= 2) AS solid, max(n) AS most
      FROM counted, (SELECT count(*) AS reads, sum(length(seq)) AS bases FROM reads)""",
    "splice_extend": f"""{PROBED}, {_bounds(LENIENCY)}, {_segments(True)}, exons0 AS MATERIALIZED (SELECT concat_ws('_', id, "start", "end", exon_no) AS id, exon_seq AS seq FROM ({EXONS})),
      {_walk('lw')}, {_walk('rw')},
      found AS (SELECT e.id, seq, coalesce(l.found, '') AS l, coalesce(r.found, '') AS r FROM exons0 e LEFT JOIN lw6 l ON e.id = l.id LEFT JOIN rw6 r ON e.id = r.id),
      signals AS (SELECT *, list_max(list_filter(range(1, length(l)), lambda y: list_contains({_signals(LEFT_SIGNALS)}, substr(l, y, 2)))) AS nl,
        list_min(list_filter(range(1, length(r)), lambda y: list_contains({_signals(RIGHT_SIGNALS)}, substr(r, y, 2)))) AS nr FROM found)
      SELECT id, coalesce(substr(l, nl + 2, 6), '') || seq || coalesce(substr(r, 1, nr - 1), '') AS extended_seq FROM signals""",
    "si_format": f"""SELECT l_orderkey, l_linenumber,
      CASE WHEN l_extendedprice < 1e3 THEN {_sig('l_extendedprice', 3, ' ')} WHEN l_extendedprice < 1e6 THEN {_sig('l_extendedprice / 1e3::DOUBLE', 3, ' k')} ELSE {_sig('l_extendedprice / 1e6::DOUBLE', 3, ' M')} END AS si,
      CASE WHEN n < 1024 THEN n::VARCHAR WHEN n < 1048576 THEN {_sig('n / 1024::DOUBLE', 3, 'k')} WHEN n < 1073741824 THEN {_sig('n / 1048576::DOUBLE', 3, 'M')} ELSE {_sig('n / 1073741824::DOUBLE', 3, 'G')} END AS bytes_si,
      CASE WHEN n < 10000000 THEN n::VARCHAR WHEN n < 1000000000 THEN {_sig('n / 1e6::DOUBLE', 4, 'e6')} ELSE {_sig('n / 1e9::DOUBLE', 4, 'e9')} END AS eng
      FROM (SELECT *, {_n} AS n FROM lineitem)""",
    "si_parse": f"SELECT p_partkey, ({_quantity(1000)})::DOUBLE AS number, ceil({_quantity(1024)})::BIGINT AS bytes FROM ({_parts})",
    "read_pair": f"""SELECT o_orderkey, a = b OR (b LIKE '%/2' AND a[:-2] = b[:-2]) AS pair, b LIKE 'r1%' AS starts, b LIKE '%/2' AS ends,
      CASE WHEN b LIKE '%1' THEN b[:-2] ELSE b END AS chomped FROM (SELECT o_orderkey, 'r' || (o_custkey % 10) || '/1' AS a, {_b} AS b FROM orders)""",
    "ambiguity_ops": f"""WITH {_codes}, pairs AS (SELECT item_id, place::INT AS place, codes[place + 1] AS a, codes[place + 2] AS b FROM (
        SELECT item_id, codes, unnest(range(0, length(codes) - 1)) AS place FROM codes WHERE length(codes) > 1)),
      masks AS (SELECT *, '{MASK_IUPAC}'[({_mask('a')} & {_mask('b')}) + 1] AS m, '{MASK_IUPAC}'[({_mask('a')} | {_mask('b')}) + 1] AS o FROM pairs),
      cased AS (SELECT *, CASE WHEN {_low('a')} AND {_low('b')} THEN lower(m) ELSE m END AS common, CASE WHEN {_low('a')} OR {_low('b')} THEN lower(o) ELSE o END AS united FROM masks)
      SELECT item_id, place, common, united, common = a OR common = b AS nested FROM cased""",
    "kmer_masked": f"""WITH masked AS (SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '{LETTERS}{DIGITS}', '{BASES}{"N" * len(DIGITS)}') AS seq FROM documents)
      SELECT doc_id, count(*) AS kmers, sum(x)::BIGINT AS places, count(DISTINCT canon) AS distinct_kmers FROM ({_kmers('masked', 'doc_id')}) WHERE NOT contains(kmer, 'N') GROUP BY doc_id""",
    "colour_space": f"""{BASE}, {READS} SELECT doc_id, r, array_to_string(list_transform(range(1, length(seq)),
        lambda i: xor(strpos('ACGT', seq[i]) - 1, strpos('ACGT', seq[i + 1]) - 1)), '') AS colours, seq AS bases FROM reads""",
}
