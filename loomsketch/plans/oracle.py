"""DuckDB SQL for the queries in .queries, written independently of the operators."""

from __future__ import annotations

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FOLDED = "".join("ACGT"[i % 4] for i in range(26))
_INNER = " || ".join(f"substr('ACGT', CAST(((i >> {2 * (7 - j)}) & 3) + 1 AS INTEGER), 1)" for j in range(8))
_VALUE = " + ".join(f"(strpos('ACGT', substr(c, {p}, 1)) - 1) * {4**e}" for p, e in ((1, 3), (2, 2), (11, 1), (12, 0)))

_KEPT = f"""
dim AS (SELECT i, row_number() OVER (ORDER BY md5('42:' || i)) - 1 AS rk FROM range(65536) t(i)),
kept AS (
  SELECT row_number() OVER (ORDER BY m) - 1 AS rk, {_INNER} AS inner_s
  FROM (SELECT i, md5('42:' || i) AS m FROM range(65536) t(i) ORDER BY m LIMIT 4096)
)"""


def _fold(text: str) -> str:
    return f"translate(lower(regexp_replace({text}, '[^A-Za-z]+', '', 'g')), '{_LETTERS}', '{_FOLDED}')"


def _codes(name: str, table: str, key: str, seq: str | None = None) -> str:
    """CTEs that end in `name`(sketch_id, code, n)."""
    return f"""
{name}_p AS (
  SELECT sketch_id, substr(s, CAST(a AS INTEGER), 523) AS s
  FROM (SELECT {key} AS sketch_id, {seq or _fold("text")} AS s FROM {table}) d, LATERAL (SELECT unnest(range(1, length(s) + 1, 512)) AS a) x
),
{name}_f AS (
  SELECT sketch_id, substr(s, CAST(p AS INTEGER), 12) AS f
  FROM {name}_p d, LATERAL (SELECT unnest(range(1, greatest(length(s) - 10, 1))) AS p) x
),
{name}_c AS (SELECT sketch_id, f, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS c FROM {name}_f WHERE NOT contains(f, 'N')),
{name} AS (
  SELECT sketch_id, CAST(({_VALUE}) * 4096 + rk AS BIGINT) AS code, count(*) AS n, min(c) AS kmer
  FROM {name}_c JOIN kept ON substr(c, 3, 8) = inner_s GROUP BY 1, 2
)"""


_MASKED = f"translate(upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')), '{_LETTERS.upper()}', 'N{_FOLDED[1:]}')"
_DOCS, _ITEMS = _codes("docs", "documents", "doc_id"), _codes("items", "benchmark", "item_id")
_SIZES = """
doc_sizes AS (SELECT d.doc_id AS sketch_id, count(s.code) AS n_codes FROM documents d LEFT JOIN docs s ON s.sketch_id = d.doc_id GROUP BY 1)"""
_ITEM_SIZES = """
item_sizes AS (SELECT d.item_id AS sketch_id, count(s.code) AS n_codes FROM benchmark d LEFT JOIN items s ON s.sketch_id = d.item_id GROUP BY 1)"""
_PAIRS = f"""WITH {_KEPT}, {_DOCS}, {_ITEMS}, {_SIZES}, {_ITEM_SIZES},
shared AS (SELECT q.sketch_id AS qry, r.sketch_id AS ref, count(*) AS xny FROM items q JOIN docs r ON q.code + 0 = r.code + 0 GROUP BY 1, 2),
pairs AS (SELECT qry, ref, xny, x.n_codes AS x_size, y.n_codes AS y_size FROM shared JOIN doc_sizes x ON x.sketch_id = ref JOIN item_sizes y ON y.sketch_id = qry)"""
_SELF = f"""WITH {_KEPT}, {_DOCS}, {_SIZES},
shared AS (SELECT q.sketch_id AS qry, r.sketch_id AS ref, count(*) AS xny FROM docs q JOIN docs r USING (code) GROUP BY 1, 2),
pairs AS (SELECT qry, ref, xny, x.n_codes AS x_size, y.n_codes AS y_size FROM shared JOIN doc_sizes x ON x.sketch_id = ref JOIN doc_sizes y ON y.sketch_id = qry)"""
_J = "CASE WHEN x_size + y_size - xny > 0 THEN CAST(xny AS DOUBLE) / (x_size + y_size - xny) END"
_C = "CASE WHEN least(x_size, y_size) > 0 THEN CAST(xny AS DOUBLE) / least(x_size, y_size) END"
_MASH = "CASE WHEN metric = 0 THEN 1.0 WHEN metric > 0 THEN least(ln(1 / (2 * metric) + 0.5) / 12, 1.0) END"
_AAF = "CASE WHEN metric = 0 THEN 1.0 WHEN metric > 0 THEN least(ln(1 / metric) / 12, 1.0) END"

_COEFFICIENTS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_ERFC = " + t * (".join(f"CAST({c} AS DOUBLE)" for c in _COEFFICIENTS) + ")" * (len(_COEFFICIENTS) - 1)


def _six(value: str) -> str:
    return f"coalesce(printf('%.6f', round({value}, 6)), '')"


_BOUGHT = """
bought AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, l_partkey, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
customers AS (SELECT c_custkey AS sketch_id, l_partkey AS code, CAST(least(sum(q), 65535) AS INTEGER) AS abundance FROM bought GROUP BY 1, 2),
nations AS (SELECT CAST(c_nationkey AS BIGINT) AS sketch_id, l_partkey AS code, CAST(least(sum(q), 65535) AS INTEGER) AS abundance FROM bought GROUP BY 1, 2),
suppliers AS (SELECT DISTINCT l_suppkey AS sketch_id, l_partkey AS code FROM lineitem),
pan AS (SELECT p_partkey AS code FROM part WHERE p_size > 25)"""
_STATS = f"""WITH {_BOUGHT},
both_ AS (SELECT n.sketch_id AS qry, s.sketch_id AS ref, abundance FROM nations n JOIN suppliers s USING (code)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qry, ref ORDER BY abundance) AS i, count(*) OVER (PARTITION BY qry, ref) AS n FROM both_),
stats AS (
  SELECT qry, ref, max(n) AS n_shared, CAST(sum(abundance) AS DOUBLE) / max(n) AS mean,
    CAST(sum(CASE WHEN i BETWEEN floor(n * CAST(0.98 AS DOUBLE)) AND n * CAST(0.99 AS DOUBLE) THEN abundance END) AS DOUBLE)
      / nullif(count(CASE WHEN i BETWEEN floor(n * CAST(0.98 AS DOUBLE)) AND n * CAST(0.99 AS DOUBLE) THEN 1 END), 0) AS trimmed_mean,
    max(CASE WHEN i = n // 2 THEN abundance END) AS median, max(abundance) AS peak
  FROM ranked WHERE n >= 6 GROUP BY 1, 2
),
passing AS (SELECT qry AS sample_id, ref AS ref_id, trimmed_mean AS t FROM stats WHERE median > 1 AND n_shared > 7),
abv AS (SELECT sample_id, ref_id, (t - 1) * 100 / nullif(sum(t) OVER w - count(*) OVER w, 0) AS pct FROM passing WINDOW w AS (PARTITION BY sample_id)),
norms AS (SELECT sample_id, sqrt(sum(pct * pct)) AS norm FROM abv GROUP BY 1),
met AS (SELECT x.sample_id AS qry, y.sample_id, x.pct AS x, y.pct AS y FROM abv x JOIN abv y USING (ref_id)),
cosine AS (
  SELECT qry, m.sample_id, sum(x * y) / nullif(max(a.norm) * max(b.norm), 0) AS measure
  FROM met m JOIN norms a ON a.sample_id = qry JOIN norms b ON b.sample_id = m.sample_id GROUP BY 1, 2
),
taxa AS (SELECT qry AS sample, CAST(s_nationkey + 1000 AS BIGINT) AS taxon, n_shared, trimmed_mean, median FROM stats JOIN supplier ON s_suppkey = ref)"""


def _depth(more: int, least: str) -> str:
    return f"""CASE WHEN n_shared <= {more} THEN NULL WHEN trimmed_mean > 3 AND median > 1 THEN trimmed_mean - 3
      WHEN trimmed_mean >= 2 THEN greatest(trimmed_mean - 3, {least}) END"""


SQL: dict[str, str] = {
    "sketch_codes": f"WITH {_KEPT}, {_DOCS} SELECT sketch_id, code FROM docs",
    "sketch_sizes": f"WITH {_KEPT}, {_DOCS}, {_SIZES} SELECT * FROM doc_sizes",
    "sketch_total": f"WITH {_KEPT}, {_DOCS} SELECT count(*) AS n_codes, count(DISTINCT sketch_id) AS n_sketches FROM docs",
    "sketch_offsets": f"WITH {_KEPT}, {_ITEMS}, {_ITEM_SIZES} SELECT sketch_id, n_codes, CAST(sum(n_codes) OVER (ORDER BY sketch_id) AS BIGINT) AS end_offset FROM item_sizes",
    "sketch_uniq": f"WITH {_KEPT}, {_DOCS} SELECT sketch_id, code FROM docs WHERE n = 1",
    "sketch_min_occ": f"WITH {_KEPT}, {_DOCS} SELECT sketch_id, code FROM docs WHERE n >= 2",
    "sketch_abundance": f"WITH {_KEPT}, {_DOCS} SELECT sketch_id, code, CAST(least(n, 65535) AS INTEGER) AS abundance FROM docs",
    "sketch_low_quality": f"WITH {_KEPT}, {_codes('low', 'benchmark', 'item_id', _MASKED)} SELECT sketch_id, code FROM low",
    "by_record_codes": f"WITH {_KEPT}, {_codes("records", "conversations", "conv_id || ':' || turn")} SELECT sketch_id, code, n FROM records",
    "code_components": f"WITH {_KEPT}, {_ITEMS} SELECT sketch_id, code, code % 16 AS component, code // 16 AS stored_id FROM items",
    "shuffle_permutation": f"WITH {_KEPT} SELECT i AS inner, rk FROM dim".replace("AS inner,", 'AS "inner",'),
    "postings": f"WITH {_KEPT}, {_DOCS} SELECT code, count(*) AS n_sketches, string_agg(sketch_id, ',' ORDER BY sketch_id) AS sketch_ids FROM docs GROUP BY 1",
    "shared_counts": f"{_SELF} SELECT * FROM shared",
    "jaccard_mash": f"{_PAIRS}, m AS (SELECT *, {_J} AS metric FROM pairs) SELECT qry, ref, xny, x_size, y_size, metric, round({_MASH}, 6) AS distance FROM m",
    "containment_aaf": f"{_PAIRS}, m AS (SELECT *, {_C} AS metric FROM pairs) SELECT qry, ref, xny, x_size, y_size, metric, round({_AAF}, 6) AS distance FROM m",
    "corrected_jaccard": f"""{_PAIRS},
p AS (SELECT *, 1 - pow(1 - pow(4.0, -10), x_size - xny) AS px, 1 - pow(1 - pow(4.0, -10), y_size - xny) AS py FROM pairs),
r AS (SELECT *, CASE WHEN px + py - 2 * px * py > 0 THEN px * py * (x_size + y_size - 2 * xny) / (px + py - 2 * px * py) ELSE 0 END AS rs FROM p)
SELECT qry, ref, printf('%d-%d|%d|%d', xny, CAST(floor(rs) AS BIGINT), x_size, y_size) AS counts, round(rs, 6) AS rs,
  round((xny - rs) / nullif(x_size + y_size - xny, 0), 6) AS metric FROM r""",
    "jaccard_ci": f"""{_PAIRS}, m AS (SELECT *, {_J} AS metric FROM pairs),
s AS (SELECT *, sqrt(metric * (1 - metric) / (x_size + y_size - xny)) AS sd FROM m),
b AS (SELECT *, metric - 1.96 * sd AS lo, metric + 1.96 * sd AS hi FROM s)
SELECT qry, ref, metric, round(sd, 6) AS sd, round(lo, 6) AS metric_low, round(hi, 6) AS metric_high,
  round(CASE WHEN hi > 0 THEN ln(1 / (2 * hi) + 0.5) / 12 END, 6) AS distance_low,
  round(CASE WHEN lo > 0 THEN ln(1 / (2 * lo) + 0.5) / 12 END, 6) AS distance_high FROM b""",
    "pvalue": f"""{_PAIRS}, m AS (SELECT *, {_J} AS metric FROM pairs),
s AS (SELECT *, sqrt(metric * (1 - metric) / (x_size + y_size - xny)) AS sd FROM m),
z AS (SELECT *, CASE WHEN sd > 0 THEN metric / sd * sqrt(CAST(0.5 AS DOUBLE)) END AS x FROM s),
t AS (SELECT *, 1 / (1 + x / 2) AS t FROM z),
p AS (SELECT qry, ref, metric, CASE WHEN sd > 0 THEN t * exp({_ERFC} - x * x) / 2 WHEN metric = 1 THEN 0 END AS p FROM t)
SELECT qry, ref, metric, round(p, 12) AS p_value, round(p * ((SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark)), 8) AS q_value FROM p""",
    "report_lines": f"""{_PAIRS}, m AS (SELECT *, {_J} AS metric FROM pairs),
s AS (SELECT *, sqrt(metric * (1 - metric) / (x_size + y_size - xny)) AS sd FROM m),
b AS (SELECT *, metric - 1.96 * sd AS lo, metric + 1.96 * sd AS hi, {_MASH} AS distance FROM s)
SELECT qry AS "Qry", ref AS "Ref", printf('%d-0|%d|%d', xny, x_size, y_size) AS counts, {_six("metric")} AS "Jaccard", {_six("distance")} AS "MashD",
  '[' || {_six("lo")} || ',' || {_six("hi")} || ']' AS "Jaccard_CI",
  '[' || {_six("CASE WHEN hi > 0 THEN ln(1 / (2 * hi) + 0.5) / 12 END")} || ',' || {_six("CASE WHEN lo > 0 THEN ln(1 / (2 * lo) + 0.5) / 12 END")} || ']' AS "MashD_CI" FROM b""",
    "by_read_kmers": f"WITH {_KEPT}, {_codes('records', 'conversations', "conv_id || ':' || turn")} SELECT sketch_id, '>read ' || sketch_id || chr(10) || string_agg(repeat(kmer || chr(10), n), '' ORDER BY code) AS text FROM records GROUP BY 1",
    "canonical_kmers": f"""SELECT DISTINCT least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM (
  SELECT substr(s, CAST(p AS INTEGER), 11) AS f FROM (SELECT {_fold("text")} AS s FROM benchmark) d, LATERAL (SELECT unnest(range(1, greatest(length(s) - 9, 1))) AS p) x)""",
    "dense_pairs": f"""{_PAIRS},
every AS (SELECT y.sketch_id AS qry, x.sketch_id AS ref, x.n_codes AS x_size, y.n_codes AS y_size FROM item_sizes y CROSS JOIN doc_sizes x),
filled AS (SELECT e.qry, e.ref, coalesce(s.xny, 0) AS xny, e.x_size, e.y_size FROM every e LEFT JOIN shared s ON s.qry = e.qry AND s.ref = e.ref),
m AS (SELECT *, {_J} AS metric FROM filled)
SELECT qry, ref, xny, x_size, y_size, metric, round({_MASH}, 6) AS distance FROM m""",
    "top_n_neighbors": f"""{_SELF}, m AS (SELECT *, {_J} AS metric FROM pairs WHERE qry <> ref),
k AS (SELECT *, row_number() OVER (PARTITION BY qry ORDER BY metric DESC, ref) AS r FROM m)
SELECT qry, CAST(r AS INTEGER) AS rank, ref, xny, metric, round({_MASH}, 6) AS distance FROM k WHERE r <= 3""",
    "distance_threshold": f"""{_SELF}, m AS (SELECT *, {_J} AS metric FROM pairs), e AS (SELECT *, {_MASH} AS distance FROM m)
SELECT qry, ref, xny, round(distance, 6) AS distance FROM e WHERE distance <= 0.05""",
    "set_union": f"WITH {_BOUGHT} SELECT DISTINCT code FROM customers",
    "set_uniq_union": f"WITH {_BOUGHT} SELECT code FROM suppliers GROUP BY 1 HAVING count(*) = 1",
    "set_intersect": f"WITH {_BOUGHT} SELECT * FROM customers WHERE code IN (SELECT code FROM pan)",
    "set_subtract": f"WITH {_BOUGHT} SELECT * FROM customers WHERE code NOT IN (SELECT code FROM pan)",
    "set_combine": f"""WITH {_BOUGHT}
SELECT CAST(0 AS BIGINT) AS sketch_id, 'bought' AS name, code FROM (SELECT DISTINCT code FROM customers)
UNION ALL SELECT 1, 'supplied', code FROM pan
UNION ALL SELECT 2, 'single', code FROM (SELECT code FROM suppliers GROUP BY 1 HAVING count(*) = 1)""",
    "combine_batches": f"""WITH {_BOUGHT} SELECT sketch_id, code FROM customers
UNION ALL SELECT sketch_id + (SELECT count(*) FROM customer), code FROM suppliers""",
    "set_group": f"""WITH {_BOUGHT} SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS category,
  CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey || '_n' || s_nationkey ELSE CAST(s_nationkey AS VARCHAR) END AS name, code
FROM suppliers JOIN supplier ON s_suppkey = sketch_id WHERE s_nationkey <> 0""",
    "set_names": "SELECT s_suppkey AS sketch_id, s_name AS name FROM supplier",
    "category_conflicts": """SELECT CAST(c_nationkey AS BIGINT) AS category, count(DISTINCT CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment ELSE '' END) AS n_names
FROM customer GROUP BY 1 HAVING n_names > 1""",
    "decode_kmers": f"WITH {_KEPT}, {_DOCS} SELECT sketch_id, code, kmer FROM docs",
    "composite_stats": f"{_STATS} SELECT * FROM stats",
    "composite_order": f"{_STATS} SELECT qry, ref, n_shared FROM stats",
    "abundance_vectors": f"{_STATS} SELECT sample_id, ref_id, round(pct, 6) AS pct FROM abv",
    "vector_norms": f"{_STATS} SELECT sample_id, round(norm, 6) AS norm FROM norms",
    "search_cosine": f"{_STATS} SELECT qry, sample_id, round(measure, 6) AS measure FROM cosine",
    "search_l1": f"{_STATS} SELECT qry, sample_id, round(sum(abs(x - y)) + 200 - sum(x) - sum(y), 6) + 0.0 AS measure FROM met GROUP BY 1, 2",
    "search_l2": f"{_STATS} SELECT qry, sample_id, round(sqrt(sum((x - y) * (x - y))), 6) AS measure FROM met GROUP BY 1, 2",
    "lookup_default": "SELECT d.doc_id, coalesce(CAST(q AS VARCHAR), '0') AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)",
    "lookup_concat": """SELECT n_nationkey, n_name, coalesce(v, '0') AS c_mktsegment FROM nation LEFT JOIN
(SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS v FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""",
    "lookup_regex": """SELECT o_orderkey, o_orderpriority, coalesce(r_name, '0') AS r_name FROM orders
LEFT JOIN region ON r_regionkey = try_cast(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS INTEGER)""",
    "metadata_join": f"""{_STATS} SELECT CAST(c.sample_id AS VARCHAR) AS run, round(measure, 6) AS measure,
  CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_regionkey AS VARCHAR) ELSE 'NA' END AS project,
  CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE 'NA' END AS sample, CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE 'NA' END AS organism
FROM cosine c JOIN nation ON n_nationkey = c.sample_id""",
    "semi_subset": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "best_support": """SELECT c_nationkey, c_mktsegment, support FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY support DESC, c_mktsegment) AS r
  FROM (SELECT c_nationkey, c_mktsegment, count(*) AS support FROM customer GROUP BY 1, 2)) WHERE r = 1""",
    "all_support": """SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY support DESC, c_mktsegment) AS INTEGER) AS place
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS support FROM customer GROUP BY 1, 2)""",
    "taxon_rollup": f"""{_STATS},
dep AS (SELECT sample, taxon, {_depth(7, "0.001")} AS depth FROM taxa),
per AS (SELECT sample, taxon, depth * 100 / sum(depth) OVER (PARTITION BY sample) AS percentage FROM dep WHERE depth IS NOT NULL)
SELECT sample, taxon, 'species' AS rank, round(sum(percentage), 6) AS percentage FROM per GROUP BY 1, 2
UNION ALL SELECT sample, CAST(n_regionkey + 100 AS BIGINT), 'genus', round(sum(percentage), 6) FROM per JOIN nation ON n_nationkey + 1000 = taxon GROUP BY 1, 2""",
    "lineage_paths": """SELECT CAST(n_nationkey + 1000 AS BIGINT) AS node, (r_regionkey + 100) || '|' || (n_nationkey + 1000) AS path, r_name || '|' || n_name AS names
FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), CAST(r_regionkey + 100 AS VARCHAR), r_name FROM region""",
    "krona_profile": f"""{_STATS},
one AS (SELECT sample, taxon, max(n_shared) AS n_shared, max(trimmed_mean) AS trimmed_mean, max(median) AS median FROM taxa GROUP BY 1, 2),
dep AS (SELECT sample, taxon, {_depth(8, "0.1")} AS depth FROM one)
SELECT sample, taxon, round(depth * 100 / sum(depth) OVER (PARTITION BY sample), 6) AS percentage, r_name || ';' || n_name AS lineage
FROM dep JOIN nation ON n_nationkey + 1000 = taxon JOIN region ON r_regionkey = n_regionkey WHERE depth IS NOT NULL""",
    "otu_pivot": f"""WITH {_BOUGHT}
SELECT c_nationkey AS lineage, {", ".join(f"CAST(coalesce(sum(CASE WHEN c_mktsegment = '{s}' THEN q END), 0) AS BIGINT) AS {s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}
FROM bought GROUP BY 1""",
    "otu_numbers": "SELECT lineage, row_number() OVER (ORDER BY p) - 1 AS otu FROM (SELECT c_mktsegment AS lineage, min(c_custkey) AS p FROM customer GROUP BY 1)",
    "format_census": """SELECT CASE WHEN p_partkey % 5 IN (0, 1) THEN 'fasta' WHEN p_partkey % 5 IN (2, 3) THEN 'fastq' ELSE 'co' END AS format, count(*) AS n_files
FROM part GROUP BY 1""",
    "archive_paths": """SELECT p_partkey, 'archive:/all/GCA/' || substr(z, 1, 3) || '/' || substr(z, 4, 3) || '/' || substr(z, 7, 3) || '/' || nm || '/' || nm || '_genomic.fna.gz' AS path
FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS z, 'GCA_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.1_' || regexp_replace(p_name, '\\s', '_', 'g') AS nm FROM part)""",
    "clean_names": "SELECT page_id, regexp_replace(url, '[^0-9a-zA-Z_.]', '_', 'g') AS name, regexp_extract(url, '([^/]*)/*$', 1) AS base FROM pages",
    "fasta_records": f"SELECT item_id, item_id || ' item' AS header, coalesce({_fold('text')}, '') AS seq FROM benchmark",
    "fasta_sketch": f"WITH {_KEPT}, {_codes('low', 'benchmark', 'item_id', _MASKED)} SELECT sketch_id, code FROM low",
    "fastq_records": f"SELECT '@:' || conv_id || ':' || turn AS id, {_fold("coalesce(text, '')")} AS seq, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g')) AS quality FROM conversations",
    "fastq_abundance": f"WITH {_KEPT}, {_codes('records', 'conversations', "conv_id || ':' || turn")} SELECT CAST(0 AS BIGINT) AS sketch_id, code, CAST(least(sum(n), 65535) AS INTEGER) AS abundance FROM records GROUP BY code",
    "sketch_files": f"""WITH {_BOUGHT}
SELECT c_custkey AS sketch_id, c_name AS name, count(code) OVER (PARTITION BY c_custkey) AS n_codes, code, abundance
FROM customer LEFT JOIN customers ON sketch_id = c_custkey""",
    "abundance_index": f"{_STATS} SELECT qry, n_name AS name, round(measure, 6) AS measure FROM cosine JOIN nation ON n_nationkey = sample_id",
    "shared_count_table": f"{_PAIRS} SELECT qry, ref, xny, {_C} AS metric FROM pairs",
    "report_file": f"""{_PAIRS}, m AS (SELECT *, {_J} AS metric FROM pairs)
SELECT CAST(qry AS VARCHAR) AS "Qry", CAST(ref AS VARCHAR) AS "Ref", printf('%d-0|%d|%d', xny, x_size, y_size) AS counts, {_six("metric")} AS "Jaccard", {_six(_MASH)} AS "MashD" FROM m""",
    "path_list_formats": """SELECT '/in/' || p_partkey || ['.fa', '.fna.gz', '.fastq', '.fq.gz', '.co'][p_partkey % 5 + 1] AS path,
  CASE WHEN p_partkey % 5 IN (0, 1) THEN 'fasta' WHEN p_partkey % 5 IN (2, 3) THEN 'fastq' ELSE 'co' END AS format FROM part""",
    "format_census_list": "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'fastq' ELSE 'fasta' END AS format, count(*) AS n_files FROM part GROUP BY 1",
}
