"""The same queries in DuckDB's SQL, by plain definitions."""

FILES = r"""files AS (
  SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS path, lang AS language, CAST(strlen(text) AS BIGINT) AS bytes,
    CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS loc, substr(sha256(text), 1, 16) AS hash FROM documents)"""
_PREVIOUS = "previous AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 'x' || hash ELSE hash END AS hash) FROM files WHERE doc_id % 10 <> 0)"
LINES = r"""lines AS (
  SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS path, lang AS language, CAST(k AS BIGINT) AS line, a[k] AS text
  FROM (SELECT *, string_split(text, chr(10)) AS a FROM documents), unnest(range(1, len(a) + 1)) AS u(k))"""
EDGES = """edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
    FROM lineitem) WHERE src <> dst),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"""
LINKS = """links AS (
  SELECT DISTINCT src, dst FROM (
    SELECT p_partkey AS src, p_partkey - 1 AS dst FROM part WHERE p_partkey % 50 <> 0 AND p_partkey > 1
    UNION ALL SELECT p_partkey, (p_partkey * 7 + 2) % (SELECT max(p_partkey) FROM part) + 1 FROM part WHERE p_partkey % 100 = 25
    UNION ALL SELECT p_partkey, p_partkey + 6 FROM part WHERE p_partkey % 70 = 30 AND p_partkey + 6 <= (SELECT max(p_partkey) FROM part)) WHERE src <> dst),
nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links)"""
_COMMITS = """commits AS (
  SELECT l_partkey AS path, l_suppkey AS author, l_orderkey AS sha, l_shipdate AS ts,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey) AS ordinal FROM lineitem)"""
REACH = f"{LINKS}, reach(root, node) AS (SELECT dst, src FROM links UNION SELECT root, src FROM reach JOIN links ON node = dst)"
_IMPORTS = r"""f AS (SELECT p_partkey AS k, 'src/m' || (p_partkey % 13) || '/f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.ts' END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'typescript' END AS language, (p_partkey * 7 + 2) % 1000 AS o FROM part),
i AS (SELECT path, language, CASE k % 10 WHEN 0 THEN 'm' || (o % 13) || '.f' || o WHEN 2 THEN '..m' || (o % 13) || '.f' || o WHEN 4 THEN 'numpy' WHEN 1 THEN '../m' || (o % 13) || '/f' || o
    WHEN 3 THEN '@/m' || (o % 13) || '/f' || o WHEN 5 THEN './f' || o ELSE 'pkg' || (k % 5) END AS specifier,
  CASE k % 10 WHEN 0 THEN ['m' || (o % 13) || '/f' || o, 'src/m' || (o % 13) || '/f' || o] WHEN 2 THEN ['src/m' || (o % 13) || '/f' || o] WHEN 4 THEN ['numpy', 'src/numpy']
    WHEN 1 THEN ['src/m' || (o % 13) || '/f' || o] WHEN 3 THEN ['m' || (o % 13) || '/f' || o, 'src/m' || (o % 13) || '/f' || o, 'app/m' || (o % 13) || '/f' || o]
    WHEN 5 THEN ['src/m' || (k % 13) || '/f' || o] ELSE CASE WHEN k % 2 = 0 THEN ['pkg' || (k % 5), 'src/pkg' || (k % 5)] ELSE [] END END AS bases,
  CASE k % 10 WHEN 0 THEN 0.2 WHEN 3 THEN 0.3 ELSE 0 END AS less FROM f),
r AS (
  SELECT path, language, specifier, (SELECT min(g.path) FROM f g WHERE g.path IN (SELECT b || e FROM unnest(bases) AS x(b), unnest(CASE language WHEN 'python' THEN ['.py', '.pyi'] ELSE ['.ts', '.tsx', '.d.ts', '.js', '.mjs', '.cjs', '.json'] END) AS y(e))) AS target, less FROM i),
resolved AS (
  SELECT path, language, specifier, target, CASE WHEN target IS NOT NULL THEN round(0.9 - less, 2) END AS confidence,
    CASE WHEN target = path THEN 'self' WHEN target IS NOT NULL THEN 'resolved' WHEN regexp_matches(specifier, '^[./]') THEN 'unresolved' ELSE 'external' END AS outcome FROM r)"""
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


def _search(kind: str, table: str, key: str, text: str, question: str, n: int) -> str:
    a, b = _TRI.format(text), _TRI.format(f"'{question}'")
    score = f"round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6)"
    return f"(SELECT * FROM (SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS key, {text} AS text, {score} AS score FROM {table}) WHERE score > 0.1 ORDER BY score DESC, key LIMIT {n})"


ORACLE_SQL: dict[str, str] = {
    "inventory_files": f"WITH {FILES} SELECT * EXCLUDE (doc_id) FROM files",
    "inventory_totals": f"WITH {FILES} SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(loc) AS BIGINT) AS loc, count(*) FILTER (doc_id % 5 > 0) AS parsed FROM files",
    "language_totals": f"WITH {FILES} SELECT coalesce(language, 'other') AS language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM files GROUP BY 1",
    "files_by_path": f"WITH {FILES} SELECT path, loc FROM files ORDER BY path LIMIT 500",
    "module_rollup": rf"WITH {FILES} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS module, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, min(path) AS first FROM files GROUP BY 1",
    "folder_tree_counts": f"WITH {FILES} SELECT array_to_string(p[:i], '/') AS folder, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM (SELECT *, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p, loc FROM files)) GROUP BY 1",
    "legend_topk": "SELECT source AS folder, count(*) AS files FROM documents GROUP BY 1 ORDER BY files DESC, folder LIMIT 8",
    "degree_in": f"WITH {EDGES} SELECT dst AS node, count(*) AS dependents FROM edges GROUP BY 1",
    "degree_out": f"WITH {EDGES} SELECT src AS node, count(*) AS dependencies FROM edges GROUP BY 1",
    "coupling_avg": f"WITH {EDGES}, n AS (SELECT count(*) AS nodes FROM nodes), e AS (SELECT count(*) AS edges FROM edges) SELECT nodes, edges, round(edges / greatest(nodes, 1), 2) AS average FROM n, e",
    "high_fanout": f"WITH {EDGES} SELECT src AS node, count(*) AS dependencies FROM edges GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 20",
    "ranked_dependents": f"WITH {EDGES} SELECT node, count(dst) AS dependents FROM nodes LEFT JOIN edges ON dst = node GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "graph_topn": f"WITH {EDGES}, top AS (SELECT node, count(dst) AS n FROM nodes LEFT JOIN edges ON dst = node GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 300) SELECT * FROM edges WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)",
    "dead_nodes": f"WITH {LINKS} SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM links) AND node % 10 <> 0",
    "entrypoint_flags": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages UNION ALL SELECT -p_partkey, (CASE p_partkey % 12 WHEN 0 THEN 'src/Index.ts' WHEN 1 THEN 'a/__init__.py' WHEN 2 THEN 'app/x/page.tsx' WHEN 3 THEN 'a/b.Spec.js' WHEN 4 THEN 'Tests/a.py' WHEN 5 THEN 'vite.config.ts' WHEN 6 THEN 'LICENSES/foo.py' WHEN 7 THEN 'domain.py' WHEN 8 THEN 'docs/x.MD' WHEN 9 THEN 'a/layout.py' WHEN 10 THEN 'e2e/x.ts' ELSE 'src/main.test' END) FROM part)
SELECT page_id, path, regexp_matches(path, '(?i)(^|/)(index|main|app|server|worker|cli|setup|conftest)\.[\w.]+$|\.(test|spec)\.[\w.]+$|(^|/)(tests?|spec|__tests__|fixtures?|examples?|docs?|scripts?|migrations?)/|(^|/)[^/]*\.config\.[\w.]+$|(^|/)(README|CHANGELOG|LICENSE)')
  OR regexp_matches(path, '(^|/)__init__\.py$|(^|/)(page|layout|route|middleware)\.[jt]sx?$') AS entry,
  NOT regexp_matches(path, '(?i)(^|/)(tests?|spec|__tests__|__mocks__|fixtures?|examples?|samples?|docs?|e2e)/|\.(test|spec)\.[\w.]+$|\.md$') AS production FROM p""",
    "history_churn": f"WITH {_COMMITS} SELECT path, count(*) AS commits, arg_min(ts, ordinal) AS last_commit_at FROM commits GROUP BY 1",
    "ranked_churn": "SELECT l_partkey AS path, count(*) AS commits FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "history_authors": f"WITH {_COMMITS} SELECT * FROM (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, author) AS INT) AS rank, author, count(*) AS commits FROM commits GROUP BY path, author) WHERE rank <= 3",
    "hotspots": f"WITH {EDGES}, c AS (SELECT l_partkey AS path, count(*) AS churn FROM lineitem GROUP BY 1), i AS (SELECT dst AS path, count(*) AS n FROM edges GROUP BY 1) SELECT * FROM (SELECT p_partkey AS path, p_size AS loc, coalesce(churn, 0) AS churn, coalesce(n, 0) AS dependents, round(coalesce(churn, 0) * log10(p_size + 10) * (1 + coalesce(n, 0) / 5), 2) AS risk FROM part LEFT JOIN c ON c.path = p_partkey LEFT JOIN i ON i.path = p_partkey) WHERE churn > 1 AND risk > 0 ORDER BY risk DESC, path LIMIT 20",
    "import_extract": "SELECT page_id, CAST(k - 1 AS INT) AS ordinal, a[k] AS specifier FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS a FROM pages), unnest(range(1, len(a) + 1)) AS u(k)",
    "path_normalize": rf"""WITH {FILES}, m AS (SELECT *, concat_ws('/', path, '..', '.', '', CASE WHEN doc_id % 2 = 0 THEN '../..' ELSE '..' END, language, CASE WHEN doc_id % 3 = 0 THEN '../../../..' ELSE '' END, doc_id) AS messy FROM files)
SELECT doc_id, list_reduce(list_filter(string_split(messy, '/'), lambda x: x NOT IN ('', '.')), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '(^|/)[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END, '') AS path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS extension, split_part(path, '/', 1) AS top FROM m""",
    "import_resolve": f"WITH {_IMPORTS} SELECT * FROM resolved",
    "external_counts": f"WITH {_IMPORTS} SELECT specifier, count(*) AS count FROM resolved WHERE outcome = 'external' GROUP BY 1",
    "unresolved_count": f"WITH {_IMPORTS} SELECT count(*) FILTER (outcome = 'unresolved') AS unresolved FROM resolved",
    "incremental_reuse": f"WITH {FILES}, {_PREVIOUS} SELECT path, hash FROM files f WHERE EXISTS (SELECT 1 FROM previous p WHERE p.path = f.path AND p.hash = f.hash)",
    "incremental_changed": f"WITH {FILES}, {_PREVIOUS} SELECT path, hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM previous p WHERE p.path = f.path AND p.hash = f.hash)",
    "merged_edges": f"WITH {EDGES} SELECT src, dst, 'import' AS kind, CAST(CASE WHEN src % 3 <> 0 THEN dst % 50 ELSE dst % 70 + 1 END AS INT) AS line, CASE WHEN src % 3 <> 0 THEN 0 ELSE 1 END AS old FROM edges",
    "merged_externals": "SELECT o_orderpriority AS specifier, count(*) AS count FROM orders GROUP BY 1",
    "upsert_latest": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "trigram_topk": "SELECT * FROM " + _search("part", "part", "p_partkey", "p_name", "blue ring bolt", 20),
    "evidence_union": "SELECT * FROM (" + " UNION ALL ".join("SELECT * FROM " + _search(*x) for x in (("part", "part", "p_partkey", "p_name", "Supplier 12", 20), ("supplier", "supplier", "s_suppkey", "s_name", "Supplier 12", 15), ("customer", "customer", "c_custkey", "c_name", "Supplier 12", 15))) + ") ORDER BY score DESC, kind, key LIMIT 20",
    "claims_grounded": f"WITH {FILES}, c AS (SELECT DISTINCT conv_id AS claim, turn * 4 AS line FROM conversations) SELECT claim, count(*) AS cited, count(*) FILTER (line >= 1 AND line <= greatest(loc, 1)) AS kept FROM c LEFT JOIN files ON doc_id = claim GROUP BY 1",
    "headline": r"SELECT doc_id, CASE WHEN f = '' THEN '(empty)' WHEN length(f) > 160 THEN substr(f, 1, 159) || '…' ELSE f END AS headline FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)",
    "number_lines": r"SELECT doc_id, md5(CASE WHEN length(x) > 24000 THEN substr(x, 1, 24000) || chr(10) || '… (cut, too long)' ELSE x END || CASE WHEN len(a) > 600 THEN chr(10) || '… (' || len(a) || ' lines, the first 600 are shown)' ELSE '' END) AS numbered_md5 FROM (SELECT *, array_to_string(list_transform(range(1, least(len(a), 600) + 1), lambda k: k || chr(9) || a[k]), chr(10)) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))",
    "qa_history": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) <= 50",
    "qa_recent": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place, turn, role FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)",
    "session_gaps": "WITH a AS (SELECT user_id AS key, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM a) SELECT key, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM b GROUP BY key, run",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "join_inner": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "latest_scalar": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)",
}
