"""Queries on the structure of source files, with their SQL: languages, imports, symbols, the graph that imports make, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeterra.functions import paths, texts
from codeterra.operators import analysis, graph, health, history, incremental, inventory, parsing, reading, resolve, security, views
from codeterra.plans import tables as t
from codeterra.plans.oracles import EDGES, LINES, ORACLE_SQL, REACH
from codeterra.plans.queries import QUERIES
from codeterra.plans.sources import SOURCES_SQL, quoted, sources
from codeterra.sources import git

GO_MODULE = "ex.org/r"


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _rules(name: str, table: dict) -> str:
    rows = ", ".join(f"({quoted(language)}, {i}, {quoted(kind)}, {quoted(pattern)})" for language, rules in table.items() for i, (kind, pattern) in enumerate(rules))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(language, i, kind, p))"


# lines without comments; for Go the state of its import blocks by the marks before a line
_CODE = r"""code AS (
  SELECT *, CASE WHEN language IN ('python', 'ruby', 'bash') THEN regexp_replace(text, '#.*$', '') ELSE regexp_replace(text, '//.*$', '') END AS code FROM src_lines WHERE language <> 'markdown'),
state AS (
  SELECT *, language = 'go' AND coalesce(last_value(CASE WHEN regexp_matches(code, '^\s*import\s*\(') THEN true WHEN regexp_matches(code, '^\s*\)') THEN false END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM code),
prepared AS (
  SELECT *, language <> 'go' OR inside OR regexp_matches(code, '^\s*import\s') AS plain FROM state
  WHERE NOT (language = 'go' AND (regexp_matches(code, '^\s*import\s*\(') OR inside AND regexp_matches(code, '^\s*\)'))))"""
_IMPORTS = f"""{SOURCES_SQL}, {_CODE}, {_rules("import_rules", parsing.IMPORT_RULES)},
imports AS (
  SELECT path, language, line, arg_min(regexp_extract(code, p, 1), i) AS specifier, arg_min(kind, i) AS kind
  FROM prepared JOIN import_rules USING (language) WHERE plain AND regexp_extract(code, p, 1) <> '' GROUP BY ALL)"""


@query(f"WITH {_IMPORTS} SELECT * FROM imports")
def source_imports(s, d):
    return parsing.imports(parsing.lines_of(sources(s, d)))


@query(f"""WITH {SOURCES_SQL}, {_CODE}, {_rules("symbol_rules", parsing.SYMBOL_RULES)},
hits AS (SELECT path, language, line, plain, i, kind, regexp_extract(code, p, 1) AS name FROM prepared JOIN symbol_rules USING (language) WHERE regexp_extract(code, p, 1) <> '')
SELECT path, line, name, kind FROM hits WHERE NOT plain UNION ALL SELECT path, line, arg_min(name, i), arg_min(kind, i) FROM hits WHERE plain GROUP BY path, line""")
def source_symbols(s, d):
    return parsing.symbols(parsing.lines_of(sources(s, d)))


@query(rf"WITH {SOURCES_SQL}, {_CODE} SELECT path, line, inside, regexp_matches(code, '^\s*import\s*\(') OR inside AND regexp_matches(code, '^\s*\)') AS mark FROM state WHERE language = 'go'")
def block_state(s, d):
    lines = parsing.lines_of(sources(s, d).where("language = 'go'")).withColumn("code", parsing.without_comment(F.col("text"), F.col("language")))
    return parsing.in_block(lines).select("path", "line", "inside", "mark")


def _values(pairs) -> str:
    return "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) + ")"


@query(rf"""WITH {SOURCES_SQL}, ext AS (SELECT * FROM {_values(inventory.EXTENSIONS.items())} v(e, l)), named AS (SELECT * FROM {_values(inventory.NAMES.items())} v(n, l)),
p AS (SELECT path FROM src UNION ALL SELECT 'a/' || c_name || '/Dockerfile' FROM customer UNION ALL SELECT 'vendor/x/' || s_name || '.go' FROM supplier UNION ALL SELECT 'web/' || s_suppkey || '.min.js' FROM supplier)
SELECT path, coalesce(named.l, ext.l) AS language, coalesce(coalesce(named.l, ext.l) NOT IN {inventory.COUNTED_ONLY!r}, false) AS analyzable,
  NOT regexp_matches(path, '(^|/)(\.git|node_modules|vendor|dist|build|out|\.next|\.nuxt|\.turbo|\.cache|coverage|__pycache__|\.venv|venv|target|Pods|\.gradle|\.idea|\.vscode|playwright-report|test-results)/') AND NOT regexp_matches(path, '{inventory.SKIPPED_FILES}') AS listed
FROM p LEFT JOIN named ON named.n = regexp_extract(path, '[^/]*$') LEFT JOIN ext ON ext.e = lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]*)$', 1))""")
def language_detection(s, d):
    names = t.table(s, d, "supplier")
    path = sources(s, d).select("path").union(t.table(s, d, "customer").select(F.concat(F.lit("a/"), "c_name", F.lit("/Dockerfile"))))
    path = path.union(names.select(F.concat(F.lit("vendor/x/"), "s_name", F.lit(".go")))).union(names.select(F.concat(F.lit("web/"), F.col("s_suppkey").cast("string"), F.lit(".min.js"))))
    language = inventory.language_of(F.col("path"))
    return path.select("path", language.alias("language"), inventory.is_analyzable(language).alias("analyzable"), inventory.is_listed(F.col("path")).alias("listed"))


# resolution: the places a specifier may mean, tried one after the other, normalized by a fold over its segments
_NORMAL = "list_reduce(list_filter(string_split({0}, '/'), lambda x: x NOT IN ('', '.')), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '(^|/)[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END, '')"
_TRIED = ", ".join(f"({quoted(language)}, {quoted(s)}, {c}, {i})" for language, exts in resolve.TRIED.items() for i, (s, c) in enumerate([*((e, resolve.EXTENSION) for e in exts), *[x for e in exts for x in (("/index" + e, resolve.INDEX), ("/__init__" + e, resolve.PACKAGE), ("/mod" + e, resolve.MODULE))]], 1))
_RESOLVED = rf"""{_IMPORTS},
asked AS (SELECT *, row_number() OVER () AS id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM imports),
bases AS (
  SELECT id, 0 AS b, folder || '/' || specifier AS base, 0.0 AS less FROM asked WHERE regexp_matches(specifier, '^\.\.?/')
  UNION ALL SELECT id, 0, folder || '/' || repeat('../', length(regexp_extract(specifier, '^\.+')) - 1) || replace(regexp_replace(specifier, '^\.+', ''), '.', '/'), 0.0 FROM asked WHERE language = 'python' AND starts_with(specifier, '.') AND NOT regexp_matches(specifier, '^\.\.?/')
  UNION ALL SELECT id, b, root || replace(specifier, '.', '/'), less FROM asked, (VALUES (0, '', 0.0), (1, 'src/', 0.2)) v(b, root, less) WHERE language = 'python' AND NOT starts_with(specifier, '.')
  UNION ALL SELECT id, b, root || substr(specifier, 3), less FROM asked, (VALUES (0, '', 0.3), (1, 'src/', 0.3), (2, 'app/', 0.35)) v(b, root, less) WHERE language <> 'python' AND regexp_matches(specifier, '^[@~]/')),
tries AS (SELECT * FROM (VALUES {_TRIED}) v(language, suffix, confidence, i) UNION ALL SELECT DISTINCT language, '', 1.0, 0 FROM asked),
hits AS (
  SELECT asked.id, src.path AS target, confidence - less AS confidence FROM bases JOIN asked USING (id) JOIN tries USING (language) JOIN src ON src.path = {_NORMAL.format("base")} || suffix
  QUALIFY row_number() OVER (PARTITION BY asked.id ORDER BY b, i) = 1
  UNION ALL SELECT id, src.path, 0.9 FROM asked JOIN src ON regexp_extract(src.path, '^(.*)/[^/]*$', 1) = substr(specifier, 10) AND src.path LIKE '%.go' WHERE starts_with(specifier, 'ex.org/r/') AND asked.language <> 'python'
  UNION ALL SELECT id, min(src.path), 0.5 FROM asked JOIN src ON regexp_extract(src.path, '[^/]*$') = regexp_extract(specifier, '[^/]*$') WHERE kind = 'include' AND asked.language <> 'python' AND NOT regexp_matches(specifier, '^(\.\.?|[@~])/') GROUP BY id HAVING count(*) = 1),
resolved AS (
  SELECT asked.*, target, confidence, CASE WHEN target = path THEN 'self' WHEN target IS NOT NULL THEN 'resolved' WHEN regexp_matches(specifier, '^[./]') THEN 'unresolved' ELSE 'external' END AS outcome FROM asked LEFT JOIN hits USING (id)),
graph_edges AS (SELECT path AS src, target AS dst, kind, CAST(min(line) AS BIGINT) AS line, arg_min(round(confidence, 2), line) AS confidence FROM resolved WHERE outcome = 'resolved' GROUP BY 1, 2, 3)"""


def _graph(s, d):
    files = sources(s, d)
    return resolve.build_graph(parsing.imports(parsing.lines_of(files)), files.select("path"), GO_MODULE)


@query(f"WITH {_RESOLVED} SELECT src, dst, kind, line, CAST(confidence AS DOUBLE) AS confidence FROM graph_edges")
def graph_edges(s, d):
    return _graph(s, d).edges


@query(f"WITH {_RESOLVED} SELECT path, specifier, count(*) AS count FROM resolved WHERE outcome = 'external' GROUP BY 1, 2")
def external_by_file(s, d):
    return _graph(s, d).external_by_file


@query(f"WITH {_RESOLVED} SELECT specifier, count(*) AS count FROM resolved WHERE outcome = 'external' GROUP BY 1")
def graph_external(s, d):
    return _graph(s, d).external


@query(f"WITH {_RESOLVED} SELECT count(*) FILTER (outcome = 'unresolved') AS unresolved FROM resolved")
def graph_unresolved(s, d):
    return _graph(s, d).unresolved


@query(f"WITH {_RESOLVED} SELECT src, dst, confidence FROM graph_edges WHERE src IN (SELECT path FROM src WHERE k % 3 > 0) AND dst IN (SELECT path FROM src WHERE k % 3 > 0)")
def reused_edges(s, d):
    """Edges of the graph whose ends are still there when every third file is gone."""
    return incremental.live_edges(_graph(s, d).edges, sources(s, d).where("k % 3 > 0")).select("src", "dst", "confidence")


_SEVERE = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_RULE_ROWS = ", ".join(f"({quoted(r.name)}, {quoted(r.severity)}, {quoted(r.message)}, {str(r.production_only).lower()}, {quoted(',' + ','.join(r.languages) + ',') if r.languages else 'NULL'}, {quoted(r.pattern)})" for r in security.RULES)
_MASK = r"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '"[A-Za-z0-9_\-./+=]{{16,}}"', '"[redacted]"', 'g'), '''[A-Za-z0-9_\-./+=]{{16,}}''', '''[redacted]''', 'g'), '-----BEGIN[^-]*-----', '-----BEGIN [redacted]-----', 'g'), '^\s+|\s+$', '', 'g'), 1, 200)"""
FOUND = rf"""{LINES}, {SOURCES_SQL}, every AS (SELECT path, language, line, text FROM lines UNION ALL SELECT path, language, line, text FROM src_lines),
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) v(rule, severity, message, production, languages, p)),
hits AS (
  SELECT path, line, rule, severity, message, text FROM every JOIN rules ON length(text) <= 500 AND regexp_matches(text, p) AND (languages IS NULL OR contains(languages, ',' || language || ','))
  AND NOT (production AND regexp_matches(path, '{paths.NOT_PRODUCTION}'))),
found AS (SELECT path, min(line) AS line, rule, severity, message, arg_min(text, line) AS text FROM hits GROUP BY path, rule, severity, message)"""
SUMS = "sums AS (SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM found)"


def _lines(s, d):
    """The lines of documents and of source files."""
    return t.lines(s, d).select("path", "language", "line", "text").union(parsing.lines_of(sources(s, d)).select("path", "language", "line", "text"))


@query(f"WITH {FOUND} SELECT path, line, rule, severity, message, {_MASK.format('text')} AS snippet FROM found")
def security_findings(s, d):
    return security.findings(_lines(s, d))


@query(f"WITH {FOUND}, {SUMS} SELECT high, medium, low, 8 * high + 3 * medium + low AS penalty FROM sums")
def security_summary(s, d):
    return security.summary(security.findings(_lines(s, d)))


@query(f"WITH {FOUND} SELECT path, line, rule, severity, message, {_MASK.format('text')} AS snippet FROM found ORDER BY {_SEVERE}, path, rule, line LIMIT 200")
def findings_list(s, d):
    return security.by_severity(security.findings(_lines(s, d)))


@query(f"WITH {LINES}, {SOURCES_SQL}, every AS (SELECT path, line, text FROM lines UNION ALL SELECT path, line, text FROM src_lines) SELECT path, line, md5({_MASK.format('text')}) AS snippet_md5 FROM every")
def redact(s, d):
    return _lines(s, d).select("path", "line", F.md5(security.redact(F.col("text"))).alias("snippet_md5"))


_CYC = "cyc AS (SELECT r.root AS node, min(r.node) AS cycle FROM reach r JOIN reach b ON r.root = b.node AND r.node = b.root GROUP BY r.root HAVING count(*) > 1)"


@query(f"WITH RECURSIVE {REACH}, {_CYC} SELECT node, cycle FROM cyc")
def scc_cycles(s, d):
    return graph.cycles(t.links(s, d))


@query(f"WITH RECURSIVE {REACH}, {_CYC} SELECT cycle, count(*) AS size, string_agg(node, ',' ORDER BY node) AS nodes FROM cyc GROUP BY 1 ORDER BY size DESC, cycle LIMIT 50")
def cycle_list(s, d):
    return graph.cycle_list(graph.cycles(t.links(s, d))).withColumn("nodes", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","))


_BLAST = "blast AS (SELECT root AS node, count(*) AS blast FROM reach WHERE root <> node GROUP BY 1)"


@query(f"WITH RECURSIVE {REACH}, {_BLAST} SELECT * FROM blast")
def blast_radius(s, d):
    return graph.blast_radius(t.links(s, d))


@query(f"WITH RECURSIVE {REACH}, {_BLAST} SELECT * FROM blast ORDER BY blast DESC, node LIMIT 20")
def ranked_blast(s, d):
    return graph.blast_radius(t.links(s, d)).orderBy(F.desc("blast"), "node").limit(20)


# a level is one above the highest of the nodes used; nodes in cycles or above them have the level after the last
_LEVELS = f"""{_CYC}, stuck AS (SELECT DISTINCT x.node FROM (SELECT node FROM cyc UNION SELECT r.node FROM reach r JOIN cyc ON r.root = cyc.node) x),
g AS (SELECT * FROM links WHERE src NOT IN (SELECT node FROM stuck)),
l(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT node FROM stuck) UNION SELECT src, level + 1 FROM l JOIN g ON dst = node),
m AS (SELECT node, max(level) AS level FROM l GROUP BY 1), levels AS (SELECT * FROM m UNION ALL SELECT node, (SELECT coalesce(max(level), -1) + 1 FROM m) FROM stuck)"""


@query(f"WITH RECURSIVE {REACH}, {_LEVELS} SELECT node, CAST(level AS INT) AS level, CAST(row_number() OVER (PARTITION BY level ORDER BY node) AS INT) AS place FROM levels")
def topo_order(s, d):
    return graph.order_of(graph.reading_levels(t.links(s, d)))


def _reading_facts(s, d):
    links = graph.split(t.links(s, d))
    facts = graph.reading_levels(links).join(graph.dependents(links), "node", "left").join(graph.dependencies(links), "node", "left").join(graph.blast_radius(links), "node", "left")
    churn = history.churn(t.commits(s, d)).select(F.col("path").alias("node"), F.col("commits").alias("churn"))
    return facts.join(churn, "node", "left").fillna(0).withColumn("entry", F.col("node") % 10 == 0)


_FACTS = f"""{_BLAST}, ind AS (SELECT dst AS node, count(*) AS dependents FROM links GROUP BY 1), outd AS (SELECT src AS node, count(*) AS dependencies FROM links GROUP BY 1), churn AS (SELECT l_partkey AS node, count(*) AS churn FROM lineitem GROUP BY 1),
facts AS (SELECT node, level, coalesce(dependents, 0) AS dependents, coalesce(dependencies, 0) AS dependencies, coalesce(blast, 0) AS blast, coalesce(churn, 0) AS churn, node % 10 = 0 AS entry FROM levels LEFT JOIN ind USING (node) LEFT JOIN outd USING (node) LEFT JOIN blast USING (node) LEFT JOIN churn USING (node)),
scored AS (SELECT *, CAST(3 * dependents + blast + churn / 2 + CASE WHEN entry THEN 5 ELSE 0 END AS DOUBLE) AS importance FROM facts),
best AS (SELECT *, row_number() OVER (ORDER BY importance DESC, level, node) AS rank, count(*) OVER () AS n FROM scored),
steps AS (SELECT CAST(row_number() OVER (ORDER BY level, node) AS INT) AS step, * FROM best WHERE rank <= CASE WHEN n <= 7 THEN n ELSE least(15, greatest(7, floor(n / 12 + 0.5))) END)"""


@query(f"WITH RECURSIVE {REACH}, {_LEVELS}, {_FACTS} SELECT step, node, CAST(level AS INT) AS level, importance FROM steps")
def reading_steps(s, d):
    return reading.steps(_reading_facts(s, d))


@query(f"""WITH RECURSIVE {REACH}, {_LEVELS}, {_FACTS} SELECT step, node, CASE WHEN entry THEN 'This file looks like a place where the program begins; it uses ' || dependencies || ' other files' ELSE dependents || ' files depend on this one; those that follow are easier after it' END AS why, CAST(node AS VARCHAR) AS path, CAST(1 AS BIGINT) AS line FROM steps""")
def reading_path(s, d):
    facts = t.settled(_reading_facts(s, d))
    found = reading.reading_path(reading.steps(facts), facts)
    first = F.col("why")[0]
    return found.select("step", "node", first["text"].alias("why"), first["citations"][0]["path"].alias("path"), first["citations"][0]["line"].alias("line"))


@query(f"""WITH RECURSIVE {REACH}, {_CYC}, {FOUND}, {SUMS},
x AS (SELECT (SELECT greatest(count(*), 1) FROM nodes) AS parsed, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT dst FROM links) AND node % 10 <> 0) AS dead, (SELECT count(*) FROM cyc) AS loops, (SELECT count(*) FROM links) AS e),
p AS (SELECT CAST(floor(least(100 * dead / parsed, 25) + 0.5) AS BIGINT) AS dead_penalty, CAST(floor(least(150 * loops / parsed, 25) + 0.5) AS BIGINT) AS cycle_penalty, CAST(floor(least(3 * greatest(round(e / parsed, 2) - 4, 0), 20) + 0.5) AS BIGINT) AS coupling_penalty, CAST(least(8 * high + 3 * medium + low, 30) AS BIGINT) AS security_penalty FROM x, sums),
q AS (SELECT *, greatest(100 - dead_penalty - cycle_penalty - coupling_penalty - security_penalty, 0) AS score FROM p)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM q""")
def health_score(s, d):
    links = graph.split(t.links(s, d))  # each once and without loops, as they are
    one = graph.nodes(links).agg(F.count("*").alias("parsed"))
    dead = graph.dead(graph.nodes(links), links, F.col("node") % 10 == 0).agg(F.count("*").alias("dead"))
    loops = graph.cycles(links).agg(F.count("*").alias("in_cycles"))
    found = security.summary(security.findings(_lines(s, d)))
    facts = one.join(F.broadcast(dead)).join(F.broadcast(loops)).join(F.broadcast(links.agg(F.count("*").alias("edges")))).join(F.broadcast(found))  # one row each
    return health.health(facts.withColumn("average", F.round(F.col("edges") / F.greatest("parsed", F.lit(1)), 2)))


_PARTS = f"""ind AS (SELECT dst AS path, count(*) AS dependents FROM edges GROUP BY 1), outd AS (SELECT src AS path, count(*) AS dependencies FROM edges GROUP BY 1), churn AS (SELECT l_partkey AS path, count(*) AS churn FROM lineitem GROUP BY 1),
parts AS (SELECT p_partkey AS path, p_brand AS language, p_size AS loc, coalesce(dependents, 0) AS dependents, coalesce(dependencies, 0) AS dependencies, coalesce(churn, 0) AS churn FROM part LEFT JOIN ind ON path = p_partkey LEFT JOIN outd ON outd.path = p_partkey LEFT JOIN churn ON churn.path = p_partkey)"""


def _parts(s, d):
    """Parts as files with what the graph and the history say of them; blast is their number of dependents here."""
    part = t.table(s, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("language"), F.col("p_size").alias("loc"))
    edges = t.edges(s, d)
    blast = graph.dependents(edges).withColumnRenamed("dependents", "blast")
    return analysis.insights(part, edges, t.commits(s, d), blast)


@query(f"WITH {EDGES}, {_PARTS} SELECT path, language, loc, dependents, dependencies, dependents AS blast, (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM part) > 100 AS truncated FROM parts ORDER BY dependents DESC, loc DESC, path LIMIT 100")
def graph_nodes(s, d):
    return views.graph_nodes(_parts(s, d), t.edges(s, d), 100)


@query(f"""WITH {EDGES}, {_PARTS}, a AS (SELECT l_partkey AS path, l_suppkey AS author, count(*) AS n FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) <= 3),
b AS (SELECT path, string_agg(author || ':' || n, ',' ORDER BY n DESC, author) AS authors FROM a GROUP BY 1), c AS (SELECT l_partkey AS path, max(l_shipdate) AS last_commit_at FROM lineitem GROUP BY 1)
SELECT path, loc, dependents, churn, dependents AS blast, coalesce(authors, '') AS authors, last_commit_at FROM parts LEFT JOIN b USING (path) LEFT JOIN c USING (path)""")
def file_insights(s, d):
    authors = F.array_join(F.transform("authors", lambda a: F.concat_ws(":", a["name"].cast("string"), a["commits"].cast("string"))), ",")
    return _parts(s, d).select("path", "loc", "dependents", "churn", "blast", authors.alias("authors"), "last_commit_at")


@query(f"WITH {EDGES}, {_PARTS} SELECT path, loc, churn FROM parts WHERE churn > 0 ORDER BY churn DESC, path LIMIT 20")
def ranked_files(s, d):
    return views.ranked(_parts(s, d), "churn").select("path", "loc", "churn")


@query(f"WITH {EDGES}, {_PARTS} SELECT path, dependents, loc FROM parts ORDER BY dependents DESC, path")
def summary_files(s, d):
    return views.summary_files(_parts(s, d)).select("path", "dependents", "loc")


@query(f"WITH {EDGES}, {_PARTS} SELECT path, round(least(3 + sqrt(loc) / 4, 14), 6) AS size, greatest((SELECT max(dependents) FROM parts), 1) AS dependents FROM parts")
def node_sizes(s, d):
    files = _parts(s, d)
    return files.select("path", F.round(views.node_size(F.col("loc")), 6).alias("size")).join(F.broadcast(views.largest(files).select("dependents")))  # one row


@query(f"WITH {EDGES} SELECT src, dst FROM edges ORDER BY src, dst LIMIT 5000")
def edge_list(s, d):
    edges = t.edges(s, d).withColumns({"kind": F.lit("import"), "line": F.lit(1), "confidence": F.lit(1.0)})
    return views.edge_list(edges).select("src", "dst")


@query(f"WITH {EDGES}, c AS (SELECT node AS c FROM nodes LEFT JOIN edges ON dst = node GROUP BY 1 ORDER BY count(dst) DESC, 1 LIMIT 1), o AS (SELECT DISTINCT 'out' AS side, dst AS node FROM edges, c WHERE src = c ORDER BY node LIMIT 200), i AS (SELECT DISTINCT 'in' AS side, src AS node FROM edges, c WHERE dst = c ORDER BY node LIMIT 200) SELECT * FROM o UNION ALL SELECT * FROM i")
def neighbours(s, d):
    edges = t.edges(s, d)
    centre = graph.top_nodes(edges, 1).first()["node"]  # one row
    return views.neighbours(edges, centre)


@query(f"WITH {SOURCES_SQL}, {_CODE}, {_rules('symbol_rules', parsing.SYMBOL_RULES)} SELECT regexp_extract(code, p, 1) AS name, kind, line FROM prepared JOIN symbol_rules USING (language) WHERE k = 36 AND regexp_extract(code, p, 1) <> '' ORDER BY line, name LIMIT 500")
def symbol_list(s, d):
    files = sources(s, d)
    path = files.where("k = 36").first()["path"]  # one row
    return views.symbols_of(parsing.symbols(parsing.lines_of(files)), path)


@query(f"""WITH {SOURCES_SQL}, e AS (SELECT language, k % 4 > 0 AS same FROM src WHERE language <> 'markdown') SELECT 'pattern' AS engine, count(*) AS files, count(*) FILTER (same) AS reused FROM e""")
def file_engines(s, d):
    """Files by what reads them, and how many of them are reused when every fourth has changed."""
    files = sources(s, d).select("k", "path", "language", texts.content_hash(F.col("text")).alias("hash"))
    engine = files.withColumn("engine", parsing.engine_of(F.col("language"), inventory.is_analyzable(F.col("language")))).where("engine is not null")
    before = files.select("path", F.when(F.col("k") % 4 == 0, F.lit("")).otherwise(F.col("hash")).alias("hash"))
    same = incremental.reused(engine, before).select("path", F.lit(1).alias("same"))
    return engine.join(same, "path", "left").groupBy("engine").agg(F.count("*").alias("files"), F.count("same").alias("reused"))


_HEADS = "h AS (SELECT o_orderkey AS sha, 'c' || o_custkey AS author, o_orderdate AS ts, o_custkey % 7 AS repo, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) AS ordinal FROM orders)"


@query(f"WITH {_HEADS} SELECT CAST(h.repo AS VARCHAR) AS repo, CAST(sha AS VARCHAR) AS sha, author, 'p' || l_partkey AS path, ordinal FROM h JOIN lineitem ON l_orderkey = sha")
def git_log(s, d):
    """Orders as commits of seven repositories, written as git's log and read again."""
    mark, orders = git._MARK, t.table(s, d, "orders")
    repo = (F.col("o_custkey") % 7).cast("string")
    head = F.concat(F.lit(mark), F.col("o_orderkey").cast("string"), F.lit(mark + "c"), F.col("o_custkey").cast("string"), F.lit(mark), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    heads = orders.select(repo.alias("repo"), (F.col("o_orderkey") * 100).alias("seq"), head.alias("text"))
    items = t.table(s, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    files = items.select(repo.alias("repo"), (F.col("o_orderkey") * 100 + 2 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"))
    return git.parse_log(heads.union(heads.select("repo", F.col("seq") + 1, F.lit(""))).union(files)).drop("ts")


@query(None)
def order_cycles(s, d):
    """Cycles of the graph of parts that follow each other in orders, nearly all of which are one component."""
    return graph.cycles(t.edges(s, d))


@query(None)
def order_levels(s, d):
    """The same graph's edges from a part to one of a smaller key: levels without a cycle, in one component."""
    return graph.reading_levels(t.edges(s, d).where("src > dst"))


@query(None)
def order_blast(s, d):
    """How many parts lead to each, by edges to smaller keys."""
    return graph.blast_radius(t.edges(s, d).where("src > dst"))
