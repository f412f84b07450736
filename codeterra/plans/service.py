"""Queries on what is kept and served: addresses, jobs, summaries and claims, notes, reports, reading lists, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeterra import store
from codeterra.functions import paths, texts
from codeterra.operators import comprehension, grounding, inventory, notes, parsing, reading, report, security, views
from codeterra.plans import tables as t
from codeterra.plans.oracles import EDGES, FILES
from codeterra.plans.sources import SOURCES_SQL, sources
from codeterra.plans.structure import FOUND, _lines, query
from codeterra.session import checkpointed, drop_folder, shared_folder
from codeterra.sources import git
from codeterra.streaming import limits

_ADDRESSES = """a AS (SELECT page_id AS id, url AS address FROM pages UNION ALL
  SELECT -s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN ' owner' || s_suppkey || '/name' || s_suppkey || '.git ' WHEN 1 THEN 'https://www.GitHub.com/o/n' || s_suppkey || '.git?x=1' WHEN 2 THEN 'git@gitlab.com:o/n' || s_suppkey || '.git'
    WHEN 3 THEN 'http://github.com/o/n' WHEN 4 THEN 'https://10.0.0.1/o/n' WHEN 5 THEN 'https://a.localhost/o/n' WHEN 6 THEN 'https://github.com/o' WHEN 7 THEN 'https://u@bitbucket.org:443/o/n/tree/main' WHEN 8 THEN 'file:///srv/x' ELSE 'o/n$' END FROM supplier)"""


def _addresses(s, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [text(" owner", n, "/name", n, ".git "), text("https://www.GitHub.com/o/n", n, ".git?x=1"), text("git@gitlab.com:o/n", n, ".git")]
    forms += [F.lit(x) for x in ("http://github.com/o/n", "https://10.0.0.1/o/n", "https://a.localhost/o/n", "https://github.com/o", "https://u@bitbucket.org:443/o/n/tree/main", "file:///srv/x", "o/n$")]
    made = t.table(s, d, "supplier").select((-k).alias("id"), F.element_at(F.array(*forms), (k % 10 + 1).cast("int")).alias("address"))
    return t.table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("address")).union(made)


@query(rf"""WITH {_ADDRESSES}, b AS (SELECT id, trim(address) AS x FROM a), c AS (
  SELECT *, regexp_matches(x, '^git@([^:]+):(.+)$') AS ssh, regexp_matches(x, '(?i)^https?://') AS web, '(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?([^?#]*)' AS p FROM b),
e AS (SELECT *, lower(CASE WHEN ssh THEN regexp_extract(x, '^git@([^:]+):(.+)$', 1) WHEN web THEN regexp_extract(x, p, 1) ELSE 'github.com' END) AS h, CASE WHEN ssh THEN regexp_extract(x, '^git@([^:]+):(.+)$', 2) WHEN web THEN regexp_extract(x, p, 2) ELSE x END AS rest FROM c),
f AS (SELECT *, regexp_replace(h, '^www\.', '') AS host0, list_filter(string_split(regexp_replace(rest, '(?i)\.git$', ''), '/'), lambda y: y <> '') AS parts FROM e),
g AS (SELECT *, CASE WHEN x = '' THEN 'no address' WHEN x LIKE 'file://%' OR x LIKE '/%' THEN 'only hosted repositories' WHEN NOT ssh AND x ILIKE 'http://%' THEN 'only https' WHEN NOT ssh AND NOT web AND x LIKE '%://%' THEN 'only https' WHEN h = '' THEN 'unreadable link'
  WHEN h = 'localhost' OR h LIKE '%.localhost' OR h LIKE '%.internal' OR regexp_matches(h, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') OR h LIKE '%:%' THEN 'private host' WHEN host0 NOT IN ('github.com', 'gitlab.com', 'bitbucket.org') THEN 'unknown host'
  WHEN len(parts) < 2 THEN 'owner and name are needed' WHEN NOT (regexp_matches(parts[1], '^[A-Za-z0-9._-]+$') AND regexp_matches(parts[2], '^[A-Za-z0-9._-]+$')) THEN 'bad characters in a name' END AS error FROM f)
SELECT id, error IS NULL AS ok, CASE WHEN error IS NULL THEN host0 END AS host, CASE WHEN error IS NULL THEN parts[1] END AS owner, CASE WHEN error IS NULL THEN parts[2] END AS name, CASE WHEN error IS NULL THEN 'https://' || host0 || '/' || parts[1] || '/' || parts[2] || '.git' END AS clone_url, CASE WHEN error IS NULL THEN parts[1] || '/' || parts[2] ELSE '' END AS slug, error FROM g""")
def repo_ref_parse(s, d):
    rows = _addresses(s, d).select("id", git.repo_ref(F.col("address")).alias("r"))
    return rows.select("id", "r.ok", "r.host", "r.owner", "r.name", "r.clone_url", git.slug(F.col("r")).alias("slug"), "r.error")


_ERRORS = ("fatal: repository 'x' not found", "Could not resolve host: h", "Permission denied (publickey)", "Authentication failed", "network is unreachable", "broken pipe")


@query("SELECT k, CASE WHEN e ILIKE '%not found%' THEN 'not found: misspelt or private' WHEN e ILIKE '%could not resolve host%' OR e ILIKE '%network%' THEN 'the host can''t be reached' WHEN e ILIKE '%authentication%' OR e ILIKE '%permission denied%' THEN 'no access' ELSE 'the clone failed' END AS reason FROM (SELECT s_suppkey AS k, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{e.replace(chr(39), chr(39) * 2)}'" for i, e in enumerate(_ERRORS)) + " END AS e FROM supplier)")
def git_failures(s, d):
    said = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return t.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), git.failure_reason(said).alias("reason"))


@query(f"WITH {FILES} SELECT path, loc FROM files WHERE hash <> '' AND loc > 0")
def readable_files(s, d):
    return t.files(s, d).where(inventory.is_readable(F.col("hash"), F.col("loc"))).select("path", "loc")


@query(f"WITH {FILES} SELECT path, loc FROM files WHERE lower(path) LIKE '%/d1%'")
def keyword_filter(s, d):
    return t.files(s, d).where(paths.contains_keyword(F.col("path"), " /D1 ")).select("path", "loc")


@query(f"WITH {FILES}, {EDGES}, i AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), m AS (SELECT path, loc, coalesce(n, 0) AS dependents FROM files LEFT JOIN i ON dst = doc_id WHERE loc > 0 AND bytes > 0 AND doc_id % 9 > 0) SELECT * FROM m ORDER BY dependents DESC, path LIMIT 400")
def model_files(s, d):
    files = t.files(s, d).join(_dependents(s, d).withColumnRenamed("node", "doc_id"), "doc_id", "left").fillna(0, ["dependents"])
    files = files.withColumn("skip_reason", F.when(F.col("doc_id") % 9 == 0, "binary"))
    return reading.model_files(files).select("path", "loc", "dependents")


def _dependents(s, d):
    return t.edges(s, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))


@query(rf"WITH {SOURCES_SQL} SELECT path, 1 AS line FROM src WHERE regexp_matches(path, '(?i)(^|/)(index|main)\.[\w.]+$|(^|/)tests?/|/__init__\.py$') ORDER BY path LIMIT 12")
def entry_point_list(s, d):
    return views.entry_points(sources(s, d), paths.is_entry_point(F.col("path")))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey % 20 > 0 THEN (o_orderkey % 20) / (o_custkey % 20) ELSE 0 END AS DOUBLE) AS coverage FROM orders")
def coverage_ratio(s, d):
    orders = t.table(s, d, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), store.coverage(F.col("o_orderkey") % 20, F.col("o_custkey") % 20).alias("coverage"))


@query("SELECT c_custkey AS id FROM customer WHERE lower(c_mktsegment) = 'building'")
def email_equality(s, d):
    return t.table(s, d, "customer").where(texts.same_word(F.col("c_mktsegment"), F.lit("Building"))).select(F.col("c_custkey").alias("id"))


@query("SELECT o_orderkey AS analysisId, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS createdAt FROM orders")
def api_rows(s, d):
    orders = t.table(s, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return views.api_shape(orders)


# the latest run of a customer's conversations; a turn is a summary of one key
_SUMMARIES = """sm AS (SELECT conv_id % 50 AS user_id, conv_id AS comprehension_id, CASE turn % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'module' ELSE 'repo' END AS scope, CAST(turn AS VARCHAR) AS key, role AS headline, text FROM conversations),
lasts AS (SELECT user_id, scope, max(comprehension_id) AS comprehension_id FROM sm GROUP BY 1, 2)"""


def _summaries(s, d):
    turns = t.table(s, d, "conversations")
    scope = F.when(F.col("turn") % 3 == 0, "file").when(F.col("turn") % 3 == 1, "module").otherwise("repo")
    point = F.array(F.struct(F.col("text").alias("text"), F.array(F.struct(F.col("turn").cast("string").alias("path"), (F.col("turn") + 1).cast("long").alias("line"))).alias("citations"))).cast(grounding.CLAIMS)
    return turns.select(F.lit("a").alias("analysis_id"), (F.col("conv_id") % 50).alias("user_id"), F.col("conv_id").alias("comprehension_id"), scope.alias("scope"), F.col("turn").cast("string").alias("key"), F.col("role").alias("headline"), point.alias("points"))


def _runs(s, d):
    return t.table(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("conv_id").alias("created_at")).distinct()


@query(f"WITH {_SUMMARIES} SELECT key, headline FROM sm JOIN lasts USING (user_id, scope, comprehension_id) WHERE user_id = 7 AND scope = 'module' ORDER BY key")
def module_summaries(s, d):
    return views.latest_summary(_summaries(s, d), _runs(s, d), "a", 7, "module").select("key", "headline")


@query(f"WITH {_SUMMARIES}, one AS (SELECT * FROM sm WHERE user_id = 3 AND scope = 'file' AND key = '0') SELECT key, headline FROM one WHERE comprehension_id = (SELECT max(comprehension_id) FROM one)")
def file_summary(s, d):
    return views.latest_summary(_summaries(s, d), _runs(s, d), "a", 3, "file", "0").select("key", "headline")


@query(f"WITH {_SUMMARIES} SELECT headline, text AS purpose, CAST(0 AS INT) AS stack FROM sm JOIN lasts USING (user_id, scope, comprehension_id) WHERE user_id = 5 AND scope = 'repo'")
def repo_digest(s, d):
    rows = views.latest_summary(_summaries(s, d), _runs(s, d), "a", 5, "repo")
    detail = F.lit(None).cast(f"struct<purpose:{grounding.CLAIMS},stack:{grounding.CLAIMS},entrypoints:{grounding.CLAIMS},how_to_run:{grounding.CLAIMS},notes:{grounding.CLAIMS}>")
    found = views.digest(rows.withColumn("detail", detail).withColumn("model", F.lit(None).cast("string")))
    return found.select("headline", F.col("purpose")[0]["text"].alias("purpose"), F.size("stack").alias("stack"))


@query("SELECT conv_id AS comprehension_id, turn + 1 AS line, text FROM conversations WHERE turn % 3 < 2")
def nested_claims(s, d):
    return grounding.points_of(_summaries(s, d).where("scope <> 'repo'").select("comprehension_id", "points")).select("comprehension_id", "line", "text")


@query(f"WITH {SOURCES_SQL}, {_SUMMARIES} SELECT (SELECT count(*) FROM src) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM sm WHERE scope = 'file') AS file_summaries")
def table_counts(s, d):
    return views.counts(sources(s, d), t.table(s, d, "part"), _summaries(s, d))


@query("SELECT conv_id, string_agg(DISTINCT role || ':' || n, ',' ORDER BY role || ':' || n) AS places FROM (SELECT conv_id, role, lpad(CAST(turn // 2 AS VARCHAR), 4, '0') AS n FROM conversations) GROUP BY 1")
def citations_dedup(s, d):
    places = t.table(s, d, "conversations").select("conv_id", F.col("role").alias("path"), F.floor(F.col("turn") / 2).cast("long").alias("line"))
    shown = F.transform("citations", lambda c: F.concat(c["path"], F.lit(":"), F.lpad(c["line"].cast("string"), 4, "0")))
    return grounding.distinct_citations(places, "conv_id").select("conv_id", F.array_join(shown, ",").alias("places"))


def _replies(s, d):
    """Turns as a model's replies: prose, a fence or nothing around one object of claims, one in five broken."""
    turns = t.table(s, d, "conversations").select("conv_id", "turn", "role")
    k, line = F.col("turn").cast("string"), (F.col("turn") * 4).cast("string")
    body = F.concat(F.lit('{"claims":[{"text":" '), "role", F.lit(' } {\\" ","lines":['), line, F.lit(","), line, F.lit(',"x",1.7]},{"text":"","lines":[1]},{"text":"far","refs":[{"path":"'), F.col("conv_id").cast("string"), F.lit('","line":'), k, F.lit('},{"path":"none","line":1},{"path":7}]},5,{"text":"bare"}]}'))
    kind = F.col("turn") % 5
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure: "), body, F.lit(" Done }"))).when(kind == 3, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.substring(body, 1, 40))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("path"), text.alias("reply"))


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 4 THEN '' ELSE role || ' } {"@' || conv_id || ':' || (turn * 4) || CASE WHEN turn * 4 <> 1 THEN '+' || conv_id || ':1' ELSE '' END || ';far@' || conv_id || ':' || turn || '+none:1;bare@' END AS claims FROM conversations""")
def read_claims(s, d):
    found = _replies(s, d).select("id", grounding.read_claims(F.col("reply"), "claims", F.col("path")).alias("c"))
    return found.select("id", _claims_text(F.col("c")).alias("claims"))


def _claims_text(claims):
    place = lambda p: F.concat_ws(":", p["path"], p["line"].cast("string"))
    return F.array_join(F.transform(claims, lambda c: F.concat(c["text"], F.lit("@"), F.array_join(F.transform(c["citations"], place), "+"))), ";")


@query(rf"""WITH {FILES}, c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, greatest(loc, 1) AS n FROM conversations JOIN files ON doc_id = conv_id WHERE turn % 5 < 4),
p AS (SELECT id, role || ' }} {{"@' || CASE WHEN turn * 4 BETWEEN 1 AND n THEN conv_id || ':' || (turn * 4) || CASE WHEN turn * 4 <> 1 THEN '+' || conv_id || ':1' ELSE '' END ELSE conv_id || ':1' END AS a, CASE WHEN turn BETWEEN 1 AND n THEN ';far@' || conv_id || ':' || turn ELSE '' END AS b FROM c)
SELECT conv_id * 1000 + turn AS id, coalesce(a || b, '') AS claims FROM conversations LEFT JOIN p ON p.id = conv_id * 1000 + turn""")
def grounded_claims(s, d):
    found = _replies(s, d).select("id", grounding.read_claims(F.col("reply"), "claims", F.col("path")).alias("claims"))
    files = t.files(s, d).select(F.col("doc_id").cast("string").alias("path"), "loc")
    return grounding.keep_grounded(found, files, "id").select("id", _claims_text(F.col("claims")).alias("claims"))


@query("SELECT conv_id AS id, CASE WHEN count(*) FILTER (role <> 'user') > 0 THEN string_agg(text, ' ' ORDER BY turn, text) FILTER (role <> 'user') ELSE 'no grounded answer' END AS answer FROM conversations GROUP BY 1")
def short_answers(s, d):
    """What others than the user say in each conversation, as one answer."""
    one = F.when(F.col("role") != "user", F.struct("turn", "text"))
    rows = t.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("claims"))
    return rows.select(F.col("conv_id").alias("id"), reading.short_answer(F.col("claims")).alias("answer"))


@query("SELECT c_custkey AS id, 'codeterra-' || replace(c_mktsegment, ' ', '-') || '-' || replace(c_name, '#', '-') || '-' || CASE WHEN c_custkey % 3 = 0 THEN 'latest' ELSE substr(md5(c_name), 1, 7) END AS slug FROM customer")
def report_slug(s, d):
    sha = F.when(F.col("c_custkey") % 3 > 0, F.md5("c_name"))
    return t.table(s, d, "customer").select(F.col("c_custkey").alias("id"), texts.file_slug("codeterra", F.col("c_mktsegment"), F.col("c_name"), sha).alias("slug"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def unquoted(s, d):
    quote = F.element_at(F.array(F.lit("'"), F.lit('"'), F.lit("`"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.table(s, d, "customer").select(F.col("c_custkey").alias("id"), texts.unquote(F.concat(quote, "c_name", quote)).alias("name"))


_NOTE_ROWS = "SELECT s_suppkey AS k, s_name, CASE s_suppkey % 7 WHEN 0 THEN 'Odd' ELSE 'Fixed' END AS second FROM supplier"


def _notes(s, d):
    """Suppliers as release notes; one in seven has an unknown heading, one in eleven no head."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    n = k.cast("string")
    head = F.concat(F.lit("---\nversion: 1."), n, F.lit(".0\ndate: 2024-01-01\ntitle: Note: "), name, F.lit("\n---\n"))
    body = F.concat(F.lit("intro\n## Added\n\n- one "), n, F.lit("\n  goes on\n* two\nnot a bullet\n## "), F.when(k % 7 == 0, "Odd").otherwise("Fixed"), F.lit("\n  stray\n- three\n"))
    return t.table(s, d, "supplier").select(n.alias("source"), F.concat(F.when(k % 11 == 0, "").otherwise(head), body).alias("text"))


@query(f"""SELECT CAST(k AS VARCHAR) AS source, CASE WHEN k % 11 = 0 THEN '' ELSE '1.' || k || '.0' END AS version, CASE WHEN k % 11 = 0 THEN '' ELSE 'Note: ' || s_name END AS title, CAST(3 AS BIGINT) AS changes, 'Added=one ' || k || ' goes on|two;' || second || '=three' AS sections, CASE WHEN k % 11 = 0 THEN 'no head' WHEN k % 7 = 0 THEN 'unknown heading Odd' END AS error FROM ({_NOTE_ROWS})""")
def release_notes(s, d):
    shown = F.array_join(F.transform("sections", lambda x: F.concat(x["heading"], F.lit("="), F.array_join(x["items"], "|"))), ";")
    return notes.parse(_notes(s, d)).select("source", "version", "title", notes.changes(F.col("sections")).alias("changes"), shown.alias("sections"), "error")


@query(f"""SELECT '# Changelog' || chr(10) || chr(10) || string_agg('## v1.' || k || '.0 — Note: ' || s_name || chr(10) || chr(10) || 'Date 2024-01-01' || chr(10) || chr(10) || '### Added' || chr(10) || chr(10) || '- one ' || k || ' goes on' || chr(10) || '- two' || chr(10) || chr(10) || '### Fixed' || chr(10) || chr(10) || '- three' || chr(10), chr(10) ORDER BY k DESC) AS text FROM ({_NOTE_ROWS}) WHERE k % 11 > 0 AND k % 7 > 0""")
def changelog(s, d):
    return notes.changelog(notes.parse(_notes(s, d)))


@query("SELECT a || '.' || b || '.' || c AS version, CAST(row_number() OVER (PARTITION BY a ORDER BY b DESC, c DESC) AS INT) AS place FROM (SELECT DISTINCT p_partkey % 3 AS a, p_size % 12 AS b, p_partkey % 15 AS c FROM part)")
def semver_sort(s, d):
    part = t.table(s, d, "part").select((F.col("p_partkey") % 3).alias("a"), (F.col("p_size") % 12).alias("b"), (F.col("p_partkey") % 15).alias("c")).distinct()
    version = part.select(F.concat_ws(".", F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string")).alias("version"))
    return version.withColumn("place", F.row_number().over(Window.partitionBy(F.substring_index("version", ".", 1)).orderBy(notes.version_key(F.col("version")).desc())))


@query(f"""WITH {FILES}, {FOUND},
l AS (SELECT coalesce(language, 'other') AS language, count(*) AS n, CAST(sum(loc) AS BIGINT) AS loc FROM files GROUP BY 1 ORDER BY loc DESC, n DESC, language LIMIT 10),
e AS (SELECT o_orderpriority AS s, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, s LIMIT 20),
f AS (SELECT * FROM found ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, rule, line LIMIT 50)
SELECT '## Languages' || chr(10) || chr(10) || '| Language | Files | Lines |' || chr(10) || '| --- | --- | --- |' || chr(10) || (SELECT string_agg('| ' || language || ' | ' || n || ' | ' || loc || ' |', chr(10) ORDER BY loc DESC, n DESC, language) FROM l) || chr(10) AS languages,
  '## Most used packages' || chr(10) || chr(10) || (SELECT string_agg('- ' || s || ' — ' || n || ' times', chr(10) ORDER BY n DESC, s) FROM e) || chr(10) AS externals,
  '## Security findings' || chr(10) || chr(10) || '_Found by patterns; this is no audit._' || chr(10) || chr(10) || (SELECT string_agg('- **[' || severity || ']** `' || path || ':' || line || '` — ' || message, chr(10) ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, rule, line) FROM f) || chr(10) AS findings""")
def report_sections(s, d):
    languages = report.languages(inventory.language_totals(t.files(s, d)))
    used = t.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("specifier")).agg(F.count("*").alias("count"))
    found = report.findings(security.findings(_lines(s, d)))
    return languages.join(F.broadcast(report.externals(used))).join(F.broadcast(found))  # one row each


@query("""SELECT '{"files":' || (SELECT to_json(list({'path': n, 'language': p_brand, 'loc': p_size} ORDER BY n)) FROM (SELECT *, p_name || '#' || p_partkey AS n FROM part ORDER BY n LIMIT 5000)) || ',"edges":' || (SELECT to_json(list({'src': l_orderkey, 'dst': l_partkey, 'kind': l_returnflag} ORDER BY l_orderkey, l_partkey, l_returnflag)) FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_partkey, l_returnflag LIMIT 5000)) || ',"findings":' || (SELECT to_json(list({'path': s_name, 'line': s_nationkey, 'rule': 'r', 'severity': 'low'} ORDER BY s_name)) FROM (SELECT * FROM supplier ORDER BY s_name LIMIT 500)) || '}' AS doc""")
def export_json(s, d):
    files = t.table(s, d, "part").select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("language"), F.col("p_size").alias("loc"))
    edges = t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    found = t.table(s, d, "supplier").select(F.col("s_name").alias("path"), F.col("s_nationkey").alias("line"), F.lit("r").alias("rule"), F.lit("low").alias("severity"))
    return report.export(files, edges, found)


@query("""SELECT o_custkey AS job, CAST(arg_max(o_orderstatus, o_orderkey) AS VARCHAR) AS status, coalesce(max(o_orderkey) FILTER (o_orderkey % 3 = 0), -1) AS files_done, arg_max(o_clerk, o_orderkey) FILTER (o_orderkey % 5 = 0) AS message FROM (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority AS o_clerk FROM orders) GROUP BY 1""")
def job_state(s, d):
    """Orders as partial updates of their customer's job."""
    k = F.col("o_orderkey")
    log = t.table(s, d, "orders").select(F.col("o_custkey").alias("job"), k.alias("version"), F.col("o_orderstatus").alias("status"), F.when(k % 3 == 0, k).alias("files_done"), F.when(k % 5 == 0, F.col("o_orderpriority")).alias("message"))
    return store.merged_log(log, ("job",)).select("job", "status", F.coalesce("files_done", F.lit(-1)).alias("files_done"), "message")


@query("SELECT o_custkey AS name, max(o_orderkey) AS analysis_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7 AND o_orderkey % 2 = 1 GROUP BY 1")
def permalink(s, d):
    orders = t.table(s, d, "orders")
    rows = orders.select(F.lit("github.com").alias("host"), F.lit("o").alias("owner"), F.col("o_custkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"), (F.col("o_orderkey") % 2).alias("schema_version"), F.col("o_orderkey").alias("created_at"), F.col("o_orderkey").alias("analysis_id"))
    return store.cached(rows, "GitHub.com", "o", "7").select(F.col("name").cast("long").alias("name"), "analysis_id")


@query(f"""WITH {SOURCES_SQL}, {EDGES}, e AS (SELECT src AS path, count(*) AS n, min(dst) AS first FROM edges GROUP BY 1), i AS (SELECT l_partkey AS path, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, coalesce(e.n, 0) AS edges, coalesce(e.first, -1) AS first_edge, coalesce(i.n, 0) AS findings, CAST(0 AS BIGINT) AS externals FROM src LEFT JOIN e ON e.path = k LEFT JOIN i ON i.path = k""")
def snapshots(s, d):
    """Nested snapshots of parts, with their edges and, as findings, their items."""
    files = sources(s, d).select(F.col("k").alias("path"), F.lit("h").alias("hash"), F.lit("pattern").alias("engine"))
    edges = t.edges(s, d).withColumns({"line": F.lit(1), "kind": F.lit("import"), "confidence": F.lit(1.0)})
    items = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("severity"))
    none = files.select("path").limit(0)
    snap = store.snapshot(files, none.withColumns({"line": F.lit(1), "name": F.lit(""), "kind": F.lit("")}), edges, items, none.withColumns({"specifier": F.lit(""), "count": F.lit(1)}))
    many = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("long")
    return snap.select(F.col("path").alias("k"), many("edges").alias("edges"), F.coalesce(F.get("edges", 0)["dst"], F.lit(-1)).alias("first_edge"), many("findings").alias("findings"), many("externals").alias("externals"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


def _scored(kind: str, rows: str, by: str, question: str, n: int) -> str:
    a, b = _TRI.format(by), _TRI.format(f"'{question}'")
    score = f"round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6)"
    return f"SELECT * FROM (SELECT '{kind}' AS kind, path, line, text, {score} AS score FROM ({rows})) WHERE score > 0.1 ORDER BY score DESC, path, line, text LIMIT {n}"


_EVIDENCE = f"""WITH {_SUMMARIES}, a AS ({_scored("symbol", "SELECT p_brand AS path, CAST(p_partkey AS BIGINT) AS line, 'function ' || p_name AS text, p_name AS by_ FROM part", "by_", "blue supplier ring", 20)}), b AS ({_scored("file", "SELECT s_name AS path, CAST(1 AS BIGINT) AS line, s_name AS text FROM supplier", "text", "blue supplier ring", 15)}),
c AS ({_scored("point", "SELECT key AS path, CAST(key AS BIGINT) + 1 AS line, text FROM sm WHERE user_id = 4 AND scope <> 'repo'", "text", "blue supplier ring", 15)})
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY score DESC, kind, path, line LIMIT 20"""


def _sought(s, d):
    symbols = t.table(s, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), F.lit("function").alias("kind"), F.col("p_name").alias("name"))
    files = t.table(s, d, "supplier").select(F.col("s_name").alias("path"))
    return files, symbols, _summaries(s, d)


@query(_EVIDENCE)
def owned_evidence(s, d):
    return views.evidence(*_sought(s, d), 4, " blue supplier ring ")


@query(_EVIDENCE)
def indexed_evidence(s, d):
    """The same from an index that is built of the tables first, and deleted once the 20 rows are there."""
    root = shared_folder(s)
    views.index_evidence(*_sought(s, d), root)
    found = checkpointed(views.indexed_evidence(s, root, 4, " blue supplier ring "))
    drop_folder(s, root)
    return found


@query(f"""WITH {FILES}, m AS (SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'Not read: binary' ELSE coalesce(language, 'unknown') || ' file of ' || loc || ' lines' || CASE WHEN doc_id % 4 = 0 THEN ', 1 declared' ELSE '' END END AS headline,
  CASE WHEN doc_id % 9 = 0 THEN bytes || ' bytes, named by 2 files' WHEN doc_id % 4 = 0 THEN 'function f' || doc_id ELSE loc || ' lines, used by 2 files' END AS point FROM files) SELECT * FROM m""")
def plain_summaries(s, d):
    return _described(s, d).select("path", "headline", F.col("points")[0]["text"].alias("point"))


def _described(s, d):
    files = t.files(s, d).withColumn("skip_reason", F.when(F.col("doc_id") % 9 == 0, "binary")).withColumn("dependents", F.lit(2))
    symbols = files.where("doc_id % 4 = 0").select("path", F.lit(3).alias("line"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.lit("function").alias("kind"))
    return reading.describe(files, symbols)


@query(f"""WITH {FILES}, m AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS module, path, CASE WHEN doc_id % 9 = 0 THEN 'Not read: binary' ELSE coalesce(language, 'unknown') || ' file of ' || loc || ' lines' || CASE WHEN doc_id % 4 = 0 THEN ', 1 declared' ELSE '' END END AS headline, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY path) AS r FROM files),
g AS (SELECT module, count(*) AS files, string_agg(path || ' — ' || headline, '|' ORDER BY path) FILTER (r <= 3) AS points FROM m GROUP BY 1) SELECT * FROM g ORDER BY files DESC, module LIMIT 30""")
def module_fallback(s, d):
    found = reading.describe_modules(_described(s, d), paths.module_of(F.col("path")))
    return reading.model_modules(found).select("module", "files", F.array_join(F.transform("points", lambda p: p["text"]), "|").alias("points"))


@query(f"WITH {FILES} SELECT CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'module' ELSE 'repo' END AS scope, count(*) AS n FROM (SELECT 0 AS k FROM files UNION ALL SELECT DISTINCT ON (m) 1 FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS m FROM files) UNION ALL SELECT 2) GROUP BY 1")
def summary_scopes(s, d):
    files = _described(s, d)
    repo = s.range(1).select(F.lit("all").alias("headline"), F.array().cast(grounding.CLAIMS).alias("points"))
    return reading.scopes(files, reading.describe_modules(files, paths.module_of(F.col("path"))), repo).groupBy("scope").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, 'Evidence:' || chr(10) || string_agg('- ' || role || ':' || turn || ' t' || turn, chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Asked before:' || chr(10) || '- q -> a' || chr(10) || chr(10) || 'Question: why ' || conv_id || chr(10) || 'Answer' AS prompt FROM conversations GROUP BY 1""")
def question_prompts(s, d):
    shown = F.struct(F.col("turn").alias("line"), F.col("role").alias("path"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("text"))
    rows = t.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(shown)).alias("evidence"))
    past = F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer")))
    prompt = reading.question_prompt(F.concat(F.lit("why "), F.col("conv_id").cast("string")), F.col("evidence"), past)
    return rows.select("conv_id", F.concat(F.substring_index(prompt, "\nAnswer", 1), F.lit("Answer")).alias("prompt"))


@query(f"""WITH {SOURCES_SQL} SELECT path, 'File: ' || path || chr(10) || 'Language: ' || language || chr(10) || chr(10) || 'Declared in this file:' || chr(10) || '- line 1: function f' || k || chr(10) || chr(10) || 'Files that depend on it: none' || chr(10) || 'Files that it uses: a, b' || chr(10) || chr(10) || 'Content (the number before the tab is the line):' || chr(10)
  || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || chr(9) || x), chr(10)) || chr(10) AS prompt FROM src""")
def file_prompts(s, d):
    symbols = F.array(F.struct(F.concat(F.lit("f"), F.col("k").cast("string")).alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line")))
    prompt = reading.file_prompt(F.col("path"), F.col("language"), texts.number_lines(F.col("text")), symbols, F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b")))
    return sources(s, d).select("path", F.substring_index(prompt, "\nAnswer with", 1).alias("prompt"))


@query("SELECT user_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def status_latest(s, d):
    events = t.table(s, d, "events").select("user_id", "event_id", "event_type", "ts")
    return limits.latest_status(events, "user_id", "ts", "event_id").select("user_id", F.col("event_type").alias("status"), "event_id")


@query("SELECT user_id, max(ts) AS used FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 12 HOUR > (SELECT max(ts) FROM events)")
def sliding_expiry(s, d):
    events = t.table(s, d, "events").select("user_id", "ts")
    return limits.still_alive(events, "user_id", "12 hours", events.agg(F.max("ts")))


@query("SELECT * FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE done % 5 = 0 OR done = total")
def progress_throttle(s, d):
    return limits.throttled(t.table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("""WITH RECURSIVE n AS (SELECT user_id AS key, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(key, id, ts, i, log, allowed, retry_after) AS (
  SELECT key, id, ts, i, [epoch_us(ts)], true, CAST(0 AS BIGINT) FROM n WHERE i = 1
  UNION ALL SELECT key, id, ts, i, CASE WHEN len(live) < 3 THEN list_append(live, now) ELSE live END, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE CAST(ceil((86400000000 - (now - live[1])) / 1000000) AS BIGINT) END
  FROM (SELECT n.*, epoch_us(n.ts) AS now, list_filter(r.log, lambda x: x > epoch_us(n.ts) - 86400000000) AS live FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1))
SELECT key, id, ts, allowed, retry_after FROM r""")
def rate_limit_decisions(s, d):
    return limits.rate_limit(t.requests(s, d), 3, 86_400)


def _echo(prompt: str) -> str:
    """A stand-in for a model: it repeats a prompt's first line and cites line 1, a line too far, and a file of no such name."""
    first = prompt.split("\n", 1)[0]
    if first.endswith("7.py"):
        raise ValueError("no answer")
    path = first.removeprefix("File: ")
    return "Here: " + json.dumps({"headline": f"  on   {first} ", "points": [{"text": "kept", "lines": [1, 10**6]}, {"text": "lost", "refs": [{"path": "none", "line": 1}]}], "claims": [{"text": prompt.split("\n")[1][2:], "refs": [{"path": path, "line": 1}, {"path": "src/m1/f1.py", "line": 2}]}]})


def _comprehension(s, d):
    files = sources(s, d).select("path", "language", F.octet_length("text").alias("bytes"), texts.line_count(F.col("text")).alias("loc"), F.lit(0).alias("dependents"), F.lit(None).cast("string").alias("skip_reason"))
    lines = parsing.lines_of(sources(s, d))
    edges = s.createDataFrame([], "src string, dst string")
    return comprehension.comprehend(files, sources(s, d).select("path", "text"), parsing.symbols(lines), edges, "o/n", _echo)


@query(f"""WITH {SOURCES_SQL} SELECT path, CASE WHEN path LIKE '%7.py' THEN 'analyzer' ELSE 'model' END AS source, CASE WHEN path LIKE '%7.py' THEN NULL ELSE 'on File: ' || path END AS headline FROM (SELECT * FROM src WHERE language <> '' ORDER BY path LIMIT 400)""")
def comprehension_files(s, d):
    """The files that the model was asked of; one with a failed call is told from facts."""
    files = _comprehension(s, d).files
    asked = reading.model_files(sources(s, d).select("path", F.lit(1).alias("loc"), F.lit(1).alias("bytes"), F.lit(0).alias("dependents"), F.lit(None).cast("string").alias("skip_reason"))).select("path")
    return files.join(asked, "path").select("path", "source", F.when(F.col("source") == "model", F.col("headline")).alias("headline"))


@query(f"""WITH {SOURCES_SQL}, m AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS module, count(*) AS files FROM src GROUP BY 1) SELECT module, files, CASE WHEN r <= 30 THEN 'on Folder: ' || module ELSE 'This folder holds ' || files || ' files' END AS headline, CASE WHEN r <= 30 THEN 'model' ELSE 'analyzer' END AS source FROM (SELECT *, row_number() OVER (ORDER BY files DESC, module) AS r FROM m)""")
def comprehension_modules(s, d):
    return _comprehension(s, d).modules.select("module", "files", "headline", "source")


@query("SELECT conv_id || '-' || turn AS id, min(role) || ':' || turn || ' t' || turn AS first FROM conversations GROUP BY conv_id, turn")
def question_answers(s, d):
    """A question on each turn of each conversation; the model repeats the first piece of evidence."""
    shown = F.struct(F.col("turn").alias("line"), F.col("role").alias("path"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("text"))
    rows = t.table(s, d, "conversations").groupBy(F.concat_ws("-", "conv_id", "turn").alias("id")).agg(F.array_sort(F.collect_list(shown)).alias("evidence"))
    rows = rows.withColumn("question", F.lit("why")).withColumn("history", F.array().cast("array<struct<question:string,answer:string>>"))
    files = s.createDataFrame([("src/m1/f1.py", 9)], "path string, loc int")
    found = comprehension.answer(rows, files, _echo)
    return found.select("id", F.col("claims")[0]["text"].alias("first"))


@query("SELECT s_suppkey AS id, 'v1.' || s_suppkey || ' · ' || CASE WHEN s_suppkey % 2 = 0 THEN '2024-05-06 · ' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN 'dev' ELSE 'abcdef0' END AS label, '1.' || s_suppkey AS version FROM supplier")
def build_labels(s, d):
    k = F.col("s_suppkey")
    version = F.concat(F.lit("1."), k.cast("string"))
    label = notes.build_label(version, F.when(k % 2 == 0, "2024-05-06T07:08:09Z"), F.when(k % 3 == 0, " ").otherwise("abcdef0123"))
    return t.table(s, d, "supplier").select(k.alias("id"), label.alias("label"), notes.plain_version(F.concat(F.lit("v"), version)).alias("version"))
