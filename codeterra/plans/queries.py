"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeterra import store
from codeterra.functions import paths, texts
from codeterra.operators import graph, grounding, history, incremental, inventory, resolve, search
from codeterra.plans import tables as t
from codeterra.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: A report's length.
TOP = 20
#: Dependencies that make a fan-out high: the sample graph is sparse.
FAN_OUT = 3


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def inventory_files(s, d):
    return t.files(s, d).drop("doc_id")


@query
def inventory_totals(s, d):
    return inventory.totals(t.files(s, d).withColumn("parsed", F.col("doc_id") % 5 > 0))


@query
def language_totals(s, d):
    return inventory.language_totals(t.files(s, d))


@query
def files_by_path(s, d):
    return t.files(s, d).select("path", "loc").orderBy("path").limit(500)


@query
def module_rollup(s, d):
    return inventory.modules(t.files(s, d))


@query
def folder_tree_counts(s, d):
    return inventory.folder_counts(t.files(s, d))


@query
def legend_topk(s, d):
    return t.files(s, d).groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(8)


@query
def degree_in(s, d):
    return graph.dependents(t.edges(s, d))


@query
def degree_out(s, d):
    return graph.dependencies(t.edges(s, d))


@query
def coupling_avg(s, d):
    edges = t.edges(s, d)
    n = graph.nodes(edges).agg(F.count("*").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).join(F.broadcast(n)).select("nodes", "edges", F.round(F.col("edges") / F.greatest("nodes", F.lit(1)), 2).alias("average"))


@query
def high_fanout(s, d):
    return graph.dependencies(t.edges(s, d)).where(F.col("dependencies") >= FAN_OUT).orderBy(F.desc("dependencies"), "node").limit(TOP)


@query
def ranked_dependents(s, d):
    return graph.top_nodes(t.edges(s, d), TOP)


@query
def graph_topn(s, d):
    edges = t.edges(s, d)
    return graph.within(edges, graph.top_nodes(edges, 300))


@query
def dead_nodes(s, d):
    links = t.links(s, d)
    return graph.dead(graph.nodes(links), links, F.col("node") % 10 == 0)


@query
def entrypoint_flags(s, d):
    pages = t.table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    odd = F.array(*[F.lit(p) for p in ("src/Index.ts", "a/__init__.py", "app/x/page.tsx", "a/b.Spec.js", "Tests/a.py", "vite.config.ts", "LICENSES/foo.py", "domain.py", "docs/x.MD", "a/layout.py", "e2e/x.ts", "src/main.test")])
    made = t.table(s, d, "part").select((-F.col("p_partkey")).alias("page_id"), F.element_at(odd, (F.col("p_partkey") % 12 + 1).cast("int")).alias("path"))
    return pages.union(made).select("page_id", "path", paths.is_entry_point(F.col("path")).alias("entry"), paths.is_production(F.col("path")).alias("production"))


@query
def history_churn(s, d):
    return history.churn(t.commits(s, d))


@query
def ranked_churn(s, d):
    return history.churn(t.commits(s, d)).select("path", "commits").orderBy(F.desc("commits"), "path").limit(TOP)


@query
def history_authors(s, d):
    return history.top_authors(t.commits(s, d))


@query
def hotspots(s, d):
    churn = history.churn(t.commits(s, d)).select("path", F.col("commits").alias("churn"))
    loc = t.table(s, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("loc"))
    facts = loc.join(churn, "path", "left").join(graph.dependents(t.edges(s, d)).withColumnRenamed("node", "path"), "path", "left").fillna(0, ["churn", "dependents"])
    return history.hotspots(facts)


@query
def import_extract(s, d):
    pages = t.table(s, d, "pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ordinal", "specifier"))


@query
def path_normalize(s, d):
    docs = t.files(s, d)
    deep = F.when(F.col("doc_id") % 3 == 0, "../../../..").otherwise("")
    messy = F.concat_ws("/", "path", F.lit(".."), F.lit("."), F.lit(""), F.when(F.col("doc_id") % 2 == 0, "../..").otherwise(".."), "language", deep, F.col("doc_id").cast("string"))
    return docs.select("doc_id", paths.normalize(messy).alias("path"), paths.directory_of(F.col("path")).alias("folder"), paths.extension_of(F.col("path")).alias("extension"), paths.top_folder(F.col("path")).alias("top"))


def _imports(s, d):
    """Parts as Python and TypeScript files that import others by every kind of specifier."""
    part = t.table(s, d, "part").select(F.col("p_partkey").alias("k"))
    ext = F.when(F.col("k") % 2 == 0, ".py").otherwise(".ts")
    path = F.concat(F.lit("src/m"), (F.col("k") % 13).cast("string"), F.lit("/f"), F.col("k").cast("string"), ext)
    files = part.select("k", path.alias("path"), F.when(F.col("k") % 2 == 0, "python").otherwise("typescript").alias("language"))
    other = (F.col("k") * 7 + 2) % 1000
    name = F.concat(F.lit("f"), other.cast("string"))
    folder = F.concat(F.lit("m"), (other % 13).cast("string"))
    specifier = (
        F.when(F.col("k") % 10 == 0, F.concat(F.lit("m"), (other % 13).cast("string"), F.lit("."), name))
        .when(F.col("k") % 10 == 2, F.concat(F.lit(".."), folder, F.lit("."), name))
        .when(F.col("k") % 10 == 4, F.lit("numpy"))
        .when(F.col("k") % 10 == 1, F.concat(F.lit("../"), folder, F.lit("/"), name))
        .when(F.col("k") % 10 == 3, F.concat(F.lit("@/"), folder, F.lit("/"), name))
        .when(F.col("k") % 10 == 5, F.concat(F.lit("./"), name))
        .otherwise(F.concat(F.lit("pkg"), (F.col("k") % 5).cast("string")))
    )
    return files.select("path", "language", specifier.alias("specifier"), F.lit(1).alias("line"), F.lit("from").alias("kind")), files


@query
def import_resolve(s, d):
    imports, files = _imports(s, d)
    return resolve.resolve(imports, files).drop("line", "kind")


@query
def external_counts(s, d):
    return resolve.external_counts(resolve.resolve(*_imports(s, d)))


@query
def unresolved_count(s, d):
    return resolve.resolve(*_imports(s, d)).agg(F.count(F.when(F.col("outcome") == "unresolved", 1)).alias("unresolved"))


@query
def incremental_reuse(s, d):
    return incremental.reused(t.files(s, d), t.previous(s, d)).select("path", "hash")


@query
def incremental_changed(s, d):
    return incremental.changed(t.files(s, d), t.previous(s, d)).select("path", "hash")


@query
def merged_edges(s, d):
    """Every edge is known from before; two thirds of the files have been read again."""
    every = t.edges(s, d).withColumn("kind", F.lit("import"))
    fresh = every.where("src % 3 <> 0").withColumn("line", (F.col("dst") % 50).cast("int"))
    kept = every.withColumn("line", (F.col("dst") % 70 + 1).cast("int"))
    return incremental.merged_edges(fresh, kept)


@query
def merged_externals(s, d):
    items = t.table(s, d, "orders").select(F.col("o_orderpriority").alias("specifier"), F.col("o_orderkey").alias("k"))
    counts = lambda x: x.groupBy("specifier").agg(F.count("*").alias("count"))
    return incremental.merged_counts(counts(items.where("k % 2 = 0")), counts(items.where("k % 2 = 1")), "specifier")


@query
def upsert_latest(s, d):
    orders = t.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return incremental.latest(orders, "o_custkey", "o_orderdate", "o_orderkey")


@query
def trigram_topk(s, d):
    return search.trigram_search(t.table(s, d, "part").withColumn("key", F.col("p_partkey")), "p_name", "blue ring bolt", 20, "part")


@query
def evidence_union(s, d):
    parts = []
    for kind, name, key, text, n in (("part", "part", "p_partkey", "p_name", 20), ("supplier", "supplier", "s_suppkey", "s_name", 15), ("customer", "customer", "c_custkey", "c_name", 15)):
        parts.append(search.trigram_search(t.table(s, d, name).withColumn("key", F.col(key)), text, "Supplier 12", n, kind))
    return search.evidence(parts)


@query
def claims_grounded(s, d):
    claims = t.table(s, d, "conversations").select(F.col("conv_id").alias("claim"), F.col("conv_id").cast("string").alias("path"), (F.col("turn") * 4).alias("line"))
    return grounding.grounded(claims, t.files(s, d).select(F.col("doc_id").cast("string").alias("path"), "loc"))


@query
def headline(s, d):
    return t.table(s, d, "documents").select("doc_id", texts.headline(F.col("text"), F.lit("(empty)")).alias("headline"))


@query
def number_lines(s, d):
    return t.table(s, d, "documents").select("doc_id", F.md5(texts.number_lines(F.col("text"))).alias("numbered_md5"))


@query
def qa_history(s, d):
    return store.first_rows(t.table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", [F.col("turn"), F.col("role")], 50)


@query
def qa_recent(s, d):
    last = store.first_rows(t.table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", [F.desc("turn")], 3)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


@query
def session_gaps(s, d):
    return limits.sessions(t.requests(s, d), 6 * 3600).select("key", "started", "ended", "n")


@query
def json_props(s, d):
    props = F.from_json("props", "k bigint")
    return t.table(s, d, "events").groupBy(props["k"].alias("k")).agg(F.count("*").alias("n"))


@query
def join_inner(s, d):
    both = t.table(s, d, "orders").join(t.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def join_left(s, d):
    orders = t.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.table(s, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query
def join_semi(s, d):
    return t.table(s, d, "customer").join(t.table(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query
def join_anti(s, d):
    return t.table(s, d, "customer").join(t.table(s, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query
def latest_scalar(s, d):
    orders = t.table(s, d, "orders")
    last = orders.agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x")).select(F.col("x.o_orderkey").alias("o_orderkey"))
    return t.table(s, d, "lineitem").join(F.broadcast(last), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
