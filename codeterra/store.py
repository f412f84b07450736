"""Results kept as Parquet tables by analysis, and what writes do to them.

Tables of one analysis (files, edges, symbols, findings, file_externals) are written under a new version each time. The
analysis' own row in `analyses` is written last and names the version of each of its tables, so readers see all of the former
state or all of the new one, and a write that ends halfway is never seen. Former versions stay until prune(), for readers that
still have them. Job rows are logs, of which a reader takes the
last value of each column that is not null. Keyed rows (repos, summaries, messages, reading paths) are appended with a version,
and readers take the latest of each key; `compact` drops what is outdated.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeterra.session import drop_folder, shared_folder

RESULT_TABLES = ("files", "edges", "symbols", "findings", "file_externals")
SCHEMA_VERSION = 1
#: Job states that are final.
ENDED = ("done", "failed")
#: Files of the job log that a tail reads at a time.
STEPS = 1000

KEYS: dict[str, tuple[str, ...]] = {
    "repos": ("host", "owner", "name"),
    "summaries": ("comprehension_id", "scope", "key"),
    "reading_paths": ("analysis_id", "user_id"),
    "qa_messages": ("id",),
}


def latest(rows: DataFrame, key: tuple[str, ...] | list[str], version: str = "version") -> DataFrame:
    """The row of the highest version of each key."""
    rest = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(rest, version).alias("x")).select(*key, "x.*")


def merged_log(log: DataFrame, key: tuple[str, ...] | list[str], version: str = "version") -> DataFrame:
    """A log of partial updates as one row per key: each column's last value that is not null."""
    rest = [c for c in log.columns if c not in key and c != version]
    return log.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in rest])


def coverage(done: Column, total: Column) -> Column:
    """done / total, 0 for no total."""
    return F.when(total > 0, done / total).otherwise(0.0)


def live(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that have not expired."""
    return rows.where(F.col(expires) > now)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _scan(self, table: str) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(f"{self.root}/{table}")
            # a letter before the id, or Spark takes ids of digits for numbers
            return rows.withColumn("analysis_id", F.substring("analysis", 2, 1 << 30)).drop("analysis") if "analysis" in rows.columns else rows
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(self, table: str) -> DataFrame | None:
        """A table, as far as analyses name its rows; None before its first write."""
        rows = self._scan(table)
        if rows is None or table not in (*RESULT_TABLES, "analyses"):
            return rows
        if table == "analyses":
            return latest(rows, ("analysis_id",)).drop("version", "versions")
        heads = self._scan("analyses")
        if heads is None:
            return None
        named = latest(heads, ("analysis_id",)).select("analysis_id", F.col("versions")[table].alias("version"))
        return rows.join(named, ["analysis_id", "version"], "left_semi").drop("version")

    def of(self, table: str, analysis_id: str) -> DataFrame | None:
        """One analysis' rows, as they are now and stay for this reader: the partition of their version alone is read."""
        rows = self._scan(table)
        if rows is None or table == "analyses":
            return rows and self.read(table).where(F.col("analysis_id") == analysis_id)
        version = self._versions(analysis_id).get(table, "")
        return rows.where((F.col("analysis_id") == analysis_id) & (F.col("version") == version)).drop("version")

    def _versions(self, analysis_id: str) -> dict[str, str]:
        heads = self._scan("analyses")
        row = heads and heads.where(F.col("analysis_id") == analysis_id).orderBy(F.desc("version")).select("versions").first()
        return dict(row["versions"]) if row else {}

    def replace_analysis(self, analysis_id: str, tables: dict[str, DataFrame], header: DataFrame) -> None:
        """Puts the tables in place of the analysis' former ones, all at once: by its header row. Tables that are not given stay."""
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        versions = self._versions(analysis_id)
        for name in RESULT_TABLES:
            if name in tables:
                rows = tables[name].drop("analysis_id", "version").withColumns({"analysis": F.lit(f"a{analysis_id}"), "version": F.lit(version)})
                rows.write.mode("append").partitionBy("analysis", "version").parquet(f"{self.root}/{name}")
                versions[name] = version
        named = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair]) if versions else F.create_map().cast("map<string,string>")
        self.append("analyses", header.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "analysis_id": F.lit(analysis_id), "version": F.lit(version), "versions": named}))

    def prune(self, analysis_id: str) -> None:
        """Deletes what the analysis' header no longer names; for when no reader has it any more and no writer is at work."""
        versions = self._versions(analysis_id)
        for name in RESULT_TABLES:
            if self._scan(name) is not None:
                rows = self.spark.read.parquet(f"{self.root}/{name}").where((F.col("analysis") == f"a{analysis_id}") & (F.col("version") != versions.get(name, "")))
                self._delete([r["file_path"] for r in rows.select("_metadata.file_path").distinct().collect()])  # one analysis' files

    def _delete(self, files: list[str]) -> None:
        for name in files:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{table}")

    def upsert(self, table: str, rows: DataFrame, version: Column) -> None:
        """Adds rows under a version; of one key in rows one must be given once."""
        self.append(table, rows.withColumn("version", version))

    def current(self, table: str) -> DataFrame | None:
        rows = self.read(table)
        return None if rows is None else latest(rows, KEYS[table])

    def compact(self, table: str) -> None:
        """Adds the current rows of a keyed table, or of the job log, as new files and lets go of the files they were in.

        Rows appended meanwhile are in other files and stay. Until the old files are gone, readers find some rows twice, which their
        version makes one; ended halfway, that is what remains.
        """
        rows = self._scan(table)
        if rows is None:
            return
        before = rows.inputFiles()
        rows = self.spark.read.schema(rows.schema).parquet(*before)
        if table == "jobs":
            made = merged_log(rows, ("job",)).join(rows.groupBy("job").agg(F.max("version").alias("version")), "job").select(*rows.columns)
        else:
            made = latest(rows, KEYS[table]).select(*rows.columns)
        made.write.mode("append").parquet(f"{self.root}/{table}")
        self._delete(before)

    def upsert_repo(self, host: str, owner: str, name: str, version: int) -> str:
        """The repository's id: that of its first upsert, the same whoever asks."""
        row = self.spark.createDataFrame([(host, owner, name)], "host string, owner string, name string")
        row = row.withColumn("repo_id", F.substring(F.sha2(F.concat_ws("/", "host", "owner", "name"), 256), 1, 16))
        self.upsert("repos", row, F.lit(version))
        return row.first()["repo_id"]

    def progress(self, job: str, version: int, **values: object) -> None:
        """A step of a job: what is not given keeps its value."""
        known = {"status": "string", "stage": "string", "percent": "int", "message": "string", "files_done": "long", "files_total": "long", "input_tokens": "long", "output_tokens": "long", "commit_sha": "string", "error": "string"}
        schema = "job string, version long, " + ", ".join(f"{k} {t}" for k, t in known.items())
        self.append("jobs", self.spark.createDataFrame([(job, version, *[values.get(k) for k in known])], schema))

    def fail(self, job: str, version: int, reason: str) -> None:
        self.progress(job, version, status="failed", error=reason, message=reason)

    def finish(self, job: str, version: int, **totals: object) -> None:
        self.progress(job, version, status="done", stage="publish", percent=100, **totals)

    def jobs(self) -> DataFrame:
        """One row per job, with its coverage."""
        return merged_log(self.read("jobs"), ("job",)).withColumn("coverage", coverage(F.coalesce("files_done", F.lit(0)), F.coalesce("files_total", F.lit(0))))

    def follow(self, job: str, handle: Callable[[DataFrame], None], checkpoint: str) -> None:
        """The job's row as it stands, then each later step, until all that is there has been handed on."""
        now = self.read("jobs")
        handle(merged_log(now.where(F.col("job") == job), ("job",)))
        steps = self.spark.readStream.schema(now.schema).parquet(f"{self.root}/jobs").where(F.col("job") == job)
        run = steps.writeStream.foreachBatch(lambda rows, _: handle(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()

    def tail(self, job: str, handle: Callable[[dict[str, object]], None], seconds: float | None = None, trigger: str = "1 second") -> bool | None:
        """Hands on the job's state as it stands, then each later step when it is written, in order of version; ends by itself once the job has.

        True where the job ended, False where `seconds` passed before, None for a job that nobody knows. Steps hold what was
        given, null else. Whoever lost a tail calls it again and starts from the state of then. A log that is compacted meanwhile
        may give several steps as one, never one twice. The driver holds one trigger's steps of this job and the versions handed on.
        """
        now = self.read("jobs")
        mine = now and now.where(F.col("job") == job)
        state = mine and merged_log(mine, ("job",)).join(mine.groupBy("job").agg(F.max("version").alias("version")), "job").first()
        if not state:
            return None
        handle(state.asDict())
        if state["status"] in ENDED:
            return True
        handed, ended = {state["version"]}, threading.Event()

        def batch(rows: DataFrame, _: int) -> None:
            for step in sorted(rows.collect(), key=lambda r: r["version"]):  # one job's steps of one trigger
                if step["version"] not in handed and not ended.is_set():
                    handed.add(step["version"])
                    handle(step.asDict())
                    if step["status"] in ENDED:
                        ended.set()

        log = self.spark.readStream.schema(now.schema).option("maxFilesPerTrigger", STEPS).option("ignoreMissingFiles", "true").parquet(f"{self.root}/jobs")
        later = log.where((F.col("job") == job) & (F.col("version") > state["version"]))
        folder = shared_folder(self.spark)
        run = later.writeStream.foreachBatch(batch).option("checkpointLocation", folder).trigger(processingTime=trigger).start()
        until = None if seconds is None else time.monotonic() + seconds
        try:
            while not ended.is_set() and (until is None or time.monotonic() < until):
                if run.awaitTermination(0.2):
                    break
        finally:
            run.stop()
            drop_folder(self.spark, folder)
        return ended.is_set()


def cached(analyses: DataFrame, host: str, owner: str, name: str, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """The latest finished analysis of a repository under this schema, or no row."""
    same = (F.lower("host") == host.lower()) & (F.col("owner") == owner) & (F.col("name") == name) & (F.col("status") == "done") & (F.col("schema_version") == schema_version)
    return analyses.where(same).orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(1)


def snapshot(files: DataFrame, symbols: DataFrame, edges: DataFrame, findings: DataFrame, externals: DataFrame) -> DataFrame:
    """(path, hash, engine, symbols, edges, findings, externals): what an analysis knows of each file, nested, in order."""

    def held(rows: DataFrame, by: str, into: str, *fields: str) -> DataFrame:
        return rows.groupBy(F.col(by).alias("path")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(into))

    out = files.select("path", "hash", "engine")
    for more in (
        held(symbols, "path", "symbols", "line", "name", "kind"),
        held(edges, "src", "edges", "line", "dst", "kind", "confidence"),
        held(findings, "path", "findings", "line", "rule", "severity"),
        held(externals, "path", "externals", "specifier", "count"),
    ):
        out = out.join(more, "path", "left")
    return out


def first_rows(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most).drop("place")
