"""Reading a repository: addresses, a shallow clone, files as a partitioned scan, history from git's log."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeterra.functions.regexes import portable
from codeterra.operators.inventory import MAX_BYTES
from codeterra.session import checkpointed
from codeterra.sources.folder import FolderSource

MAX_FILES = 50_000
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20
_MARK = "\x01"
#: Numbers of lines of a log that one task reads in order.
RUN = 1 << 18

# Hosts that may be cloned from, and what a part of a name may hold.
HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
SEGMENT = "^[A-Za-z0-9._-]+$"
_SSH, _WEB = r"^git@([^:]+):(.+)$", r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?([^?#]*)"


def is_private(host: Column) -> Column:
    """This machine, an internal name, or any numeric address."""
    host = F.lower(host)
    return (host == "localhost") | host.endswith(".localhost") | host.endswith(".internal") | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z") | host.contains(":")


def repo_ref(address: Column, allow_local: bool = False) -> Column:
    """struct(ok, host, owner, name, clone_url, local, error) of `owner/name`, an https link, git@host:path, or, if allowed, a local path.

    Only HOSTS are let through; error says why an address is refused, the other fields are then null.
    """
    text = F.regexp_replace(F.coalesce(address, F.lit("")), portable(r"^\s+|\s+$"), "")
    local = text.startswith("file://") | text.startswith("/")
    path = F.regexp_replace(text, "^file://", "")
    last = F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1) if allow_local else F.lit(None)
    ssh, web = text.rlike(portable(_SSH)), text.rlike("(?i)^https?://")
    host = F.when(ssh, F.regexp_extract(text, portable(_SSH), 1)).when(web, F.regexp_extract(text, _WEB, 1)).otherwise("github.com")
    rest = F.when(ssh, F.regexp_extract(text, portable(_SSH), 2)).when(web, F.regexp_extract(text, _WEB, 2)).otherwise(text)
    plain = F.regexp_replace(F.lower(host), r"^www\.", "")
    parts = F.filter(F.split(F.regexp_replace(rest, r"(?i)\.git\z", ""), "/"), lambda x: x != "")
    owner, name = F.get(parts, 0), F.get(parts, 1)
    error = (
        F.when(text == "", "no address")
        .when(local, F.lit(None) if allow_local else F.lit("only hosted repositories"))
        .when(~ssh & F.lower(text).startswith("http://"), "only https")
        .when(~ssh & ~web & text.contains("://"), "only https")
        .when(host == "", "unreadable link")
        .when(is_private(host), "private host")
        .when(~plain.isin(*HOSTS), "unknown host")
        .when(name.isNull(), "owner and name are needed")
        .when(~(owner.rlike(portable(SEGMENT)) & name.rlike(portable(SEGMENT))), "bad characters in a name")
    )
    ok = error.isNull()
    pick = lambda here, there: F.when(ok & local, here).when(ok, there)
    url = F.concat(F.lit("https://"), plain, F.lit("/"), owner, F.lit("/"), name, F.lit(".git"))
    return F.struct(
        ok.alias("ok"),
        pick(F.lit("local"), plain).alias("host"),
        pick(F.lit("local"), owner).alias("owner"),
        pick(F.coalesce(last, F.lit("local")), name).alias("name"),
        pick(path, url).alias("clone_url"),
        (ok & local).alias("local"),
        error.alias("error"),
    )


def slug(ref: Column) -> Column:
    return F.concat_ws("/", ref["owner"], ref["name"])


def failure_reason(stderr: Column) -> Column:
    """Why git failed, by what it wrote."""
    text = F.lower(stderr)
    return (
        F.when(text.contains("not found"), "not found: misspelt or private")
        .when(text.contains("could not resolve host") | text.contains("network"), "the host can't be reached")
        .when(text.contains("authentication") | text.contains("permission denied"), "no access")
        .otherwise("the clone failed")
    )


@dataclass
class Clone:
    folder: str
    commit: str
    branch: str


class GitError(Exception):
    """Holds what git wrote."""


def _git(*args: str, folder: str | None = None, seconds: int = 60) -> str:
    own = {"GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "echo", "GIT_CONFIG_NOSYSTEM": "1", "GCM_INTERACTIVE": "never"}
    try:
        done = subprocess.run(["git", "-c", "safe.directory=*", *args], cwd=folder, env=os.environ | own, stdin=subprocess.DEVNULL, capture_output=True, text=True, errors="replace", timeout=seconds)
    except subprocess.TimeoutExpired as e:
        raise GitError(f"git took more than {seconds} s") from e
    if done.returncode:
        raise GitError(done.stderr)
    return done.stdout


def clone(url: str, parent: str, depth: int = 200, checkout: str | None = None, seconds: int = 180) -> Clone:
    """A shallow clone without links below parent, a folder that executors see. A commit that can't be fetched leaves the branch's tip.

    The caller removes the folder.
    """
    folder = tempfile.mkdtemp(prefix="clone-", dir=parent)
    _git("-c", "core.symlinks=false", "-c", "advice.detachedHead=false", "clone", "--depth", str(depth), "--single-branch", "--no-tags", "--quiet", url, folder, seconds=seconds)
    head = lambda *flags: _git("rev-parse", *flags, "HEAD", folder=folder, seconds=15).strip()
    if checkout and head() != checkout:
        try:
            _git("fetch", "--depth", "1", "--quiet", "origin", checkout, folder=folder, seconds=seconds)
            _git("-c", "advice.detachedHead=false", "checkout", "--quiet", "--detach", "FETCH_HEAD", folder=folder, seconds=30)
        except GitError:
            pass  # the caller sees from commit that it is not the one asked for
    return Clone(folder, head(), head("--abbrev-ref"))


def listed(spark: SparkSession, root: str, most: int = MAX_FILES) -> DataFrame:
    """(path, bytes) of the first `most` files below root, a folder's own files before those of its folders, each by name."""
    spark.dataSource.register(FolderSource)
    names = checkpointed(spark.read.format("repository_folder").load(root))
    if names.count() <= most:
        return names
    # a folder's mark comes after a file's, so arrays of marked names are in that order
    steps = F.split("path", "/")
    place = F.transform(steps, lambda x, k: F.concat(F.when(k == F.size(steps) - 1, "0").otherwise("1"), x))
    return names.orderBy(place).limit(most)


def tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """(path, bytes, content binary) of files below root, which executors must see; dotfiles and empty files included, links, generated folders, lock files and minified ones left out.

    Tasks list names and sizes, of which max_files at most are taken, and read the files, but none of more than max_bytes.
    """
    names = listed(spark, root, max_files)
    size = names.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("bytes") <= max_bytes, F.col("bytes"))), F.lit(0)).alias("bytes")).first()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                blobs = []
                for name, size in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if size > max_bytes:
                        blobs.append(None)
                        continue
                    with open(os.path.join(root, name), "rb") as f:
                        blobs.append(f.read())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(blobs, pa.binary())], names=["path", "bytes", "content"])

    return names.repartition(max(1, size["files"] // 512, size["bytes"] // TASK_BYTES)).mapInArrow(read, "path string, bytes long, content binary")


def go_module(files: DataFrame) -> str | None:
    """The module that a go.mod at the root names."""
    row = files.where("path = 'go.mod'").select(F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1).alias("m")).first()
    return row["m"] or None if row else None


def parse_log(lines: DataFrame) -> DataFrame:
    """lines(repo, seq, text) of git's log -> (repo, sha, author, ts, path, ordinal), the latest commit being ordinal 1.

    A head line is the mark, then commit, author and date with marks between; the paths below it are its own. A repository's
    lines are read in runs of RUN numbers, each by one task.
    """
    head = F.when(F.col("text").startswith(_MARK), F.split(F.substring("text", 2, 1 << 30), _MARK))
    rows = lines.withColumn("head", head).withColumn("is_head", F.col("head").isNotNull()).withColumn("run", F.floor(F.col("seq") / RUN))
    # what is before a run: a row for each, not one for each line
    runs = Window.partitionBy("repo").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("repo", "run").agg(F.count("head").alias("heads"), F.max_by("head", F.when(F.col("is_head"), F.col("seq"))).alias("last"))
    ahead = sums.select(F.col("repo").alias("of"), F.col("run").alias("at"), F.coalesce(F.sum("heads").over(runs), F.lit(0)).alias("ahead"), F.last("last", ignorenulls=True).over(runs).alias("before"))
    order = Window.partitionBy("repo", "run").orderBy("seq")
    rows = rows.withColumn("own", F.last("head", ignorenulls=True).over(order)).withColumn("count", F.count("head").over(order))
    rows = rows.join(ahead, F.col("repo").eqNullSafe(F.col("of")) & F.col("run").eqNullSafe(F.col("at")))
    rows = rows.withColumn("head", F.coalesce("own", "before")).withColumn("ordinal", F.col("count") + F.col("ahead"))
    rows = rows.where(~F.col("is_head") & (F.trim("text") != "") & F.col("head").isNotNull())
    return rows.select("repo", F.col("head")[0].alias("sha"), F.col("head")[1].alias("author"), F.to_timestamp(F.col("head")[2]).alias("ts"), F.trim("text").alias("path"), "ordinal")


def history(spark: SparkSession, root: str, most: int = 300) -> DataFrame:
    """(sha, author, ts, path, ordinal) of the last commits that are no merges, ts being the committer's date; no rows where git fails."""
    try:
        out = _git("log", "--no-merges", f"--max-count={most}", "--name-only", f"--format={_MARK}%H{_MARK}%an{_MARK}%cI", folder=root)
    except (GitError, OSError):
        out = ""
    lines = spark.createDataFrame([(root, k, x) for k, x in enumerate(out.split("\n"))], "repo string, seq long, text string")
    return parse_log(lines).drop("repo")
