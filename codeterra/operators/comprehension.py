"""Explanations by a model that the caller brings: files, then folders, then the repository, each grounded or told from facts.

The model is a function from prompt to reply, called by the tasks that hold the prompts. What it writes is only kept as far as
its citations name lines that exist; where nothing is kept, or a call fails, the description from facts stands.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.functions import paths, texts
from codeterra.operators import grounding, reading
from codeterra.session import checkpointed

Ask = Callable[[str], str]
#: Bytes of a file that is read for a model.
LARGEST = 400 * 1024
WARNINGS = 5


class FatalError(Exception):
    """A call that no other call would survive, such as a refused key: it ends the job."""


class BusyError(Exception):
    """A call that may succeed later: the service is busy, out of order or out of reach. retry_after: the seconds it asks to wait, if it does."""

    def __init__(self, reason: str, retry_after: float | None = None):
        super().__init__(reason)
        self.retry_after = retry_after


# Calls at once, tries after the first, seconds before the second try (doubled each time), the longest wait that a service may ask for.
AT_ONCE, RETRIES, FIRST_WAIT, LONGEST_WAIT = 4, 3, 1.0, 30.0


def error_of(status: int, reason: str, retry_after: float | None = None) -> Exception:
    """The error for an HTTP status: 429 and 5xx are tried again, a refused key (401, 403) ends the job, others fail the call."""
    if status == 429 or status >= 500:
        return BusyError(reason, retry_after)
    return FatalError(reason) if status in (401, 403) else RuntimeError(reason)


def tried(ask: Ask, prompt: str, retries: int = RETRIES, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> str:
    """ask(prompt), again after a wait when it is busy."""
    for attempt in range(retries + 1):
        try:
            return ask(prompt)
        except BusyError as busy:
            if attempt == retries:
                raise
            asked = busy.retry_after
            sleep(min(asked, LONGEST_WAIT) if asked and asked > 0 else first_wait * 2**attempt)
    raise AssertionError("retries is negative")


def replies(prompts: DataFrame, ask: Ask, at_once: int = AT_ONCE, retries: int = RETRIES, first_wait: float = FIRST_WAIT, kept: str | None = None, wave: int = 64) -> DataFrame:
    """prompts(id, prompt) -> (id, reply, error): each distinct prompt is asked once, at most at_once of them at a time; a failed call leaves its reason. Null prompts are not asked.

    With kept, a folder for this model, replies are stored there by the prompt's hash in waves of `wave` prompts, and prompts
    that it has are not asked: a job that is run again asks only what is missing, a lost task only its wave. Failed calls are not kept.
    """
    spark = prompts.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for hash_, prompt in zip(pdf["hash"], pdf["prompt"]):
                said = why = None
                try:
                    said = tried(ask, prompt, retries, first_wait)
                except FatalError:
                    raise
                except Exception as e:  # noqa: BLE001  (whatever a model's client raises)
                    why = str(e)
                yield pd.DataFrame({"hash": [hash_], "reply": [said], "error": [why]}).astype(object)

    def asked(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.repartition(at_once).mapInPandas(run, "hash string, reply string, error string"))

    hashed = checkpointed(prompts.select("id", "prompt", F.sha2("prompt", 256).alias("hash")))  # made once
    todo = checkpointed(hashed.where("prompt is not null").select("hash", "prompt").dropDuplicates(["hash"]))
    if kept is None:
        said = asked(todo)
    else:
        known = _kept(spark, kept)
        left = todo if known is None else checkpointed(todo.join(known, "hash", "left_anti"))
        waves = -(-left.count() // wave)
        said = None
        for k in range(waves):
            part = asked(left.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == k))
            part.where("reply is not null").select("hash", "reply").write.mode("append").parquet(kept)
            failed = part.where("reply is null")
            said = failed if said is None else said.union(failed)
        known = _kept(spark, kept)
        if known is not None:
            known = known.join(todo, "hash", "left_semi").select("hash", "reply", F.lit(None).cast("string").alias("error"))
            said = known if said is None else said.union(known)
    if said is None:
        return hashed.select("id", F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error"))
    return checkpointed(hashed.join(said, "hash", "left").select("id", "reply", "error"))


def _kept(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema("hash string, reply string").parquet(folder).dropDuplicates(["hash"])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _told(answers: DataFrame, plain: DataFrame, key: str, facts: DataFrame, default_path: Column | None, most: int = 4) -> DataFrame:
    """plain(key, headline, points) with what answers(id, reply) say instead, and source, model or analyzer."""
    read = answers.withColumn("claims", grounding.read_claims(F.col("reply"), "points", default_path, most))
    kept = grounding.keep_grounded(read.select("id", "claims"), facts, "id", most=most)
    line = F.get_json_object(grounding.read_object(F.col("reply")), "$.headline")
    said = answers.where("reply is not null").select("id", line.alias("line"), grounding.read_object(F.col("reply")).alias("object")).where("object is not null").join(kept, "id")
    rows = plain.join(said.withColumnRenamed("id", key), key, "left")
    return rows.select(
        *[c for c in plain.columns if c not in ("headline", "points")],
        texts.headline(F.coalesce("line", "headline"), F.col("headline")).alias("headline"),
        F.when(F.size("claims") > 0, F.col("claims")).otherwise(F.col("points")).alias("points"),
        F.when(F.col("object").isNotNull(), "model").otherwise("analyzer").alias("source"),
    )


@dataclass
class Comprehension:
    files: DataFrame  # path, headline, points, source
    modules: DataFrame  # module, files, headline, points, source
    repo: DataFrame  # one row: headline, purpose, stack, entrypoints, how_to_run, notes, source
    warnings: DataFrame  # id, error


def comprehend(files: DataFrame, contents: DataFrame, symbols: DataFrame, edges: DataFrame, name: str, ask: Ask, most_files: int = 400, most_modules: int = 30) -> Comprehension:
    """files(path, language, bytes, loc, dependents, skip_reason), contents(path, text), symbols(path, line, name, kind), edges(src, dst) -> Comprehension.

    A model sees the files that most depend on, then the largest folders, then the whole; `name` heads the last prompt.
    """
    files, symbols = checkpointed(files), checkpointed(symbols)  # read for each kind of claim
    plain = checkpointed(reading.describe(files, symbols))
    chosen = checkpointed(reading.model_files(files.where(F.col("bytes") <= LARGEST), most_files).select("path", "language"))
    of_chosen = lambda rows: rows.join(F.broadcast(chosen.select("path")), "path", "left_semi")  # noqa: E731  (`most_files` rows)
    shown = chosen.join(of_chosen(contents), "path")
    side = lambda at, other, into: of_chosen(edges.select(F.col(at).alias("path"), other)).groupBy("path").agg(F.array_sort(F.collect_set(other)).alias(into))
    declared = of_chosen(symbols).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))), lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["line"].alias("line"))).alias("symbols"))
    for more in (declared, side("dst", "src", "used_by"), side("src", "dst", "uses")):
        shown = shown.join(more, "path", "left")
    none, nobody = F.array().cast("array<struct<name:string,kind:string,line:bigint>>"), F.array().cast("array<string>")
    symbols_ = F.coalesce(F.col("symbols").cast("array<struct<name:string,kind:string,line:bigint>>"), none)
    prompt = reading.file_prompt(F.col("path"), F.col("language"), texts.number_lines(F.col("text")), symbols_, F.coalesce("used_by", nobody), F.coalesce("uses", nobody))
    file_replies = replies(shown.select(F.col("path").alias("id"), prompt.alias("prompt")), ask)
    told = checkpointed(_told(file_replies, plain, "path", files, F.col("id")))

    module = paths.module_of(F.col("path"))
    folders = checkpointed(reading.describe_modules(told, module))
    anchor = F.coalesce(F.get(F.get(F.col("points"), 0)["citations"], 0)["line"], F.lit(1).cast("long"))
    members = told.groupBy(module.alias("module")).agg(F.array_sort(F.collect_list(F.struct("path", "headline", anchor.alias("line")))).alias("members"))
    asked = reading.model_modules(folders, most_modules).select("module").join(members, "module")
    module_replies = replies(asked.select(F.col("module").alias("id"), reading.module_prompt(F.col("module"), F.col("members")).alias("prompt")), ask)
    told_modules = checkpointed(_told(module_replies, folders, "module", files, None))

    top = told_modules.orderBy(F.desc("files"), "module").limit(40)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), "module", "headline"))), lambda m: F.concat(F.lit("- "), m["module"], F.lit(": "), m["headline"]))
    totals = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    whole = top.agg(F.array_join(listed, "\n").alias("listed")).join(F.broadcast(totals))  # one row
    size = F.concat(F.col("n").cast("string"), F.lit(" files, "), F.col("loc").cast("string"), F.lit(" lines"))
    repo_replies = replies(whole.select(F.lit(name).alias("id"), F.concat(F.lit(f"Repository: {name}\n"), size, F.lit("\n\nFolders:\n"), "listed", F.lit("\n\nAnswer with JSON of this form:\n{\"headline\":\"one sentence\",\"purpose\":[],\"stack\":[],\"entrypoints\":[],\"howToRun\":[],\"notes\":[]}")).alias("prompt")), ask)
    repo = whole.select(F.lit(name).alias("id"), F.concat(F.lit(f"{name} — "), F.col("n").cast("string"), F.lit(" files")).alias("plain")).join(repo_replies, "id")
    for key, column in (("purpose", "purpose"), ("stack", "stack"), ("entrypoints", "entrypoints"), ("howToRun", "how_to_run"), ("notes", "notes")):
        read = repo_replies.select("id", grounding.read_claims(F.col("reply"), key, None, 4).alias(column))
        repo = repo.join(grounding.keep_grounded(read, files, "id", column, 4), "id")
    starts = files.where(paths.is_entry_point(F.col("path"))).orderBy("path").limit(4)
    own = starts.agg(F.flatten(F.array_sort(F.collect_list(reading.cite(F.concat("path", F.lit(" looks like a place where the program begins")), F.col("path"), F.lit(1))))).alias("own"))
    line = F.get_json_object(grounding.read_object(F.col("reply")), "$.headline")
    repo = repo.join(F.broadcast(own)).select(  # one row
        texts.headline(F.coalesce(line, "plain"), F.col("plain")).alias("headline"),
        "purpose",
        "stack",
        F.when(F.size("entrypoints") > 0, F.col("entrypoints")).otherwise(F.col("own")).alias("entrypoints"),
        "how_to_run",
        "notes",
        F.when(grounding.read_object(F.col("reply")).isNotNull(), "model").otherwise("analyzer").alias("source"),
    )
    failed = file_replies.union(module_replies).union(repo_replies).where("error is not null").select("id", "error").orderBy("id").limit(WARNINGS)
    return Comprehension(told, told_modules, repo, failed)


def answer(questions: DataFrame, files: DataFrame, ask: Ask, most: int = 6) -> DataFrame:
    """questions(id, question, evidence, history), files(path, loc) -> (id, question, claims, error): grounded answers, `most` claims at most."""
    said = replies(questions.select("id", reading.question_prompt(F.col("question"), F.col("evidence"), F.col("history")).alias("prompt")), ask)
    read = said.select("id", grounding.read_claims(F.col("reply"), "claims", None, most).alias("claims"))
    kept = grounding.keep_grounded(read, files, "id", most=most)
    return questions.select("id", "question").join(kept, "id").join(said.select("id", "error"), "id")
