"""File inventory: languages, sizes, line counts, hashes, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeterra.functions import paths, texts

MAX_BYTES = 2 << 20

# The language of each extension.
EXTENSIONS = {
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".py": "python",
    ".pyi": "python",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
    ".rb": "ruby",
    ".php": "php",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".scala": "scala",
    ".ex": "elixir",
    ".exs": "elixir",
    ".lua": "lua",
    ".dart": "dart",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".vue": "vue",
    ".svelte": "svelte",
    ".sql": "sql",
    ".md": "markdown",
    ".mdx": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".css": "css",
    ".scss": "css",
    ".html": "html",
}
# The language of whole names, languages that are counted and not analysed, folders and files that are left out.
NAMES = {"Dockerfile": "dockerfile", "Makefile": "make", "Caddyfile": "caddy"}
COUNTED_ONLY = ("sql", "markdown", "json", "yaml", "toml", "css", "html", "dockerfile", "make", "caddy")
SKIPPED_FOLDERS = (
    ".git",
    "node_modules",
    "vendor",
    "dist",
    "build",
    "out",
    ".next",
    ".nuxt",
    ".turbo",
    ".cache",
    "coverage",
    "__pycache__",
    ".venv",
    "venv",
    "target",
    "Pods",
    ".gradle",
    ".idea",
    ".vscode",
    "playwright-report",
    "test-results",
)
SKIPPED_FILES = r"(^|/)(pnpm-lock\.yaml|package-lock\.json|yarn\.lock|poetry\.lock|Cargo\.lock|go\.sum|[^/]*\.min\.(js|css)|[^/]*\.map)$"


def language_of(path: Column) -> Column:
    """By whole base name first, then by extension; null if neither is known."""
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table(NAMES), paths.base_name(path)), F.try_element_at(table(EXTENSIONS), paths.extension_of(path)))


def is_analyzable(language: Column) -> Column:
    return F.coalesce(~language.isin(*COUNTED_ONLY), F.lit(False))


def is_listed(path: Column) -> Column:
    """Whether a path is in the inventory: no generated folder, no lock or minified file."""
    folders = F.split(paths.directory_of(path), "/")
    return ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])) & ~path.rlike(SKIPPED_FILES)


def inventory(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """raw(path, content binary) -> path, language, bytes, loc, hash, parsed, skip_reason. Oversize files have hash '' and no lines.

    Where raw has a column bytes, it is the file's size, and the content of an oversize file may be missing.
    """
    size = F.col("bytes") if "bytes" in raw.columns else F.octet_length("content")
    raw = raw.where(is_listed(F.col("path"))).withColumn("language", language_of(F.col("path"))).withColumn("bytes", size.cast("long"))
    large, binary = F.col("bytes") > max_bytes, texts.is_binary(F.col("content"))
    reason = F.when(large, "too large").when(binary, "binary").when(~is_analyzable(F.col("language")), "unsupported language")
    loc = F.when(large | binary, F.lit(0)).otherwise(texts.line_count(texts.utf8(F.col("content")))).cast("long")
    return raw.select("path", "language", "bytes", loc.alias("loc"), F.when(large, "").otherwise(texts.content_hash(F.col("content"))).alias("hash"), reason.isNull().alias("parsed"), reason.alias("skip_reason"))


def is_readable(hash_: Column, loc: Column) -> Column:
    """Whether lines are read at all."""
    return (hash_ != "") & (loc > 0)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count(F.when(F.col("parsed"), 1)).alias("parsed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))


def language_totals(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def folder_counts(files: DataFrame) -> DataFrame:
    """(folder, files, loc) of every folder, with all that is below it."""
    parts = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k < F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.select(F.explode(above).alias("folder"), "loc").groupBy("folder").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def modules(files: DataFrame) -> DataFrame:
    """(module, files, loc, first): files by their own folder, first is the smallest path."""
    return files.groupBy(paths.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.min("path").alias("first"))
