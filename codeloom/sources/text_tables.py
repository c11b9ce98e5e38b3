"""Source files and reports as tables of lines."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.scalars import ignored, redacted_lines

#: Folders that a scan of sources leaves out.
SKIPPED = ("target", "build", ".git", ".idea", ".gradle", "node_modules", "out", "bin")


def java_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of the Java files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(root)
    skip = "/(" + "|".join(x.replace(".", "[.]") for x in SKIPPED) + ")/"
    return files.where(~F.col("path").rlike(skip)).select("path", F.decode("content", "UTF-8").alias("text"))


def _local_files(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), f"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    return files.select(rel.alias("path"), F.col("length").alias("size"), "content").where(~ignored(F.col("path"), globs))


def local_snapshot(spark: SparkSession, root: str, globs: list[str], most_bytes: int = 1 << 20) -> DataFrame:
    """path, size, sha256 of the files under a folder that no rule ignores, no null byte marks as binary, and that aren't too large.

    It is complete if `not_in_snapshot` has no row with the reason "too large".
    """
    own = _local_files(spark, root, globs).where(F.col("size") <= most_bytes)
    return own.where(~F.contains(F.col("content"), F.lit(b"\x00"))).select("path", "size", F.sha2("content", 256).alias("sha256"))


def not_in_snapshot(spark: SparkSession, root: str, globs: list[str], most_bytes: int = 1 << 20) -> DataFrame:
    """path, size, reason of the files that no rule ignores and that local_snapshot leaves out: too large, or binary."""
    reason = F.when(F.col("size") > most_bytes, "too large").when(F.contains(F.col("content"), F.lit(b"\x00")), "binary")
    return _local_files(spark, root, globs).select("path", "size", reason.alias("reason")).where("reason is not null")


def _members(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """archive, path, size, content, skipped of every entry but folders; content is null where skipped says why."""

    def entries(data: bytes) -> Iterator[tuple[str, int, bool, Callable[[], bytes]]]:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from ((i.filename, i.file_size, True, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                yield from ((m.name, m.size, m.isfile(), lambda m=m: t.extractfile(m).read()) for m in t if not m.isdir())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    for name, size, is_file, read in entries(bytes(data)):
                        unsafe = name.startswith("/") or ".." in name.split("/")
                        skipped = "unsafe path" if unsafe else "no plain file" if not is_file else "too large" if size > most_bytes else None
                        yield pd.DataFrame({"archive": [archive], "path": [name], "size": [size], "content": [None if skipped else read()], "skipped": [skipped]})
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
                    yield pd.DataFrame({"archive": [archive], "path": [None], "size": [0], "content": [None], "skipped": [f"broken: {type(e).__name__}"]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "archive string, path string, size long, content binary, skipped string")


def archive_files(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """archive, path, content of the files in ZIP and TAR archives, whatever they come to together.

    An archive is opened by one task, a member at a time. Links, absolute paths, paths with .. and members that are over
    most_bytes by their header are left out before they are unpacked; archive_skips lists them.
    """
    return _members(spark, path, most_bytes).where("skipped is null").select("archive", "path", "content")


def archive_skips(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """archive, skipped, n: how many members archive_files leaves out, for each reason; a broken archive says so."""
    return _members(spark, path, most_bytes).where("skipped is not null").groupBy("archive", "skipped").agg(F.count(F.lit(1)).alias("n"))


def lines(texts: DataFrame, key: str) -> DataFrame:
    """key, line (from 1), text of each line."""
    return texts.select(key, F.posexplode(F.split("text", "\r?\n")).alias("at", "line_text")).select(key, (F.col("at") + 1).alias("line"), F.col("line_text").alias("text"))


def line_range(texts: DataFrame, key: str, first: int, last: int, most: int = 500) -> DataFrame:
    """Lines first to last of each text, at most `most` of them, secrets and private keys hidden."""
    end = min(last, first + most - 1)
    part = F.slice(F.split("text", "\r?\n"), first, max(0, end - first + 1))
    return texts.select(key, F.posexplode(redacted_lines(part)).alias("at", "line_text")).select(key, (F.col("at") + first).alias("line"), F.col("line_text").alias("text"))


def search_lines(texts: DataFrame, key: str, query: str, longest: int = 200) -> DataFrame:
    """key, line, snippet of lines that hold the query, whatever its case: the line without spaces around it, `longest` characters
    at most; secrets and the lines of private keys are hidden."""
    kept = F.split("text", "\r?\n")
    both = texts.select(key, F.posexplode(F.arrays_zip(kept.alias("line"), redacted_lines(kept).alias("shown"))).alias("at", "both"))
    hit = both.where(F.contains(F.lower("both.line"), F.lit(query.lower()))).select(key, (F.col("at") + 1).alias("line"), F.regexp_replace("both.shown", r"^\s+|\s+$", "").alias("shown"))
    return hit.select(key, "line", F.when(F.length("shown") > longest, F.concat(F.substring("shown", 1, longest), F.lit("\u2026"))).otherwise(F.col("shown")).alias("snippet"))


def source_root(path: Column, text: Column) -> Column:
    """The folder above a file's package: the path without the package's segments and the file's name."""
    package = F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    segments = F.concat(F.lit("/"), F.replace(package, F.lit("."), F.lit("/")))
    return F.when((package != "") & F.endswith(folder, segments), F.substr(folder, F.lit(1), F.length(folder) - F.length(segments))).otherwise(folder)


def conventions(texts: DataFrame, key: str, most_sections: int = 50, most_items: int = 100) -> DataFrame:
    """key, section, title, item, text: list items under the headings of a markdown text, code fences left out."""
    w = Window.partitionBy(key).orderBy("line")
    rows = lines(texts, key).withColumn("fence", F.sum(F.when(F.col("text").startswith("```"), 1).otherwise(0)).over(w)).where("fence % 2 = 0")
    head = F.regexp_extract("text", r"^#{1,6}\s+(.+?)\s*$", 1)
    rows = rows.withColumn("head", F.nullif(head, F.lit(""))).withColumn("section", F.count("head").over(w)).withColumn("title", F.last("head", ignorenulls=True).over(w))
    item = F.regexp_extract("text", r"^\s*(?:[-*+]|\d+[.])\s+(.+?)\s*$", 1)
    items = rows.select(key, "line", "section", "title", item.alias("text")).where("text <> '' and section > 0")
    nth = F.row_number().over(Window.partitionBy(key, "section").orderBy("line"))
    return items.withColumn("item", nth).where((F.col("item") <= most_items) & (F.col("section") <= most_sections)).select(key, "section", "title", "item", "text")


def stack_frames(traces: DataFrame, key: str) -> DataFrame:
    """key, cause, position, class_name, method, file, line of stack traces; cause counts the "Caused by" sections before a frame."""
    w = Window.partitionBy(key).orderBy("line")
    rows = lines(traces, key).withColumn("cause", F.sum(F.when(F.col("text").rlike(r"^\s*Caused by:"), 1).otherwise(0)).over(w))
    frame = r"^\s*at\s+(?:[\w.@/]+/)?([\w.$]+)\.([\w$<>]+)\(([^:()]*)(?::(\d+))?\)"
    at = [F.regexp_extract("text", frame, k) for k in range(1, 5)]
    method = F.regexp_replace(F.when(at[1] == "<init>", F.element_at(F.split(at[0], r"[.$]"), -1)).otherwise(at[1]), r"^lambda\$(\w+)\$\d+$", "$1")
    return rows.where(F.col("text").rlike(frame)).select(key, "cause", F.col("line").alias("position"), F.regexp_replace(at[0], r"\$.*$", "").alias("class_name"), method.alias("method"), at[2].alias("file"), F.nullif(at[3], F.lit("")).cast("int").alias("at_line"))


def compiler_errors(outputs: DataFrame, key: str, most: int = 50) -> DataFrame:
    """key, file, at_line, message: distinct errors in the output of Maven or javac, in their order, at most `most` a key."""
    maven, javac = r"^\[ERROR\]\s+(\S+\.java):\[(\d+),\d+\]\s*(.*)$", r"^(\S+\.java):(\d+): error: (.*)$"
    rows = lines(outputs, key)
    pick = lambda k: F.when(F.col("text").rlike(maven), F.regexp_extract("text", maven, k)).when(F.col("text").rlike(javac), F.regexp_extract("text", javac, k))
    found = rows.select(key, "line", pick(1).alias("file"), pick(2).cast("int").alias("at_line"), pick(3).alias("message")).where("file is not null")
    first = found.groupBy(key, "file", "at_line", "message").agg(F.min("line").alias("line"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select(key, "file", "at_line", "message")


def file_scores(texts: DataFrame, key: str, words: list[str]) -> DataFrame:
    """key, score: ten points for each line that holds a word, for each word, and one for each distinct word."""
    rows = lines(texts, key)
    hits = rows.select(key, F.explode(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("text"), w))).alias("word"))
    return hits.groupBy(key).agg((F.count(F.lit(1)) * 10 + F.countDistinct("word")).alias("score"))


def folders(paths: DataFrame) -> DataFrame:
    """folder, depth, n_files: every folder on the way to a file, with the files below it."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))).alias("depth")
    rows = paths.select(parts.alias("parts")).where(F.size("parts") > 1).select("parts", at)
    return rows.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("folder"), "depth").agg(F.count(F.lit(1)).alias("n_files"))


def markdown_rows(files: DataFrame, key: str) -> DataFrame:
    """key, line, cells: the rows of Markdown tables in texts (key, text), rules below the heads left out; cells are trimmed.

    A row is a line that begins with a bar, spaces aside; a bar after a backslash belongs to its cell.
    """
    row = F.regexp_replace(F.trim("text"), r"^[|]|(?<!\\)[|]$", "")
    cells = F.transform(F.split(row, r"(?<!\\)[|]"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    at = lines(files, key).where(F.startswith(F.trim("text"), F.lit("|")) & ~F.col("text").rlike(r"^[\s|:\-]+$"))
    return at.select(key, "line", cells.alias("cells"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a head, every part by its own task; arrays are spread over columns first by the caller."""
    rows.write.mode("errorifexists").option("header", True).csv(path)
