"""Committed sources and commit history of a git repository, as tables.

Git is asked once per task, not once per commit or file: a task that reads a slice of the history runs one ``git log -p``, one that
reads files runs one ``git cat-file --batch``.  What the diffs say is read by column expressions.  The repository must be a
folder that the executors see; nothing is read from the working tree.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.text import LANGUAGES, suffix
from lexforge.scratch import materialise
from lexforge.shipping import ship
from lexforge.sources.repo import MAX_FILE_BYTES

#: Commits that one task reads, and files that are asked for in one go.
COMMITS_PER_TASK, FILES_PER_TASK = 256, 512
#: The control characters that end a commit's record and its message in the log.
_RECORD, _MESSAGE = "\x1e", "\x1f"


def git(repo: str, *arguments: str, given: bytes | None = None) -> bytes:
    """What a git command prints; a failing command is an error."""
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *arguments], input=given, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def _log(repo: str, span: str, skip: int, many: int) -> Iterator[bytes]:
    """The records of a slice of the history, read as git prints them."""
    ask = ["git", "-C", repo, "-c", "core.quotePath=false", "log", "--no-merges", "--no-color", "-M", "-w", "--unified=0", "-p", f"--format={_RECORD}%H%n%B{_MESSAGE}"]
    with subprocess.Popen([*ask, f"--skip={skip}", f"--max-count={many}", span], stdout=subprocess.PIPE) as run:
        held = b""
        while piece := run.stdout.read(1 << 20):
            *whole, held = (held + piece).split(_RECORD.encode())
            yield from (w for w in whole if w)
        if held:
            yield held
    if run.returncode:
        raise RuntimeError("git log failed")


def _blobs(repo: str, names: list[str]) -> Iterator[bytes]:
    """The contents of named objects, in order, from one process."""
    said, at = git(repo, "cat-file", "--batch", given="".join(n + "\n" for n in names).encode()), 0
    for name in names:
        end = said.index(b"\n", at)
        about = said[at:end].split(b" ")
        if len(about) != 3 or about[1] != b"blob":
            raise ValueError(f"no such file: {name}")
        size = int(about[2])
        yield said[end + 1 : end + 1 + size]
        at = end + 2 + size


def _contents(files: DataFrame, repo: str, name: str) -> DataFrame:
    """``files`` with the bytes of the object that column ``name`` names (column data)."""
    schema = T.StructType([*files.schema.fields, T.StructField("data", T.BinaryType())])
    at = files.columns.index(name)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FILES_PER_TASK):
                part = batch.slice(i, FILES_PER_TASK)
                data = pa.array(list(_blobs(repo, part.column(at).to_pylist())), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], [*part.schema.names, "data"])

    return files.mapInArrow(read, schema)


def snapshot(spark: SparkSession, repo: str, revision: str = "HEAD", suffixes: tuple[str, ...] = ("rs", "py")) -> DataFrame:
    """Source files of a revision: path, text, sha256, bytes, lines.

    Links, submodules, climbing paths, files over 2 MiB, with a NUL or not in UTF-8 are errors, as is
    a revision without such sources: a snapshot is whole or there is none.
    """
    ship(spark)
    at = git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows = [r for r in git(repo, "ls-tree", "-r", "-z", at).decode().split("\0") if r]
            yield pa.RecordBatch.from_arrays([pa.array(rows)], ["entry"])

    entries = materialise(spark.range(1, numPartitions=1).mapInArrow(listed, "entry string"), "git-tree")
    about, path = F.split(F.substring_index("entry", "\t", 1), " "), F.substring(F.col("entry"), F.locate("\t", F.col("entry")) + 1, F.char_length("entry"))
    found = entries.select(path.alias("path"), about[0].alias("mode"), about[2].alias("oid")).where(suffix(F.col("path")).isin(*suffixes))
    odd = ~F.col("mode").isin("100644", "100755") | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(odd, F.col("path"))).alias("odd")).head()
    if seen["odd"] is not None:
        raise ValueError(f"not a plain file below the root: {seen['odd']}")
    if not seen["n"]:
        raise ValueError("the revision holds no such sources")
    dealt = found.select("path", "oid").repartition(-(-seen["n"] // FILES_PER_TASK))
    read = _contents(dealt, repo, "oid")
    held = F.try_validate_utf8(F.col("data").cast("string"))
    bad = (F.octet_length("data") > MAX_FILE_BYTES) | held.isNull() | F.contains(held, F.lit("\0"))
    text = F.when(bad, F.raise_error(F.concat(F.lit("not a source file: "), F.col("path"))).cast("string")).otherwise(held)
    ends = F.regexp_count("text", F.lit(r"\r\n|\r|\n"))
    whole = read.select("path", text.alias("text"), F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("bytes"))
    return whole.withColumn("lines", (ends + F.when(F.col("text").rlike(r"[^\r\n]\z"), 1).otherwise(0)).cast("long"))


def old_lines(section: Column) -> Column:
    """Lines of the old file that a diff of one file without context changes; an insertion counts for the line before it."""
    hunk = F.lit(r"(?m)^@@ -(\d+)(?:,(\d+))? \+")
    begins, sizes = (F.regexp_extract_all(section, hunk, F.lit(k)) for k in (1, 2))

    def covered(begin: Column, size: Column) -> Column:
        many = F.greatest(F.coalesce(F.nullif(size, F.lit("")).cast("int"), F.lit(1)), F.lit(1))
        return F.sequence(begin.cast("int"), begin.cast("int") + many - 1)

    return F.flatten(F.zip_with(begins, sizes, covered))


def file_changes(diff: Column) -> Column:
    """array<struct<path, lines>> of the source files that a diff modifies; those it adds, deletes or renames aren't there."""
    sections = F.split(diff, r"(?m)^diff --git ")
    old = lambda s: F.regexp_extract(s, r"(?m)^--- a/(.*?)\t?$", 1)
    kept = F.filter(sections, lambda s: (old(s) != "") & (old(s) == F.regexp_extract(s, r"(?m)^\+\+\+ b/(.*?)\t?$", 1)) & ~s.rlike(r"(?m)\A[^@]*^rename from "))
    found = F.transform(kept, lambda s: F.struct(old(s).alias("path"), old_lines(s).alias("lines")))
    return F.filter(found, lambda c: suffix(c["path"]).isin(*sorted(LANGUAGES)) & (F.size(c["lines"]) > 0))


def commits(spark: SparkSession, repo: str, since: str, until: str = "HEAD", limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """Commits of ``since..until`` but merges: position, commit, message, changes (:func:`file_changes`; white space alone is no change).

    Positions count from the end that ``newest_first`` names; ``limit`` keeps the first ones.
    """
    ship(spark)
    span = f"{since}..{until}"
    total = int(git(repo, "rev-list", "--count", "--no-merges", span))
    kept = total if limit is None else min(limit, total)
    begin = 0 if newest_first else total - kept  # git's own order is newest first
    starts = spark.range(begin, begin + kept, COMMITS_PER_TASK, numPartitions=max(1, -(-kept // COMMITS_PER_TASK)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                for i, record in enumerate(_log(repo, span, start, min(COMMITS_PER_TASK, begin + kept - start))):
                    yield pa.RecordBatch.from_arrays([pa.array([start + i]), pa.array([record.decode(errors="replace")])], ["at", "record"])

    raw = starts.mapInArrow(read, "at long, record string")
    head, diff = F.substring_index("record", _MESSAGE, 1), F.substring_index("record", _MESSAGE, -1)
    position = F.col("at") if newest_first else total - 1 - F.col("at")
    message = F.regexp_replace(F.substring(head, F.locate("\n", head) + 1, F.char_length(head)), r"^\s+|\s+$", "")
    return raw.select(position.alias("position"), F.substring_index(head, "\n", 1).alias("commit"), message.alias("message"), file_changes(diff).alias("changes"))


def touched_definitions(history: DataFrame, repo: str, parse) -> DataFrame:
    """commit, path, name, line of the innermost definition around each changed line of the old files.

    ``parse`` makes symbols (path, name, line, end_line) of files (path, text), as
    ``lambda files: source.symbols(source.parse(files))`` does.
    """
    from lexforge.operators.graph import locate

    each = history.select("commit", F.explode("changes").alias("c")).select("commit", F.col("c.path").alias("file"), F.col("c.lines").alias("lines"))
    each = materialise(each.withColumn("path", F.concat_ws(":", "commit", "file")), "git-changes")
    old = _contents(each.select("path", F.concat("commit", F.lit("^:"), "file").alias("object")).distinct(), repo, "object")
    points = each.select("path", F.explode("lines").alias("line")).distinct()
    found = locate(points, parse(old.select("path", F.decode("data", "UTF-8").alias("text"))), ["path"]).where("span_name IS NOT NULL")
    parts = F.split("path", ":", 2)
    return found.select(parts[0].alias("commit"), parts[1].alias("path"), F.col("span_name").alias("name"), F.col("span_line").alias("line")).distinct()
