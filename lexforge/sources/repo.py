"""A source tree as a table: an ignore-aware walk as a Python data source.

Hidden entries, ``.git``, a root ``target`` folder, and what ``.gitignore`` and ``.ignore`` files
exclude are left out (unless ``no_ignore``), as are symlinks, files over 2 MiB, files with a NUL and
files that aren't UTF-8; the last three stand in the table with a ``reason`` if ``skipped`` is set.
The driver lists the top of the tree until there are folders enough; tasks list and read what lies below
them.  Filters on ``path`` and ``suffix`` are pushed into the walk: folders that can't match aren't entered, and
files that don't match aren't opened.  The folder must be one that the executors see.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

#: Bounds of a workspace.
MAX_FILE_BYTES, MAX_PATH_BYTES, FILES_PER_TASK = 2 << 20, 4096, 64
#: Folders from which on each is a task of its own.
FOLDER_TASKS = 256
SCHEMA = "path string, text string, bytes long, reason string, suffix string"


def suffix_of(path: str) -> str:
    """What follows the last full stop of the file's name, in lower case."""
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""


def resolve(root: str, path: str) -> str:
    """The path below ``root``; absolute, climbing, over-long and symlinked paths are errors."""
    if len(path.encode()) > MAX_PATH_BYTES:
        raise ValueError("path is too long")
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "~")) or re.match(r"^[A-Za-z]:", path) or ".." in parts:
        raise ValueError("path must be relative and stay below the root")
    at = Path(root)
    for part in parts:
        if part in ("", "."):
            continue
        at = at / part
        if at.is_symlink():
            raise ValueError("path goes through a symlink")
    if not at.exists():
        raise FileNotFoundError(path)
    return str(at)


def root_from_uri(uri: str) -> str:
    """The folder of a ``file://`` URI; home and the root of the file system are refused."""
    from urllib.parse import unquote, urlsplit

    parts = urlsplit(uri)
    if parts.scheme != "file" or parts.netloc not in ("", "localhost"):
        raise ValueError("only local file URIs name a root")
    root = os.path.normpath(unquote(parts.path))
    if root in ("/", os.path.expanduser("~")):
        raise ValueError("the home folder and the file system's root can't be searched")
    return root


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file."""

    pattern: re.Pattern
    negated: bool
    folders_only: bool

    @classmethod
    def parse(cls, line: str) -> Rule | None:
        line = line.rstrip("\n").rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        out, i = "", 0
        line = line.removeprefix("/")
        while i < len(line):
            c = line[i]
            if line.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                out, i = out + ".*", i + 2
            elif c == "*":
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                body = line[i + 1 : end]
                out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            elif c == "\\" and i + 1 < len(line):
                out, i = out + re.escape(line[i + 1]), i + 2
            else:
                out, i = out + re.escape(c), i + 1
        return cls(re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders)


def _rules(folder: str) -> list[Rule]:
    found = []
    for name in (".gitignore", ".ignore"):  # the later file wins
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as lines:
                found += [r for line in lines if (r := Rule.parse(line))]
        except OSError:
            continue
    return found


def _listed(root: str, relative: str, rules: list[tuple[str, list[Rule]]], no_ignore: bool) -> tuple[list[str], list[str], list[tuple[str, list[Rule]]]]:
    """(files, folders, rules that hold inside) of one folder; ``rules`` are those of the folders above it."""
    folder = os.path.join(root, relative) if relative else root
    if not no_ignore:
        rules = [*rules, (relative, _rules(folder))]
    files, folders = [], []
    with os.scandir(folder) as entries:
        for e in entries:
            path = f"{relative}/{e.name}" if relative else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or e.is_symlink() or path == "target" and is_dir:
                continue
            ignored = False
            for base, own in rules:
                inner = path[len(base) + 1 :] if base else path
                for rule in own:
                    if rule.pattern.match(inner) and (is_dir or not rule.folders_only):
                        ignored = not rule.negated
            if ignored:
                continue
            if is_dir:
                folders.append(path)
            elif e.is_file(follow_symlinks=False):
                files.append(path)
    return files, folders, rules


def walk(root: str, no_ignore: bool = False, below: str = "", fits: Callable[[str], bool] = lambda folder: True) -> Iterator[str]:
    """Relative paths of the files below a folder of a tree, entering the folders that ``fits``."""
    rules: list[tuple[str, list[Rule]]] = []
    if below and not no_ignore:  # the rules of the folders above hold as well
        parts = below.split("/")
        rules = [(at, _rules(os.path.join(root, at))) for at in ("/".join(parts[:k]) for k in range(len(parts)))]
    todo = [(below, rules)]
    while todo:
        folder, rules = todo.pop()
        files, folders, inside = _listed(root, folder, rules, no_ignore)
        yield from files
        todo += [(f, inside) for f in folders if fits(f)]


def load_text(path: str) -> tuple[str | None, int, str | None]:
    """(text, bytes, reason): the text of a readable text file, else why there is none."""
    size = os.path.getsize(path)
    if size > MAX_FILE_BYTES:
        return None, size, "too_large"
    with open(path, "rb") as f:
        data = f.read()
    if b"\0" in data:
        return None, size, "not_text"
    try:
        return data.decode("utf-8"), size, None
    except UnicodeDecodeError:
        return None, size, "not_text"


@dataclass
class _Part(InputPartition):
    """What one task lists and reads: whole folders, and files of folders that were listed already."""

    folders: list[str]
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.no_ignore = options.get("no_ignore", "false").lower() == "true"
        self.skipped = options.get("skipped", "false").lower() == "true"
        #: Conjunctive tests of a path: (kind, values).
        self.tests: list[tuple[str, tuple[str, ...]]] = []
        if scope := options.get("scope", ""):
            self.tests.append(("below", (scope.rstrip("/"),)))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests of the path and of the suffix are decided before a file is opened."""
        for f in filters:
            kind = {EqualTo: "is", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}.get(type(f))
            if f.attribute == ("path",) and kind:
                self.tests.append((kind, (f.value,)))
            elif f.attribute == ("path",) and isinstance(f, In):
                self.tests.append(("is", tuple(f.value)))
            elif f.attribute == ("suffix",) and isinstance(f, EqualTo):
                self.tests.append(("suffix", (f.value,)))
            elif f.attribute == ("suffix",) and isinstance(f, In):
                self.tests.append(("suffix", tuple(f.value)))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        test = {
            "is": lambda v: path == v,
            "below": lambda v: path == v or path.startswith(v + "/"),
            "starts": path.startswith,
            "ends": path.endswith,
            "holds": lambda v: v in path,
            "suffix": lambda v: suffix_of(path) == v,
        }
        return all(any(test[kind](v) for v in values) for kind, values in self.tests)

    def _entered(self, folder: str) -> bool:
        """Whether a folder can hold a wanted path."""
        inside = folder + "/"
        for kind, values in self.tests:
            heads = [v + "/" for v in values] if kind == "below" else values
            if kind in ("is", "below", "starts") and not any(inside.startswith(h) or h.startswith(inside) for h in heads):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """The top of the tree is listed here, folder by folder, until there are enough folders for many tasks."""
        files: list[str] = []
        todo: list[tuple[str, list[tuple[str, list[Rule]]]]] = [("", [])]
        at = 0
        while at < len(todo) and len(todo) - at < FOLDER_TASKS:
            folder, rules = todo[at]
            at += 1
            own, folders, inside = _listed(self.root, folder, rules, self.no_ignore)
            files += [p for p in own if self._wanted(p)]
            todo += [(f, inside) for f in folders if self._entered(f)]
        parts = [_Part([folder], []) for folder, _ in todo[at:]]
        parts += [_Part([], files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)]
        return parts or [_Part([], [])]

    def read(self, partition: _Part):
        listed = (p for folder in partition.folders for p in walk(self.root, self.no_ignore, folder, self._entered) if self._wanted(p))
        for path in chain(partition.files, listed):
            try:
                text, size, reason = load_text(os.path.join(self.root, path))
            except OSError:
                text, size, reason = None, 0, "unreadable"
            if reason is None or self.skipped:
                yield path, text, size, reason, suffix_of(path)


class RepoDataSource(DataSource):
    """``spark.read.format("repo").load(folder)``; options no_ignore, skipped, scope."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_repo(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The files of a tree; never cached across calls, so each question sees the tree as it is."""
    from lexforge.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoDataSource)
    return spark.read.format("repo").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load(root)


def go_module(files: DataFrame) -> str | None:
    """Module path from the root's go.mod."""
    from pyspark.sql import functions as F

    row = files.where(F.col("path") == "go.mod").select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)).head()
    return row[0] or None if row else None
