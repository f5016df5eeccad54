"""Options in layers, and the skip rules of a tree.

Each directory may hold an rc file of TOML; a directory has its parent's options with its own
on top, and a call's options apply last. Lists are added to, other values replaced. Names and
globs hold below the directory that declares them. Ignore files follow the rules of git: the
last pattern that matches decides, a nearer file after a farther one, and nothing below an
ignored directory comes back.

The rules of a tree are few beside its files, and are gathered on the driver and broadcast.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.files import METADATA_FILES, SKIPPED_DIRS, glob_pattern

RC_FILE = ".brindlerc.toml"
IGNORE_FILE = ".gitignore"
DEEP = ("false", "true", "history-only")
#: A tree's rc and ignore files may have so many characters together.
RULE_CHARACTERS = 50_000_000


@dataclass(frozen=True)
class Options:
    auto_excludes: bool = True
    cache_directory: str = ""
    deep: str = "false"
    output_file: str = "-"
    output_format: str = "text"
    color: bool = False
    show_summary: bool = True
    skip_commits: tuple[str, ...] = ()
    skip_commits_up_to: str = ""
    skip_directory_names: tuple[tuple[str, str], ...] = ()  # (anchor, name)
    skip_file_names: tuple[tuple[str, str], ...] = ()
    skip_fingerprints: tuple[str, ...] = ()
    skip_glob: tuple[tuple[str, str], ...] = ()
    skip_vcs_ignored: bool = True
    validate: bool = False
    validate_timeout_seconds: int = 30
    verbose: bool = False

    @property
    def scans_tree(self) -> bool:
        return self.deep != "history-only"

    @property
    def scans_history(self) -> bool:
        return self.deep != "false"


_SCOPED = ("skip_directory_names", "skip_file_names", "skip_glob")
_LISTS = ("skip_commits", "skip_fingerprints")


def applied(options: Options, values: dict, anchor: str = "") -> Options:
    """Options with values on top; unknown keys and values of another type are left out."""
    changes = {}
    for key, value in values.items():
        key = key.replace("-", "_")
        if not hasattr(options, key) or key.startswith("scans_"):
            continue
        old = getattr(options, key)
        if key in _SCOPED or key in _LISTS:
            more = [str(v) for v in (value if isinstance(value, list) else [value])]
            more = [(anchor, v) for v in more] if key in _SCOPED else more
            changes[key] = (*old, *dict.fromkeys(v for v in more if v not in old))
        elif key == "deep":
            value = str(value).lower()
            changes |= {key: value} if value in DEEP else {}
        elif isinstance(value, type(old)):
            changes[key] = value
    return replace(options, **changes)


def ancestors(path: str) -> list[str]:
    """The directories above a path, the farthest first."""
    parts = path.strip("/").split("/")[:-1]
    lead = "/" if path.startswith("/") else ""
    return [lead.rstrip("/") if not i else lead + "/".join(parts[:i]) for i in range(len(parts) + 1)]


@dataclass
class Layers:
    """A tree's options and ignore patterns by directory."""

    rc: dict[str, dict] = field(default_factory=dict)
    ignored: dict[str, list[tuple[re.Pattern, bool, bool]]] = field(default_factory=dict)  # (pattern, negated, directories only)
    given: dict = field(default_factory=dict)

    def __post_init__(self):
        self._known: dict[str, Options] = {}

    def at(self, path: str) -> Options:
        """The options for a file: those of its directories in turn, then the call's."""
        own = path.rsplit("/", 1)[0] if "/" in path else ""
        if own not in self._known:
            options = Options()
            for directory in ancestors(path):
                if directory in self.rc:
                    options = applied(options, self.rc[directory], directory)
            self._known[own] = applied(options, self.given)
        return self._known[own]

    def vcs_ignored(self, path: str) -> bool:
        """Whether the ignore files above a path leave it or a directory above it out."""
        parts = ancestors(path)[1:]
        for item, is_dir in [*((p, True) for p in parts), (path, False)]:
            verdict = False
            for directory in ancestors(item):
                rest = item[len(directory) :].lstrip("/") if directory else item.lstrip("/")
                for pattern, negated, only_dirs in self.ignored.get(directory, ()):
                    if (is_dir or not only_dirs) and pattern.match(rest):
                        verdict = not negated
            if verdict:
                return True
        return False

    def reason(self, path: str) -> str | None:
        """Why a path is skipped, or None: a name, a glob, an ignore file, a directory, a metadata file, in this order; a directory's before its files'."""
        options = self.at(path)
        name, directories = path.rsplit("/", 1)[-1], ancestors(path)[1:]
        below = lambda anchor, item: not anchor or item.startswith(anchor.rstrip("/") + "/")
        for item in directories:
            own = item.rsplit("/", 1)[-1]
            if any(own == n and below(a, item) for a, n in options.skip_directory_names):
                return "directory name"
            if _globbed(options, item):
                return "glob"
        if any(name == n and below(a, path) for a, n in options.skip_file_names):
            return "file name"
        if _globbed(options, path):
            return "glob"
        if options.skip_vcs_ignored and self.vcs_ignored(path):
            return "ignored by version control"
        if options.auto_excludes and any(d.rsplit("/", 1)[-1] in SKIPPED_DIRS for d in directories):
            return "excluded directory"
        return "system metadata" if options.auto_excludes and name in METADATA_FILES else None


def _globbed(options: Options, path: str) -> bool:
    for anchor, glob in options.skip_glob:
        if not anchor or path.startswith(anchor.rstrip("/") + "/"):
            if re.match(glob_pattern(glob), path[len(anchor) :].lstrip("/") if anchor else path.lstrip("/")):
                return True
    return False


def ignore_patterns(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """An ignore file's patterns as (pattern for a path below its directory, negated, directories only)."""
    found = []
    for line in text.split("\n"):
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r"))
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = glob_pattern(line.lstrip("/"))[1:-1]
        found.append((re.compile(rf"(?:{'' if anchored else '(?:.*/)?'}{body})\Z", re.S), negated, only_dirs))
    return found


def layers(files: DataFrame, given: dict | None = None) -> Layers:
    """The layers of a tree (path, text): its rc and ignore files, whose size is checked before they are fetched."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.where(name.isin(RC_FILE, IGNORE_FILE) & F.col("text").isNotNull()).select("path", "text")
    size = own.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size > RULE_CHARACTERS:
        raise ValueError(f"rc and ignore files have {size} characters, more than {RULE_CHARACTERS}")
    made = Layers(given=given or {})
    for row in own.toLocalIterator():
        directory, _, file = row["path"].rpartition("/")
        if file == IGNORE_FILE:
            made.ignored[directory] = ignore_patterns(row["text"])
            continue
        try:
            made.rc[directory] = tomllib.loads(row["text"])
        except tomllib.TOMLDecodeError:
            continue
    return made


def with_reason(files: DataFrame, made: Layers) -> DataFrame:
    """``files`` with ``skip_reason``; null where a file is scanned. Only paths pass through Python, in Arrow batches."""
    held = files.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("string")
    def reason(paths):
        return paths.map(lambda p: None if p is None else held.value.reason(p))

    return files.withColumn("skip_reason", reason("path"))


def nearest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with the longest of the roots (root) that its path lies below; null where there is none.

    The directories above each path are joined to the roots by equality.
    """
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    pairs = files.select("path").distinct().select("path", F.explode(up).alias("root")).join(roots.select("root").distinct(), "root")
    best = pairs.groupBy("path").agg(F.max_by("root", F.char_length("root")).alias("root"))
    return files.join(best, "path", "left")
