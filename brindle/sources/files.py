"""File trees as DataFrames: reading, skip rules and file types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are skipped by name, and files that operating systems leave behind.
SKIPPED_DIRS = (".git", ".hg", ".svn", ".jj", "node_modules", "bower_components", "jspm_packages", "vendor", "vendors", "third_party", "third-party", "extern", "externals", "deps", ".cache", ".ccache", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".eggs", ".gradle", ".maven", ".m2", ".ivy2", ".sbt", ".metals", ".bloop", ".dart_tool", ".npm", ".yarn", ".pnpm-store", ".cargo", ".rustup", ".bundle", ".gem", ".pub-cache", "Pods", "Carthage", "coverage", ".nyc_output", "htmlcov", ".coverage", "__snapshots__", ".terraform", ".serverless", ".pulumi")
METADATA_FILES = (".DS_Store", "Thumbs.db", "desktop.ini")
# Lock files of package managers, which are scanned unless a caller leaves them out.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "Cargo.lock", "Gemfile.lock", "gems.locked", "poetry.lock", "composer.lock", "Pipfile.lock", "pubspec.lock", "go.sum", "flake.lock", "deno.lock")
# File types by whole name and by extension.
BY_NAME = {".flaskenv": "FlaskEnv", ".gitconfig": "GitConfig", ".git-credentials": "GitCredentials", ".npmrc": "Npmrc", ".pypirc": "Pypirc", ".editorconfig": "EditorConfig", ".ftpconfig": "Json", ".netrc": "Netrc", "_netrc": "Netrc", ".pgpass": "Pgpass", ".esmtprc": "Esmtprc", "gemfile": "Ruby", "rakefile": "Ruby", "podfile": "Ruby", "guardfile": "Ruby", "vagrantfile": "Ruby"}
BY_EXTENSION = {
    "Astro": "astro", "CSharp": "cs csx", "JavaScript": "js jsx mjs cjs", "TypeScript": "ts tsx mts cts", "Dart": "dart", "Ejs": "ejs", "Erb": "erb", "Go": "go", "Groovy": "groovy gradle gvy gy", "Html": "html htm xhtml",
    "Java": "java", "Kotlin": "kt kts", "Json": "json jsonc tfstate", "Liquid": "liquid", "Php": "php", "Python": "py pyi", "Razor": "razor cshtml", "Ruby": "rb rake gemspec", "Rust": "rs", "Shell": "sh bash zsh",
    "Sql": "sql psql pgsql ddl", "Svelte": "svelte", "Swift": "swift", "Vue": "vue", "Hcl": "tf tfvars hcl", "Plist": "plist", "PowerShell": "ps1 psm1 psd1", "Properties": "properties", "Ini": "ini cfg conf cnf", "DotEnv": "env",
    "Xml": "xml config csproj vbproj fsproj props targets", "Toml": "toml", "Twig": "twig", "Yaml": "yml yaml", "Jupyter": "ipynb",
}


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size, content, text) of every file below a root; text is null where the bytes aren't UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8"))
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", text.alias("text"))


def glob_pattern(glob: str) -> str:
    """A glob of `**`, `*`, `?`, `[..]` and `{a,b}` as a pattern for a whole path."""
    out, depth = "", 0
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|\{|\}|,|.", glob):
        if part == "{":
            out, depth = out + "(?:", depth + 1
        elif part == "}" and depth:
            out, depth = out + ")", depth - 1
        elif part == "," and depth:
            out += "|"
        else:
            out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[0] == "[" else re.escape(part))
    return f"^{out}$"


def skip_reason(path: Column, names: tuple[str, ...] = (), globs: tuple[str, ...] = (), lock_files: bool = False) -> Column:
    """Why a path is skipped, or null: a name, a glob, a skipped directory above it, a metadata file, and a lock file if wanted, in this order."""
    parts = F.split(path, "/")
    file, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    by_name = F.arrays_overlap(parts, listed(names)) if names else F.lit(False)
    by_glob = F.lit(False)
    for glob in globs:
        by_glob = by_glob | path.rlike(glob_pattern(glob))
    return F.when(by_name, "name").when(by_glob, "glob").when(F.arrays_overlap(dirs, listed(SKIPPED_DIRS)), "directory").when(file.isin(*METADATA_FILES), "metadata").when(F.lit(lock_files) & file.isin(*LOCK_FILES), "lock file")


def file_type(path: Column) -> Column:
    """The file type by name, prefix or extension; a file without an extension reads as Ini, an unknown one as null."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    kind = F.when((name == ".env") | name.startswith(".env."), "DotEnv")
    for exact, found in BY_NAME.items():
        kind = kind.when(name == exact, found)
    for stem, found in (("dockerfile", "Dockerfile"), ("jenkinsfile", "Groovy")):
        kind = kind.when((name == stem) | name.startswith(f"{stem}.") | name.endswith(f".{stem}"), found)
    kind = kind.when(name.rlike(r"^(?:redis|sentinel)(?:-.*)?\.conf$"), "Redis").when(name.endswith(".blade.php"), "Blade")
    for found, extensions in BY_EXTENSION.items():
        kind = kind.when(extension.isin(*extensions.split()), found)
    return kind.when(extension == "", "Ini")
