"""Path predicates.  Evaluate them on ``files`` before lines are exploded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

# Folders, suffixes, extensions and base names.
LOW_SIGNAL_DIRS = ["docs", "doc", "examples", "example", "fixtures", "fixture", "testdata", "samples", "sample",
                   "tests", "test", "__tests__", "spec"]
LOW_SIGNAL_SUFFIXES = ["_test.go", ".test.js", ".test.ts", ".spec.js", ".spec.ts", ".md"]
PRODUCTION_EXT = [".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".sh", ".bash", ".zsh", ".rb", ".php", ".java", ".cs",
                  ".rs", ".yml", ".yaml", ".json", ".toml", ".mjs", ".cjs"]
SIGNAL_EXT = [*PRODUCTION_EXT, ".ps1"]
PLUGIN_SCRIPT_EXT = [".go", ".js", ".ts", ".py", ".sh", ".rb", ".php"]
DECLARATION_NAMES = ["skill.md", "readme.md", "description.md", "manifest.md"]
EXCLUDED_FILE_PARTS = ["_test.go", "test_", ".test.js", ".spec.js", "README.md", "CHANGELOG", "LICENSE",
                       "example", "sample", "test"]
LANGUAGE_BY_EXT = {
    ".md": "markdown", ".go": "go", ".js": "javascript", ".ts": "typescript", ".py": "python", ".java": "java",
    ".rs": "rust", ".php": "php", ".rb": "ruby", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql",
    ".html": "html", ".htm": "html", ".css": "css", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp",
}
MANIFEST_NAMES = [
    "requirements.txt", "requirements-dev.txt", "pyproject.toml", "poetry.lock", "pipfile", "pipfile.lock",
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.mod", "go.sum", "pom.xml",
    "build.gradle", "build.gradle.kts", "gradle.lockfile", "gemfile", "gemfile.lock", "cargo.toml", "cargo.lock",
    "composer.json", "composer.lock", "cyclonedx.json", "cyclonedx.xml", "sbom.json", "sbom.xml",
]


def _slashed(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_ext(path: Column) -> Column:
    """Lower-cased extension with its dot, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def _in_low_signal_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(_slashed(path), "/"), F.array(*[F.lit(d) for d in LOW_SIGNAL_DIRS]))


def is_low_signal_path(path: Column) -> Column:
    """Documentation, example, fixture or test location."""
    low = _slashed(path)
    return _in_low_signal_dir(path) | any_of(low.endswith(s) for s in LOW_SIGNAL_SUFFIXES)


def is_production_source(path: Column) -> Column:
    ext = file_ext(path)
    return ~is_low_signal_path(path) & (ext.isin(PRODUCTION_EXT) | (ext == ""))


def is_signal_file(path: Column) -> Column:
    """Behaviour-scan gate."""
    ext = file_ext(path)
    return ~_in_low_signal_dir(path) & (ext.isin(SIGNAL_EXT) | (ext == ""))


def is_declaration(path: Column) -> Column:
    return F.lower(base_name(path)).isin(DECLARATION_NAMES)


def in_scripts_dir(path: Column) -> Column:
    low = _slashed(path)
    return low.contains("/scripts/") | low.startswith("scripts/")


def is_script(path: Column) -> Column:
    return in_scripts_dir(path) & is_production_source(path)


def is_plugin_script(path: Column) -> Column:
    """Narrower script test of the package plugin: top-level ``scripts/`` only."""
    return _slashed(path).startswith("scripts/") & file_ext(path).isin(PLUGIN_SCRIPT_EXT)


def is_excluded_file(path: Column, parts: list[str] | None = None) -> Column:
    return any_of(path.contains(p) for p in (parts or EXCLUDED_FILE_PARTS))


def is_manifest(path: Column) -> Column:
    base = F.lower(base_name(path))
    return base.isin(MANIFEST_NAMES) | base.contains("sbom") | base.endswith(".spdx") | base.endswith(".spdx.json")


def language_of(path: Column) -> Column:
    """Language, or null for files the artifact reader drops."""
    base, ext = F.lower(base_name(path)), file_ext(path)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXT.items() for x in kv])
    return (
        F.when(base == "go.mod", F.lit("gomod"))
        .when(base == "package.json", F.lit("json"))
        .when((ext == ".md") & ~base.isin(DECLARATION_NAMES), F.lit(None).cast("string"))
        .otherwise(F.element_at(table, ext))
    )
