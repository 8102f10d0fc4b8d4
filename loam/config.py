"""Fixed values and settings of the document collection."""

from __future__ import annotations

from dataclasses import dataclass, field

# Sizes and thresholds that results depend on.
MAX_CHUNK_CHARS = 4000
SOFT_BREAK_WINDOW = 800
MAX_K, DEFAULT_K = 20, 10
MIN_SIMILARITY, VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.35, 0.7, 0.3
STALE_HOURS = 24
CHAIN_DEPTH = 10
FUZZY_MATCHES = 5
MAX_TOP, DEFAULT_TOP = 100, 10
DRIFT_TTL_SECONDS = 60
CONTRADICTION_DECISIONS, CONTRADICTION_LENGTHS, CONTRADICTION_HITS = 500, (8, 80), 5
CONTRADICTION_PREFIX, CONTRADICTION_REASON = 40, 60
COVERAGE_FLOOR = 0.80
LOGGED_QUERY, LOGGED_ERROR = 500, 200
BATCH, RETRIES = 100, 5

# Vocabularies.
DOC_TYPES = ("spec", "res", "str", "dec", "pol", "fwk")
STATUSES = ("draft", "in-progress", "complete", "superseded", "needs-review")
LEGACY_STATUS = {"in progress": "in-progress", "active": "complete"}
RELATIONS = ("depends_on", "feeds_into", "also_touches", "supersedes")
SIGNALS = ("stale-string", "dangling-ref", "dep-out-of-date", "decision-contradict")
REQUIRED_FIELDS = ("file", "area", "area-name", "type", "title", "status", "date", "depends-on", "feeds-into")
LIST_FIELDS = ("depends-on", "feeds-into", "also-touches")
NULLS = ("null", "Null", "NULL", "~", "")
SKIP_DIRS = ("session-logs", "shift-and-drift", "handoff", "assets")


@dataclass(frozen=True)
class Pattern:
    """A stale string: a regex matched in any case, why it is stale, and what excuses a line."""

    regex: str
    category: str
    reason: str
    replacement: str | None = None
    excludes: tuple[str, ...] = ()


@dataclass(frozen=True)
class RenameMap:
    renames: dict[str, str] = field(default_factory=dict)
    per_file_renames: dict[str, dict[str, str]] = field(default_factory=dict)
    area_redirects: dict[str, str] = field(default_factory=dict)
    delete_refs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """What a collection sets for itself. parity: keep behaviour that is a fault elsewhere fixed (nested keys
    overwrite a document's own, files edited to nothing keep their chunks)."""

    repo_prefix: str = "corpus"
    excluded_fields: tuple[str, ...] = ()
    patterns: tuple[Pattern, ...] = ()
    renames: RenameMap = RenameMap()
    exclude_globs: tuple[str, ...] = ("TEMPLATES",)
    parity: bool = False
    prune: bool = False
    lite: bool = False

    def __post_init__(self):
        if not self.repo_prefix or "{{" in self.repo_prefix:
            raise ValueError("the collection has no name yet: set repo_prefix")
