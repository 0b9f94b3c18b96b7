"""Classes of queries, contents and lines, and fixed per-language and per-kind rules, as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns and rates that results depend on, in the order in which they are tried.
HIGH_RISK = ("security", "auth", "authentication", "password", "secret", "credential", "payment", "billing", "encrypt", "decrypt", "token", "vulnerability", "injection", "sanitize")
LOW_RISK = ("explain", "what is", "how does", "summarize", "describe", "chat", "hello")
ARCHETYPES = (
    (r"\b(?:pytest|jest|vitest|mocha|rspec|phpunit)\b", "test/run"),
    (r"\b(?:run|execute)\b.*\b(?:test|spec|suite)\b", "test/run"),
    (r"\b(?:write|add|create)\b.*\b(?:test|spec|unit test)\b", "test/write"),
    (r"\b(?:fix|debug|failing)\b.*\btest\b", "test/fix"),
    (r"\b(?:build|compile|tsc|webpack|cargo build|go build|make)\b", "build/run"),
    (r"\b(?:fix|resolve)\b.*\b(?:build|compilation|type)\s*(?:error|issue)\b", "build/fix"),
    (r"\b(?:lint|eslint|pylint|ruff|clippy|format|prettier|black)\b", "lint/run"),
    (r"\b(?:mypy|pyright|typecheck|type.?check|tsc.*noEmit)\b", "typecheck/run"),
    (r"\b(?:refactor|rename|move|extract|inline)\b", "code/refactor"),
    (r"\b(?:add|implement|create|write)\b.*\b(?:function|method|class|component|endpoint)\b", "code/implement"),
    (r"\b(?:fix|debug|resolve|patch)\b.*\b(?:bug|error|issue|crash|exception)\b", "code/fix_bug"),
    (r"\b(?:update|change|modify|edit)\b", "code/edit"),
    (r"\b(?:explain|what does|how does|why does|what is|describe|summarize)\b", "explain"),
    (r"\b(?:read|look at|check|review|show|find|search|grep)\b", "inspect"),
    (r"\b(?:git|commit|push|pull|merge|rebase|branch|diff|status)\b", "git/op"),
    (r"\b(?:install|setup|configure|init|npm|pip|cargo)\b", "setup"),
)
INTENTS = (
    ("Audit", ("security", "vulnerability", "cve", "pii", "compliance", "audit", "gdpr", "hipaa", "sox", "penetration")),
    ("Incident", ("incident", "outage", "downtime", "crash", "spike", "latency", "alert", "pager")),
    ("Repair", ("fix", "repair", "broken", "failing", "error", "bug", "root cause", "regression", "debug")),
    ("TestGap", ("test", "coverage", "uncovered", "missing test", "test gap", "untested")),
    ("Release", ("release", "deploy", "rollout", "ready to ship", "changelog", "version")),
    ("PrBrief", ("pr", "pull request", "diff", "review", "merge", "commit")),
    ("CodeGeneration", ("generate", "write code", "implement", "scaffold", "create function", "migration")),
    ("Report", ("report", "slide", "presentation", "diagram", "chart", "visuali")),
    ("Research", ("research", "benchmark", "compare", "evaluate", "study", "analyze options")),
    ("Architecture", ("architecture", "design", "how does", "system", "module", "component", "dependency", "flow", "pipeline")),
    ("Reuse", ("reuse", "existing", "already have", "duplicate", "shared", "utility", "helper")),
    ("Onboarding", ("onboard", "explain", "new engineer", "getting started", "walkthrough", "tutorial")),
)
LEGAL = ("whereas", "hereby", "hereinafter", "pursuant", "notwithstanding")
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".rs": "rust", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go", ".java": "java", ".kt": "kotlin", ".rb": "ruby",
    ".sql": "sql", ".sh": "bash", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".md": "markdown", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
}
CHARS_PER_TOKEN = {
    "python": 3.0, "rust": 3.5, "typescript": 3.1, "javascript": 3.1, "go": 3.4, "java": 3.2, "kotlin": 3.2, "ruby": 3.0, "c": 3.6, "cpp": 3.4, "sql": 3.3, "json": 2.8, "yaml": 3.5, "toml": 3.5, "markdown": 4.0, "bash": 3.2,
}
OTHER_CHARS_PER_TOKEN = 3.3
SEPARATORS = "═─━┄┅┈┉╌╍╴╶╸╺─—–=~*-+|·•"
PROGRESS = "█▓▒░▏▎▍▌▋▊▉#=>-.%"
LOG_STAMP = r"^(?:\[[^\]\r\n]*\d{2}:\d{2}:\d{2}(?:[.,]\d+)?[^\]\r\n]*\]|\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+"
LOG_KEPT = (
    r"(?i)\bHTTP(?:/\d(?:\.\d)?)?\s+\d{3}\b|\b(?:http[_ -]?status|status(?:_code)?|exit(?:ed)?[_ -]?(?:code|status)|signal|errno|error[_ -]?code|amount(?:_cents)?|total|balance|price|cost|fee|tax|port|version|line|column)"
    r"\s*[=: #]?\s*[-+]?\d+(?:\.\d+)?\b"
)
LOG_VARIABLE = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|0x[0-9a-fA-F]+|\b[0-9a-fA-F]{16,}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d+(?:\.\d+)?(?:ms|us|ns|kb|mb|gb)\b"
    r"|\b(?:retry|attempt|counter|sequence|seq|request[_ -]?id|trace[_ -]?id)\s*[=: #]?\s*\d+\b"
)


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def risk_domain(query: Column) -> Column:
    """high, low or standard; high words come first. Null counts as empty."""
    lower = F.lower(F.coalesce(query, F.lit("")))
    return F.when(_has_any(lower, HIGH_RISK), "high").when(_has_any(lower, LOW_RISK), "low").otherwise("standard")


def intent(query: Column) -> Column:
    """The first of INTENTS of which a word occurs, else General. Null counts as empty."""
    lower = F.lower(F.coalesce(query, F.lit("")))
    found = F.when(F.lit(False), "")
    for name, words in INTENTS:
        found = found.when(_has_any(lower, words), name)
    return found.otherwise("General")


def archetype(message: Column) -> Column:
    """The first of ARCHETYPES that matches, else general; unknown for empty or null messages. Words end at any script's letters."""
    text = F.coalesce(message, F.lit(""))
    found = F.when(text == "", "unknown")
    for pattern, name in ARCHETYPES:
        found = found.when(text.rlike("(?iUd)" + pattern), name)
    return found.otherwise("general")


def content_type(text: Column) -> Column:
    """One of ten kinds; prose for null, short or other texts. Only heads are looked at for most kinds, by definition."""
    t = F.coalesce(text, F.lit(""))
    head = lambda n: F.substring(t, 1, n)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    commas, breaks = count(","), count("\n")
    return (
        F.when(F.length(t) < 20, "prose")
        .when(t.rlike(r"(?U)^\s*[{\[]"), "json")
        .when(t.rlike(r"(?U)^\s*<") & head(200).contains(">"), "xml")
        .when(head(500).rlike(r"(?mdU)^#{1,6}\s"), "markdown")
        .when(head(500).rlike(r"(?mdU)^\d{4}[-/]\d{2}|^\[?\d{2}:\d{2}|^(DEBUG|INFO|WARN|ERROR)"), "log")
        .when((commas > 10) & (breaks > 3) & (commas / F.greatest(breaks, F.lit(1)) > 2), "csv")
        .when((count("|") > 6) & (breaks > 2), "table")
        .when(head(500).rlike(r"(?mdU)^(From|To|Subject|Date):\s"), "email")
        .when(_has_any(F.lower(head(2000)), LEGAL), "legal")
        .when(head(1000).rlike(r"(?mdU)(Traceback|Exception|at\s+\S+\.\S+\(|^\s+at\s)"), "stacktrace")
        .otherwise("prose")
    )


def language(source: Column) -> Column:
    """Language of a source by its extension; null if unknown."""
    return F.try_element_at(_constants(LANGUAGES), _extension(source))


def _extension(source: Column) -> Column:
    return F.regexp_extract(F.lower(source), r"(\.[a-z]+)$", 1)


def _constants(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def calibrated_tokens(text: Column, source: Column) -> Column:
    """Token estimate by the language's characters a token: 1 at least, 0 for null or empty texts. The extension is looked up once."""
    rates = {end: CHARS_PER_TOKEN[name] for end, name in LANGUAGES.items() if name in CHARS_PER_TOKEN}
    rate = F.coalesce(F.try_element_at(_constants(rates), _extension(source)), F.lit(OTHER_CHARS_PER_TOKEN))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / rate))).cast("long")


def character_shares(text: Column) -> Column:
    """Shares of upper, lower, digit, sep, prog and ws characters (they may overlap) and other, 0 at least; zeros for null or empty texts."""
    size = F.length(text)
    # whole runs go at once; marks are looked for among what isn't a letter, digit or space, as their long classes are slow to match
    marks = F.regexp_replace(text, r"[A-Za-z0-9\s\p{L}]+", "")
    share = lambda kept, among=text: F.when(size > 0, F.length(F.regexp_replace(among, kept, "")) / size).otherwise(0.0)
    found = {"upper": share(r"\P{Lu}+"), "lower": share(r"\P{Ll}+"), "digit": share(r"\P{Nd}+")}
    found |= {"sep": share(f"[^{re.escape(SEPARATORS)}]+", marks), "prog": share(f"[^{re.escape(PROGRESS)}]+", marks), "ws": share(r"(?U)\S+")}
    total = F.lit(0.0)
    for value in found.values():
        total = total + value
    other = F.when(size > 0, F.greatest(F.lit(0.0), 1.0 - total)).otherwise(0.0)
    return F.struct(*(v.alias(k) for k, v in found.items()), other.alias("other"))


def quantized(vector: Column) -> Column:
    """A vector of floats from -1 to 1 as whole numbers from 0 to 65535, in float arithmetic; values beyond are clamped."""
    one, half, top = (F.lit(x).cast("float") for x in (1.0, 0.5, 65535.0))
    return F.transform(vector, lambda v: F.least(F.greatest(F.round((v + one) * half * top), F.lit(0.0).cast("float")), top).cast("int"))


def naming_issue(path: Column) -> Column:
    """PascalCase or camelCase for Python and Rust files that aren't in snake case, non-PascalCase for components that should be; else null. Stems of under 3 bytes are left out."""
    name = F.element_at(F.split(path, "/"), -1)
    pieces = F.split(name, r"\.")
    stem = F.when(F.size(pieces) > 1, F.try_element_at(pieces, F.lit(-2))).otherwise(name)
    snake = path.rlike(r"\.(py|rs)$")
    script = path.rlike(r"\.(js|ts|jsx|tsx)$")
    first = stem.rlike(r"^\p{Lu}")
    return F.when(F.octet_length(stem) < 3, None).when(snake & stem.rlike(r"\p{Lu}"), F.when(first, "PascalCase").otherwise("camelCase")).when(script & path.contains("/components/") & ~first, "non-PascalCase")


def health_score(n: Column, symbols: Column, clones: Column, dead: Column, gods: Column, layers: Column, names: Column) -> Column:
    """(score, grade, and the five penalties) of a code base from its counts."""
    capped = lambda c, whole: F.least(F.lit(1.0), c / whole)
    pairs = n * F.greatest(n - 1, F.lit(0)) / 2
    files = F.greatest(n, F.lit(1))
    dup = F.when(pairs == 0, 0.0).otherwise(capped(clones, pairs * 0.05))
    gone = capped(dead, F.greatest(symbols, F.lit(1)) * 2.0)
    coupling, arch, naming = (capped(c, F.greatest(files * share, F.lit(1.0))) for c, share in ((gods, 0.05), (layers, 0.1), (names, 0.2)))
    weighted = 0.30 * coupling + 0.30 * dup + 0.20 * gone + 0.15 * arch + 0.05 * naming
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1.0 - weighted)))
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    parts = {"p_dup": dup, "p_dead": gone, "p_coupling": coupling, "p_arch": arch, "p_naming": naming}
    return F.struct(F.round(score, 1).alias("score"), grade.alias("grade"), *(F.round(v, 2).alias(k) for k, v in parts.items()))


def resolution(kind: Column, utilization: Column, old: Column) -> Column:
    """How far a block is cut at a share of the window in use: Verbatim, Skeleton, Digest or Fingerprint."""
    u = utilization
    result = F.when((u >= 0.90) & old, "Fingerprint").when(u >= 0.70, "Skeleton")
    thinking = F.when(u >= 0.80, "Digest")
    call = F.when((u >= 0.85) & old, "Digest").when(u >= 0.75, "Skeleton")
    said = F.when((u >= 0.95) & old, "Skeleton")
    found = F.when(u < 0.70, None).when(kind == "ToolResult", result).when(kind == "ThinkingBlock", thinking).when(kind == "ToolCall", call).when(kind == "AssistantMessage", said)
    return F.coalesce(found, F.lit("Verbatim"))


def transition(before: Column, now: Column, elapsed: Column, window: float, rephrase: float, change: float | None = None) -> Column:
    """(status, similarity, hamming) between two 64-bit fingerprints that are elapsed seconds apart."""
    distance = F.bit_count(before.bitwiseXOR(now))
    alike = 1.0 - distance / 64.0
    out = (elapsed < 0) | (elapsed > window)
    other = F.lit("topic_change") if change is None else F.when(alike < change, "topic_change").otherwise("ambiguous")
    status = F.when(elapsed < 0, "invalid_time").when(elapsed > window, "expired").when(alike > rephrase, "rephrase").otherwise(other)
    return F.struct(status.alias("status"), F.when(out, 0.0).otherwise(alike).alias("similarity"), F.when(out, 64).otherwise(distance).alias("hamming"))


def log_template(line: Column) -> Column:
    """A log line without its time and with its variable numbers masked, unless a number in it matters."""
    bare = F.regexp_replace(line, "(?U)" + LOG_STAMP, "")
    return F.when(bare.rlike("(?U)" + LOG_KEPT), bare).otherwise(F.regexp_replace(bare, "(?U)" + LOG_VARIABLE, "*"))


def compression(source: Column, selected: Column, eligible: Column) -> Column:
    """Withheld and saved tokens, ratios both ways and shares in per cent; saved and reduction are 0 unless eligible. No source: ratios 1, no saving."""
    empty = source == 0
    ratio = selected / source
    withheld = F.greatest(source - selected, F.lit(0))
    per_cent = F.round((1.0 - ratio) * 100.0, 3)
    return F.struct(
        F.when(empty, 0).otherwise(withheld).cast("long").alias("tokens_withheld"),
        F.when(~empty & eligible, withheld).otherwise(0).cast("long").alias("tokens_saved"),
        F.when(empty, 1.0).otherwise(F.round(ratio, 6)).alias("selected_to_source_ratio"),
        F.when(empty, 1.0).when(selected > 0, F.round(source / selected, 6)).otherwise(0.0).alias("source_to_selected_ratio"),
        F.when(~empty & eligible, per_cent).otherwise(0.0).alias("reduction_pct"),
        F.when(empty, 0.0).otherwise(per_cent).alias("withheld_pct"),
    )


# Words that decide a change's purpose, in the order in which they are tried.
CHANGES = (("bugfix", ("fix", "bug", "patch")), ("security", ("security", "cve")), ("test", ("test", "spec")), ("refactor", ("refactor", "clean")), ("performance", ("perf", "optim")), ("docs", ("doc", "readme")))


def change_set(diff: Column, message: Column) -> Column:
    """Files changed and deleted, lines added and removed, functions of hunk headers and purpose of a unified diff; null counts as empty.

    The purpose is taken from the message and the diff's first 2000 characters. Old files count as
    deleted if any new one is the null device.
    """
    text = F.coalesce(diff, F.lit(""))
    lines = F.split(text, r"\r?\n")
    begins = lambda s: F.filter(lines, lambda x: x.startswith(s))
    rest = lambda s: F.transform(begins(s), lambda x: F.substr(x, F.lit(len(s) + 1)))
    count = lambda c: F.size(F.filter(lines, lambda x: x.startswith(c) & ~x.startswith(c * 3)))
    named = lambda x, word: F.regexp_extract(x, word + r" ([\p{IsAlphabetic}\pN_]*)", 1)
    names = F.transform(begins("@@"), lambda x: F.when(x.contains("fn "), named(x, "fn")).when(x.contains("def "), named(x, "def")).when(x.contains("function "), named(x, "function")).otherwise(""))
    head = F.lower(F.concat(F.coalesce(message, F.lit("")), F.lit(" "), F.substring(text, 1, 2000)))
    purpose = F.when(F.lit(False), "")
    for name, words in CHANGES:
        purpose = purpose.when(_has_any(head, words), name)
    deleted = F.when(text.contains("+++ /dev/null"), rest("--- a/")).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.array_distinct(rest("+++ b/")).alias("files_modified"), deleted.alias("files_deleted"), count("+").alias("lines_added"), count("-").alias("lines_removed"),
        F.array_distinct(F.filter(names, lambda n: n != "")).alias("functions_changed"), purpose.otherwise("feature").alias("intent"),
    )
