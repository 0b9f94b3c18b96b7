"""Column functions for predicates, weights, budgets and likeness."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential markers, names of secrets in assignments, and what starts a line that isn't code.
CREDENTIALS = ("-----begin private key-----", "-----begin rsa private key-----", "aws_secret_access_key")
SECRET_NAMES = ("secret_key", "api_key", "private_key")
NOT_CODE = r"^\s*(#|//|/\*|\*|-|\"\"\"|''')"

# Words that make a line evidence.
ANCHORS = (
    "timeout", "panic", "exception", "traceback", "warning", "denied", "refused", "invalid", "unexpected",
    "unresolved", "exit code", "assertion", "segfault", "not found", "no such",
)


def _any_of(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def has_safety_signal(text: Column) -> Column:
    """Whether a text holds a credential marker or, in a line of code, a secret's name and an equals sign. Null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _any_of(low, CREDENTIALS) | F.exists(F.split(low, "\n"), lambda x: ~x.rlike(NOT_CODE) & F.contains(x, F.lit("=")) & _any_of(x, SECRET_NAMES))


def anchor_lines(text: Column) -> Column:
    """How many lines hold an evidence word; 0 for null."""
    return F.size(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: _any_of(x, ANCHORS))).cast("long")


def block_kind(role: Column, text: Column, tool: Column | None = None) -> Column:
    """Kind of a conversation's block from its role, its first tag and its tool."""
    thinking = F.coalesce(text.rlike(r"^\s*<(thinking|reasoning)>"), F.lit(False))
    called = F.lit(False) if tool is None else tool.isNotNull()
    said = F.when(thinking, "ThinkingBlock").when(called, "ToolCall").otherwise("AssistantMessage")
    return F.when(role == "system", "SystemMessage").when(role == "user", "UserMessage").when(role == "assistant", said).when(role.isin("tool", "function"), "ToolResult").otherwise("AssistantMessage")


def attention_weight(position: Column, total: Column) -> Column:
    """U-shaped weight of a position from 0: high at both ends; 1 where there is one place only."""
    scale = F.greatest(0.15 * total, F.lit(1.0))
    return F.when(total <= 1, F.lit(1.0)).otherwise(0.4 * F.exp(-position / scale) + 0.4 * F.exp(-(total - position - 1) / scale) + 0.2)


def mass_factor(tokens: Column) -> Column:
    """0.3 to 1, growing with the logarithm of the tokens; 0.65 at 80."""
    return 0.3 + 0.7 / (1 + F.exp(-F.log(tokens / 80)))


def split_budget(total: Column, files: Column, entropy: Column) -> tuple[Column, Column, Column]:
    """Token budgets of the map, the skeletons and the full texts; zeros without a budget or files."""
    usable = (total > 0) & (files > 0)
    first = F.least(F.greatest(total * 0.05, F.lit(50.0)), F.lit(500.0)).cast("long")
    rest = F.greatest(total - first, F.lit(0))
    share = F.when(entropy > 0.7, 0.20).when(entropy < 0.3, 0.35).otherwise(0.25)
    second = (rest * share).cast("long")
    return tuple(F.when(usable, c).otherwise(F.lit(0)).cast("long") for c in (first, second, rest - second))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_cosine(distance: Column) -> Column:
    """Cosine that a Hamming distance of 64-bit SimHashes estimates; 0 at the least."""
    return F.greatest(F.cos(distance * (math.pi / 64)), F.lit(0.0))


def ngrams(text: Column, n: int) -> Column:
    """All runs of n words between white space; none in shorter or null texts."""
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    count = F.greatest(F.size(w) - (n - 1), F.lit(0))
    # shifted copies are zipped: a lambda that uses w would split the text again for each word
    out = F.slice(w, 1, count)
    for shift in range(1, n):
        out = F.zip_with(out, F.slice(w, 1 + shift, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def hashed(values: Column) -> Column:
    """64-bit hashes of an array's strings. Spark compares arrays of integers by a hash set, but those of strings pair by pair, which is too slow for long texts."""
    return F.transform(values, lambda x: F.xxhash64(x))


# Words of risky and less risky requests.
HIGH_RISK = ("security", "vulnerability", "pii", "compliance", "audit", "gdpr", "hipaa", "credential", "secret", "encrypt", "auth")
MEDIUM_RISK = ("deploy", "migration", "database", "schema", "release", "production", "breaking", "api change")

# Classes of learning queries in order of precedence, and their words.
LEARNING_CLASSES = (
    ("Debugging", ("fix", "bug", "error", "crash", "issue", "debug", "broken", "fail", "wrong", "exception")),
    ("Feature", ("add", "implement", "create", "build", "feature", "new", "support", "integrate", "enable")),
    ("Refactoring", ("refactor", "clean", "reorganize", "simplify", "extract", "rename", "move", "split", "merge")),
    ("Performance", ("optimize", "performance", "slow", "fast", "speed", "cache", "memory", "leak", "bottleneck")),
    ("Testing", ("test", "spec", "assert", "expect", "mock", "stub", "coverage", "unit", "integration", "e2e")),
    ("Documentation", ("document", "readme", "comment", "explain", "describe", "usage", "api")),
)

# Characters that hide or turn text.
DANGEROUS_CHARACTERS = (
    0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x034F, 0x061C, 0x180E,
)

# Generic verbs and signals of specificity.
GENERIC_VERBS = (
    "fix", "debug", "add", "help", "check", "look", "find", "show", "get", "make", "do", "run", "try", "use", "change", "update", "improve", "understand", "explain", "review",
    "refactor", "write", "work", "broken", "issue", "problem", "error", "wrong",
)
SPECIFIC_WORDS = (
    "cwe", "sql", "injection", "xss", "token", "auth", "oauth", "jwt", "endpoint", "api", "schema", "migration", "trait", "impl", "struct", "async", "await", "cache", "redis", "postgres",
    "kafka", "docker", "hypothesis", "bisect", "panic", "unwrap", "lifetime", "borrow", "memory", "unsafe", "overflow", "deadlock", "race", "lock", "mutex", "latency", "throughput",
    "benchmark", "profil", "optim",
)


def risk_level(query: Column) -> Column:
    """High, Medium or Low by the words that a query holds."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return F.when(_any_of(low, HIGH_RISK), "High").when(_any_of(low, MEDIUM_RISK), "Medium").otherwise("Low")


def learning_class(query: Column) -> Column:
    """The first class of which a word is one of the query's; General if none is."""
    words = F.split(F.lower(F.coalesce(query, F.lit(""))), r"[^\p{L}\p{N}_]+")
    out = None
    for name, known in LEARNING_CLASSES:
        hit = F.arrays_overlap(words, F.array(*map(F.lit, known)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("General")


def dangerous_characters(text: Column) -> Column:
    """The code points, sorted, of the characters in a text that hide or turn it."""
    found = [F.when(F.contains(text, F.lit(chr(c))), F.lit(c)) for c in sorted(DANGEROUS_CHARACTERS)]
    return F.array_compact(F.array(*found))


def vagueness(terms: Column, query: Column) -> Column:
    """0 (specific) to 1 (vague) of a query with these terms: generic verbs and shortness against technical words and identifiers; 1 without terms."""
    n = F.size(terms)
    generic = F.size(F.filter(terms, lambda t: _any_of(t, GENERIC_VERBS))) / n
    short = F.when(n < 3, 0.7).when(n < 5, 0.4).when(n < 7, 0.15).otherwise(0.0)
    specific = F.size(F.filter(terms, lambda t: _any_of(t, SPECIFIC_WORDS)))
    named = F.exists(F.split(query, r"\s+"), lambda w: (F.octet_length(w) > 4) & w.rlike(r"\p{Lu}") & w.rlike(r"[^\p{Lu}]"))
    bonus = F.least(F.lit(0.4), specific * 0.15 + F.when(named, 0.2).otherwise(0.0))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), generic * 0.5 + short * 0.3 - bonus * 0.7))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(raw, 3))


def dense_token_estimate(text: Column) -> Column:
    """Bytes by 5 where over 0.4 of them are characters that aren't letters, by 4 elsewhere; 1 at least."""
    size = F.octet_length(text)
    other = F.char_length(F.regexp_replace(text, r"\p{L}", "")) / F.greatest(size, F.lit(1))
    return F.greatest(size / F.when(other > 0.4, 5.0).otherwise(4.0), F.lit(1.0)).cast("long")


def word_token_estimate(text: Column) -> Column:
    """Words that start with an ASCII letter or digit, hyphens parting them; 1 at least."""
    return F.greatest(F.regexp_count(F.replace(text, F.lit("-"), F.lit(" ")), F.lit("[A-Za-z0-9][A-Za-z0-9_']*")), F.lit(1)).cast("long")


def cosine_lower_bound(distance: Column, comparisons: Column, alpha: float) -> Column:
    """A cosine that the SimHashes' texts have at least, at level alpha over so many comparisons."""
    p = distance / 64.0
    q = F.greatest(F.lit(1e-12), F.least(F.lit(0.5), F.lit(min(max(alpha, 1e-9), 0.5)) / F.greatest(comparisons, F.lit(1))))
    t = F.sqrt(-2.0 * F.log(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    high = F.least(p + z * F.sqrt(p * (1.0 - p) / 64.0), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.cos(high * math.pi)))


def uniqueness(fingerprint: Column, others: Column) -> Column:
    """1 less the greatest share of equal bits with other fingerprints; 0.5 for an empty text (0), 0.7 without others. Empty texts aren't compared with."""
    real = F.filter(others, lambda x: x != 0)
    most = F.aggregate(real, F.lit(0.0), lambda a, x: F.greatest(a, 1 - hamming(fingerprint, x) / 64.0))
    return F.when(fingerprint == 0, 0.5).when(F.size(real) == 0, 0.7).otherwise(1 - most)


def softcap(x: Column, cap: float = 0.85) -> Column:
    """x for small values, levelling off towards cap."""
    return cap * F.tanh(x / cap)


def blended_relevance(parts: list[tuple[Column, float]], feedback: Column) -> Column:
    """Weighted mean of scores times feedback, levelling off; 0 without weights."""
    total = sum(w for _, w in parts)
    return softcap(sum((c * w for c, w in parts), F.lit(0.0)) / total * feedback) if total else F.lit(0.0)


def ordering_priority(relevance: Column, criticality: Column, pinned: Column, dependencies: Column) -> Column:
    """Relevance with 100 for pinned rows, 50, 30 or 10 for Safety, Critical or Important ones and up to 20 for dependencies."""
    level = F.when(criticality == "Safety", 50.0).when(criticality == "Critical", 30.0).when(criticality == "Important", 10.0).otherwise(0.0)
    return relevance + F.when(pinned, 100.0).otherwise(0.0) + level + F.least(dependencies.cast("double"), F.lit(20.0))


def half_life_decay(age: Column, half_life: Column) -> Column:
    """1 at age 0 or less, a half after each half-life (1 at least)."""
    return F.exp(-math.log(2.0) / F.greatest(half_life, F.lit(1)) * F.greatest(age, F.lit(0)))


def decayed_risk(risk: Column, elapsed: Column, half_life: float) -> Column:
    """A risk after some turns, between 0 and 1; as it was if no turns passed."""
    return F.when(elapsed > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk * F.pow(F.lit(0.5), elapsed / half_life)))).otherwise(risk)


def micro_cost(tokens: Column, per_million: Column) -> Column:
    """Cost in millionths of a dollar at a rate for a million tokens, a half rounded up."""
    return F.round(tokens.cast("decimal(18,0)") * per_million.cast("decimal(12,6)"), 0).cast("long")


def retry_delay(event_id: Column, attempt: Column, base: float, most: float) -> Column:
    """Seconds to wait before an attempt: doubling from base up to most, times 0.85 to 1.15 by a hash of the event and the attempt."""
    power = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(20))
    seed = F.conv(F.substring(F.sha2(F.concat_ws(":", event_id.cast("string"), attempt.cast("string")), 256), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), power)) * (0.85 + 0.30 * seed)


def capture_estimate(selected: Column, first: Column, second: Column, both: Column) -> tuple[Column, Column, Column, Column]:
    """(coverage, gap, confidence, risk) of a selection by how many candidates two searches found, and both of them."""
    a, b, m = F.greatest(first, F.lit(1)).cast("double"), F.greatest(second, F.lit(1)).cast("double"), both.cast("double")
    total = F.when(m > 0, (a + 1) * (b + 1) / (m + 1) - 1).otherwise(a + b)
    spread = F.sqrt((a + 1) * (b + 1) * F.greatest(a - m, F.lit(0.0)) * F.greatest(b - m, F.lit(0.0)) / (F.pow(m + 1, F.lit(2)) * (m + 2)))
    none = selected == 0
    coverage = F.when(none, 0.0).otherwise(F.least(F.lit(1.0), selected / total))
    confidence = F.when(none, 0.0).when(m > 0, 1 / (1 + spread)).otherwise(0.2)
    gap = F.when(none, 0.0).otherwise(F.greatest(total - selected, F.lit(0.0)))
    sure = coverage * confidence
    return coverage, gap, confidence, F.when(none, "unknown").when(sure >= 0.75, "low").when(sure >= 0.45, "medium").otherwise("high")


def mcnemar(left_only: Column, right_only: Column) -> Column:
    """Two-sided exact p-value of the pairs that only one of two sides won; 1 without any."""
    n = left_only + right_only
    # each binomial coefficient from the one before, as logarithms
    step = lambda a, k: F.struct((a["c"] + F.when(k == 0, 0.0).otherwise(F.log((n - k + 1).cast("double")) - F.log(F.greatest(k, F.lit(1)).cast("double")))).alias("c"), a["s"].alias("s"))
    add = lambda a: F.struct(a["c"].alias("c"), (a["s"] + F.exp(a["c"] - n * math.log(2.0))).alias("s"))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(left_only, right_only).cast("long")), start, lambda a, k: add(step(a, k)), lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))
