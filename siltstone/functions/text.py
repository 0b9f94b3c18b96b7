"""Column functions over texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases of the prompt-injection detector.
INJECTION_PHRASES = (
    "ignore previous instructions",
    "ignore all previous",
    "system prompt:",
    "you are now",
    "jailbreak",
    "disregard the above",
    "forget your instructions",
)

# Task types in order of precedence, their keywords and budget multipliers.
TASK_TYPES = (
    ("BugTracing", ("bug", "error", "fail", "crash", "fix", "debug", "trace", "broken"), 1.5),
    ("Refactoring", ("refactor", "rename", "move", "extract", "restructure"), 1.0),
    ("Testing", ("test", "spec", "assert"), 0.8),
    ("CodeReview", ("review", "audit", "check"), 1.0),
    ("CodeGeneration", ("create", "implement", "build", "add", "write", "generate"), 0.7),
    ("Documentation", ("doc", "readme", "comment"), 0.6),
    ("Exploration", ("explore", "understand", "what", "how", "why"), 1.3),
)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(text) / 4))


def preview(text: Column, width: int = 240) -> Column:
    """White space collapsed; longer texts are cut so that they have width characters with the three dots at their end."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def pii_types(text: Column) -> Column:
    """Kinds of personal data that a text seems to hold: Email, APIKey, SSN."""
    email = F.contains(text, F.lit("@")) & F.contains(text, F.lit("."))
    key = F.regexp_extract(text, r"(?s)^.*?(sk-[\p{L}\p{N}-]*)", 1)
    # that pattern is over bytes, and four of them follow its last digit
    octets = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    # a first match of 21 or more characters counts, a later one doesn't
    return F.array_compact(F.array(F.when(email, F.lit("Email")), F.when(F.char_length(key) > 20, F.lit("APIKey")), F.when(octets.rlike(r"(?s)[0-9]..-[0-9].-[0-9]...."), F.lit("SSN"))))


def has_injection(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for phrase in INJECTION_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return out


def task_type(query: Column) -> Column:
    """The first task type of which a keyword occurs in the query; Unknown if none does."""
    low = F.lower(query)
    out = F.lit("Unknown")
    for name, keywords, _ in reversed(TASK_TYPES):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def budget_multiplier(task: Column) -> Column:
    out = F.lit(1.0)
    for name, _, factor in TASK_TYPES:
        out = F.when(task == name, F.lit(factor)).otherwise(out)
    return out


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores with two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.char_length(w) >= 2)


def term_jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays' distinct elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


@F.arrow_udf(T.StructType([T.StructField("shannon", T.DoubleType()), T.StructField("renyi2", T.DoubleType())]))
def byte_entropies(texts: pa.Array) -> pa.Array:
    """Shannon and order-2 entropies of the UTF-8 bytes in bits; 0 for empty and null texts. An array of 256 counts for each text, whose bytes are counted where they lie."""
    found = np.zeros((2, len(texts)))
    for i, text in enumerate(texts):
        data = np.frombuffer(text.as_buffer() or b"", np.uint8)
        if len(data):
            p = np.bincount(data, minlength=256) / len(data)
            p = p[p > 0]
            found[:, i] = -(p * np.log2(p)).sum(), -np.log2((p * p).sum())
    return pa.StructArray.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["shannon", "renyi2"])


def retention(age: Column, half_life: float) -> Column:
    """Ebbinghaus decay: a half after each half-life."""
    return F.exp(F.lit(-np.log(2.0)) / half_life * age)


def wilson_lower(successes: Column, total: Column, z: float = 1.96) -> Column:
    p = successes / total
    centre = p + z * z / (2 * total)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    return (centre - spread) / (1 + z * z / total)


def wilson_upper(successes: Column, total: Column, z: float = 1.96) -> Column:
    p = successes / total
    centre = p + z * z / (2 * total)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    return (centre + spread) / (1 + z * z / total)


def learned_value(successes: Column, total: Column) -> Column:
    """The Wilson lower bound mapped to 0.5 to 2; 1 without observations."""
    return F.when(total > 0, 0.5 + 1.5 * wilson_lower(successes, total)).otherwise(F.lit(1.0))
