"""Column functions that shorten and clean texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credentials in texts; the first group, if there is one, stays.
SECRETS = (
    r"(?i)https://hooks\.slack\.com/services/[^\s]+",
    r"(?i)https://(?:canary\.|ptb\.)?discord(?:app)?\.com/api/webhooks/[^\s]+",
    r"\b\d{6,12}:[A-Za-z0-9_-]{20,}\b",
    r"(?i)\b(?:sk|rk|pk)-[A-Za-z0-9_-]{12,}\b",
    r"(?i)(authorization\s*[:=]\s*(?:bearer\s+)?)[^\s,;]+",
)

# Escape sequences of terminals, and characters that are dropped or replaced after them.
ESCAPES = r"\x1B\[[0-9;]*[A-Za-z]|\x1B\][^\x07]*\x07|\x1B[()][AB012]|\x1B[>=<]"
PLAIN = (("\r", ""), ("\u00a0", " "), ("\u200b", ""), ("\u2028", "\n"), ("\u2029", "\n"))

# Words that make a decoded payload an instruction.
ORDERS = ("ignore", "instruction", "system", "forget", "disregard", "override", "you are", "new role", "bypass")


def without_escapes(text: Column) -> Column:
    """Text without terminal escapes, CR and zero-width spaces; other odd white space becomes plain. Null stays null."""
    out = F.regexp_replace(text, ESCAPES, "")
    for odd, plain in PLAIN:
        out = F.replace(out, F.lit(odd), F.lit(plain))
    return out


def encoded_orders(text: Column, least: int = 40) -> Column:
    """Runs of least or more base64 characters whose UTF-8 text holds an instruction, in order; none for null.

    Runs that lack padding, or whose bytes aren't UTF-8, are no payloads.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[A-Za-z0-9+/]{{{least},}}={{0,2}}"), F.lit(0))

    def orders(run: Column) -> Column:
        body = F.rtrim(run, F.lit("="))
        over, pads = F.length(body) % 4, F.length(run) - F.length(body)
        whole = F.when(over == 0, body).when((over == 2) & (pads == 2), run).when((over == 3) & (pads >= 1), F.concat(body, F.lit("=")))
        decoded = F.lower(F.try_validate_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string")))
        return F.coalesce(decoded.rlike("|".join(ORDERS)), F.lit(False))

    return F.filter(runs, orders)


def redacted(text: Column) -> Column:
    """Text without NUL, CR and common credentials."""
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit("")), F.lit("\r"), F.lit(""))
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, ("$1" if "(authorization" in pattern else "") + "[REDACTED]")
    return out


def wiki_links(text: Column) -> Column:
    """Different names between double brackets, trimmed, in order; blank ones are left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def shortened_csv(text: Column, sample: int = 5) -> Column:
    """The header, the first rows and how many more rows and columns there are; short texts stay as they are."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")
    more = F.concat(F.lit("[... "), (F.size(lines) - sample - 1).cast("string"), F.lit(" more rows, "), F.size(F.split(lines[0], ",")).cast("string"), F.lit(" columns]"))
    return F.when(F.size(lines) <= sample + 1, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, sample + 1), "\n"), F.lit("\n"), more))


def common_prefix(a: Column, b: Column, block: int) -> Column:
    """Characters of the blocks that two texts have in common from the start on; only the last block of the shorter may be cut."""
    least = F.least(F.char_length(a), F.char_length(b))
    n = F.ceil(least / block).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    part = lambda t, i: F.substring(t, i * block + 1, F.lit(block))
    apart = F.filter(places, lambda i: part(a, i) != part(b, i))
    return F.when(F.size(apart) > 0, apart[0] * block).otherwise(least).cast("long")


def no_longer(out: Column, text: Column) -> Column:
    """out, or text where out is longer."""
    return F.when(F.char_length(out) > F.char_length(text), text).otherwise(out)
