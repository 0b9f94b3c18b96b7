"""Once-only sinks, an outbox of events, usage payloads and archives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPENAI, _ANTHROPIC, _GOOGLE = ("openai", "azure_openai", "azure"), ("anthropic", "claude"), ("google", "gemini", "vertex")
#: Categories of usage_tokens.
CATEGORIES = ("uncached_input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")


def conflicts(stored: DataFrame, incoming: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Keys of incoming that are stored, or come twice, with another identity; nulls compare equal. A sink writes only if there is none.

    Both sides are reduced to the different identities of a key before they meet.
    """
    row = F.struct(*identity)
    both = stored.select(key, row.alias("_i")).unionByName(incoming.select(key, row.alias("_i")))
    return both.groupBy(key).agg(F.max("_i").alias("_a"), F.min("_i").alias("_b")).filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def adjustments_once(stored: DataFrame, incoming: DataFrame, events: DataFrame, key: str, event: str, order: str) -> DataFrame:
    """stored and the first row by order of each new key of incoming whose event exists."""
    from siltstone.operators.ledger import insert_once

    return insert_once(stored, incoming.join(events.select(event), event, "left_semi").select(*incoming.columns), key, order)


def event_id(schema: str, channel: Column, destination: Column, key: Column) -> Column:
    """The outbox's id of an event: the same for the same channel, destination and key; null if one of them is."""
    return F.sha2(F.concat(F.lit(schema), *(x for part in (channel, destination, key) for x in (F.lit("\0"), part))), 256)


def claim(events: DataFrame, channel: str, destination: str, now: float, limit: int = 32, lease: float = 30.0) -> DataFrame:
    """events with claimed and a new lease_until for the first limit rows (by created_at, event_id) that are pending, due and not leased. Write the result back before the next claim.

    1 to 1000 rows are claimed, so they are broadcast. Event ids are unique.
    """
    due = (F.col("channel") == channel) & (F.col("destination") == destination) & (F.col("state") == "pending") & (F.col("not_before") <= now)
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    first = events.filter(due & free).orderBy("created_at", "event_id").limit(max(1, min(limit, 1000))).select("event_id", F.lit(True).alias("claimed"))
    joined = events.join(F.broadcast(first), "event_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return joined.withColumn("lease_until", F.when(F.col("claimed"), F.lit(now + max(1.0, lease))).otherwise(F.col("lease_until").cast("double")))


def _whole(raw: Column, *names: str) -> Column:
    found = F.coalesce(*(F.get_json_object(raw, f"$.{n}") for n in names))
    return F.greatest(F.lit(0), F.coalesce(found.try_cast("double").cast("long"), F.lit(0)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def usage_tokens(provider: Column, payload: Column) -> Column:
    """CATEGORIES of a usage payload in JSON of three vendors' shapes; zeros for missing or odd counts, null for other providers."""
    nested = F.filter(F.array(*(F.get_json_object(payload, f"$.{k}") for k in ("usage", "usage_metadata", "usageMetadata"))), lambda u: u.startswith("{"))
    raw = F.coalesce(F.get(nested, F.lit(0)), payload)
    who = F.lower(F.trim(provider))

    def cached(raw: Column, total: tuple, read: tuple, output: tuple) -> Column:
        counts = F.struct(_whole(raw, *total).alias("total"), _whole(raw, *read).alias("read"), _whole(raw, *output).alias("output"))
        return _bound(counts, lambda n: F.struct(F.greatest(F.lit(0), n["total"] - n["read"]).alias(CATEGORIES[0]), F.least(n["read"], n["total"]).alias(CATEGORIES[1]), F.lit(0).cast("long").alias(CATEGORIES[2]), n["output"].alias(CATEGORIES[3])))

    names = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")

    def parsed(raw: Column) -> Column:
        first = cached(raw, ("input_tokens", "prompt_tokens"), ("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"), ("output_tokens", "completion_tokens"))
        second = F.struct(*(_whole(raw, n).alias(c) for n, c in zip(names, CATEGORIES)))
        third = cached(raw, ("promptTokenCount", "prompt_token_count"), ("cachedContentTokenCount", "cached_content_token_count"), ("candidatesTokenCount", "candidates_token_count"))
        return F.when(who.isin(*_OPENAI), first).when(who.isin(*_ANTHROPIC), second).when(who.isin(*_GOOGLE), third)

    return _bound(raw, parsed)


def stream_usage(transcripts: DataFrame, key: str, provider: str, text: str) -> DataFrame:
    """(key, CATEGORIES): the largest count of each category over a transcript's data lines; transcripts without usage are left out."""
    lines = transcripts.select(key, F.col(provider).alias("_p"), F.explode(F.split(text, r"\R|[\x1c-\x1e]")).alias("_line"))
    frame = lines.withColumn("_e", F.regexp_extract("_line", r"(?U)^\s*data:\s*(\{.*)$", 1)).filter("_e <> ''")
    # a broken line is parsed once and not at each place, as each time costs an exception
    frame = frame.filter(F.get_json_object("_e", "$").isNotNull())
    places = ("usage", "usage_metadata", "usageMetadata", "message.usage", "response.usage")
    found = frame.select(key, "_p", F.explode(F.array(*(F.get_json_object("_e", f"$.{p}") for p in places))).alias("_u")).filter(F.col("_u").startswith("{"))
    parsed = found.select(key, usage_tokens(F.col("_p"), F.col("_u")).alias("_t"))
    return parsed.groupBy(key).agg(*(F.max(f"_t.{c}").alias(c) for c in CATEGORIES))


def archived(events: DataFrame, day: str, counted: Column, sums: dict[str, Column], cutoff: str) -> DataFrame:
    """One row: sums (0 at least each) and number of the counted events before cutoff, to be added to the archive, and the sums of those that stay, as kept_ columns."""
    old, new = counted & (F.col(day) < cutoff), counted & (F.col(day) >= cutoff)
    total = lambda which, v: F.coalesce(F.sum(F.when(which, F.greatest(v, F.lit(0)))), F.lit(0)).cast("long")
    return events.agg(*(total(old, v).alias(k) for k, v in sums.items()), F.count_if(old).alias("contribution_events"), *(total(new, v).alias(f"kept_{k}") for k, v in sums.items()))


def reconciled(stored: DataFrame, live: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, change): add, update or remove for paths that differ between a stored and a live listing; digests compare null-safely. Paths are unique."""
    a = stored.select(path, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = live.select(path, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "add").when(F.col("_in_b").isNull(), "remove").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return a.join(b, path, "full_outer").select(path, change.alias("change")).filter("change IS NOT NULL")


def redactions(versions: DataFrame, selected: Column, redacted: Column, body: str) -> DataFrame:
    """(body, deleted): the different bodies of selected versions, and whether no version that stays (neither selected nor redacted before) shares them."""
    chosen, was = F.coalesce(selected, F.lit(False)), F.coalesce(redacted, F.lit(False))
    marks = versions.groupBy(body).agg(F.max(chosen).alias("_chosen"), F.max(~chosen & ~was).alias("_kept"))
    return marks.filter("_chosen").select(body, (~F.col("_kept")).alias("deleted"))
