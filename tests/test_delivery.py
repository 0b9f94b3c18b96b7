"""Sinks, classes, reports and graphs on small fixtures and against plain code."""

import random

import pytest

from pyspark.sql import functions as F

from siltstone.functions import routing
from siltstone.operators import blocks, delivery, graph, reports


def test_components_match_plain_union(spark):
    draw = random.Random(5)
    nodes = list(range(120))
    edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(90)] + [(5, 5), (None, 3), (7, 500)]
    edges += [(i, i + 1) for i in range(0, 40)]
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a in root and b in root:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame([(n,) for n in [*nodes, 3, None]], "node int"), spark.createDataFrame(edges, "src int, dst int")).collect()
    assert sorted((r.node, r.component) for r in got) == [(n, find(n)) for n in nodes]


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "node int"), spark.createDataFrame([], "src int, dst int")).collect() == []


def test_conflicts_need_another_identity(spark):
    stored = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "id string, n int, t string")
    incoming = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("d", 1, "x"), ("d", 2, "x"), ("c", 3, "y")], "id string, n int, t string")
    assert sorted(r.id for r in delivery.conflicts(stored, incoming, "id", ["n", "t"]).collect()) == ["b", "d"]


def test_adjustments_need_an_event(spark):
    events = spark.createDataFrame([("e1",)], "event string")
    stored = spark.createDataFrame([("a1", "e1", 5)], "id string, event string, n int")
    new = spark.createDataFrame([("a1", "e1", 9), ("a2", "e1", 7), ("a2", "e1", 6), ("a3", "gone", 1)], "id string, event string, n int")
    got = delivery.adjustments_once(stored, new, events, "id", "event", "n").collect()
    assert sorted(tuple(r) for r in got) == [("a1", "e1", 5), ("a2", "e1", 6)]


def test_a_claim_is_leased(spark):
    rows = [("x", "c", "d", "pending", 1.0, 0.0, None), ("y", "c", "d", "pending", 0.0, 0.0, 200.0), ("z", "c", "d", "delivered", 0.0, 0.0, None), ("v", "c", "d", "pending", 2.0, 101.0, None), ("w", "c", "d", "pending", 3.0, 0.0, 100.0), ("u", "c", "e", "pending", 0.0, 0.0, None)]
    events = spark.createDataFrame(rows, "event_id string, channel string, destination string, state string, created_at double, not_before double, lease_until double")
    first = delivery.claim(events, "c", "d", 100.0, limit=1)
    assert [(r.event_id, r.lease_until) for r in first.filter("claimed").collect()] == [("x", 130.0)]
    assert [r.event_id for r in delivery.claim(first.drop("claimed"), "c", "d", 101.0, lease=0.0).filter("claimed").orderBy("created_at").collect()] == ["v", "w"]
    assert delivery.claim(first.drop("claimed"), "none", "d", 101.0).filter("claimed").count() == 0


@pytest.mark.parametrize(
    "provider, payload, want",
    [
        ("openai", '{"usage": {"prompt_tokens": 100, "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 40}}}', (60, 40, 0, 7)),
        ("Azure ", '{"input_tokens": 10, "input_tokens_details": {"cached_tokens": 40}}', (0, 10, 0, 0)),
        ("anthropic", '{"usage": {"input_tokens": 5, "cache_read_input_tokens": 6, "cache_creation_input_tokens": 7, "output_tokens": "8"}}', (5, 6, 7, 8)),
        ("gemini", '{"usageMetadata": {"promptTokenCount": 9, "cachedContentTokenCount": -3, "candidatesTokenCount": 2}}', (9, 0, 0, 2)),
        ("openai", '{"usage": 3, "usage_metadata": {"input_tokens": 4}}', (4, 0, 0, 0)),
        ("openai", "no json", (0, 0, 0, 0)),
        ("elsewhere", "{}", None),
    ],
)
def test_usage_of_three_vendors(spark, provider, payload, want):
    got = spark.createDataFrame([(provider, payload)], "p string, j string").select(delivery.usage_tokens(F.col("p"), F.col("j")).alias("u")).first().u
    assert (got and tuple(got)) == want


def test_stream_usage_takes_the_largest_counts(spark):
    text = 'event: a\r\ndata: {"message": {"usage": {"input_tokens": 50, "output_tokens": 1}}}\n\n data:{"usage": {"output_tokens": 20}} data: [DONE]\ndata: {"usage": {"output_tokens": 4}}\ndata: {'
    rows = spark.createDataFrame([(1, "claude", text), (2, "claude", "data: {}\ndata: x"), (3, "claude", None)], "k int, p string, t string")
    assert [tuple(r) for r in delivery.stream_usage(rows, "k", "p", "t").collect()] == [(1, 50, 0, 0, 20)]


def test_archive_counts_once(spark):
    rows = spark.createDataFrame([("2024-01-01", 5, True), ("2024-01-01", -5, True), ("2024-01-01", 9, False), ("2024-03-01", 2, True), (None, 7, True)], "d string, v int, s boolean")
    got = delivery.archived(rows, "d", F.col("s"), {"v": F.col("v")}, "2024-02-01").first()
    assert got.asDict() == {"v": 5, "contribution_events": 2, "kept_v": 2}
    assert delivery.archived(rows.filter("false"), "d", F.col("s"), {"v": F.col("v")}, "x").first().asDict() == {"v": 0, "contribution_events": 0, "kept_v": 0}


def test_reconciled_and_redacted(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", None)], "path string, h string")
    b = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None), ("s", "1")], "path string, h string")
    assert sorted(tuple(r) for r in delivery.reconciled(a, b, "path", "h").collect()) == [("q", "update"), ("s", "add")]
    assert [tuple(r) for r in delivery.reconciled(a, b.filter("false"), "path", "h").filter("path = 'r'").collect()] == [("r", "remove")]
    versions = spark.createDataFrame([("x", True, False), ("x", False, False), ("y", True, False), ("y", False, True), ("z", False, None)], "body string, s boolean, was boolean")
    assert sorted(tuple(r) for r in delivery.redactions(versions, F.col("s"), F.col("was"), "body").collect()) == [("x", False), ("y", True)]


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_classes(spark):
    for text, want in ((None, "unknown"), ("", "unknown"), ("please run all\nthe test suite", "general"), ("Run the TEST suite", "test/run"), ("écheck", "general"), ("what is this", "explain"), ("fix the failing build error", "build/run"), ("debug this crash", "code/fix_bug")):
        assert _one(spark, text, routing.archetype) == want, text
    for text, want in ((None, "standard"), ("Explain the auth flow", "high"), ("EXPLAIN it", "low"), ("write it", "standard")):
        assert _one(spark, text, routing.risk_domain) == want
    for text, want in ((None, "General"), ("gdpr bug", "Audit"), ("a bug", "Repair"), ("walk", "General"), ("spreadsheet", "PrBrief"), ("onboard me", "Onboarding")):
        assert _one(spark, text, routing.intent) == want, text


def test_content_types(spark):
    cases = {
        " [1, 2, 3, 4, 5, 6, 7, 8]": "json", "<a>some long text here</a>": "xml", "text\n## heading\nmore text": "markdown", "x\n2024-01-02 something happened": "log", "short": "prose",
        "a,b,c,d\n" * 5: "csv", "a|b|c|d\n" * 3: "table", "hello there you\nSubject: greetings": "email", "it is hereby agreed by all": "legal", "Traceback (most recent call": "stacktrace", "plain words, nothing else at all": "prose",
    }
    for text, want in cases.items():
        assert _one(spark, text, routing.content_type) == want, text
    assert _one(spark, None, routing.content_type) == "prose"


def test_tokens_names_and_shares(spark):
    rows = spark.createDataFrame([("x" * 30, "a.PY"), ("x", "b.unknown"), ("", "a.py"), (None, "a.py"), ("x" * 33, None)], "t string, s string")
    assert [r.n for r in rows.select(routing.calibrated_tokens(F.col("t"), F.col("s")).alias("n")).collect()] == [10, 1, 0, 0, 10]
    for path, want in (("src/MyFile.py", "PascalCase"), ("myFile.rs", "camelCase"), ("my_file.py", None), ("a/components/button.tsx", "non-PascalCase"), ("a/components/Button.tsx", None), ("aB.py", None), (None, None)):
        assert _one(spark, path, routing.naming_issue) == want, path
    shares = _one(spark, "Ab1-   é", routing.character_shares)
    assert (shares.upper, shares.lower, shares.digit, shares.sep, shares.prog, shares.ws, shares.other) == (0.125, 0.25, 0.125, 0.125, 0.125, 0.375, 0.0)
    assert _one(spark, "", routing.character_shares).other == 0.0
    vector = spark.createDataFrame([([-1.0, 0.0, 1.0, 3.0, -3.0],)], "v array<float>").select(routing.quantized(F.col("v")).alias("q")).first().q
    assert vector == [0, 32768, 65535, 65535, 0]


def test_log_templates_keep_numbers_that_matter(spark):
    lines = ["2024-01-01T10:00:00Z INFO retry=3 from 10.0.0.1", "  [x 10:00:01.5] INFO retry 4 from 10.0.0.2", "10:00:02 INFO retry=5 from 10.0.0.9", "", "INFO status=500 retry=1", "INFO status=404 retry=1", "id 0123456789abcdef0 took 5ms", None]
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(lines)], "log string, i int, line string")
    got = sorted((r["first"], r.n) for r in reports.log_templates(rows, "log", "i", "line").collect())
    assert got == [(0, 3), (4, 1), (5, 1), (6, 1)]


def test_column_profile_against_plain_code(spark):
    draw = random.Random(2)
    rows = [(str(draw.choice([1, 2, "3,000", " 4.5 "])), draw.choice(["yes", "No", "1"]), f"id{i}", draw.choice(["a", "b", None, " "]), None) for i in range(50)]
    got = {r.name: r for r in reports.column_profile(spark.createDataFrame(rows, "n string, b string, u string, t string, e string"), list("nbute")).collect()}
    numbers = sorted(float(r[0].replace(",", "")) for r in rows)
    assert (got["n"].kind, got["n"].low, got["n"].p50, got["n"].high) == ("number", numbers[0], numbers[round(0.5 * 49)], numbers[-1])
    assert {k: r.kind for k, r in got.items()} == {"n": "number", "b": "boolean", "u": "unique", "t": "text", "e": "empty"}
    assert got["t"].missing == sum(1 for r in rows if not (r[3] or "").strip()) and got["t"].n_distinct == 2 and got["e"].missing == 50


def test_report_of_one_trace_and_unmeasured_costs(spark):
    traces = spark.createDataFrame([("m", 0.0, 10, 5), ("m", 0.4, 0, None), (None, None, None, 1), ("o", 1.0, 7, 1)], "model string, cost double, ms int, tokens int")
    report = reports.model_report(traces, "model", "cost", "ms", "tokens")
    got = {r.model: r for r in report.collect()}
    assert (got["m"].requests, got["m"].measured_cost_requests, got["m"].total_cost_usd, got["m"].p50_ms, got["m"].p95_ms, got["m"].total_tokens) == (2, 1, 0.4, 10.0, 10.0, 5)
    assert got["unknown"].p50_ms is None and got["unknown"].avg_cost_usd == 0.0
    used = spark.createDataFrame([("p", "m", "o"), ("p", "o", "m"), ("p", "m", "m"), ("p", "m", "unknown"), ("q", "m", None)], "policy string, model string, rec_model string")
    assert [tuple(r) for r in reports.shadow_cost_delta(used, report).collect()] == [("p", 2, 0.0, 0.0)]


def test_resolution_transition_score_and_compression(spark):
    one = spark.range(1)
    cut = lambda kind, u, old: one.select(routing.resolution(F.lit(kind), F.lit(u), F.lit(old)).alias("x")).first().x
    assert [cut("ToolResult", u, True) for u in (0.69, 0.70, 0.90)] == ["Verbatim", "Skeleton", "Fingerprint"]
    assert cut("ThinkingBlock", 0.8, False) == "Digest" and cut("ToolCall", 0.85, True) == "Digest" and cut("AssistantMessage", 0.95, False) == "Verbatim" and cut("UserMessage", 1.0, True) == "Verbatim"
    move = lambda a, b, e, change=None: tuple(one.select(routing.transition(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(e), 10.0, 0.9, change).alias("x")).first().x)
    assert move(0, 1, 1.0) == ("rephrase", 1 - 1 / 64, 1) and move(0, -1, 1.0) == ("topic_change", 0.0, 64) and move(0, 255, 1.0, 0.5)[0] == "ambiguous"
    assert move(0, 0, -1.0) == ("invalid_time", 0.0, 64) and move(0, 0, 11.0)[0] == "expired"
    health = lambda *n: one.select(routing.health_score(*map(F.lit, n)).alias("x")).first().x
    assert (health(0, 0, 0, 0, 0, 0, 0).score, health(10, 10, 100, 100, 100, 100, 100).score, health(10, 10, 100, 100, 100, 100, 100).grade) == (100.0, 0.0, "F")
    packed = lambda x, y, e: tuple(one.select(routing.compression(F.lit(x), F.lit(y), F.lit(e)).alias("x")).first().x)
    assert packed(0, 5, True) == (0, 0, 1.0, 1.0, 0.0, 0.0) and packed(100, 25, True) == (75, 75, 0.25, 4.0, 75.0, 75.0) and packed(100, 0, False) == (100, 0, 0.0, 0.0, 0.0, 100.0)


def test_boosts_are_shares_of_the_largest(spark):
    edges = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.7), ("b", "y", 0.9), ("c", "z", 9.0)], "src string, dst string, strength double")
    got = graph.boosts(spark.createDataFrame([("a",), ("b",), ("a",)], "node string"), edges).collect()
    assert {r.node: round(r.boost, 6) for r in got} == {"x": 0.625, "y": 1.0}


def test_line_chunks_keep_all_and_fill_up(spark):
    draw = random.Random(3)
    texts = ["".join("é" * draw.randrange(30) + draw.choice(["\n", "\r\n", "\n"]) for _ in range(40)) + "end" for _ in range(5)] + ["x" * 200, "", None, "a\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in blocks.line_chunks(docs, "id", "text", 64).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    assert {k: "".join(v) for k, v in got.items()} == {i: t for i, t in enumerate(texts) if t}
    for chunks in got.values():
        for a, b in zip(chunks, chunks[1:]):
            assert len((a + b.splitlines(keepends=True)[0]).encode()) > 64
        assert all(len(c.encode()) <= 64 or len(c.splitlines()) == 1 for c in chunks)
    assert blocks.line_chunks(docs, "id", "text", 0).count() == 7 and blocks.line_chunks(docs.filter("false"), "id", "text", 64).count() == 0


def test_change_sets(spark):
    diff = "--- a/x.rs\r\n+++ b/x.rs\r\n@@ -1 +1 @@ pub fn run_it(a)\n+new\n++more\n-old\n@@ -9 +9 @@ function go()\n+++ b/x.rs\n--- a/y.rs\n+++ /dev/null"
    got = spark.createDataFrame([(diff, "Speed"), (None, None)], "d string, m string").select(routing.change_set(F.col("d"), F.col("m")).alias("s")).collect()
    assert tuple(got[0].s) == (["x.rs"], ["x.rs", "y.rs"], 2, 1, ["run_it", "go"], "feature")
    assert tuple(got[1].s) == ([], [], 0, 0, [], "feature")


def test_blast_radius(spark):
    rows = spark.createDataFrame([(1, "uses Auth", None), (2, None, "AUTH.py"), (3, "none", None)], "id int, a string, b string")
    assert sorted(tuple(r) for r in blocks.blast_radius(rows, "id", ["a", "b"], ["src/auth.py", "lib/auth.rs"]).collect()) == [(1, 2, "low"), (2, 2, "low")]
    assert blocks.blast_radius(rows, "id", ["a"], ["zzz.py"]).count() == 0


def test_an_extension_is_looked_up_once(spark):
    from siltstone.functions import routing

    rows = spark.range(3).select(F.concat(F.lit("a."), F.element_at(F.array(F.lit("Py"), F.lit("h"), F.lit("odd")), (F.col("id") + 1).cast("int"))).alias("s"), F.lit("x" * 36).alias("t"))
    got = rows.select(routing.calibrated_tokens(F.col("t"), F.col("s")).alias("n"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    assert [r.n for r in got.collect()] == [12, 10, 10]


def test_a_usage_payload_is_parsed_once(spark):
    rows = spark.range(2).select(F.lit("openai").alias("p"), F.concat(F.lit('{"usage":{"input_tokens":'), "id", F.lit("}}")).alias("j"))
    got = rows.select(delivery.usage_tokens(F.col("p"), F.col("j")).alias("u"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") <= 20
    assert sorted(r.u[0] for r in got.collect()) == [0, 1]
