"""What a shell command and its exit code say about the work before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of commands, their category and tool; the first that is found counts.
COMMANDS = (
    (r"\bpytest\b|python\s+-m\s+pytest\b|py\.test\b", "test", "pytest"),
    (r"\bunittest\b|python\s+-m\s+unittest\b", "test", "unittest"),
    (r"\bnose2?\b|python\s+-m\s+nose\b", "test", "nose"),
    (r"\bjest\b|npx\s+jest\b", "test", "jest"),
    (r"\bvitest\b|npx\s+vitest\b", "test", "vitest"),
    (r"\bmocha\b|npx\s+mocha\b", "test", "mocha"),
    (r"\bcypress\b|npx\s+cypress\b", "test", "cypress"),
    (r"\bplaywright\b|npx\s+playwright\b", "test", "playwright"),
    (r"\bgo\s+test\b", "test", "go_test"),
    (r"\bcargo\s+test\b", "test", "cargo_test"),
    (r"\bdotnet\s+test\b", "test", "dotnet_test"),
    (r"\brspec\b|bundle\s+exec\s+rspec\b", "test", "rspec"),
    (r"\bphpunit\b", "test", "phpunit"),
    (r"\bmaven\s+test\b|mvn\s+test\b", "test", "maven_test"),
    (r"\bgradle\s+test\b|gradlew\s+test\b", "test", "gradle_test"),
    (r"\bnpm\s+(?:run\s+)?test\b|yarn\s+(?:run\s+)?test\b|pnpm\s+test\b", "test", "npm_test"),
    (r"\bzig\s+test\b", "test", "zig_test"),
    (r"\bswift\s+test\b", "test", "swift_test"),
    (r"\belixir.*test\b|mix\s+test\b", "test", "mix_test"),
    (r"\bcargo\s+build\b", "build", "cargo_build"),
    (r"\bgo\s+build\b", "build", "go_build"),
    (r"\bnpm\s+run\s+build\b|yarn\s+build\b|pnpm\s+build\b", "build", "npm_build"),
    (r"\btsc\b(?!.*--noEmit)", "build", "tsc_build"),
    (r"\bwebpack\b", "build", "webpack"),
    (r"\bvite\s+build\b", "build", "vite_build"),
    (r"\bmake\b(?!\s+test)", "build", "make"),
    (r"\bcmake\b", "build", "cmake"),
    (r"\bgcc\b|g\+\+\b|clang\b|clang\+\+\b", "build", "cc"),
    (r"\bjavac\b", "build", "javac"),
    (r"\bdotnet\s+build\b", "build", "dotnet_build"),
    (r"\bzig\s+build\b", "build", "zig_build"),
    (r"\bruff\b(?:\s+check)?", "lint", "ruff"),
    (r"\beslint\b|npx\s+eslint\b", "lint", "eslint"),
    (r"\bpylint\b", "lint", "pylint"),
    (r"\bflake8\b", "lint", "flake8"),
    (r"\bclippy\b|cargo\s+clippy\b", "lint", "clippy"),
    (r"\bgolangci-lint\b|golint\b", "lint", "golint"),
    (r"\brubocop\b", "lint", "rubocop"),
    (r"\bshellcheck\b", "lint", "shellcheck"),
    (r"\bhadolint\b", "lint", "hadolint"),
    (r"\bmypy\b", "typecheck", "mypy"),
    (r"\bpyright\b|npx\s+pyright\b", "typecheck", "pyright"),
    (r"\btsc\s+.*--noEmit\b|tsc\b.*--noEmit", "typecheck", "tsc_check"),
    (r"\bflow\b", "typecheck", "flow"),
    (r"\bcargo\s+check\b", "typecheck", "cargo_check"),
    (r"\bblack\b(?:\s+--check)?", "format", "black"),
    (r"\bprettier\b|npx\s+prettier\b", "format", "prettier"),
    (r"\bisort\b", "format", "isort"),
    (r"\brustfmt\b|cargo\s+fmt\b", "format", "rustfmt"),
    (r"\bgofmt\b|goimports\b", "format", "gofmt"),
)
FAILED = r"(?i)FAIL(?:ED|URE)?|ERROR|(?:\d+)\s+(?:failed|errors?|failures?)|AssertionError|panic|SEGFAULT|(?:Build|Compilation)\s+(?:failed|error)"
PASSED = r"(?i)(?:\d+)\s+passed|(?:All\s+)?tests?\s+passed|OK\s*$|Build\s+succeeded|0\s+(?:errors?|failures?|failed)"


def outcome(command: Column, exit_code: Column, output: Column) -> Column:
    """Struct of category, tool, verdict and confidence; null for commands that verify nothing and for null ones.

    A command "[proxy:kind/...]" stands for itself. Tests that could not be collected (exit codes 4 and 5) have
    the verdict unknown, a null exit code fails. Output that agrees with the verdict raises the confidence, output
    against it lowers it. Word boundaries are those of ASCII.
    """
    found = F.when(F.lit(False), F.struct(F.lit("").alias("category"), F.lit("").alias("tool")))
    for pattern, category, tool in COMMANDS:
        found = found.when(command.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(tool).alias("tool")))
    done = F.coalesce(exit_code == 0, F.lit(False))
    verdict = lambda kind: F.when(done, "pass").when(exit_code.isin(4, 5) & (kind == "test"), "unknown").otherwise("fail")
    failed, passed = (F.coalesce(output, F.lit("")).rlike(p) for p in (FAILED, PASSED))
    sure = lambda v: F.when(failed & ~passed, F.when(v == "pass", 0.4).otherwise(0.95)).when(passed & ~failed, F.when(v == "fail", 0.4).otherwise(0.95)).otherwise(0.85)
    judged = lambda f: F.when(f.isNotNull(), F.struct(f["category"].alias("category"), f["tool"].alias("tool"), verdict(f["category"]).alias("verdict"), sure(verdict(f["category"])).alias("confidence")))
    # an array of one, so that the patterns are tried once
    real = F.get(F.transform(F.array(found), judged), F.lit(0))
    kind = F.regexp_replace(F.substring(command, 8, 1 << 30), r"\]\z", "")
    first = F.split(kind, "/")[0]
    implied = F.struct(F.when(first.isin("test", "build", "lint", "typecheck", "format"), first).otherwise("other").alias("category"), kind.alias("tool"), F.when(done, "pass").otherwise("fail").alias("verdict"), F.lit(0.4).alias("confidence"))
    return F.when(command.startswith("[proxy:"), implied).otherwise(real)
