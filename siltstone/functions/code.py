"""Column functions over source code, identifiers and paths."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of code that a search leaves out.
CODE_STOP_WORDS = (
    "def", "class", "import", "from", "return", "self", "none", "true", "false", "if", "else", "elif", "for", "while", "try", "except", "with", "as",
    "and", "or", "not", "in", "is", "pass", "break", "continue", "yield", "lambda", "raise", "finally", "assert", "del", "global", "nonlocal",
    "fn", "let", "mut", "pub", "use", "mod", "struct", "enum", "impl", "trait", "where", "match", "ref", "move", "async", "await", "unsafe",
    "crate", "super", "type", "const", "static", "var", "new", "this", "null", "void", "int", "str", "bool",
    "the", "are", "but", "was", "all", "any", "can", "had", "her", "his", "how", "its", "may", "our", "out", "too", "who",
    "has", "have", "that", "then", "than", "these", "those", "does", "done",
)

# Parts of a path that a search leaves out.
PATH_STOP_WORDS = ("py", "rs", "ts", "js", "md", "txt", "json", "yaml", "yml", "toml", "cfg", "src", "lib", "file")

# Keywords that aren't identifiers.
KEYWORDS = (
    "def", "class", "import", "from", "return", "if", "else", "elif", "for", "while", "try", "except", "finally", "with", "as", "and", "or", "not", "in", "is", "None", "True", "False", "self", "pass",
    "break", "continue", "raise", "yield", "lambda", "async", "await", "fn", "let", "mut", "pub", "use", "mod", "impl", "struct", "enum", "trait", "where", "match", "loop", "move", "ref",
    "static", "const", "type", "unsafe", "extern", "crate", "super", "function", "var", "this", "new", "typeof", "instanceof", "void", "delete", "throw", "catch", "switch", "case", "default",
    "export", "require", "module", "extends", "constructor", "interface", "implements", "abstract", "declare", "namespace", "readonly", "keyof", "infer", "never", "any", "unknown",
    "satisfies", "override", "private", "protected", "public", "func", "package", "chan", "defer", "go", "select", "range", "map", "fallthrough", "goto", "final", "synchronized", "throws", "volatile", "transient",
    "native", "strictfp", "assert", "sealed", "record", "permits", "using", "virtual", "internal", "partial", "event", "delegate", "foreach", "checked", "unchecked", "fixed", "lock", "params",
    "guard", "protocol", "extension", "typealias", "associatedtype", "inout", "lazy", "weak", "unowned", "convenience", "required", "mutating", "nonmutating", "indirect",
    "auto", "register", "inline", "sizeof", "template", "typename", "explicit", "friend", "mutable", "operator", "dynamic_cast", "static_cast", "reinterpret_cast", "const_cast", "noexcept",
    "constexpr", "decltype", "nullptr", "alignas", "alignof", "begin", "end", "rescue", "ensure", "defined", "do", "then", "elsif", "unless", "until", "when", "redo", "retry",
    "echo", "print", "isset", "unset", "empty", "die", "exit", "include", "include_once", "require_once", "list", "global", "endfor", "endforeach", "endif", "endwhile", "endswitch",
    "true", "false", "null", "undefined", "int", "str", "float", "bool", "string", "number", "object", "array", "symbol", "bigint",
)

# Whole lines, and starts of lines, that carry no content.
BOILERPLATE_LINES = (
    "}", ")", "]", "{", "};", "},", "})", "});", "];", "],", "({", "pass", "...", '"""', "'''", "return None", "return self", "return True", "return False",
    "if err != nil {", "return nil", "return err", "return nil, err", "return nil, nil", "return fmt.Errorf(", "Ok(())", "Ok(());", "Err(e)", "unimplemented!()", "todo!()", "unreachable!()",
    "module.exports", "export default", "'use strict';", '"use strict";', "@Override", "super();", "---", "[", "null", "null,", "true,", "false,", "return 0;", "return;", "break;", "continue;",
)
BOILERPLATE_STARTS = (
    "import ", "from ", "use ", "mod ", "require(", "apiVersion:", "kind:", "metadata:", "spec:", "namespace:", "labels:", "annotations:", "name:", "resources:", "type: ",
    "selector:", "template:", "containers:", "ports:", "#include ", "#pragma ",
)

# Weights of sources by the end of their path.
SOURCE_WEIGHTS = (
    (1.0, (".go", ".py", ".pyw", ".rs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".java", ".kt", ".scala", ".cs", ".fs", ".swift", ".cpp", ".cc", ".c", ".h", ".hpp", ".rb", ".php", ".ex", ".exs", ".dart", ".lua", ".zig")),
    (0.35, (".yaml", ".yml", ".json", ".toml")),
    (0.45, (".md", ".rst", ".txt")),
    (0.40, (".sh", ".bash", ".zsh")),
    (0.75, (".sql",)),
    (0.60, (".html", ".htm", ".css", ".scss", ".vue", ".svelte")),
)

# Layers of an architecture, in order, and what their paths hold.
LAYERS = (
    ("domain", ("model", "entity", "domain", "schema", "types")),
    ("data", ("repository", "repo", "store", "dao", "db", "database", "migration")),
    ("service", ("service", "manager", "engine", "provider", "processor", "worker")),
    ("api", ("controller", "handler", "route", "router", "endpoint", "api", "middleware")),
    ("presentation", ("view", "component", "page", "screen", "widget", "ui", "template")),
    ("test", ("test", "spec", "mock", "stub", "fixture")),
)

_CODE_STOPS = frozenset(CODE_STOP_WORDS)
_KEYWORDS = frozenset(KEYWORDS)

_RUN = r"[\p{L}\p{N}_]+"

#: What lies between runs.
BETWEEN = r"[^\p{L}\p{N}_]+"

#: Where an identifier parts: underscores, before a capital after something else, before a capitalised word after capitals.
_PARTS = r"_+|(?<=[^\p{Lu}_])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"

#: What an identifier without it has one part for, itself; most words are so.
_PARTED = r"^$|_|[^\p{Lu}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"


def stem(word: Column) -> Column:
    """The stem that a lower-case word shares with its plural, past and continuous forms, or null if it has none. Lengths are in bytes."""
    n = F.octet_length(word)
    less = lambda k: F.substring(word, F.lit(1), F.char_length(word) - k)
    return (
        F.when((n >= 6) & word.endswith("ies"), F.concat(less(3), F.lit("y")))
        .when((n >= 6) & word.endswith("es") & (word.endswith("ses") | word.endswith("xes") | word.endswith("zes") | word.endswith("ches") | word.endswith("shes")), less(2))
        .when((n >= 7) & word.endswith("ing"), less(3))
        .when((n >= 6) & word.endswith("ed"), less(2))
        .when((n >= 5) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), less(1))
        .when((n >= 6) & word.endswith("e") & ~word.endswith("ee"), less(1))
    )


def split_identifier(name: Column) -> Column:
    """Lower-case parts of an identifier in camel or snake case; runs of capitals stay together."""
    parts = F.transform(F.filter(F.split(name, _PARTS), lambda p: p != ""), F.lower)
    return F.when(~name.rlike(_PARTED), F.array(F.lower(name))).otherwise(parts)


def with_stem(word: Column) -> Column:
    """A word after its stem, if it has one."""
    return F.array_compact(F.array(stem(word), word))


def code_tokens(text: Column) -> Column:
    """Search terms of code: each word in lower case and its stem, and those of its parts if it has several. Stop words and single bytes are left out; null has none."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUN), F.lit(0)), lambda w: (F.octet_length(w) >= 2) & ~F.lower(w).isin(*CODE_STOP_WORDS))

    def terms(word: Column) -> Column:
        parts = split_identifier(word)
        more = F.flatten(F.transform(F.filter(parts, lambda p: (F.octet_length(p) >= 2) & ~p.isin(*CODE_STOP_WORDS)), with_stem))
        return F.when(F.size(parts) > 1, F.concat(with_stem(F.lower(word)), more)).otherwise(with_stem(F.lower(word)))

    return F.flatten(F.transform(words, terms))


def stem_of(word: str) -> str | None:
    """stem() of a string."""
    if not word.endswith(("s", "g", "d", "e")):
        return None
    n = len(word.encode())
    if n >= 6 and word.endswith("ies"):
        return word[:-3] + "y"
    if n >= 6 and word.endswith(("ses", "xes", "zes", "ches", "shes")):
        return word[:-2]
    if n >= 7 and word.endswith("ing"):
        return word[:-3]
    if n >= 6 and word.endswith("ed"):
        return word[:-2]
    if n >= 5 and word.endswith("s") and not word.endswith(("ss", "us")):
        return word[:-1]
    return word[:-1] if n >= 6 and word.endswith("e") and not word.endswith("ee") else None


def is_identifier(run: str) -> bool:
    """Whether identifiers() have a run."""
    return len(run.encode()) > 1 and run not in _KEYWORDS


class _Kinds(dict):
    """Kinds of characters by which identifiers part, found out once for each: U for capitals, l for small letters."""

    def __missing__(self, code: int) -> str:
        self[code] = kind = "_" if code == ord("_") else {"Lu": "U", "Ll": "l"}.get(unicodedata.category(chr(code)), "o")
        return kind


_KINDS = _Kinds()
_CUTS = re.compile(r"_+|(?<=[^U_])(?=U)|(?<=U)(?=Ul)")


def parts_of(name: str) -> list[str]:
    """split_identifier() of a string."""
    kinds, out, at = name.translate(_KINDS), [], 0
    if "_" not in kinds and "U" not in kinds:
        return [name.lower()] if name else []
    for cut in _CUTS.finditer(kinds):
        out.append(name[at : cut.start()].lower())
        at = cut.end()
    return [p for p in (*out, name[at:].lower()) if p]


def tokens_of(word: str, parts: list[str]) -> list[str]:
    """code_tokens() of one run, whose parts_of() are given."""
    low = word.lower()
    if len(word.encode()) < 2 or low in _CODE_STOPS:
        return []
    all_of = [low]
    if len(parts) > 1:
        all_of += [p for p in parts if len(p.encode()) >= 2 and p not in _CODE_STOPS]
    return [t for w in all_of for t in (stem_of(w), w) if t is not None]


def path_tokens(path: Column) -> Column:
    """Lower-case parts of a path with two bytes or more but common folders and endings."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), r"[/\\.\-_]"), lambda p: F.octet_length(p) >= 2)
    return F.filter(F.transform(parts, F.lower), lambda p: ~p.isin(*PATH_STOP_WORDS))


def file_stem(path: Column) -> Column:
    """The file's name before its last dot in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)\.[^./\\]*$", 1))


def identifiers(text: Column) -> Column:
    """Runs of letters, digits and underscores with more than one byte that aren't keywords, in order."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUN), F.lit(0)), lambda w: (F.octet_length(w) > 1) & ~w.isin(*KEYWORDS))


def is_boilerplate(line: Column) -> Column:
    """Whether a trimmed line is blank or scaffolding of a programming language or a configuration."""
    out = (line == "") | line.isin(*BOILERPLATE_LINES)
    for start in BOILERPLATE_STARTS:
        out = out | line.startswith(start)
    return out | (line.startswith("def __") & line.contains("__(")) | (line.startswith("package ") & ~line.contains("{"))


def boilerplate_ratio(text: Column) -> Column:
    """Share of scaffolding among a text's lines that aren't blank; 1 without any."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, is_boilerplate)) / F.size(lines)).otherwise(F.lit(1.0))


def source_weight(path: Column) -> Column:
    """Weight of a source by its kind of file."""
    low = F.lower(path)
    out = None
    for weight, ends in SOURCE_WEIGHTS:
        hit = F.lit(False) if weight != 0.40 else low.contains("dockerfile")
        for end in ends:
            hit = hit | low.endswith(end)
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.otherwise(0.55)


def layer(path: Column) -> Column:
    """The first layer of which the path holds a word; null if none."""
    low = F.lower(path)
    out = None
    for name, words in LAYERS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
