"""Symbols that lines of source code define and import, by rules in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.code import KEYWORDS, identifiers


@dataclass(frozen=True)
class Rule:
    """A trimmed line that matches all of when and none of unless gives names.

    before is cut off the line, take's first group is cut at each comma if many; of each part
    what follows " as " goes, then all up to the last match of last, then strip.
    """

    when: tuple[str, ...]
    take: str
    unless: tuple[str, ...] = ()
    before: str = ""
    many: bool = False
    last: str = ""
    strip: str = ""
    drop: tuple[str, ...] = field(default=())


# How lines define names. The first rule whose conditions hold decides.
DEFINITIONS = (
    Rule(("^(?:def|class) ",), r"^\S+\s+([^\s(]+)", strip=":+$"),
    Rule(("^(?:(?:pub )?(?:fn|struct)|enum|trait) ",), r"^(?:pub\s+)?\S+\s+([^\s(]+)", strip="[{<:]+$"),
    Rule(("^(?:export default |export async |export |async )?function ",), r"(?:^|\s)function\s+([^\s(]+)", strip=r"[^\pL\pN_]+$"),
    Rule(("^(?:export (?:const|let|default)|const|let) ", r"=>|= function|= async function|= \("), r"^([\pL_][^ :=]*)", before="^(?:export )*(?:default )*(?:const )*(?:let )*"),
    Rule(("^(?:export )?interface ",), r"^([^ {<]*)", before="^(?:export )*(?:interface )*"),
    Rule(("^(?:export )?type ", "="), "^([^ =<]*)", before="^(?:export )*(?:type )*"),
    Rule(("^(?:export )?(?:const )?enum ",), r"^([^ {]*)", before="^(?:export )*(?:const )*(?:enum )*"),
    Rule((r"^func \(",), r"^.*?\) ([^(]*)"),
    Rule(("^func ",), r"^([^(]*)", before="^(?:func )*"),
    Rule(("^type ",), r"^\S+\s+(\S+)\s+\S"),
    Rule(("^(?:public|private|protected|abstract|final|class|interface|data class|sealed|open) ", "(?:class|interface) "), r"(?:^|\s)(?:class|interface)\s+([^\s{<(:]*)"),
    Rule(("^(?:public|private|protected|static|override|suspend) ", r"\("), r"^[^(]*?(\S+)\s*$", before=r"\(.*$", drop=KEYWORDS),
    Rule((r"^(?:namespace |typedef .*struct)",), r"^\S+\s+([^\s{;:]+)", drop=KEYWORDS),
    Rule(("^module ",), r"^\S+\s+([^\s;<:]+)"),
)

# How lines import names.
IMPORTS = (
    Rule(("^from ", " import "), r"^.*? import (.*?)(?: import |$)", many=True, drop=("*",)),
    Rule(("^import ",), r"^(.*)$", unless=("from",), before="^(?:import )+", many=True, last=r"^.*\."),
    Rule(("^use ", r"\{"), r"\{([^}]*)\}", many=True),
    Rule(("^use ",), r"^(.*)$", before="^(?:use )+|;+$", last="^.*::"),
    Rule(("^import ", r"\{"), r"\{([^}]*)\}", many=True),
    Rule(("^import ",), r"^(\S+)", before="^(?:import )+", strip=r"^[^\pL\pN_]+|[^\pL\pN_]+$", drop=("type",)),
    Rule((r"require\(", r"^(?:const|let|var) \s*\{[^=]*\}[^=]*=\s*require\("), r"\{[\s,]*([^,:}]+)"),
    Rule((r"require\(",), r"^(?:const|let|var) ([^=]*)=\s*require\(", strip=r"^[^\pL\pN_]+|[^\pL\pN_]+$"),
    Rule(('^".*"$',), '^"+(.*?)"*$', last="^.*/"),
    Rule(("^#include",), r'^#include\s*[<">]*([^>"]*)', last="^.*/", strip=r"\..*$"),
    Rule(("^require(?:_relative)? ",), r"^require(?:_relative)?\s+(.*)$", last="^.*/", strip="^['\"]+|['\"]+$"),
    Rule(("^using ", ";$"), r"^(\S+)$", before="^(?:using )+(?:static )*|;+$", last=r"^.*\."),
)

# What a line holds that crosses to another language, and the name of that bridge.
BRIDGES = (
    (r"#\[pyfunction\]|#\[pyclass\]|#\[pymethods\]|pyo3::prelude", "__pyo3_bridge__"),
    (r"^native | native |System\.loadLibrary|System\.load\(|JNIEXPORT|JNIEnv", "__jni_bridge__"),
    (r'extern "[Cc]"|ctypes\.|from ctypes|cffi|dlopen', "__c_ffi__"),
    (r'^import "C"$', "__cgo_bridge__"),
    (r"wasm_bindgen|wasm-bindgen", "__wasm_bridge__"),
    (r"napi::|#\[napi\]|neon::prelude", "__node_native__"),
)

# Names so common that nothing follows from them.
GENERIC = (
    "new", "init", "main", "run", "start", "stop", "get", "set", "update", "delete", "create", "read", "write", "close", "open", "error", "result", "value", "data", "name", "id", "key", "type",
    "self", "this", "true", "false", "none", "null", "ok", "err", "ok_or", "unwrap", "expect", "from", "into", "clone", "copy", "default", "debug", "display", "drop",
)

_TRIM = r"^[\s\pZ]+|[\s\pZ]+$"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, _TRIM, "")), lambda x: x != "")


def _holds(line: Column, rule: Rule) -> Column:
    out = F.lit(True)
    for p in rule.when:
        out = out & line.rlike(p)
    for p in rule.unless:
        out = out & ~line.rlike(p)
    return out


def _names(line: Column, rule: Rule) -> Column:
    cut = F.regexp_replace(line, rule.before, "") if rule.before else line
    taken = F.regexp_extract(cut, rule.take, 1)

    def name(part: Column) -> Column:
        part = F.regexp_replace(F.regexp_replace(part, " as .*$", "") if rule.many else part, _TRIM, "")
        if rule.strip and "'" in rule.strip:  # quotes go before the folder
            part = F.regexp_replace(part, rule.strip, "")
        if rule.last:
            part = F.regexp_replace(part, rule.last, "")
        if rule.strip and "'" not in rule.strip:
            part = F.regexp_replace(part, rule.strip, "")
        return F.regexp_replace(part, _TRIM, "")

    parts = F.split(taken, ",") if rule.many else F.array(taken)
    return F.filter(F.transform(parts, name), lambda n: (n != "") & ~n.isin(*rule.drop) if rule.drop else n != "")


def _by_rules(line: Column, rules: tuple[Rule, ...]) -> Column:
    out = None
    for rule in rules:
        out = F.when(_holds(line, rule), _names(line, rule)) if out is None else out.when(_holds(line, rule), _names(line, rule))
    return out.otherwise(F.array().cast("array<string>"))


def definitions(text: Column) -> Column:
    """Names that a text of source code defines, in order, each line by its start. Null has none."""
    return F.flatten(F.transform(_lines(text), lambda x: _by_rules(x, DEFINITIONS)))


def imports(text: Column) -> Column:
    """Names that a text of source code imports, bridges to other languages included; each once. Null has none."""
    lines = _lines(text)
    named = F.flatten(F.transform(lines, lambda x: _by_rules(x, IMPORTS)))
    crossed = [F.when(F.exists(lines, _matcher(pattern)), F.lit(name)) for pattern, name in BRIDGES]
    return F.array_distinct(F.concat(named, F.array_compact(F.array(*crossed))))


def _matcher(pattern: str):
    return lambda line: line.rlike(pattern)


def is_type_reference(lower_text: Column, name: Column) -> Column:
    """Whether a name stands where types do: after a colon, an arrow or an opening angle."""
    low = F.lower(name)
    return F.contains(lower_text, F.concat(F.lit(": "), low)) | F.contains(lower_text, F.concat(F.lit("-> "), low)) | F.contains(lower_text, F.concat(F.lit("<"), low)) | F.contains(lower_text, F.concat(F.lit("isinstance(_, "), low))


def reference_kind(lower_text: Column, imported: Column, name: Column) -> Column:
    """import, type or call: how a text uses a name, by its lower-case form and what it imports."""
    return F.when(F.array_contains(imported, name), "import").when(is_type_reference(lower_text, name), "type").otherwise("call")


def strength(kind: Column) -> Column:
    """How surely a use of that kind means the symbol."""
    return F.when(kind == "import", 1.0).when(kind == "type", 0.9).otherwise(0.7)


def references(text: Column) -> Column:
    """Structs (symbol, kind, strength) of the different identifiers of a text: imports, types and other uses."""
    low, imported = F.lower(F.coalesce(text, F.lit(""))), imports(text)

    def one(name: Column) -> Column:
        kind = reference_kind(low, imported, name)
        return F.struct(name.alias("symbol"), kind.alias("kind"), strength(kind).alias("strength"))

    return F.transform(F.array_distinct(identifiers(text)), one)
