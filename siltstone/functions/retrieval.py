"""Terms of code and texts for ranking files, expansion of a query by what it is about, and marks of files."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.code import stem, stem_of

# Words that no term is.
STOP_WORDS = tuple(
    "the a an of to in on for with by how does what why is are and or but do between two include shown actual actually that this these those "
    "from can could should would has have had will was were been being about into through over under above below after before while when where "
    "not no yes all any some most many much more less than then thus therefore you your their his her its our it he she they them we us i me my".split()
)

# Words of each subject.
CLUSTERS = {
    "mapping": "map mapping mapper transform convert converter serialize deserialize marshal unmarshal adapt translate encode decode parse parser".split(),
    "schema": "schema model models type types record records entity entities struct dto interface".split(),
    "ingest": "incoming request payload event events ingest ingestion consume consumer intake receive handler queue worker processor stream".split(),
    "persistence": "persist persistence save store stored write upsert insert update delete repository repositories dao table tables database migration query".split(),
}

# Subjects that come with a subject.
LINKS = {"mapping": ("schema",), "schema": (), "ingest": ("mapping", "persistence"), "persistence": ("schema",)}

# Endings that a word of a subject loses, the first that leaves three characters.
ENDINGS = (("ings", ""), ("ing", ""), ("ied", "y"), ("ies", ""), ("ed", ""), ("es", ""), ("s", ""))

# Words of a query that asks for tests.
TEST_WORDS = ("test", "tests", "spec", "assert", "fixture", "mock")

# Patterns of paths, which are lower-case and parted by /.
TEST_PATH = r"(^|/)(__tests__|tests?|specs?|e2e|fixtures?|mocks?|__mocks__)(/|$)|[._-](test|spec|stories)\."
GENERATED_PATH = r"/(generated|gen|dist|build|out|coverage|snapshots?|__snapshots__|vendor|migrations?|seed(?:er)?s?)/|[._-](?:generated|min)\.|(?:package-lock|pnpm-lock|yarn\.lock)"
SOURCE_PATH = r"/(?:src|lib|core|pkg|internal|app)/"
LOGIC_PATH = r"/(?:services?|repositor(?:y|ies)|models?|domain|handlers?|controllers?|workers?|queues?|jobs?|processors?|usecases?|adapters?|mappers?|stores?|dao|db|database|persistence)/"
VIEW_PATH = r"/(?:components?|pages?|views?|widgets?|ui|styles?)/"

# Patterns of texts.
MAPPER = r"\b(?:map|convert|transform|to|from)[A-Za-z0-9_]*?(?:To|From|Into)[A-Z][A-Za-z0-9_]*\b"
TRANSFORM = r"(?i)\b(?:serialize|deserialize|marshal|unmarshal|encode|decode|parse|format|normalize|adapt)[A-Za-z0-9_]*\b"
PERSIST = r"\b(?:insert|upsert|save|persist|write|store|create|update|delete|find|fetch|load|select)[A-Z][A-Za-z0-9_]*\b"
SCHEMA_TYPE = r"\b[A-Z][A-Za-z0-9_]*(?:InsertType|UpdateType|RecordType|Record|Schema|Model|Entity|Dto|DTO|Table|Row|Document)\b"
SQL_TEXT = r"(?is)\b(?:INSERT\s+INTO|UPDATE\s+\w+\s+SET|SELECT\b.{0,200}?\bFROM|CREATE\s+TABLE)\b"

# What a text that one of these patterns fits has at any rate; FOLDED has no case, and each of UNFOLDED is a letter of it in some other case.
NEEDED = {
    MAPPER: ("To", "From", "Into"),
    PERSIST: ("insert", "upsert", "save", "persist", "write", "store", "create", "update", "delete", "find", "fetch", "load", "select"),
    SCHEMA_TYPE: ("InsertType", "UpdateType", "Record", "Schema", "Model", "Entity", "Dto", "DTO", "Table", "Row", "Document"),
}
FOLDED = {
    TRANSFORM: ("serialize", "marshal", "encode", "decode", "parse", "format", "normalize", "adapt"),
    SQL_TEXT: ("insert", "update", "select", "create"),
}
UNFOLDED = "\u017f\u212a\u0131\u0130"

# Weights of the marks, of the terms' score and of terms that only the expansion has.
WEIGHTS = {
    "bm25f": 1.0, "test_penalty": -0.45, "generated_penalty": -0.55, "source_dir": 0.08, "logic_dir_intent": 0.22, "ui_penalty_for_logic": -0.30,
    "basename_hit": 0.30, "defines_mapper": 0.40, "defines_transform": 0.16, "defines_persistence": 0.30, "defines_schema_type": 0.22, "rank_expansion_weight": 0.35,
}

_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"
_CAMEL = r"[0-9]+|[A-Z][a-z]+|[A-Z]+(?![a-z])|[a-z]+"

#: Characters of scripts without spaces: Kana, Han, Hangul.
UNSPACED = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿ｦ-ﾝ]"

#: Characters that no term has.
BETWEEN = f"[^A-Za-z0-9_{UNSPACED[1:-1]}]+"


def _lits(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f names it."""
    return F.transform(F.array(value), f)[0]


def tokens(text: Column) -> Column:
    """Terms of a text in lower case, with repeats: of each identifier of three or more characters itself, its parts of three or more and their stems, once each; pairs of characters of unspaced scripts. Null has none."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: F.filter(c, lambda p: F.char_length(p) > 2)

    def parts(name: Column) -> Column:
        low = F.lower(name)
        pieces = F.concat(F.array(low), long(F.split(low, "_")), long(F.transform(F.regexp_extract_all(name, F.lit(_CAMEL), F.lit(0)), F.lower)))
        many = once(F.array_distinct(pieces), lambda p: F.array_distinct(F.array_compact(F.concat(p, F.transform(p, stem)))))
        # most words have one part
        return F.when(name.rlike("^[A-Za-z][a-z]+$"), F.array_compact(F.array(low, stem(low)))).otherwise(many)

    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_IDENTIFIER), F.lit(0)), parts))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    unspaced = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(UNSPACED + "+"), F.lit(0)), pairs))
    return F.concat(F.filter(names, lambda p: ~p.isin(*STOP_WORDS)), unspaced)


_NAMES, _PIECES, _PAIRED, _PLAIN = re.compile(_IDENTIFIER), re.compile(_CAMEL), re.compile(UNSPACED + "+"), re.compile("[A-Za-z][a-z]+")
_STOPS = frozenset(STOP_WORDS)


def tokens_of(run: str) -> list[str]:
    """tokens() of a run of characters that lies between matches of BETWEEN."""
    out = []
    for name in _NAMES.findall(run):
        pieces = [low := name.lower()]
        # most names have one part
        if not _PLAIN.fullmatch(name):
            pieces = dict.fromkeys([low, *(p for p in low.split("_") if len(p) > 2), *(c.lower() for c in _PIECES.findall(name) if len(c) > 2)])
        out += [t for t in dict.fromkeys([*pieces, *map(stem_of, pieces)]) if t is not None and t not in _STOPS]
    if not run.isascii():
        out += [u[i : i + 2] for u in _PAIRED.findall(run) for i in range(max(1, len(u) - 1))]
    return out


def _term(word: Column) -> Column:
    """Whether a word is long enough for a query's term."""
    return (F.char_length(word) > 2) | word.rlike(f"^{UNSPACED}+$")


def query_tokens(query: Column) -> Column:
    """Different terms of a query."""
    return F.array_distinct(F.filter(tokens(query), _term))


def root(word: Column) -> Column:
    """A word without its ending, by which it is held against words of subjects."""
    out = None
    for end, instead in ENDINGS:
        short = F.concat(F.substring(word, F.lit(1), F.char_length(word) - len(end)), F.lit(instead))
        holds = word.endswith(end) & (F.char_length(word) >= len(end) + 3)
        out = F.when(holds, short) if out is None else out.when(holds, short)
    return out.otherwise(word)


def subjects(terms: Column) -> Column:
    """Names of the subjects of which the terms have a word, whatever its ending."""
    plain = lambda w: next((w[: -len(end)] + instead for end, instead in ENDINGS if w.endswith(end) and len(w) >= len(end) + 3), w)
    roots = {name: [plain(w) for w in words] for name, words in CLUSTERS.items()}
    return once(F.transform(terms, root), lambda r: F.array_compact(F.array(*(F.when(F.arrays_overlap(r, _lits(words)), F.lit(name)) for name, words in roots.items()))))


def expand_query(query: Column) -> Column:
    """Different terms of a query and all words of its subjects and of those that come with them, sorted."""
    leads = {name: [name, *(n for n, linked in LINKS.items() if name in linked)] for name in CLUSTERS}
    more = lambda known: [F.when(F.arrays_overlap(known, _lits(leads[name])), _lits(words)).otherwise(_lits([])) for name, words in CLUSTERS.items()]
    both = once(query_tokens(query), lambda terms: once(subjects(terms), lambda known: F.concat(terms, *more(known))))
    return F.array_sort(F.array_distinct(F.filter(both, lambda t: ~t.isin(*STOP_WORDS) & _term(t))))


def file_name(path: Column) -> Column:
    """What stands after a path's last / and before the last dot there."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*\z", 0), r"\.[^.]*\z", "")


def marks(path: Column, text: Column, known: list[str], base: list[str], terms: list[str], weights: dict[str, float] = WEIGHTS) -> Column:
    """Sum of the weights of a file's marks for a query's subjects (known), its own terms (base) and all its terms.

    Files of tests and generated ones lose, unless the query asks for tests; source folders, names
    with a term, and mappers, parsers, storing calls and record types where the query is about them win.
    Null paths and texts are empty.
    """
    low = F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    text = F.coalesce(text, F.lit(""))
    about = lambda *names: any(n in known for n in names)
    any_of = lambda c, words: reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))

    def has(pattern: str) -> Column:
        """Whether a pattern fits somewhere; texts that lack what it needs aren't looked through for it."""
        if pattern in NEEDED:
            near = any_of(text, NEEDED[pattern])
        else:
            near = once(F.lower(text), lambda low: any_of(low, FOLDED[pattern])) | any_of(text, UNFOLDED)
        return near & text.rlike(f"(?U){pattern}")

    found = [("source_dir", low.rlike(SOURCE_PATH))]
    if not set(base) & set(TEST_WORDS):
        found += [("test_penalty", low.rlike(TEST_PATH)), ("generated_penalty", low.rlike(GENERATED_PATH))]
    if known:
        found += [("logic_dir_intent", low.rlike(LOGIC_PATH)), ("ui_penalty_for_logic", low.rlike(VIEW_PATH))]
    if terms:
        found.append(("basename_hit", F.arrays_overlap(tokens(file_name(low)), _lits(terms))))
    if about("mapping", "schema"):
        found.append(("defines_mapper", has(MAPPER)))
    if about("mapping", "ingest"):
        found.append(("defines_transform", has(TRANSFORM)))
    if about("persistence", "ingest"):
        found.append(("defines_persistence", has(PERSIST) | has(SQL_TEXT)))
    if about("schema", "mapping", "persistence"):
        found.append(("defines_schema_type", has(SCHEMA_TYPE)))
    return reduce(lambda a, b: a + b, (F.when(hit, F.lit(float(weights.get(name, 0.0)))).otherwise(F.lit(0.0)) for name, hit in found))
