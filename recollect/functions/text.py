"""Column expressions on texts: words, hashes, token estimates, languages, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopword lists of the memory store, of the query analysis, and of code search.
MEMORY_STOPWORDS = """
a an the is are was were be been being have has had do does did will would could should may might must shall can need
dare to of in for on with at by from as into through during before after above below between under again further then
once here there when where why how all each few more most other some such no nor not only own same so than too very just
and but if or because until while about against up down out off over any both this that these those am i me my myself
we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom does doing having loves like likes user agent
""".split()
QUERY_STOPWORDS = """
a an the is are was were be been being have has had do does did will would could should may might must shall can need
to of in for on with at by from as what when where why how who which that this these those and but or if because until
while about against i me my we our you your he him his she her it its they them their am all each few more most other
some such no nor not only own same so than too very just user agent tell know remember recall find search get show
""".split()
CODE_STOPWORDS = """
is the a an and or in on with how what where to for of can you explain from pull context only which does do that this it
but not at by are be been has have was were show me all about tell describe give find list get there when if then so
also my i we us our your its any some each every just need want like use used using would could should will shall may
might must
""".split()
# Languages by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".cs": "csharp",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".html": "html",
    ".css": "css", ".sql": "sql", ".sh": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
    ".md": "markdown", ".xml": "xml",
}


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def split_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def tokenize_query(text: Column, stopwords: list[str] = MEMORY_STOPWORDS) -> Column:
    """Lower-case words longer than 2 that aren't stopwords; if none is left, all words longer than 2."""
    long = F.filter(split_words(F.lower(text)), lambda w: F.length(w) > 2)
    kept = F.filter(long, lambda w: ~F.array_contains(strings(stopwords), w))
    return F.when(F.size(kept) > 0, kept).otherwise(long)


def normalise_hash(text: Column) -> Column:
    """sha256 of the text with white space collapsed and trimmed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def number_lines(text: Column, start: Column) -> Column:
    """`line:N text` for each line, joined by a space."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat(F.lit("line:"), (start + i).cast("string"), F.lit(" "), x)), " ")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) * F.lit(0.25)).cast("long")


def detect_language(path: Column) -> Column:
    """Language by extension, else `other`."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)], F.lit("other"))


def decompose_identifier(name: Column) -> Column:
    """Parts of a snake, camel or dotted name longer than 1, in lower case, and the whole; sorted."""
    camel = F.regexp_extract_all(name, F.lit(r"([a-z]+|[A-Z][a-z]*)"), F.lit(1))
    snake = F.split(name, r"[_.]")
    parts = F.transform(F.filter(F.concat(camel, snake), lambda p: F.length(p) > 1), lambda p: F.lower(p))
    return F.array_sort(F.array_distinct(F.concat(parts, F.array(F.lower(name)))))
