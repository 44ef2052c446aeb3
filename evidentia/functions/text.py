"""Column expressions over text, lines, paths and identifiers. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no search meaning.
STOPWORDS = (
    "the", "and", "how", "why", "what", "where", "when", "who", "does", "work", "works", "with", "into", "from", "that", "this", "then", "than",
    "are", "for", "you", "about", "fit", "fits", "implementation", "algorithm", "system", "process", "deep", "level", "tell", "everything", "please",
    "explain", "walkthrough", "overview", "fully",
)

#: Core vocabulary of the lexical priority.
CORE = (
    "runtime", "store", "indexer", "watcher", "embedder", "index", "file", "stats", "progress", "chunker", "chunk", "vector", "search", "embedding",
    "text", "upsert", "content", "hash", "dependency", "manifest", "config", "package", "cargo",
)
CORE_PATTERN = r"(index|embed|chunk|vector|database|store|retrieval|dependency|manifest|config|schema|query)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it; lambdas would compute it anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(content: Column) -> Column:
    """The lines of a text; CRLF counts as one line end."""
    return F.split(content, "\r?\n", -1)


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def split_identifier(value: Column, lower: bool = True) -> Column:
    """Parts of an identifier: cut at camel-case humps, then at everything that is not a letter or digit."""
    parts = F.array_remove(F.split(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+"), "")
    return F.transform(parts, F.lower) if lower else parts


def split_text(value: Column) -> Column:
    """split_identifier of a long text: its parts are looked for, which is faster than cutting at all else."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def search_token(token: Column) -> Column:
    """The form in which tokens are compared."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), "^@", ""), "[^a-z0-9]+", "")


def lexical_priority(token: Column) -> Column:
    """5 for code-shaped tokens, 4 for the core vocabulary, 2 for words that contain it, else 0."""
    norm = search_token(token)
    shaped = token.rlike("[./@$-]") | token.rlike("[a-z0-9][A-Z]") | token.rlike("^[A-Z0-9_]{2,}$")
    return F.when(norm == "", 0).when(shaped, 5).when(norm.isin(*CORE), 4).when(norm.rlike(CORE_PATTERN), 2).otherwise(0)


def code_terms(content: Column, limit: int = 80) -> Column:
    """The first distinct parts of a text's identifiers, in order, without stopwords."""
    names = F.regexp_extract_all(content, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    parts = F.flatten(F.transform(names, lambda n: split_identifier(n)))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 3) & ~F.array_contains(stop, p))), 1, limit)


def path_tokens(path: Column) -> Column:
    return F.array_remove(F.split(path, "[^A-Za-z0-9]+"), "")


def fts_text(path: Column, content: Column, description: Column) -> Column:
    """The text that is searched: description twice, path, its tokens three times, content."""
    own = F.array_join(path_tokens(path), " ")
    some = F.when(F.coalesce(description, F.lit("")) != "", description)
    return F.concat_ws("\n", some, some, path, own, own, own, content)


def _labelled(label: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(label), text))


def embedding_head(path: Column, line_start: Column, line_end: Column, description: Column) -> Column:
    """The labelled header lines of embedding_text that need no content; empty parts are left out."""
    return F.concat_ws(
        "\n",
        _labelled("Purpose: ", description),
        F.concat(F.lit("File: "), path, F.lit(":"), line_start.cast("string"), F.lit("-"), line_end.cast("string")),
        _labelled("Directory: ", dirname(path)),
        _labelled("Name terms: ", F.array_join(split_identifier(basename(path)), " ")),
    )


def embedding_text(path: Column, line_start: Column, line_end: Column, content: Column, description: Column) -> Column:
    """embedding_head, the terms of the code, then the content; empty parts are left out."""
    return F.concat_ws("\n", embedding_head(path, line_start, line_end, description), _labelled("Code terms: ", F.array_join(code_terms(content), " ")), content)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def extension(path: Column) -> Column:
    """The last extension of the file name; a dot file's whole name."""
    name = F.lower(basename(path))
    return F.when(name.rlike(r"^\.[^.]+$"), name).otherwise(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def content_hash(content: Column, fingerprint: str, namespace: str = "chunk") -> Column:
    """First 16 hex digits of SHA-256 over namespace, index fingerprint and content."""
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(namespace), F.lit(fingerprint), content), 256), 1, 16)


def clip_lines(content: Column, budget: int) -> Column:
    """(text, n_lines, truncated): the whole lines that fit into budget characters; a first line that is longer is cut."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.length(line) + F.when(acc["n"] > 0, 1).otherwise(0)
        fits = ~acc["full"] & (used <= budget)
        return F.struct((acc["n"] + fits.cast("int")).alias("n"), F.when(fits, used).otherwise(acc["used"]).alias("used"), (~fits).alias("full"))

    def cut(parts: Column, n: Column) -> Column:
        return F.when(n > 0, F.struct(join_lines(F.slice(parts, 1, n)).alias("text"), n.alias("n_lines"), (n < F.size(parts)).alias("truncated"))).otherwise(
            F.struct(F.concat(F.substring(parts[0], 1, budget - 1), F.lit("…")).alias("text"), F.lit(1).alias("n_lines"), F.lit(True).alias("truncated"))
        )

    return bound(lines(content), lambda parts: bound(F.aggregate(parts, start, step)["n"], lambda n: cut(parts, n)))


def gutter(parts: Column, first: Column) -> Column:
    """Lines with right-aligned numbers, two spaces behind each."""

    def numbered(parts: Column) -> Column:
        width = F.length((first + F.size(parts) - 1).cast("string"))
        return bound(width, lambda w: F.transform(parts, lambda line, i: F.concat(F.lpad((first + i).cast("string"), w, F.lit(" ")), F.lit("  "), line)))

    return join_lines(bound(parts, numbered))


def strip_gutter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^ *\d+  ", "")


def clamp_at_word(text: Column, most: int) -> Column:
    """At most so many characters, ending at a word where there is one."""
    cut = F.substring(text, 1, most)
    word = F.regexp_extract(cut, r"^(?s)(.*) ", 1)
    return F.when(F.length(text) <= most, text).when(word != "", word).otherwise(cut)


def slug(text: Column) -> Column:
    """Kebab case of letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squash(text: Column, most: int) -> Column:
    """White space runs as one blank, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def base64url(token: Column) -> Column:
    return F.unbase64(F.translate(token, "-_", "+/")).cast("string")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(r"\b(" + "|".join(words) + r")\b")


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Lines that two ranges share."""
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1)


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Lines between two ranges; 0 when they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a1, b1) - F.least(a2, b2))
