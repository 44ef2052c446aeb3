"""Which lines of an excerpt explain most: points for what a line does, for what the question is about, and for a line's role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of lines and questions with their points, by which equal lines get equal scores.
#: What a line does: points, pattern.
BEHAVIOUR = (
    (30, r"\b(await|return|throw|yield)\b"),
    (35, r"(?i)\b(stream|send|emit|publish|subscribe|listen|event)\w*\s*\("),
    (40, r"(?i)\b(abort|cancel|timeout|disconnect|close)\b"),
    (45, r"\.\s*on\s*\("),
    (35, r"\.(upsert|insert|delete|add|write|save|query|watch|close|emit|send|read|open|connect)\s*\("),
    (25, r"\b(onEvent|callback|handler|listener)\b"),
    (8, r"\b(if|try|catch|switch|case)\b"),
    (-25, r"^(?:import\b|//|/\*|\*)"),
)
#: What a line and the question share: pattern of the line, pattern of the question, points with and without the latter.
CONCEPTS = (
    (r"(?i)\b(stream|send|emit|publish|subscribe|listen|event)\w*\s*\(", r"\b(sse|stream|streaming|abort|cancel|disconnect|client)\b", 80, 45),
    (r"(?i)\babort\b|\.abort\s*\(|\bcancel\b|\.cancel\s*\(", r"\b(abort|cancel|disconnect|client|timeout)\b", 70, 30),
    (r"(?i)\b(cache|memo|replay|prior|history)\w*|\.(get|set|has)\s*\(", r"\b(cache|replay|memory|prior|similar)\b", 55, 10),
    (r"(?i)\b(save|persist|insert|update|upsert|write|record)\w*\s*\(", r"\b(save|persist|history|memory|replay|write)\b", 58, 24),
    (r"(?i)\.(push|append|add)\s*\(", r"\b(collect|cache|save|persist|event|stream|list|array)\b", 40, 12),
    (r"(?i)\b(req|request|body|json|response|status)\b", r"\b(request|response|json|api|route|error|invalid)\b", 55, 24),
)
LOGGING, LOGGING_QUESTION = "incidental logging", r"\b(log|logging|diagnostic|debug|error|invalid|failure|warn)\b"
#: What a role teaches: role, pattern of the question (none: always), points with and without it.
TEACHES = (
    ("entrypoint", "", 45, 45),
    ("stream lifecycle", r"\b(stream|streaming|event|events|client|server|response|lifecycle)\b", 70, 35),
    ("event bridge", r"\b(event|events|stream|streaming|producer|consumer|async|client)\b", 75, 35),
    ("cancellation", r"\b(cancel|abort|disconnect|client|lifecycle|stream)\b", 65, 25),
    ("persistence", r"\b(save|persist|history|memory|replay)\b", 54, 10),
    ("validation", r"\b(valid|invalid|payload|json|body|input|error|failure|bad request)\b", 44, 5),
    ("error boundary", r"\b(error|failure|fallback|exception|catch|invalid)\b", 38, 6),
    ("incidental logging", "", -80, -80),
    ("definition boundary", "", 25, 25),
    ("call boundary", "", 25, 25),
    ("iteration", r"\b(iterate|loop|stream|sequence|each|event)\b", 42, 12),
    ("branch", r"\b(branch|condition|case|choose|if|when|error)\b", 35, 8),
    ("output boundary", "", 22, 22),
)
FOR_AWAIT, SENDS = r"\bfor await\b", r"(?i)\b(stream|send|emit|publish|subscribe|listen|event)\w*\s*\("
#: Words that tell nothing of a line's relevance.
UNTELLING = (
    "const", "let", "var", "this", "return", "function", "class", "async", "await", "true", "false", "null", "undefined", "the", "and", "for", "with", "from", "into", "that", "then", "than",
    "what", "when", "where", "which", "who", "why", "how", "does", "work", "works", "system", "process", "implementation", "source", "code", "file", "component", "excerpt", "annotated", "question",
)
RELEVANT_TERMS, MOST_RELEVANCE = 32, 24
#: Endings at which an excerpt can stop.
CLEAN_STOP = r"[};)>]$"


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for part in parts:
        out = out + part
    return out


def behaviour_score(line: Column) -> Column:
    """Points for what a line does, whatever is asked; a blank or null line has none."""
    bare = F.trim(F.coalesce(line, F.lit("")))
    return F.when(bare == "", 0).otherwise(_sum([F.when(bare.rlike(p), n).otherwise(0) for n, p in BEHAVIOUR]))


def concept_score(line: Column, about: Column, role: Column | None = None) -> Column:
    """Points for what a line shares with the text about it, in lower case: the question, the intent and the caption."""
    parts = [F.when(line.rlike(p), F.when(about.rlike(a), yes).otherwise(no)).otherwise(0) for p, a, yes, no in CONCEPTS]
    if role is not None:
        parts.append(F.when(role == LOGGING, F.when(about.rlike(LOGGING_QUESTION), 22).otherwise(-70)).otherwise(0))
    return _sum(parts)


def teaching_score(line: Column, role: Column, about: Column) -> Column:
    """Points for a line's role, more where the question is about it."""
    parts = [F.when(role == name, F.when(about.rlike(a), yes).otherwise(no)).otherwise(0) for name, a, yes, no in TEACHES]
    return _sum([*parts, F.when(line.rlike(FOR_AWAIT), 35).otherwise(0), F.when(line.rlike(SENDS), 30).otherwise(0)])


def relevance_terms(*texts: Column) -> Column:
    """The words of texts, cut at humps, lower, without hyphens and underscores at their ends: the first 32 distinct ones of three letters
    or more that tell something."""
    some = F.concat_ws(" ", *[F.when(F.coalesce(t, F.lit("")) != "", t) for t in texts])
    words = F.regexp_extract_all(F.regexp_replace(some, r"([a-z0-9])([A-Z])", "$1 $2"), F.lit(r"[A-Za-z_$][\w$-]{2,}"), F.lit(0))
    clean = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[-_]+|[-_]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda w: (F.length(w) >= 3) & ~w.isin(*UNTELLING))), 1, RELEVANT_TERMS)


def relevance_score(line: Column, terms: Column) -> Column:
    """8 points for each long and 5 for each short term that a line holds, or whose beginning one of its words is; 24 at most."""
    low = F.lower(F.coalesce(line, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9]{3,}"), F.lit(0))
    begun = lambda t: (F.length(t) >= 6) & F.exists(words, lambda w: (F.length(w) < F.length(t)) & F.startswith(t, w))
    points = lambda t: F.when(F.contains(low, t), F.when(F.length(t) > 5, 8).otherwise(5)).when(begun(t), 5).otherwise(0)
    return F.least(F.aggregate(F.transform(terms, points), F.lit(0), lambda a, x: a + x), F.lit(MOST_RELEVANCE))


def callout_score(line: Column, noted: Column, role: Column, about: Column, terms: Column) -> Column:
    """What speaks for a callout on a line: one point, its annotation's score noted, and what it shares with the question; a blank line
    has none."""
    bare = F.trim(F.coalesce(line, F.lit("")))
    return F.when(bare == "", 0).otherwise(1 + F.coalesce(noted, F.lit(0)) + concept_score(bare, about, role) + relevance_score(line, terms))


def score_lines(lines: DataFrame) -> DataFrame:
    """lines (key, line_no, line, role, noted, question, intent, caption, path) with (anchor, teaching, score, boundary): what
    excerpt_windows weighs. score is the callout's points, not below 0, with the anchor's and twice the teaching's; a boundary
    is a blank line or one at which an excerpt can stop. Null roles, notes and texts are empty."""
    about = F.lower(F.concat_ws(" ", *[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("question", "intent", "caption")]))
    rows = lines.withColumn("_about", about).withColumn("_terms", relevance_terms(*[F.col(c) for c in ("question", "intent", "caption", "path")]))
    line, role = F.trim(F.coalesce("line", F.lit(""))), F.coalesce("role", F.lit(""))
    rows = rows.withColumn("anchor", behaviour_score(line)).withColumn("teaching", teaching_score(line, role, F.col("_about")))
    callout = callout_score(F.col("line"), F.col("noted"), role, F.col("_about"), F.col("_terms"))
    score = F.greatest(F.lit(0), callout) + F.col("anchor") + F.col("teaching") * 2
    return rows.withColumn("score", score.cast("double")).withColumn("boundary", (line == "") | line.rlike(CLEAN_STOP)).drop("_about", "_terms")
