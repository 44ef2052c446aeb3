"""What a lexer tells of source files: code without its strings and comments, nesting, definitions with their ranges, imports.

A language's lexemes are one alternation, by which the JVM cuts a whole file from left to right: the automaton of its regular
expression carries strings and comments over line ends. What follows works on lines in windows over a file, in linear time.
Files are (path, content); lines count from 1, and a carriage return before a line end is no part of the line.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places
from ..functions.patterns import LINE_FACTS
from ..sources.shared import settled

_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
_CHARACTER = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"
_TICKS = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`?"
_RAW_TICKS = r"`[^`]*+`?"
_TRIPLE = r'"""(?:.*?"""|.*+)' + "|" + r"'''(?:.*?'''|.*+)"
_SLASHES = r"//[^\n]*+|/\*(?:.*?\*/|.*+)"
_HASH = r"#[^\n]*+"
_SHELL_HASH = r"(?<![^\s;])#[^\n]*+"

#: Lexemes that are no code, by family, and the characters that one of them can begin with.
LEXEMES = {
    "python": (_TRIPLE, _HASH, _DOUBLE, _SINGLE),
    "shell": (_SHELL_HASH, _DOUBLE, _SINGLE),
    "lua": (r"--\[\[(?:.*?\]\]|.*+)", r"--[^\n]*+", _DOUBLE, _SINGLE),
    "script": (_SLASHES, _DOUBLE, _SINGLE, _TICKS),
    "go": (_SLASHES, _DOUBLE, _CHARACTER, _RAW_TICKS),
    "brace": (_SLASHES, _DOUBLE, _CHARACTER),
}
_STARTS = {"python": "\"'#", "shell": "\"'#", "lua": "\"'-", "script": "\"'`/", "go": "\"'`/", "brace": "\"'/"}
#: Languages by family; what is not named has no lexer.
FAMILIES = {
    "python": ("python",), "shell": ("bash", "yaml", "toml", "elixir"), "lua": ("lua",), "script": ("javascript", "typescript", "tsx", "php", "css", "solidity"), "go": ("go",),
    "brace": ("c", "cpp", "c-sharp", "java", "kotlin", "scala", "rust", "zig", "objc"),
}
INDENTED = ("python",)
#: What opens and closes a body, by language; braces elsewhere.
BODIES = {"lua": r"\b(?:function|if|do|repeat|end|until)\b", "elixir": r"\bdo\b(?!:)|\bfn\b|\bend\b"}
CLOSERS = ("}", "end", "until")
#: How many lines below a definition its body may open.
BODY_WITHIN = 16


#: A string that can be the target of an import: one word in quotes.
_TARGET = r"^(?:\"[^\s\"'`()]+\"|'[^\s\"'`()]+'|`[^\s\"'`()]+`)$"


def _blanked(content: Column, family: str, targets: bool) -> Column:
    """content with blanks for comments, and for strings but their first quote, with targets for those that are no target of an
    import; line ends stay where they are."""
    starts = _STARTS[family]
    lexeme = f"(?s)(?:{'|'.join(LEXEMES[family])})|[^{starts}]++|."
    quiet = lambda t: (F.length(t) > 1) & F.substring(t, 1, 1).isin(*starts)
    blank = lambda t: F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, "[^\n]", " ")).otherwise(F.repeat(F.lit(" "), F.length(t)))
    quoted = lambda t: F.concat(F.lit('"'), blank(F.substring(t, 2, 1 << 30)))
    kept = lambda t: t.rlike(_TARGET) if targets else F.lit(False)
    tokens = F.regexp_extract_all(content, F.lit(lexeme), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(~quiet(t) | kept(t), t).when(F.substring(t, 1, 1).isin("/", "#", "-"), blank(t)).otherwise(quoted(t))), "")


def code(content: Column, language: Column, targets: bool = False) -> Column:
    """The code of a text: comments as blanks, strings as a quote and blanks (with targets, words in quotes stay), lines in their
    places. Null for a language without a lexer."""
    out = F.lit(None).cast("string")
    for family, languages in FAMILIES.items():
        out = F.when(language.isin(*languages), _blanked(content, family, targets)).otherwise(out)
    return out


def plain_lines(files: DataFrame) -> DataFrame:
    """(path, lang, line_no, line) of code_lines, for what reads no code: nothing is lexed."""
    known = [x for xs in FAMILIES.values() for x in xs]
    text = F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    rows = files.select("path", places.language(F.col("path")).alias("lang"), text.alias("text"))
    # other files have no lines; a filter would be pushed down to whatever rows the files are made from, and match paths there
    own = F.when(F.col("lang").isin(*known), F.split("text", "\n", -1))
    return rows.select("path", "lang", F.posexplode(own).alias("i", "line")).select("path", "lang", (F.col("i") + 1).alias("line_no"), "line")


def code_lines(files: DataFrame, targets: bool = False) -> DataFrame:
    """(path, lang, line_no, line, code, n_lines) of files whose language has a lexer. Null content is an empty text, of one line."""
    lang = places.language(F.col("path"))
    # the code of other files is null, so that they have no lines; a filter would match paths for each row that files are made from
    plain = files.select("path", lang.alias("lang"), F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\n")).alias("text"))
    cut = lambda c: F.split(c, "\n", -1)
    both = plain.select("path", "lang", cut(F.col("text")).alias("a"), cut(code(F.col("text"), F.col("lang"), targets)).alias("b"))
    rows = both.select("path", "lang", F.size("a").alias("n_lines"), F.posexplode(F.arrays_zip("a", "b")).alias("i", "x"))
    return rows.select("path", "lang", (F.col("i") + 1).alias("line_no"), F.col("x.a").alias("line"), F.col("x.b").alias("code"), "n_lines")


def _count(text: Column, characters: str) -> Column:
    """How many of some ASCII characters a text holds. A text without a character is searched, not made again."""
    return reduce(Column.__add__, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters])


def nesting(lines: DataFrame) -> DataFrame:
    """lines of code_lines with (depth_before, depth): how many brackets of any kind are open before and behind a line."""
    change = _count(F.col("code"), "([{") - _count(F.col("code"), ")]}")
    depth = lines.withColumn("depth", F.sum(change).over(Window.partitionBy("path").orderBy("line_no")))
    return depth.withColumn("depth_before", F.col("depth") - change)


def marks(lines: DataFrame) -> Column:
    """What opens or closes a body on a line of code_lines, in order."""
    out = F.regexp_extract_all("code", F.lit(r"[{}]"), F.lit(0))
    for lang, pattern in BODIES.items():
        out = F.when(F.col("lang") == lang, F.regexp_extract_all("code", F.lit(pattern), F.lit(0))).otherwise(out)
    return out


def body_pairs(lines: DataFrame) -> DataFrame:
    """(path, line_no, i, closes) of lines (path, line_no, n_lines, marks): each opener of a body, i-th on its line, and the line of what
    closes it, or the last line. Marks of one depth open and close in turns, so that the next one of the depth is the partner."""
    rows = lines.select("path", "line_no", "n_lines", F.posexplode("marks").alias("i", "mark")).withColumn("opens", ~F.col("mark").isin(*CLOSERS))
    depth = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(Window.partitionBy("path").orderBy("line_no", "i"))
    rows = rows.withColumn("depth", depth).withColumn("level", F.when(F.col("opens"), F.col("depth")).otherwise(F.col("depth") + 1))
    turn = Window.partitionBy("path", "level").orderBy("line_no", "i")
    partner = F.when(~F.lead("opens").over(turn), F.lead("line_no").over(turn))
    return rows.withColumn("closes", F.coalesce(partner, F.col("n_lines"))).filter("opens").select("path", "line_no", "i", "closes")


def next_at_most(indents: np.ndarray) -> np.ndarray:
    """For each place the next one whose value is no larger, or the length. Each place enters and leaves the stack once."""
    out, stack = np.full(len(indents), len(indents), np.int32), []
    for i, indent in enumerate(indents.tolist()):
        while stack and indents[stack[-1]] >= indent:
            out[stack.pop()] = i
        stack.append(i)
    return out


def indent_ends(lines: DataFrame) -> DataFrame:
    """(path, line_no, closes) of lines of code (path, line_no, indent, depth_before): the last one before the next one that is indented no
    deeper. Lines that begin inside a string or brackets belong to the line before them."""
    begins = F.when(F.col("depth_before") <= 0, F.col("line_no"))
    owner = F.last(begins, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no"))
    rows = lines.withColumn("own", owner).groupBy("path", "own").agg(F.min_by("indent", "line_no").alias("indent"), F.max("line_no").alias("upto")).filter("own is not null")
    # one row a file: numbers of lines and their indents, no text
    packed = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("own", "indent", "upto"))).alias("x"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, x in zip(batch.column("path").to_pylist(), batch.column("x"), strict=True):
                own, indents, upto = (x.values.field(k).to_numpy(zero_copy_only=False) for k in ("own", "indent", "upto"))
                yield pa.RecordBatch.from_pydict({"path": [path] * len(own), "line_no": pa.array(own, pa.int32()), "closes": pa.array(upto[next_at_most(indents) - 1], pa.int32())})

    return packed.mapInArrow(ends, "path string, line_no int, closes int")


#: For each language what a trimmed line of code defines: (kind, pattern), the first that matches counts.
DEFINITIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "python": (
        ("function", r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("class", r"^class\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
    ),
    "go": (
        ("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("type", r"^type\s+([A-Za-z_][A-Za-z0-9_]*)\s+(?:struct|interface|func|\w+)"),
    ),
    "php": (
        ("function", r"^(?:public|private|protected|static|final|abstract|\s)*function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("class", r"^(?:final\s+|abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("interface", r"^interface\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("trait", r"^trait\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("enum", r"^enum\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
    ),
    "kotlin": (
        ("function", r"^(?:public|private|protected|internal|suspend|inline|tailrec|operator|infix|\s)*fun\s+(?:[A-Za-z_][A-Za-z0-9_]*\.)?([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("class", r"^(?:data\s+|sealed\s+|open\s+|abstract\s+|inner\s+|enum\s+)*class\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("interface", r"^interface\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("object", r"^(?:companion\s+)?object\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
    ),
    "zig": (
        ("function", r"^(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("type", r"^(?:pub\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:struct|enum|union|opaque)\b"),
    ),
    "lua": (
        ("function", r"^function\s+([A-Za-z_][A-Za-z0-9_.:]*)\s*\("),
        ("function", r"^local\s+function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ),
    "elixir": (
        ("module", r"^defmodule\s+([A-Z][A-Za-z0-9_.]*)\s+do\b"),
        ("function", r"^defp?\s+([A-Za-z_][A-Za-z0-9_!?]*)\b"),
        ("macro", r"^defmacro\s+([A-Za-z_][A-Za-z0-9_!?]*)\b"),
    ),
    "bash": (
        ("function", r"^([A-Za-z_][A-Za-z0-9_]*)\s*\(\)\s*\{"),
        ("function", r"^function\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
    ),
}
#: Definitions of the languages above are by those patterns; these are this library's own.
DEFINITIONS["javascript"] = DEFINITIONS["typescript"] = DEFINITIONS["tsx"] = (
    ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("function", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|[\w$]+\s*=>)"),
)
DEFINITIONS["rust"] = (
    ("function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"),
    ("type", r"^(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union|mod)\s+(\w+)"),
)
DEFINITIONS["java"] = (("class", r"^(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)+[\w<>\[\], ?.]+\s+(\w+)\s*\([^;]*\)\s*(?:throws\b[^{]+)?\{?$"))


def symbol(trimmed: Column, language: Column, languages: tuple[str, ...] = tuple(DEFINITIONS)) -> Column:
    """struct(kind, name) of the definition on a trimmed line of code; null without one."""
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for lang, rules in DEFINITIONS.items():
        if lang in languages:
            found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract(trimmed, pattern, 1).alias("name")) for kind, pattern in rules])
            out = F.when(language == lang, F.try_element_at(F.filter(found, lambda x: x["name"] != ""), F.lit(1))).otherwise(out)
    return out


def definitions(files: DataFrame, languages: tuple[str, ...] = tuple(DEFINITIONS)) -> DataFrame:
    """(path, kind, name, line_start, line_end) of the definitions in files.

    A definition ends where its body does: in languages of indented blocks at the last line of code that is indented deeper,
    in others with what closes the first body opened on its line or, before another definition, within BODY_WITHIN
    lines below; one without a body ends on its line, and one whose body stays open with the file. Strings and comments
    neither define nor close anything. The first definition of a line counts. A corpus of few languages names them, for a
    smaller expression.
    """
    lines = nesting(code_lines(files))
    flat = F.col("lang").isin(*INDENTED)
    coded = F.trim("code") != ""
    # what follows reads no text: lines are lexed once, and the rest works on this small table
    outline = settled(lines.filter(coded).select(
        "path", "lang", "line_no", "n_lines", "depth_before", symbol(F.trim("code"), F.col("lang"), languages).alias("s"),
        F.when(flat, F.array().cast("array<string>")).otherwise(marks(lines)).alias("marks"), F.when(flat, F.length(F.regexp_extract("code", r"^(\s*)", 1))).alias("indent"),
    ))
    found = outline.filter("s is not null").select("path", "lang", "line_no", "s.kind", "s.name")
    indented = found.filter(flat).join(indent_ends(outline.filter(flat)), ["path", "line_no"], "left")
    indented = indented.select("path", "kind", "name", F.col("line_no").alias("line_start"), F.coalesce("closes", "line_no").alias("line_end"))
    curly = found.filter(~flat)
    opened = body_pairs(outline.filter(~flat)).groupBy("path", "line_no").agg(F.min_by("closes", "i").alias("closes"))
    both = curly.join(opened, ["path", "line_no"], "full").withColumn("body", F.struct("line_no", "closes"))
    # seen from the end of the file, the last body at or above a row is the next one at or below it
    back = Window.partitionBy("path").orderBy(F.desc("line_no"))
    both = both.withColumn("next", F.last(F.when(F.col("closes").isNotNull(), F.col("body")), ignorenulls=True).over(back))
    other = F.lag(F.last(F.when(F.col("name").isNotNull(), F.col("line_no")), ignorenulls=True).over(back)).over(back)
    both = both.withColumn("other", other).filter("name is not null")
    near = (F.col("next.line_no") < F.col("line_no") + BODY_WITHIN) & (F.col("other").isNull() | (F.col("next.line_no") < F.col("other")))
    ends = both.select("path", "kind", "name", F.col("line_no").alias("line_start"), F.when(F.coalesce(near, F.lit(False)), F.col("next.closes")).otherwise(F.col("line_no")).alias("line_end"))
    return indented.unionByName(ends)


def imports(files: DataFrame) -> DataFrame:
    """(path, target, line_no) of the imports of files, by the patterns of their languages over lines without comments and without
    strings that hold more than a word."""
    lines = code_lines(files, targets=True)
    found = F.array().cast("array<string>")
    for lang, rules in LINE_FACTS.items():
        if "import" in rules:
            found = F.when(F.col("lang") == lang, F.regexp_extract_all("code", F.lit(rules["import"]), F.lit(1))).otherwise(found)
    # in Go a list of imports stands in parentheses, where any line else could be a string alone
    opens = F.when(F.col("code").rlike(r"^\s*import\s*\("), True).when(F.col("code").rlike(r"^\s*\)"), False)
    listed = F.coalesce(F.last(opens, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no")), F.lit(False))
    rows = lines.withColumn("listed", (F.col("lang") != "go") | listed | F.col("code").rlike(r"^\s*import\b")).filter("listed")
    return rows.select("path", F.explode(found).alias("target"), "line_no").filter("target <> ''")


def tree_facts(files: DataFrame) -> DataFrame:
    """(path, line_start, line_end, kind, name, target, detail): definitions with their ranges and imports, as facts of the code graph.
    kind is definition or import; detail names the kind of definition."""
    none = F.lit(None).cast("string")
    own = definitions(files).select("path", "line_start", "line_end", F.lit("definition").alias("kind"), "name", none.alias("target"), F.col("kind").alias("detail"))
    into = imports(files).select("path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.lit("import").alias("kind"), F.col("target").alias("name"), "target", none.alias("detail"))
    return own.unionByName(into)
