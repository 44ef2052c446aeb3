"""Notes on lines of code: what a line does, what it names, how much it explains. A language is a row of rules; one operator applies
them all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import syntax

MOST_FACTS = 8

# Patterns, keywords, points and sentences, by which equal lines get equal notes.
#: Points of a line, by style: for a symbol, a binding, a call, an output, a branch or loop, an await, a mark of doubt at its end.
POINTS = {
    "curly": {"symbol": 25, "binding": 20, "call": 30, "output": 35, "control": 20, "await": 16, "doubt": 10},
    "block": {"symbol": 25, "binding": 20, "call": 28, "output": 30, "control": 18},
    "python": {"symbol": 25, "binding": 20, "call": 30, "output": 35, "control": 18},
}
CONFIG_POINTS = 20
#: Sentences, with the places of a name, a kind and a language.
INTRODUCES = "Introduces {name}, the {kind} this {language} excerpt is explaining."
BINDS = {"curly": "Binds {name} so later {language} code in this scope can use it.", "block": "Stores {name} so later {language} code in this scope can use it."}
CONTROLS = "Controls what leaves this {language} scope or how it stops executing."
PYTHON_INTRODUCES = "Introduces {name}, the {kind} this excerpt is explaining."
PYTHON_STORES = "Stores {name} so later Python logic in this scope can use it."
PYTHON_RETURNS = "Returns the value that leaves this Python scope."
PYTHON_RAISES = "Raises an error so the failure path is explicit instead of continuing silently."
SETS = "Sets {name}, a configuration value consumed by code or tooling."
STORIES = (
    (r"\b(request|response|route|handler|controller|endpoint)\b", "This {language} excerpt participates in a request or handler flow."),
    (r"\b(save|persist|insert|update|query|select|repository|database|store)\b", "It reads or writes state that other {language} code depends on."),
    (r"\b(error|exception|throw|raise|catch|rescue|result|failure)\b", "The excerpt includes a failure path that changes how execution continues."),
)
CURLY_CALL = r"\b([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\s*\("
BLOCK_CALL = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\s*(?:\(|$)"
PYTHON_CALL = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\s*\("
PUNCTUATION = r"^[()\[\]{};,]+$"


@dataclass(frozen=True)
class Rules:
    """How a language's lines are read. Definitions are those of syntax.DEFINITIONS."""

    name: str
    style: str
    bindings: tuple[str, ...] = ()
    call: str = CURLY_CALL
    keywords: tuple[str, ...] = ()
    comment: str = r"^//"
    branch: str = r"\b(if|else|switch|case|match|catch|guard|when)\b"
    iteration: str = r"\b(for|while|loop|foreach)\b"
    output: str = r"\b(return|yield|throw|raise|break|continue)\b"
    block_end: str = r"^end\b"
    separator: str = ":"


LANGUAGES: dict[str, Rules] = {
    "go": Rules(
        "Go", "curly", (r"^([A-Za-z_][A-Za-z0-9_]*)\s*:=", r"^(?:var|const)\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        keywords=("if", "for", "switch", "select", "go", "defer", "return", "range"), output=r"\b(return|panic|continue|break|fallthrough)\b",
    ),
    "php": Rules(
        "PHP", "curly", (r"^\$([A-Za-z_][A-Za-z0-9_]*)\s*=", r"^(?:public|private|protected|static|\s)*\$([A-Za-z_][A-Za-z0-9_]*)\s*="),
        call=r"\b([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)?(?:->[A-Za-z_][A-Za-z0-9_]*)?)\s*\(", keywords=("if", "for", "foreach", "while", "switch", "catch", "return", "throw", "new"),
    ),
    "kotlin": Rules("Kotlin", "curly", (r"^(?:val|var)\s+([A-Za-z_][A-Za-z0-9_]*)\b",), keywords=("if", "for", "while", "when", "catch", "return", "throw")),
    "zig": Rules(
        "Zig", "curly", (r"^(?:const|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=",), keywords=("if", "for", "while", "switch", "return", "try", "catch", "defer", "errdefer"),
        output=r"\b(return|try|catch|break|continue|unreachable)\b",
    ),
    "lua": Rules(
        "Lua", "block", (r"^(?:local\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=",), call=BLOCK_CALL, keywords=("if", "then", "else", "elseif", "for", "while", "repeat", "until", "function", "local", "end", "return"),
        comment=r"^--", branch=r"\b(if|elseif|else)\b", iteration=r"\b(for|while|repeat|until)\b", output=r"\b(return|error)\b",
    ),
    "elixir": Rules(
        "Elixir", "block", (r"^([A-Za-z_][A-Za-z0-9_]*)\s*=",), call=BLOCK_CALL, keywords=("if", "unless", "case", "cond", "for", "with", "def", "defp", "defmodule", "do", "end", "raise"),
        comment=r"^#", branch=r"\b(if|unless|case|cond|with)\b", iteration=r"\b(for|Enum\.)\b", output=r"\b(raise|throw|exit)\b",
    ),
    "bash": Rules(
        "shell", "block", (r"^([A-Za-z_][A-Za-z0-9_]*)=",), call=r"^([A-Za-z_][A-Za-z0-9_.:-]*)\b", keywords=("if", "then", "else", "elif", "fi", "for", "while", "do", "done", "case", "esac", "function"),
        comment=r"^#", branch=r"\b(if|elif|else|case)\b", iteration=r"\b(for|while|until|select)\b", output=r"\b(return|exit|echo|printf)\b", block_end=r"^(fi|done|esac|\})$",
    ),
    "python": Rules(
        "Python", "python", (r"^([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^=]+)?=\s*.+$",), call=PYTHON_CALL, keywords=("if", "for", "while", "with", "except", "return", "await"), comment=r"^#",
        branch=r"\b(if|elif|else|match|case)\b", iteration=r"\b(for|while)\b", output=r"\b(return|raise|yield|await)\b",
    ),
    "yaml": Rules("YAML", "config", comment=r"^#|^//"),
    "toml": Rules("TOML", "config", comment=r"^#|^//", separator="="),
}
AWAIT = r"\b(await|async)\b"
#: Words before a call, and bindings of one, that are no part of its name.
BEFORE_CALL = (r"^(?:return|await|try|throw|raise|yield)\s+", r"^(?:let|var|const|auto|final|val|mut)\s+[A-Za-z_][A-Za-z0-9_]*\s*=\s*")
PYTHON_BEFORE_CALL = (r"^(?:return|await)\s+",)


def _first(trimmed: Column, patterns: tuple[str, ...]) -> Column:
    """What the first matching pattern names; null without one. As with syntax.symbol, the lambda keeps the projection out of whole-stage
    code, where all languages' rules would be one method, too long for the JVM to compile."""
    found = F.array(*[F.regexp_extract(trimmed, p, 1) for p in patterns])
    return F.try_element_at(F.filter(found, lambda x: x != ""), F.lit(1))


def _sentence(template: str, language: str, name: Column | None = None, kind: Column | None = None) -> Column:
    out = F.lit(template.replace("{language}", language))
    for place, value in (("{name}", name), ("{kind}", kind)):
        out = out if value is None else F.replace(out, F.lit(place), value)
    return out


#: What a line says, as _says finds it.
SAYS = ("binding", "call", "entry", "output", "branch", "iteration", "control", "await", "doubt", "returns", "error", "raises", "worthy")


def _says(rules: Rules, line: Column) -> Column:
    """SAYS of a trimmed line, as a struct: each pattern is matched once, and what follows reads its fields. Without a call or entry those are empty."""
    nothing, no = F.lit(None).cast("string"), F.lit(False)
    said = {k: nothing if k in ("binding", "call", "entry") else no for k in SAYS}
    if rules.style == "config":
        said["entry"] = F.regexp_extract(line, rf"^[\"']?([A-Za-z0-9_.-]+)[\"']?\s*{rules.separator}\s*(.+)$", 1)
        said["worthy"] = ~line.rlike(r"^[{}\[\],]+$") & ~line.rlike(rules.comment)
    else:
        python = rules.style == "python"
        source = line
        for pattern in PYTHON_BEFORE_CALL if python else BEFORE_CALL:
            source = F.regexp_replace(source, pattern, "")
        said |= {"binding": _first(line, rules.bindings), "call": F.regexp_extract(source, rules.call, 1), "output": line.rlike(rules.output), "branch": line.rlike(rules.branch), "iteration": line.rlike(rules.iteration), "doubt": line.rlike(r"[?!];?$")}
        if "await" in POINTS[rules.style]:
            said["await"] = line.rlike(AWAIT)
        if python:
            said |= {"control": line.rlike(r"\b(if|elif|else|match|case|for|while|try|except|finally)\b"), "returns": line.rlike(r"\breturn\b"), "error": line.rlike(r"\b(raise|except)\b"), "raises": line.rlike(r"\braise\b")}
        said["worthy"] = ~line.rlike(rules.comment) & ~line.rlike(r"^[()\[\]{},:]+$" if python else PUNCTUATION)
        if rules.style == "block":
            said["worthy"] = said["worthy"] & ~line.rlike(rules.block_end)
    return F.struct(*[said[k].alias(k) for k in SAYS])


def _call(rules: Rules, called: Column) -> Column:
    """What is called, without keywords."""
    if rules.style == "config":
        return F.lit(None).cast("string")
    return F.when((called != "") & ~(called if rules.style == "python" else F.lower(called)).isin(*rules.keywords), called)


def _parts(rules: Rules, says: Column, call: Column, symbol: Column) -> dict[str, Column]:
    """role, note, score of a line by what it says, calls and defines."""
    if rules.style == "config":
        entry = F.nullif(says["entry"], F.lit(""))
        return {"role": F.when(entry.isNotNull(), "configuration entry").otherwise(""), "note": F.coalesce(_sentence(SETS, rules.name, entry), F.lit("")), "score": F.when(entry.isNotNull(), CONFIG_POINTS).otherwise(0)}
    python, binding = rules.style == "python", says["binding"]
    output = says["returns"] if python else says["output"]
    role = F.when(symbol.isNotNull(), F.concat(symbol["kind"], F.lit(" boundary"))).when(output, "output boundary")
    if python:
        role = role.when(says["error"], "error boundary")
    role = role.when(says["branch"], "branch").when(says["iteration"], "iteration").when(binding.isNotNull(), "state/data").when(call.isNotNull(), "call boundary").otherwise("supporting statement")
    control = says["control"] if python else says["branch"] | says["iteration"]
    held = {"symbol": symbol.isNotNull(), "binding": binding.isNotNull(), "call": call.isNotNull(), "output": says["output"], "control": control, "await": says["await"], "doubt": says["doubt"]}
    score = F.lit(0)
    for what, points in POINTS[rules.style].items():
        score = score + F.when(held[what], points).otherwise(0)
    if python:
        note = F.when(symbol.isNotNull(), _sentence(PYTHON_INTRODUCES, rules.name, symbol["name"], symbol["kind"])).when(binding.isNotNull(), _sentence(PYTHON_STORES, rules.name, binding))
        note = note.when(call.isNotNull(), "").when(output, PYTHON_RETURNS).when(says["raises"], PYTHON_RAISES).otherwise("")
    else:
        note = F.when(symbol.isNotNull(), _sentence(INTRODUCES, rules.name, symbol["name"], symbol["kind"])).when(binding.isNotNull(), _sentence(BINDS[rules.style], rules.name, binding))
        note = note.when(says["output"], _sentence(CONTROLS, rules.name)).otherwise("")
    return {"role": role, "note": note, "score": score}


def annotate(lines: DataFrame, facts: DataFrame | None = None, languages: tuple[str, ...] = tuple(LANGUAGES)) -> DataFrame:
    """(path, line_no, role, facts, note, score, worthy) of lines (path, lang, line_no, line), for the languages that have rules; a corpus of
    few of them names those, for a smaller expression.

    facts of a line are those given for it (path, line_start, kind, name), by kind and name, then what the line defines,
    assigns and calls, and the last definition above it; each once, eight at most. A blank line has no role, note, score or
    fact and explains nothing. Null lines count as blank.
    """
    trimmed = F.regexp_replace(F.coalesce("line", F.lit("")), r"^\s+|\s+$", "")
    rows = lines.filter(F.col("lang").isin(*languages)).select("path", "lang", "line_no", trimmed.alias("trimmed"))
    rows = rows.withColumn("symbol", syntax.symbol(F.col("trimmed"), F.col("lang"), languages))
    rows = rows.withColumn("around", F.last("symbol", ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no")))
    if facts is not None:
        named = F.concat_ws(": ", "kind", "name")
        told = facts.filter("name <> ''").groupBy("path", F.col("line_start").alias("line_no")).agg(F.array_sort(F.collect_set(F.struct("kind", "name", named.alias("text")))).alias("told"))
        rows = rows.join(told.select("path", "line_no", F.col("told.text").alias("told")), ["path", "line_no"], "left")
    else:
        rows = rows.withColumn("told", F.array().cast("array<string>"))
    symbol, blank = F.col("symbol"), F.col("trimmed") == ""
    known = {lang: rules for lang, rules in LANGUAGES.items() if lang in languages}

    def pick(of: dict[str, Column]) -> Column:
        out = F.lit(None)
        for lang, value in of.items():
            out = F.when(F.col("lang") == lang, value).otherwise(out)
        return out

    # each step reads columns of the one before, so that a line meets each pattern once
    rows = rows.withColumn("says", pick({lang: _says(rules, F.col("trimmed")) for lang, rules in known.items()}))
    rows = rows.withColumn("call", pick({lang: _call(rules, F.col("says.call")) for lang, rules in known.items()}))
    by_language = {lang: _parts(rules, F.col("says"), F.col("call"), symbol) for lang, rules in known.items()}
    out = rows.select("path", "line_no", "trimmed", "symbol", "around", "told", "call", "says.binding", F.nullif("says.entry", F.lit("")).alias("entry"), "says.worthy", *[pick({lang: parts[k] for lang, parts in by_language.items()}).alias(k) for k in ("role", "note", "score")])
    label = lambda text, c: F.when(c.isNotNull(), F.concat(F.lit(text), c))
    inside = F.when(F.col("around.name") != F.coalesce("symbol.name", F.lit("")), F.col("around.name"))
    own = F.array(label("configuration: ", F.col("entry")), label("definition: ", F.col("symbol.name")), label("assigns: ", F.col("binding")), label("calls: ", F.col("call")), label("inside: ", inside))
    told = F.coalesce("told", F.array().cast("array<string>"))
    every = F.slice(F.array_distinct(F.concat(told, F.filter(own, lambda x: x.isNotNull()))), 1, MOST_FACTS)
    none = F.array().cast("array<string>")
    return out.select(
        "path", "line_no", F.when(blank, "").otherwise(F.col("role")).alias("role"), F.when(blank, none).otherwise(every).alias("facts"), F.when(blank, "").otherwise(F.col("note")).alias("note"),
        F.when(blank, 0).otherwise(F.col("score")).alias("score"), (F.col("worthy") & ~blank).alias("worthy"),
    )


def story(text: Column, language: str) -> Column:
    """What an excerpt, with the question and caption around it, takes part in: a sentence for each family of words; empty without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat_ws(" ", *[F.when(low.rlike(pattern), sentence.replace("{language}", language)) for pattern, sentence in STORIES])


#: Roles by the types of syntax nodes that a line holds; the first that matches counts.
NODE_ROLES = (
    (r"function|method|class|struct|trait|interface|module", "definition boundary"), (r"call|invocation", "call boundary"), (r"assignment|variable|declaration|declarator", "state/data"),
    (r"if|match|switch|case|conditional", "branch"), (r"for|while|loop|iterator", "iteration"), (r"return|yield", "output boundary"),
)


def role_of_nodes(types: Column) -> Column:
    """The role of a line by the types of its nodes; empty if none tells."""
    out = F.lit("")
    for pattern, role in reversed(NODE_ROLES):
        out = F.when(F.exists(types, lambda t: F.lower(t).rlike(pattern)), role).otherwise(out)
    return F.coalesce(out, F.lit(""))
