"""The code graph: facts from lines, resolved imports, hubs, neighbours, and joins of facts with chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs, places
from ..functions import text as T
from ..functions.patterns import LINE_FACTS
from .retrieval import ranked

FACTS_PER_FILE = 500


def _facts(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def line_facts(files: DataFrame, limit: int = FACTS_PER_FILE, languages: tuple[str, ...] = tuple(LINE_FACTS)) -> DataFrame:
    """(path, line_start, line_end, kind, name, target, detail) of (path, content): every match on every line, first by
    kind, name, target and line; at most limit facts of a file, in the order of lines. A corpus of few languages
    names them, for a smaller expression."""
    lang = places.language(F.col("path"))
    rows = files.select("path", lang.alias("lang"), F.posexplode(T.lines(F.col("content"))).alias("i", "line")).filter(F.col("lang").isin(*languages))
    every = []
    for language in languages:
        for kind, pattern in LINE_FACTS[language].items():
            names = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
            every.append(F.when(F.col("lang") == language, _facts(names, kind)))
    facts = F.flatten(F.filter(F.array(*every), lambda x: x.isNotNull()))
    out = rows.select("path", (F.col("i") + 1).alias("line_start"), F.trim("line").alias("detail"), F.explode(facts).alias("f"))
    out = out.select("path", "line_start", F.col("f.kind").alias("kind"), F.col("f.name").alias("name"), F.substring("detail", 1, 240).alias("detail"))
    out = out.groupBy("path", "kind", "name", "line_start").agg(F.min("detail").alias("detail"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line_start", "kind", "name"))
    kept = out.withColumn("_k", place).filter(F.col("_k") <= limit)
    return kept.select("path", "line_start", F.col("line_start").alias("line_end"), "kind", "name", F.when(F.col("kind") == "import", F.col("name")).alias("target"), "detail")


def search_text(facts: DataFrame) -> DataFrame:
    """facts with (search_text), which the graph leg searches."""
    return facts.withColumn("search_text", F.lower(F.concat_ws("\n", "path", "kind", "name", "target", "detail")))


def graph_score(kind: Column, haystack: Column, tokens: Column, family: Column | None = None, profile: Column | None = None) -> Column:
    """What a fact adds to its row: by its kind, by tokens that name the kind, and by tokens that it contains; five times whether its
    surface family is wanted, and four times its profile's score."""
    base = F.when(kind.isin("definition", "route", "storage", "entrypoint", "dependency"), 3.0).when(kind.isin("markup", "ui", "style", "style_rule"), 2.5).when(kind.isin("configuration", "import"), 2.0).otherwise(0.0)
    named = F.when(F.array_contains(tokens, F.lower(kind)), 4.0).otherwise(0.0) + F.when(F.array_contains(tokens, F.lit("route")) & (kind == "route"), 4.0).otherwise(0.0)
    styled = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, ("selector", "style", "css")))) & kind.startswith("style"), 4.0).otherwise(0.0)
    marked = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, ("html", "markup", "ui")))) & kind.isin("markup", "ui"), 4.0).otherwise(0.0)
    hits = F.aggregate(F.filter(tokens, lambda t: F.contains(haystack, t)), F.lit(0.0), lambda acc, t: acc + F.when(F.length(t) > 5, 2.0).otherwise(1.0))
    score = base + named + styled + marked + hits
    score = score if family is None else score + F.when(F.coalesce(family, F.lit(False)), 5.0).otherwise(0.0)
    return score if profile is None else score + profile * 4


def symbol_ranges(facts: DataFrame) -> DataFrame:
    """(path, name, line_start, line_end, place) of the definitions among facts, once each, by line and name."""
    own = facts.filter((F.col("kind") == "definition") & (F.coalesce("name", F.lit("")) != "") & F.col("line_start").isNotNull() & F.col("line_end").isNotNull())
    rows = own.select("path", "name", "line_start", "line_end").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("line_start", "line_end", "name")))


def named_symbol(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """(q, path, name, line_start, line_end): of each path the first of symbol_ranges that a term (q, term) names."""
    named = symbols.filter(F.col("line_end") >= F.col("line_start")).join(terms.select("q", F.lower("term").alias("low")).distinct(), F.lower("name") == F.col("low"))
    rest = F.min_by(F.struct("name", "line_start", "line_end"), "place")
    return named.groupBy("q", "path").agg(rest.alias("s")).select("q", "path", "s.*")


def import_edges(facts: DataFrame) -> DataFrame:
    """(path, specifier) of the imports among facts; all of them, for the order of rows says nothing of which to leave out."""
    own = facts.filter((F.col("kind") == "import") & (F.coalesce("target", F.lit("")) != "") & ~F.startswith("path", F.lit(places.DEPENDENCY_DOCS)))
    return own.select("path", F.col("target").alias("specifier"))


def known_paths(chunks: DataFrame) -> DataFrame:
    """(path) of stored chunks, once each."""
    return chunks.select("path").distinct()


# ---- imports


def resolve_imports(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, specifier, target): the file that an import (path, specifier) of paths (path) means; unknown ones are left out.

    A relative specifier is taken from its file's folder, as it stands and without extension. Another one is tried as it
    stands, with dots for slashes, and as the end of a path, of several the first by name. Every try is an equi-join.
    """
    bare = T.strip_extension(F.col("path"))
    parts = F.split(bare, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = paths.select("path").distinct().select(
        "path", F.explode(F.concat(F.array(F.struct(F.lit("exact").alias("kind"), F.col("path").alias("key")), F.struct(F.lit("bare").alias("kind"), bare.alias("key"))), F.transform(ends, lambda e: F.struct(F.lit("end").alias("kind"), e.alias("key"))))).alias("k")
    )
    lookup = keys.groupBy("k.kind", "k.key").agg(F.min("path").alias("target"))
    spec = F.col("specifier")
    folder = T.dirname(F.col("path"))
    inside = globs.normalise(F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), spec))
    relative = spec.startswith(".")
    dotted = F.replace(T.strip_extension(spec), F.lit("."), F.lit("/"))
    tries = lambda *xs: F.array(*[F.struct(F.lit(i).alias("order"), F.lit(kind).alias("kind"), key.alias("key")) for i, (kind, key) in enumerate(xs)])
    own = F.when(relative, tries(("exact", inside), ("bare", T.strip_extension(inside)), ("bare", inside))).otherwise(
        tries(("exact", spec), ("bare", spec), ("bare", F.replace(spec, F.lit("."), F.lit("/"))), ("end", T.strip_extension(spec)), ("end", F.replace(spec, F.lit("."), F.lit("/"))), ("end", dotted))
    )
    asked = edges.select("path", "specifier").distinct().select("path", "specifier", F.explode(own).alias("t")).select("path", "specifier", "t.order", "t.kind", "t.key").filter("key is not null")
    found = asked.join(lookup, ["kind", "key"]).groupBy("path", "specifier").agg(F.min_by("target", "order").alias("target"))
    return found.filter("path <> target")


def import_hubs(edges: DataFrame, limit: int = 5) -> DataFrame:
    """(path, wires, rank): the files that import most other files."""
    return wires(edges).orderBy(F.desc("wires"), "path").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("wires"), "path")))


def wires(edges: DataFrame) -> DataFrame:
    """(path, wires): how many files each one imports."""
    return edges.groupBy("path").agg(F.countDistinct("target").alias("wires"))


def needed_sides(seeds: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """(q, path, d, first, most) of seeds (q, path, seed_rank) and the numbers of neighbours (path, d, size) of files: each question's sides in
    the order of first, up to one with limit neighbours more than the question has seeds, which is most."""
    counted = seeds.withColumn("most", limit + F.count(F.lit(1)).over(Window.partitionBy("q")))
    each = counted.join(sizes, "path").withColumn("first", F.struct("seed_rank", "d"))
    last = F.min(F.when(F.col("size") >= F.col("most"), F.col("first"))).over(Window.partitionBy("q"))
    return each.withColumn("last", last).filter(F.col("last").isNull() | (F.col("first") <= F.col("last"))).select("q", "path", "d", "first", "most")


def import_neighbours(edges: DataFrame, seeds: DataFrame, limit: int = 8) -> DataFrame:
    """(q, path, direction, rank): files one import away from the seeds (q, path, seed_rank): what they import, then what
    imports them, in the order of seeds; each once and no seed itself.

    Of a file's neighbours on one side only the first limit + n by name can be in a result, where n is the number of seeds of the
    question: all others stand behind limit rows that are no seeds. For the same reason a side of so many neighbours is the last
    one that a question needs, and neither the seeds behind it nor their neighbours are joined."""
    largest = limit + seeds.groupBy("q").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    pairs = edges.select("path", F.col("target").alias("other")).distinct()
    sides = [pairs.withColumn("d", F.lit(0)), pairs.select(F.col("other").alias("path"), F.col("path").alias("other"), F.lit(1).alias("d"))]
    near = sides[0].unionByName(sides[1]).join(seeds.select("path").distinct(), "path", "left_semi")
    few = ranked(near, ["path", "d"], [F.col("other")], largest).withColumnRenamed("rank", "place")
    needed = needed_sides(seeds, few.groupBy("path", "d").agg(F.max("place").alias("size")), limit)
    found = needed.join(few, ["path", "d"]).filter(F.col("place") <= F.col("most"))
    both = found.groupBy("q", "other").agg(F.min("first").alias("first")).withColumnRenamed("other", "path").join(seeds.select("q", "path"), ["q", "path"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("first", "path"))
    best = both.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return best.select("q", "path", F.when(F.col("first.d") == 0, "imports").otherwise("imported_by").alias("direction"), "rank")


def architecture_spine(hubs: DataFrame, limit: int = 5) -> DataFrame:
    """(path, role, place) of hubs (path, wires): the best of each role in the fixed order of roles, then the rest by wires. Of a
    role no more than limit can be among them, so that the last sort sees few rows."""
    order = F.array_position(F.array(*map(F.lit, places.ROLES)), F.col("role"))
    best = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("wires"), "path"))
    few = hubs.withColumn("role", places.architecture_role(F.col("path"))).withColumn("nth", best).filter(F.col("nth") <= limit)
    turn = [F.col("nth") > 1, F.when(F.col("nth") == 1, order), F.desc("wires"), F.col("path")]
    return few.orderBy(*turn).limit(limit).select("path", "role", F.row_number().over(Window.orderBy(*turn)).alias("place"))


# ---- lines


def chunks_for_facts(facts: DataFrame, chunks: DataFrame, each: int = 2) -> DataFrame:
    """facts (path, fact_id, line_start, line_end) with (chunk_start, chunk_end, overlapping): up to each chunks that share a
    line with the fact, the first by line; a fact that meets none gets its file's first chunk, if there is one."""
    c = chunks.select("path", F.col("line_start").alias("chunk_start"), F.col("line_end").alias("chunk_end"))
    head = c.groupBy("path").agg(F.min(F.struct("chunk_start", "chunk_end")).alias("head"))
    meets = (F.col("chunk_start") <= F.col("line_end")) & (F.col("chunk_end") >= F.col("line_start"))
    hit = facts.join(c, "path").filter(meets)
    hit = hit.withColumn("_k", F.row_number().over(Window.partitionBy("fact_id").orderBy("chunk_start"))).filter(F.col("_k") <= each).drop("_k").withColumn("overlapping", F.lit(True))
    rest = facts.join(hit.select("fact_id"), "fact_id", "left_anti").join(head, "path").select(*facts.columns, F.col("head.chunk_start").alias("chunk_start"), F.col("head.chunk_end").alias("chunk_end"), F.lit(False).alias("overlapping"))
    return hit.select(*rest.columns).unionByName(rest)


def brace_ranges(lines: DataFrame) -> DataFrame:
    """(key, line_start, line_end) of lines (key, line_no, line): from each line that opens a brace at depth 0 to the first
    one that brings the depth back to 0, or the last. Quoted text does not count."""
    bare = F.regexp_replace("line", r"\"[^\"]*\"|'[^']*'", "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    w = Window.partitionBy("key").orderBy("line_no")
    depth = lines.select("key", "line_no", (count("{") - count("}")).alias("delta"), count("{").alias("opens")).withColumn("depth", F.sum("delta").over(w))
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    # seen from the end, so that each row adds itself to a running minimum
    behind = Window.partitionBy("key").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed = F.min(F.when(F.col("depth") <= 0, F.col("line_no"))).over(behind)
    return depth.withColumn("before", before).withColumn("line_end", F.coalesce(closed, F.max("line_no").over(behind))).filter("before <= 0 and opens > 0").select("key", F.col("line_no").alias("line_start"), "line_end")


def last_definition(lines: DataFrame, symbol: Column) -> DataFrame:
    """lines (key, line_no, ...) with (definition): the last symbol at or above each line."""
    return lines.withColumn("definition", F.last(symbol, ignorenulls=True).over(Window.partitionBy("key").orderBy("line_no")))


def enclosing_symbol(lines: DataFrame, symbols: DataFrame, least: int, most: int) -> DataFrame:
    """(key, line_no, name) of lines: the symbol (key, name, callable, s, e) around each whose span has least to most lines;
    callables first, then the smallest."""
    span = F.col("e") - F.col("s") + 1
    around = lines.join(symbols, "key").filter((F.col("line_no") >= F.col("s")) & (F.col("line_no") <= F.col("e")) & span.between(least, most))
    first = F.row_number().over(Window.partitionBy("key", "line_no").orderBy(F.desc("callable"), span, "s", "name"))
    return around.withColumn("_k", first).filter("_k = 1").select("key", "line_no", "name")
