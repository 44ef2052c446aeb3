"""Files as a table: scans, text policy, line reads, listing and search of lines."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, places
from ..functions import text as T

MOST_BYTES = 1_000_000
READ_LINES, GREP_HITS, GREP_CHARS, LIST_ENTRIES, MANIFESTS = 200, 30, 220, 100, 80


def scan_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, size_bytes, bytes) of the files under root, with paths relative to it. Globs are applied to the paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*" + base.replace("\\", "\\\\").replace(".", "\\.") + "/", "")
    files = found.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("bytes"))
    if include:
        files = files.filter(globs.matches(F.col("path"), include))
    return files.filter(~globs.matches(F.col("path"), exclude)) if exclude else files


def looks_binary(data: Column) -> Column:
    """Of the first 4096 bytes: any NUL, or more than 8 % control bytes besides tab and line ends."""
    head = F.substring(data, 1, 4096)
    text = F.decode(head, "ISO-8859-1")
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x01-\x08\x0B\x0C\x0E-\x1F]", ""))
    return (F.instr(text, "\0") > 0) | (control > 0.08 * F.length(text))


def text_policy(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files of (path, size_bytes, bytes) with (content, skip_reason): too_large, binary, or null with the text."""
    reason = F.when(F.col("size_bytes") > most, "too_large").when(looks_binary(F.col("bytes")), "binary")
    return files.withColumn("skip_reason", reason).withColumn("content", F.when(reason.isNull(), F.decode("bytes", "UTF-8"))).drop("bytes")


def path_policy(files: DataFrame, exclude: list[str], rules: list[tuple[int, str, str, bool]] = ()) -> DataFrame:
    """files with (reason), null where the path may be indexed; the first of path_escape, path_excluded,
    source_type_excluded and repo_ignored."""
    path = F.col("path")
    known = places.language(path).isNotNull() | places.is_supporting(path)
    marked = globs.ignored(files, list(rules))
    reason = (
        F.when(globs.normalise(path).isNull(), "path_escape")
        .when(globs.matches(path, exclude), "path_excluded")
        .when(~known, "source_type_excluded")
        .when(F.col("ignored"), "repo_ignored")
    )
    return marked.withColumn("reason", reason).drop("ignored")


def resolve_path(root: str, path: str) -> tuple[str | None, str | None]:
    """(absolute path, null) or (null, reason) of a path that a user gives: it may not leave root, nor pass a link."""
    if not path or "\0" in path or os.path.isabs(path) or ".." in Path(path.replace("\\", "/")).parts:
        return None, "path_escape"
    at = Path(root).resolve()
    for part in Path(path.replace("\\", "/")).parts:
        at = at / part
        if at.is_symlink():
            return None, "symlink"
    return (str(at), None) if at.exists() else (None, "not_found")


def line_slice(files: DataFrame, first: Column, last: Column, most: int = READ_LINES) -> DataFrame:
    """files with (line_start, line_end, total_lines, truncated, excerpt): a range of lines with numbers."""
    parts = T.lines(F.col("content"))
    total = F.size(parts)
    end = F.least(last, first + most - 1, total)
    own = F.slice(parts, first, F.greatest(F.lit(0), end - first + 1))
    return files.select(*[c for c in files.columns if c != "content"], first.alias("line_start"), end.alias("line_end"), total.alias("total_lines"), (end < total).alias("truncated"), T.gutter(own, first).alias("excerpt"))


def grep(files: DataFrame, pattern: str, limit: int = GREP_HITS, mode: str = "smart") -> DataFrame:
    """(path, line_no, line) of the first lines that contain pattern, cut at 220 characters. smart: case counts if the
    pattern has an upper-case letter; exact and ignore fix it."""
    exact = mode == "exact" or mode == "smart" and pattern.lower() != pattern
    rows = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "line"))
    hit = F.col("line").contains(pattern) if exact else F.lower("line").contains(pattern.lower())
    cut = F.when(F.length("line") > GREP_CHARS, F.concat(F.substring("line", 1, GREP_CHARS), F.lit("…"))).otherwise(F.col("line"))
    return rows.filter(hit).select("path", (F.col("i") + 1).alias("line_no"), cut.alias("line")).orderBy("path", "line_no").limit(limit)


def list_dir(files: DataFrame, folder: str = ".", limit: int = LIST_ENTRIES) -> DataFrame:
    """(name, kind, truncated): a folder's entries by name, derived from the paths."""
    prefix = "" if folder in (".", "") else folder.rstrip("/") + "/"
    rest = F.col("path").substr(F.lit(len(prefix) + 1), F.length("path"))
    own = files.filter(F.col("path").startswith(prefix)).select(F.substring_index(rest, "/", 1).alias("name"), F.when(F.instr(rest, "/") > 0, "dir").otherwise("file").alias("kind")).distinct()
    return own.orderBy("name", "kind").limit(limit).withColumn("truncated", F.lit(own.count() > limit))


def dedupe_docs(docs: DataFrame) -> DataFrame:
    """(path, content): texts of (seq, path, content) that share a path, in order, a blank line between them."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return docs.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"))


def revisions(files: DataFrame) -> DataFrame:
    """(repo, revision, n_files) of files (repo, path, content): one hash for each repository, in two steps. Files fall into 4096 blocks
    by the hash of their path; a block's sorted lines of path and hash stream through a digest, and the revision is the
    digest of the blocks' digests in order. So no task holds or orders a whole repository."""
    line = F.concat("path", F.lit(":"), F.substring(F.sha2("content", 256), 1, 16))
    own = files.select(F.concat("repo", F.lit("\0"), F.substring(F.sha2("path", 256), 1, 3)).alias("repo"), line.alias("line"))
    blocks = own.repartition("repo").sortWithinPartitions("repo", "line").mapInArrow(line_digests, "repo string, revision string, n_files long")
    parts = blocks.select(F.split("repo", "\0")[0].alias("repo"), F.concat(F.split("repo", "\0")[1], F.lit(":"), "revision").alias("line"), "n_files")
    joined = F.array_join(F.array_sort(F.collect_list("line")), "\n")  # at most 4096 of 20 bytes
    return parts.groupBy("repo").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("revision"), F.sum("n_files").alias("n_files"))


def coverage(files: DataFrame) -> DataFrame:
    """(reason, n, share) of files (reason): how many were skipped and why, and how many indexed, where there is no reason."""
    counts = files.groupBy(F.coalesce("reason", F.lit("indexed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("reason", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def find_files(files: DataFrame, patterns: list[str], limit: int = MANIFESTS, exclude: list[str] | None = None) -> DataFrame:
    """The first paths of files (path) that match a pattern and none of exclude."""
    found = files.select("path").filter(globs.matches(F.col("path"), patterns))
    return (found.filter(~globs.matches(F.col("path"), exclude)) if exclude else found).distinct().orderBy("path").limit(limit)


def read_source(files: DataFrame, asked: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, status, content) of asked (path): ok with the whole text, too_large, binary, excluded, or not_found; files has
    (path, size_bytes, content, skip_reason, reason)."""
    status = F.when(F.col("size_bytes").isNull(), "not_found").when(F.col("reason").isNotNull(), "excluded").when(F.col("size_bytes") > most, "too_large").when(F.col("skip_reason").isNotNull(), F.col("skip_reason")).otherwise("ok")
    rows = asked.select("path").distinct().join(files.select("path", "size_bytes", "content", "skip_reason", "reason"), "path", "left").withColumn("status", status)
    return rows.select("path", "status", F.when(F.col("status") == "ok", F.coalesce("content", F.lit(""))).alias("content"))


def line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repo, revision, n_files) of rows (repo, line) sorted by both: 16 digits of the SHA-256 of the lines with line ends between them."""
    repo, digest, n = None, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"repo": pa.array([repo], pa.string()), "revision": [digest.hexdigest()[:16]], "n_files": pa.array([n], pa.int64())})

    for batch in batches:
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or key != repo:
                if digest is not None:
                    yield row()
                repo, digest, n = key, hashlib.sha256(), 0
            if line is not None:
                digest.update(("\n" if n else "").encode() + line.encode())
            n += 1
    if digest is not None:
        yield row()


# ---- manifests


def json_dependencies(files: DataFrame) -> DataFrame:
    """(path, group, name, spec) of package.json-like files."""
    groups = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    schema = ", ".join(f"`{g}` map<string,string>" for g in groups)
    parsed = files.select("path", F.from_json("content", schema, {"allowComments": "true"}).alias("j"))
    rows = None
    for g in groups:
        one = parsed.select("path", F.lit(g).alias("group"), F.explode(F.col(f"j.{g}")).alias("name", "spec"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def requirement_lines(files: DataFrame) -> DataFrame:
    """(path, group, name, spec) of requirements files: comments, options and blank lines dropped."""
    line = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    rows = files.select("path", F.explode(T.lines(F.col("content"))).alias("line")).select("path", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("-"))
    return rows.select("path", F.lit("requirements").alias("group"), F.regexp_extract("line", r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.trim(F.regexp_replace("line", r"^[A-Za-z0-9._-]+(\[[^\]]*\])?", "")).alias("spec"))


def toml_section(files: DataFrame, sections: str) -> DataFrame:
    """(path, group, name, spec) of `name = value` lines under sections whose names match: Cargo and pyproject files."""
    from pyspark.sql import Window

    rows = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "line"))
    head = F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1)
    group = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("path").orderBy("i"))
    kept = rows.withColumn("group", group).filter(F.col("group").rlike(sections))
    name, spec = F.regexp_extract("line", r"^\s*\"?([A-Za-z0-9._-]+)\"?\s*=", 1), F.regexp_extract("line", r"=\s*(?:\{[^}]*version\s*=\s*)?\"([^\"]*)\"", 1)
    return kept.select("path", "group", name.alias("name"), spec.alias("spec")).filter("name <> ''")


def line_dependencies(files: DataFrame, group: str, pattern: str) -> DataFrame:
    """(path, group, name, spec) by a pattern of two groups: go.mod, Gradle, sbt, CMake, mix files."""
    rows = files.select("path", F.explode(T.lines(F.col("content"))).alias("line"))
    return rows.select("path", F.lit(group).alias("group"), F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("spec")).filter("name <> ''")


POM = "dependencies struct<dependency: array<struct<groupId: string, artifactId: string, version: string, scope: string>>>"


def pom_dependencies(files: DataFrame) -> DataFrame:
    """(path, group, name, spec) of pom.xml files, by Spark's XML reader: group:artifact names, scopes as groups. Broken files have none."""
    text = F.regexp_replace(F.regexp_replace("content", r"(?s)<!--.*?-->", ""), r"(<project)\s[^>]*>", "$1>")
    parsed = files.select("path", F.from_xml(text, POM, {"mode": "PERMISSIVE"}).alias("x")).select("path", F.explode("x.dependencies.dependency").alias("d"))
    name = F.concat_ws(":", F.trim("d.groupId"), F.trim("d.artifactId"))
    return parsed.filter("d.artifactId is not null").select("path", F.coalesce(F.trim("d.scope"), F.lit("compile")).alias("group"), name.alias("name"), F.coalesce(F.trim("d.version"), F.lit("")).alias("spec"))


def toml_tables(files: DataFrame, table: str) -> DataFrame:
    """(path, group, name, spec) of `[[table]]` entries with a name and a version: lock files of Cargo and Poetry. Sections are numbered by a
    running count over the lines, and each number is one entry."""
    from pyspark.sql import Window

    rows = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "line"))
    head = F.regexp_extract("line", r"^\s*(\[\[?[^\]]+\]\]?)\s*(?:#.*)?$", 1)
    w = Window.partitionBy("path").orderBy("i")
    numbered = rows.withColumn("head", head).withColumn("section", F.sum(F.when(F.col("head") != "", 1).otherwise(0)).over(w)).withColumn("own", F.last(F.when(F.col("head") != "", F.col("head")), ignorenulls=True).over(w))
    value = lambda k: F.first(F.when(F.col("line").rlike(rf"^\s*{k}\s*="), F.regexp_extract("line", r'=\s*"([^"]*)"', 1)), ignorenulls=True)
    entries = numbered.filter(F.col("own") == f"[[{table}]]").groupBy("path", "section").agg(value("name").alias("name"), value("version").alias("spec"))
    return entries.filter("name is not null").select("path", F.lit("lock").alias("group"), "name", F.coalesce("spec", F.lit("")).alias("spec"))


def vcpkg_dependencies(files: DataFrame) -> DataFrame:
    """(path, group, name, spec) of vcpkg.json files, whose dependencies are names or objects with a name and a lowest version."""
    each = files.select("path", F.explode(F.from_json(F.get_json_object("content", "$.dependencies"), "array<string>")).alias("d"))
    plain = ~F.col("d").startswith("{")
    return each.select("path", F.lit("dependencies").alias("group"), F.when(plain, F.col("d")).otherwise(F.get_json_object("d", "$.name")).alias("name"), F.coalesce(F.when(~plain, F.get_json_object("d", "$['version>=']")), F.lit("")).alias("spec")).filter("name is not null")


def conan_dependencies(files: DataFrame) -> DataFrame:
    """(path, group, name, spec) of the requires sections of conanfile.txt."""
    from pyspark.sql import Window

    rows = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "line"))
    head = F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1)
    group = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("path").orderBy("i"))
    line = F.trim(F.regexp_replace("line", r"#.*$", ""))
    kept = rows.withColumn("group", group).filter(F.col("group").rlike("requires$")).select("path", "group", F.regexp_extract(line, r"^([A-Za-z0-9_.+-]+)/", 1).alias("name"), F.regexp_extract(line, r"^[^/]+/([^@\s]+)", 1).alias("spec"))
    return kept.filter("name <> ''")


def tsconfig_options(files: DataFrame) -> DataFrame:
    """(path, group, name, spec) of the compiler options of tsconfig files, comments allowed; nested values as JSON."""
    parsed = files.select("path", F.from_json("content", "compilerOptions map<string,string>", {"allowComments": "true"}).alias("j"))
    return parsed.select("path", F.lit("compilerOptions").alias("group"), F.explode("j.compilerOptions").alias("name", "spec"))


#: Line patterns (name, version) of the ecosystems whose manifests are read by lines.
LINE_PATTERNS = {
    "go": r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[^\s]+)",
    "jvm": r"^\s*(?:implementation|api|compileOnly|testImplementation)[\s(]+['\"]([^:'\"]+:[^:'\"]+):([^'\"]+)['\"]",
    "sbt": r"\"([^\"]+\"\s*%%?\s*\"[^\"]+)\"\s*%\s*\"([^\"]+)\"",
    "dotnet": r"<Package(?:Reference|Version)\s+Include=\"([^\"]+)\"\s+Version=\"([^\"]+)\"",
    "native": r"^\s*find_package\(\s*([A-Za-z0-9_+-]+)\s*([0-9.]*)",
    "elixir": r"\{:([a-z0-9_]+),\s*\"([^\"]+)\"",
}


def dependency_docs(files: DataFrame) -> DataFrame:
    """(path, content): a virtual document for each dependency of all manifests, merged by path and with runtime groups only marked."""
    name = T.basename(F.col("path"))
    low = F.lower(name)
    parts = [
        ("npm", json_dependencies(files.filter(low == "package.json"))),
        ("php", json_dependencies(files.filter(low == "composer.json").withColumn("content", F.regexp_replace("content", '"require(-dev)?"', '"dependencies"')))),
        ("python", requirement_lines(files.filter(low.rlike(r"^requirements.*\.txt$"))).unionByName(toml_section(files.filter(low == "pyproject.toml"), "dependencies"))),
        ("rust", toml_section(files.filter(low.isin("cargo.toml")), "dependencies").unionByName(toml_tables(files.filter(low == "cargo.lock"), "package"))),
        ("typescript", tsconfig_options(files.filter(low.rlike(r"^tsconfig.*\.json$")))),
        ("go", line_dependencies(files.filter(low == "go.mod"), "require", LINE_PATTERNS["go"])),
        ("jvm", line_dependencies(files.filter(low.rlike(r"\.gradle(\.kts)?$")), "gradle", LINE_PATTERNS["jvm"]).unionByName(pom_dependencies(files.filter(low == "pom.xml"))).unionByName(line_dependencies(files.filter(low == "build.sbt"), "sbt", LINE_PATTERNS["sbt"]))),
        ("dotnet", line_dependencies(files.filter(low.rlike(r"\.csproj$|^directory\.packages\.props$")), "package", LINE_PATTERNS["dotnet"])),
        ("native", line_dependencies(files.filter(low == "cmakelists.txt"), "cmake", LINE_PATTERNS["native"]).unionByName(vcpkg_dependencies(files.filter(low == "vcpkg.json"))).unionByName(conan_dependencies(files.filter(low == "conanfile.txt")))),
        ("elixir", line_dependencies(files.filter(low.isin("mix.exs")), "mix", LINE_PATTERNS["elixir"])),
    ]
    rows = None
    for eco, df in parts:
        one = df.withColumn("eco", F.lit(eco))
        rows = one if rows is None else rows.unionByName(one)
    safe = F.regexp_replace("name", "[^A-Za-z0-9._-]+", "_")
    doc = F.concat_ws("\n", F.concat(F.lit("# "), F.col("name")), F.concat(F.lit("- ecosystem: "), F.col("eco")), F.concat(F.lit("- group: "), F.col("group")), F.concat(F.lit("- version: "), F.col("spec")), F.concat(F.lit("- manifest: "), F.col("path")))
    docs = rows.select(F.concat(F.lit(places.DEPENDENCY_DOCS), F.col("eco"), F.lit("/"), safe, F.lit(".md")).alias("doc_path"), F.concat_ws("\0", "path", "group").alias("seq"), doc.alias("content"))
    return dedupe_docs(docs.select(F.col("doc_path").alias("path"), "seq", "content"))
