from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import globs, places
from evidentia.functions import text as T
from evidentia.operators import chunking
from evidentia.sources import corpus


def col(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r) for r in df.select("i", *exprs).orderBy("i").drop("i").collect()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00e9", max_size=30), min_size=1, max_size=30), st.integers(8, 40))
def test_split_covers_every_character(lines, most):
    content = "\n".join(lines)
    parts = chunking.split_text(content, 1, most, 5)
    assert all(len(p) <= most for _, _, p in parts)
    covered = set()
    for a, b, p in parts:
        if a == b and len(lines[a - 1]) > most:
            covered |= {(a, k) for k in range(len(lines[a - 1])) if p in lines[a - 1]}
        else:
            assert p == "\n".join(lines[a - 1 : b])
            covered |= {(n, k) for n in range(a, b + 1) for k in range(len(lines[n - 1]))}
    assert covered >= {(n + 1, k) for n, line in enumerate(lines) for k in range(len(line))}


def test_window_edges(spark):
    texts = {f"{n}.py": "\n".join(str(i) for i in range(n)) for n in (1, 80, 81, 150, 151)} | {"crlf.py": "a\r\nb", "empty.py": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = {}
    for r in chunking.windows(files).orderBy("path", "line_start").collect():
        got.setdefault(r.path, []).append((r.line_start, r.line_end))
    assert got == {"1.py": [(1, 1)], "80.py": [(1, 80)], "81.py": [(1, 80), (71, 81)], "150.py": [(1, 80), (71, 150)], "151.py": [(1, 80), (71, 150), (141, 151)], "crlf.py": [(1, 2)], "empty.py": [(1, 1)]}


def test_blocks_and_oversize(spark):
    block = "def f{0}():\n" + "\n".join(f"    x{i} = {i}" for i in range(40)) + "\n"
    code = "\n".join(block.format(i) for i in range(6))
    files = spark.createDataFrame([("a.py", code), ("b.txt", "x" * 20_001), ("c.bin", "no")], "path string, content string")
    rows = chunking.chunk_files(files).collect()
    a = sorted((r.line_start, r.line_end) for r in rows if r.path == "a.py")
    assert len(a) > 1 and a[0][0] == 1 and all(code.split("\n")[s - 1].startswith("def") for s, _ in a)
    b = sorted((r.line_start, len(r.content)) for r in rows if r.path == "b.txt")
    assert b == [(1, 401), (1, 20_000)]
    assert not [r for r in rows if r.path == "c.bin"]


def test_paths(spark):
    values = ["a/b.py", "./a//b", "a/../b", "../x", "/abs", "a\\b", "a/../../b", "C:/x", ".", None]
    got = [r[0] for r in col(spark, values, "string", globs.normalise(F.col("v")))]
    assert got == ["a/b.py", "a/b", "b", None, None, "a/b", None, None, None, None]


def test_globs(spark):
    paths = ["src/a.js", "src/x/a.js", "node_modules/m/i.js", "lib/node_modules/i.js", "a.min.js", "docs/read.me", "x/y/z.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "v string")
    hits = lambda *g: {r.v for r in df.filter(globs.matches(F.col("v"), g)).collect()}
    assert hits("src/**") == {"src/a.js", "src/x/a.js"}
    assert hits("**/node_modules/**") == {"node_modules/m/i.js", "lib/node_modules/i.js"}
    assert hits("*.js") == {"src/a.js", "src/x/a.js", "node_modules/m/i.js", "lib/node_modules/i.js", "a.min.js"}
    assert hits("src/*.js") == {"src/a.js"} and hits("docs/read.me") == {"docs/read.me"} and hits("**/*.ts") == {"x/y/z.ts"} and hits() == set()


def test_ignore_rules_last_match_wins(spark):
    rules = globs.ignore_rules([(".gitignore", "*.log\n!keep.log\n/tmp/\n# no\n\nout"), ("sub/.gitignore", "!b.log\nsecret.txt\n")])
    df = spark.createDataFrame([(p,) for p in ("a.log", "keep.log", "sub/b.log", "tmp/x", "a/tmp/x", "out/y", "a/out/y", "sub/secret.txt", "secret.txt", "node_modules/m.js")], "path string")
    got = {r.path for r in globs.ignored(df, rules).filter("ignored").collect()}
    assert got == {"a.log", "tmp/x", "out/y", "a/out/y", "sub/secret.txt", "node_modules/m.js"}


def test_path_policy_order(spark):
    df = spark.createDataFrame([(p,) for p in ("../a.py", "x/a.py", "a.exe", "i.py", "ok.py", "package.json")], "path string")
    got = {r.path: r.reason for r in corpus.path_policy(df, ["x/**"], globs.ignore_rules([(".gitignore", "i.py")])).collect()}
    assert got == {"../a.py": "path_escape", "x/a.py": "path_excluded", "a.exe": "source_type_excluded", "i.py": "repo_ignored", "ok.py": None, "package.json": None}


def test_scan_and_text_policy(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_bytes("é = 1\n".encode())
    (tmp_path / "src/b.bin").write_bytes(b"ab\0c")
    (tmp_path / "src/c.txt").write_bytes(bytes(range(1, 9)) * 3 + b"x" * 100)
    (tmp_path / "big.txt").write_bytes(b"x" * 1_000_001)
    files = corpus.text_policy(corpus.scan_files(spark, str(tmp_path), exclude=["*.md"]))
    got = {r.path: (r.skip_reason, r.content) for r in files.collect()}
    assert got["src/a.py"] == (None, "é = 1\n") and got["src/b.bin"] == ("binary", None) and got["src/c.txt"][0] == "binary" and got["big.txt"][0] == "too_large"


def test_resolver(tmp_path):
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "l.py").symlink_to(tmp_path / "a.py")
    r = lambda p: corpus.resolve_path(str(tmp_path), p)[1]
    assert (r("a.py"), r("../a.py"), r("/a.py"), r("l.py"), r("none.py"), r("a\0")) == (None, "path_escape", "path_escape", "symlink", "not_found", "path_escape")


def test_lines(spark):
    files = spark.createDataFrame([("a.py", "\n".join(f"L{i}" for i in range(1, 13)))], "path string, content string")
    (r,) = corpus.line_slice(files, F.lit(9), F.lit(99), 3).collect()
    assert (r.line_end, r.total_lines, r.truncated, r.excerpt) == (11, 12, True, " 9  L9\n10  L10\n11  L11")
    assert col(spark, [r.excerpt], "string", T.strip_gutter(F.col("v"))) == [("L9\nL10\nL11",)]
    assert [(x.line_no, x.line) for x in corpus.grep(files, "l1").collect()] == [(1, "L1"), (10, "L10"), (11, "L11"), (12, "L12")]
    assert corpus.grep(files, "L1", mode="exact").count() == 4 and corpus.grep(files, "l1", mode="exact").count() == 0


def test_clip(spark):
    got = col(spark, ["ab\ncd\nef", "abcdefgh", "", "ab"], "string", T.clip_lines(F.col("v"), 5).alias("c"))
    assert [tuple(x[0]) for x in got] == [("ab\ncd", 2, True), ("abcd…", 1, True), ("", 1, False), ("ab", 1, False)]


def test_identifiers(spark):
    got = col(spark, ["parseHTTPUrl_v2 x", "the createStore", None], "string", T.split_identifier(F.col("v")), T.code_terms(F.col("v")))
    assert got[0] == (["parse", "httpurl", "v2", "x"], ["parse", "httpurl"]) and got[1][1] == ["create", "store"] and got[2] == (None, None)


def test_places(spark):
    got = col(spark, ["a/Dockerfile", "x.tsx", ".env", "p/.env.local", "package.json", "README.md", "requirements-dev.txt", "weird"], "string", places.language(F.col("v")), places.is_env_file(F.col("v")), places.supporting_role(F.col("v")))
    assert [g[0] for g in got] == ["docker", "tsx", None, None, "json", "markdown", "text", None]
    assert [g[1] for g in got] == [False, False, True, True, False, False, False, False]
    assert [g[2] for g in got] == [None, None, None, None, "manifest", "documentation", "manifest", None]


def test_dependency_docs(spark):
    files = spark.createDataFrame([
        ("package.json", '{"dependencies": {"left": "1"}, /* c */ "devDependencies": {"right": "2"}}'), ("requirements.txt", "# c\nnumpy>=2  # x\n-r other\n\npandas[all]==1\n"), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = { version = "1.0" }\nlog = "0.4"\n'),
        ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.0\n)"), ("app/mix.exs", '{:phoenix, "~> 1.7"}'), ("sub/package.json", '{"dependencies": {"left": "3"}}'), ("bad/package.json", "{nope"), ("CMakeLists.txt", "find_package(ZLIB 1.2)"), ("x.csproj", '<PackageReference Include="Json" Version="13" />'),
    ], "path string, content string")
    docs = {r.path: r.content for r in corpus.dependency_docs(files).collect()}
    assert set(docs) == {f"__dependencies__/{n}.md" for n in ("npm/left", "npm/right", "python/numpy", "python/pandas", "rust/serde", "rust/log", "go/github.com_a_b", "elixir/phoenix", "native/ZLIB", "dotnet/Json")}
    assert docs["__dependencies__/npm/left.md"].count("# left") == 2 and "1.0" in docs["__dependencies__/rust/serde.md"]
