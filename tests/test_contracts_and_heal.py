import datetime as dt

from pyspark.sql import functions as F

from evidentia.functions import contracts as C
from evidentia.operators import evidence as E
from evidentia.operators import profiles as PR
from evidentia.operators import search as S
from evidentia.sources import corpus
from evidentia.streaming import live

RULES = [C.Rule("id", "string", True, pattern=r"^[a-z]+$"), C.Rule("n", "number", least=0), C.Rule("flag", "boolean"), C.Rule("sub", "object"), C.Rule("list", "array", shortest=1, longest=2)]


def test_good_and_bad_requests(spark):
    rows = [
        ('{"id": "abc"}', []), ('{"id": "abc", "n": 0.5, "flag": false, "sub": {}, "list": [1]}', []), ('{"id": "A1"}', ["id: pattern"]), ("{}", ["id: missing"]), ('{"id": "a", "n": -1, "list": []}', ["n: range", "list: length"]),
        ('{"id": 1, "n": "x", "flag": 1, "sub": [], "list": {}}', ["id: type", "n: type", "flag: type", "sub: type", "list: type"]), ('{"id": "a", "z": 1, "b": 2}', ["b: unknown", "z: unknown"]),
        ("", ["not_json"]), (None, ["not_json"]), ("nope", ["not_json"]), ('"text"', ["not_object"]), ('{"id": "a", "list": [1, 2, 3]}', ["list: length"]), ('{"id": "a", "n": null}', []),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(rows)], "i int, body string").orderBy("i")
    assert [r[0] for r in df.select(C.violations(F.col("body"), RULES)).collect()] == [v for _, v in rows]


DIAGRAMS = [
    (1, "sequenceDiagram\nalt x\nA->>B: y\nend"), (2, "sequenceDiagram\nend\nalt x\nend\nend"), (3, "flowchart TD\nsubgraph a\nsubgraph b\nend"), (4, ""), (5, "sequenceDiagram\r\n%% end\r\n  end  \r\nA->>B: z"), (6, "end"), (7, None),
]


def test_healed_diagrams_pass_and_sound_ones_stay(spark):
    df = spark.createDataFrame(DIAGRAMS, "id int, source string")
    healed = {r.id: r for r in E.heal_diagrams(df, close=True).collect()}
    assert healed[1].source == DIAGRAMS[0][1] and (healed[1].dropped, healed[1].closed) == (0, 0)
    assert healed[2].source == "sequenceDiagram\nalt x\nend" and healed[2].dropped == 2
    assert healed[3].source == "flowchart TD\nsubgraph a\nsubgraph b\nend\nend" and healed[3].closed == 1
    assert healed[5].source == "sequenceDiagram\n%% end\nA->>B: z" and healed[6].source == "" and healed[4].source == "" and healed[7].source is None
    ok = {r.id: r.ok for r in E.lint_diagrams(E.heal_diagrams(df, close=True).filter("id in (1, 2, 3)").select("id", "source")).collect()}
    assert ok == {1: True, 2: True, 3: True}
    assert {r.id: r.closed for r in E.heal_diagrams(df).collect()}[3] == 0


def deps(df):
    return sorted((r.group, r.name, r.spec) for r in df.collect())


def test_manifests_of_all_ecosystems(spark):
    one = lambda path, text: spark.createDataFrame([(path, text)], "path string, content string")
    pom = '<project xmlns="u">\n<dependencyManagement><dependencies><dependency><artifactId>no</artifactId></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><scope>test</scope></dependency><!-- <dependency><artifactId>x</artifactId></dependency> --></dependencies></project>'
    assert deps(corpus.pom_dependencies(one("pom.xml", pom))) == [("test", "g:a", "")]
    assert deps(corpus.pom_dependencies(one("pom.xml", "<project><broken"))) == [] == deps(corpus.pom_dependencies(one("pom.xml", None)))
    lock = '[[package]]\nname = "a"\nversion = "1"\n\n[[package]] # c\nname = "b"\n[[other]]\nname = "no"\n[package]\nname = "no"'
    assert deps(corpus.toml_tables(one("Cargo.lock", lock), "package")) == [("lock", "a", "1"), ("lock", "b", "")]
    assert deps(corpus.vcpkg_dependencies(one("vcpkg.json", '{"dependencies": ["fmt", {"name": "zlib", "version>=": "1.2"}, {"x": 1}]}'))) == [("dependencies", "fmt", ""), ("dependencies", "zlib", "1.2")]
    assert deps(corpus.conan_dependencies(one("conanfile.txt", "[requires]\nfmt/1.0@a/b\n# no/1\n[build_requires]\ncmake/3 # x\n[options]\na/1"))) == [("build_requires", "cmake", "3"), ("requires", "fmt", "1.0")]
    assert deps(corpus.tsconfig_options(one("tsconfig.json", '{/* c */ "compilerOptions": {"strict": true, "paths": {"a": ["b"]}}}'))) == [("compilerOptions", "paths", '{"a":["b"]}'), ("compilerOptions", "strict", "true")]


def test_bursts_fire_once_after_quiet(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    src = f"file://{tmp_path}/in"
    kind = "table string, ts timestamp"
    for k, part in enumerate([[("t", at(0)), ("t", at(1)), ("u", at(1))], [("t", at(2)), ("t", at(30)), ("t", at(31))], [("end", at(600))], [("end", at(601))]]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src if k == 0 else src)
    events = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    done = []
    query = live.compact_when_quiet(events, "ts", "table", 5, lambda table: done.append(table) or (_ for _ in ()).throw(RuntimeError("busy")) if table == "u" else done.append(table), f"file://{tmp_path}/cp", available=True)
    query.awaitTermination(120)
    assert sorted(done) == ["t", "t", "u"]


CHUNKS = [("src/a.py", 1, 9, "def load(): pass"), ("src/b.css", 1, 9, "a { color: red }"), ("package.json", 1, 3, '{"dependencies": {"load": "1"}}'), ("src/c.py", 1, 9, "import load")]


def test_counters_and_profiles_reach_every_leg(spark):
    chunks = spark.createDataFrame(CHUNKS, "path string, line_start int, line_end int, content string")
    asked = spark.createDataFrame([(1, "Which python function loads the package dependencies?"), (2, "load")], "q long, text string")
    facts = spark.createDataFrame([("src/a.py", 1, 1, "definition", "load", None, "def load"), ("src/b.css", 1, 1, "style_rule", "load", None, "load {")], "path string, line_start int, line_end int, kind string, name string, target string, detail string")
    plain = S.search(chunks, asked, facts=facts, support=1, threshold=0.0)
    counters = {}
    found = S.search(chunks, asked, facts=facts, support=1, threshold=0.0, profiles=PR.default_profiles(spark), counters=counters)
    rows = found.collect()
    seen = S.counts(counters)
    assert set(seen) == {"vector", "lexical", "graph", "support"} and seen["lexical"]["questions"] == 2 and seen["vector"]["rows"] == 8 and seen["graph"]["rows"] > 0
    assert {r.q for r in rows} == {1, 2} and len(rows) >= len(plain.collect()) - 1
