"""What the findings of round 3 asked for."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from evidentia.functions import contracts as C
from evidentia.functions import text as T
from evidentia.llm import bpe
from evidentia.operators import annotations as N
from evidentia.operators import evidence as E
from evidentia.operators import graph as G
from evidentia.operators import retrieval as R
from evidentia.operators import syntax as S
from evidentia.plans import evidence_queries, packet_queries, syntax_queries
from evidentia.sources import text_index as X
from evidentia.sources.store import Catalog


def test_f1_a_line_meets_each_pattern_once(spark):
    lines = spark.createDataFrame([("a.py", "python", 1, "x = f(1)")], "path string, lang string, line_no int, line string")
    plan = N.annotate(lines, languages=("python",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(N.PYTHON_CALL) == 1 and plan.count(N.LANGUAGES["python"].bindings[0]) == 1


def test_f1_plain_lines_are_those_of_the_lexer(spark):
    files = spark.createDataFrame([("a.py", "x\r\n'''\ny"), ("b.go", None), ("c.md", "z")], "path string, content string")
    both = [sorted(map(tuple, f(files).select("path", "lang", "line_no", "line").collect())) for f in (S.plain_lines, S.code_lines)]
    assert both[0] == both[1] and len(both[0]) == 4


def test_f3_of_rows_with_one_number_the_first_counts(spark, tmp_path):
    rows = [(1, 1, 2, 0, "A", "F", 1.0), (1, 1, 1, 0, "B", "F", 1.0), (2, 2, 2, 0, "Z", "F", 1.0), (2, 2, 2, 0, "A", "F", 1.0)]
    schema = "l_orderkey long, l_linenumber int, x long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double"
    spark.createDataFrame(rows, schema).withColumn("l_suppkey", F.lit(2)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.key: r.note for r in evidence_queries.model_callouts(spark, str(tmp_path)).collect()}
    assert got == {1: 'Part "A" decides', 2: 'Part "Z" decides'}


def test_f14_pieces_give_what_the_whole_gives(monkeypatch):
    low, terms = pa.array(["a b", None, "", "c" * 50 + " a", "b b a"]), pa.array(["a", "b"])
    whole = [x.tolist() for x in R._term_places(pc.fill_null(low, ""), terms)]
    for most in (1, 4, 60):
        monkeypatch.setattr(R, "PIECE", most)
        assert [x.tolist() for x in R._term_places(pc.fill_null(low, ""), terms)] == whole
    assert list(R._pieces(low, 4)) == [(0, 3), (3, 4), (4, 5)] and whole[2] == [2, 0, 0, 2, 3]


def test_f5_more_rows_get_more_tasks(spark):
    rows = spark.range(1000).withColumn("q", F.col("id") % 100)
    assert E.dealt(rows, "q", 100).rdd.getNumPartitions() == 10 and E.dealt(rows, "q").rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_f22_heads_read_no_content(spark):
    row = spark.createDataFrame([("a/b_c.py", "x = some_name", 1)], "path string, content string, n int")
    head, text = T.embedding_head(F.col("path"), F.lit(1), F.col("n"), F.lit(None).cast("string")), T.embedding_text(F.col("path"), F.lit(1), F.col("n"), F.col("content"), F.lit(None).cast("string"))
    assert row.select(F.startswith(text, head) & (F.size(F.split(head, "\n")) == 3)).first()[0]
    plan = packet_queries.embedding_heads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_f2_words_of_an_item_are_made_once(spark):
    items = spark.createDataFrame([(1, 1, "a.py", "some text", 0.5, "search")], "q int, ord int, path string, content string, similarity double, tool string")
    asked = spark.createDataFrame([(1, "How does text work?")], "q int, text string")
    assert E.full_score(items, asked)._jdf.queryExecution().optimizedPlan().toString().count("[a-z][a-z0-9]{3,}") == 2


def test_op8_ids_leave_the_worker_that_puts_them_together_once(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("Ein Text, un été "), F.col("id").cast("string"))).alias("text"))
    trip = bpe.round_trip(docs, ranks)
    plan = trip._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("FlatMapGroupsInArrow") == 1
    ids = bpe._encoder(ranks).encode_ordinary
    sha = lambda data: hashlib.sha256(data).hexdigest()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {k: (len(ids(x)), sha(",".join(map(str, ids(x))).encode()), sha(x.encode())) for k, x in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trip.collect()} == want


def test_f6_no_seed_is_joined_behind_enough_neighbours(spark):
    seeds = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, "c", 1), (2, "b", 5)], "q int, path string, seed_rank int")
    sizes = spark.createDataFrame([("a", 0, 4), ("a", 1, 1), ("b", 0, 5), ("b", 1, 9), ("c", 0, 3)], "path string, d int, size int")
    got = {(r.q, r.path, r.d, r.most) for r in G.needed_sides(seeds, sizes, 2).collect()}
    assert got == {(1, "a", 0, 5), (1, "a", 1, 5), (1, "b", 0, 5), (1, "c", 0, 5), (2, "c", 0, 4), (2, "b", 0, 4)}


def test_f6_neighbours_are_those_of_the_whole_join(spark):
    draw = random.Random(7)
    edges = {(draw.randrange(12), draw.randrange(12) if draw.random() < 0.5 else 3) for _ in range(90)}
    seeds = {(q, p): draw.randrange(4) for q in range(30) for p in draw.sample(range(14), draw.randrange(1, 5))}
    got = G.import_neighbours(spark.createDataFrame(list(edges), "path int, target int"), spark.createDataFrame([(q, p, r) for (q, p), r in seeds.items()], "q int, path int, seed_rank int"), 3)
    want = set()
    for q in range(30):
        first = {}
        for (own, p), r in seeds.items():
            if own == q:
                for turn, other in [((r, 0), t) for s, t in edges if s == p] + [((r, 1), s) for s, t in edges if t == p]:
                    first[other] = min(turn, first.get(other, turn))
        best = sorted((turn, other) for other, turn in first.items() if (q, other) not in seeds)[:3]
        want |= {(q, other, "imports" if turn[1] == 0 else "imported_by", k + 1) for k, (turn, other) in enumerate(best)}
    assert set(map(tuple, got.select("q", "path", "direction", "rank").collect())) == want


def test_f12_a_request_is_parsed_once(spark):
    rules = [C.Rule("a", "string", True, 1, 3, pattern="^x", values=("x y",)), C.Rule("b", "array", shortest=1, longest=2), C.Rule("c", "number", least=0, most=2), C.Rule("d", "object")]
    bodies = {
        '{"a": " x y ", "b": [null, {"z": 1}], "c": 1.5, "d": {}}': [], '{"a": "x", "b": [], "c": -1, "d": 1, "f": 0, "e": null}': ["e: unknown", "f: unknown", "a: value", "b: length", "c: range", "d: type"],
        ' \n{"b": "[1]", "c": "1"}': ["a: missing", "b: type", "c: type"], '{"a": "\\u0079y"}': ["a: pattern"], '"{"': ["not_object"], "null": ["not_object"], '{"a": 1, "a": 2}': ["not_json"], "": ["not_json"],
    }
    rows = spark.createDataFrame([(x,) for x in bodies], "body string").select("body", C.violations(F.col("body"), rules).alias("v"))
    assert {r.body: r.v for r in rows.collect()} == bodies
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_f9_f10_sources_group_numbers_and_no_texts(spark):
    plan = syntax_queries.sources(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "def item_" not in plan[plan.index("+- Project") :]
    text = spark.createDataFrame([("a([{b)]}é(", "")], "x string, y string")
    assert text.select(S._count(F.col("x"), "([{"), S._count(F.col("x"), ")]}"), S._count(F.col("y"), "(")).first() == (4, 3, 0)


def _shuffled_rows(spark):
    jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_f4_f15_blocks_are_shuffled_and_no_postings(spark, tmp_path):
    docs = spark.range(300, numPartitions=2).select(F.col("id").alias("key"), F.lit(" ".join(f"w{i}" for i in range(40))).alias("text")).cache()
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 2} w{q + 3}") for q in range(20)], "q int, text string")
    assert docs.count() == 300
    index, before = X.TextIndex(Catalog(spark, f"file://{tmp_path}/c")), set(_shuffled_rows(spark))
    index.apply(docs)
    index.apply(docs.filter("key % 5 = 1"), docs.filter("key % 7 = 3").select("key"))
    index.merge()
    assert index.search(asked, 3).count() == 60
    assert sum(n for stage, n in _shuffled_rows(spark).items() if stage not in before) < 300 * 40


def test_f4_merged_ranges_number_live_texts_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "RANGE", 200)
    draw = random.Random(3)
    live = {i: " ".join(draw.choices("abcdefghij", k=draw.randrange(30))) for i in range(900)}
    index = X.TextIndex(Catalog(spark, f"file://{tmp_path}/c"))
    index.apply(spark.createDataFrame(list(live.items()), "key int, text string"))
    changed, removed = {i: "a b k" for i in range(0, 1000, 9)}, set(range(1, 900, 2)) - set(range(0, 1000, 9))
    index.apply(spark.createDataFrame(list(changed.items()), "key int, text string"), spark.createDataFrame([(i,) for i in removed], "key int"))
    index.merge()
    live = {k: v for k, v in (live | changed).items() if k not in removed}
    asked = spark.createDataFrame([(1, "a k"), (2, "b c j"), (3, "h")], "q int, text string")
    for _ in range(2):
        ranges = [(r.ords, r.n, dict(zip(r["keys"], r.dls, strict=True))) for r in index._blocks(index._head()[1], [X.TEXTS]).collect()]
        assert all(ords == list(range(n)) and n <= 2 * X.RANGE for ords, n, _ in ranges)
        assert {k: v for _, _, own in ranges for k, v in own.items()} == {k: len(v.split()) for k, v in live.items()} and sum(n for _, n, _ in ranges) == len(live)
        want = R.bm25(spark.createDataFrame(list(live.items()), "key int, text string"), asked, 25)
        assert sorted(map(tuple, index.search(asked, 25).select("q", "key", "score", "rank").collect())) == sorted(map(tuple, want.select("q", "key", "score", "rank").collect()))
        index.apply(spark.createDataFrame([], "key int, text string"), spark.createDataFrame([(i,) for i in range(0, 900, 4)], "key int"))
        live = {k: v for k, v in live.items() if k % 4 or k >= 900}
        index.merge()


def test_f15_a_range_is_a_row_for_each_folder_and_not_for_each_term(spark, tmp_path):
    docs = spark.range(300, numPartitions=2).select(F.col("id").alias("key"), F.expr("concat_ws(' ', transform(sequence(0, 19), i -> concat('w', id * 20 + i)), 'both')").alias("text"))
    index = X.TextIndex(Catalog(spark, f"file://{tmp_path}/c"))
    index.apply(docs)
    index.apply(docs.filter("key < 3"), docs.filter("key = 7").select("key"))
    asked = spark.createDataFrame([(1, "w45 both"), (2, "w140 w6")], "q int, text string")
    want = sorted(map(tuple, R.bm25(docs.filter("key <> 7"), asked, 3).select("q", "key", "score", "rank").collect()))
    for _ in range(2):
        assert spark.read.parquet(f"{tmp_path}/c/text_index/blocks").count() <= 2 * (X.BUCKETS + 1)
        assert sorted(map(tuple, index.search(asked, 3).select("q", "key", "score", "rank").collect())) == want
        index.merge()
        index.vacuum()


def test_f15_words_are_those_of_tokens(spark):
    texts = ["ab", "c d", "", "é1ï2", "  x", "y  ", "z", "-", "ß_0 a9", "w" * 70]
    want = [(i, t) for i, r in enumerate(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(T.tokens(F.col("x")).alias("t")).collect()) for t in r.t]
    for a, n in ((0, 10), (1, 3), (2, 1), (3, 7), (0, 0)):
        words, dl = X._words(pa.array(texts).slice(a, n))
        doc = [a + i for i, m in enumerate(dl.tolist()) for _ in range(m)]
        assert list(zip(doc, words.to_pylist(), strict=True)) == [x for x in want if a <= x[0] < a + n]


def test_f15_pieces_and_batches_give_the_same_packs(monkeypatch):
    draw = random.Random(5)
    low = ["", "-"] + [" ".join(draw.choices([f"t{i}" for i in range(90)], k=draw.randrange(25))) for _ in range(60)]
    rows = pa.table({"r": pa.array([4] * len(low), pa.int64()), "key": pa.array(range(len(low)), pa.int64()), "low": low})

    def made(size):
        out = pa.Table.from_batches(X._packs_of(pa.int64())(iter(rows.to_batches(max_chunksize=size)))).to_pylist()
        blocks = {}
        for x in out[1:]:
            ords, tfs = (X._numbers(pa.array([x[c]], pa.binary()))[0].tolist() for c in ("ords", "tfs"))
            for i, t in enumerate(x["terms"].split(" ")):
                at = slice(x["ends"][i - 1] if i else 0, x["ends"][i])
                blocks[t] = (x["bucket"], x["max_tfs"][i], x["min_dls"][i], list(zip(ords[at], tfs[at], strict=True)))
        return out[0], blocks

    head, blocks = made(100)
    assert (head["keys"], head["dls"]) == (list(range(len(low))), [len(t.replace("-", "").split()) for t in low])
    for t, (_, most, least, own) in blocks.items():
        assert own == [(i, x.split().count(t)) for i, x in enumerate(low) if t in x.split()]
        assert most == max(tf for _, tf in own) and least == min(head["dls"][i] for i, _ in own)
    for piece, size in ((1, 100), (40, 7), (2 << 20, 9)):
        monkeypatch.setattr(R, "PIECE", piece)
        assert made(size) == (head, blocks)
