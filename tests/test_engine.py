"""Hand-worked cases of the engine's operators, and every registered query against its SQL on the smallest tables."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import ports
from lodestone.functions import text as T
from lodestone.operators import aggregates, budgets, chunks, context, dedup, evaluation, parse, patches, predicates, relations, retrieval, templates, tree, vectors
from lodestone.plans import catalog
from lodestone.sources import files
from lodestone.streaming import questions

SF = "/root/testdata/sf0.001"

PKG = {
    "pkg/b.py": "def helper(v):\n    return str(v)\n",
    "pkg/a.py": 'import os\nfrom pkg.b import helper\n\nMAX_SIZE = 3\n\n\nclass A(Base):\n    """First. Second."""\n\n    x = 1\n    xy = 2\n\n    def m(self, p):\n        return helper(self.x)\n\n    def n(self):\n        return self.xy\n',
    "pkg/bad.py": "def broken(:\n",
}


@pytest.fixture(scope="module")
def parsed(spark):
    return parse.files(files.in_memory(spark, PKG)).cache()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- parsing and relations


def test_entities(parsed):
    functions = {r["name"]: r for r in parse.table(parsed, "functions").collect()}
    assert set(functions) == {"m", "n", "helper"}
    assert functions["m"]["is_method"] and functions["m"]["class_name"] == "A" and functions["m"]["parameters"] == ["self", "p"] and functions["m"]["calls"] == ["helper"]
    assert functions["helper"]["calls"] == ["str"] and not functions["helper"]["is_method"]
    assert [(r["name"], r["class_name"]) for r in parse.table(parsed, "attributes").collect()] == [("x", "A"), ("xy", "A")]
    constants = {r["name"]: r["is_constant"] for r in parse.table(parsed, "variables").collect()}
    assert constants["MAX_SIZE"] and not constants["x"]
    assert [r["file"] for r in parse.errors(parsed).collect()] == ["pkg/bad.py"]


def test_relations(parsed):
    functions, classes, attributes = (parse.table(parsed, n) for n in ("functions", "classes", "attributes"))
    assert [(r["source_id"], r["target_id"]) for r in relations.calls(functions).collect()] == [("m", "helper")]
    assert [(r["source_id"], r["target_id"]) for r in relations.inherits(classes).collect()] == [("A", "Base")]
    assert {tuple(r)[1:] for r in relations.attribute_users(attributes, functions).collect()} == {("x", "m"), ("x", "n"), ("xy", "n")}
    users = relations.variable_users(attributes.select("name"), functions)
    assert {tuple(r) for r in users.collect()} == {("x", "m"), ("xy", "n")}
    nodes = parse.file_nodes(parsed)
    assert relations.file_graph(nodes).collect() == []
    linked = nodes.withColumn("imports", F.when(F.endswith("file", F.lit("a.py")), F.array(F.lit("pkg.b"))).otherwise(F.col("imports")))
    assert [tuple(r) for r in relations.file_graph(linked).collect()] == [("pkg", "pkg")]
    assert relations.owners(functions.where("is_method"), classes).count() == 2


def test_spans_and_chunks(spark, parsed):
    spans = chunks.spans(parse.table(parsed.where("file = 'pkg/a.py'"), "blocks").drop("pos")).orderBy("ord").collect()
    assert [(s["span_id"], s["span_type"]) for s in spans] == [("imports", "init"), ("impl", "impl"), ("A", "init"), ("A.m", "impl"), ("A.n", "impl")]
    made = chunks.chunks(spark.createDataFrame(spans)).collect()
    assert len(made) == 1 and made[0]["tokens"] == sum(s["tokens"] for s in spans)
    assert chunks.merged([50, 400, 300]) == [[0, 1], [2]] and chunks.merged([400, 50, 300]) == [[0], [1, 2]] and chunks.merged([50, 1490]) == [[0], [1]]
    shown = F.array(F.struct(F.lit(2).alias("start"), F.lit(2).alias("end")))
    assert one(spark, chunks.rendered(F.lit("a\nb\nc\nd"), shown, numbers=False)) == "# ...\nb\n# ..."


def test_modules(spark):
    rows = spark.createDataFrame([("pkg/a.py",), ("pkg/sub/c.py",), ("top.py",), ("__init__.py",), (".hidden/x.py",)], "file string")
    got = {r["module_id"]: (r["parent_id"], r["is_package"]) for r in tree.modules(rows).collect()}
    assert got == {"pkg": (None, True), "pkg.a": ("pkg", False), "pkg.sub": ("pkg", True), "pkg.sub.c": ("pkg.sub", False), "top": (None, False)}


# --- templates


def test_first_rule_hides_the_specific_one(spark):
    asked = spark.createDataFrame([("What", "What is the purpose of the `<Method>` in `<Class>`?"), ("What", "Why `<Nothing>`?")], "category string, template string")
    classes = spark.createDataFrame([("A", "class A", "f", 0, "Doc one. Two")], "name string, code string, file string, pos int, docstring string")
    functions = spark.createDataFrame([("m", "A", True, "def m", ["self"], "f", None)], "name string, class_name string, is_method boolean, code string, parameters array<string>, file string, docstring string")
    attributes = spark.createDataFrame([], "name string, class_name string")
    things = templates.entities(classes, functions, attributes)
    strict = [r["question"] for r in templates.questions(asked, things).collect()]
    assert strict == ["What is the purpose of the `<Method>` in `A`?"]
    loose = [r["question"] for r in templates.questions(asked, things, strict=False).collect()]
    assert loose == ["What is the purpose of the `m` in `A`?"]
    logic = spark.createDataFrame([("How", "How is <Logic> done?")], "category string, template string")
    assert [r["question"] for r in templates.logic_questions(classes, functions, logic).collect()] == ["How is Doc one done?"]


# --- text


@pytest.mark.parametrize(
    "p, t, want",
    [("The cat sat", "a cat sat down", (0.8, 1.0, 2 / 3)), ("yes", "yes it is", (0, 0, 0)), ("", "x", (0, 0, 0)), ("a b b", "b b b", (0.8, 1.0, 2 / 3)), ("no", "no", (1, 1, 1))],
)
def test_f1(spark, p, t, want):
    got = one(spark, T.token_f1(F.lit(p), F.lit(t)))
    assert (got["f1"], got["precision"], got["recall"]) == pytest.approx(want)


def test_text_functions(spark):
    assert one(spark, T.tag_map(F.lit("<a>1</a> x <b> two </b><a>3</a>"))) == {"a": "3", "b": "two"}
    assert one(spark, T.parsed_reply(F.lit('x {"score": 4, "reasoning": None} y'), "score int, reasoning string"))["score"] == 4
    assert one(spark, T.integer_for(F.lit("The value: 7, score: -3"), "score")) == -3
    assert one(spark, T.largest_json(F.lit('```json\n{"a": 1}\n``` and ```json\n{"a": 1, "b": 2}\n```'))) == '{"a": 1, "b": 2}'
    assert one(spark, F.array(*[T.is_constant(F.lit(n)) for n in ("MAX_SIZE", "MAXSIZE", "Max_Size")])) == [True, False, False]
    assert one(spark, T.called_names(F.lit("if (foo(bar.baz(1)))"))) == ["foo", "bar.baz"]
    assert one(spark, T.usage_total(F.lit('{"input_tokens": 5, "cost": 0.5}'))) == (0.5, 5, 0, 0)
    assert one(spark, T.duration(F.lit(3725.9))) == "01h:02m:05s"
    assert one(spark, T.docstring(F.lit('def f(x):\n    """Doc."""\n    return x'))) == "Doc."


def test_paths(spark):
    paths = ["a/testing/x.py", "tests/x.py", "x_test.py", "a/b/x.py"]
    assert [one(spark, predicates.is_test(F.lit(p))) for p in paths] == [True, False, True, False]
    match = lambda p, g: one(spark, predicates.matches_any(F.lit(p), [g]))
    assert match("a/b/x.py", "**.py") and match("a/x.py", "/a/x.py") and match("b/a/x.py", "a/x.py") and match("b/a/xyz.py", "a/x*.py") and not match("a/b/x.py", "a/*.py")
    with pytest.raises(ValueError):
        predicates.matches_any(F.lit("x"), ["a,b"])


# --- dedup, budgets, trees


def test_dedup(spark):
    rows = spark.createDataFrame([(0, "What is X?"), (1, "what is x"), (2, "Where?")], "pos int, text string")
    assert {tuple(r) for r in dedup.by_text(rows).collect()} == {(0, "what is x"), (2, "Where?")}
    empty = F.array().cast("array<string>")
    assert one(spark, dedup.jaccard(empty, empty)) == 1.0
    pair = spark.createDataFrame([({"f1": ["a", "b"], "f2": []}, {"f1": ["b"]}, None)], "a map<string,array<string>>, b map<string,array<string>>, patch_similarity double")
    assert dedup.context_similarity(pair).first()["similarity"] == pytest.approx(0.7)
    frame = spark.createDataFrame([("abc", "abd"), ("", "")], "a string, b string")
    assert [r[0] for r in frame.select(dedup.patch_ratio("a", "b")).collect()] == pytest.approx([2 / 3, 1.0])
    assert [r[0] for r in frame.select(dedup.partial_ratio(F.lit("ell"), F.lit("hello"))).collect()] == [100, 100]


def test_skip_budget(spark):
    rows = spark.createDataFrame([(1, 4, 5), (1, 3, 9), (1, 2, 4), (1, 1, 1)], "h int, at int, tokens int")
    got = budgets.greedy(rows, ["h"], ["at"], 10).first()["rows"]
    assert [r["tokens"] for r in got] == [5, 4, 1]


def test_tree(spark):
    nodes = spark.createDataFrame([(0, None, None), (1, 0, 50), (2, 1, 80)], "node_id long, parent_id long, reward long")
    paths = tree.closure(nodes)
    assert paths.count() == 6
    back = {r["node_id"]: (r["visits"], r["value"]) for r in tree.backpropagated(nodes, paths).collect()}
    assert back == {0: (2, 130), 1: (2, 130), 2: (1, 80)}
    means = {r["node_id"]: r["mean_reward"] for r in tree.trajectory_means(tree.backpropagated(nodes, paths), paths).collect()}
    assert means[2] == pytest.approx(70.0)
    edges = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "node_id long, depends_on long")
    assert tree.dag_depth(edges).first()["depth"] == 1
    assert [r["node_id"] for r in tree.leaves(nodes).collect()] == [2]
    order = {r["node_id"]: r["preorder"] for r in tree.preorder(paths).collect()}
    assert order == {0: 1, 1: 2, 2: 3}
    kept = tree.without_later(nodes, paths, 1)
    assert kept.count() == 2


def test_uct_and_selection(spark):
    cols = "node_id long, parent_id long, visits long, reward double, action string, is_duplicate boolean, expect_correction boolean, has_context boolean"
    nodes = spark.createDataFrame([(0, None, 4, 60.0, None, False, False, False), (1, 0, 2, 80.0, "A", False, True, False), (2, 0, 1, 10.0, "A", True, False, False), (3, 0, 0, None, "B", False, False, False)], cols)
    got = {r["node_id"]: r for r in tree.uct(nodes, tree.closure(nodes)).collect()}
    assert got[3]["uct"] == math.inf
    assert got[0]["duplicate_child_penalty"] == -25 and got[0]["duplicate_action_penalty"] == -50 and got[0]["child_penalty"] == -5
    assert got[1]["leaf_bonus"] == 50 and got[1]["correction_bonus"] == 50
    assert got[1]["exploration"] == pytest.approx(math.sqrt(math.log(4) / 2))
    pick = tree.selected(nodes, tree.uct(nodes, tree.closure(nodes)), least=50).first()
    assert pick["node_id"] == 1
    rewards = spark.createDataFrame([("file_not_found", "X", 0, 0), (None, "FindClass", 0, 0), (None, "ViewCode", 0, 2), (None, "Finish", 0, 0)], "fail_reason string, action string, hits int, new_spans int")
    assert [r["reward"] for r in tree.rule_rewards(rewards).collect()] == [-50, 0, 50, 50]


# --- vectors and retrieval


def test_topk(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, query array<float>")
    got = vectors.topk(rows, q, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 0.0), (2, 1.0), (1, 25.0)]
    assert vectors.topk(rows.limit(0), q, 3).count() == 0 and vectors.topk(rows, q.limit(0), 3).count() == 0


def test_semantic_admits_one_more(spark):
    hits = [(1, k, f"f{k}.py", [(f"s{k}", 10)], k == 3) for k in range(1, 6)]
    df = spark.createDataFrame(hits, "query_id long, rank int, file_path string, spans array<struct<span_id:string,tokens:int>>, is_exact boolean")
    assert retrieval.semantic(df, max_results=3).count() == 4
    assert [r["file_path"] for r in retrieval.semantic(df, exact=True).collect()] == ["f3.py"]
    assert retrieval.semantic(df, max_tokens=15).count() == 2
    windows = retrieval.admitted_spans(df, 3, 8000)
    assert sorted(r["span_id"] for r in windows.collect()) == sorted(r["span_id"] for r in retrieval.semantic(df, max_results=3).collect())


def test_names_and_views(spark):
    blocks = spark.createDataFrame([("a.py", "A", None, "A", "class"), ("a.py", "A.m", "A", "m", "function"), ("t/test_a.py", "A.m", "A", "m", "function")], "file_path string, span_id string, class_name string, identifier string, type string").withColumn("class_name", F.coalesce("class_name", F.when(F.col("type") == "class", F.col("identifier"))))
    names = spark.createDataFrame([(1, "A", None), (2, "A", "m"), (3, None, "m")], "query_id long, class_name string, function_name string")
    got = {(r["query_id"], r["file_path"], r["span_id"]) for r in retrieval.by_name(blocks, names, category="implementation").collect()}
    assert got == {(1, "a.py", "A"), (1, "a.py", "A.m"), (2, "a.py", "A.m"), (3, "a.py", "A.m")}
    spans = spark.createDataFrame([("a.py", "A", 1, 3, 10), ("a.py", "A.m", 4, 9, 20), ("a.py", "f", 10, 12, 5)], "file_path string, span_id string, start_line int, end_line int, tokens int")
    asks = spark.createDataFrame([(1, "a.py", "A", None, None), (2, "a.py", None, 9, 10), (3, "a.py", None, None, None)], "request_id long, file_path string, span_id string, low int, high int")
    seen = {}
    for r in retrieval.viewed(spans, asks, 30).collect():
        seen.setdefault(r["request_id"], set()).add((r["span_id"], r["too_large"]))
    assert seen == {1: {("A", False), ("A.m", False)}, 2: {("A.m", False), ("f", False)}, 3: {("A", True), ("A.m", True), ("f", True)}}


def test_context(spark):
    spans = spark.createDataFrame([("a.py", "imports", "init", None, 1, 1, 3), ("a.py", "A", "init", "A", 2, 4, 5), ("a.py", "A.m", "impl", "A", 5, 9, 8)], "file_path string, span_id string, span_type string, class_name string, start_line int, end_line int, tokens int")
    none = spark.createDataFrame([], "node_id long, file_path string, pos int, span_id string, pinned boolean, tokens int")
    new = spark.createDataFrame([(1, "a.py", "A.m")], "node_id long, file_path string, span_id string")
    got = context.added(none, new, spans)
    assert {(r["span_id"], r["pinned"]) for r in got.collect()} == {("imports", True), ("A", False), ("A.m", False)}
    assert context.tokens(got).first()["tokens"] == 16
    left = context.removed(got, got.select("node_id", "file_path", "span_id"))
    assert [r["span_id"] for r in left.collect()] == ["imports"]
    ranges = spark.createDataFrame([(1, "a.py", 3, 6), (1, "a.py", 3, 20)], "node_id long, file_path string, low int, high int")
    assert [(r["low"], r["high"]) for r in context.covers(got, spans, ranges).collect()] == [(3, 6)]


# --- patches


def test_patches(spark):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -10,7 +10,8 @@ def f\n context\n+new\n"
    assert patches.hunk(10, 7, 8) == (13, 13, "modification")
    df = spark.createDataFrame([(1, patch), (2, "")], "instance_id long, patch string")
    got = patches.hunks(df)
    assert [tuple(r) for r in got.collect()] == [(1, "x.py", 13, 13, "modification")]
    other = spark.createDataFrame([(1, "x.py", 12, 14), (1, "y.py", 1, 2)], "instance_id long, file_path string, start_line int, end_line int")
    assert [tuple(r) for r in patches.compared(got, other).collect()] == [(1, 0, 0)]
    assert [tuple(r) for r in patches.compared(other, got).collect()] == [(1, 1, 2)]
    assert aggregates.patch_size(df).first()["additions"] == 1


# --- judging and choosing


@pytest.mark.parametrize("rag, dec, tr, want", [(4, 4, 3, "tree"), (5, 4, 4, "rag"), (3, 5, 4, "decompose"), (4, 4, 4, "tree")])
def test_best_of_three(spark, rag, dec, tr, want):
    assert one(spark, evaluation.best_of_three(F.lit(rag), F.lit(dec), F.lit(tr))) == want


def test_judging(spark):
    rows = spark.createDataFrame([("q", "the cat", "the cat"), ("q", "dog", "the cat")], "question string, answer string, ground_truth string")
    got = [r["score"] for r in evaluation.judged(rows, ports.judge).collect()]
    assert got == [5, 1]
    broken = evaluation.judged(rows, lambda prompts: ["no json"] * len(prompts))
    assert {r["score"] for r in broken.collect()} == {evaluation.BASIC}
    assert evaluation.kept(broken).count() == 0
    asks = spark.createDataFrame([("q", ["x = 1\ny"]), ("r", None)], "question string, codes array<string>")
    assert {r["question"]: r["rag_answer"] for r in evaluation.rag_answers(asks, ports.answer).collect()} == {"q": "x = 1", "r": evaluation.NO_CONTEXT}
    assert one(spark, evaluation.picked(F.lit(0.5), F.lit(0.5), F.lit(0.2))) == 0
    reply = json.dumps({"sub-questions": [{"description": "a", "dependencies": []}, {"description": "b", "dependencies": [0]}], "answer": "x"})
    subs = evaluation.decomposed(spark.createDataFrame([(1, reply)], "id long, reply string")).orderBy("position").collect()
    assert [s["is_independent"] for s in subs] == [True, False]


def test_ports():
    calls = []

    def small(texts):
        calls.append(len(texts))
        if len(texts) > 20:
            raise ValueError
        return ports.embed(texts, 4)

    assert len(ports.embed_batches(["x"] * 50, small)) == 50 and max(calls) == 50


# --- sources and sinks


def test_sources(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "What.txt").write_text("What is `<Class>`?\n\n  Why?  \n")
    got = files.templates(spark, str(tmp_path / "q")).collect()
    assert [(r["category"], r["template"]) for r in got] == [("What", "What is `<Class>`?"), ("What", "Why?")]
    (tmp_path / "src" / "t").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "t" / "test_a.py").write_text("y = 1\n")
    assert {(r["file_path"], r["category"]) for r in files.code_documents(spark, str(tmp_path / "src")).collect()} == {("a.py", "implementation"), ("t/test_a.py", "test")}
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "q", "answer": "a", "score": 3.0}, {"answer": "lost"}]))
    good, bad = files.qa_pairs(spark, str(tmp_path / "qa.json"))
    assert good.count() == 1 and bad.count() == 1
    pairs = spark.createDataFrame([("q", "a"), ("", "a"), ("q", None)], "question string, answer string")
    for form in (*files.FORMS, "unknown"):
        files.write_training(pairs, str(tmp_path / "out" / form), form)
        assert files.training_lines(pairs, form).count() == 1
    line = json.loads(spark.read.text(str(tmp_path / "out" / "openai")).first()["value"])
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]
    store = files.resolved_store(spark, str(tmp_path / "store"), lambda: spark.range(3))
    assert store.count() == 3 and files.resolved_store(spark, str(tmp_path / "store"), lambda: 1 / 0).count() == 3


def test_batches(spark):
    rows = spark.range(0, 250, 1, 1)
    kept = files.in_batches(rows, lambda rs: [{"n": len(rs)}] if rs[0]["id"] != 100 else 1 / 0, "n long", keep_going=True)
    assert sorted(r["n"] for r in kept.collect()) == [50, 100]


def test_stream_appends_once(spark, tmp_path):
    folder, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(folder)
    for k in range(2):
        with open(f"{folder}/{k}.json", "w") as f:
            f.write(json.dumps({"question": "Q", "answer": "A"}) + "\n" + json.dumps({"question": f"Q{k}", "answer": "A"}) + "\n")
        questions.run(spark, folder, target, state).awaitTermination(120)
    assert spark.read.parquet(target).count() == 3


# --- registered queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, int | str | bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


# --- values read off the reference's rules


def test_replies_without_the_keyword_give_no_integer(spark):
    got = lambda text, **k: one(spark, T.integer_for(F.lit(text), "reward", **k))
    assert got("I saw 42 files, no verdict") is None and got("<reward> 7 </reward>") == 7 and got("**Reward:** -3") == -3
    assert got("Reward: node 5") == 5 and got("<Reward>: Node_12") == 12 and got("reward 8") == 8
    assert got("<reward>150</reward> reward: 80", allowed=list(range(101))) == 80 and got("reward: 500", allowed=[1, 2]) is None
    node = lambda text: one(spark, T.node_id(F.lit(text)))
    assert [node(x) for x in ("expand node 5", "Node ID: 7", "suggested node: 3", '{"suggested_node_id": 9}', "see #4")] == [5, 7, 3, 9, None]


def test_durations_without_empty_parts(spark):
    assert [one(spark, T.duration(F.lit(x))) for x in (5.9, 65.0, 3600.0, 0.0)] == ["05s", "01m:05s", "01h:00m:00s", "00s"]


def test_globs_at_any_depth_or_anchored(spark):
    hit = lambda path, glob: one(spark, predicates.matches_any(F.lit(path), [glob]))
    assert hit("pkg/setup.py", "setup.py") and hit("setup.py", "/setup.py") and not hit("pkg/xsetup.py", "setup.py")
    assert hit("src/a/t1.py", "src/**/t*.py") and hit("src/t1.py", "src/**/t*.py") and not hit("x/src/a/t1.py", "src/**/t*.py")
    assert hit("x/a/b.py", "a/b.py") and hit("x/a/b.py", "a/*.py") and hit("x/y/b.py", "**.py") and not hit("x/a/b.py", "**/y/b.py")


def test_test_names(spark):
    paths = ["a/unittest_x.py", "tests_x.py", "FooTest.java", "a/testing/x.py", "a/tests/x.py", "x_test.py", "tests.py"]
    assert [one(spark, predicates.is_test(F.lit(p))) for p in paths] == [True, True, False, True, False, True, True]


def test_hunks_of_deleted_files_keep_their_path(spark):
    patch = "diff --git a/x/gone.py b/x/gone.py\n--- a/x/gone.py\n+++ /dev/null\n@@ -10,9 +0,0 @@\n-a\n"
    got = patches.hunks(spark.createDataFrame([("i", patch)], "instance_id string, patch string")).collect()
    assert [tuple(r) for r in got] == [("i", "x/gone.py", 13, 15, "deletion")]


def test_numbers_of_json_files(spark):
    names = spark.createDataFrame([("3.json",), ("9.log",), ("score.json",), ("x.json",), ("12.old.json",)], "file_name string")
    assert files.next_number(names).first()["next"] == 13


def test_training_records_hold_the_system_message(spark):
    pairs = spark.createDataFrame([("q", "a"), ("", "a"), (" ", "b")], "question string, answer string")
    keys = {f: [list(json.loads(r["value"])) for r in files.training_lines(pairs, f, "django").collect()] for f in files.FORMS[:-1]}
    assert keys == {"claude": [["messages"]] * 2, "openai": [["messages"]] * 2, "llama": [["system", "instruction", "output"]] * 2, "general": [["system_instruction", "question", "answer", "context"]] * 2}
    assert files.training_lines(pairs, "csv").columns == ["system", "question", "answer", "context"]
    roles = [m["role"] for m in json.loads(files.training_lines(pairs, "claude").first()["value"])["messages"]]
    assert roles == ["system", "human", "assistant"]


def test_paths_below_a_root_whose_name_repeats(spark, tmp_path):
    root = tmp_path / "src" / "p+" / "src"
    (root / "q").mkdir(parents=True)
    (root / "q" / "a.py").write_text("x = 1")
    assert [r["file"] for r in files.code_files(spark, str(root)).collect()] == ["q/a.py"]


def test_large_vectors_lose_no_neighbour(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = 1e5 + r.normal(size=(200, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = vectors.topk(df, df.where("vec_id = 0").selectExpr("vec_id as query_id", "embedding as query"), 5).orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == np.argsort(((v - v[0]) ** 2).sum(1), kind="stable")[:5].tolist()


def test_queries_beyond_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", 40)
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(150)], "vec_id long, embedding array<double>")
    got = vectors.topk(df, df.selectExpr("vec_id as query_id", "embedding as query"), 1).collect()
    assert sorted((x["query_id"], x["vec_id"]) for x in got) == [(i, i) for i in range(150)]


def test_lines_with_short_and_long_needles(spark):
    texts = spark.createDataFrame([(1, "one two three\nxtwo three four"), (2, "nothing\nwo threes")], "doc_id int, text string")
    needles = spark.createDataFrame([("a", "e two thr"), ("b", "two"), ("c", "two three four"), ("d", "wo  three")], "id string, needle string")
    got = {(r["doc_id"], r["id"], r["line"]) for r in predicates.line_search(texts, needles).collect()}
    assert got == {(1, "a", 1), (1, "b", 1), (1, "b", 2), (1, "c", 2)}
