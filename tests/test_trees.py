"""Block searches against a plain recursive walk over random trees, and hand-worked feedback and question cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks, feedback, templates, tree

TYPES = ("class", "function", "statement", "commented_out_code", "error")


def forest(seed: int) -> list[dict]:
    """Random trees in the order of a walk; ids aren't that order."""
    draw = random.Random(seed)
    ids = draw.sample(range(1000), 70)
    rows: list[dict] = []
    way: list[int] = []
    for ord_ in range(60):
        while way and (len(way) > 5 or draw.random() < 0.35):
            way.pop()
        if ord_ in (0, 30):
            way = []
        elif not way:
            way = [rows[0 if ord_ < 30 else 30]["block_id"]]
        rows.append({
            "block_id": ids[ord_], "parent_id": way[-1] if way else None, "ord": ord_, "type": draw.choice(TYPES) if way else "module", "identifier": draw.choice(["a", "b", None]),
            "content": draw.choice(["red hat", "blue", "", None]), "span_id": draw.choice(["s", "t", "u", None]) if way else None,
        })
        way.append(ids[ord_])
    return rows


class Walk:
    """The same searches by recursion over one tree."""

    def __init__(self, rows):
        self.by_id = {r["block_id"]: r for r in rows}
        self.kids = {r["block_id"]: [x for x in rows if x["parent_id"] == r["block_id"]] for r in rows}

    def below(self, r, own=True):
        return ([r] if own else []) + [y for k in self.kids[r["block_id"]] for y in self.below(k)]

    def by_path(self, r, path):
        for k in self.kids[r["block_id"]] if path else []:
            if k["identifier"] == path[0]:
                return self.by_path(k, path[1:])
        return None if path else r

    def last_of_span(self, r, span):
        for k in reversed(self.kids[r["block_id"]]):
            found = k if k["span_id"] == span else self.last_of_span(k, span)
            if found:
                return found
        return None

    def last_before(self, r, span, last=None):
        for k in self.kids[r["block_id"]]:
            if k["span_id"] == span:
                return last
            last = k if k["span_id"] else last
            found = self.last_before(k, span, last)
            if found:
                return found
        return None

    def relationships(self, r, exclude):
        return [r] + [y for k in self.kids[r["block_id"]] if k["type"] not in exclude for y in self.relationships(k, exclude)]


@pytest.mark.parametrize("seed", range(2))
def test_block_searches_equal_a_walk(spark, seed):
    rows = forest(seed)
    w = Walk(rows)
    b = spark.createDataFrame(rows, "block_id long, parent_id long, ord int, type string, identifier string, content string, span_id string").cache()
    paths = tree.closure(b.select(F.col("block_id").alias("node_id"), "parent_id")).cache()
    pairs = lambda df: sorted((r["start_id"], r["block_id"]) for r in df.select("start_id", "block_id").collect())
    want = lambda f: sorted((r["block_id"], x["block_id"]) for r in rows for x in f(r) if x)
    first = lambda xs: xs[:1]
    for span in (None, "s"):
        got = {r["block_id"] for r in blocks.has_content(b, paths, "red", span).collect()}
        assert got == {r["block_id"] for r in rows if any("red" in (x["content"] or "") and span in (None, x["span_id"]) for x in w.below(r))}
    assert not {r["block_id"] for r in blocks.has_content(b, paths, "").collect()} & {r["block_id"] for r in rows if not any(x["content"] for x in w.below(r))}
    roots = [r for r in rows if r["parent_id"] is None]
    asks = [(r["block_id"], list(p)) for r in roots for p in ((), ("a",), ("a", "b"), ("b", "a"), ("b", "b", "a"), ("z",))]
    got = {(r["root_id"], tuple(r["path"])): r["block_id"] for r in blocks.by_path(b, paths, spark.createDataFrame(asks, "root_id long, path array<string>")).collect()}
    led = {(i, tuple(p)): w.by_path(w.by_id[i], p) for i, p in asks}
    assert got == {k: x["block_id"] for k, x in led.items() if x}
    assert pairs(blocks.by_identifier(b, paths, "a")) == want(lambda r: first([x for x in w.kids[r["block_id"]] if x["identifier"] == "a"]))
    assert pairs(blocks.by_identifier(b, paths, "a", "class", True)) == want(lambda r: first([x for x in w.below(r, False) if x["identifier"] == "a" and x["type"] == "class"]))
    assert pairs(blocks.with_identifier(b, paths, "b")) == want(lambda r: [x for x in w.below(r, False) if x["identifier"] == "b"])
    assert pairs(blocks.with_types(b, paths, "class", "error")) == want(lambda r: [x for x in w.below(r) if x["type"] in ("class", "error")])
    assert pairs(blocks.first_of_type(b, paths, "error")) == want(lambda r: first([x for x in w.below(r) if x["type"] == "error"]))
    gaps = lambda r: any(x["type"] == "commented_out_code" for x in w.below(r))
    assert {r["block_id"] for r in blocks.complete(b, paths).collect()} == {r["block_id"] for r in rows if not gaps(r)}
    assert pairs(blocks.incomplete(b, paths, "class", "function")) == want(lambda r: [x for x in w.below(r, False) if x["type"] in ("class", "function") and gaps(x)])
    assert pairs(blocks.of_span(b, paths, "s")) == want(lambda r: [x for x in w.below(r) if x["span_id"] == "s"])
    assert pairs(blocks.first_of_span(b, paths, "s")) == want(lambda r: first([x for x in w.below(r) if x["span_id"] == "s"]))
    assert pairs(blocks.last_of_span(b, paths, "s")) == want(lambda r: [w.last_of_span(r, "s")])
    for span in ("s", "t", "u"):
        got = sorted((r["root_id"], r["block_id"]) for r in blocks.last_before_span(b, paths, span).collect())
        assert got == sorted((r["block_id"], x["block_id"]) for r in roots if (x := w.last_before(r, span)))
    assert {r["start_id"]: r["span_ids"] for r in blocks.span_ids(b, paths, False).collect()} == {r["block_id"]: s for r in rows if (s := sorted({x["span_id"] for x in w.below(r, False) if x["span_id"]}))}
    links = b.select("block_id", F.col("ord").alias("target"))
    assert pairs(blocks.relationships(b, paths, links, "function")) == want(lambda r: w.relationships(r, ("function",)))
    told = blocks.errors(b.withColumns({"messages": F.when(F.col("ord") % 2 == 0, F.array(F.lit("m"), F.lit("n"))), "path": F.array(F.lit("p"), F.lit("q"))}), paths)
    assert sorted(r["error"] for r in told.collect()) == sorted(e for r in rows for x in w.below(r) if x["type"] == "error" for e in (["m", "n"] if x["ord"] % 2 == 0 else ["Found validation errors in p.q"]))


def test_path_tries(spark):
    trie = lambda rows: {tuple(r["path"]): r["show"] for r in blocks.path_trie(spark.createDataFrame(rows, "path array<string>")).collect()}
    assert trie([(["a", "b"],), (["a"],), (["c", "d"],), (None,)]) == {(): False, ("a",): True, ("a", "b"): True, ("c",): False, ("c", "d"): True}
    assert trie([([],)]) == {(): True} and trie([(None,)]) == {}
    own = spark.createDataFrame([("A.m",), ("",)], "block_path string")
    links = spark.createDataFrame([("A.m", "file", ["B"]), ("A.m", "external", ["os"]), ("C", "file", ["D"])], "block_path string, scope string, path array<string>")
    assert {tuple(r["path"]): r["show"] for r in blocks.path_tree(own, links).collect()} == {(): True, ("A",): False, ("A", "m"): True, ("B",): True}


def test_attribute_lines(spark):
    rows = spark.createDataFrame([("class A:\n  xy = 1\n  x = 2", "x"), ("a", "x"), (None, "x")], "code string, name string")
    assert [r[0] for r in rows.select(blocks.attribute_line(F.col("code"), F.col("name"))).collect()] == [2, None, None]


NODES = "search_id long, node_id long, parent_id long, pos int, action string, args string, observation string, reward int, explanation string, feedback string, suggested_node_id long"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        (1, 1, None, 0, None, None, None, None, None, None, 3), (1, 2, 1, 1, "Finish", "{}", "seen", 80, "good", None, None), (1, 3, 1, 2, "View", "{p}", None, 10, "so", "look here", 3),
        (1, 4, 3, 3, "Finish", "{}", None, 60, "fair", "later", None), (1, 5, 3, 4, None, None, None, None, None, None, 1),
    ]
    return spark.createDataFrame(rows, NODES)


def test_suggested_node_or_the_latest(spark, nodes):
    assert [tuple(r) for r in feedback.suggested(nodes).collect()] == [(1, 3)]
    assert [tuple(r) for r in feedback.suggested(nodes.where("node_id <> 3")).collect()] == [(1, 5)]


def test_choice_by_reply(spark, nodes):
    ask = lambda *replies: spark.createDataFrame([(1, k, r) for k, r in enumerate(replies, 1)], "search_id long, attempt int, reply string")
    said = lambda *replies: tuple(feedback.chosen(nodes, ask(*replies)).first())[1:]
    assert said("<node_id>: 4\n<feedback>: 9") == (4, "reply") and said("9", "take 2 of 4") == (2, "reply")
    assert said("9", "8", None, "4") == (1, "first") and said("no") == (1, "first")
    assert tuple(feedback.chosen(nodes.where("node_id = 2"), ask("4")).first()) == (1, 2, "only")


def test_previous_attempts(spark, nodes):
    paths = tree.closure(nodes.select("node_id", "parent_id"))
    got = [tuple(r) for r in feedback.previous_attempts(nodes, paths).orderBy("node_id", "attempt").collect()]
    assert got == [(3, 1, 2, 80, "good", None), (4, 1, 2, 80, "good", None), (5, 1, 2, 80, "good", None), (5, 2, 4, 60, "fair", "look here")]


def test_analyses_and_feedback(spark, nodes):
    got = {r["node_id"]: r for r in feedback.analyses(nodes).collect()}
    assert set(got) == {2, 3, 4, 5} and got[3]["finished"] and not got[2]["finished"]
    assert got[3]["relations"] == "Current node: 3\nParent node: 1\nSibling nodes: [2]\nChild nodes: [4, 5]"
    assert got[3]["attempts"] == "<attempt_2>\nAction: Finish({})\nObservation:\nseen\n</attempt_2>" and got[4]["attempts"] == ""

    def port(prompts):
        return [json.dumps({"analysis": "a", "feedback": "retry" if "finished" in p else "go", "suggested_node_id": 3}) for p in prompts]

    told = {r["node_id"]: tuple(r)[1:] for r in feedback.generated(nodes, port).collect()}
    assert told == {2: ("a", "go", 3), 3: ("a", "retry", 3), 4: ("a", "go", 3), 5: ("a", "retry", 3)}
    assert {r["suggested_node_id"] for r in feedback.generated(nodes, port, suggest=False).collect()} == {None}
    assert feedback.generated(nodes, lambda ps: ["?"] * len(ps)).where("feedback is null").count() == 4


def test_scales_and_logs(spark):
    scale = spark.createDataFrame([("x", *e) for e in feedback.REWARD_SCALE], "action string, min_value int, max_value int")
    assert tuple(feedback.reward_range(scale, "action").first()) == ("x", -100, 100)
    assert [len(r[0]) for r in spark.range(2, 4).select(feedback.criteria(F.col("id"))).collect()] == [2, 3]
    row = spark.sql("select 7L as node_id, timestamp'2024-01-02 03:04:05' as at, '' as system, array(named_struct('role', 'user', 'content', 'hi')) as messages, 'r' as reply")
    lines = feedback.log(row).first()["entry"].split("\n")
    assert lines[1] == "Node 7 - 2024-01-02 03:04:05" and lines[lines.index("SYSTEM PROMPT") + 2] == "No system prompt provided"
    assert "[Message 1 - user]" in lines and lines[lines.index("COMPLETION") + 2] == "r"
    assert spark.range(1).select(T.stamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "20240102_030405"


def test_category_questions(spark):
    code = {"A": "class A: ...", "m": "def m(self, p):\n    self.x = B(1)\n    return self.n()", "n": "@cached\ndef n(self):\n    k = self.xy", "g": "def g(q):\n    t = 1\n    return t == q"}
    classes = spark.createDataFrame([("A", code["A"], "pkg/a.py", 0, "Handles red hats. Etc")], "name string, code string, file string, pos long, docstring string")
    functions = spark.createDataFrame(
        [("m", "A", True, code["m"], ["self", "p"], "pkg/a.py", 1, "Do it. Now"), ("n", "A", True, code["n"], ["self"], "pkg/a.py", 2, None), ("g", None, False, code["g"], ["q"], "pkg/test_b.py", 3, None)],
        "name string, class_name string, is_method boolean, code string, parameters array<string>, file string, pos long, docstring string",
    )
    attributes = spark.createDataFrame([("x", "A"), ("xy", "A")], "name string, class_name string")
    modules = spark.createDataFrame([("pkg/a.py", "pkg"), ("pkg/test_b.py", "")], "file string, module string")
    things = templates.category_entities(classes, functions, attributes, modules).cache()

    def asked(category, template):
        df = spark.createDataFrame([(category, template)], "category string, template string")
        return sorted((r["question"], [next(k for k, v in code.items() if v == c) for c in r["codes"]]) for r in templates.category_questions(df, things, functions).collect())

    assert asked("Where", "<Class> <Method>") == [("A m", ["A", "m"]), ("A n", ["A", "n"])]
    assert asked("Where", "<Method>") == [("m", ["m", "A"]), ("n", ["n", "A"])] and asked("Where", "<Function>") == [("g", ["g"])]
    assert asked("Where", "<Class> <Field>") == [] and asked("What", "<Class> <Field>") == [("A x", ["A"]), ("A xy", ["A"])]
    assert asked("What", "<Term>") == [("A", ["A"]), ("g", ["g"]), ("m", ["m", "A"]), ("n", ["n", "A"])]
    assert asked("What", "<Class> <Parameter>") == [] and asked("What", "<Function> <Module>") == [("m pkg", ["m"]), ("n pkg", ["n"])]
    assert asked("What", "<Function> <Context>") == [("g the codebase", ["g"]), ("m Do it. Now", ["m"]), ("n the codebase", ["n"])]
    assert asked("What", "<Method> <Parameter>") == [("m p", ["m"])]
    # `self.x` is a start of `self.xy`, which counts as a use.
    assert asked("What", "<Variable>") == [("x", ["m", "n"]), ("xy", ["n"])]
    assert asked("How", "<Class> <Variable>") == [("A x", ["A", "m", "n"]), ("A xy", ["A", "n"])]
    assert asked("How", "<Class> <Method>") == [("A m", ["A", "m"]), ("A n", ["A", "n", "m"])]
    assert asked("How", "<Class> <Feature>") == sorted([(f"A {f}", ["A"]) for f in ("red hats", *templates.FEATURES)])
    assert asked("How", "<Method> <Logic>") == [("m Do it", ["m"])] and asked("How", "<Method> <Object>") == [("m B", ["m"])]
    assert asked("How", "<Function> <Decorator>") == [("n cached", ["n"])] and asked("How", "<Function> <Logic>")[0] == ("g this codebase", ["g"])
    assert asked("How", "<Function> <Variable>") == [("g q", ["g"]), ("g t", ["g"]), ("m p", ["m"]), ("m self", ["m"]), ("n k", ["n"]), ("n self", ["n"])]
    assert asked("How", "<Attribute> <Context>") == [("x m", ["m"]), ("x n", ["n"]), ("xy n", ["n"])]
    assert asked("How", "<Method> <Attribute> <Context>") == [] and asked("How", "how are tests run?") == [("how are tests run?", ["g"])] and asked("How", "why?") == []
