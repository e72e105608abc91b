import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import answers
from lodestrand.functions.headers import is_header, last_group
from lodestrand.functions.text import base_identifier, called_name, code_tokens, diff_features, diff_side, line_number, line_tokens, strip_comments, variable_paths
from lodestrand.operators import align, cfg, diffs, graphs, grouping, knowledge, lookup, mapping, rank, ranges, scoring, slices, validate, versions
from lodestrand.plans import index_queries, matching, storage
from lodestrand.sources import git, tables
from lodestrand.streaming import index
from lodestrand.sources.csource import functions as c_functions


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "c string").select(make(F.col("c"))).first()[0]


def test_code_tokens(spark):
    got = sorted(one(spark, "XMLParser read_node if ab 123 \u00e9aux skb READ_NODE", code_tokens))
    assert got == sorted({"XMLParser", "XML", "Parser", "read_node", "read", "node", "\u00e9aux", "READ_NODE", "READ", "NODE"})
    assert one(spark, None, code_tokens) is None


def test_comments_keep_lines(spark):
    assert one(spark, "a /* x\n y */ b // tail\nc", strip_comments) == "a \n b \nc"


def test_line_tokens_and_numbers(spark):
    assert one(spark, "[ 12] p->nextNode = read_len(x2); // why", line_tokens) == ["p", "->", "next", "node", "=", "read", "len", "x", "2"]
    assert one(spark, "[ 12] x", line_number) == 12 and one(spark, "x", line_number) == -1


def test_variable_paths(spark):
    assert one(spark, "if (dev->q.len > n) total = dev->q.len;", variable_paths) == ["dev->q.len", "total"]


def brute_align(sim, nos):
    """The alignment's score by plain recursion over the definition."""
    n, m = sim.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        cost = 0.0 if i == n else 0.1 / max(1, nos[i] - nos[i - 1])
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + sim[i - 1, j - 1], best[i, j - 1] - cost, best[i - 1, j])
    return best[n, m]


def test_alignment_scores_like_the_recursion():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, m = rng.integers(1, 7, 2)
        sim = np.round(rng.random((n, m)) * 0.98 + 0.01, 2)  # a match of similarity 0 is none on the way back
        nos = list(np.cumsum(rng.integers(1, 4, n)))
        pairs, penalty = align.align(sim, nos)
        assert abs(sum(sim[i, j] for i, j in pairs) - penalty - brute_align(sim, nos)) < 1e-9
        assert pairs == sorted(pairs)


def test_line_tags_pair_changed_lines():
    pre, post, changed = align.line_tags([["a"], ["b", "c"], ["d"]], [["a"], ["b", "x"], ["d"]])
    assert (pre, post, changed) == (["COMMON", "VULN", "COMMON"], ["COMMON", "FIX", "COMMON"], [(1, 1)])


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 100, 101, 200]], "id int")
    got = {r.id: r.component for r in graphs.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100, 200: 200}


def test_definition_of_a_qualified_name(spark):
    symbols = spark.createDataFrame([("f", i) for i in range(7)], "name string, at int")
    names = spark.createDataFrame([("struct f",), ("g",)], "name string")
    assert [r.at for r in lookup.definitions(symbols, names, "name", ["at"]).orderBy("at").collect()] == [0, 1, 2, 3, 4]


def test_nested_spans(spark):
    spans = spark.createDataFrame([("u", 1, 9, "outer"), ("u", 2, 3, "inner"), ("w", 0, None, "open"), ("w", 5, 4, "never")], "k string, s int, e int, n string")
    points = spark.createDataFrame([("u", 3), ("u", 5), ("u", 1), ("v", 1), ("w", 900)], "k string, at int")
    got = {(r.k, r["at"]): r.enclosing for r in ranges.enclosing(points, spans, "k", "at", "s", "e", "n").collect()}
    assert got == {("u", 3): "inner", ("u", 5): "outer", ("v", 1): "unknown", ("w", 900): "open"}


def test_every_link_has_a_category(spark):
    assert knowledge.chain_links(spark).join(knowledge.categories(spark), "category", "left_anti").isEmpty()


def test_index_round_trip(spark, tmp_path):
    symbols = spark.createDataFrame([(1, "f")], "unit_id int, name string")
    postings = spark.createDataFrame([("tok", 1), ("tok", 1)], "token string, unit_id int")
    storage.write_index(symbols, postings, str(tmp_path))
    assert [t.count() for t in storage.read_index(spark, str(tmp_path))] == [1, 1]
    with pytest.raises(storage.MissingIndex):
        storage.read_index(spark, str(tmp_path / "none"))


def test_phase_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [storage.phase(spark, str(tmp_path), "p", make).count() for _ in range(2)] == [3, 3] and len(made) == 1


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_text("int f(void) { return 1; }\n")
    (tmp_path / "src/a.txt").write_text("no")
    (tmp_path / "tools").mkdir()
    (tmp_path / "tools/b.c").write_text("int g;")
    assert [r.path.rsplit("/", 1)[1] for r in tables.source_files(spark, str(tmp_path)).collect()] == ["a.c"]
    (tmp_path / "r.csv").write_text("repo,version\nx,1\n")
    assert tables.repositories(spark, str(tmp_path / "r.csv")).collect()[0].asDict() == {"repository": "x", "version": "1"}
    (tmp_path / "v.csv").write_text("repo,vul_id,fixed_commit_sha\nr,v,b\nr,v,a\nr,w,c\n")
    assert [r.fixed_commit_sha for r in tables.vulnerabilities(spark, str(tmp_path / "v.csv"), most=5).collect()] == ["a", "c"]
    (tmp_path / "b.json").write_text('{"v": {"versions": {"pre": {"1.0": {"a.c": {"f": "int f;"}}}}}}')
    assert [r.func_name for r in tables.versioned_functions(spark, str(tmp_path / "b.json")).collect()] == ["f"]
    (tmp_path / "m.json").write_text('{"CVE-1": {"cwe_ids": ["CWE-416"], "cwe_names": [], "description": "d"}}')
    assert tables.metadata(spark, str(tmp_path / "m.json")).first().cwe_ids == ["CWE-416"]


def test_c_functions(spark):
    code = "/* f(x) { */\nstruct point { int x; };\nstatic int\nadd(int a, int b)\n{\n  if (a) { return b; } // }\n  return '}' + a;\n}\n#define MAX(a) (a)\nint proto(void);\nvoid g(void) { add(1, 2); }\n"
    got = {(r["kind"], r["name"]): (r.start_line, r.end_line) for r in c_functions(spark.createDataFrame([("p.c", code), ("q.c", None)], "path string, text string")).collect()}
    assert got == {("struct", "point"): (2, 2), ("function", "add"): (3, 8), ("macro", "MAX"): (9, 9), ("function", "g"): (11, 11)}


def edges_of(code):
    b = cfg._Builder(code)
    b.build()
    text = {n: (t or n) for n, *_, t in b.nodes}
    return {(text[a], text[z]) for a, z in b.edges}


def test_flow_of_short_circuits_and_loops():
    got = edges_of("int f(int a, int b)\n{\n  if (a && b) return 1;\n  while (a) { a--; if (b) break; continue; }\n  return 0;\n}\n")
    assert got == {
        ("ENTRY", "a"), ("a", "b"), ("a", "a"), ("b", "return 1"), ("return 1", "EXIT"), ("b", "a"), ("a", "a--"), ("a--", "b"), ("b", "break"), ("break", "return 0"),
        ("b", "continue"), ("continue", "a"), ("a", "return 0"), ("return 0", "EXIT"),
    }


def test_flow_of_for_switch_do_and_goto():
    assert edges_of("void f(void) { for (i = 0; i < n; i++) g(i); }") == {("ENTRY", "i = 0"), ("i = 0", "i < n"), ("i < n", "g(i)"), ("g(i)", "i++"), ("i++", "i < n"), ("i < n", "EXIT")}
    assert edges_of("void f(int k) { switch (k) { case 1: a(); case 2: b(); break; } c(); }") == {
        ("ENTRY", "k"), ("k", "case 1:"), ("case 1:", "a()"), ("k", "case 2:"), ("a()", "case 2:"), ("case 2:", "b()"), ("b()", "break"), ("break", "c()"), ("k", "c()"), ("c()", "EXIT"),
    }
    assert edges_of("void f(void) { do { a(); } while (b()); c(); }") == {("ENTRY", "a()"), ("a()", "b()"), ("b()", "a()"), ("b()", "c()"), ("c()", "EXIT")}
    assert edges_of("void f(void) { a(); goto out; b(); out: c(); exit(1); d(); }") == {("ENTRY", "a()"), ("a()", "goto out"), ("goto out", "out:"), ("b()", "out:"), ("out:", "c()"), ("c()", "exit(1)"), ("exit(1)", "EXIT"), ("d()", "EXIT")}


def test_accesses():
    assert cfg.accesses("p->n += q[i] + f(&r)") == [("i", "use"), ("p->n", "def"), ("p->n", "use"), ("q", "use"), ("r", "def"), ("r", "use")]
    assert cfg.accesses("int x = y") == [("x", "def"), ("y", "use")]


def test_functions_that_cannot_be_read(spark):
    nodes, flow, _ = cfg.program_graphs(spark.createDataFrame([("a", None), ("b", "void f(")], "func_id string, code string"))
    assert {(r.func_id, r.src, r.dst) for r in flow.collect()} == {("a", "ENTRY", "EXIT"), ("b", "ENTRY", "EXIT")}


def test_control_dependence_of_a_branch(spark):
    flow = spark.createDataFrame([("f", a, b) for a, b in (("ENTRY", "c"), ("c", "x"), ("c", "y"), ("x", "y"), ("y", "EXIT"))], "func_id string, src string, dst string")
    assert [(r.src, r.dst) for r in graphs.control_dependence(flow).collect()] == [("c", "x")]


def test_index_follows_a_folder(spark, tmp_path):
    def run():
        index.follow(spark, str(tmp_path / "in"), "id int, code string", "id", "code", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.token, r.unit_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    spark.createDataFrame([(1, "alpha beta")], "id int, code string").write.parquet(str(tmp_path / "in"))
    assert run() == [("alpha", 1), ("beta", 1)]
    spark.createDataFrame([(2, "beta")], "id int, code string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [("alpha", 1), ("beta", 1), ("beta", 2)]


def test_line_mapping():
    assert mapping.map_lines(["a", "b", "old"], ["a", "new one", "b"]) == [(1, 1, "EXACT"), (2, 3, "EXACT"), (3, None, "UNIQUE_PRE"), (None, 2, "UNIQUE_POST")]
    assert mapping.map_lines(["x = 1;"], ["x  =  1;"]) == [(1, 1, "WHITESPACE")]
    assert mapping.map_lines(["x"], ["y"]) == [(1, 1, "MODIFIED")]


def test_snippets_and_paths():
    assert [mapping.find_snippet("int a;\nfoo( 1,\n  2);\n", s) for s in ("int a", "foo(1,2)", "none", " ")] == [1, 2, -1, -1]
    near = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["a"]}
    assert mapping.shortest_path(near, "a", "d") == ["a", "b", "d"] and mapping.shortest_path(near, "a", "a") == ["a", "b", "d", "a"]
    assert mapping.shortest_path(near, "a", "z") == []


RING = [
    "int put(struct ring *ring, int slot, int value)\n{\n  ring->cell[slot] = value;\n  ring->used++;\n  return 0;\n}\n",
    "int keep(struct ring *r, int slot, int value)\n{\n  if (slot >= r->limit)\n    return -1;\n  r->cell[slot] = value;\n  r->used++;\n  return 0;\n}\n",
    "void report(int value)\n{\n  print(value);\n}\n",
]


def test_siblings_of_a_patch(spark):
    """A bounds check that one sibling lacks, one has, and one has no use for."""
    patches = frame(spark, [("bound", RING[0].replace("ring->", "r->").replace("put", "store"), RING[1].replace("keep", "store"))], "group_id string, pre string, post string")
    found = matching.match(patches, frame(spark, list(enumerate(RING, 1)), "unit_id int, code string"))
    got = {r.unit_id: (r.verdict, r["rank"]) for r in found.collect()}
    assert got == {1: ("VULNERABLE", 0), 2: ("PATCHED", -1), 3: ("VULNERABLE", 1)}  # without anchors nothing is below one half
    assert values(matching.summary(found), "verdict", "n") == [("PATCHED", 1), ("VULNERABLE", 2)]


def test_answers():
    assert answers.parse_json('Sure:\n```json\n{"a": [1, 2,], "b": {"c": "}"}}\n``` done') == {"a": [1, 2], "b": {"c": "}"}}
    assert answers.parse_json('{"result": {"a": 1, "b": 2}}') == {"a": 1, "b": 2}
    assert answers.parse_json('{"a": 1, "b": [2, {"c": "open') == {"a": 1, "b": [2, {"c": "open"}]}
    assert answers.parse_json("none") is None and answers.parse_json(None) is None


def test_retries():
    waits, left = [], [OSError("429"), OSError("reset")]

    def call():
        if left:
            raise left.pop(0)
        return "yes"

    assert answers.with_retries(call, wait=waits.append) == "yes" and waits == [30.0, 4.0]

    def refused():
        raise answers.Refused

    assert answers.with_retries(refused, wait=waits.append) is None and len(waits) == 2


def test_parsed_answers(spark):
    rows = spark.createDataFrame([('x {"ok": true}',), (None,), ("-",)], "raw string")
    assert [r.parsed.ok if r.parsed else None for r in answers.parsed(rows, "raw", "ok boolean").collect()] == [True, None, None]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def test_line_tokens_of_any_script(spark):
    assert one(spark, "über foo", line_tokens) == ["ber", "foo"]
    assert one(spark, "[ 3] 中文_x9½ é a->b a /* x // y */ b", line_tokens) == ["中文", "x", "9", "é", "a", "->", "b", "a", "/", "*", "x"]


def test_names_and_features(spark):
    assert one(spark, "*(p->q) + 1", base_identifier) == "p" and one(spark, "if (a) foo (b)", called_name) == "foo" and one(spark, "while (x)", called_name) is None
    diff = "@@ -1 +1 @@\n-  old(p->len); // note(x)\n+  put(p->cap, \"s(t)\");\n keep.it = sizeof(n);\n--- a\n"
    got = spark.createDataFrame([(diff,)], "d string").select(diff_features(F.col("d")).alias("f"), diff_side(F.col("d"), "-").alias("m"), diff_side(F.col("d"), "+").alias("p")).first()
    assert (sorted(got.f.calls), sorted(got.f.members), sorted(got.f.tokens)) == (["old", "put"], ["cap", "it", "len"], ["a", "keep", "n", "old", "p", "put"])
    assert got.m == ["old(p->len); // note(x)"] and got.p == ['put(p->cap, "s(t)");']


def test_headers():
    yes = ["static int f(int a)", "[ 12] void MACH0_(go)(char *x, int y) {", "int main()", "R_API void r(void)", "UT32 *make(const char *s)", "struct x *f(struct y *a);"]
    no = ["", "x = f(a, b);", "if (int_ok(a)) {", "return f(int);", "int x = 3;", "free(p)", "int n = count(x);"]
    assert [is_header(x) for x in yes] == [True] * len(yes) and [is_header(x) for x in no] == [False] * len(no)
    assert last_group("a(b)(c(d), e) f") == "c(d), e"


def test_grep_modes(spark):
    rows = frame(spark, [(1, 1, "a.b = c"), (1, 2, "axb y"), (1, 3, "f(x)"), (2, 1, "  über a.b")], "unit_id int, line_no int, line string")
    hits = lambda p, m="word", **k: values(lookup.grep(rows, p, m, **k), "unit_id", "line_no", "type", "method")
    assert hits("a.b") == [(1, 1, "match", "word_match"), (2, 1, "match", "word_match")] and hits("f(") == [(1, 3, "match", "word_match")] and hits("ber") == []
    assert [r[:2] for r in hits("a.b", "regex")] == [(1, 1), (1, 2), (2, 1)] and hits("(", "regex") == [(None, None, "error", "error")]
    assert [r[:2] for r in hits("a.b", scope=(1, 1))] == [(1, 1), (2, 1)]
    nodes = frame(spark, [(1, 2, "axb y", ["axb"], ["y"]), (2, 1, "z", ["z"], [])], "unit_id int, line_no int, code string, defs array<string>, uses array<string>")
    assert hits("axb", "def_use", scope=(1, 3), nodes=nodes) == [(1, 2, "def", "precise_pdg")]
    assert hits("a.b", "def_use", scope=(1, 3), nodes=nodes) == [(1, 1, "match", "word_match"), (2, 1, "match", "word_match")]
    page = lookup.page(lookup.grep(rows, "[a-z]", "regex"), 1, 2).collect()
    assert [(r.place, r.total, r.has_more, r.next_cursor) for r in page] == [(2, 4, True, 3), (3, 4, True, 3)]


def test_callers_of_a_page(spark):
    calls = frame(spark, [(1, 1, "int f() {"), (1, 3, "use()"), (1, 9, "use()"), (1, 12, "use()")], "unit_id int, line_no int, line string")
    functions = frame(spark, [(1, "f", 1, 5), (1, "g", 11, 15)], "unit_id int, name string, start_line int, end_line int")
    assert values(lookup.enclosing_callers(calls, functions), "line_no", "caller", "place") == [(12, "g", 3), (3, "f", 1), (9, "unknown", 2)]
    assert values(lookup.enclosing_callers(calls, functions, 1), "line_no", "caller") == [(3, "f")]


OLD = "#define CAP(x) (x)\nstruct ring {\n  int n;\n};\nint size(struct ring *r)\n{\n  return r->n;\n}\n"
NEW = OLD + "static int grow(struct ring *r)\n{\n  if (size(r) > CAP(3)) return size(r);\n  total = size(r);\n  return 0;\n}\n"


def test_versions(spark):
    blobs = frame(spark, [("v1", "a.c", OLD), ("v2", "a.c", NEW), ("v2", "b.c", "int x;\n"), ("v1", "c.c", "gone"), ("v2", "n.txt", "size(")], "version string, path string, text string")
    commits = frame(spark, [("v2", "v1", " grow it \n"), ("v1", None, "first")], "version string, parent string, message string")
    changed = {r.path: (r.old_text, r.new_text) for r in versions.changed_files(blobs, commits).collect()}
    assert changed == {"a.c": (OLD, NEW), "b.c": (None, "int x;\n"), "c.c": ("gone", None)}
    wanted = frame(spark, [("v2", "a.c"), ("v2", "none.c")], "version string, path string")
    assert values(versions.content_at(blobs, wanted), "path", "text") == [("a.c", NEW), ("none.c", "")]
    assert [r.message for r in versions.messages(commits, wanted.limit(1)).collect()] == ["grow it"]
    symbols = versions.symbols_at(blobs)
    assert values(versions.functions_in(symbols, wanted), "name", "place", "start_line") == [("grow", 2, 9), ("size", 1, 5)]
    names = frame(spark, [("v2", n) for n in ("size", "ring", "CAP", "grow", "n")], "version string, name string")
    assert values(versions.symbol_code(symbols, names), "name", "kind") == [("CAP", "macro"), ("grow", "function"), ("ring", "struct"), ("size", "function")]
    assert values(versions.definitions_at(blobs, names), "name", "kind", "path", "line_no") == [("CAP", "macro", "a.c", 1), ("grow", "function", "a.c", 9), ("ring", "struct", "a.c", 2), ("size", "function", "a.c", 5)]
    assert values(versions.callers_at(blobs, symbols, names), "name", "path", "caller", "line_no") == [("CAP", "a.c", "global/unknown", 1), ("CAP", "a.c", "grow", 11), ("size", "a.c", "grow", 11), ("size", "a.c", "grow", 12), ("size", "n.txt", "global/unknown", 1)]
    old, new = (symbols.where(f"version = '{v}' and kind = 'function'").withColumn("version", F.lit("c")) for v in ("v1", "v2"))
    assert values(versions.changed_functions(old, new), "name", "change_type", "start_line_new") == [("grow", "ADDED", 9)]


def test_is_definition(spark):
    rows = [("function", "int f(int a)", True), ("function", "f(int a)", False), ("function", "x = f(a)", False), ("function", "g(f(a))", False), ("macro", "#define f(a)", True), ("macro", "#define g f", False), ("struct", "enum f {", True), ("struct", "struct g f", False)]
    got = frame(spark, rows, "kind string, line string, want boolean").withColumn("got", versions.is_definition(F.col("kind"), F.col("line"), F.lit("f")))
    assert got.where("got <> want").collect() == []


def test_unified_diffs(spark):
    pairs = frame(spark, [(1, "a.c:f", "one\ntwo\nthree\n", "one\n2\nthree\n", 100, 200), (2, "b", "same", "same", 1, 1), (3, "c", None, "new\n", 1, 7)], "pair_id int, name string, old string, new string, old_start int, new_start int")
    got = {r.pair_id: r.diff for r in diffs.unified(pairs).collect()}
    assert got == {1: "--- a/a.c:f\n+++ b/a.c:f\n@@ -100,3 +200,3 @@\n one\n-two\n+2\n three\n", 2: None, 3: "--- a/c\n+++ b/c\n@@ -0,0 +7,1 @@\n+new\n"}
    back = diffs.hunk_lines(frame(spark, [(1, got[1])], "id int, d string"), "id", "d")
    assert values(diffs.changed_lines(back), "sign", "line_no", "code") == [("+", 201, "2"), ("-", 101, "two")]


def item(i, func="f", file="a.c", deleted=(), added=()):
    return {"id": i, "func": func, "file": file, "deleted": set(deleted), "added": set(added)}


def test_refinement():
    assert grouping.refined([item("1"), item("2", "g")], set()) == [["1", "2"]]
    assert grouping.refined([item("1"), item("2", file="b.c"), item("3", "g")], set()) == [["1", "3"], ["2"]]
    same = [item("1", "f", added=["x"]), item("2", "g", added=["x"]), item("3", "h"), item("4", "k")]
    assert grouping.refined(same, {frozenset("13")}) == [["1", "3"], ["2"], ["4"]]
    assert grouping.refined(same, {frozenset("12")}) == [["1", "2", "3", "4"]]
    moved = [item("1", "f", added=["x"], deleted=["y"]), item("2", "g", added=["x", "y"])]
    assert grouping.refined(moved, set()) == [["1", "2"]]


def test_groups_of_a_commit(spark):
    rows = [
        ("c", "1", "a.c", "open", "@@ -1 +1 @@\n+  read(p);\n@@ -9 +9 @@\n-  q->len = 1;"), ("c", "2", "a.c", "read", "@@ -1 +1 @@\n+  if (n) return;"), ("c", "3", "b.c", "lone", "+  x = 1;"),
        ("c", "4", "a.c", "peek", "+  y = q->len;"), ("d", "1", "a.c", "open", "+  read(p);"),
    ]
    patches = frame(spark, rows, "commit string, id string, file string, func string, diff string")
    edges = values(grouping.patch_edges(grouping.with_features(patches)), "commit", "a", "b", "type")
    assert edges == [("c", "1", "2", "call"), ("c", "1", "4", "data")]
    groups = grouping.function_groups(patches)
    assert values(groups, "commit", "part", "id") == [("c", "1", "1"), ("c", "1", "2"), ("c", "1", "4"), ("c", "3", "3"), ("d", "1", "1")]
    cut = grouping.hunks(patches)
    assert values(cut, "commit", "id", "at") == [("c", "1#0", 0), ("c", "1#2", 2), ("c", "2#0", 0), ("c", "3#0", 0), ("c", "4#0", 0), ("d", "1#0", 0)]
    assert values(grouping.hunk_edges(grouping.with_features(cut)), "a", "b", "type") == [("1#2", "4#0", "data_inter")]
    merged = grouping.hunk_groups(patches, groups)
    assert {(r.commit, r.id): r.diff for r in merged.collect()}[("c", "1")] == rows[0][4]


CODE = "int f(int a,\n      int b)\n{\n  int x = a;\n  if (x >\n      b)\n    x = g(b,\n          a);\n  return x;\n}"


def test_slices_as_text(spark):
    functions = frame(spark, [("f", CODE, 40)], "func_id string, code string, start_line int")
    nodes, flow, _ = cfg.program_graphs(functions)
    span = {r.code: (r.node, r.line, r.end_line) for r in nodes.collect()}
    assert span["x > b"][1:] == (5, 6) and span["x = g(b, a)"][1:] == (7, 8)
    chosen = frame(spark, [("f", "ENTRY"), ("f", span["x > b"][0]), ("f", "EXIT")], "func_id string, node string")
    assert values(slices.slice_text(slices.slice_lines(chosen, nodes), functions), "text") == [("[  40] int f(int a,\n[  44]   if (x >\n[  45]       b)",)]
    anchors = frame(spark, [("f", "cond", 6), ("f", "call", 8), ("f", "none", 10)], "func_id string, anchor string, line int")
    assert values(slices.expanded_anchors(anchors, nodes), "anchor", "line") == [("call", 7), ("call", 8), ("cond", 5), ("cond", 6), ("none", 10)]
    places = frame(spark, [("p", 44), ("p", 90)], "path string, line int")
    spans = frame(spark, [("p", "f", 40, 49)], "path string, func_id string, start_line int, end_line int")
    assert values(slices.function_at(spans, places), "line", "func_id", "line_in_function") == [(44, "f", 5)]
    shown = slices.evidence(frame(spark, [("f", "pre", "[  40] int f\n// note\n [ 41]   x")], "func string, version string, text string"))
    assert values(shown, "evidence_id", "code") == [("f:pre:40", "int f"), ("f:pre:41", "x")]
    kept = frame(spark, [("f", 1), ("f", 2)], "func_id string, line int")
    mapped = frame(spark, [("f", 1, 1, "EXACT"), ("f", 3, 2, "MOVED"), ("f", 2, 4, "MODIFIED"), ("f", None, 5, "UNIQUE_POST"), ("g", None, 1, "UNIQUE_POST")], "func_id string, old_line int, new_line int, kind string")
    assert values(slices.shadow_lines(kept, mapped, frame(spark, [("f", 9)], "func_id string, line int")), "line") == [(1,), (4,), (5,), (9,)]
    assert values(slices.mapping_histogram(mapped), "kind", "n") == [("EXACT", 1), ("MODIFIED", 1), ("MOVED", 1), ("UNIQUE_POST", 2)]
    by_name = {c: n for c, (n, _, _) in span.items()}
    pairs = [(1, "data", "int x = a", "return x"), (2, "data", "x > b", "return x"), (3, "control", "x > b", "x = g(b, a)"), (4, "temporal", "return x", "x > b"), (5, "temporal", "x > b", "return x"), (6, "data", "x > b", "x = g(b, a)")]
    asked = frame(spark, [("f", i, k, [by_name[a]], [by_name[b]]) for i, k, a, b in pairs], "func_id string, pair int, dependency string, sources array<string>, targets array<string>")
    got = {r.pair: r.path_type for r in slices.link_checks(cfg.dependence(functions), flow, asked).collect()}
    assert got == {1: "data_flow", 2: "data_flow_mixed", 3: "control_flow", 4: "none", 5: "temporal", 6: "data_flow_mixed"}


def test_chains_and_decisions(spark):
    links = knowledge.chain_links(spark)
    candidates = frame(spark, [("uaf", "Use After Free"), ("race", "Race Condition"), ("few", "Use After Free"), ("bad", "Use After Free"), ("part", "Out-of-bounds Read")], "candidate string, category string")
    mapped = frame(spark, [(c, t) for c in ("uaf", "bad") for t in ("alloc", "dealloc", "use")] + [("few", "alloc"), ("part", "object"), ("part", "access")], "candidate string, type string")
    checked = frame(spark, [("uaf", 0, True, "data_flow"), ("uaf", 1, True, "temporal"), ("bad", 0, True, "data_flow"), ("bad", 1, False, "none"), ("part", 0, True, "data_flow")], "candidate string, pos int, reachable boolean, path_type string")
    assert values(slices.chain_results(candidates, links, mapped, checked), "candidate", "reachable", "path_type", "reason") == [
        ("bad", False, "data_flow", None), ("few", False, "none", "too few anchors"), ("part", True, "data_flow", None), ("race", True, "none", "empty chain"), ("uaf", True, "mixed", None),
    ]
    anchors = frame(spark, [("a", False, True, True), ("a", True, False, True), ("b", False, False, True), ("c", False, True, False)], "candidate string, is_optional boolean, is_mapped boolean, causality boolean")
    assert values(slices.consistency(anchors), "candidate", "decision") == [("a", "PROCEED"), ("b", "SAFE"), ("c", "SAFE")]
    levels = frame(spark, [("CONCRETE",), ("assumed",), ("conceptual",)], "v string").select("v", slices.is_locatable(F.col("v")).alias("l"), slices.requires_assumption(F.col("v")).alias("r"))
    assert values(levels, "v", "l", "r") == [("CONCRETE", True, False), ("assumed", True, True), ("conceptual", False, True)]


def test_taxonomy_records(spark):
    got = {r.category: r for r in knowledge.taxonomy(knowledge.categories(spark).select("category"), spark).collect()}
    assert got["Use After Free"].anchor_types == ["alloc", "dealloc", "use"] and got["Use After Free"].chain == "alloc →d dealloc →t use"
    assert got["Buffer Overflow"].chain == "object →d access ←d? source" and got["Race Condition"].chain == ""
    assert got["Missing Authorization"].legacy_type == "Authorization Bypass" and got["Logic Error"].legacy_type == "Logic Error"
    names = frame(spark, [("authorization bypass",), ("Deadlock",)], "name string")
    assert values(knowledge.resolve(names, spark, "name"), "name", "category", "rule") == [("Deadlock", "Unknown", None), ("authorization bypass", "Missing Authorization", 4)]


def test_results_of_runs(spark, tmp_path):
    runs = frame(spark, [("v1", "repo", False), ("v2", "other", True), ("v9", None, False)], "vul_id string, repo string, success boolean")
    findings = frame(spark, [("v1",), ("v3",), ("v9",)], "vul_id string")
    assert values(storage.with_metadata(findings, runs, "vul_id", "repo"), "vul_id", "repo") == [("v1", "repo"), ("v3", "UNKNOWN"), ("v9", "UNKNOWN")]
    again, missing = storage.failed_tasks(runs, frame(spark, [("v1",), ("v2",)], "vul_id string"), "vul_id", "success")
    assert values(again, "vul_id") == [("v1",)] and values(missing, "vul_id") == [("v9",)]
    storage.phase(spark, str(tmp_path), "one", lambda: spark.range(1))
    assert storage.pending_phases(spark, str(tmp_path), ["one", "two", "three"]) == ["two", "three"]


def test_anchor_operators(spark):
    anchors = frame(spark, [("x", "u", "alloc", 2, "p = get()"), ("y", "u", "odd", 9, "free(p)")], "anchor string, unit_id string, type string, line_no int, snippet string").withColumn("category", F.lit("Use After Free"))
    links = knowledge.chain_links(spark)
    allowed = links.select("category", F.col("source").alias("type")).union(links.select("category", "target"))
    assert values(validate.allowed_anchors(anchors, allowed), "anchor") == [("x",)]
    held = frame(spark, [([1, 2], [2]), ([], [2]), ([3], [2])], "line_nos array<int>, anchor_lines array<int>").select(validate.slice_holds_anchor(None).alias("h"))
    assert [r.h for r in held.collect()] == [True, False, False]
    nodes = frame(spark, [("u", "n1", 1, 3, "p  = get( )"), ("u", "n2", 4, 4, "free(p)")], "func_id string, node string, start_line int, end_line int, code string")
    assert values(validate.nodes_at(anchors, nodes), "anchor", "node") == [("x", "n1"), ("y", "n2")]
    trace = frame(spark, [(1, 0, 2, 20, "p = get();"), (1, 1, 5, 21, "free(p);")], "pair_id int, pos int, orig_line int, target_no int, slice_line string")
    assert values(validate.mapped_anchors(anchors.withColumn("pair_id", F.lit(1)), trace), "anchor", "target_no") == [("x", 20), ("y", 21)]
    found = frame(spark, [("g", "VULNERABLE", 0.5), ("g", "VULNERABLE", 0.3), ("g", "PATCHED", 0.9), ("h", "VULNERABLE", 0.9)], "group_id string, verdict string, confidence double")
    assert validate.with_features(found, frame(spark, [("g", 1)], "group_id string, f int")).count() == 1
    assert one(spark, "x", lambda c: validate.involved_functions(F.array(c, F.lit("b"), F.lit(None)), F.array(F.lit(""), c))) == ["b", "x"]
    rows = frame(spark, [("f", 1), ("f", 5), ("g", 2)], "name string, at int")
    assert values(validate.latest_of(rows, ["name"], "at"), "name", "at") == [("f", 5), ("g", 2)]
    paths = frame(spark, [("a.c",), ("x/a.c",), ("x/ba.c",)], "path string")
    assert values(tables.by_basename(paths, "a.c"), "path") == [("a.c",), ("x/a.c",)]


def test_competition_of_changed_lines(spark):
    trace = frame(spark, [(1, "pre", 0, 4, 2, 0.5, False), (1, "post", 0, 4, 4, 0.75, False), (1, "pre", 1, 6, 2, 0.5, False), (1, "post", 1, 6, 4, 0.5, False), (1, "post", 2, 7, 9, 1.0, True)], "pair_id int, side string, pos int, target_no int, tokens int, similarity double, is_header boolean")
    changed = frame(spark, [(1, 0, 0), (1, 1, 1)], "pair_id int, pre int, post int")
    assert values(scoring.competitive(trace, changed), "side", "loss") == [("post", 4 * 0.5 / 8), ("pre", 2 * 0.5 / 4)]


def plain_match(patch, code, anchors):
    """Verdict and confidence of one unit, by loops over the definitions."""
    strip = lambda t: re.sub(r"//.*", "", t)
    tokens = lambda line: [t for t in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+|->|[^\w\s]", re.sub(r"^\[\s*\d+\]", "", strip(line)).replace("_", " ")) if t not in set(";(){}[],.")]
    low = lambda line: [t.lower() for t in tokens(line)]
    cut = lambda t: [(n, x) for n, x in enumerate(t.split("\n"), 1) if strip(x).strip()]
    target = [low(x) for _, x in cut(code)]
    sides = {s: cut(patch[s]) for s in ("pre", "post")}
    lists = {s: [low(x) for _, x in rows] for s, rows in sides.items()}
    tags = align.line_tags(lists["pre"], lists["post"])
    out = {}
    for k, s in enumerate(("pre", "post")):
        nos = [n for n, _ in sides[s]]
        sim = align.similarities(lists[s], target)
        found, penalty = align.align(sim, nos)
        at, body = dict(found), [not is_header(x) for _, x in sides[s]]
        sims = [float(sim[i, at[i]]) if i in at else 0.0 for i in range(len(nos))]
        size = [len(x) for x in lists[s]]
        matched = sum(size[i] * sims[i] for i in range(len(nos)) if body[i])
        full = [n for n in size if n]
        keep = max(0.0, matched - penalty * sum(size) / len(full)) / matched if matched > 0 else 0.0
        mean = lambda rows: sum(size[i] * sims[i] for i in rows) / sum(size[i] for i in rows) if sum(size[i] for i in rows) else 0.0  # noqa: E731, B023
        here = [i for i in range(len(nos)) if body[i]]
        own = [i for i in here if tags[k][i] != "COMMON"]
        held = [max([sims[i] for i, n in enumerate(nos) if n == line], default=0.0) for side, line in anchors if side == s and line > 0]
        out[s] = {
            "at": at, "sims": sims, "size": size, "has": any(t != "COMMON" for t in tags[k]), "raw": mean(here), "raw_feat": mean(own), "score": mean(here) * keep, "feat": mean(own) * keep,
            "ctx": mean([i for i in here if tags[k][i] == "COMMON"]) * keep, "anchor": (sum(held) / len(held) if held else 1.0) if nos else 0.0, "tokens": sum(size[i] for i in here),
        }
    a, b = out["pre"], out["post"]
    if a["has"] and b["has"] and tags[2]:
        lost = {"pre": 0.0, "post": 0.0}
        for i, j in tags[2]:
            if i in a["at"] and j in b["at"] and a["at"][i] == b["at"][j]:
                lost["post" if a["sims"][i] >= b["sims"][j] else "pre"] += b["size"][j] * b["sims"][j] if a["sims"][i] >= b["sims"][j] else a["size"][i] * a["sims"][i]
        for s, x in out.items():
            x["score"], x["feat"] = max(0.0, x["raw"] - (lost[s] / x["tokens"] if x["tokens"] else 0.0)), x["raw_feat"]
    vuln, fix = (0.5 * x["score"] + 0.5 * x["anchor"] for x in (a, b))
    if vuln < 0.4:
        return "MISMATCH", 1 - vuln
    if b["has"] and not a["has"]:
        return ("PATCHED", fix) if b["feat"] >= 0.9 else ("VULNERABLE", vuln)
    if a["has"] and not b["has"]:
        return ("PATCHED", fix) if a["feat"] < 0.4 else ("VULNERABLE", vuln)
    if a["has"]:
        return ("PATCHED", fix) if fix > vuln else ("VULNERABLE", vuln)
    return "UNKNOWN", max(a["ctx"], b["ctx"])


def test_match_against_plain_loops(spark):
    rng = np.random.default_rng(17)
    words = ["alpha", "beta", "gammaRay", "delta_x", "omega", "ring9", "load", "store"]
    line = lambda: f"{rng.choice(words)}({rng.choice(words)}) + {rng.choice(words)};"
    patches, units = [], []
    for g in range(6):
        pre = ["static int run(struct ring *r, int n)", *[line() for _ in range(6)]]
        post = list(pre)
        if g % 3 != 1:
            post.insert(3, line())
        if g % 3 != 0:
            post[4 if g % 3 == 2 else 2 :][:1] = []
            del post[5]
        if g == 5:
            post[2] = line()
        patches.append((f"g{g}", "\n".join(pre), "\n".join(post)))
        for base in (pre, post):
            changed = [x if rng.random() < 0.7 else line() for x in base]
            changed.insert(int(rng.integers(1, len(changed))), line())
            units.append((len(units), "\n".join(changed)))
    patches.append(("same", patches[0][1], patches[0][1]))
    units.append((len(units), "nothing like it;"))
    anchors = [("g0", "pre", "x", 3, "alpha"), ("g0", "post", "x", 4, "alpha"), ("g2", "pre", "x", 2, "beta"), ("g2", "pre", "y", 90, "beta"), ("g2", "pre", "z", 3, " ;"), ("g3", "pre", "w", -1, "omega")]
    got = matching.match(frame(spark, patches, "group_id string, pre string, post string"), frame(spark, units, "unit_id int, code string"), frame(spark, anchors, "group_id string, side string, anchor string, line_no int, snippet string"))
    rows = {(r.group_id, r.unit_id): (r.verdict, r.confidence) for r in got.collect()}
    code, sides = dict(units), {g: {"pre": a, "post": b} for g, a, b in patches}
    assert len(rows) > 60 and len({v for v, _ in rows.values()}) == 4
    for (g, u), (verdict, confidence) in rows.items():
        want = plain_match(sides[g], code[u], [(s, n) for h, s, _, n, t in anchors if h == g and t.strip(" ;")])
        assert verdict == want[0] and abs(confidence - want[1]) < 1e-9, (g, u)


def test_git_repository(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "tools").mkdir(parents=True)
    run = lambda *args: git.git(str(repo), "-c", "user.name=t", "-c", "user.email=t@example.org", *args)
    run("init", "-q")
    (repo / "a.c").write_text(OLD)
    (repo / "tools/b.c").write_text("int b;")
    (repo / "note.md").write_text("no")
    run("add", "-A")
    run("commit", "-qm", "first")
    run("tag", "one")
    (repo / "a.c").write_text(NEW)
    (repo / "new.h").write_text("")
    run("add", "-A")
    run("commit", "-qm", "grow it")
    run("tag", "two")
    assert values(git.tracked_files(spark, str(repo)), "path") == [("a.c",), ("new.h",)]
    root = git.git(str(repo), "rev-parse", "one").decode().strip()
    log = git.commits(spark, str(repo), ["one", "two"])
    assert [(r.version, r.parent) for r in log.orderBy("version").collect()] == [("one", None), ("two", root)]
    files = git.blobs(spark, str(repo), [root, "two"])
    assert [r.message for r in versions.messages(log, log.where("version = 'two'").select("version")).collect()] == ["grow it"]
    assert values(versions.changed_files(files, log), "version", "path", "old_text") == [("two", "a.c", OLD), ("two", "new.h", None)]
    copy = git.clone(str(repo), str(tmp_path / "copy"), "one")
    assert open(f"{copy}/a.c").read() == OLD


def test_bodies_contexts_and_peers(spark):
    symbols = frame(spark, [("f", "b.c", 3), ("f", "a.c", 9), ("g", "a.c", 1)], "name string, path string, at int")
    assert values(lookup.body(symbols, frame(spark, [("f",)], "name string"), "name", ["path", "at"]), "path") == [("a.c",)]
    assert values(lookup.body(symbols, frame(spark, [("f", "b.c")], "name string, path string"), "name", ["at"], "path"), "at") == [(3,)]
    rows = frame(spark, [(1, n, f"l{n}") for n in range(1, 100)], "unit_id int, line_no int, line string")
    spans = frame(spark, [(1, 5, 20), (1, 30, 90)], "unit_id int, start_line int, end_line int")
    got = sorted(values(lookup.symbol_context(rows, frame(spark, [(1, 5), (1, 30)], "unit_id int, at int"), spans, 2), "at", "line_no", "text"))
    assert [r[:2] for r in got] == [(5, n) for n in range(5, 21)] + [(30, n) for n in range(28, 33)] and got[0][2] == ">> [   5] l5"
    found = frame(spark, [("a.c", "f", "v1"), ("a.c", "g", "v1"), ("a.c", "h", "v2"), ("a.c", "f", "v1")], "file string, func string, version string")
    assert values(rank.peers(found, "file", "func", same=("version",)), "func", "peer") == [("f", "g"), ("g", "f")]
    assert values(rank.peers(found, "file", "func", most=1), "func", "peer") == [("f", "g"), ("g", "f"), ("h", "f")]
    facts = frame(spark, [(True, True, False, True, False, False, True), (True, True, True, True, False, True, True)], "consistent boolean, reachable boolean, type_matches boolean, in_scope boolean, blocked boolean, contested boolean, vulnerable boolean")
    assert sorted(r.verdict for r in scoring.final_verdict(facts).collect()) == ["PROCEED", "SAFE-TypeMismatch"]
    corpus = frame(spark, [("v", "pre", "1", "a.c", "f", "x"), ("v", "old", "1", "a.c", "f", "x"), ("w", "fix", "1", "a.c", "f", "x")], "vul_id string, tag string, version string, file_path string, func_name string, code_content string")
    assert values(tables.benchmark_corpus(corpus, frame(spark, [("v",)], "vul_id string")), "name") == [("pre:1:f",)]


def test_walks_through_a_function(spark):
    code = "int f(int n)\n{\n  int a = n;\n  int b = a;\n  if (b > 2)\n    b = g(a);\n  use(b);\n  return 0;\n}"
    functions = frame(spark, [("f", code, 1)], "func_id string, code string, start_line int")
    nodes, _, _ = cfg.program_graphs(functions)
    name = {r.code: r.node for r in nodes.collect()}
    edges = cfg.dependence(functions)
    asked = frame(spark, [("f", name["use(b)"], "b")], "func_id string, node string, var string")
    trace = graphs.variable_trace(edges, nodes, asked).orderBy("place").collect()
    assert [r.line for r in trace if r.node != "ENTRY"] == [4, 6, 3] and len(graphs.variable_trace(edges, nodes, asked, most=2).collect()) == 2
    assert values(graphs.variable_trace(edges, nodes, frame(spark, [("f", name["int a = n"], "a")], "func_id string, node string, var string"), backward=False), "line") == [(4,), (5,), (6,), (7,)]
    place = frame(spark, [("f", name["b = g(a)"])], "func_id string, node string")
    assert values(graphs.guards(edges, nodes, place), "code", "line") == [("b > 2", 5)]
    assert values(graphs.control_ancestors(edges, place), "node") == sorted([(name["b = g(a)"],), (name["b > 2"],)])
    wide = graphs.both_ways(edges, place.withColumn("vars", F.array(F.lit("a"), F.lit("b"))))
    assert {name["int a = n"], name["b > 2"], name["use(b)"]} <= {r.node for r in wide.collect()} and name["return 0"] not in {r.node for r in wide.collect()}
    anchors = frame(spark, [("f", "source", name["int a = n"]), ("f", "sink", name["use(b)"])], "func_id string, type string, node string")
    links = frame(spark, [(0, "source", "sink", "data")], "pos int, source string, target string, dependency string")
    chosen = slices.anchored_nodes(edges, anchors, links, nodes, frame(spark, [("f", 8)], "func_id string, line int"))
    text = slices.slice_text(slices.slice_lines(chosen, nodes), functions)
    assert [int(x[1:5]) for x in text.first().text.split("\n")] in ([1, 3, 4, 7, 8], [1, 3, 6, 7, 8])
    assert slices.sliced_or_whole(functions, text).first().text == text.first().text
    assert slices.sliced_or_whole(functions, text, 0.99).first().text.count("\n") == 8


def test_candidate_nodes(spark):
    old = "int f(int n)\n{\n  int a = n;\n  if (a > 2)\n    drop(a);\n  int z = 0;\n  q(n);\n  return z;\n}"
    new = old.replace("drop(a);", "return 1;\n  extra(n);")
    graphs_of = lambda code: cfg.program_graphs(frame(spark, [("f", code)], "func_id string, code string"))
    (nodes, flow, access), (nodes2, flow2, _) = graphs_of(old), graphs_of(new)
    lines_ = lambda *ns: frame(spark, [("f", n) for n in ns], "func_id string, line int")
    code = {r.node: r.code for r in nodes.collect()}
    got = {code[r.node]: r.reasons for r in slices.candidate_nodes(nodes, flow, access, lines_(4)).collect()}
    assert got["a > 2"] == ["changed"] and got["drop(a)"] == ["body"] and got["int a = n"] == ["variable"]
    more = slices.candidate_nodes(nodes, flow, access, lines_(5), frame(spark, [("f", "q(n)")], "func_id string, code string"))
    assert {code[r.node]: r.reasons for r in more.collect()} == {"drop(a)": ["changed"], "q(n)": ["reach"], "int a = n": ["variable"], "a > 2": ["variable"]}
    fresh = slices.newly_reached((nodes, flow, lines_(8)), (nodes2, flow2, lines_(4)))
    assert values(fresh, "code") == sorted([("extra(n)",), ("int z = 0",), ("q(n)",), ("return 1",), ("return z",)])


def test_slice_quality_and_lists(spark):
    rows = frame(spark, [(["a"], [3], [1, 3]), ([], [3], [3]), (["a"], [3], []), (["a"], [3], [4])], "anchors array<string>, anchor_lines array<int>, line_nos array<int>")
    assert [r.reason for r in slices.quality(rows).collect()] == [None, "no anchor", "empty slice", "no anchor in slice"]
    assert one(spark, "x", lambda c: slices.listed(F.array(c, c, c), 2)) == "x\nx\n... 1 more" and one(spark, "x", lambda c: slices.listed(F.array(c), 2)) == "x"


def test_roles_of_accesses(spark):
    assert cfg.parameters("static int f(struct ring *r, const char *s, int n, lock_t lk)") == {"r": "struct ring*", "s": "const char*", "n": "int", "lk": "lock_t"}
    assert cfg.declared("char *p = q, c, **d") == {"p": "char*", "c": "char", "d": "char*"} and cfg.declared("return x") == {} and cfg.declared("x = 1") == {}
    types = {"p": "char*", "n": "int", "s": "struct item"}
    assert cfg.roles("free(p)", types) == {("p", "use", "VALUE"), ("p", "def", "VALUE"), ("p", "use", "STATE"), ("p", "def", "STATE")}
    assert cfg.roles("n = count(n, &n)", types) == {("n", "def", "VALUE"), ("n", "use", "VALUE")}
    assert ("p", "use", "STATE") in cfg.roles("n = *p", types) and ("p", "use", "STATE") in cfg.roles("p[n] = 0", types) and ("p", "use", "STATE") not in cfg.roles("q = p", types)
    code = "void f(char *p, int n)\n{\n  free(p);\n  n = n + 1;\n  use(p);\n  out(n);\n}"
    functions = frame(spark, [("f", code)], "func_id string, code string")
    nodes, flow, _ = cfg.program_graphs(functions)
    name = {r.node: r.code or r.node for r in nodes.collect()}
    got = {(name[r.src], name[r.dst], r["var"], r.role, r.implicit) for r in cfg.role_edges(flow, cfg.role_accesses(functions)).collect()}
    assert got == {
        ("ENTRY", "free(p)", "p", "VALUE", True), ("ENTRY", "free(p)", "p", "STATE", True), ("free(p)", "use(p)", "p", "VALUE", False), ("free(p)", "use(p)", "p", "STATE", False),
        ("ENTRY", "n = n + 1", "n", "VALUE", True), ("n = n + 1", "out(n)", "n", "VALUE", False),
    }


def test_benchmark_mode(spark, tmp_path):
    rows = [("v", "pre", "1", "a.c", "put", RING[0]), ("v", "fix", "2", "a.c", "put", RING[1]), ("v", "pre", "1", "a.c", "other", RING[0]), ("w", "pre", "1", "a.c", "put", RING[0])]
    corpus = tables.benchmark_corpus(frame(spark, rows, "vul_id string, tag string, version string, file_path string, func_name string, code_content string"), frame(spark, [("v",), ("w",)], "vul_id string"))
    storage.write_benchmark(corpus.unionByName(corpus), str(tmp_path / "index"))
    units, postings = storage.read_index(spark, str(tmp_path / "index"))
    assert units.count() == 4 and postings.count() == postings.distinct().count() > 8
    named = units.withColumnRenamed("code_content", "code")
    patches = frame(spark, [("g", "v", "put", RING[0], RING[1])], "group_id string, vul_id string, func string, pre string, post string")
    chosen = matching.benchmark_candidates(patches, named)
    got = matching.match(patches, named, chosen=chosen).join(named.select("unit_id", "name"), "unit_id")
    assert values(got, "name", "verdict") == [("fix:2:put", "PATCHED"), ("pre:1:put", "VULNERABLE")]
    counted = storage.completion(frame(spark, [("a",), ("a",), ("b",)], "k string"), frame(spark, [("a",), ("b",)], "k string"), "k")
    assert values(counted, "k", "expected", "done", "complete") == [("a", 2, 1, False), ("b", 1, 1, True)]
    assert storage.output_folders("x", "r", "v", "no-slices")["results"] == "x/results-no-slices/r"


def test_closest_paths(spark):
    """The same places as scoring all pairs gives: ids that are null or repeat, paths that are null, empty or without a
    directory, keys of many rows; and no pairs of all with all in the plan."""
    rng = np.random.default_rng(5)
    paths = [None, "", "a", "/", "h/x.c", "h/x.h", "h/y.c", "g/x.c", "g/.x", "g/z/x.c", "g/z/"]
    made = [(int(i) if i < 70 else None, paths[p]) for i, p in zip(rng.integers(0, 72, 150), rng.integers(0, len(paths), 150), strict=True)]
    made += [(3, "h/x.c")] * 15 + [(4, f"h/{k}.c") for k in range(15)] + [(10, "h/x.c"), (10, None)]
    items = frame(spark, made, "id long, path string")
    contexts = items.where("id % 10 = 0").select(F.col("id").alias("c"), F.col("path").alias("context_path"))
    pairs = contexts.join(items, F.col("c") != F.col("id"))
    path, other = F.col("path"), F.col("context_path")
    plain = lookup.closest(pairs.select("c", "id", lookup.closeness(path, other).alias("score"), lookup.caller_distance(path, other).alias("distance")), "c", "id")
    found = lookup.closest_paths(items, contexts, "c", "id")
    columns = ("c", "id", "score", "distance", "place")
    assert sorted(values(found, *columns)) == sorted(values(plain, *columns))
    assert found.dtypes == plain.dtypes
    assert lookup.closest_paths(items.limit(0), contexts, "c", "id").isEmpty() and lookup.closest_paths(items, contexts.limit(0), "c", "id").isEmpty()


def test_definition_ranking_meets_by_key(spark, tmp_path):
    spark.range(100).selectExpr("id as page_id", "concat('http://h', id % 7, '/', id % 3, '.html') as url").write.parquet(f"{tmp_path}/pages.parquet")
    plan = index_queries.definition_ranking(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
