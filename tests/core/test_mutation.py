"""Mutants and patches."""

import ast

import pytest

from lattica.functions import mutation, patches

SGN = 'def sgn(x: int) -> int:\n    """1 or 2"""\n    if x > 0:\n        return 1\n    if x < 0:\n        return -1\n    return 0\n'


def test_mutants():
    got = list(mutation.mutants(SGN, "sgn"))
    assert [m.change for m in got] == ["> -> >=", "0 -> 1", "0 -> -1", "1 -> 2", "1 -> 0", "< -> <=", "0 -> 1", "0 -> -1", "1 -> 2", "1 -> 0", "0 -> 1", "0 -> -1"]
    assert len({m.source for m in got}) == len(got) and all(ast.parse(m.source) for m in got) and all('"""1 or 2"""' in m.source for m in got)
    kinds = [m.kind for m in mutation.mutants("def f(a, b):\n    return a + b * 2 if a and b or True else a // b\n", "f")]
    assert sorted(set(kinds)) == ["arithmetic", "boolean", "constant"] and kinds.count("constant") == 2
    with pytest.raises(ValueError):
        list(mutation.mutants(SGN, "other"))


def diff(before, after, path="src/a.py"):
    a, b = before.split("\n"), after.split("\n")
    return "\n".join([f"--- a/{path}", f"+++ b/{path}", f"@@ -1,{len(a) + 1} +1,{len(b) + 1} @@", " context", *(f"-{x}" for x in a), *(f"+{x}" for x in b)])


def git(path, *lines):
    return "\n".join([f"diff --git a/{path} b/{path}", *lines])


CASES = [
    (diff("while left < right:", "while left <= right:"), None, ["comparison_operator"]),
    (diff("x = n + 1", "x = n + 2"), None, ["constant_delta"]),
    (diff("rows = range(n)", "rows = range(n - 1)"), None, ["constant_delta"]),
    (diff("x = n + 1", "x = n + 100"), "unclassified_change", []),
    (diff("y = a[i]", "y = a[i - 1]"), None, ["index_date_arith"]),
    (diff("y = a[i + 1:]", "y = a[i - 1:]"), None, ["index_date_arith"]),
    (diff("d = timedelta(days=1)", "d = timedelta(days=30)"), None, ["index_date_arith"]),
    (diff("w = width", "w = max(0, width)"), None, ["minmax_guard"]),
    (diff("w = min(a, b)", "w = min(a, b, c)"), None, ["minmax_guard"]),
    (diff("if ok:", "if ok and len(xs) > 0:"), None, ["minmax_guard"]),
    (diff("if row < rows:", "if 0 <= row < rows:"), None, ["minmax_guard"]),
    (diff("use(x)", "if count == 0:\n    return None\nuse(x)"), None, ["minmax_guard"]),
    (diff("flag = True", "flag = False"), "unclassified_change", []),
    (diff("x = f(1)", "x = g(1)"), "unclassified_change", []),
    (diff("# old", "# new"), "no_boundary_change", []),
    (diff("say( 'a' )", "say('b')"), "no_boundary_change", []),
    (diff("a < b", "a <= b", "tests/check.py"), "test_or_doc_only", []),
    (diff("a < b", "a <= b", "src/a.js"), "non_py_code_change", []),
    ("nothing", "unparseable_patch", []),
    (None, "unparseable_patch", []),
    ("--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n-a", "unparseable_patch", []),
    ("\n".join(diff("a < b", "a <= b", f"s/{k}.py") for k in range(3)), "too_many_files", []),
    (diff("\n".join(f"x{k} = 1" for k in range(11)), "\n".join(f"x{k} = 2" for k in range(11))), "too_many_lines", []),
    (diff("x, y, z, w, v, u, t = 1, 1, 1, 1, 1, 1, 1", "x, y, z, w, v, u, t = 2, 2, 2, 2, 2, 2, 2"), "unclassified_change", []),
    (diff("        elif a > b:", "        elif a >= b:"), None, ["comparison_operator"]),
    (diff("    ), key[2]", "    ), key[3]"), None, ["index_date_arith"]),
    (diff("    ) > top + 1", "    ) >= top"), None, ["comparison_operator", "constant_delta"]),
    # A test that goes away is a test; a picture that changes is no Python.
    (diff("a < b", "a <= b") + "\n" + git("tests/test_old.py", "deleted file mode 100644", "--- a/tests/test_old.py", "+++ /dev/null", "@@ -1 +0,0 @@", "-x = 1", "\\ No newline at end of file"), None, ["comparison_operator"]),
    (diff("a < b", "a <= b") + "\n" + git("art/logo.png", "index 1..2 100644", "Binary files a/art/logo.png and b/art/logo.png differ"), "non_py_code_change", []),
    (diff("a < b", "a <= b") + "\n" + git("old.c", "similarity index 100%", "rename from old.c", "rename to new.c"), None, ["comparison_operator"]),
]


@pytest.mark.parametrize("case", CASES)
def test_patches(case):
    assert patches.judge(case[0]) == (case[1] is None, *case[1:])


def test_files_and_blocks():
    text = git("a.py", "new file mode 100644", "--- /dev/null", "+++ b/a.py", "@@ -0,0 +1 @@", "+x", ) + "\n" + git("b.py", "--- a/b.py\t2020", "+++ /dev/null", "@@ -1,3 +1,3 @@", "-a", "+b", "-c", "+d", " e", "@@ -9 +9,0 @@", "-f")
    one, two = patches.parse(text)
    assert (one.path, two.path) == ("a.py", "b.py") and one.blocks == [([], ["x"])]
    assert two.blocks == [(["a"], ["b"]), (["c"], ["d"]), (["f"], [])] and two.lines == 3
    assert patches.classify_block(["try again:", "  at = n - 1"], ["try again:", "  at = n - 2"]) == {"constant_delta"}
    assert patches.classify_block(["x) {"], ["if index > 0:", "x) {"]) == {"minmax_guard"}


def test_tables(spark):
    programs = spark.createDataFrame([(1, SGN, "sgn"), (2, "def oops(", "x")], "id int, source string, function string")
    assert mutation.mutants_of(programs).groupBy("id", "boundary").count().collect()[0]["count"] == 12
    rows = spark.createDataFrame([(k, c[0], "kept") for k, c in enumerate(CASES)], "instance_id int, patch string, reason string")
    got = patches.judged(rows).cache()
    assert got.columns == ["instance_id", "patch", "qualifies", "reason", "filter_classes"]
    assert {r["instance_id"]: (r["reason"], r["filter_classes"]) for r in got.collect()} == {k: (c[1], c[2]) for k, c in enumerate(CASES)}
    told = {(r["kind"], r["name"]): r["n"] for r in patches.report(got).collect()}
    assert told["total", "scanned"] == len(CASES) and told["total", "qualified"] == sum(c[1] is None for c in CASES)
    assert all(told["class", c] == sum(c in x[2] for x in CASES) for c in patches.CLASSES) and told["excluded", "unparseable_patch"] == 3
    none = {(r["kind"], r["name"]): r["n"] for r in patches.report(got.limit(0)).collect()}
    assert set(none.values()) == {0} and len(none) == 6
