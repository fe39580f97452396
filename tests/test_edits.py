"""The edit algebra: spans, merging, conflicts, and judging a patch by the statements it touches."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from fleetlint.operators import repair, verdict
from fleetlint.operators.verdict import PatchedFile, enclosing
from fleetlint.plans.repair import fixable_rows


def spliced(spark, old, spans):
    row = spark.createDataFrame([(old, spans)], f"old string, spans {repair.SPANS_TYPE}")
    kept = repair.clean_spans(F.col("spans"))
    return row.select(kept.alias("kept"), repair._spliced(F.col("old"), kept).alias("text")).first()


def test_spans_are_sorted_deduplicated_and_checked_for_overlap(spark):
    got = spliced(spark, "f(a, b )", [
        (6, 7, 3, ""), (6, 6, 5, ", y"), (6, 6, 3, ", x"), (6, 6, 4, ", x"), (2, 5, 1, "A,"), (3, 4, 0, "lost"), (0, 0, 2, "# ")])
    assert got.text == "# f(A, b, x, y)"[:4] + "A,b, x, y)"
    assert "lost" not in [s.text for s in got.kept]
    assert spliced(spark, "same", []).text == "same"
    assert spliced(spark, "äöü", [(1, 2, 0, "o"), (3, 3, 0, "!")]).text == "äoü!"


def edit(line, old, whole=False, text=None, spans=(), before=None):
    return (line, old, before, whole, text, list(spans))


def merged(spark, rows):
    schema = f"repo_id bigint, path string, finding_id string, edit {repair.EDITS_TYPE[6:-1]}"
    out = repair.merged_lines(spark.createDataFrame([(1, "a.py", f, e) for f, e in rows], schema))
    return {r.line_no: (r.new_text, sorted(r.conflicts)) for r in out.collect()}


def test_lines_replaced_as_a_whole_win_and_conflicts_are_named(spark):
    got = merged(spark, [
        ("a", edit(1, "x = 1", before="import ast\n")), ("b", edit(1, "x = 1", before="import ast\n")),
        ("c", edit(2, "except:", True, "except Exception as err:")), ("d", edit(2, "except:", spans=[(0, 0, 4, "late ")])),
        ("e", edit(3, "gone", True, None)), ("f", edit(4, "g(h)", spans=[(3, 3, 3, ", s")])),
        ("g", edit(4, "g(h)", spans=[(2, 4, 5, "other")])), ("h", edit(5, "f()", spans=[(0, 0, 2, "# ")])),
        ("i", edit(5, "f()", spans=[(2, 2, 3, "seed")])),
    ])
    assert got == {
        1: ("import ast\nx = 1", []), 2: ("except Exception as err:", ["d"]), 3: (None, []),
        4: ("g(other", ["f"]), 5: ("# f()", ["i"])}


def test_text_from_slices(spark):
    texts = ["", "a", "a\nb\nc\n", "a\r\nb\rc", "one\n\n\ntwo"]
    for text in texts:
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        for k in range(len(lines) + 1):
            edits = [] if k == 0 else [(k, None if k % 2 else "new\nlines")]
            want = [t for j, old in enumerate(lines, 1) for t in [dict(edits).get(j, old)] if t is not None]
            row = spark.createDataFrame([(text, edits)], "t string, e array<struct<line_no:int,new_text:string>>")
            assert row.select(repair.rebuilt_text(F.col("t"), F.col("e"))).first()[0] == "\n".join(want) + "\n"


SOURCE = '''"""Doc."""
import os; import sys

@deco(
    1)
def f(a, b=[]):
    """Inner."""
    if a:
        for x in b:
            y = eval(x); z = 1
    else:
        try:
            g()
        except ValueError:
            pass
        finally:
            text = """
not indented
"""
    return b

class C:
    def m(self): return 1

    def n(self):
        match self:
            case 1:
                return 2
'''


def test_enclosing_statements():
    tree, lines = ast.parse(SOURCE), SOURCE.split("\n")
    spans = {k: enclosing(tree.body, k, k, lines) for k in range(1, len(lines))}
    assert spans[2] == (2, 2, "") and spans[4] == (4, 20, "") and spans[7] == (7, 7, "    ")
    assert spans[10] == (10, 10, " " * 12) and spans[13] == (13, 13, " " * 12) and spans[14] == (12, 19, " " * 8)
    assert spans[18] == (17, 19, " " * 12) and spans[23] == (23, 23, " " * 4) and spans[28] == (28, 28, " " * 16)
    for k, (first, last, indent) in spans.items():
        if lines[k - 1].strip():
            ast.parse(("if 1:\n" if indent else "") + "\n".join(lines[first - 1: last]) + "\n")


@pytest.mark.parametrize("seed", range(3))
def test_judging_by_statements_equals_judging_the_whole_text(seed):
    rng, lines = random.Random(seed), SOURCE.split("\n")[:-1]
    news = [None, "", "x = (", "    import socket", "import socket", "        os.system('x')", "            exec(y)", "  odd",
            "def f(a, b=None):\n    if b is None:\n        b = []", "\"\"\"", "return 1", "            q = 1", "@deco("]
    file = PatchedFile("a.py", SOURCE)
    assert file.local
    kept = ("parse_ok", "parse_error", "compile_ok", "compile_error")
    for _ in range(400):
        edits = {k: rng.choice([*news, lines[k - 1]]) for k in rng.sample(range(1, len(lines) + 1), rng.randrange(1, 4))}
        whole = verdict._features("a.py", SOURCE, file.patched(edits))
        own = file.features(edits)
        if whole.get("compile_ok") is False:  # no edit of ours puts a return where none may be
            continue
        assert {k: own.get(k) for k in kept} == {k: whole.get(k) for k in kept}, edits
        if whole["parse_ok"]:
            fresh = {k: set(whole[f"new_{k}"]) - set(whole[f"old_{k}"]) for k in ("modules", "calls")}
            got = {k: set(own[f"new_{k}"]) - set(own[f"old_{k}"]) for k in ("modules", "calls")}
            assert got["modules"] & set(verdict.FORBIDDEN_MODULES) == fresh["modules"] & set(verdict.FORBIDDEN_MODULES)
            assert got["calls"] & verdict._FORBIDDEN == fresh["calls"] & verdict._FORBIDDEN


def test_imports_before_future_statements_are_judged_whole():
    text = "from __future__ import annotations\nx = eval(s)\n"
    file = PatchedFile("a.py", text)
    got = file.features({1: "import ast\nfrom __future__ import annotations", 2: "x = ast.literal_eval(s)"})
    assert got["parse_ok"] and got["compile_ok"] is False


def test_patches_hold_no_file_text(fleet_of):
    """A file with many findings: what is kept grows with the findings, not with findings times lines."""
    def rows(n):
        body = "".join(f"def f{k}(a=[]):\n    return yaml.load(a)\n" for k in range(n))
        return repair.patched_files(fixable_rows(fleet_of({"r": {"a.py": "import yaml\n" + body}})))

    sizes = []
    for n in (50, 500):
        patched = rows(n)
        patches = repair.line_patches(patched)
        assert patches.count() == 2 * n
        sizes.append(patches.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0])
        text = repair.merged_files(patched, patches).first().content
        assert text.count("safe_load") == text.count("=None") == n
        features = verdict.gate(verdict.edit_features(patched))
        assert features.filter("passed").count() == 2 * n
    assert sizes[1] < 12 * sizes[0]
