"""Facts kept by digest."""

from pyspark.sql import functions as F

from fleetlint.operators.fact_store import FactStore, tool_version
from fleetlint.operators.facts import extract_facts

FILES = {
    "r": {"a.py": "import os\nos.system(x)\n", "b.py": "def f(:\n", "c.py": "", "README.md": "import os\n"},
    "s": {"z.py": "import os\nos.system(x)\n", "c.py": ""},
}


def by_key(rows):
    return {(r.repo_id, r.path): r for r in rows.collect()}


def test_equal_texts_are_parsed_once(spark, fleet_of, tmp_path):
    store = FactStore(spark, str(tmp_path))
    files = fleet_of(FILES)
    assert store.add(files, "one").count() == 3
    assert store.add(files, "two").count() == 0
    later = fleet_of({"t": {"n/a.py": FILES["r"]["a.py"], "n/b.py": "y = 1\n"}})
    assert store.add(later, "three").count() == 1
    assert store.add(later, "three").count() == 1  # a repeated scan writes the same folder over
    assert store.add(files.limit(0), "none").count() == 0
    everything = files.unionByName(later.withColumn("repo_id", F.lit(7).cast("bigint")))
    got = by_key(store.facts_of(everything))
    want = by_key(extract_facts(everything))
    assert set(got) == set(want) and len(got) == 8
    for key, row in want.items():
        if row.is_python:
            for c in ("parse_ok", "error_line", "error_text", "calls", "imports", "defs", "scopes", "fact_errors", "loc"):
                assert got[key][c] == row[c], (key, c)
        else:
            assert got[key].parse_ok is None and got[key].calls is None


def test_odd_rows(spark, fleet_of, tmp_path):
    store = FactStore(spark, str(tmp_path), want=("imports",))
    files = fleet_of({"r": {"a.py": "import a\n"}})
    twice = files.unionByName(files).unionByName(files.withColumn("content", F.lit("import b\n")))
    blank = files.withColumns({"content": F.lit(None).cast("string"), "path": F.lit("n.py")})
    assert store.add(twice.unionByName(blank), "one").count() == 2
    rows = store.facts_of(twice.unionByName(blank)).collect()
    assert sorted(str(r.imports and r.imports[0].names) for r in rows) == ["None", "['a']", "['a']", "['b']"]


def test_another_tool_parses_anew(spark, fleet_of, tmp_path):
    files = fleet_of({"r": {"a.py": "eval(x)\nprint(x)\n"}})
    every, few = FactStore(spark, str(tmp_path)), FactStore(spark, str(tmp_path), want=("calls",), call_names=["eval"])
    assert every.add(files, "one").count() == 1 and few.add(files, "one").count() == 1
    assert len(every.facts_of(files).first().calls) == 2 and len(few.facts_of(files).first().calls) == 1
    assert tool_version(("calls", "defs")) == tool_version(("defs", "calls")) != tool_version(("calls",))
