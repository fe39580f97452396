"""Positive, negative and boundary cases, all audited in one run."""

import re

import pytest

from fleetlint.model import RULE_IDS, SECRET_HINTS, SECRET_PATTERNS
from fleetlint.plans.audit import Audit

BASE = {"README.md": "install usage example " * 10, "LICENSE": "x", ".gitignore": ".env __pycache__ .venv",
        "Dockerfile": "FROM python:3.11\n", ".github/workflows/ci.yaml": "on: push\n", "pyproject.toml": ""}


def branches(n, name="f"):
    return f"def {name}(x: int) -> int:\n" + "    if x: x += 1\n" * (n - 1) + "    return x\n"


def public(total, documented):
    out = ""
    for k in range(total):
        out += f"def f{k}(x: int):\n" + ('    """Doc."""\n' if k < documented else "") + "    return x\n"
    return out


CASES = {
    # name: (files, rules that must be found, rules that must not)
    "root6": ({f"m{k}.py": "" for k in range(6)}, [], ["ARCH-001"]),
    "root7": ({f"m{k}.py": "" for k in range(7)}, ["ARCH-001"], []),
    "root7+1": ({**{f"m{k}.py": "" for k in range(7)}, "a/__init__.py": ""}, [], ["ARCH-001", "ARCH-INIT"]),
    "loc600": ({"a.py": "x = 1\n" * 600}, [], ["ARCH-GOD"]),
    "loc601": ({"a.py": "x = 1\n" * 601}, ["ARCH-GOD:MEDIUM"], []),
    "loc1000": ({"a.py": "x = 1\n" * 1000}, ["ARCH-GOD:MEDIUM"], []),
    "loc1001": ({"a.py": "x = 1\n" * 1001}, ["ARCH-GOD:HIGH"], []),
    "tests dir needs no init": ({"tests/test_a.py": "", "tests/unit/test_b.py": ""}, ["ARCH-INIT"], []),
    "cycle by stem": ({"a/x.py": "import y.z\n", "b/y.py": "from x import q\n", "a/__init__.py": "", "b/__init__.py": ""},
                      ["ARCH-CIRC"], []),
    "no cycle": ({"x.py": "import y\nimport x\n", "y.py": "import os\n"}, [], ["ARCH-CIRC"]),
    "complexity12": ({"a.py": branches(12)}, [], ["QUAL-CMPX"]),
    "complexity13": ({"a.py": branches(13)}, ["QUAL-CMPX:MEDIUM"], []),
    "complexity20": ({"a.py": branches(20)}, ["QUAL-CMPX:MEDIUM"], []),
    "complexity21": ({"a.py": branches(21)}, ["QUAL-CMPX:HIGH"], []),
    "boolop counts": ({"a.py": "def f(a):\n    return " + " and ".join(["a"] * 13) + "\n"}, ["QUAL-CMPX"], []),
    "nested counts into parent": (
        {"a.py": "def f(x):\n" + "".join("    " + ln + "\n" for ln in branches(13, "g").splitlines())}, ["QUAL-CMPX"], []),
    "except continue": ({"a.py": "for i in x:\n    try:\n        i()\n    except OSError:\n        continue\n"},
                        ["QUAL-EXC"], []),
    "except with two statements": ({"a.py": "try:\n    x()\nexcept OSError:\n    y()\n    pass\n"}, [], ["QUAL-EXC"]),
    "keyword-only and set()": ({"a.py": "def f(*, a=[]):\n    pass\ndef g(b=set()):\n    pass\n"}, [], ["QUAL-MUT"]),
    "set literal": ({"a.py": "async def f(a={1}):\n    pass\n"}, ["QUAL-MUT"], []),
    "untyped 13/20": ({"a.py": "".join(f"def f{k}(x): pass\n" if k < 13 else f"def f{k}(x: int): pass\n" for k in range(20))},
                      [], ["QUAL-TYPE"]),
    "untyped 14/20": ({"a.py": "".join(f"def f{k}(x): pass\n" if k < 14 else f"def f{k}(x: int): pass\n" for k in range(20))},
                      ["QUAL-TYPE"], []),
    "untyped in test_": ({"test_a.py": "def a(x): pass\n" * 9}, [], ["QUAL-TYPE"]),
    "no manifest": ({"a.py": "", "pyproject.toml": None}, ["DEP-NOMANIFEST"], []),
    "requirements": ({"requirements.txt": "flask[async]\n  Requests \nuvicorn>=1,<2\nx~=1\ny!=2\nhttp://z\n"},
                     ["DEP-UNPIN"], ["DEP-DEPR"]),
    "deprecated case": ({"requirements.txt": "PyCrypto==2.6\n"}, ["DEP-DEPR"], ["DEP-UNPIN"]),
    "nested requirements": ({"sub/requirements.txt": "sklearn\n"}, [], ["DEP-DEPR", "DEP-UNPIN"]),
    "secret": ({"a.py": "PASSWORD = 'abcdefghijkl'\n"}, ["SEC-SECRET"], []),
    "secret too short": ({"a.py": "PASSWORD = 'abcdefghijk'\n"}, [], ["SEC-SECRET"]),
    "excused in test": ({"tests/a.py": "password = 'abcdefghijkl'  # Mock\n"}, [], ["SEC-SECRET"]),
    "not excused elsewhere": ({"a.py": "password = 'abcdefghijkl'  # Mock\n"}, ["SEC-SECRET"], []),
    "secret in broken file": ({"a.py": "def (\nx = 'ghp_" + "a" * 36 + "'\n"}, ["SEC-SECRET"], []),
    "eval attribute": ({"a.py": "x.eval('1')\n"}, [], ["SEC-EXEC"]),
    "exec": ({"a.py": "exec('1')\n"}, ["SEC-EXEC"], []),
    "yaml positional loader": ({"a.py": "yaml.load(f, yaml.SafeLoader)\n"}, ["SEC-YAML"], []),
    "yaml safe keyword": ({"a.py": "yaml.load(f, Loader=yaml.CSafeLoader)\n"}, [], ["SEC-YAML"]),
    "shell false": ({"a.py": "subprocess.run(c, shell=False)\nrun(c, shell=True)\n"}, [], ["SEC-SHELL"]),
    "f-string update": ({"a.py": "x = f'Update {y} now'\n"}, ["SEC-SQL"], []),
    "f-string without the blank": ({"a.py": "x = f'Updated{y}selection'\n"}, [], ["SEC-SQL"]),
    "f-string sql": ({"a.py": "x = f'UPDATE {y} set'\nz = f'delete from {y}'\n"}, ["SEC-SQL"], []),
    "no tests": ({"a.py": "x = 1\n"}, ["TEST-NOTESTS"], ["TEST-LOWRATIO"]),
    "latest is a test file": ({"latest.py": "x = 1\n"}, [], ["TEST-NOTESTS"]),
    "ratio at .15": ({"a.py": "x = 1\n" * 200, "test_a.py": "x = 1\n" * 30}, [], ["TEST-LOWRATIO"]),
    "ratio below .15": ({"a.py": "x = 1\n" * 200, "test_a.py": "x = 1\n" * 29}, ["TEST-LOWRATIO:MEDIUM"], []),
    "ratio at .05": ({"a.py": "x = 1\n" * 200, "test_a.py": "x = 1\n" * 10}, ["TEST-LOWRATIO:MEDIUM"], []),
    "ratio below .05": ({"a.py": "x = 1\n" * 200, "test_a.py": "x = 1\n" * 9}, ["TEST-LOWRATIO:HIGH"], []),
    "source of 100": ({"a.py": "x = 1\n" * 100, "test_a.py": "x = 1\n"}, [], ["TEST-LOWRATIO"]),
    "decorator call counts": ({"test_a.py": "@mark()\ndef test_x():\n    pass\n"}, [], ["TEST-NOASSERT"]),
    "async test ignored": ({"test_a.py": "async def test_x():\n    pass\n"}, [], ["TEST-NOASSERT"]),
    "no assert": ({"test_a.py": "def test_x():\n    pass\n"}, ["TEST-NOASSERT"], []),
    "no readme": ({"README.md": None}, ["DOC-NOREADME"], ["DOC-SPARSE-README", "DOC-SECTIONS"]),
    "readme 149": ({"README.md": "\n" + "x" * 149 + "\n\n"}, ["DOC-SPARSE-README", "DOC-SECTIONS"], []),
    "readme 150": ({"README.md": "Install Usage Example" + "x" * 129}, [], ["DOC-SPARSE-README", "DOC-SECTIONS"]),
    "lower-case readme": ({"README.md": None, "readme.md": "short"}, ["DOC-SPARSE-README"], ["DOC-NOREADME"]),
    "upper-case readme wins": ({"readme.md": "short"}, [], ["DOC-SPARSE-README"]),
    "4 defs": ({"a.py": public(4, 0)}, [], ["DOC-LOWDOCSTRINGS"]),
    "docs .40": ({"a.py": public(10, 4)}, [], ["DOC-LOWDOCSTRINGS"]),
    "docs .30": ({"a.py": public(10, 3)}, ["DOC-LOWDOCSTRINGS:LOW"], []),
    "docs .20": ({"a.py": public(10, 2)}, ["DOC-LOWDOCSTRINGS:LOW"], []),
    "docs .10": ({"a.py": public(10, 1)}, ["DOC-LOWDOCSTRINGS:MEDIUM"], []),
    "docs in tests/": ({"tests/a.py": public(10, 0)}, [], ["DOC-LOWDOCSTRINGS"]),
    "unlicense": ({"LICENSE": None, "UNLICENSE": ""}, [], ["DOC-NOLICENSE"]),
    "no license": ({"LICENSE": None}, ["DOC-NOLICENSE"], []),
    "workflow elsewhere": ({".github/workflows/ci.yaml": None, "workflows/ci.yml": ""}, ["CICD-NOWORKFLOWS"], []),
    "docker dir latest": ({"Dockerfile": None, "docker/Dockerfile": "# x\nFROM a:latest\n"},
                          ["DEPLOY-DOCKER-LATEST"], ["DEPLOY-NODOCKER"]),
    "root docker wins": ({"docker/Dockerfile": "FROM a:latest\n"}, [], ["DEPLOY-DOCKER-LATEST"]),
    "gitignore gaps": ({".gitignore": ".env\n"}, ["DEPLOY-INCOMPLETE-GITIGNORE"], ["DEPLOY-NOGITIGNORE"]),
    "split before fit": ({"a.py": "def f():\n    a, b = train_test_split(x)\n    s.fit(a)\n"}, [], ["ML-LEAK-PREFIT"]),
    "async scope": ({"a.py": "async def f():\n    s.fit(x)\n    a, b = train_test_split(x)\n"}, ["ML-LEAK-PREFIT"], []),
    "split as attribute": ({"a.py": "s.fit(x)\na = m.train_test_split(x)\n"}, [], ["ML-LEAK-PREFIT"]),
    "fit in decorator": ({"a.py": "@s.fit(x)\ndef f():\n    a = train_test_split(x)\n"}, ["ML-LEAK-PREFIT"], []),
    "values is val": ({"a.py": "s.fit(df.values)\n"}, ["ML-LEAK-TESTFIT"], []),
    "second argument": ({"a.py": "s.fit(x, y_test)\n"}, [], ["ML-LEAK-TESTFIT"]),
    "pipeline used": ({"a.py": "p = Pipeline([])\nscaler.transform(x)\nmodel.fit(x)\n"}, [], ["ML-PREP-NOPIPE"]),
    "pipeline as argument": ({"a.py": "go(make_pipeline(a))\nscaler.transform(x)\nclf.fit(x)\n"}, [], ["ML-PREP-NOPIPE"]),
    "no pipeline": ({"a.py": "X = StandardScaler().fit_transform(x)\nregressor.fit(X)\n"}, ["ML-PREP-NOPIPE"], []),
    "linear svc by substring": ({"a.py": "from sklearn.svm import LinearSVC\n"}, ["ML-PREP-UNSCALED"], []),
    "scaled": ({"a.py": "from sklearn.svm import SVC\nfrom sklearn.preprocessing import scale\n"}, [], ["ML-PREP-UNSCALED"]),
    "seed keyword": ({"a.py": "XGBClassifier(seed=1)\n"}, [], ["ML-VAL-NOSEED"]),
    "seed in kwargs": ({"a.py": "m.PCA(**kw)\n"}, ["ML-VAL-NOSEED"], []),
    "cv present": ({"a.py": "from m import train_test_split\nfrom m import StratifiedKFold\n"}, [], ["ML-VAL-NOCV"]),
    "in tests/": ({"tests/a.py": "from m import train_test_split, accuracy_score\n"}, [], ["ML-VAL-NOCV", "ML-MET-RAWACC"]),
    "stratified": ({"a.py": "from m import SVC\ntrain_test_split(x, stratify=y)\n"}, [], ["ML-MET-NOSTRAT"]),
    "other metric": ({"a.py": "from m import accuracy_score, f1_score\n"}, [], ["ML-MET-RAWACC"]),
    "deep nesting parses or not, but never fails": ({"a.py": "x = " + "(" * 3000 + ")" * 3000 + "\n"}, [], ["SEC-EXEC"]),
    "shell true": ({"a.py": "subprocess.check_output(c, shell=True)\n"}, ["SEC-SHELL"], []),
    "bare repository": ({k: None for k in BASE} | {"a.py": ""},
                        ["DEPLOY-NOGITIGNORE", "DEPLOY-NODOCKER", "CICD-NOWORKFLOWS", "DEP-NOMANIFEST"], []),
    "single split, raw accuracy": (
        {"a.py": "from m import train_test_split, accuracy_score, SVC\ntrain_test_split(x)\n"},
        ["ML-VAL-NOCV", "ML-MET-RAWACC", "ML-MET-NOSTRAT"], []),
    "null byte": ({"a.py": "x = 1\0\npassword = 'abcdefghijkl'\n"}, ["SEC-SECRET"], []),
    "crlf": ({"a.py": "x = 1\r\neval(x)\r\n"}, ["SEC-EXEC"], []),
}


@pytest.fixture(scope="module")
def found(fleet_of):
    repos = {}
    for name, (files, _, _) in CASES.items():
        merged = {**BASE, **files}
        repos[name] = {p: c for p, c in merged.items() if c is not None}
    names = list(repos)
    out = {name: set() for name in names}
    for r in Audit(fleet_of(repos)).findings.collect():
        out[names[r.repo_id]] |= {r.rule_id, f"{r.rule_id}:{r.severity}"}
    return out


@pytest.mark.parametrize("name", list(CASES))
def test_case(found, name):
    _, present, absent = CASES[name]
    for rule in present:
        assert rule in found[name], found[name]
    for rule in absent:
        assert rule not in found[name], found[name]


def test_every_rule_is_exercised(found):
    seen = set().union(*found.values())
    assert set(RULE_IDS) <= seen


def test_hints_cover_every_secret_pattern():
    """Each alternative of each pattern contains a fragment of the prefilter."""
    for pattern in SECRET_PATTERNS.values():
        body = re.sub(r"^\(\?i\)", "", pattern)
        group = re.match(r"\(\?:([^)]*)\)", body)
        for alternative in group.group(1).split("|") if group else [body]:
            assert any(h in alternative.lower() for h in SECRET_HINTS), alternative
