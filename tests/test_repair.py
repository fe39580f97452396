"""Line edits, alone and merged, on small files."""

import pytest
from pyspark.sql import functions as F

from fleetlint.operators import repair, verdict
from fleetlint.plans.audit import Audit
from fleetlint.plans.repair import Repair, fixable_rows

BLOCK = (
    "def f(X, y):\n    scaler = StandardScaler()\n    X = scaler.fit_transform(X)\n"
    "    X_train, X_test, y_train, y_test = train_test_split(X, y)  # note\n    return X_train\n"
)
CASES = {
    "block": (BLOCK, "def f(X, y):\n    X_train, X_test, y_train, y_test = train_test_split(X, y, random_state=42)  # note\n"
              "    scaler = StandardScaler()\n    X_train = scaler.fit_transform(X_train)\n"
              "    X_test = scaler.transform(X_test)\n    return X_train\n"),
    "block with seed": (
        "scaler = MinMaxScaler()\nX = scaler.fit_transform(X)\na, b = train_test_split(X, random_state=1)\n",
        "a, b = train_test_split(X, random_state=1)\nscaler = MinMaxScaler()\n"
        "X_train = scaler.fit_transform(X_train)\nX_test = scaler.transform(X_test)\n"),
    "block over several lines": (
        "scaler = S()\nX = scaler.fit_transform(X)\na, b = train_test_split(\n    X,\n    random_state=1)\nz = 1\n",
        "a, b = train_test_split(\n    X,\n    random_state=1)\nscaler = S()\n"
        "X_train = scaler.fit_transform(X_train)\nX_test = scaler.transform(X_test)\nz = 1\n"),
    "no block, other name": (
        "scaler = S()\nZ = scaler.fit_transform(X)\na, b = train_test_split(Z, random_state=1)\n",
        "scaler = S()\n# fitted after the split instead\n# Z = scaler.fit_transform(X)\n"
        "a, b = train_test_split(Z, random_state=1)\n"),
    "plain fit before split has no edit": ("s.fit(X)\na = train_test_split(X, random_state=1)\n", None),
    "seed in empty call": ("k = KMeans()\n", "k = KMeans(random_state=42)\n"),
    "seed before trailing text": ("k = f(KMeans(3) )  # (x\n", "k = f(KMeans(3), random_state=42)  # (x\n"),
    "two seeds on one line": ("a, b = KMeans(1), PCA(2)\n", "a, b = KMeans(1), PCA(2, random_state=42)\n"),
    "call over lines has no closing parenthesis": ("k = KMeans(\n    3)\n", None),
    "seed and strata": (
        "from m import SVC\na, b = train_test_split(X, y)\n",
        "from m import SVC\na, b = train_test_split(X, y, random_state=42, stratify=y)\n"),
    "exception": (
        "def f():\n    try:\n        g()\n    except:\n        pass\n",
        "def f():\n    try:\n        g()\n    except Exception as err:\n        import logging\n"
        '        logging.getLogger(__name__).warning("suppressed: %s", err)\n'),
    "exception with comment between": ("try:\n    g()\nexcept:\n    # why\n    pass\n", None),
    "default": ("def f(a, b=[]):\n    return b\n",
                "def f(a, b=None):\n    if b is None:\n        b = []\n    return b\n"),
    "default that is not empty": ("def f(b=[1]):\n    return b\n", None),
    "yaml": ("x = yaml.load(f)\n", "x = yaml.safe_load(f)\n"),
    "eval": ("y = 1\nx = eval(s)\n", "import ast\ny = 1\nx = ast.literal_eval(s)\n"),
    "eval with the import there": ("import ast\nx = eval(s)\n", "import ast\nx = ast.literal_eval(s)\n"),
    "eval next to a method": ("m.eval(); x = eval(s)\n", "import ast\nm.eval(); x = ast.literal_eval(s)\n"),
    "eval where it is used already": ("y = ast.literal_eval(s)\nx = eval(s)\n", None),
    "exec stays": ("exec(s)\n", None),
}


@pytest.fixture(scope="module")
def rows(fleet_of):
    files = fleet_of({name: {"a.py": before} for name, (before, _) in CASES.items()})
    return fixable_rows(files)


def texts_of(rows):
    """The text that each patch alone makes of its file."""
    patched = repair.patched_files(rows)
    one = repair.line_patches(patched).join(patched.select("repo_id", "path", "original"), ["repo_id", "path"])
    return one.withColumn("replacement_code", repair.rebuilt_text(
        F.col("original"), F.sort_array(F.transform(repair.changed(F.col("edits")), lambda e: F.struct(e.line_no, e.new_text)))))


@pytest.fixture(scope="module")
def merged(rows):
    patched = repair.patched_files(rows)
    names = list(CASES)
    return {names[r.repo_id]: r.content for r in repair.merged_files(patched, repair.line_patches(patched)).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_merged_text(merged, name):
    assert merged.get(name) == CASES[name][1]


def test_one_patch_per_finding(rows):
    names = list(CASES)
    patches = {}
    for r in texts_of(rows).collect():
        patches.setdefault(names[r.repo_id], []).append(r)
    one = {p.rule_id: p.replacement_code for p in patches["seed and strata"]}
    assert one["ML-VAL-NOSEED"] == "from m import SVC\na, b = train_test_split(X, y, random_state=42)\n"
    assert one["ML-MET-NOSTRAT"] == "from m import SVC\na, b = train_test_split(X, y, stratify=y)\n"
    edits = repair.line_edits(repair.line_patches(repair.patched_files(rows))).filter("op = 'delete'").collect()
    assert {names[e.repo_id] for e in edits} >= {"block"}


def test_requirement_edit_goes_by_line_not_prefix(fleet_of):
    files = fleet_of({"r": {"requirements.txt": "torch\ntorchvision==0.1\nsklearn"}})
    texts = {p.rule_id: p.replacement_code for p in texts_of(fixable_rows(files)).collect()}
    assert texts == {"DEP-UNPIN": "torch>=2.2.0\ntorchvision==0.1\nsklearn\n",
                     "DEP-DEPR": "torch\ntorchvision==0.1\nscikit-learn\n"}


def test_cycle_of_scan_repair_and_rescan(spark, fleet_of):
    files = fleet_of({"r": {"src/a.py": "def f(a=[]):\n    return eval(a)\n", "src/b.py": "subprocess.run(c, shell=True)\n"}})
    audit = Audit(files)
    shell = audit.findings.filter("rule_id = 'SEC-SHELL'").first().finding_id
    proposals = spark.createDataFrame(
        [(shell, "cause", "why", "subprocess.run([c])\n", 0.85, True),
         ("UNKNOWN-1", "cause", "why", "x = 1\n", 0.99, True),
         (audit.findings.filter("rule_id = 'SEC-EXEC'").first().finding_id, "c", "w", "x = 1\n", 0.84, True)],
        "finding_id string, root_cause string, rationale string, replacement_code string, confidence double, safe_to_apply boolean")
    runs = lambda p: p.select("repo_id", "finding_id", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("phase"),
                              F.lit(0).alias("exit_code"), F.lit("1 passed in 0.1s").alias("log"))
    job = Repair(audit, runs, proposals)
    assert job.results.filter("overall_status <> 'PASSED'").count() == 0
    after = {r.path: r.content for r in job.files_after.collect()}
    assert after["src/b.py"] == "subprocess.run([c])\n"
    assert after["src/a.py"] == ("import ast\ndef f(a=None):\n    if a is None:\n        a = []\n"
                                 "    return ast.literal_eval(a)\n")
    left = {r.rule_id for r in job.after.findings.collect()}
    assert not left & {"SEC-EXEC", "SEC-SHELL", "QUAL-MUT", "ARCH-INIT", "DOC-NOREADME", "DEPLOY-NODOCKER"}
    counts = verdict.verdict_counts(job.results).first()
    assert counts.verified == counts.patches
