"""Schemas and fixed dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]

# Deduction per finding, in tenths of a point; any other severity costs 5.
DEDUCTION_TENTHS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 0}
DEDUCTION_UNKNOWN = 5

# Category name -> weight in percent, in reporting order.
CATEGORY_WEIGHTS = {
    "Architecture": 12,
    "Code Quality": 15,
    "Testing": 15,
    "ML Engineering": 20,
    "Security": 15,
    "Documentation": 8,
    "Reproducibility": 8,
    "CI/CD": 7,
}
CATEGORIES = list(CATEGORY_WEIGHTS)

GRADES = [(95, "A+"), (85, "A"), (70, "B"), (55, "C"), (40, "D")]

IGNORE_DIRS = [
    ".git", ".venv", "venv", "env", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "node_modules", "dist", "build",
    ".egg-info", ".tox", ".coverage", "site-packages",
]
IGNORE_EXTENSIONS = [
    ".pyc", ".pyd", ".pyo", ".so", ".dll", ".exe", ".bin",
    ".jpg", ".jpeg", ".png", ".gif", ".ico", ".svg",
    ".mp4", ".mp3", ".wav", ".zip", ".tar", ".gz", ".7z",
    ".pkl", ".joblib", ".h5", ".pt", ".pth", ".onnx", ".parquet", ".feather",
]
MAX_FILE_BYTES = 2 * 1024 * 1024

MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "environment.yml"]
LICENSES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "UNLICENSE"]
READMES = ["README.md", "readme.md"]
DOCKERFILES = ["Dockerfile", "docker/Dockerfile"]
README_SECTIONS = ["install", "usage", "example"]
GITIGNORE_ENTRIES = [".env", "__pycache__", ".venv"]

DEPRECATED_PACKAGES = {
    "sklearn": "scikit-learn",
    "pycrypto": "cryptography",
    "pickle5": "pickle",
}
RECOMMENDED_PINS = {
    "numpy": "numpy==1.26.4",
    "pandas": "pandas==2.2.2",
    "scikit-learn": "scikit-learn==1.4.2",
    "scipy": "scipy==1.13.0",
    "xgboost": "xgboost==2.0.3",
    "lightgbm": "lightgbm==4.3.0",
    "torch": "torch>=2.2.0",
    "fastapi": "fastapi>=0.110.0",
    "uvicorn": "uvicorn>=0.29.0",
    "pydantic": "pydantic>=2.7.0",
    "streamlit": "streamlit>=1.33.0",
    "pytest": "pytest>=8.1.0",
    "requests": "requests>=2.31.0",
}
REQUIREMENT_PATTERN = r"^([a-zA-Z0-9_\-\.]+)(.*)$"

# Name shown in the finding -> pattern searched in each line.
SECRET_PATTERNS = {
    "Hardcoded Secret / API Token":
        r"""(?i)(?:api_key|apikey|secret_key|auth_token|access_token|aws_secret_access_key|password)\s*=\s*['"][a-zA-Z0-9_\-\.]{12,}['"]""",
    "Exposed GitHub Personal Access Token": r"ghp_[a-zA-Z0-9]{36}",
    "Exposed OpenAI Secret Key": r"sk-[a-zA-Z0-9]{32,48}",
    "Exposed AWS Access Key ID": r"AKIA[0-9A-Z]{16}",
}
# Lower-case fragments one of which every match of a pattern above contains.
SECRET_HINTS = [
    "api_key", "apikey", "secret_key", "auth_token", "access_token", "aws_secret_access_key",
    "password", "ghp_", "sk-", "akia",
]
SECRET_EXCUSES = ["dummy", "example", "mock"]

SQL_PHRASES = ["select ", "insert into ", "update ", "delete from "]
EXEC_CALLS = ["eval", "exec"]
YAML_MODULES = ["yaml", "pyyaml"]
SHELL_CALLS = ["Popen", "run", "call", "check_output"]
FIT_CALLS = ["fit", "fit_transform"]
TRANSFORM_CALLS = ["fit_transform", "transform"]
SPLIT_CALL = "train_test_split"
MODEL_WORDS = ["clf", "model", "reg"]
STOCHASTIC_CALLS = [
    "RandomForestClassifier", "RandomForestRegressor", "GradientBoostingClassifier",
    "GradientBoostingRegressor", "ExtraTreesClassifier", "ExtraTreesRegressor",
    "XGBClassifier", "XGBRegressor", "LGBMClassifier", "LGBMRegressor",
    "LogisticRegression", "KMeans", "PCA", "TSNE", "train_test_split",
]
SEED_KEYWORDS = ["random_state", "seed"]
SCALE_SENSITIVE = [
    "LogisticRegression", "SGDClassifier", "SGDRegressor",
    "SVC", "SVR", "KNeighborsClassifier", "KNeighborsRegressor",
    "MLPClassifier", "MLPRegressor", "Ridge", "Lasso", "ElasticNet", "PCA",
]
SCALER_WORDS = ["Scaler", "Normalizer", "scale", "normalize"]
CV_WORDS = ["cross_val_score", "cross_validate", "KFold", "StratifiedKFold", "TimeSeriesSplit"]
CLASSIFIERS = [
    "LogisticRegression", "RandomForestClassifier", "XGBClassifier",
    "LGBMClassifier", "SVC", "KNeighborsClassifier", "DecisionTreeClassifier",
]
ACCURACY_WORDS = ["accuracy_score"]
ROBUST_METRICS = [
    "f1_score", "roc_auc_score", "classification_report",
    "precision_score", "recall_score", "log_loss",
]

# Patch gate limits.
FORBIDDEN_MODULES = [
    "socket", "ctypes", "pty", "subprocess", "telnetlib",
    "ftplib", "paramiko", "shutil", "tempfile_evil",
]
FORBIDDEN_CALLS = ["eval", "exec", "compile", "__import__", "globals", "locals", "getattr"]
FORBIDDEN_OS_CALLS = ["os.system", "os.popen", "os.spawn"]
MAX_LINES_ADDED = 250
MIN_PROPOSAL_CONFIDENCE_PCT = 85
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Static part of a rule; ``{x}`` in the texts stands for a finding's detail."""

    rule_id: str
    category: str
    analyzer_ord: int
    confidence_pct: int
    auto_fixable: bool
    level: str  # file | repo | dir | pair
    risk: str
    advice: str


def _r(rule_id, category, ord_, conf, fix, level, risk, advice):
    return Rule(rule_id, category, ord_, conf, fix, level, risk, advice)


RULES = [
    _r("ARCH-001", "Architecture", 1, 90, False, "repo",
       "With every module at the top level nothing separates concerns, and names start to collide as code is added.",
       "Move the code into packages, for instance below src/."),
    _r("ARCH-GOD", "Architecture", 1, 95, False, "file",
       "One file holds {x} lines; code of this size is hard to test or to change in isolation.",
       "Split the file into smaller modules with one responsibility each."),
    _r("ARCH-CIRC", "Architecture", 1, 92, False, "pair",
       "Two modules import one another ({x}); whichever loads first sees the other half-initialised.",
       "Put what both need into a third module, or import inside the function that needs it."),
    _r("ARCH-INIT", "Architecture", 1, 98, True, "dir",
       "The directory holds modules but no package marker, so imports depend on the runtime's search path.",
       "Create __init__.py in '{x}'."),
    _r("QUAL-EXC", "Code Quality", 2, 98, True, "file",
       "The handler drops the error without a trace, so faults surface later and elsewhere.",
       "Catch the narrow exception type and log it."),
    _r("QUAL-MUT", "Code Quality", 2, 99, True, "file",
       "The default object of {x}() is built once and shared by all calls, so a change made in one call leaks into the next.",
       "Default to None and build the object inside the function."),
    _r("QUAL-CMPX", "Code Quality", 2, 92, False, "file",
       "Function {x} has so many branches that its paths can hardly be covered by tests.",
       "Break the function up into helpers or use a dispatch table."),
    _r("QUAL-TYPE", "Code Quality", 2, 90, False, "file",
       "Most public functions carry no annotations ({x}), so type checkers and editors cannot help.",
       "Annotate parameters and results of public functions."),
    _r("DEP-NOMANIFEST", "Reproducibility", 3, 98, True, "repo",
       "No file declares the dependencies, so the environment cannot be rebuilt elsewhere.",
       "Add a requirements.txt or pyproject.toml."),
    _r("DEP-DEPR", "Reproducibility", 3, 99, True, "file",
       "The package is abandoned, renamed or known to be unsafe.",
       "Depend on '{x}' instead."),
    _r("DEP-UNPIN", "Reproducibility", 3, 96, True, "file",
       "Without an upper bound or a pin, a new upstream release can change results or break the build.",
       "Pin the version, for example '{x}'."),
    _r("SEC-SECRET", "Security", 4, 97, True, "file",
       "A credential in version control is readable by everyone who can clone the code, for ever.",
       "Revoke it, and read the value from the environment or a secret store."),
    _r("SEC-EXEC", "Security", 4, 99, True, "file",
       "{x}() runs any text it is given as code.",
       "Parse data with ast.literal_eval or json instead of {x}()."),
    _r("SEC-YAML", "Security", 4, 98, True, "file",
       "The default loader can build arbitrary objects from the document, and so run code.",
       "Call yaml.safe_load."),
    _r("SEC-SHELL", "Security", 4, 95, True, "file",
       "The command line goes through a shell, where any unquoted input becomes syntax.",
       "Pass a list of arguments and leave shell off."),
    _r("SEC-SQL", "Security", 4, 91, False, "file",
       "Values are spliced into the statement text, which invites SQL injection.",
       "Use bound parameters."),
    _r("TEST-NOTESTS", "Testing", 5, 99, True, "repo",
       "Nothing verifies the code automatically, so regressions pass unnoticed.",
       "Start a tests/ directory with pytest cases for the core functions."),
    _r("TEST-LOWRATIO", "Testing", 5, 92, False, "repo",
       "There is little test code compared with the source ({x}).",
       "Extend the suite, beginning with the most used paths."),
    _r("TEST-NOASSERT", "Testing", 5, 95, True, "file",
       "Test {x} can only fail by raising, as it checks nothing.",
       "Assert on the result, the state or the expected exception."),
    _r("DOC-NOREADME", "Documentation", 6, 99, True, "repo",
       "A reader cannot tell what the project does, how to install it or how to run it.",
       "Write a README.md with purpose, installation and a first example."),
    _r("DOC-SPARSE-README", "Documentation", 6, 95, True, "repo",
       "The README is shorter than 150 characters and leaves the basic questions open.",
       "Describe structure, set-up, usage and tests."),
    _r("DOC-SECTIONS", "Documentation", 6, 90, True, "repo",
       "The README says nothing about: {x}.",
       "Add the missing sections with commands that can be pasted."),
    _r("DOC-LOWDOCSTRINGS", "Documentation", 6, 93, False, "repo",
       "Few public functions and classes are documented ({x}).",
       "Add docstrings for arguments, results and errors."),
    _r("DOC-NOLICENSE", "Documentation", 6, 98, True, "repo",
       "Without a licence nobody else may legally use the code.",
       "Add a LICENSE file."),
    _r("CICD-NOWORKFLOWS", "CI/CD", 7, 98, True, "repo",
       "Changes are merged without an automatic build, lint or test run.",
       "Add a workflow that runs linter and tests on every push."),
    _r("DEPLOY-NODOCKER", "CI/CD", 7, 92, True, "repo",
       "The runtime environment is not described as an image, so deployments differ.",
       "Add a Dockerfile on a slim base image."),
    _r("DEPLOY-DOCKER-LATEST", "CI/CD", 7, 96, True, "repo",
       "The base image tag moves, so the same build gives different images over time.",
       "Name an explicit base image version."),
    _r("DEPLOY-NOGITIGNORE", "CI/CD", 7, 99, True, "repo",
       "Environments, caches and .env files are easily committed by accident.",
       "Add a .gitignore for Python projects."),
    _r("DEPLOY-INCOMPLETE-GITIGNORE", "CI/CD", 7, 97, True, "file",
       "Not ignored, and so easily committed: {x}.",
       "Add to .gitignore: {x}."),
    _r("ML-LEAK-PREFIT", "ML Engineering", 8, 98, True, "file",
       "The transformer learns from rows that later serve as test data, so the measured quality is too good.",
       "Split first, fit on the training part only, then transform both."),
    _r("ML-LEAK-TESTFIT", "ML Engineering", 8, 99, True, "file",
       "{x}() on held-out data re-learns parameters that must come from training.",
       "Only transform or predict on held-out data."),
    _r("ML-PREP-NOPIPE", "ML Engineering", 9, 94, True, "file",
       "Scaling and model are chained by hand and can drift apart between training and serving.",
       "Combine both in a scikit-learn Pipeline."),
    _r("ML-PREP-UNSCALED", "ML Engineering", 9, 91, False, "file",
       "The estimator reacts to feature magnitude ({x}), and nothing in the file scales features.",
       "Standardise features before fitting."),
    _r("ML-VAL-NOSEED", "Reproducibility", 10, 97, True, "file",
       "Without a fixed seed {x}() gives another result on every run.",
       "Pass random_state to {x}()."),
    _r("ML-VAL-NOCV", "ML Engineering", 10, 88, False, "file",
       "A single split measures one lucky or unlucky sample.",
       "Use cross-validation."),
    _r("ML-MET-NOSTRAT", "ML Engineering", 11, 92, True, "file",
       "A plain split can shift class shares between the parts, most of all for rare classes.",
       "Pass stratify=y."),
    _r("ML-MET-RAWACC", "ML Engineering", 11, 89, False, "file",
       "Accuracy looks good on unbalanced data even for a constant answer.",
       "Report precision, recall, F1 or ROC AUC as well."),
]
RULES_BY_ID = {r.rule_id: r for r in RULES}
RULE_IDS = [r.rule_id for r in RULES]

# What a rule function emits; everything else is looked up by rule_id.
HIT_TYPE = (
    "struct<rule_id:string,severity:string,title:string,path:string,line_no:int,"
    "end_line_no:int,code_snippet:string,detail:string,disc:string,"
    "metadata:map<string,string>,metric_num:bigint,metric_den:bigint>"
)
HITS_TYPE = f"array<{HIT_TYPE}>"

# Total order of findings within a repository.
FINDING_ORDER = ["analyzer_ord", "path", "line_no", "rule_id", "finding_id"]


def rule_dim(spark: SparkSession) -> DataFrame:
    """37 rows, one per rule; always safe to broadcast."""
    rows = [
        (r.rule_id, r.category, r.analyzer_ord, r.confidence_pct / 100.0, r.auto_fixable, r.risk, r.advice)
        for r in RULES
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, category string, analyzer_ord int, confidence double, "
        "auto_fixable boolean, risk_text string, advice_text string",
    )


def one_of(column: Column, values: list[str]) -> Column:
    return column.isin(*values)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def deduction(severity: Column) -> Column:
    """Deduction in tenths of a point."""
    out = F.when(severity == SEVERITIES[0], DEDUCTION_TENTHS[SEVERITIES[0]])
    for name in SEVERITIES[1:]:
        out = out.when(severity == name, DEDUCTION_TENTHS[name])
    return out.otherwise(DEDUCTION_UNKNOWN)

# ---- fixed value: the text of the MIT licence as published; {holder} stands for its year and owner.
MIT_TEXT = """MIT License

Copyright (c) {holder}

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
