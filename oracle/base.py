"""Common table expressions: fixture files and expected findings in plain SQL.

Expected findings of the code templates are written by hand, not computed by
the rules under test.
"""

from __future__ import annotations

import re

from fleetlint import model
from fleetlint.sources import corpus

NL = "chr(10)"


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows) + ")"


def names(items) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


# template -> findings: rule, severity, title, line, end line, snippet (a text,
# or (first, last) source lines), detail, discriminator, metric pair
EXPECTED = [
    (1, "SEC-EXEC", "CRITICAL", "Arbitrary Code Execution via 'eval()'", 2, None, "return eval(s)",
     "eval", "11-2:18", None, None),
    (2, "QUAL-MUT", "MEDIUM", "Mutable Default Argument in 'f()'", 1, None, (1, 3), "f", "f|1", None, None),
    (2, "QUAL-MUT", "MEDIUM", "Mutable Default Argument in 'f()'", 1, None, (1, 3), "f", "f|2", None, None),
    (3, "QUAL-EXC", "HIGH", "Silent Exception Swallowing (except: pass)", 3, None, (3, 5), None, "", None, None),
    (4, "SEC-YAML", "HIGH", "Unsafe YAML Deserialization (yaml.load)", 3, None,
     'cfg = yaml.load(open("c.yml"))', None, "6-3:30", None, None),
    (5, "SEC-SHELL", "HIGH", "Subprocess Execution with 'shell=True'", 3, None,
     'subprocess.run("ls", shell=True)', None, "0-3:32", None, None),
    (6, "SEC-SQL", "HIGH", "Potential SQL Injection via String Interpolation", 2, None,
     'return f"SELECT * FROM {t}"', None, "11-2:31", None, None),
    (8, "ML-LEAK-PREFIT", "CRITICAL", "Data Leakage: Preprocessing Fitted Before train_test_split()", 7, 8,
     "X = s.fit_transform(X)\n...\nreturn train_test_split(X, y, random_state=1)", None, "", None, None),
    (9, "ML-LEAK-TESTFIT", "CRITICAL", "Test-Set Contamination: Calling 'fit_transform()' on Test Data", 2, None,
     "return sc.fit_transform(X_test)", "fit_transform", "11-2:35", None, None),
    (10, "ML-PREP-UNSCALED", "HIGH", "Unscaled Features with Sensitive Estimator (SVC)", 1, None, None,
     "SVC", "", None, None),
    (11, "ML-VAL-NOSEED", "MEDIUM", "Missing 'random_state' in 'KMeans()'", 3, None,
     "km = KMeans(n_clusters=3)", "KMeans", "5-3:25", None, None),
    (12, "ML-VAL-NOCV", "LOW", "Absence of K-Fold Cross-Validation in '{path}'", 1, None, None, None, "", None, None),
    (12, "ML-MET-RAWACC", "LOW", "Sole Reliance on 'accuracy_score' in '{path}'", 1, None, None, None, "", None, None),
    (12, "ML-MET-NOSTRAT", "MEDIUM", "Missing 'stratify' in Classification train_test_split()", 5, None,
     "a, b = train_test_split([1, 2], random_state=0)", None, "7-5:47", None, None),
    (13, "ML-PREP-NOPIPE", "MEDIUM", "Missing Scikit-Learn Pipeline Encapsulation", 2, None, None, None,
     "function", None, None),
    (14, "QUAL-CMPX", "MEDIUM", "High Cyclomatic Complexity (13) in 'g'", 1, None, (1, 11), "g", "g", 13, None),
    (15, "QUAL-TYPE", "LOW", "Missing Type Annotations in '{path}' (3/4 functions)", 1, None,
     "# 3 untyped public functions in {path}", "3/4", "", 3, 4),
    (18, "TEST-NOASSERT", "MEDIUM", "Test Without Assertions in 'test_nothing()'", 1, None, None,
     "test_nothing", "test_nothing", None, None),
]

# template -> public definitions, documented ones
DOCSTRINGS = [(0, 1, 1), (1, 1, 0), (2, 1, 0), (6, 1, 0), (8, 1, 0), (9, 1, 0), (13, 1, 0), (14, 1, 0), (15, 4, 0)]

# template -> line edits of its fix: rule, line, new text
EDITS = [
    (1, "SEC-EXEC", 1, "import ast\ndef parse(s: str):"),
    (1, "SEC-EXEC", 2, "    return ast.literal_eval(s)"),
    (2, "QUAL-MUT", 1,
     "def f(a, b=None, c=None):\n    if b is None:\n        b = []\n    if c is None:\n        c = {}"),
    (3, "QUAL-EXC", 3, "except Exception as err:"),
    (3, "QUAL-EXC", 4, '    import logging\n    logging.getLogger(__name__).warning("suppressed: %s", err)'),
    (4, "SEC-YAML", 3, 'cfg = yaml.safe_load(open("c.yml"))'),
    (8, "ML-LEAK-PREFIT", 7, "# fitted after the split instead\n#     X = s.fit_transform(X)"),
    (11, "ML-VAL-NOSEED", 3, "km = KMeans(n_clusters=3, random_state=42)"),
    (12, "ML-MET-NOSTRAT", 5, "a, b = train_test_split([1, 2], random_state=0, stratify=y)"),
]


def _expected_rows():
    for t, rule, sev, title, line, end, snip, detail, disc, num, den in EXPECTED:
        text, first, last = (None, *snip) if isinstance(snip, tuple) else (snip, None, None)
        yield (t, rule, sev, title, line, end, text, first, last, detail, disc, num, den)


def percent(num: str, den: str) -> str:
    """Half-up percentage with one decimal from an integer pair."""
    p = f"((({num})*2000+({den}))//(({den})*2))"
    return f"(({p}//10) || '.' || ({p}%10) || '%')"


def tenths(x: str) -> str:
    return f"((CASE WHEN ({x})<0 THEN '-' ELSE '' END) || (abs({x})//10) || '.' || (abs({x})%10))"


HIT = ("repo_id, rule_id, severity, title, path, line_no, end_line_no, code_snippet, detail, disc, "
       "metric_num, metric_den")


def fixed_hit(rule, severity, title, path, line=1, snippet="NULL", detail="NULL", disc="''", num="NULL", den="NULL"):
    """SELECT list of a repository-level finding; all but rule and severity are SQL."""
    return (f"repo_id, {quote(rule)} AS rule_id, {severity} AS severity, {title} AS title, {path} AS path, "
            f"{line} AS line_no, NULL::INT AS end_line_no, {snippet} AS code_snippet, {detail} AS detail, "
            f"{disc} AS disc, {num}::BIGINT AS metric_num, {den}::BIGINT AS metric_den")


# Fixed values of the rules, typed from the source and not taken from the engine:
# rule, category, confidence in percent, fixable.
RULE_VALUES = [
    ("ARCH-001", "Architecture", 90, False), ("ARCH-GOD", "Architecture", 95, False),
    ("ARCH-INIT", "Architecture", 98, True), ("ARCH-CIRC", "Architecture", 92, False),
    ("QUAL-EXC", "Code Quality", 98, True), ("QUAL-MUT", "Code Quality", 99, True),
    ("QUAL-CMPX", "Code Quality", 92, False), ("QUAL-TYPE", "Code Quality", 90, False),
    ("DEP-NOMANIFEST", "Reproducibility", 98, True), ("DEP-DEPR", "Reproducibility", 99, True),
    ("DEP-UNPIN", "Reproducibility", 96, True),
    ("SEC-SECRET", "Security", 97, True), ("SEC-EXEC", "Security", 99, True), ("SEC-YAML", "Security", 98, True),
    ("SEC-SHELL", "Security", 95, True), ("SEC-SQL", "Security", 91, False),
    ("TEST-NOTESTS", "Testing", 99, True), ("TEST-LOWRATIO", "Testing", 92, False), ("TEST-NOASSERT", "Testing", 95, True),
    ("DOC-NOREADME", "Documentation", 99, True), ("DOC-SPARSE-README", "Documentation", 95, True),
    ("DOC-SECTIONS", "Documentation", 90, True), ("DOC-LOWDOCSTRINGS", "Documentation", 93, False),
    ("DOC-NOLICENSE", "Documentation", 98, True),
    ("CICD-NOWORKFLOWS", "CI/CD", 98, True), ("DEPLOY-NODOCKER", "CI/CD", 92, True),
    ("DEPLOY-DOCKER-LATEST", "CI/CD", 96, True), ("DEPLOY-NOGITIGNORE", "CI/CD", 99, True),
    ("DEPLOY-INCOMPLETE-GITIGNORE", "CI/CD", 97, True),
    ("ML-LEAK-PREFIT", "ML Engineering", 98, True), ("ML-LEAK-TESTFIT", "ML Engineering", 99, True),
    ("ML-PREP-NOPIPE", "ML Engineering", 94, True), ("ML-PREP-UNSCALED", "ML Engineering", 91, False),
    ("ML-VAL-NOSEED", "Reproducibility", 97, True), ("ML-VAL-NOCV", "ML Engineering", 88, False),
    ("ML-MET-NOSTRAT", "ML Engineering", 92, True), ("ML-MET-RAWACC", "ML Engineering", 89, False),
]
# Category and weight in percent.
WEIGHTS = [
    ("Architecture", 12), ("Code Quality", 15), ("Testing", 15), ("ML Engineering", 20), ("Security", 15),
    ("Documentation", 8), ("Reproducibility", 8), ("CI/CD", 7),
]


def ctes() -> dict[str, str]:
    out: dict[str, str] = {}
    out["docs"] = (
        "SELECT doc_id, doc_id//20 AS repo_id, ((doc_id%20)*(1+(doc_id//20)%5))%20 AS t, text FROM documents")
    out["tpl(t, code)"] = values((t, code or "") for t, code in enumerate(corpus.TEMPLATES))
    out["mods"] = f"""
        SELECT d.repo_id, d.doc_id, d.t,
          CASE WHEN d.t=0 THEN 'main_'||doc_id||'.py'
               WHEN d.t=18 THEN (CASE WHEN repo_id%10=8 THEN '' ELSE 'tests/' END)||'test_mod_'||doc_id||'.py'
               ELSE (CASE WHEN repo_id%10=8 THEN '' ELSE 'src/p'||(d.t%4)||'/' END)||'mod_'||doc_id||'.py' END AS path,
          (CASE WHEN d.t=17 THEN repeat('x = 1'||{NL}, (400+doc_id%800)::BIGINT) ELSE code END)
            || '# ' || replace(text, {NL}, {NL}||'# ') AS content
        FROM docs d JOIN tpl ON d.t = tpl.t"""
    out["repos"] = "SELECT DISTINCT repo_id FROM docs"

    def extra(path, content, cond="TRUE"):
        return f"SELECT repo_id, {quote(path)} AS path, {content} AS content FROM repos WHERE {cond}"

    readme = f"CASE WHEN repo_id%8=2 THEN '# Repo'||{NL}||{NL}||'Install it.'||{NL} ELSE {quote(corpus.README)} END"
    parts = [
        extra("README.md", f"({readme}) || CASE WHEN repo_id%4=0 THEN repeat('word ',40) ELSE '' END", "repo_id%2=0"),
        extra("LICENSE", f"'MIT'||{NL}", "repo_id%3=0"),
        extra("requirements.txt", quote(corpus.REQUIREMENTS), "repo_id%4<>3"),
        extra("Dockerfile", f"CASE WHEN repo_id%4=1 THEN 'FROM python:latest'||{NL} ELSE 'FROM python:3.11'||{NL} END",
              "repo_id%2=1"),
        extra(".gitignore", "CASE WHEN repo_id%5<3 THEN " + quote(".env\n__pycache__/\n.venv/\n")
              + " ELSE " + quote(".env\n") + " END", "repo_id%5<>0"),
        extra(".github/workflows/ci.yml", f"'on: push'||{NL}", "repo_id%7=0"),
        *[extra(f"src/p{k}/__init__.py", "''", "repo_id%2=1") for k in range(4)],
        extra("src/cyc/alpha.py", f"'import beta'||{NL}", "repo_id%3=1"),
        extra("src/cyc/beta.py", f"'from alpha import x'||{NL}", "repo_id%3=1"),
        extra("node_modules/a.js", f"'x'||{NL}"), extra("img.PNG", f"'x'||{NL}"), extra(".venv/lib.py", f"'x'||{NL}"),
    ]
    out["raw"] = "SELECT repo_id, path, content FROM mods UNION ALL " + " UNION ALL ".join(parts)
    out["sized"] = f"""
        SELECT *, strlen(content)::BIGINT AS size_bytes, ends_with(path, '.py') AS is_python,
          regexp_extract(path, '[^/]*$') AS base,
          CASE WHEN contains(path,'/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir,
          (CASE WHEN content='' THEN 0 ELSE length(content)-length(replace(content,{NL},''))
             + (CASE WHEN ends_with(content,{NL}) THEN 0 ELSE 1 END) END)::INT AS loc
        FROM raw"""
    keep = (f"size_bytes <= 2097152 AND lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) NOT IN "
            f"{names(model.IGNORE_EXTENSIONS)}")
    bad = f"(d IN {names(model.IGNORE_DIRS)} OR starts_with(d, '.'))"
    out["kept_strict"] = (
        f"SELECT * FROM sized WHERE {keep} AND len(list_filter(string_split(dir,'/'), lambda d: {bad})) = 0")
    out["files"] = (
        f"SELECT *, 'repo-'||repo_id AS repo_name FROM sized WHERE {keep} AND "
        f"len(list_filter(string_split(dir,'/'), lambda d: {bad} AND d <> '.github')) = 0")
    out["py"] = "SELECT * FROM files WHERE is_python"
    out["file_lines"] = f"""
        SELECT repo_id, path, is_python, line_no, l[line_no] AS text FROM (
          SELECT repo_id, path, is_python, l, unnest(generate_series(1, len(l))) AS line_no FROM (
            SELECT repo_id, path, is_python, CASE WHEN content='' THEN []::VARCHAR[] WHEN ends_with(content,{NL})
              THEN string_split(content,{NL})[:-2] ELSE string_split(content,{NL}) END AS l FROM files))"""

    out["exp(t, rule_id, severity, title, line_no, end_line_no, snip, snip_a, snip_b, detail, disc, num, den)"] = (
        values(_expected_rows()))
    out["hit_tpl"] = f"""
        SELECT m.repo_id, rule_id, severity, replace(title,'{{path}}',path) AS title, path, line_no, end_line_no,
          CASE WHEN snip_a IS NOT NULL THEN array_to_string(list_slice(string_split(content,{NL}), snip_a, snip_b), {NL})
               ELSE replace(snip,'{{path}}',path) END AS code_snippet,
          detail, disc, num::BIGINT AS metric_num, den::BIGINT AS metric_den
        FROM mods m JOIN exp e ON m.t = e.t"""
    out["hit_god"] = """
        SELECT repo_id, 'ARCH-GOD' AS rule_id, CASE WHEN loc>1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
          'Monolithic ''God File'' Detected ('||loc||' LOC)' AS title, path, 1 AS line_no, least(loc,50) AS end_line_no,
          '# File: '||path||' ('||loc||' lines)' AS code_snippet, loc::VARCHAR AS detail, '' AS disc,
          loc::BIGINT AS metric_num, NULL::BIGINT AS metric_den FROM py WHERE loc>600"""
    out["secret_rule(label, pattern)"] = values(model.SECRET_PATTERNS.items())
    out["secret_hit"] = """
        SELECT l.repo_id, l.path, l.line_no, l.text, s.label FROM file_lines l JOIN secret_rule s
          ON regexp_matches(l.text, s.pattern)
        WHERE l.is_python AND NOT (contains(lower(l.path),'test')
          AND (contains(lower(l.text),'dummy') OR contains(lower(l.text),'example') OR contains(lower(l.text),'mock')))"""
    out["hit_secret"] = """
        SELECT repo_id, 'SEC-SECRET' AS rule_id, 'CRITICAL' AS severity, label||' Detected in Source Code' AS title, path,
          line_no, NULL::INT AS end_line_no, substr(trim(text),1,80)||'...' AS code_snippet, NULL AS detail, label AS disc,
          NULL::BIGINT AS metric_num, NULL::BIGINT AS metric_den FROM secret_hit"""
    out["req"] = f"""
        SELECT repo_id, path, line_no, trim(text) AS text,
          lower(regexp_extract(trim(text), {quote(model.REQUIREMENT_PATTERN)}, 1)) AS pkg,
          trim(regexp_extract(trim(text), {quote(model.REQUIREMENT_PATTERN)}, 2)) AS bound
        FROM file_lines WHERE path='requirements.txt' AND trim(text)<>'' AND NOT starts_with(trim(text),'#')
          AND NOT starts_with(trim(text),'-') AND regexp_matches(trim(text), {quote(model.REQUIREMENT_PATTERN)})"""
    out["deprecated(pkg, substitute)"] = values(model.DEPRECATED_PACKAGES.items())
    out["pin(pkg, pinned)"] = values(model.RECOMMENDED_PINS.items())
    out["dep"] = """
        SELECT r.*, d.substitute, coalesce(p.pinned, r.pkg||'==latest-stable') AS pinned,
          (d.pkg IS NULL AND (bound='' OR (contains(bound,'>=') AND NOT contains(bound,'<') AND NOT contains(bound,'==')))) AS loose
        FROM req r LEFT JOIN deprecated d ON r.pkg=d.pkg LEFT JOIN pin p ON r.pkg=p.pkg"""
    out["hit_dep"] = """
        SELECT repo_id, 'DEP-DEPR' AS rule_id, 'HIGH' AS severity, 'Deprecated/Insecure Dependency '''||pkg||'''' AS title,
          path, line_no, NULL::INT AS end_line_no, text AS code_snippet, substitute AS detail, pkg AS disc,
          NULL::BIGINT AS metric_num, NULL::BIGINT AS metric_den FROM dep WHERE substitute IS NOT NULL
        UNION ALL
        SELECT repo_id, 'DEP-UNPIN', 'MEDIUM', 'Unpinned Dependency '''||text||'''', path, line_no, NULL, text, pinned, pkg,
          NULL, NULL FROM dep WHERE loose"""
    out["gaps"] = """
        SELECT repo_id, path, array_to_string(list_filter(['.env','__pycache__','.venv'],
          lambda g: NOT contains(content,g)), ', ') AS missing FROM files WHERE path='.gitignore'"""
    out["hit_ignore"] = ("SELECT " + fixed_hit(
        "DEPLOY-INCOMPLETE-GITIGNORE", "'MEDIUM'", "'.gitignore Missing Essential Rules ('||missing||')'", "path",
        detail="missing") + " FROM gaps WHERE missing <> ''")
    out["docnum(t, pub, documented)"] = values(DOCSTRINGS)
    out["repo_docs"] = (
        # Tests at the root count: two undocumented functions each.
        "SELECT repo_id, coalesce(sum(CASE WHEN repo_id%10=8 AND mods.t=18 THEN 2 ELSE pub END),0)::BIGINT AS pub, "
        "coalesce(sum(documented),0)::BIGINT AS documented "
        "FROM mods LEFT JOIN docnum ON mods.t = docnum.t GROUP BY repo_id")
    test = "is_python AND contains(lower(path),'test')"
    source = "is_python AND NOT contains(lower(path),'test')"
    out["agg"] = f"""
        SELECT f.repo_id, 'repo-'||f.repo_id AS repo_name, count(*) AS total_files, count(*) FILTER (is_python) AS python_files,
          sum(loc)::BIGINT AS total_loc, count(*) FILTER (is_python AND NOT contains(path,'/')) AS root_python_files,
          count(*) FILTER ({test}) AS test_files,
          coalesce(sum(loc) FILTER ({test}),0)::BIGINT AS test_loc, coalesce(sum(loc) FILTER ({source}),0)::BIGINT AS source_loc,
          min(path) FILTER (is_python) AS first_python, min(path) FILTER ({source}) AS first_source,
          min(path) FILTER ({test}) AS first_test, min(path) FILTER (is_python AND NOT starts_with(path,'tests/')) AS first_untested,
          bool_or(path IN {names(model.MANIFESTS)}) AS has_manifest, bool_or(path IN {names(model.LICENSES)}) AS has_license,
          bool_or(path='.gitignore') AS has_gitignore, bool_or(path='README.md') AS has_readme,
          bool_or(path='Dockerfile') AS has_docker,
          bool_or(regexp_matches(path,'^\\.github/workflows/.*\\.ya?ml$')) AS has_workflow,
          max(CASE WHEN path='README.md' THEN content END) AS readme, max(CASE WHEN path='Dockerfile' THEN content END) AS docker,
          max(pub) AS pub, max(documented) AS documented
        FROM files f JOIN repo_docs d ON f.repo_id=d.repo_id GROUP BY f.repo_id"""
    share = percent("test_loc", "source_loc")
    cover = percent("documented", "pub")
    repo_hits = [
        ("flat", fixed_hit("ARCH-001", "'MEDIUM'", "'Flat Unstructured Root Directory'", "first_python", "NULL",
                           num="root_python_files"), "root_python_files>6 AND root_python_files=python_files"),
        ("nomanifest", fixed_hit("DEP-NOMANIFEST", "'HIGH'",
                                 "'Missing Dependency Manifest (requirements.txt / pyproject.toml)'",
                                 "'requirements.txt'", "NULL"), "NOT has_manifest AND python_files>0"),
        ("notests", fixed_hit("TEST-NOTESTS", "'CRITICAL'", "'No Automated Test Suite Detected'", "first_source"),
         "test_files=0 AND python_files>0"),
        ("lowratio", fixed_hit("TEST-LOWRATIO", "CASE WHEN test_loc*100<source_loc*5 THEN 'HIGH' ELSE 'MEDIUM' END",
                               f"'Low Test-to-Code Ratio ('||{share}||')'", "first_test", "NULL",
                               detail="test_loc||' of '||source_loc", num="test_loc", den="source_loc"),
         "test_files>0 AND source_loc>100 AND test_loc*100<source_loc*15"),
        ("noreadme", fixed_hit("DOC-NOREADME", "'HIGH'", "'Missing README.md Documentation'", "'README.md'"),
         "NOT has_readme"),
        ("sparse", fixed_hit("DOC-SPARSE-README", "'MEDIUM'", "'Sparse / Incomplete README.md'", "'README.md'",
                             snippet="substr(readme,1,100)", num=f"length(trim(readme, ' '||{NL}))"),
         f"has_readme AND length(trim(readme, ' '||{NL}))<150"),
        ("lowdoc", fixed_hit("DOC-LOWDOCSTRINGS", "CASE WHEN documented*100<pub*20 THEN 'MEDIUM' ELSE 'LOW' END",
                             f"'Low Public API Docstring Coverage ('||{cover}||')'", "first_untested",
                             detail="documented||' of '||pub", num="documented", den="pub"),
         "pub>4 AND documented*100<pub*40"),
        ("nolicense", fixed_hit("DOC-NOLICENSE", "'LOW'", "'Missing Open-Source LICENSE File'", "'LICENSE'"),
         "NOT has_license"),
        ("noflow", fixed_hit("CICD-NOWORKFLOWS", "'HIGH'", "'Missing Automated CI/CD Workflows'",
                             "'.github/workflows/ci.yml'"), "NOT has_workflow"),
        ("nodocker", fixed_hit("DEPLOY-NODOCKER", "'LOW'", "'Missing Dockerfile for Containerized Deployment'",
                               "'Dockerfile'"), "NOT has_docker"),
        ("latest", fixed_hit("DEPLOY-DOCKER-LATEST", "'MEDIUM'", "'Unpinned Docker Base Image (''latest'' tag)'",
                             "'Dockerfile'", snippet=f"string_split(docker,{NL})[1]"),
         "contains(docker,'latest') AND contains(docker,'FROM')"),
        ("noignore", fixed_hit("DEPLOY-NOGITIGNORE", "'HIGH'", "'Missing .gitignore File'", "'.gitignore'"),
         "NOT has_gitignore"),
    ]
    missing = ("array_to_string(list_filter(['install','usage','example'], "
               "lambda s: NOT contains(lower(readme), s)), ', ')")
    repo_hits.append(("sections", fixed_hit(
        "DOC-SECTIONS", "'LOW'", f"'README Missing Essential Sections ('||{missing}||')'", "'README.md'",
        detail=missing), f"has_readme AND {missing} <> ''"))
    out["hit_repo"] = " UNION ALL ".join(f"SELECT {cols} FROM agg WHERE {cond}" for _, cols, cond in repo_hits)
    out["dirs"] = "SELECT DISTINCT repo_id, dir FROM py WHERE dir <> ''"
    out["bare_dirs"] = """
        SELECT d.repo_id, d.dir FROM dirs d WHERE d.dir <> 'tests' AND NOT EXISTS (
          SELECT 1 FROM files f WHERE f.repo_id=d.repo_id AND f.path = d.dir||'/__init__.py')"""
    out["hit_init"] = "SELECT " + fixed_hit(
        "ARCH-INIT", "'LOW'", "'Missing __init__.py in package directory '''||dir||''''", "dir||'/__init__.py'",
        snippet="''", detail="dir") + " FROM bare_dirs"
    out["hit_circ"] = "SELECT " + fixed_hit(
        "ARCH-CIRC", "'HIGH'", "'Circular Import Dependency: alpha <-> beta'", "'src/cyc/alpha.py'",
        detail="'src/cyc/alpha.py, src/cyc/beta.py'", disc="'alpha|beta'") + " FROM repos WHERE repo_id%3=1"
    out["hits"] = " UNION ALL ".join(f"SELECT {HIT} FROM {h}" for h in (
        "hit_tpl", "hit_god", "hit_secret", "hit_dep", "hit_ignore", "hit_repo", "hit_init", "hit_circ"))
    out["rule_dim(rule_id, category, analyzer_ord, confidence_pct, auto_fixable, risk, advice)"] = values(
        (rule_id, category, model.RULES_BY_ID[rule_id].analyzer_ord, confidence, fixable,
         model.RULES_BY_ID[rule_id].risk, model.RULES_BY_ID[rule_id].advice)
        for rule_id, category, confidence, fixable in RULE_VALUES)
    out["findings"] = """
        SELECT h.rule_id||'-'||substr(sha256(concat_ws('|', h.repo_id::VARCHAR, path, coalesce(line_no::VARCHAR,'-'), disc)),1,16)
            AS finding_id,
          h.rule_id, h.repo_id, d.category, h.severity, h.title, h.path, h.line_no::INT AS line_no,
          h.end_line_no::INT AS end_line_no, h.code_snippet,
          replace(d.risk,'{x}',coalesce(h.detail,'')) AS risk_explanation,
          replace(d.advice,'{x}',coalesce(h.detail,'')) AS recommendation,
          d.confidence_pct/100.0::DOUBLE AS confidence, d.auto_fixable, h.metric_num, h.metric_den,
          d.analyzer_ord::INT AS analyzer_ord
        FROM hits h JOIN rule_dim d ON h.rule_id=d.rule_id"""
    out.update(score_ctes("findings", "agg", ""))
    out["summary"] = """
        SELECT c.repo_id, c.repo_name, 'Scored '||""" + tenths("overall_tenths") + """||'/10 (grade '||grade||') over 8 categories. '
          ||total_issues||' findings ('||critical_issues||' critical, '||high_issues||' high, '||medium_issues||' medium). '
          || coalesce('Critical: '||fc.title||' in `'||fc.path||'`.', 'Key risk: '||fh.title||' in `'||fh.path||'`.',
                      'No critical or high finding.') AS summary
        FROM cards c
          LEFT JOIN (SELECT * FROM ranked WHERE severity='CRITICAL' AND rs=1) fc ON c.repo_id=fc.repo_id
          LEFT JOIN (SELECT * FROM ranked WHERE severity='HIGH' AND rs=1) fh ON c.repo_id=fh.repo_id"""
    out["ranked"] = """
        SELECT *, row_number() OVER (PARTITION BY repo_id, severity ORDER BY analyzer_ord, path, line_no NULLS FIRST, rule_id, finding_id) AS rs,
          row_number() OVER (PARTITION BY repo_id ORDER BY analyzer_ord, path, line_no NULLS FIRST, rule_id, finding_id) AS ra
        FROM findings"""
    out["summary"] = out.pop("summary")
    out.update(repair_ctes())
    out.update(trial_ctes())
    out["snap"] = """
        SELECT user_id::BIGINT AS repo_id, event_id::BIGINT AS snapshot_id, ts,
          (10 + floor(value)::BIGINT % 91)::INT AS overall_tenths, (event_id%40)::BIGINT AS total_issues,
          (event_id%5)::BIGINT AS fixes_applied, CASE WHEN event_type='signup' THEN 'First contact' ELSE '' END AS given
        FROM events"""
    d = "(overall_tenths-previous_tenths)"
    out["tl"] = f"""
        SELECT *, 'v'||version_no AS version, {d} AS delta_tenths,
          CASE WHEN given<>'' THEN given WHEN version_no=1 THEN 'Initial scan & diagnosis'
            ELSE 'Repaired '||fixes_applied||' issues (Score '||(CASE WHEN {d}>=0 THEN '+' ELSE '' END)||{tenths(d)}||')' END
            AS description
        FROM (SELECT *, row_number() OVER w AS version_no, lag(overall_tenths) OVER w AS previous_tenths
              FROM snap WINDOW w AS (PARTITION BY repo_id ORDER BY ts, snapshot_id))"""
    return out


def score_ctes(findings: str, repos: str, tag: str) -> dict[str, str]:
    """Category scores and scorecards from a findings table."""
    out = {}
    out[f"catdim{tag}(ord, category, weight)"] = values(
        (k + 1, c, w) for k, (c, w) in enumerate(WEIGHTS))
    cost = ("CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 3 "
            "WHEN 'INFO' THEN 0 ELSE 5 END")
    out[f"cats{tag}"] = f"""
        SELECT r.repo_id, c.ord, c.category, c.weight,
          greatest(10, least(100, 100 - coalesce(sum({cost}) FILTER (f.finding_id IS NOT NULL),0)))::INT AS score_tenths,
          count(f.finding_id) AS issue_count, count(f.finding_id) FILTER (f.severity='CRITICAL') AS critical_count
        FROM {repos} r CROSS JOIN catdim{tag} c LEFT JOIN {findings} f ON f.repo_id=r.repo_id AND f.category=c.category
        GROUP BY r.repo_id, c.ord, c.category, c.weight"""
    out[f"overall{tag}"] = f"""
        SELECT repo_id, greatest(10, least(100, (sum(score_tenths*weight)+50)//100))::INT AS overall_tenths
        FROM cats{tag} GROUP BY repo_id"""
    sev = ", ".join(f"count(*) FILTER (severity='{s.upper()}') AS {s}_issues" for s in ("critical", "high", "medium", "low"))
    out[f"cards{tag}"] = f"""
        SELECT o.repo_id, 'repo-'||o.repo_id AS repo_name, overall_tenths, overall_tenths/10 AS overall_score,
          CASE WHEN overall_tenths>=95 THEN 'A+' WHEN overall_tenths>=85 THEN 'A' WHEN overall_tenths>=70 THEN 'B'
               WHEN overall_tenths>=55 THEN 'C' WHEN overall_tenths>=40 THEN 'D' ELSE 'F' END AS grade,
          coalesce(total_issues,0) AS total_issues, coalesce(critical_issues,0) AS critical_issues,
          coalesce(high_issues,0) AS high_issues, coalesce(medium_issues,0) AS medium_issues, coalesce(low_issues,0) AS low_issues
        FROM overall{tag} o LEFT JOIN (SELECT repo_id, count(*) AS total_issues, {sev} FROM {findings} GROUP BY repo_id) n
          ON o.repo_id=n.repo_id"""
    return out


def digit(column: str) -> str:
    return f"(instr('0123456789abcdef', right({column},1))-1)"


def repair_ctes() -> dict[str, str]:
    from fleetlint.operators.repair import FILE_TEMPLATES

    out = {}
    k = digit("finding_id")
    out["edit_tpl(t, rule_id, line_no, new_text)"] = values(EDITS)
    out["edits"] = """
        SELECT f.repo_id, f.path, f.finding_id, f.rule_id, e.line_no::INT AS line_no, e.new_text
        FROM findings f JOIN mods m ON f.repo_id=m.repo_id AND f.path=m.path JOIN edit_tpl e ON m.t=e.t AND f.rule_id=e.rule_id
        UNION ALL
        SELECT f.repo_id, f.path, f.finding_id, f.rule_id, f.line_no, coalesce(d.substitute, d.pinned)
        FROM findings f JOIN dep d ON f.repo_id=d.repo_id AND f.path=d.path AND f.line_no=d.line_no
        WHERE f.rule_id IN ('DEP-DEPR','DEP-UNPIN')"""
    out["created_tpl(rule_id, template)"] = values(FILE_TEMPLATES.items())
    out["created"] = """
        SELECT f.repo_id, f.path, f.finding_id, f.rule_id, 'Create '||f.path AS description,
          replace(template,'{repo}','repo-'||f.repo_id) AS replacement_code
        FROM findings f JOIN created_tpl c ON f.rule_id=c.rule_id"""
    out["accepted"] = f"""
        SELECT finding_id, repo_id, rule_id, path, title, 'The command runs in a shell.' AS root_cause,
          {quote(corpus.PROPOSED_CODE)} AS replacement_code
        FROM findings WHERE rule_id='SEC-SHELL' AND {k}<8 AND {k}%4<>3"""
    out["patches"] = """
        SELECT DISTINCT e.repo_id, e.path, e.finding_id, e.rule_id, 'Auto-repair: '||f.title AS description
        FROM edits e JOIN findings f ON e.finding_id=f.finding_id
        UNION ALL SELECT repo_id, path, finding_id, rule_id, description FROM created
        UNION ALL SELECT repo_id, path, finding_id, rule_id, 'Proposed repair: '||title||'. '||root_cause FROM accepted"""
    out["results"] = f"""
        SELECT repo_id, finding_id AS patch_id, rule_id, path, description,
          CASE WHEN {k} IN (1,2,3) THEN 'FAILED' ELSE 'PASSED' END AS overall_status, TRUE AS syntax_check,
          {k} NOT IN (1,2,3) AS import_check,
          CASE WHEN {k}=0 THEN 2 ELSE 3 END AS tests_passed_before, CASE WHEN {k}=0 THEN 1 ELSE 0 END AS tests_failed_before,
          CASE WHEN {k} IN (1,2) THEN 2 WHEN {k}=3 THEN 0 ELSE 3 END AS tests_passed_after,
          CASE WHEN {k} IN (1,2) THEN 1 ELSE 0 END AS tests_failed_after,
          CASE WHEN {k} IN (1,2,3) THEN 0.2 ELSE 0.99 END::DOUBLE AS confidence,
          'Security Gate Validation=PASSED;Baseline Test Execution='||(CASE WHEN {k}=0 THEN 'WARNING' ELSE 'PASSED' END)
            ||';Patch Application=PASSED;Syntax Verification=PASSED;Post-Patch Test Execution='
            ||(CASE WHEN {k} IN (1,2,3) THEN 'FAILED' ELSE 'PASSED' END) AS steps
        FROM patches"""
    out["passed"] = "SELECT repo_id, path, patch_id AS finding_id, rule_id FROM results WHERE overall_status='PASSED'"
    out["passed_edits"] = """
        SELECT DISTINCT e.repo_id, e.path, e.line_no, e.new_text FROM edits e JOIN passed p ON e.finding_id=p.finding_id"""
    out["rebuilt"] = f"""
        SELECT l.repo_id, l.path, string_agg(coalesce(e.new_text, l.text), {NL} ORDER BY l.line_no)||{NL} AS content
        FROM file_lines l
          JOIN (SELECT DISTINCT repo_id, path FROM passed_edits) f ON l.repo_id=f.repo_id AND l.path=f.path
          LEFT JOIN passed_edits e ON l.repo_id=e.repo_id AND l.path=e.path AND l.line_no=e.line_no
        GROUP BY l.repo_id, l.path
        UNION ALL SELECT c.repo_id, c.path, c.replacement_code FROM created c JOIN passed p ON c.finding_id=p.finding_id
        UNION ALL SELECT a.repo_id, a.path, a.replacement_code FROM accepted a JOIN passed p ON a.finding_id=p.finding_id"""
    # After the repair: verified findings are gone, as are both defaults of a
    # def line once one of its patches passes; a renamed requirement is unpinned.
    out["gone"] = """
        SELECT finding_id FROM passed UNION
        SELECT f.finding_id FROM findings f JOIN passed p ON f.repo_id=p.repo_id AND f.path=p.path AND f.rule_id=p.rule_id
        WHERE f.rule_id='QUAL-MUT'"""
    out["loc_change"] = f"""
        SELECT r.repo_id, sum((length(r.content)-length(replace(r.content,{NL},''))) - coalesce(f.loc,0))::BIGINT AS d
        FROM rebuilt r LEFT JOIN files f ON r.repo_id=f.repo_id AND r.path=f.path
        WHERE ends_with(r.path,'.py') AND NOT contains(lower(r.path),'test') GROUP BY r.repo_id"""
    out["agg_after"] = """
        SELECT a.* EXCLUDE (source_loc), a.source_loc + coalesce(d,0) AS source_loc
        FROM agg a LEFT JOIN loc_change c ON a.repo_id=c.repo_id"""
    out["findings_after"] = """
        SELECT f.finding_id, f.rule_id, f.repo_id, f.category, f.severity FROM findings f
        WHERE f.rule_id <> 'TEST-LOWRATIO' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.finding_id=f.finding_id)
        UNION ALL
        SELECT 'TEST-LOWRATIO-'||substr(sha256(concat_ws('|', repo_id::VARCHAR, first_test, '-', '')),1,16), 'TEST-LOWRATIO',
          repo_id, 'Testing', CASE WHEN test_loc*100<source_loc*5 THEN 'HIGH' ELSE 'MEDIUM' END
        FROM agg_after WHERE test_files>0 AND source_loc>100 AND test_loc*100<source_loc*15
        UNION ALL
        SELECT 'DEP-UNPIN-'||substr(sha256(concat_ws('|', repo_id::VARCHAR, 'requirements.txt', line_no::VARCHAR, new_text)),1,16),
          'DEP-UNPIN', repo_id, 'Reproducibility', 'MEDIUM'
        FROM passed_edits WHERE path='requirements.txt' AND new_text='scikit-learn'"""
    out.update(score_ctes("findings_after", "agg", "_after"))
    return out


def trial_ctes() -> dict[str, str]:
    """The gate's trial patches; kinds as documented in the corpus."""
    out = {}
    old = {3: "import os\ndef run():\n    pass\n"}
    new = [
        "def run(x):\n    return float(x)\n",
        "import socket.x\nimport json\ndef run(x):\n    return socket.x(x)\n",
        "def run(x):\n    return eval(compile(x))\n",
        "import os\ndef run():\n    os.system('ls')\n",
        "def run(x):\n    return float(x)\n",
        "def run(x):\n    return int(x)\n",
        "def run(x:\n    return int(x)\n",
        "def run(x):\n    return int(x)\nreturn 1\n",
    ]
    rows = [
        # kind, old, new, parses, compiles, old modules, old calls, new modules, new calls, objections
        (0, True, True, "", "int", "", "float", ""),
        (1, True, True, "", "int", "json,socket", "", "patch introduces forbidden module 'socket'"),
        (2, True, True, "", "int", "", "compile,eval",
         "patch introduces dangerous call 'compile()'; patch introduces dangerous call 'eval()'"),
        (3, True, True, "os", "", "os", "os.system", "patch introduces dangerous call 'os.system()'"),
        (4, True, True, "", "int", "", "float", ""),
        (5, True, True, "", "int", "", "int", ""),
        (6, False, None, None, None, None, None, ""),
        (7, True, False, "", "int", "", "int", ""),
    ]
    default = "def run(x):\n    return int(x)\n"
    out["kinds(kind, old_code, new_code, parse_ok, compile_ok, old_modules, old_calls, new_modules, new_calls, vulnerabilities)"] = (
        values((r[0], old.get(r[0], default), new[r[0]], *r[1:]) for r in rows))
    notes = f"('# '||replace(text,{NL},{NL}||'# ')||{NL})"
    count = "length({0})-length(replace({0},chr(10),''))"
    out["trial_text"] = f"""
        SELECT doc_id//20 AS repo_id, doc_id, 'TRIAL-'||doc_id AS finding_id,
          (CASE WHEN kind=4 THEN '../' ELSE '' END)||'src/mod_'||doc_id||'.py' AS path,
          old_code||{notes} AS o, new_code||(CASE WHEN kind=5 THEN repeat({notes},6) ELSE {notes} END) AS n, k.*
        FROM documents JOIN kinds k ON doc_id%8=k.kind"""
    out["trials"] = f"""
        SELECT *, old_lines>10 AND new_lines*10>old_lines*35 AS expands, new_lines-old_lines>250 AS adds_too_much
        FROM (SELECT *, ({count.format('o')})::INT AS old_lines, ({count.format('n')})::INT AS new_lines FROM trial_text)"""
    out["decisions"] = """
        SELECT *, (CASE WHEN kind=4 THEN 1 ELSE 0 END) + expands::INT + adds_too_much::INT + (CASE WHEN kind=6 THEN 1 ELSE 0 END)
          + (CASE WHEN vulnerabilities='' THEN 0 ELSE len(string_split(vulnerabilities,'; ')) END) AS n_reasons
        FROM trials"""
    return out


def build(final: str) -> str:
    """A statement with just the table expressions it uses, in order."""
    tables = ctes()

    def words(sql):
        return set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", sql)))

    heads = {head.split("(")[0]: head for head in tables}
    needed: set[str] = set()
    todo = [final]
    while todo:
        for word in words(todo.pop()):
            if word in heads and word not in needed:
                needed.add(word)
                todo.append(tables[heads[word]])
    listed = []

    def visit(name):
        if name in listed:
            return
        for word in sorted(words(tables[heads[name]])):
            if word in heads and word != name and word in needed:
                visit(word)
        if name not in listed:
            listed.append(name)

    for name in sorted(needed):
        visit(name)
    if not listed:
        return final
    return "WITH " + ",\n".join(f"{heads[n]} AS ({tables[heads[n]]})" for n in listed) + "\n" + final
