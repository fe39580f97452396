"""One SQL statement per query of the catalog."""

from __future__ import annotations

from fleetlint import model
from oracle.base import NL, build, digit, names, percent, quote, tenths, values

FCOLS = ("finding_id, rule_id, repo_id, category, severity, title, path, line_no, end_line_no, code_snippet, "
         "confidence, auto_fixable, metric_num, metric_den, analyzer_ord")

# Expected facts per template, by hand.
# t -> parse_ok, calls, scopes, imports, defs, handlers, fstrings
FACT_COUNTS = [
    (0, True, 0, 0, 0, 1, 0, 0), (1, True, 1, 0, 0, 1, 0, 0), (2, True, 0, 0, 0, 1, 0, 0),
    (3, True, 0, 0, 0, 0, 1, 0), (4, True, 4, 0, 1, 0, 0, 0), (5, True, 2, 0, 1, 0, 0, 0),
    (6, True, 0, 0, 0, 1, 0, 1), (7, True, 0, 0, 0, 0, 0, 0), (8, True, 3, 2, 2, 1, 0, 0),
    (9, True, 1, 2, 0, 1, 0, 0), (10, True, 1, 0, 1, 0, 0, 0), (11, True, 2, 0, 1, 0, 0, 0),
    (12, True, 1, 1, 3, 0, 0, 0), (13, True, 2, 2, 0, 1, 0, 0), (14, True, 0, 0, 0, 1, 0, 0),
    (15, True, 0, 0, 0, 4, 0, 0), (16, False, 0, 0, 0, 0, 0, 0), (17, True, 0, 0, 0, 0, 0, 0),
    (18, True, 1, 0, 0, 2, 0, 0), (19, True, 3, 0, 3, 0, 0, 0),
]
# t -> name, line, has_docstring, typed_args, typed_return, mutable_defaults, complexity, asserts_or_calls
DEFS = [
    (0, "add", 4, True, True, True, 0, 1, 0), (1, "parse", 1, False, True, False, 0, 1, 1),
    (2, "f", 1, False, False, False, 2, 1, 0), (6, "q", 1, False, True, True, 0, 1, 0),
    (8, "load", 5, False, False, False, 0, 1, 3), (9, "prep", 1, False, False, False, 0, 1, 1),
    (13, "run", 2, False, False, False, 0, 1, 2), (14, "g", 1, False, True, True, 0, 13, 0),
    (15, "a1", 1, False, False, False, 0, 1, 0), (15, "a2", 2, False, False, False, 0, 1, 0),
    (15, "a3", 3, False, False, False, 0, 1, 0), (15, "a4", 4, False, True, True, 0, 1, 0),
    (18, "test_nothing", 1, False, False, False, 0, 1, 0), (18, "test_call", 5, False, False, False, 0, 1, 1),
]
# t -> call_id (breadth-first), line, span, kind, name, receiver, n_args, arg0_src, call_src, keywords
CALLS = [
    (1, 0, 2, "11-2:18", "name", "eval", None, 1, None, None, ""),
    (4, 0, 3, "6-3:30", "attr", "load", "yaml", 1, None, None, ""),
    (4, 1, 4, "5-4:53", "attr", "load", "yaml", 1, None, None, "Loader"),
    (4, 2, 3, "16-3:29", "name", "open", None, 1, None, None, ""),
    (4, 3, 4, "15-4:28", "name", "open", None, 1, None, None, ""),
    (5, 0, 3, "0-3:32", "attr", "run", "subprocess", 1, None, None, "shell"),
    (5, 1, 4, "0-4:22", "attr", "run", "subprocess", 1, None, None, ""),
    (8, 0, 6, "8-6:24", "name", "StandardScaler", None, 0, None, None, ""),
    (8, 1, 7, "8-7:26", "attr", "fit_transform", "s", 1, "X", "s.fit_transform(X)", ""),
    (8, 2, 8, "11-8:49", "name", "train_test_split", None, 2, None, None, "random_state"),
    (9, 0, 2, "11-2:35", "attr", "fit_transform", "sc", 1, "X_test", "sc.fit_transform(X_test)", ""),
    (10, 0, 3, "6-3:16", "name", "SVC", None, 0, None, None, "C"),
    (11, 0, 3, "5-3:25", "name", "KMeans", None, 0, None, None, "n_clusters"),
    (11, 1, 4, "5-4:41", "name", "KMeans", None, 0, None, None, "n_clusters,random_state"),
    (12, 0, 5, "7-5:47", "name", "train_test_split", None, 1, None, None, "random_state"),
    (13, 0, 3, "9-3:28", "attr", "transform", "scaler", 1, "X", "scaler.transform(X)", ""),
    (13, 1, 4, "4-4:20", "attr", "fit", "model", 2, "X2", "model.fit(X2, y)", ""),
    (18, 0, 6, "4-6:12", "name", "print", None, 1, None, None, ""),
    (19, 0, 5, "4-5:71", "name", "make_pipeline", None, 2, None, None, ""),
    (19, 1, 5, "18-5:34", "name", "StandardScaler", None, 0, None, None, ""),
    (19, 2, 5, "36-5:70", "name", "LogisticRegression", None, 0, None, None, "random_state"),
]
# t -> line, kind, module, names, source text
IMPORTS = [
    (4, 1, "import", None, "yaml", "import yaml"), (5, 1, "import", None, "subprocess", "import subprocess"),
    (8, 1, "from", "sklearn.model_selection", "train_test_split,KFold",
     "from sklearn.model_selection import train_test_split, KFold"),
    (8, 2, "from", "sklearn.preprocessing", "StandardScaler", "from sklearn.preprocessing import StandardScaler"),
    (10, 1, "from", "sklearn.svm", "SVC", "from sklearn.svm import SVC"),
    (11, 1, "from", "sklearn.cluster", "KMeans", "from sklearn.cluster import KMeans"),
    (12, 1, "from", "sklearn.ensemble", "RandomForestClassifier", "from sklearn.ensemble import RandomForestClassifier"),
    (12, 2, "from", "sklearn.metrics", "accuracy_score", "from sklearn.metrics import accuracy_score"),
    (12, 3, "from", "sklearn.model_selection", "train_test_split",
     "from sklearn.model_selection import train_test_split"),
    (19, 1, "from", "sklearn.pipeline", "make_pipeline", "from sklearn.pipeline import make_pipeline"),
    (19, 2, "from", "sklearn.preprocessing", "StandardScaler", "from sklearn.preprocessing import StandardScaler"),
    (19, 3, "from", "sklearn.linear_model", "LogisticRegression",
     "from sklearn.linear_model import LogisticRegression"),
]
# t -> scope kind, scope line, uses_pipeline, call line, name, item, in body
SCOPE_CALLS = [
    (8, "module", 1, None, 7, "fit_transform", 2, True), (8, "module", 1, None, 8, "train_test_split", 2, True),
    (8, "function", 5, None, 7, "fit_transform", 1, True), (8, "function", 5, None, 8, "train_test_split", 2, True),
    (9, "module", 1, None, 2, "fit_transform", 0, True), (9, "function", 1, None, 2, "fit_transform", 0, True),
    (12, "module", 1, None, 5, "train_test_split", 3, True),
    (13, "module", 1, False, 3, "transform", 1, True), (13, "module", 1, False, 4, "fit", 1, True),
    (13, "function", 2, False, 3, "transform", 0, True), (13, "function", 2, False, 4, "fit", 1, True),
]
# t -> import flags: splits, cv, classifier, accuracy, robust
FLAGS = [(4, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (8, 1, 1, 0, 0, 0), (10, 0, 0, 1, 0, 0), (11, 0, 0, 0, 0, 0),
         (12, 1, 0, 1, 1, 0), (19, 0, 0, 1, 0, 0)]
# t -> public functions, annotated ones
TYPED = [(0, 1, 1), (1, 1, 1), (2, 1, 0), (6, 1, 1), (8, 1, 0), (9, 1, 0), (13, 1, 0), (14, 1, 1), (15, 4, 1),
         (18, 2, 0)]


def _per_template(columns: str, rows, select: str) -> str:
    return f"SELECT m.repo_id, m.path, {select} FROM mods m JOIN {values(rows)} v({columns}) ON m.t = v.t"


def _cyclic(select_alpha: str, select_beta: str) -> str:
    return (f"SELECT repo_id, 'src/cyc/alpha.py' AS path, {select_alpha} FROM repos WHERE repo_id%3=1 UNION ALL "
            f"SELECT repo_id, 'src/cyc/beta.py', {select_beta} FROM repos WHERE repo_id%3=1")


def _edit(*rules) -> str:
    return (f"SELECT repo_id, path, finding_id, line_no, 'replace' AS op, new_text FROM edits "
            f"WHERE rule_id IN {names(rules)}")


def _section(number, source, texts, order="0", place="''", title=None) -> str:
    """A report section as rows; ``texts`` are SQL expressions, null where a line is left out."""
    items = ", ".join(f"({t})::VARCHAR" for t in texts)
    body = (
        f"SELECT repo_id, {number} AS section, ({order})::BIGINT AS ord, {place} AS place, (sub-1)::INT AS sub, present[sub] AS text "
        f"FROM (SELECT *, unnest(generate_series(1, len(present))) AS sub FROM ("
        f"SELECT *, list_filter([{items}], lambda x: x IS NOT NULL) AS present FROM {source}))")
    if title:
        body += (f" UNION ALL SELECT repo_id, {number}, -1, '', sub, ['', {quote('## ' + title)}, ''][sub+1] FROM ("
                 f"SELECT DISTINCT repo_id, unnest([0,1,2])::INT AS sub FROM {source})")
    return body


def _report() -> str:
    """Sections 0 to 4 of the report as rows."""
    sure = "floor(round(confidence*100,6))::INT||' in 100 sure'"
    shade = "CASE WHEN score_tenths>=85 THEN 'green' WHEN score_tenths>=65 THEN 'yellow' ELSE 'red' END"
    words = ("CASE WHEN score_tenths>=90 THEN 'Excellent health' WHEN score_tenths>=70 THEN 'Minor issues found' "
             "ELSE 'Needs immediate attention' END")
    order = "PARTITION BY repo_id ORDER BY analyzer_ord, path, line_no NULLS FIRST, rule_id, finding_id"
    tab = "chr(9)"
    place = (f"lpad(analyzer_ord::VARCHAR,3,'0')||{tab}||path||{tab}||lpad(coalesce(line_no,0)::VARCHAR,9,'0')||{tab}||rule_id"
             f"||{tab}||finding_id")
    score_rows = f"""(
        SELECT repo_id, ord, '- '||category||': '||{tenths('score_tenths')}||' ('||({shade})||'), '||issue_count||' findings'
          ||(CASE WHEN critical_count>0 THEN ', '||critical_count||' critical' ELSE '' END)||'. '||({words})||'.' AS line FROM cats
        UNION ALL
        SELECT repo_id, 99, '- Together: '||{tenths('overall_tenths')}||', grade '||grade||', '||total_issues||' findings, '
          ||critical_issues||' critical' FROM cards)"""
    return " UNION ALL ".join([
        _section(0, "(SELECT c.*, s.summary, a.total_files, a.python_files, a.total_loc FROM cards c "
                    "JOIN summary s ON c.repo_id=s.repo_id JOIN agg a ON c.repo_id=a.repo_id)", [
            "'# Audit of '||repo_name", "'Scanned on 2024-01-31 at 12:05 UTC.'",
            "total_files||' files, '||python_files||' of them Python; '||total_loc||' lines.'", "''", "summary"]),
        _section(1, score_rows, ["line"], "ord", title="Scores"),
        _section(2, f"(SELECT *, row_number() OVER ({order}) AS n FROM findings WHERE severity IN ('CRITICAL','HIGH'))", [
            "n||'. '||title||' ('||lower(severity)||', '||category||')'",
            f"'   in '||path||coalesce(':'||line_no, '')||', '||{sure}",
            f"CASE WHEN coalesce(code_snippet,'')<>'' THEN '       '||replace(code_snippet, {NL}, {NL}||'       ') END",
            "'   '||risk_explanation", "'   To do: '||recommendation"], "n", title="To fix first"),
        _section(3, "(SELECT * FROM findings WHERE category='ML Engineering' OR starts_with(rule_id,'ML-'))", [
            "'- '||path||': '||title", "'  '||risk_explanation||' '||recommendation"], place=place, title="Learning code"),
        _section(4, "results", [
            "'- '||path||': '||(CASE WHEN overall_status='PASSED' THEN 'verified' ELSE 'rejected' END)||', '"
            "||(CASE WHEN syntax_check THEN 'compiles' ELSE 'does not compile' END)||', tests '||tests_passed_before||' passed and '"
            "||tests_failed_before||' failed before, '||tests_passed_after||' passed and '||tests_failed_after||' failed after ('"
            f"||patch_id||', '||{sure}||')'"], place="patch_id", title="Checked patches"),
    ])


def _timeline_lines() -> str:
    return _section(5, "tl", [
        f"'- '||version||' of '||strftime(ts,'%Y-%m-%d %H:%M')||': '||{tenths('overall_tenths')}||' with '||total_issues"
        "||' findings, '||fixes_applied||' fixes applied. '||description"], "version_no", title="History")


def _finals() -> dict[str, str]:
    s: dict[str, str] = {}
    for rule in model.RULE_IDS:
        s["rule_" + rule.lower().replace("-", "_")] = f"SELECT {FCOLS} FROM findings WHERE rule_id={quote(rule)}"
    s["s1_list_tree"] = """
        SELECT repo_id, path, FALSE AS is_dir, 1::BIGINT AS n_files, size_bytes AS total_bytes,
          (len(string_split(path, '/'))-1)::INT AS depth FROM files
        UNION ALL SELECT repo_id, path, TRUE, count(*), sum(size_bytes)::BIGINT, (len(string_split(path, '/'))-1)::INT FROM (
          SELECT repo_id, array_to_string(parts[1:k], '/') AS path, size_bytes FROM (
            SELECT repo_id, size_bytes, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS k
            FROM files)) GROUP BY repo_id, path"""
    s["s1_load_trees"] = "SELECT repo_name, path, is_python, loc, md5(content) AS digest FROM files"
    s["s2_skip_rules"] = "SELECT repo_id, path, size_bytes FROM files"
    s["s2_skip_rules_all_dot_dirs"] = "SELECT repo_id, path, size_bytes FROM kept_strict"
    ignored = (f"len(list_filter(string_split(dir,'/'), lambda d: (d IN {names(model.IGNORE_DIRS)} OR starts_with(d, '.'))"
               " AND d <> '.github')) > 0")
    s["s2_skipped_files"] = f"""
        SELECT * FROM (SELECT repo_id, path, size_bytes, CASE WHEN {ignored} THEN 'ignored directory'
          WHEN lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) IN {names(model.IGNORE_EXTENSIONS)} THEN 'ignored extension'
          WHEN size_bytes > 4000 THEN 'too large' END AS reason FROM sized) WHERE reason IS NOT NULL"""
    s["s3_decode"] = "SELECT repo_id, repo_name, path, is_python, loc, md5(content) AS digest FROM files"
    s["s4_lookup"] = """
        SELECT w.repo_id, w.path, f.path IS NOT NULL AS found, f.loc FROM (
          SELECT repo_id, unnest(['README.md','Dockerfile']) AS path FROM repos) w
        LEFT JOIN files f ON f.repo_id=w.repo_id AND f.path=w.path"""
    zero = "TRUE, 0, 0, 0, 0, 0, 0"
    one_import = "TRUE, 0, 0, 1, 0, 0, 0"
    s["s5_fact_counts"] = (
        _per_template("t, parse_ok, n_calls, n_scopes, n_imports, n_defs, n_handlers, n_fstrings", FACT_COUNTS,
                      "parse_ok, n_calls, n_scopes, n_imports, n_defs, n_handlers, n_fstrings")
        + f" UNION ALL SELECT repo_id, path, {zero} FROM files WHERE ends_with(path,'/__init__.py')"
        + " UNION ALL " + _cyclic(one_import, one_import))
    s["s5_stored_facts"] = s["s5_fact_counts"]
    s["s5_parsed_once"] = (
        "SELECT 'first' AS scan, count(DISTINCT content)::BIGINT AS parsed FROM files WHERE ends_with(path, '.py')"
        " UNION ALL SELECT 'again', 0 UNION ALL SELECT 'moved', 0")
    s["s5_defs"] = _per_template(
        "t, name, line, has_docstring, typed_args, typed_return, mutable_defaults, complexity, asserts_or_calls", DEFS,
        "'function' AS kind, name, line, has_docstring, typed_args, typed_return, mutable_defaults, complexity, asserts_or_calls")
    s["s5_calls"] = _per_template(
        "t, call_id, line, span, func_kind, func_name, recv_name, n_args, arg0_src, call_src, keywords", CALLS,
        "call_id, line, span, func_kind, func_name, recv_name, n_args, arg0_src, call_src, keywords")
    s["s5_imports"] = (
        _per_template("t, line, kind, module, names, src", IMPORTS, "line, kind, module, 0 AS level, names, src")
        + " UNION ALL " + _cyclic("1, 'import', NULL, 0, 'beta', 'import beta'",
                                  "1, 'from', 'alpha', 0, 'x', 'from alpha import x'"))
    s["s5_scope_calls"] = _per_template(
        "t, scope_kind, scope_line, uses_pipeline, line, func_name, item_idx, in_body", SCOPE_CALLS,
        "scope_kind, scope_line, uses_pipeline::BOOLEAN AS uses_pipeline, line, func_name, item_idx, in_body")
    s["s6_python_files"] = "SELECT repo_id, path, loc FROM py"
    s["k1_append_snapshots"] = "SELECT repo_id, snapshot_id, overall_tenths, total_issues, fixes_applied FROM snap"
    s["k1_compacted_log"] = """
        SELECT repo_id, snapshot_id, 'part-'||(snapshot_id%8) AS scan_id, overall_tenths,
          CASE WHEN snapshot_id%50<>0 THEN overall_tenths::DOUBLE END AS security FROM snap"""
    s["k1_card_timeline"] = "SELECT repo_id, 'v1' AS version, overall_tenths, total_issues, 8 AS n_scores FROM cards"
    s["k2_read_timeline"] = """
        SELECT repo_id, snapshot_id, (CASE WHEN snapshot_id%50=0 THEN 0 ELSE 1 END) AS n_scores,
          CASE WHEN snapshot_id%50<>0 THEN overall_tenths::DOUBLE END AS security FROM snap"""
    s["k3_diagnosis_json"] = """
        SELECT repo_id, 'finding' AS section, finding_id AS key, title, NULL AS grade, NULL::BIGINT AS total_loc FROM findings
        UNION ALL SELECT c.repo_id, 'scorecard', c.repo_name, NULL, c.grade, a.total_loc FROM cards c JOIN agg a ON c.repo_id=a.repo_id
        UNION ALL SELECT repo_id, 'validation', patch_id, NULL, NULL, NULL FROM results
        UNION ALL SELECT repo_id, 'patch', finding_id, NULL, NULL, NULL FROM patches
        UNION ALL SELECT repo_id, 'timeline', version, NULL, NULL, NULL FROM tl"""
    s["k3_findings_json"] = f"SELECT {FCOLS} FROM findings"
    s["k3_scorecards_json"] = """
        SELECT c.repo_id, c.repo_name, overall_score, grade, total_issues, critical_issues, high_issues, medium_issues, low_issues,
          s.summary, total_files, python_files, total_loc
        FROM cards c JOIN summary s ON c.repo_id=s.repo_id JOIN agg a ON c.repo_id=a.repo_id"""
    s["k3_validation_json"] = """
        SELECT patch_id, path, overall_status, syntax_check, import_check, tests_passed_before, tests_failed_before,
          tests_passed_after, tests_failed_after, confidence, steps FROM results"""
    s["k3_patches_json"] = """
        SELECT p.repo_id, p.finding_id, p.rule_id, p.path, p.description,
          md5(coalesce(c.replacement_code, a.replacement_code)) AS text_digest
        FROM patches p LEFT JOIN created c ON c.finding_id=p.finding_id LEFT JOIN accepted a ON a.finding_id=p.finding_id"""
    s["k3_timeline_json"] = """
        SELECT repo_id, snapshot_id, version, overall_tenths, previous_tenths, delta_tenths, total_issues, fixes_applied,
          description FROM tl"""
    s["k4_report_lines"] = _report()
    s["k4_report_timeline"] = _timeline_lines()
    s["k5_counters"] = "SELECT repo_id, total_files, python_files, total_loc FROM agg"

    s["p1_search"] = """
        SELECT finding_id, rule_id, repo_id, path FROM findings WHERE severity IN ('CRITICAL','HIGH','MEDIUM')
          AND category IN ('Security','Testing','Documentation','CI/CD') AND (contains(lower(title),'test')
            OR contains(lower(path),'test') OR contains(lower(risk_explanation),'test'))"""
    s["p2_urgent"] = "SELECT finding_id, severity FROM findings WHERE severity IN ('CRITICAL','HIGH')"
    s["p3_ml_related"] = ("SELECT finding_id, rule_id, category FROM findings "
                          "WHERE category='ML Engineering' OR starts_with(rule_id,'ML-')")
    s["p4_fixable"] = "SELECT finding_id, rule_id FROM findings WHERE auto_fixable"
    s["p5_bands"] = """
        SELECT repo_id, category, score_tenths, CASE WHEN score_tenths>=85 THEN 'green' WHEN score_tenths>=65 THEN 'yellow'
          ELSE 'red' END AS band FROM cats"""
    s["p6_snippets"] = f"""
        SELECT f.finding_id, f.line_no AS start_line, f.line_no+2 AS end_line,
          coalesce(string_agg(l.text, {NL} ORDER BY l.line_no), '') AS snippet
        FROM findings f JOIN files x ON f.repo_id=x.repo_id AND f.path=x.path
          LEFT JOIN file_lines l ON f.repo_id=l.repo_id AND f.path=l.path AND l.line_no BETWEEN f.line_no AND f.line_no+2
        WHERE f.line_no IS NOT NULL GROUP BY f.finding_id, f.line_no"""
    s["p6b_badges"] = f"""
        SELECT repo_id, {tenths('overall_tenths')} AS score_text, colour,
          '![Health Score](https://img.shields.io/badge/health-'||{tenths('overall_tenths')}||'%2F10-'||colour||')' AS badge
        FROM (SELECT *, CASE WHEN overall_tenths>=85 THEN 'brightgreen' WHEN overall_tenths>=65 THEN 'yellow' ELSE 'red' END
              AS colour FROM cards)"""
    s["v1_range_checks"] = """
        SELECT 'finding.confidence' AS check_name, count(*) AS rows_checked,
          count(*) FILTER (confidence<0 OR confidence>1) AS violations FROM findings
        UNION ALL SELECT 'scorecard.overall', count(*), count(*) FILTER (overall_tenths NOT BETWEEN 0 AND 100) FROM cards
        UNION ALL SELECT 'category.score', count(*), count(*) FILTER (score_tenths NOT BETWEEN 0 AND 100) FROM cats"""

    s["j1_files_present"] = f"SELECT DISTINCT repo_id FROM files WHERE path IN {names(model.MANIFESTS)}"
    s["j1_files_absent"] = ("SELECT repo_id FROM repos r WHERE NOT EXISTS (SELECT 1 FROM files f "
                            f"WHERE f.repo_id=r.repo_id AND f.path IN {names(model.LICENSES)})")
    s["j2_missing_init"] = "SELECT repo_id, dir||'/__init__.py' AS path FROM bare_dirs"
    s["j3_import_edges"] = """
        SELECT repo_id, 'alpha' AS src_stem, 'beta' AS dst_stem FROM repos WHERE repo_id%3=1
        UNION ALL SELECT repo_id, 'beta', 'alpha' FROM repos WHERE repo_id%3=1"""
    s["j4_mutual_imports"] = "SELECT repo_id, 'alpha' AS stem_a, 'beta' AS stem_b FROM repos WHERE repo_id%3=1"
    s["j5_fits_above_splits"] = """
        SELECT m.repo_id, m.path, v.scope_line, 7 AS fit_line, 8 AS split_line, '8-7:26' AS span
        FROM mods m, (VALUES (1), (5)) v(scope_line) WHERE m.t=8"""
    s["j6_requirement_pins"] = """
        SELECT repo_id, line_no, pkg, coalesce(substitute, pinned) AS pin FROM dep WHERE loose OR substitute IS NOT NULL"""
    s["j7_secret_lines"] = "SELECT repo_id, path, line_no, label AS pattern FROM secret_hit"
    s["j8_proposals"] = "SELECT finding_id, repo_id, path, root_cause FROM accepted"
    s["j9_patch_results"] = "SELECT patch_id AS finding_id, description, overall_status FROM results"
    s["j10_selected_patches"] = f"""
        SELECT repo_id, path, count(*) AS patches_applied FROM results
        WHERE overall_status='PASSED' AND {digit('patch_id')}%2=0 GROUP BY repo_id, path"""
    s["j11_compare_scores"] = """
        SELECT b.repo_id, b.overall_tenths AS score_before, b.total_issues AS issues_before, a.overall_tenths AS score_after,
          a.total_issues AS issues_after, a.overall_tenths-b.overall_tenths AS score_change, a.total_issues-b.total_issues AS issue_change
        FROM cards b JOIN cards_after a ON a.repo_id=b.repo_id"""
    s["j11_compare_findings"] = """
        SELECT coalesce(b.finding_id,a.finding_id) AS finding_id, coalesce(b.repo_id,a.repo_id) AS repo_id,
          coalesce(b.rule_id,a.rule_id) AS rule_id,
          CASE WHEN a.finding_id IS NULL THEN 'resolved' WHEN b.finding_id IS NULL THEN 'new' ELSE 'remaining' END AS state
        FROM findings b FULL OUTER JOIN findings_after a ON a.finding_id=b.finding_id"""
    s["j11_changed_files"] = """
        SELECT r.repo_id, r.path, CASE WHEN f.path IS NULL THEN 'added' ELSE 'modified' END AS change
        FROM rebuilt r LEFT JOIN files f ON f.repo_id=r.repo_id AND f.path=r.path"""

    s["j11_version_changes"] = s["j11_changed_files"]
    s["j11_rescan_versions"] = """
        SELECT repo_id, 0 AS version, count(*) AS rows_read, count(*) AS rows_written FROM files GROUP BY repo_id
        UNION ALL
        SELECT repo_id, 1, sum(n_before)+sum(added), sum(written) FROM (
          SELECT repo_id, 1 AS n_before, 0 AS added, 0 AS written FROM files
          UNION ALL
          SELECT r.repo_id, 0, (f.path IS NULL)::INT, 1 FROM rebuilt r LEFT JOIN files f ON f.repo_id=r.repo_id AND f.path=r.path
        ) GROUP BY repo_id"""

    s["a1_category_counts"] = "SELECT repo_id, category, ord, issue_count FROM cats"
    s["a2_category_scores"] = "SELECT repo_id, category, score_tenths/10 AS score FROM cats"
    s["a3_category_words"] = """
        SELECT repo_id, category, CASE WHEN score_tenths>=90 THEN 'Excellent health' WHEN score_tenths>=70
          THEN 'Minor issues found' ELSE 'Needs immediate attention' END AS summary FROM cats"""
    s["a4_overall"] = "SELECT repo_id, overall_tenths, overall_score FROM cards"
    s["a5_severity_counts"] = """
        SELECT repo_id, total_issues, critical_issues, high_issues, medium_issues, low_issues,
          critical_issues AS critical_by_category FROM cards"""
    s["a6_grades"] = "SELECT repo_id, grade FROM cards"
    s["a7_score_map"] = "SELECT repo_id, category, score_tenths/10 AS score FROM cats"
    s["a7_radar"] = "SELECT repo_id, " + ", ".join(
        f"max(score_tenths/10) FILTER (category={quote(c)}) AS {c.lower().replace(' ', '_').replace('/', '_')}"
        for c in model.CATEGORIES) + " FROM cats GROUP BY repo_id"
    s["a8_summaries"] = "SELECT repo_id, repo_name, summary FROM summary"
    s["a9_test_ratio"] = "SELECT repo_id, test_files, test_loc, source_loc FROM agg"
    s["a10_docstring_coverage"] = ("SELECT repo_id, documented AS documented_defs, pub AS public_defs, test_loc, source_loc "
                                   "FROM agg")
    s["a10_typing_coverage"] = _per_template("t, functions, typed", TYPED, "functions, typed")
    s["a11_directories"] = "SELECT repo_id, dir FROM dirs"
    flags = ", ".join(f"{c}=1 AS {c}" for c in ("splits", "cv", "classifier", "accuracy", "robust"))
    none = "FALSE, FALSE, FALSE, FALSE, FALSE"
    s["a12_import_flags"] = _per_template("t, splits, cv, classifier, accuracy, robust", FLAGS, flags) + (
        " UNION ALL " + _cyclic(none, none))
    s["a13_verdict_counts"] = """
        SELECT repo_id, count(*) FILTER (overall_status='PASSED') AS verified, count(*) AS patches,
          count(DISTINCT path) FILTER (overall_status='PASSED') AS files_touched FROM results GROUP BY repo_id"""

    s["w1_versions"] = "SELECT repo_id, snapshot_id, version FROM tl"
    s["w2_changes"] = "SELECT repo_id, snapshot_id, previous_tenths, delta_tenths, description FROM tl"
    s["w3_trajectory"] = f"""
        SELECT *, latest_tenths-first_tenths AS delta_tenths, (CASE WHEN latest_tenths>=first_tenths THEN '+' ELSE '' END)
          ||{tenths('(latest_tenths-first_tenths)')} AS delta_text
        FROM (SELECT repo_id, arg_min(overall_tenths, version_no) AS first_tenths, arg_max(overall_tenths, version_no)
              AS latest_tenths, count(*) AS versions FROM tl GROUP BY repo_id)"""
    s["w4_numbering"] = """
        SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY analyzer_ord, path, line_no NULLS FIRST, rule_id, finding_id)
          AS item_no, finding_id FROM findings WHERE severity IN ('CRITICAL','HIGH')"""
    s["w5_source_lines"] = "SELECT repo_id, path, line_no::INT AS line_no, text FROM file_lines"
    s["t1_timeline_order"] = "SELECT repo_id, snapshot_id, ts, overall_tenths FROM snap ORDER BY repo_id, ts, snapshot_id"
    s["t2_first_findings"] = "SELECT repo_id, ra::INT AS rank, finding_id FROM ranked WHERE ra<=6"
    s["t3_first_urgent"] = """
        SELECT repo_id, max(finding_id) FILTER (severity='CRITICAL' AND rs=1) AS critical_id,
          max(finding_id) FILTER (severity='HIGH' AND rs=1) AS high_id FROM ranked GROUP BY repo_id"""
    s["t4_first_from_line"] = """
        SELECT repo_id, path, text AS docker_from FROM file_lines WHERE path='Dockerfile' AND contains(text,'FROM')
          AND contains(text,'latest') AND line_no=1"""
    s["t5_truncation"] = "SELECT repo_id, path, substr(content,1,100) AS head FROM files"

    s["u1_all_findings"] = f"SELECT {FCOLS} FROM findings"
    s["u2_introduced"] = """
        SELECT finding_id, CASE WHEN kind=1 THEN 'socket' ELSE '' END AS modules,
          CASE WHEN vulnerabilities='' THEN 0 ELSE len(string_split(vulnerabilities,'; ')) END AS n_vulnerabilities FROM trials"""
    s["u3_missing_items"] = "SELECT repo_id, missing FROM gaps"
    s["u4_test_split"] = "SELECT repo_id, path, contains(lower(path),'test') AS is_test FROM py"

    s["r1_created_files"] = "SELECT repo_id, path, finding_id, description, replacement_code FROM created"
    s["r2_requirements"] = _edit("DEP-UNPIN", "DEP-DEPR")
    s["r3_fit_below_split"] = _edit("ML-LEAK-PREFIT")
    s["r4_random_state"] = _edit("ML-VAL-NOSEED")
    s["r5_stratify"] = _edit("ML-MET-NOSTRAT")
    s["r6_exception_log"] = _edit("QUAL-EXC")
    s["r7_mutable_default"] = _edit("QUAL-MUT")
    s["r8_safe_load"] = _edit("SEC-YAML")
    s["r9_literal_eval"] = _edit("SEC-EXEC")
    dispatch = [
        ("DEP-DEPR", "replace requirement"), ("DEP-UNPIN", "replace requirement"),
        ("ML-LEAK-PREFIT", "move fit below split"), ("ML-VAL-NOSEED", "add random_state"),
        ("ML-MET-NOSTRAT", "add stratify"), ("QUAL-EXC", "log exception"), ("QUAL-MUT", "default to None"),
        ("SEC-YAML", "safe_load"), ("SEC-EXEC", "literal_eval"), ("ARCH-INIT", "create file"),
        ("DOC-NOREADME", "create file"), ("DOC-NOLICENSE", "create file"), ("CICD-NOWORKFLOWS", "create file"),
        ("DEPLOY-NODOCKER", "create file"), ("DEPLOY-NOGITIGNORE", "create file"),
    ]
    s["r10_dispatch"] = f"""
        SELECT f.finding_id, f.rule_id, d.edit, p.finding_id IS NOT NULL AS has_patch FROM findings f
          LEFT JOIN {values(dispatch)} d(rule_id, edit) ON f.rule_id=d.rule_id
          LEFT JOIN patches p ON f.finding_id=p.finding_id WHERE f.auto_fixable"""
    s["r11_proposal_override"] = """
        SELECT p.finding_id, p.path, p.description, md5(a.replacement_code) AS digest
        FROM patches p JOIN accepted a ON p.finding_id=a.finding_id"""
    s["r12_rebuilt_files"] = "SELECT repo_id, path, md5(content) AS digest FROM rebuilt"

    k = digit("finding_id")
    s["r12_superseded"] = f"""
        SELECT f.repo_id, f.path, f.finding_id, w.superseded_by FROM findings f JOIN (
          SELECT repo_id, path, min(finding_id) AS superseded_by FROM findings WHERE rule_id='QUAL-MUT' GROUP BY repo_id, path) w
          ON f.repo_id=w.repo_id AND f.path=w.path AND f.finding_id<>w.superseded_by
        WHERE f.rule_id='QUAL-MUT' AND {k} NOT IN (1,2,3) AND {digit('superseded_by')} NOT IN (1,2,3)"""
    s["g1_path_check"] = "SELECT finding_id, path, kind=4 AS unsafe FROM trials"
    s["g2_size_check"] = "SELECT finding_id, old_lines, new_lines, expands, adds_too_much FROM trials"
    s["g3_parse_check"] = "SELECT finding_id, parse_ok, compile_ok FROM trials"
    s["g4_features"] = "SELECT finding_id, old_modules, old_calls, new_modules, new_calls FROM trials"
    s["g5_decisions"] = """
        SELECT finding_id, n_reasons=0 AS passed, n_reasons, vulnerabilities, new_lines-old_lines AS diff_line_change FROM decisions"""
    k = digit("finding_id")
    s["g6_test_counts"] = f"""
        SELECT finding_id, 'before' AS phase, CASE WHEN {k}=0 THEN 2 ELSE 3 END AS passed, CASE WHEN {k}=0 THEN 1 ELSE 0 END AS failed,
          0 AS errors, {k}<>0 AS success FROM trials
        UNION ALL SELECT finding_id, 'after', CASE WHEN {k} IN (1,2) THEN 2 WHEN {k}=3 THEN 0 ELSE 3 END,
          CASE WHEN {k} IN (1,2) THEN 1 ELSE 0 END, CASE WHEN {k}=3 THEN 1 ELSE 0 END, {k} NOT IN (1,2,3) FROM trials"""
    ok, compiled = "n_reasons=0", "coalesce(compile_ok,TRUE)"
    tested = f"({compiled} AND {k} NOT IN (1,2,3))"
    s["g7_trial_verdicts"] = f"""
        SELECT finding_id AS patch_id, path, CASE WHEN {ok} AND {tested} THEN 'PASSED' ELSE 'FAILED' END AS overall_status,
          {ok} AND {compiled} AS syntax_check, {ok} AND {tested} AS import_check,
          CASE WHEN NOT {ok} THEN 0 WHEN {k}=0 THEN 2 ELSE 3 END AS tests_passed_before,
          CASE WHEN {ok} AND {k}=0 THEN 1 ELSE 0 END AS tests_failed_before,
          CASE WHEN NOT {ok} OR NOT {compiled} THEN 0 WHEN {k} IN (1,2) THEN 2 WHEN {k}=3 THEN 0 ELSE 3 END AS tests_passed_after,
          CASE WHEN NOT {ok} THEN 0 WHEN NOT {compiled} THEN 1 WHEN {k} IN (1,2) THEN 1 ELSE 0 END AS tests_failed_after,
          (CASE WHEN NOT {ok} THEN 0.0 WHEN {tested} THEN 0.99 ELSE 0.2 END)::DOUBLE AS confidence,
          CASE WHEN NOT {ok} THEN 'Security Gate Validation=FAILED' ELSE
            'Security Gate Validation=PASSED;Baseline Test Execution='||(CASE WHEN {k}=0 THEN 'WARNING' ELSE 'PASSED' END)
            ||';Patch Application=PASSED;Syntax Verification='||(CASE WHEN {compiled} THEN 'PASSED' ELSE 'FAILED' END)
            ||';Post-Patch Test Execution='||(CASE WHEN {tested} THEN 'PASSED' ELSE 'FAILED' END) END AS steps
        FROM decisions"""
    s["g7_verdicts"] = """
        SELECT patch_id, path, overall_status, syntax_check, import_check, tests_passed_before, tests_failed_before,
          tests_passed_after, tests_failed_after, confidence, steps FROM results"""
    s["g8_compile_report"] = """
        SELECT repo_id, path, 'mod_'||doc_id||'.py:1 - invalid syntax' AS message FROM mods WHERE t=16
        UNION ALL SELECT repo_id, NULL, 'All Python files compiled successfully.' FROM repos r
          WHERE NOT EXISTS (SELECT 1 FROM mods m WHERE m.repo_id=r.repo_id AND m.t=16)"""

    s["f1_split_lines"] = f"""
        SELECT doc_id, len(l) AS n_lines, len(l) AS counted, l[1] AS first_line, l[-1] AS last_line FROM (
          SELECT doc_id, CASE WHEN text='' THEN []::VARCHAR[] WHEN ends_with(text,{NL}) THEN string_split(text,{NL})[:-2]
            ELSE string_split(text,{NL}) END AS l FROM documents)"""
    s["f2_text"] = r"""
        SELECT doc_id, length(regexp_replace(text,'^\s+|\s+$','','g')) AS stripped, contains(lower(text),'the ') AS has_the,
          starts_with(text,'A') AS starts, ends_with(text,'.') AS ends, length(replace(text,'e','')) AS without_e FROM documents"""
    s["f3_regex"] = """
        SELECT doc_id, regexp_matches(text,'[0-9]{3,}') AS has_number,
          regexp_extract(text,'([A-Z][a-z]+) ([a-z]+)',2) AS second_word,
          length(regexp_replace(text,'[0-9]+','#','g')) AS masked_length FROM documents"""
    s["f4_paths"] = r"""
        SELECT repo_id, path, dir, CASE WHEN regexp_matches(base,'^.+\.[^.]+$') THEN regexp_extract(base,'^(.+)\.[^.]+$',1)
            ELSE base END AS stem,
          regexp_extract(base,'^.+(\.[^.]+)$',1) AS suffix, string_split(replace(path,'/','.'),'.')[1] AS "first" FROM files"""
    s["f5_numbers"] = f"""
        SELECT event_id, greatest(10, least(100, floor(value)::BIGINT)) AS clamped,
          {percent('event_id%97', '1+event_id%89')} AS share, {tenths('(event_id%200-100)')} AS tenths FROM events"""
    s["f6_json"] = """
        SELECT event_id, '{"a":'||(event_id%7)||',"b":'||(event_id%3)||'}' AS encoded, event_id%3 AS decoded_b FROM events"""
    s["f7_time"] = """
        SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M') AS minute, strftime(ts,'%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events"""
    s["f8_ids"] = "SELECT doc_id, 'DOC-'||substr(sha256(doc_id||'|'||text),1,16) AS id FROM documents"
    s["f9_name_lists"] = "SELECT doc_id, array_to_string(list_sort([source, lang]), ', ') AS names FROM documents"
    s["f10_last_paren"] = f"""
        SELECT doc_id, (n-1)::INT AS pos, regexp_extract(l[n], '^.*\\)([^)]*)$', 1) AS tail FROM (
          SELECT doc_id, l, unnest(generate_series(1, len(l))) AS n FROM (
            SELECT doc_id, string_split(text,{NL}) AS l FROM documents)) WHERE contains(l[n], ')')"""
    # Template 18 is the only one that prints: once, in its second test.
    own = """
        SELECT 'OWN-PRINT' AS rule_id, repo_id, 'Code Quality' AS category, 'LOW' AS severity, path, 0.7::DOUBLE AS confidence,
          'Prints 1 times.' AS risk_explanation FROM mods WHERE t=18
        UNION ALL SELECT 'OWN-TESTHEAVY', repo_id, 'Testing', 'MEDIUM', first_test, 0.6::DOUBLE, 'More tests than code.'
          FROM agg WHERE first_test IS NOT NULL
        UNION ALL SELECT rule_id, repo_id, category, severity, path, confidence, risk_explanation FROM findings
          WHERE rule_id='TEST-NOTESTS'"""
    s["u5_user_rules"] = own
    s["u5_user_rule_scores"] = """
        SELECT a.repo_id, c.category, CASE c.category WHEN 'Code Quality' THEN coalesce(p.n, 0)
            WHEN 'Testing' THEN (a.first_test IS NOT NULL)::BIGINT + coalesce(m.n, 0) ELSE 0 END AS issue_count
        FROM agg a CROSS JOIN (SELECT DISTINCT category FROM rule_dim) c
        LEFT JOIN (SELECT repo_id, count(*) AS n FROM mods WHERE t=18 GROUP BY repo_id) p ON p.repo_id=a.repo_id
        LEFT JOIN (SELECT repo_id, count(*) AS n FROM findings WHERE rule_id='TEST-NOTESTS' GROUP BY repo_id) m
          ON m.repo_id=a.repo_id"""
    gram = r"""list_distinct([array_to_string(w[i:i+7], ' ') FOR i IN range(1, len(w) - 6)])"""
    words = r"""string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w"""
    s["d1_contamination"] = f"""
        SELECT doc_id, count(k.g) AS matched, count(*) AS total FROM (
          SELECT doc_id, unnest({gram}) AS g FROM (SELECT doc_id, {words} FROM documents)) d
        LEFT JOIN (SELECT DISTINCT unnest({gram}) AS g FROM (SELECT {words} FROM benchmark)) k ON d.g = k.g GROUP BY doc_id"""
    part = "CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'valid' ELSE 'test' END AS split"
    at = "(('0x'||substr(md5({}), 1, 8))::BIGINT % {})::INT"
    s["d2_hash_split"] = f"""
        SELECT *, {part} FROM (SELECT doc_id, {at.format('doc_id::VARCHAR', 100)} AS bucket FROM documents)"""
    strata = """
        SELECT doc_id, quality, toxic, CASE WHEN r * 100 <= n * 20 THEN 'test' ELSE 'train' END AS split FROM (
          SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS r,
            count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels)"""
    s["d3_stratified_split"] = strata
    s["d3_share_drift"] = f"""
        SELECT *, abs(train_share - test_share) AS drift FROM (
          SELECT quality, toxic, train, test, train * 100.0::DOUBLE / sum(train) OVER () AS train_share,
            test * 100.0::DOUBLE / sum(test) OVER () AS test_share FROM (
            SELECT quality, toxic, count(*) FILTER (WHERE split='train') AS train,
              count(*) FILTER (WHERE split='test') AS test FROM ({strata}) GROUP BY ALL))"""
    s["d4_standardised"] = f"""
        WITH b AS (SELECT *, {at.format('l_orderkey::VARCHAR', 100)} AS bucket FROM lineitem),
        x AS (SELECT l_orderkey, l_linenumber, {part}, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS name,
          unnest([round(l_quantity*100)::BIGINT, round(l_extendedprice*100)::BIGINT, round(l_discount*100)::BIGINT]) AS v FROM b),
        t AS (SELECT name, count(*)::DOUBLE AS n, sum(v)::DOUBLE AS s, sum(v::HUGEINT*v)::DOUBLE AS ss FROM x
          WHERE split='train' GROUP BY name)
        SELECT l_orderkey, l_linenumber, split, name, round((v::DOUBLE - s/n) / nullif(sqrt((n*ss - s*s)/(n*n)), 0), 6) AS z
        FROM x JOIN t USING (name)"""
    s["d5_folds"] = f"""SELECT doc_id, {at.format("'fold:'||doc_id", 5)} AS fold FROM labels"""
    s["d6_class_metrics"] = """
        SELECT class, tp, fp, fn, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) END AS "precision",
          CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) END AS recall,
          CASE WHEN 2*tp+fp+fn>0 THEN (2*tp)::DOUBLE/(2*tp+fp+fn) END AS f1, "right"::DOUBLE/n AS accuracy FROM (
          SELECT class, count(*) FILTER (WHERE t=class AND p=class) AS tp, count(*) FILTER (WHERE t<>class AND p=class) AS fp,
            count(*) FILTER (WHERE t=class AND p<>class) AS fn, count(*) FILTER (WHERE t=p) AS "right", count(*) AS n
          FROM (SELECT 1-quality AS t, toxic AS p, unnest([0, 1]) AS class FROM labels) GROUP BY class)"""
    # The source's patterns typed out once more, and the query's own one.
    secrets = {
        "Hardcoded Secret / API Token":
            r"""(?i)(api_key|apikey|secret_key|auth_token|access_token|aws_secret_access_key|password)\s*=\s*['"][a-zA-Z0-9_.-]{12,}['"]""",
        "Exposed GitHub Personal Access Token": "ghp_[a-zA-Z0-9]{36}",
        "Exposed OpenAI Secret Key": "sk-[a-zA-Z0-9]{32,48}",
        "Exposed AWS Access Key ID": "AKIA[0-9A-Z]{16}",
        "Quoted Token": 'token = "[0-9a-f]{40}"',
    }
    s["d7_text_secrets"] = " UNION ALL ".join(f"""
        SELECT doc_id, n::INT AS line_no, {quote(name)} AS pattern,
          substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 80) AS snippet
        FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (
          SELECT doc_id, string_split(text, {NL}) AS l FROM documents))
        WHERE regexp_matches(line, {quote(pattern)})""" for name, pattern in secrets.items())
    s["st1_scan_arrivals"] = f"SELECT {FCOLS} FROM findings"
    s["st2_snapshot_stream"] = "SELECT repo_id, snapshot_id, version, description FROM tl"
    s["st2_late_rows"] = """
        SELECT user_id::BIGINT AS repo_id, event_id AS snapshot_id FROM events WHERE event_id%10=0
          AND ts <= (SELECT max(ts) FROM events WHERE event_id%10<>0) - INTERVAL 1 DAY"""
    s["st2_outcomes"] = """
        WITH e AS (SELECT user_id::BIGINT AS repo_id, event_id AS snapshot_id, ts, event_id%10=0 AS later FROM events),
        m AS (SELECT max(ts) FILTER (WHERE NOT later) AS first_mark, max(ts) AS mark FROM e)
        SELECT repo_id, snapshot_id, 0::BIGINT AS batch_id, 'kept' AS outcome, 1::BIGINT AS copies FROM e WHERE NOT later
        UNION ALL
        SELECT repo_id, snapshot_id, 1, CASE WHEN ts <= first_mark - INTERVAL 1 DAY THEN 'late' ELSE 'kept' END, 1 FROM e, m WHERE later
        UNION ALL
        SELECT repo_id, snapshot_id, 2, CASE WHEN ts <= mark - INTERVAL 1 DAY THEN 'late' ELSE 'repeated' END, 2
        FROM e, m WHERE snapshot_id%7=1"""
    return s


def all_statements() -> dict[str, str]:
    return {name: build(final) for name, final in _finals().items()}
