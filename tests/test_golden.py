"""The fixture repository has one exact expected result."""

from collections import Counter

import pytest
from fixture_repo import FILES

from fleetlint.operators import repair
from fleetlint.plans.audit import Audit
from fleetlint.plans.repair import fixable_rows

BY_CATEGORY = {
    "Architecture": (0, 10.0), "Code Quality": (3, 6.9), "Testing": (1, 9.2), "ML Engineering": (4, 4.4),
    "Security": (2, 7.0), "Documentation": (3, 8.6), "Reproducibility": (4, 6.1), "CI/CD": (3, 6.7),
}


@pytest.fixture(scope="module")
def files(fleet_of):
    return fleet_of({"demo": FILES})


def test_source_scope_mode(files):
    audit = Audit(files, scope_mode="source")
    scores = {r.category: (r.issue_count, r.score) for r in audit.category_scores.collect()}
    assert scores == BY_CATEGORY
    card = audit.scorecards.first()
    assert (card.overall_score, card.grade, card.total_issues) == (7.2, "B", 20)
    assert (card.critical_issues, card.high_issues, card.medium_issues, card.low_issues) == (2, 6, 7, 5)


def test_default_scope_mode_and_places(files):
    audit = Audit(files)
    card = audit.scorecards.first()
    assert (card.overall_score, card.grade, card.total_issues, card.critical_issues) == (7.7, "B", 19, 1)
    places = Counter((r.rule_id, r.path, r.line_no) for r in audit.findings.collect())
    assert places == Counter([
        ("QUAL-EXC", "settings.py", 18), ("QUAL-MUT", "settings.py", 8), ("QUAL-MUT", "settings.py", 8),
        ("SEC-YAML", "settings.py", 10), ("SEC-SHELL", "settings.py", 17),
        ("ML-LEAK-PREFIT", "leavers.py", 20), ("ML-VAL-NOSEED", "leavers.py", 21), ("ML-VAL-NOSEED", "leavers.py", 22),
        ("ML-VAL-NOCV", "leavers.py", 1), ("ML-MET-RAWACC", "leavers.py", 1),
        ("TEST-NOASSERT", "tests/test_settings.py", 10),
        ("DEP-UNPIN", "requirements.txt", 2), ("DEP-DEPR", "requirements.txt", 3),
        ("DOC-SPARSE-README", "README.md", 1), ("DOC-SECTIONS", "README.md", 1), ("DOC-NOLICENSE", "LICENSE", 1),
        ("CICD-NOWORKFLOWS", ".github/workflows/ci.yml", 1), ("DEPLOY-NODOCKER", "Dockerfile", 1),
        ("DEPLOY-NOGITIGNORE", ".gitignore", 1),
    ])
    assert audit.findings.select("finding_id").distinct().count() == 19
    lines = repair.line_patches(repair.patched_files(fixable_rows(files))).collect()
    made = repair.create_patches(audit.findings, audit.repos).collect()
    assert Counter(p.rule_id for p in lines) == Counter(
        {"ML-VAL-NOSEED": 2, "QUAL-MUT": 2, "DEP-UNPIN": 1, "DEP-DEPR": 1, "ML-LEAK-PREFIT": 1, "QUAL-EXC": 1, "SEC-YAML": 1})
    assert len(made) == 4
    gone, fit, moved = next(p for p in lines if p.rule_id == "ML-LEAK-PREFIT").edits
    assert gone.whole and fit.whole and gone.text is None and fit.text is None
    assert "train_test_split(" in moved.spans[0].text and "scaler = MinMaxScaler()" in moved.spans[-1].text


def test_every_rule_has_bounded_values(files):
    rows = Audit(files).category_scores.collect()
    assert len(rows) == 8
    assert all(1.0 <= r.score <= 10.0 for r in rows)
