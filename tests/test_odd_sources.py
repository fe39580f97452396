"""Source files that a parser or a writer of source text cannot digest as a whole."""

from fleetlint.operators.facts import extract_facts
from fleetlint.plans.audit import Audit

ODD = {
    "surrogate.py": 'def f(s):\n    x = f"a\\ud800 {s}"\n    return eval(s)\n',
    "number.py": "def f(m):\n    m.fit(0x" + "F" * 6000 + ")\n    return eval('1')\n",
    "deep.py": "def f(s, m, a):\n    m.fit(" + "+".join(["a"] * 5000) + ")\n    return eval(s)\n",
    "broken.py": "def f(:\n",
    "plain.py": "def f(s):\n    return eval(s)\n",
}


def test_other_facts_stay(fleet_of):
    files = fleet_of({"odd": ODD})
    facts = {r.path: r for r in extract_facts(files).collect()}
    assert len(facts) == len(ODD)
    for path in ("surrogate.py", "number.py", "deep.py", "plain.py"):
        assert facts[path].parse_ok
        assert [d.name for d in facts[path].defs] == ["f"]
        assert "eval" in [c.func_name for c in facts[path].calls]
    assert facts["number.py"].fact_errors and facts["deep.py"].fact_errors and not facts["plain.py"].fact_errors
    assert facts["broken.py"].parse_ok is False


def test_findings_of_odd_files(fleet_of):
    found = Audit(fleet_of({"odd": ODD})).findings.where("rule_id = 'SEC-EXEC'").collect()
    assert {r.path for r in found} == {"surrogate.py", "number.py", "deep.py", "plain.py"}
