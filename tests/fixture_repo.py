"""A small repository with known mistakes: a gym that wants to know who leaves."""

LEAVERS = '''"""Which gym members are about to leave, judged by their visits."""

import csv

from sklearn.ensemble import GradientBoostingClassifier
from sklearn.metrics import accuracy_score
from sklearn.model_selection import train_test_split
from sklearn.preprocessing import MinMaxScaler


def read_members(path):
    with open(path) as source:
        table = [[float(cell) for cell in line] for line in csv.reader(source)]
    return [line[:-1] for line in table], [line[-1] for line in table]


def share_guessed(path):
    visits, gone = read_members(path)
    scaler = MinMaxScaler()
    visits = scaler.fit_transform(visits)
    seen, unseen, seen_gone, unseen_gone = train_test_split(visits, gone)
    guesser = GradientBoostingClassifier()
    guesser.fit(seen, seen_gone)
    return accuracy_score(unseen_gone, guesser.predict(unseen))
'''

SETTINGS = '''"""Settings of the gym, from a file or the command line."""

import subprocess

import yaml


def from_file(path, extra={}, hidden=[]):
    with open(path) as source:
        found = yaml.load(source)
    found.update(extra)
    return {k: v for k, v in found.items() if k not in hidden}


def from_shell(command):
    try:
        return subprocess.run(command, shell=True, check=True)
    except Exception:
        pass
'''

TESTS = '''from settings import from_file


def test_reads_a_file(tmp_path):
    path = tmp_path / "gym.yml"
    path.write_text("open: 6")
    assert from_file(path) == {"open": 6}


def test_runs():
    pass
'''

FILES = {
    "README.md": "# Gym\n\nWho leaves next month?\n",
    "leavers.py": LEAVERS,
    "settings.py": SETTINGS,
    "requirements.txt": "scikit-learn==1.5.2\nPyYAML\nsklearn\n",
    "tests/test_settings.py": TESTS,
}
