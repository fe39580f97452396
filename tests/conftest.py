import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlint.session import local_session  # noqa: E402
from fleetlint.sources.files import decode_files, keep_files  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="6g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fleet_of(spark):
    """{repo name: {path: content}} -> source_files; repo_id is the position."""

    def build(repos: dict):
        rows = [
            (k, name, path, content, len(content.encode()))
            for k, (name, files) in enumerate(repos.items()) for path, content in files.items()
        ]
        raw = spark.createDataFrame(
            rows, "repo_id bigint, repo_name string, path string, content string, size_bytes bigint")
        return decode_files(keep_files(raw))

    return build
