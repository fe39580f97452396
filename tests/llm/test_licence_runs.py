"""Several licences in one run, full texts and wrapped notices."""

from fleetlint.llm import licenses
from fleetlint.model import MIT_TEXT

MIT = MIT_TEXT.replace("{holder}", "2020 Somebody")


def found(text):
    scanner = licenses.Scanner(licenses.templates())
    return sorted(r[2] for r in scanner.scan(text.encode()) if r[6])


def test_every_licence_of_a_run():
    assert found(MIT + "\nLicensed under the Apache License, Version 2.0.\n") == ["Apache-2.0", "MIT"]
    assert found(MIT + licenses.TEXTS["BSD-3-Clause"]) == ["BSD-3-Clause", "MIT"]
    assert found(MIT * 8) == ["MIT"] * 8


def test_full_texts():
    for spdx, text in licenses.TEXTS.items():
        assert found("Some prose.\n" + text + "More prose.\n") == [spdx]


def test_wrapped_notice():
    assert found("Prose.\nLicensed under the Apache\nLicense, Version 2.0.\nProse.") == ["Apache-2.0"]
