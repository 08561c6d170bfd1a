"""The library keeps to the rules it states: no localCheckpoint, nothing
collected to the driver, no cross joins, no row-at-a-time Python UDFs."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1] / "govlake"
FORBIDDEN = {
    r"\.localCheckpoint\(": "localCheckpoint",
    r"\.collect\(\)": "collect to the driver",
    r"\.toPandas\(\)": "toPandas to the driver",
    r"\.crossJoin\(": "cross join",
    r"\bF\.udf\(|@udf\b|\.udf\.register\(": "row-at-a-time Python UDF",
    r"\.rdd\b": "RDD API",
}


def core_files():
    # the corpus subpackage states and tests its own rules
    return [p for p in ROOT.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]


def test_library_has_no_forbidden_calls():
    found = []
    for path in core_files():
        for n, line in enumerate(path.read_text().splitlines(), 1):
            code = line.split("#")[0]
            for pattern, what in FORBIDDEN.items():
                if re.search(pattern, code):
                    found.append(f"{path.relative_to(ROOT)}:{n}: {what}")
    assert found == []


def test_hand_broadcasts_are_bounded():
    # every hand broadcast goes through dimensions.bounded_broadcast
    offenders = []
    for path in core_files():
        for n, line in enumerate(path.read_text().splitlines(), 1):
            if "F.broadcast(" in line and not path.name == "dimensions.py":
                offenders.append(f"{path.name}:{n}")
    assert offenders == []
