import random

import pytest

from quillbit.operators.segments import segments

TEXT = set(range(32, 127)) | {9, 10, 13}
LOSSY = {4, 6, 0x13, 0x14, 0x16, 0x1D}


def plain(data):
    """The steps one after the other, over a list of runs."""

    def merge(runs):
        out = []
        for kind, part in runs:
            if out and out[-1][0] == kind:
                out[-1] = (kind, out[-1][1] + part)
            else:
                out.append((kind, part))
        return out

    runs = merge([("T" if b in TEXT else "B", bytes([b])) for b in data])
    runs = merge([("B" if len(p) < 64 else k, p) for k, p in runs])
    n = len(runs)
    runs = merge([("T" if k == "B" and 0 < i < n - 1 and len(p) <= 8 else k, p) for i, (k, p) in enumerate(runs)])
    if len(runs) >= 2:
        runs = merge([("T" if k == "B" and len(p) < 64 and not set(p) & LOSSY else k, p) for k, p in runs])
    out, at = [], 0
    for k, p in runs:
        out.append((k, at, len(p)))
        at += len(p)
    return out


A, NUL = b"A" * 64, bytes([0x80])
CASES = {
    "empty": (b"", []),
    "all text": (A * 2, [("T", 0, 128)]),
    "all binary": (b"\xc3\x28" * 150 + bytes(70), [("B", 0, 300 + 70)]),
    "demote": (NUL * 64 + b"a few words" + b"\x06" * 90, [("B", 0, 165)]),
    "bridge": (A + NUL * 8 + A, [("T", 0, 136)]),
    "no bridge": (A + NUL * 64 + A, [("T", 0, 64), ("B", 64, 64), ("T", 128, 64)]),
    "absorb": (A + NUL * 9 + A, [("T", 0, 137)]),
    "lossy in a bridge": (A + b"\x04" * 8 + A, [("T", 0, 136)]),
    "lossy kept": (A + b"\x04" * 9 + A, [("T", 0, 64), ("B", 64, 9), ("T", 73, 64)]),
    "short text alone": (b"A" * 63, [("B", 0, 63)]),
    "binary first": (NUL * 5 + A, [("T", 0, 69)]),
    "binary last": (A + NUL * 70, [("T", 0, 64), ("B", 64, 70)]),
}


def test_cases_and_random_inputs(spark):
    r = random.Random(3)
    cases = dict(CASES)
    for i in range(150):
        data = b"".join(r.choice([b"x", b"\x80", b"\x06"]) * r.choice([1, 7, 8, 9, 63, 64, 65]) for _ in range(r.randrange(1, 9)))
        cases[f"random {i}"] = (data, plain(data))
    names = list(cases)
    rows = spark.createDataFrame([(i, bytearray(cases[n][0])) for i, n in enumerate(names)], "id long, data binary")
    found = {}
    for row in segments(rows, "id", "data").orderBy("id", "seg_no").collect():
        found.setdefault(names[row.id], []).append((row.kind, row.off, row.len))
    for n, (data, expected) in cases.items():
        assert found.get(n, []) == expected == plain(data), n


@pytest.mark.parametrize("name", CASES)
def test_plain_agrees(name):
    assert plain(CASES[name][0]) == CASES[name][1]
