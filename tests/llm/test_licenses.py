"""Fuzzy notices against an edit-distance table, and time that grows with the text."""

import random
import time

import pytest

pytest.importorskip("regex")

from tidelane.llm import licenses  # noqa: E402


def least_edits(phrase, words):
    """Fewest edits that make some part of words the phrase."""
    row = [0] * (len(words) + 1)
    for i, c in enumerate(phrase, 1):
        new = [i]
        for j, d in enumerate(words, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def damaged(rng, phrase, edits):
    out = list(phrase)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = rng.choice("xyz") if kind else ""
    return "".join(out).strip()


def test_every_notice_within_its_errors_is_found_and_no_other():
    rng = random.Random(3)
    for phrase, (label, errors) in licenses.NOTICES.items():
        for edits in range(errors + 4):
            words = " ".join(["some words", " ".join(damaged(rng, phrase, edits).split()), "and others"])
            want = {n for k, n in enumerate(licenses.NOTICES) if least_edits(n, words) <= licenses.NOTICES[n][1]}
            got = {list(licenses.NOTICES)[m[4]] for m in licenses.fuzzy(words)}
            assert got == want, (words, got, want)


def test_each_place_has_its_span():
    one = "released undr the mit licence"
    for text, places in ((f"{one} released under the mit license", [0, 5]), (" ".join([one] * 3), [0, 5, 10]), ("relased undr the mit license foo released under the mit license", [0, 6])):
        k = list(licenses.NOTICES).index("released under the mit license")
        assert [m[0] for m in licenses.fuzzy(text) if m[4] == k] == places


def test_time_grows_with_the_text():
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        base, near = licenses.scan_text(" ".join(["cc by nc"] * n))
        took.append(time.perf_counter() - start)
        assert len(base) == n and len(near) == n
    assert took[1] < 8 * took[0] + 1
