"""Matches that go over the ends of files, of any length."""

import random
import re

import pytest

from riskloom import registry as R
from riskloom.functions.automaton import Positions, Relation, relation
from riskloom.operators import borders

OWN = (R.Signature("a", r"a\s*(b|c)+x{2,3}[^'\"]{2,}?d", ()), R.Signature("b", r"q(.|\s)*z|\n\ny", ()), R.Signature("w", r"\bfoo", ()), R.Signature("c", r"e\s", ()))
PARTS = ["password", "password =", "=", "'", "'", "abc", " ", "\n", "token='", "except", ":", "eval", "(", "input"]


def over_ends(positions: Positions, files: list[str]) -> list[int]:
    found, after, whole = [0] * len(files), 0, Relation(0, {k: 1 << k for k in range(len(positions.crossing))})
    for i in reversed(range(len(files))):
        opens, inside = relation(positions, files[i])
        for k, p in enumerate(positions.crossing):
            if opens & after & 1 << k:
                found[i] |= 1 << positions.owner[p]
        after, whole = inside.before(after), Relation.unpacked(inside.packed()).then(whole)
    assert whole.before(0) == after
    return found


def by_definition(signatures: list[tuple[int, str]], files: list[str]) -> list[int]:
    """Every stretch of the joined text that begins in a file, or at its end, and ends later."""
    text, start, found = "\n".join(files), 0, []
    for i, f in enumerate(files):
        end = start + len(f)
        found.append(sum(1 << j for j, pattern in signatures if i + 1 < len(files) and any(
            re.compile(pattern).fullmatch(text, b, e) for b in range(start, end + 1) for e in range(end + 1, len(text) + 1))))
        start = end + 1
    return found


@pytest.mark.parametrize("signatures,parts", [(R.SHORTCUTS, PARTS), (OWN, list("abcxxd'qzye\n "))])
def test_states_equal_all_stretches_of_the_text(signatures, parts):
    rng, positions, some = random.Random(5), Positions(signatures), 0
    regular = [(i, s.pattern.lower()) for i, s in enumerate(signatures) if i not in positions.irregular]
    for _ in range(400):
        files = ["".join(rng.choices(parts, k=rng.choice([0, 0, 1, 2, 3, 5]))) for _ in range(rng.randint(1, 4))]
        want = by_definition(regular, files)
        assert over_ends(positions, files) == want, files
        some += any(want)
    assert some > 20 and positions.irregular == ([2] if signatures is OWN else [])


def test_matches_longer_than_any_window(spark, files, monkeypatch):
    """A text in quotes that begins and ends far from the ends of its files, with whole files and blocks between."""
    monkeypatch.setattr(borders, "BLOCK", 4)
    far = "y" * 3000
    rows = [("r", "a.py", f"password = '{far}"), ("r", "b.py", f"{far}'"),
            *(("s", f"{i:02d}.py", f"secret = \"{far}" if i == 1 else f"{far}\"" if i == 11 else far if i % 3 else "") for i in range(13)),
            ("t", "a.py", f"password = '{far}"), ("t", "b.py", far), ("u", "a.py", "md5 (x"), ("u", "b.py", "password"),
            ("v", "a.py", f"try: {far}\nexcept"), ("v", "b.py", " " * 700), ("v", "c.py", ":"), ("w", "a.py", f"password = '{far}")]
    got = {(r.repo, r.file, r.border_mask) for r in borders.border_masks(files(*rows), width=8).collect()}
    assert got == {("r", "a.py", 2), ("s", "01.py", 2), ("v", "a.py", 4)}


def test_signatures_with_word_edges_see_the_whole_text(spark, files):
    own = R.DEFAULT._replace(shortcuts=(R.Signature("plain", r"first\s+second", (), weight=1), R.Signature("edge", r"\bleft[^;]*right\b", (), weight=1)))
    far = "y" * 900
    rows = [("r", "a.py", f"left {far}"), ("r", "b.py", f"{far} right"), ("s", "a.py", f"aleft {far}"), ("s", "b.py", f"{far} right"), ("t", "a.py", f"{far}first"), ("t", "b.py", "second")]
    got = {(r.repo, r.file, r.border_mask) for r in borders.border_masks(files(*rows), own).collect()}
    assert got == {("r", "a.py", 2), ("t", "a.py", 1)}
