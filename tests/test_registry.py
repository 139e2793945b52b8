"""A scan with other signatures: every result follows the registry."""

from riskloom import registry as R
from riskloom.operators import patching
from riskloom.plans.scan import scan

OWN = R.Registry(
    vulnerabilities=(R.Signature("Frobnicated Value", r"frobnicate\s*\(", ("frob",), severity="High"),),
    shortcuts=(R.Signature("Left Over Marker", r"marker\s*:\s*later", ("marker",), weight=14), R.Signature("Sleepy", r"zzz+", (), weight=3)),
    triggers={**R.TRIGGERS, "frob": ("frobnicate",), "marker": ("marker",)})
CODE = "a = 1\n  b = frobnicate (a)\n# marker : LATER\nvalue = eval(a)\n"


def test_shortcuts_and_their_weights(files):
    df = files(("r", "a.py", CODE), ("r", "b.py", "zzzz"), ("s", "a.py", "x = eval(input)"))
    with scan(df, registry=OWN) as result:
        found = {(r.repo, r.shortcut): r.weight for r in result.shortcuts.collect()}
        points = {r.repo: r.vibe_breakdown["Insecure Shortcuts"] for r in result.report.collect()}
        high = {r.repo: r.vibe_breakdown["High Severity Issues"] for r in result.report.collect()}
    assert found == {("r", "Left Over Marker"): 14, ("r", "Sleepy"): 3}
    assert points == {"r": 15, "s": 0}            # 17, but 15 at most
    assert high == {"r": 7, "s": 0}
    with scan(df) as result:
        assert {r.shortcut for r in result.shortcuts.collect()} == {"No Input Validation (direct use)"}


def test_fixes_of_own_signatures(files):
    df = files(("r", "a.py", CODE), ("s", "a.py", "x = eval(input)\n"))
    got = {r.repo: r for r in patching.patched_files(df, OWN).collect()}
    note = patching._FIX["default_note"]
    assert set(got) == {"r"} and got["r"].fixed_lines == 1
    assert got["r"].patched_content == f"a = 1\n  {note}\n  b = frobnicate (a)\n# marker : LATER\nvalue = eval(a)\n"


def test_first_last_and_adjacent_lines_are_fixed(files):
    df = files(("r", "a.py", "x = eval(a)\ny = eval(b)\nplain\nz = eval(c)"), ("r", "b.py", "x = eval(a)\n"), ("r", "c.py", "# eval(a)\n\n"))
    got = {r.file: (r.fixed_lines, r.patched_content) for r in patching.patched_files(df).collect()}
    assert got == {"a.py": (3, "x = ast.literal_eval(a)\ny = ast.literal_eval(b)\nplain\nz = ast.literal_eval(c)"), "b.py": (1, "x = ast.literal_eval(a)\n")}


def test_shortcuts_over_the_borders_of_files(files):
    """Joined by name with a line break: a match may lie over two files, or over several short ones."""
    rows = [("r", "a.py", "x = 1\npassword ="), ("r", "b.py", "'abcdef'\n"), ("s", "a.py", "eval("), ("s", "b.py", ""), ("s", "c.py", ""), ("s", "d.py", "  user_input)"),
            ("t", "a.py", "password ="), ("t", "b.py", "x" * 2000), ("t", "c.py", "'abcdef'"), ("u", "b.py", "password ="), ("u", "a.py", "'abcdef'")]
    df = files(*rows)
    with scan(df, joined=True) as result:
        assert {(r.repo, r.shortcut) for r in result.shortcuts.collect()} == {("r", "Hardcoded Credential"), ("s", "No Input Validation (direct use)")}
        assert {r.repo: r.vibe_breakdown["Insecure Shortcuts"] for r in result.report.collect()} == {"r": 10, "s": 15, "t": 0, "u": 0}
    with scan(df) as result:
        assert result.shortcuts.count() == 0


def test_borders_move_every_head_once(spark, files, monkeypatch):
    """Blocks of few files, a match over many of them, and nothing is stored but the placed heads."""
    from riskloom.operators import borders

    stored = []
    durable = borders.ranked_position.__globals__["durable"]
    monkeypatch.setitem(borders.ranked_position.__globals__, "durable", lambda df, name, *a: (stored.append(name), durable(df, name, *a))[1])
    monkeypatch.setattr(borders, "BLOCK", 32)
    # a match over 13 files and two blocks, 11 of them without text; texts too long to be seen whole
    parts = ["x"] * 25 + ["y" * 900 + "password ="] + [""] * 11 + ["'abcdef'" + "z" * 900, "eval(", "user_input)"]
    rows = [("r", f"{i:02d}.py", c) for i, c in enumerate(parts)] + [("s", "a.py", "password ="), ("s", "b.py", "." * 512), ("s", "c.py", "'abcdef'")]
    got = {(r.repo, r.file) for r in borders.border_masks(files(*rows), width=32).collect()}
    assert got == {("r", "25.py"), ("r", "37.py"), ("r", "38.py")} and stored == ["ranked"]
