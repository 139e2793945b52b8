"""Fill-in-the-middle against string operations on the units of a regular expression, and the round trip."""

import re
from hashlib import sha256

import pytest

from riskloom.llm import fill_middle as M
from riskloom.llm.common import table
from riskloom.llm.queries import ORACLE, QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    name = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_query_equals_sql(spark, sf):
    from catalog.check import compare

    assert compare(spark, sf, QUERIES["op12_fill_in_middle"], ORACLE["op12_fill_in_middle"]) == ""


def test_query_equals_string_operations(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    forms = set()
    for r in QUERIES["op12_fill_in_middle"](spark, sf).collect():
        n, form, prefix, middle, output = by_hand(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == sha256(output.encode()).hexdigest() and r.restored_sha256 == sha256((texts[r.doc_id] or "").encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_rows_of_every_kind(spark, documents):
    texts = [None, "", " ", "\t\n ", "word", " word", "word ", "é è ü x", "a  b\r\nc \x0b d", "has <P> inside", "<S>", "near <P <M", "<" * 40 + " <", "x <P", "S> y <", "\x1c\x85 a　b"]
    rows = [(k * 7 + i, t) for i, t in enumerate(texts) for k in range(40)] + [(None, "no id here at all"), (None, "no id here at all"), (3, "twice the id"), (3, "twice the id")]
    df = documents(*rows)
    made = M.fill_in_middle(df)
    assert made.columns == [*df.columns, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        n, form, prefix, middle, output = by_hand(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, prefix, middle, output)
        assert r.restored_sha256 == sha256((r.text or "").encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "mine")], "doc_id long, text string, N long, output string")
    made = M.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "N", "output", "n_", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output_"]
    row = made.first()
    assert (row["N"], row["output"], row["n_"]) == (7, "mine", 3)


def test_empty_table_and_very_long_text(spark, documents):
    assert M.fill_in_middle(documents((1, "x")).filter("doc_id > 5")).count() == 0
    long = "wörd and \n" * 200_000 + "<"
    for doc_id in range(6):
        r = M.fill_in_middle(documents((doc_id, long))).first()
        assert (r.n, r.form, r.output) == (lambda x: (x[0], x[1], x[4]))(by_hand(doc_id, long))
        assert r.restored_sha256 == sha256(long.encode()).hexdigest()


@pytest.mark.parametrize("draws", [(0, 0, 0, 0), (2, 1, 0, 99), (3, 3, 0, 0), (0, 3, 0, 99)])
def test_piece_table(draws):
    text = b"one two three"
    table_, form, n, cuts = M.rearranged(text, draws)
    assert n == 3 and form == ("spm" if draws[3] < 80 else "psm")
    ends = (0, 3, 7, 13)
    assert cuts == tuple(sorted((ends[draws[0] % 4], ends[draws[1] % 4])))
    assert all(p[0] is text or p[0] in M.SENTINELS.values() for p in table_.pieces)       # nothing was copied
    assert M.restored(table_.text(), form).text() == text
    assert table_.digest() == sha256(table_.text()).hexdigest()


def test_cuts_at_one_place():
    cut = M.PieceTable(b"abcdef").cut(0, 2, 2, 6)
    assert [bytes(x) for x in cut.stream()] == [b"", b"ab", b"", b"cdef", b""]
    assert M.PieceTable(b"").cut(0, 0).text() == b""
