"""Line dedup: patience diff and the whole operator against all candidate pairs."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import line_dedup as L
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES

SEQ = st.lists(st.integers(0, 9), max_size=14)


@settings(max_examples=300, deadline=None)
@given(SEQ, SEQ)
def test_patience_matches_equal_elements_in_order(a, b):
    found = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(8)), st.permutations(range(8)))
def test_unique_elements_give_the_longest_common_subsequence(a, b):
    rows = [[0] * 9 for _ in range(9)]
    for i in range(8):
        for j in range(8):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
    assert len(L.anchors(list(a), list(b), 0, 8, 0, 8)) == rows[8][8]


def test_known_diffs():
    assert L.patience(list("abcXdef"), list("abcYdef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert L.patience([], [1]) == [] and L.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert L.common_blocks([(0, 1), (1, 2), (5, 3)], [(3, 1, 2), (4, 2, 2), (5, 3, 2)], 4) == [3, 4]


def by_hand(rows, min_words=L.MIN_WORDS):
    """rows: (doc_id, text) with distinct ids; the cleaned texts, every text being aligned with all earlier ones that share a line."""
    first, lines = {}, {}
    for i, text in sorted(rows):
        lines[i] = [(n, x.strip(" \t\n\r\x0b\x0c")) for n, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        first.setdefault(tuple(x for _, x in lines[i]), i)
    holders = defaultdict(list)
    for sequence, i in sorted(first.items(), key=lambda x: x[1]):
        for x in set(sequence):
            holders[x].append(i)
    pairs = set()
    for own in holders.values():
        own.sort()
        pairs |= {(b, a) for k, a in enumerate(own) for b in own[k + 1:]}
    gone = defaultdict(set)
    for later, earlier in pairs:
        matches = L.patience([x for _, x in lines[earlier]], [x for _, x in lines[later]])
        runs = []
        for i, j in matches:
            if runs and runs[-1][-1] == (i - 1, j - 1):
                runs[-1].append((i, j))
            else:
                runs.append([(i, j)])
        for run in runs:
            if sum(len(lines[later][j][1].split()) for _, j in run) >= min_words:
                gone[later] |= {lines[later][j][0] for _, j in run}
    out = {}
    for i, text in rows:
        top = first[tuple(x for _, x in lines[i])]
        cut = gone[i] if top == i else {n for n, _ in lines[i]} if sum(len(x.split()) for _, x in lines[i]) >= min_words else {lines[i][k][0] for k, (n, _) in enumerate(lines[top]) if n in gone[top]}
        out[i] = "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in cut)
    return out


def test_query_equals_every_pair(spark, sf):
    docs = table(spark, sf, "documents")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.clean_text for r in L.line_dedup(docs).collect()}
    assert got == want
    assert sum(r.n_deleted for r in QUERIES["op3_line_dedup"](spark, sf).collect()) > 0


def test_frequent_lines_and_moved_blocks(spark):
    rng = random.Random(10)
    block = [f"block line {k} with several words" for k in range(6)]
    rows = []
    for i in range(40):
        body = [f"own line {i} {k} of this document" for k in range(rng.randint(1, 6))]
        at = rng.randint(0, len(body))
        body[at:at] = ["", *(block if i % 2 else block[2:5]), " " + block[0] + " "]
        rows.append((i, "\n".join(body)))
    rng.shuffle(rows)
    got = {r.doc_id: r.clean_text for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_hand(rows)
    assert sum("block line 3" in t for t in got.values()) == 1


def test_rows_of_every_kind(documents):
    text = "a line of seven words is here\nsecond line of words is there"
    docs = documents((1, text), (2, text + "\n"), (3, "new line of words for this one\na line of seven words is here"), (4, None), (5, ""), (6, "short one"), (7, "short one"),
                     (None, "second line of words is there"), (8, text), (8, text), clashing=True)
    got = L.line_dedup(docs)
    assert got.columns == [*docs.columns, "clean_text_", "n_lines_", "n_deleted"]
    rows = got.collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[1].clean_text_ == text and by[2].clean_text_ == "" and by[8].clean_text_ == ""
    assert by[3].clean_text_ == "new line of words for this one" and by[3].n_deleted == 1
    assert by[4].clean_text_ is None and (by[4].n_lines_, by[4].n_deleted) == (0, 0) and by[5].clean_text_ == ""
    assert by[6].clean_text_ == by[7].clean_text_ == "short one" and by[None].clean_text_ == ""
    assert L.line_dedup(docs.filter("doc_id < 0")).count() == 0


def test_rows_with_one_id_and_text_are_one_document(documents):
    docs = documents(*[(1, "the same words stand in here")] * 3, clashing=False)
    assert [r.clean_text for r in L.line_dedup(docs).collect()] == ["the same words stand in here"] * 3


def every_pair(rows, min_words=L.MIN_WORDS):
    """rows: (doc_id, text) with distinct ids and different lines; the cleaned texts when every text is aligned with every earlier one."""
    lines = {i: L.filled_lines(text.encode()) for i, text in rows}
    out = {}
    for i, text in rows:
        later = [(k, x, len(x.split())) for k, (_, x) in enumerate(lines[i])]
        gone = {k for j in lines if j < i for k in L.common_blocks([(k, x) for k, (_, x) in enumerate(lines[j])], later, min_words)}
        cut = {lines[i][k][0] for k in gone}
        out[i] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in cut)
    return out


def cleaned(spark, rows):
    return {r.doc_id: r.clean_text for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_frequent_line_that_the_earliest_text_does_not_align(spark):
    a, b = "first frequent line of many words", "second frequent line of many words"
    rows = [(0, f"{a}\nown 0\n{b}")] + [(i, f"own {i}\n{(a, b)[i % 2]}\nend {i}") for i in range(1, 30)]
    rows += [(30, f"{b}\nx 30\ny 30\n{a}\nz 30"), (31, f"{a}\nx 31\n{a}\ny 31\n{a}"), (32, f"{a}\nx 32\n{a}\nz 32\n{a}\ny 32")]
    got = cleaned(spark, rows)
    assert got == every_pair(rows)
    assert a not in got[30] and b not in got[30]        # text 0 has the two lines in another order, texts 1 and 2 have one each
    assert a not in got[32]                             # only text 31 has the line three times


def test_block_of_short_frequent_lines(spark):
    rows = [(i, f"own {i}\nshort {'abc'[i % 3]}\nmore {i}") for i in range(30)]
    rows += [(30 + i, f"own {30 + i}\nshort a\nshort b\nshort c\nmore {30 + i}") for i in range(12)]
    got = cleaned(spark, rows)
    assert got == every_pair(rows)
    assert "short" in got[30] and not any("short" in got[30 + i] for i in range(1, 12))


def test_frequent_lines_equal_every_pair(spark, monkeypatch):
    monkeypatch.setattr(L, "RARE", 2)
    monkeypatch.setattr(L, "CELL", 2)
    monkeypatch.setattr(L, "CELLS", 1)
    monkeypatch.setattr(L, "GROWTH", 2)
    rng = random.Random(3)
    pool = [" ".join([f"w{k}"] * (1 + k % 6)) for k in range(8)]
    rows = [(i, "\n".join([f"id {i}", *rng.choices([*pool, f"gap {i}", ""], k=rng.randint(2, 9))])) for i in range(150)]
    got = cleaned(spark, rows)
    assert got == every_pair(rows)


def test_windows_cover_common_blocks():
    rows = [(0, 7, 5), (1, 8, 1), (2, 9, 3), (4, 7, 2), (5, 8, 2), (8, 9, 9)]
    found, full = L.windows(rows, 5)
    assert {(s, e) for _, s, e in found} == {(0, 0), (0, 1), (0, 2), (8, 8)} and full == [0, 1, 2, 8]
    assert L.windows(rows, 10) == ([], [])


def test_thousands_of_texts_share_one_line(spark):
    line = "one line of many words that every text has"
    rows = [(i, f"own {i}\n{line}\nend {i}") for i in range(3000)]
    got = cleaned(spark, rows)
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}\nend {i}" for i in range(1, 3000))
