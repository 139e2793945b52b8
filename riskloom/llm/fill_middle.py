"""Fill-in-the-middle: a document is a table of pieces of immutable buffers, which are cut, permuted and put back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, slices, utf8

SEED = 42
RATE = 50               # documents of 100 that are rearranged
SPM_RATE = 80           # of these, of 100, that begin with the suffix
SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: The parts of a rearranged document in order, each after its sentinel.
FORMS = {"psm": "PSM", "spm": "SPM"}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

Piece = tuple[bytes, int, int]      # buffer, start, end


class PieceTable:
    """Descriptors over immutable buffers.  Cutting splits descriptors, arranging permutes them; no text is moved."""

    def __init__(self, buffer: bytes):
        self.pieces: list[Piece] = [(buffer, 0, len(buffer))]

    def cut(self, *places: int) -> PieceTable:
        """Split the descriptors at these distances from the start, in ascending order; a part may be empty."""
        out, at = [], 0
        left = list(places)
        for buffer, start, end in self.pieces:
            while left and left[0] <= at + end - start:
                middle = start + left.pop(0) - at
                out.append((buffer, start, middle))
                at, start = at + middle - start, middle
            out.append((buffer, start, end))
            at += end - start
        self.pieces = out
        return self

    def arrange(self, order: Iterable[int]) -> PieceTable:
        self.pieces = [self.pieces[k] for k in order]
        return self

    def put(self, at: int, buffer: bytes) -> PieceTable:
        self.pieces.insert(at, (buffer, 0, len(buffer)))
        return self

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield memoryview(buffer)[start:end]

    def digest(self) -> str:
        made = sha256()
        for part in self.stream():
            made.update(part)
        return made.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.stream())


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit ends: a word with the space before it, and the space after the last word."""
    space = _SPACE[np.frombuffer(text, dtype=np.uint8)]
    ends = np.nonzero(~space[:-1] & space[1:])[0] + 1
    return np.append(ends, len(text)) if text else ends


def characters(text: bytes, start: int, end: int) -> int:
    return int(np.count_nonzero(np.frombuffer(text, dtype=np.uint8)[start:end] & 0xC0 != 0x80))


def drawn(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from the document's id; without an id, from the seed alone."""
    name = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(name[8 * k:8 * k + 8], 16) for k in range(4))


def rearranged(text: bytes, draws: tuple[int, ...], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[PieceTable, str, int, tuple[int, int] | None]:
    """The document's piece table, its form, its number of units, and where prefix and middle end."""
    table, ends = PieceTable(text), unit_ends(text)
    n = len(ends)
    if not text or draws[2] % 100 >= rate or any(s in text for s in SENTINELS.values()):
        return table, "plain", n, None
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    form = "spm" if draws[3] % 100 < spm_rate else "psm"
    table.cut(first, second).arrange("PMS".index(part) for part in FORMS[form])
    for k, part in enumerate(FORMS[form]):
        table.put(2 * k, SENTINELS[part])
    return table, form, n, (first, second)


def restored(output: bytes, form: str) -> PieceTable:
    """The original document, as pieces of the output: cut at its sentinels, which are left out, and permuted back.

    A rearranged text holds no sentinel, and none can arise where a sentinel meets text, so the first of each is the one that was put in.
    """
    table = PieceTable(output)
    if form == "plain":
        return table
    places, at = [], 0
    for part in FORMS[form]:
        at = output.index(SENTINELS[part], at)
        places += [at, at + len(SENTINELS[part])]
        at = places[-1]
    return table.cut(*places).arrange(2 * FORMS[form].index(part) + 2 for part in "PMS")


def _rows(batches, rate, spm_rate, texts):
    for batch in slices(batches):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table, form, n, cuts = rearranged(text, drawn(doc_id), rate, spm_rate)
            output = table.text()
            lengths = (None, None) if cuts is None else (characters(text, 0, cuts[0]), characters(text, *cuts))
            out.append((n, form, *lengths, table.digest(), restored(output, form).digest(), output.decode() if texts else None))
        columns = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.large_string())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(columns, kinds)), *batch.columns[2:]], [*NAMES, *batch.schema.names[2:]])


NAMES = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")
_TYPES = ("long", "string", "long", "long", "string", "string", "string")


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, texts: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output`` (longer names where these exist).

    ``output`` is the rearranged document, null unless ``texts``; ``restored_sha256`` is that of the text rebuilt from output and form alone.
    Units are words with the white space before them; cuts depend on the id alone, so reruns agree.  Null and empty texts are
    empty and plain; a text that holds a sentinel is plain; rows without id draw from the seed alone; repeated rows stay
    repeated with equal results; an empty table gives no rows.  Nothing is shuffled; a task holds a slice of rows, and of a long text one copy beside it.
    """
    names = fresh(docs, *NAMES)
    own = fresh(docs, "fim_id", "fim_text")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias(own[0]), utf8(text).alias(own[1]), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    made = rows.mapInArrow(partial(_rows, rate=rate, spm_rate=spm_rate, texts=texts),
                           f"{', '.join(map(' '.join, zip(NAMES, _TYPES)))}, row {rows.schema['row'].dataType.simpleString()}")
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(name) for c, name in zip(NAMES, names)])
