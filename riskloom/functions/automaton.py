"""Where a match may stand at a place of a text: signatures as automata of positions, walked forwards and backwards from a line break.

A position is one letter, class or dot of a pattern; being at a position means that the character before was its match.  What
a text does to all positions is a small relation, so a text may be cut anywhere without being read with what follows it.
"""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser

from riskloom.registry import Signature

COPIES = 256            # of a repeated part at most; signatures with more are not made into positions
_CATEGORY = {ops.CATEGORY_SPACE: r"\s", ops.CATEGORY_NOT_SPACE: r"\S", ops.CATEGORY_WORD: r"\w", ops.CATEGORY_NOT_WORD: r"\W",
             ops.CATEGORY_DIGIT: r"\d", ops.CATEGORY_NOT_DIGIT: r"\D"}


class Irregular(ValueError):
    """A pattern with word edges, anchors, references or other parts that look beyond a character."""


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Positions:
    """The positions of all signatures; a set of positions is a whole number with their bits."""

    def __init__(self, signatures: tuple[Signature, ...]):
        self.sources: list[str] = []        # a position's class, as a pattern
        self.owner: list[int] = []          # a position's signature
        self.follow: list[int] = []
        self.first = self.last = 0
        self.irregular: list[int] = []
        for i, s in enumerate(signatures):
            mark = len(self.sources)
            try:
                _, first, last = self._sequence(_parser.parse(s.pattern.lower()))
            except (Irregular, re.error):
                del self.sources[mark:], self.follow[mark:]
                self.irregular.append(i)
                continue
            self.first |= first
            self.last |= last
            self.owner += [i] * (len(self.sources) - mark)
        self.precede = [sum(1 << p for p, f in enumerate(self.follow) if f >> q & 1) for q in range(len(self.follow))]
        self._classes = [re.compile(s) for s in self.sources]
        self._holding: dict[str, int] = {}
        #: The positions that may have matched a line break, in order: the states in which a match can go from file to file.
        self.crossing = [*_bits(self.holding("\n"))]
        self._number = {p: k for k, p in enumerate(self.crossing)}
        #: Those with which a match begins and is whole, by number.
        self.opening, self.closing = self.numbers(self.first & self.holding("\n")), self.numbers(self.last & self.holding("\n"))
        self.forwards, self.backwards = _Walk(self, self.follow, self.last), _Walk(self, self.precede, self.first)

    def _add(self, source: str) -> tuple[bool, int, int]:
        self.sources.append(source)
        self.follow.append(0)
        own = 1 << len(self.sources) - 1
        return False, own, own

    def _link(self, last: int, first: int) -> None:
        for p in _bits(last):
            self.follow[p] |= first

    def _sequence(self, items) -> tuple[bool, int, int]:
        """Whether nothing matches, and the positions that a match may begin and end with."""
        empty, first, last = True, 0, 0
        for op, value in items:
            if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
                least, most, body = value
                if max(least, 0 if most is ops.MAXREPEAT else most) > COPIES:
                    raise Irregular
                parts = [(False, body)] * least + ([(True, body)] if most is ops.MAXREPEAT else [(None, body)] * (most - least))
            else:
                parts = [(False, [(op, value)])]
            for kind, body in parts:
                e, f, l = self._sequence(body) if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) else self._one(op, value)
                if kind:
                    self._link(l, f)
                self._link(last, f)
                e = e or kind is not False
                first, last, empty = first | f if empty else first, last | l if e else l, empty and e
        return empty, first, last

    def _one(self, op, value) -> tuple[bool, int, int]:
        if op is ops.LITERAL:
            return self._add(re.escape(chr(value)))
        if op is ops.NOT_LITERAL:
            return self._add(f"[^{re.escape(chr(value))}]")
        if op is ops.ANY:
            return self._add(r"[^\n]")
        if op is ops.IN:
            return self._add("[" + "".join(map(self._item, value)) + "]")
        if op is ops.SUBPATTERN and not (value[1] or value[2]):
            return self._sequence(value[3])
        if op is ops.BRANCH:
            each = [self._sequence(x) for x in value[1]]
            first = last = 0
            for _, f, l in each:
                first, last = first | f, last | l
            return any(e for e, _, _ in each), first, last
        raise Irregular

    @staticmethod
    def _item(item) -> str:
        op, value = item
        if op is ops.NEGATE:
            return "^"
        if op is ops.LITERAL:
            return re.escape(chr(value))
        if op is ops.RANGE:
            return f"{re.escape(chr(value[0]))}-{re.escape(chr(value[1]))}"
        return _CATEGORY[value]

    def numbers(self, crossing: int) -> int:
        """A set of crossing positions by their numbers."""
        return sum(1 << self._number[p] for p in _bits(crossing))

    def holding(self, char: str) -> int:
        """The positions whose class has a character."""
        found = self._holding.get(char)
        if found is None:
            found = self._holding[char] = sum(1 << p for p, c in enumerate(self._classes) if c.fullmatch(char))
        return found


KNOWN = 100_000         # steps that a walk remembers


class _Walk:
    """From sets of positions along a text, by the positions ``beside`` each; ``ends`` are those with which a match is whole."""

    def __init__(self, positions: Positions, beside: list[int], ends: int):
        self.positions, self.beside, self.ends = positions, beside, ends
        self._next: dict[tuple[int, str], int] = {}
        self._reach: dict[int, int] = {}
        self._same: dict[int, re.Pattern] = {}
        self._begun: dict[str, list[tuple[int, int]]] = {}

    def reach(self, state: int) -> int:
        found = self._reach.get(state)
        if found is None:
            found = 0
            for p in _bits(state):
                found |= self.beside[p]
            if len(self._reach) >= KNOWN:
                self._reach.clear()
            self._reach[state] = found
        return found

    def step(self, state: int, char: str) -> int:
        found = self._next.get((state, char))
        if found is None:
            if len(self._next) >= KNOWN:
                self._next.clear()
            found = self._next[state, char] = self.reach(state) & self.positions.holding(char)
        return found

    def _alike(self, state: int) -> re.Pattern:
        """The run of characters that leave a state as it is."""
        found = self._same.get(state)
        if found is None:
            sources = self.positions.sources
            within = [*dict.fromkeys(sources[p] for p in _bits(state))]
            without = {sources[q] for q in _bits(self.reach(state) & ~state)} - {f"[{s[2:]}" for s in within if s.startswith("[^")}
            if len(self._same) >= KNOWN // 100:
                self._same.clear()
            heads = "".join([*(f"(?={s})" for s in within[1:]), *(f"(?!{s})" for s in sorted(without))])
            found = self._same[state] = re.compile(f"(?:{heads}{within[0]})*")
        return found

    def begun(self, char: str) -> list[tuple[int, int]]:
        """``(crossing, state)`` for the crossing positions that a first character leaves alive: their numbers, and where they are."""
        found = self._begun.get(char)
        if found is None:
            if len(self._begun) >= KNOWN:
                self._begun.clear()
            after = [(k, self.step(1 << p, char)) for k, p in enumerate(self.positions.crossing)]
            found = self._begun[char] = [(k, s) for k, s in after if s]
        return found

    def along(self, text: str, state: int, at: int, runs: dict[int, tuple[int, int]]) -> tuple[bool, int]:
        """Whether a match becomes whole, and the state at the end of the text if none does; ``runs`` has where states stay in this text."""
        while not state & self.ends:
            if at >= len(text):
                return False, state
            after = self.step(state, text[at])
            at += 1
            if not after:
                return False, 0
            if after == state and at < len(text):
                start, end = runs.get(state, (0, -1))
                if not start <= at <= end:
                    start, end = runs[state] = at, self._alike(state).match(text, at).end()
                at = end
            state = after
        return True, 0


class Relation:
    """What a file does to a match that comes into it: bits are the crossing positions, by number."""

    __slots__ = ("accepts", "passes")

    def __init__(self, accepts: int, passes: dict[int, int]):
        self.accepts, self.passes = accepts, passes

    def before(self, after: int) -> int:
        """The states from which a match becomes whole in the file or behind it, by those behind it."""
        found = self.accepts
        for x, to in self.passes.items():
            if to & after:
                found |= 1 << x
        return found

    def then(self, later: Relation) -> Relation:
        passes = {}
        for x, to in self.passes.items():
            through = 0
            for y in _bits(to):
                through |= later.passes.get(y, 0)
            if through:
                passes[x] = through
        return Relation(self.before(later.accepts), passes)

    def packed(self) -> str:
        return " ".join(f"{n:x}" for n in (self.accepts, *(n for pair in sorted(self.passes.items()) for n in pair)))

    @staticmethod
    def unpacked(packed: str) -> Relation:
        accepts, *numbers = (int(n, 16) for n in packed.split())
        return Relation(accepts, dict(zip(numbers[::2], numbers[1::2])))


def relation(positions: Positions, text: str) -> tuple[int, Relation]:
    """The crossing states in which matches begun in a file leave it, and what it does to those that come in; a line break follows the file."""
    numbers, opens, accepts, passes = positions.numbers, positions.opening, positions.closing, {}
    if not text:
        into = {k: numbers(positions.forwards.step(1 << p, "\n")) for k, p in enumerate(positions.crossing)}
        return opens, Relation(accepts, {k: to for k, to in into.items() if to})
    runs: dict[int, tuple[int, int]] = {}
    for k, state in positions.forwards.begun(text[0]):
        if not accepts >> k & 1:
            found, state = positions.forwards.along(text, state, 1, runs)
            if found:
                accepts |= 1 << k
            elif state and (to := numbers(positions.forwards.step(state, "\n"))):
                passes[k] = to
    back, runs = None, {}
    for k, state in positions.backwards.begun(text[-1]):
        if not opens >> k & 1:
            back = text[::-1] if back is None else back
            if positions.backwards.along(back, state, 1, runs)[0]:
                opens |= 1 << k
    return opens, Relation(accepts, passes)
