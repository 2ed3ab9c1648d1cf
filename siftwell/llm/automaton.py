"""Rules as one deterministic automaton over bytes that a scan passes once.

Regular expressions (literals, classes, groups, alternatives, `?`, `*`, `+`, `{m}`, `{m,}`, `{m,n}`) become
nondeterministic automata with empty moves. Subset construction makes each a deterministic searcher: its states are the
sets of places that the open attempts stand at, one set for each start, earliest first; once the earliest attempt matches,
later ones go, and when it can't go on the match ends and the search begins anew. The searchers, each made minimal, run
side by side as one automaton, which is made minimal too. Bytes that all rules treat alike share a column, so a state is
an array of next states by kind of byte. A move on which matches end holds an `Ended` in place of the next state; a scan
is one lookup a byte until it meets one.

The end of a match is thereby known; its start is found by walking the reversed rule back from there, never beyond the
end of the rule's match before, so both ways together take time in proportion to the text.

Rules for which this isn't exact are refused: those in which a later attempt can match while an earlier one is undecided,
and those that can go on after a match without matching at each further byte.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class _Parser:
    """Recursive descent; builds fragments (start, end) in `moves` and `empty`."""

    def __init__(self):
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.empty.append([])
        return len(self.moves) - 1

    def rule(self, source: str, any_case: bool) -> tuple[int, int]:
        self.s, self.i, self.any_case = source, 0, any_case
        out = self.choice()
        if self.i != len(source):
            raise ValueError(f"can't read {source!r} from {self.i}")
        return out

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def choice(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, z = self.state(), self.state()
        for b, y in parts:
            self.empty[a].append(b)
            self.empty[y].append(z)
        return a, z

    def sequence(self) -> tuple[int, int]:
        a = z = self.state()
        while self.peek() and self.peek() not in "|)":
            at = self.i
            unit = self.unit()
            after = self.i
            low, high = self.times()
            end = self.i
            for k in range(max(low, 1 if high else 0) if high is not None else max(low, 1)):
                self.i = at
                b, y = unit if not k else self.unit()
                self.empty[z].append(b)
                if k >= low:
                    self.empty[b].append(y)
                z = y
                first, last = b, y
            if high is None:
                self.empty[last].append(first)
                if not low:
                    self.empty[first].append(last)
            else:
                for _ in range(max(low, 1), high):
                    self.i = at
                    b, y = self.unit()
                    self.empty[z].append(b)
                    self.empty[b].append(y)
                    z = y
            self.i = max(after, end)
            out = self.state()
            self.empty[z].append(out)
            z = out
        return a, z

    def times(self) -> tuple[int, int | None]:
        c = self.peek()
        if c and c in "?*+":
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            stop = self.s.index("}", self.i)
            low, comma, high = self.s[self.i + 1 : stop].partition(",")
            self.i = stop + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def unit(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.i += 1
            out = self.choice()
            if self.peek() != ")":
                raise ValueError("a group isn't closed")
            self.i += 1
            return out
        chars = self.kind() if c == "[" else {self.char()}
        if self.any_case:
            chars = {x for c in chars for x in (ord(chr(c).lower()), ord(chr(c).upper()))} if max(chars) < 128 else chars
        a, z = self.state(), self.state()
        self.moves[a] = (frozenset(chars), z)
        return a, z

    def char(self) -> int:
        c = self.peek()
        self.i += 1
        if c == "\\":
            c = self.peek()
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def kind(self) -> set[int]:
        self.i += 1
        out: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            high = low
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] != "]":
                self.i += 1
                high = self.char()
            out |= set(range(low, high + 1))
        self.i += 1
        return out


class Ended:
    """A move on which the matches of `rules` end before the byte; `row` is the next state."""

    __slots__ = ("row", "rules")

    def __init__(self, rules: tuple[int, ...], row: list):
        self.rules, self.row = rules, row


def _minimal(table: np.ndarray, marks: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """States that no text tells apart become one: groups split until all members of a group move alike."""
    group = np.unique(marks, axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        split = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if split.max() == group.max():
            break
        group = split
    some = np.unique(group, return_index=True)[1]
    return group[table[some]], marks[some], int(group[first])


class _Searcher:
    """One rule: moves[state][kind] and ends[state][kind] (whether a match ends on that move); the last kind is the
    end of the text. back: the reversed rule."""

    def __init__(self, source: str, any_case: bool):
        self.parser = _Parser()
        self.first, self.last = self.parser.rule(source, any_case)
        self.sets = sorted({m[0] for m in self.parser.moves if m}, key=sorted)

    def _closed(self, states: Iterable[int], empty: list[list[int]]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def build(self, samples: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        moves, empty = self.parser.moves, self.parser.empty
        fresh = self._closed([self.first], empty)
        if self.last in fresh:
            raise ValueError("a rule matches nothing at all")

        def after(attempts: tuple, byte: int) -> tuple:
            """The attempts after a byte; a place that an earlier attempt holds too is left to it."""
            held: set[int] = set()
            out = []
            for places in attempts:
                new = self._closed([moves[s][1] for s in places if moves[s] and byte in moves[s][0]], empty) - held
                held |= new
                if new:
                    out.append(new)
                if self.last in new:
                    if len(out) > 1:
                        raise ValueError("a later attempt can match before an earlier one is decided")
                    break
            return tuple(out)

        matched = lambda state: bool(state) and self.last in state[0]
        index, order, table, ends = {(): 0}, [()], [], []
        for state in order:
            to, end = [], []
            for byte in samples:
                then, done = after(state if matched(state) else (*state, fresh), byte), False
                if matched(state):
                    if then and not matched(then):
                        raise ValueError("a match can go on without matching at each byte")
                    if not then:
                        then, done = after((fresh,), byte), True
                if then not in index:
                    index[then] = len(order)
                    order.append(then)
                to.append(index[then])
                end.append(done)
            table.append([*to, 0])
            ends.append([*end, matched(state)])
        return _minimal(np.array(table), np.array(ends), 0)

    def backwards(self) -> tuple[list[dict | None], frozenset[int], int]:
        """The reversed rule as an automaton that is made as far as texts need it."""
        n = len(self.parser.moves)
        into, empty = [[] for _ in range(n)], [[] for _ in range(n)]
        for s, m in enumerate(self.parser.moves):
            if m:
                into[m[1]].append((m[0], s))
            for t in self.parser.empty[s]:
                empty[t].append(s)
        return into, self._closed([self.last], empty), empty


class _Back:
    """Walks a rule back from the end of a match to its earliest start."""

    def __init__(self, searcher: _Searcher):
        into, start, empty = searcher.backwards()
        self.into, self.empty, self.goal = into, empty, searcher.first
        self.closed = searcher._closed
        self.start = [None] * 256 + [start]  # by byte the state before it, then the places it stands for
        self.known = {start: self.start}

    def _before(self, row: list, byte: int) -> list | bool:
        places = self.closed([s for t in row[256] for chars, s in self.into[t] if byte in chars], self.empty)
        found = self.known.setdefault(places, [None] * 256 + [places]) if places else False
        row[byte] = found
        return found

    def earliest(self, data: bytes, end: int, low: int) -> int:
        row, best = self.start, end
        for at in range(end - 1, low - 1, -1):
            row = row[data[at]] if row[data[at]] is not None else self._before(row, data[at])
            if not row:
                break
            if self.goal in row[256]:
                best = at
        return best


class Automaton:
    """All rules, (name, source, whether letters match in either case), as one."""

    def __init__(self, rules: Iterable[tuple[str, str, bool]]):
        searchers = [_Searcher(source, any_case) for _, source, any_case in rules]
        marks = sorted({s for x in searchers for s in x.sets}, key=sorted)
        kinds: dict[tuple[bool, ...], int] = {}
        self.kinds = bytes(kinds.setdefault(tuple(b in m for m in marks), len(kinds)) for b in range(256))
        self.end = bytes([len(kinds)])
        parts = [x.build([self.kinds.index(k) for k in range(len(kinds))]) for x in searchers]
        self.back = [_Back(x) for x in searchers]
        # Side by side: a state is a tuple of the searchers' states.
        first = tuple(f for _, _, f in parts)
        index, order, table, ends = {first: 0}, [first], [], []
        moves, done = [t.tolist() for t, _, _ in parts], [e.tolist() for _, e, _ in parts]
        bit = [1 << k for k in range(len(parts))]
        for state in order:
            rows = [m[s] for m, s in zip(moves, state)]
            to = []
            for then in zip(*rows):
                if then not in index:
                    index[then] = len(order)
                    order.append(then)
                to.append(index[then])
            table.append(to)
            ends.append([sum(b for b, e in zip(bit, now) if e) for now in zip(*(d[s] for d, s in zip(done, state)))])
        table, ends, first = _minimal(np.array(table), np.array(ends), 0)
        self.n_states, self.n_kinds = table.shape
        rows: list[list] = [[] for _ in table]
        for row, to, end in zip(rows, table.tolist(), ends.tolist()):
            row.extend(Ended(tuple(k for k, b in enumerate(bit) if e & b), rows[t]) if e else rows[t] for t, e in zip(to, end))
        self.first = rows[first]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule's number, start, end) of each rule's leftmost-longest matches that don't overlap, by their ends."""
        out: list[tuple[int, int, int]] = []
        free = [0] * len(self.back)
        row, n = self.first, len(data)
        # A mark after the end makes every end be met by a further move.
        left = iter(data.translate(self.kinds) + self.end * 2)
        while True:
            try:
                for kind in left:
                    row = row[kind]
                return out
            except TypeError:  # `row` is an Ended of the move before this one
                at = n - left.__length_hint__()
                for rule in row.rules:
                    out.append((rule, self.back[rule].earliest(data, at, free[rule]), at))
                    free[rule] = at
                row = row.row
                row = row[kind]
