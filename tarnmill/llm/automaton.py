"""Regexes to one deterministic automaton over bytes: subset construction, minimisation, transition arrays."""

from __future__ import annotations

from re import _constants as sre
from re import _parser as sre_parser

import numpy as np

ANY_BYTE = frozenset(range(256))


class _Nfa:
    """Thompson construction; a fragment is (entry, exit). ``reverse``: of the strings read backwards."""

    def __init__(self, reverse: bool = False) -> None:
        self.reverse = reverse
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def on(self, symbols: frozenset) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a] = (symbols, b)
        return a, b

    def sequence(self, parts) -> tuple[int, int]:
        first = last = self.state()
        for a, b in parts:
            self.empty[last].append(a)
            last = b
        return first, last

    def build(self, tree) -> tuple[int, int]:
        items = list(tree)
        return self.sequence(self.item(op, arg) for op, arg in (items[::-1] if self.reverse else items))

    def item(self, op, arg) -> tuple[int, int]:
        if op is sre.LITERAL:
            symbols = chr(arg).encode()
            return self.sequence(self.on(frozenset([b])) for b in (symbols[::-1] if self.reverse else symbols))
        if op is sre.IN:
            return self.on(_members(arg))
        if op is sre.SUBPATTERN:
            return self.build(arg[3])
        if op is sre.BRANCH:
            a, b = self.state(), self.state()
            for tree in arg[1]:
                x, y = self.build(tree)
                self.empty[a].append(x)
                self.empty[y].append(b)
            return a, b
        if op is sre.MAX_REPEAT:
            low, high, tree = arg
            parts = [self.build(tree) for _ in range(low)]
            if high is sre.MAXREPEAT:
                x, y = self.build(tree)
                a = self.state()
                self.empty[a].append(x)
                self.empty[y].append(a)
                parts.append((a, a))
            else:
                for _ in range(high - low):
                    x, y = self.build(tree)
                    a, b = self.state(), self.state()
                    self.empty[a] += [x, b]
                    self.empty[y].append(b)
                    parts.append((a, b))
            return self.sequence(parts)
        raise ValueError(f"a rule uses {op}, which this automaton does not support")


def _members(items) -> frozenset:
    out: set[int] = set()
    negate = False
    for op, arg in items:
        if op is sre.NEGATE:
            negate = True
        elif op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"a class uses {op}, which this automaton does not support")
    if max(out, default=0) > 127:
        raise ValueError("classes hold ASCII characters only")
    return ANY_BYTE - out if negate else frozenset(out)


def deterministic(patterns: list[str], restart: bool, sink: bool = False, reverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, table, accepts) of the minimal automaton of all ``patterns`` together; bit k of ``accepts`` is pattern k."""
    nfa = _Nfa(reverse)
    begin, accept = nfa.state(), {}
    for k, p in enumerate(patterns):
        a, b = nfa.build(sre_parser.parse(p))
        nfa.empty[begin].append(a)
        accept[b] = 1 << k
    classes, members = Automaton._symbol_classes([m[0] for m in nfa.moves if m])
    return classes, *Automaton._minimise(*Automaton._subsets(nfa, begin, accept, members, restart, sink))


def covers(scan: str, head: str, body: str, least: int) -> bool:
    """Whether every string of head and body with at least ``least`` bytes of body holds an occurrence of ``scan``.

    All strings of the two are followed through the automaton of ``scan`` at once, by the states of both and the bytes of
    body so far (at most ``least``); one that ends outside the hit state is a string that ``scan`` would miss.
    """
    machine, nfa = Automaton([scan]), _Nfa()
    first = nfa.build(sre_parser.parse(head))
    n_head = len(nfa.moves)
    last = nfa.build(sre_parser.parse(body))
    nfa.empty[first[1]].append(last[0])
    members = [frozenset(np.flatnonzero(machine.classes == c).tolist()) for c in range(machine.table.shape[1])]
    table = machine.table.tolist()
    steps = {s: [(c, m[1]) for c in range(len(members)) if members[c] & m[0]] for s, m in enumerate(nfa.moves) if m}
    todo = [(first[0], 0, 0)] if machine.hit != 0 else []
    seen = set(todo)
    while todo:
        state, n, at = todo.pop()
        if state == last[1] and n >= least:
            return False
        following = [(t, n, at) for t in nfa.empty[state]]
        following += [(t, min(least, n + (state >= n_head)), table[at][c]) for c, t in steps.get(state, ()) if table[at][c] != machine.hit]
        for x in following:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return True


class Spans:
    """The leftmost longest matches, one after the other, of every pattern in a string of bytes.

    One automaton of all patterns reads the string backwards and tells at each byte which patterns have a match that
    begins there. From the first such place, and then from the first behind each match, the pattern's own automaton
    runs on to the longest match. So a byte is read once backwards, and once more for each pattern that it matches.
    A pattern is (head, body); ``find`` tells where the longest head of a match ends.
    """

    def __init__(self, patterns: list[tuple[str, str]]) -> None:
        def plain(classes, table, accepts):
            dead = [bool((row == k).all() and not accepts[k]) for k, row in enumerate(table)]
            return classes.tobytes(), [r.tolist() for r in table], accepts.tolist(), dead

        self.begins = plain(*deterministic([h + b for h, b in patterns], restart=True, reverse=True))
        self.whole = [plain(*deterministic([h + b], restart=False)) for h, b in patterns]
        self.heads = [plain(*deterministic([h], restart=False)) if h else None for h, b in patterns]
        if any(machine[2][0] for machine in self.whole):
            raise ValueError("a pattern matches the empty string")

    @staticmethod
    def _longest(machine, text: bytes, at: int) -> int:
        classes, table, accepts, dead = machine
        state, end = 0, at
        for k in range(at, len(text)):
            state = table[state][classes[text[k]]]
            if dead[state]:
                break
            if accepts[state]:
                end = k + 1
        return end

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(pattern, start, end of the head, end) of each match, by pattern, then start."""
        classes, table, accepts, _ = self.begins
        state, places = 0, [[] for _ in self.whole]
        for at in range(len(text) - 1, -1, -1):
            state = table[state][classes[text[at]]]
            if accepts[state]:
                for k in range(len(places)):
                    if accepts[state] >> k & 1:
                        places[k].append(at)
        out = []
        for k, own in enumerate(places):
            free = 0
            for at in reversed(own):
                if at >= free:
                    free = self._longest(self.whole[k], text, at)
                    out.append((k, at, self._longest(self.heads[k], text, at) if self.heads[k] else at, free))
        return out


class Automaton:
    """Minimal automaton that finds whether any rule occurs anywhere in a string of bytes.

    ``classes``: 256 bytes to symbol classes; ``table``: (states, classes) next states; state 0 is the start, and
    ``hit`` the state in which some rule has occurred, never left again.
    """

    def __init__(self, patterns: list[str]) -> None:
        self.classes, self.table, accepts = deterministic(patterns, restart=True, sink=True)
        hit = np.flatnonzero(accepts)
        self.hit = int(hit[0]) if len(hit) else -1

    @staticmethod
    def _symbol_classes(sets) -> tuple[np.ndarray, list[int]]:
        distinct = sorted(set(sets), key=sorted)
        keys: dict[tuple, int] = {}
        classes = np.array([keys.setdefault(tuple(b in s for s in distinct), len(keys)) for b in range(256)], np.uint8)
        return classes, [int(np.flatnonzero(classes == k)[0]) for k in range(len(keys))]

    @staticmethod
    def _subsets(nfa: _Nfa, begin: int, accept: dict[int, int], members: list[int], restart: bool, sink: bool) -> tuple[np.ndarray, np.ndarray]:
        """(table, for each state the rules, as bits, that it accepts). ``restart``: a match may begin anywhere; ``sink``: a
        state that accepts is never left."""

        def closure(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.moves[s] or s in accept)

        start = closure([begin])
        ahead = {s: closure([m[1]]) for s, m in enumerate(nfa.moves) if m}
        by_class = [{s: ahead[s] for s, m in enumerate(nfa.moves) if m and b in m[0]} for b in members]
        end = frozenset(accept)
        numbers, todo, rows = {start: 0}, [start], []
        for current in todo:
            row = []
            for moves in by_class:
                found = current if sink and current == end else (start if restart else frozenset()).union(*(moves[s] for s in current if s in moves))
                if sink and found & end:
                    found = end
                if found not in numbers:
                    numbers[found] = len(numbers)
                    todo.append(found)
                row.append(numbers[found])
            rows.append(row)
        return np.array(rows, np.int32), np.array([sum({accept[x] for x in s if x in accept}) for s in numbers], np.int64)

    @staticmethod
    def _minimise(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moore's refinement: states stay together while they accept the same and their successors' blocks agree."""
        block = np.unique(accepts, return_inverse=True)[1].reshape(-1).astype(np.int64)
        while True:
            _, refined = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            refined = refined.reshape(-1)
            if refined.max() == block.max():
                break
            block = refined
        order = [block[0], *(b for b in range(block.max() + 1) if b != block[0])]
        renumber = np.empty(len(order), np.int64)
        renumber[order] = np.arange(len(order))
        first = np.array([int(np.flatnonzero(block == b)[0]) for b in order])
        return renumber[block[table[first]]].astype(np.int32), accepts[first]

    def scan(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, few: int = 64) -> np.ndarray:
        """Whether a rule occurs in each of the byte ranges, in one pass over their bytes.

        All ranges advance together, one byte a step, as lanes of one array; the last ``few`` (the longest) go on
        byte by byte.
        """
        width = self.table.shape[1]
        flat = (self.table * width).reshape(-1)
        symbols = self.classes[data]
        order = np.argsort(start - end, kind="stable")
        at, length = start[order].astype(np.int64), (end - start)[order]
        state = np.zeros(len(order), np.int32)
        step = 0
        bounds = np.searchsorted(-length, -np.arange(1, int(length[few]) + 1 if len(length) > few else 1), "right")
        for active in bounds:  # lanes longer than step
            state[:active] = flat[state[:active] + symbols[at[:active] + step]]
            step += 1
        rows = [r.tolist() for r in self.table]
        for lane in range(min(few, len(order))):
            s = int(state[lane]) // width
            for c in symbols[at[lane] + step : at[lane] + length[lane]].tobytes():
                s = rows[s][c]
            state[lane] = s * width
        out = np.zeros(len(order), bool)
        out[order] = state == self.hit * width
        return out
