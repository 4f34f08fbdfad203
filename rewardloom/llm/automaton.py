"""Rules as one deterministic automaton over bytes.

A small regex dialect (literals, escapes, ``.``-free classes, groups, ``|``, ``? * + {m} {m,} {m,n}``, ``(?i:...)``) becomes
a nondeterministic automaton; subset construction over classes of equal bytes makes it deterministic for search
anywhere in a text, and partition refinement minimises it. What remains are transition arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rewardloom.llm.common import constants, mix


class _Parser:
    """Text to nodes: ("set", frozenset), ("seq", [..]), ("alt", [..]), ("rep", node, least, most or None)."""

    def __init__(self, text: str, counted: int | None = None):
        self.text, self.at, self.counted = text, 0, counted

    def peek(self) -> str:
        return self.text[self.at: self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self, fold: bool):
        options = [self.sequence(fold)]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence(fold))
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(fold))
        return ("seq", parts)

    def repeated(self, fold: bool):
        node = self.atom(fold)
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            if mark == "{":
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at: end].partition(",")
                least, most = int(low), int(high) if high else None if "," in self.text[self.at: end] else int(low)
                if self.counted is not None and least > self.counted:
                    least, most = self.counted, None
                node = ("rep", node, least, most)
                self.at = end + 1
            else:
                node = ("rep", node, int(mark == "+"), 1 if mark == "?" else None)
        return node

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.text.startswith("?i:", self.at):
                self.at += 3
                fold = True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            node = self.either(fold)
            self.take()
            return node
        if c == "[":
            return ("set", self.members(fold))
        return ("set", _folded({ord(self.escaped() if c == "\\" else c)}, fold))

    def escaped(self) -> str:
        c = self.take()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2: self.at], 16))
        return {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)

    def members(self, fold: bool) -> frozenset[int]:
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = ord(self.escaped() if c == "\\" else c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                c = self.take()
                high = ord(self.escaped() if c == "\\" else c)
            found |= set(range(low, high + 1))
        self.at += 1
        return _folded(found, fold)


def _folded(codes: set[int], fold: bool) -> frozenset[int]:
    if fold:
        codes = codes | {ord(chr(c).swapcase()) for c in codes if c < 128}
    return frozenset(codes)


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Build ``node`` from ``start``; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "seq":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.add(part, start)
                self.free[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + byte_class[byte]]`` is the next state; ``accept[state]`` has a bit per rule that ends there."""

    byte_class: np.ndarray
    classes: int
    table: np.ndarray
    accept: np.ndarray
    resets: np.ndarray  # bytes after which the automaton is in its first state, whatever it has read

    @property
    def states(self) -> int:
        return len(self.accept)


def compile_rules(rules: list[tuple[str, int | None]], most_states: int = 100_000) -> Automaton:
    """One automaton that finds every rule anywhere; bit i of ``accept`` stands for rule i.

    A rule is a regex and the largest repeat count that the automaton itself counts (None: all of them). Counters
    multiply the states, so longer ones may be left to an exact check: what is found is then a superset.
    """
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for i, (rule, counted) in enumerate(rules):
        start = nfa.state()
        nfa.free[root].append(start)
        end = nfa.add(_Parser(rule, counted).either(False), start)
        final[end] = final.get(end, 0) | 1 << i
    sets = list({s for moves in nfa.moves for s, _ in moves})
    patterns: dict[tuple[bool, ...], int] = {}
    byte_class = np.array([patterns.setdefault(tuple(b in s for s in sets), len(patterns)) for b in range(256)], np.uint8)
    example = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(patterns))]

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in final)

    # Sets of states are integers with a bit per state.
    closure = [sum(1 << t for t in closed([s])) for s in range(len(nfa.moves))]
    first = closure[root]
    steps = []
    for moves in nfa.moves:
        row = [0] * len(example)
        for s, t in moves:
            row = [x | closure[t] if b in s else x for x, b in zip(row, example, strict=True)]
        steps.append(row)
    known: dict[int, int] = {first: 0}
    order, table = [first], []
    for states in order:  # grows while it is read
        row = [first] * len(example)  # a match may begin at every byte
        rest = states
        while rest:
            low = rest & -rest
            row = [x | y for x, y in zip(row, steps[low.bit_length() - 1], strict=True)]
            rest ^= low
        for target in row:
            if target not in known:
                if len(order) >= most_states:
                    raise ValueError(f"the rules need more than {most_states} states")
                known[target] = len(order)
                order.append(target)
        table.append([known[x] for x in row])
    accept = np.zeros(len(order), np.int64)
    for end, bit in final.items():
        accept[[i for i, states in enumerate(order) if states >> end & 1]] |= bit
    return _minimised(np.array(table, np.int64), accept, byte_class)


def _minimised(table: np.ndarray, accept: np.ndarray, byte_class: np.ndarray) -> Automaton:
    """Merge states that no continuation tells apart, by refining the partition until it stands."""
    _, block = np.unique(accept, return_inverse=True)
    scales = constants(31, table.shape[1] + 1)
    while True:
        rows = np.column_stack([block, block[table]]).astype(np.uint64)
        _, finer = np.unique(mix(rows * scales).sum(1, dtype=np.uint64), return_inverse=True)  # rows by a 64-bit hash
        if finer.max() == block.max():
            break
        block = finer
    _, head = np.unique(block, return_index=True)
    renumber = np.argsort(np.argsort(head))  # blocks in order of their first state: the start stays 0
    small = np.empty((len(head), table.shape[1]), np.int32)
    marks = np.empty(len(head), np.int64)
    small[renumber] = renumber[block[table[head]]]
    marks[renumber] = accept[head]
    resets = np.flatnonzero((small == 0).all(0)[byte_class])
    return Automaton(byte_class, table.shape[1], small.ravel(), marks, resets)


_LONG = 16  # with fewer lanes left a plain loop is faster


def scan(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rules (as bits) that end in each lane ``starts[i]:ends[i]``; all lanes advance one byte at a time."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    classes = automaton.byte_class[data]
    width, table, accept = automaton.classes, automaton.table, automaton.accept
    marked = accept != 0
    state = np.zeros(len(starts), np.int32)
    found = np.zeros(len(starts), np.int64)
    active = len(starts)
    at = 0
    while active:
        while active and lengths[active - 1] <= at:
            active -= 1
        if active <= _LONG:
            break
        now = table[state[:active] * width + classes[starts[:active] + at]]
        state[:active] = now
        hit = marked[now]
        if hit.any():
            found[:active][hit] |= accept[now[hit]]
        at += 1
    if active:
        steps, ends_in = table.tolist(), accept.tolist()
        for lane in range(active):
            s, f = int(state[lane]), int(found[lane])
            for c in classes[starts[lane] + at: starts[lane] + lengths[lane]].tolist():
                s = steps[s * width + c]
                f |= ends_in[s]
            found[lane] = f
    out = np.empty(len(found), np.int64)
    out[order] = found
    return out
