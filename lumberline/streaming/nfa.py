"""Row patterns as small automata that take one row at a time.

States are tried in the order in which a backtracking search would try them, so the
match found is the one such a search prefers (greedy, lazy and alternatives alike).
"""

from __future__ import annotations

from functools import cache
from re import _constants as sre
from re import _parser
from typing import Any

MATCH, ONE, SPLIT = "match", "one", "split"


class _Compiler:
    def __init__(self):
        self.program: list[tuple] = []

    def add(self, *step) -> int:
        self.program.append(step)
        return len(self.program) - 1

    def sequence(self, parts) -> None:
        for op, value in parts:
            self.part(op, value)

    def part(self, op, value) -> None:
        if op is sre.LITERAL:
            self.add(ONE, frozenset((chr(value),)), False)
        elif op is sre.NOT_LITERAL:
            self.add(ONE, frozenset((chr(value),)), True)
        elif op is sre.ANY:
            self.add(ONE, frozenset("\n"), True)
        elif op is sre.IN:
            self.add(ONE, *_letters(value))
        elif op is sre.SUBPATTERN:
            self.sequence(value[3])
        elif op is sre.BRANCH:
            self.branches(value[1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            self.repeat(*value, greedy=op is sre.MAX_REPEAT)
        else:
            raise ValueError(f"a row pattern has no {str(op).lower()}")

    def branches(self, alternatives) -> None:
        ends = []
        for parts in alternatives[:-1]:
            split = self.add()
            self.sequence(parts)
            ends.append(self.add())
            self.program[split] = (SPLIT, (split + 1, len(self.program)))
        self.sequence(alternatives[-1])
        for end in ends:
            self.program[end] = (SPLIT, (len(self.program),))

    def repeat(self, least: int, most: int, parts, greedy: bool) -> None:
        for _ in range(least):
            self.sequence(parts)
        splits = []
        for _ in range(most - least):
            splits.append(self.add())
            self.sequence(parts)
        end = len(self.program)
        for split in splits:
            self.program[split] = (SPLIT, (split + 1, end) if greedy else (end, split + 1))


def _letters(items) -> tuple[frozenset, bool]:
    negated, letters = False, set()
    for op, value in items:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            letters.add(chr(value))
        elif op is sre.RANGE:
            letters.update(map(chr, range(value[0], value[1] + 1)))
        else:
            raise ValueError(f"a row pattern's set has no {str(op).lower()}")
    return frozenset(letters), negated


@cache
def compiled(pattern: str) -> tuple[tuple, ...]:
    """The steps of a pattern with bounded repeats: one letter, a choice of next steps in order, or the end."""
    compiler = _Compiler()
    compiler.sequence(_parser.parse(pattern))
    compiler.add(MATCH)
    return tuple(compiler.program)


class Matcher:
    """A match that began at some row: the steps it may be at, best first, and its best end so far."""

    def __init__(self, program, states: list[int] | None = None, length: int = 0, best: int = 0, best_mark: Any = None):
        self.program, self.length, self.best, self.best_mark = program, length, best, best_mark
        self.states = self._reach([0], None) if states is None else states

    def _reach(self, steps: list[int], mark: Any) -> list[int]:
        """The letter steps behind ``steps``, in order, up to the first way to end here."""
        out, seen, todo = [], set(), steps[::-1]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            kind, *rest = self.program[at]
            if kind == ONE:
                out.append(at)
            elif kind == SPLIT:
                todo.extend(reversed(rest[0]))
            else:
                self.best, self.best_mark = self.length, mark
                break  # ways behind this one are worse than ending here
        return out

    def feed(self, symbol: str | None, mark: Any) -> bool:
        """Take one row; whether the match may still go on. Then ``best`` rows match (0: none)."""
        self.length += 1
        passed = [at + 1 for at in self.states if symbol is not None and self._is(at, symbol)]
        self.states = self._reach(passed, mark)
        return bool(self.states)

    def _is(self, at: int, symbol: str) -> bool:
        _, letters, negated = self.program[at]
        return len(symbol) == 1 and (symbol in letters) != negated
