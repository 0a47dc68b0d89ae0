"""What the local grammars share: a cursor over codes, groups with roles, trying and going back.

Codes: words and operators stand for themselves, other names are ``a``, numbers ``0``, strings ``"``;
a group is its opening bracket, with the closing one too if it is empty. A leading mark says that
the code begins a line.
"""

from __future__ import annotations


class Fault(Exception):
    """A sequence that its grammar does not take."""


class Grammar:
    WORDS: frozenset[str] = frozenset()
    BLOCKS: frozenset[str] = frozenset()
    TOP = "block"

    def __init__(self, codes: list[str]):
        self.n = len(codes)
        self.t = [c.lstrip("¶") for c in codes] + ["", "", ""]
        self.lines = [c[0] == "¶" for c in codes] + [True] * 3
        self.i = self.far = 0
        self.roles: list[str] = []

    # ---- the cursor
    @property
    def now(self) -> str:
        return self.t[self.i]

    def at(self, *codes: str) -> bool:
        return self.t[self.i] in codes

    def eat(self, *codes: str) -> bool:
        if self.t[self.i] in codes and self.i < self.n:
            self.i += 1
            return True
        return False

    def need(self, *codes: str) -> None:
        if not self.eat(*codes):
            self.fail()

    def fail(self) -> None:
        self.far = max(self.far, self.i)
        raise Fault

    def group(self, bracket: str, role: str, empty: bool = True) -> bool:
        """Whether a group of this bracket stands here; if so it is taken and has the role."""
        c = self.t[self.i]
        if not c or c[0] != bracket:
            return False
        if len(c) == 2 and not empty:
            self.fail()
        if len(c) == 1:  # an empty group has nothing to read
            self.roles.append(role)
        self.i += 1
        return True

    def skip(self) -> None:
        """Takes the group that stands here; nothing is asked of its tokens."""
        if self.now[:1] not in ("(", "[", "{") or not self.now:
            self.fail()
        self.group(self.now[0], "any")

    def need_group(self, bracket: str, role: str, empty: bool = True) -> None:
        if not self.group(bracket, role, empty):
            self.fail()

    def attempt(self, f, *args) -> bool:
        """Whether f can be read here; if not, nothing is."""
        i, r = self.i, len(self.roles)
        try:
            if f(*args) is False:
                raise Fault
            return True
        except Fault:
            self.i = i
            del self.roles[r:]
            return False

    def listed(self, f, *args, between: str = ",", last: bool = True) -> None:
        """f, any number of times, to the end of the sequence; ``last``: the separator may end it."""
        while self.i < self.n:
            f(*args)
            if self.i < self.n:
                self.need(between)
                if self.i == self.n and not last:
                    self.fail()

    def read(self, role: str) -> None:
        getattr(self, role)()

    def any(self) -> None:
        self.roles += ["any"] * sum(c in ("(", "[", "{") for c in self.t[self.i:self.n])
        self.i = self.n
