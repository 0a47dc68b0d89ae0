"""Go: declarations, types, statements and expressions. Line ends are semicolons already."""

from __future__ import annotations

from .grammar_base import Grammar

_BINARY = frozenset("+ - * / % & | ^ << >> &^ && || == != < > <= >=".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class Go(Grammar):
    #: The language's words.
    WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    BLOCKS = frozenset(("block", "file", "fields", "methods", "imports", "specs", "types_of"))
    TOP = "file"

    def stop(self) -> None:
        if self.i < self.n:
            self.need(";")

    def file(self) -> None:
        while self.i < self.n:
            if self.eat(";"):
                continue
            if self.eat("package"):
                self.need("a")
            elif self.eat("import"):
                self.group("(", "imports") or self.import_spec()
            elif self.at("const", "var", "type"):
                self.declaration()
            elif self.eat("func"):
                self.group("(", "params")
                self.need("a")
                if self.group("[", "params"):
                    pass
                self.signature()
                self.group("{", "block")
            else:
                self.fail()
            self.stop()

    def import_spec(self) -> None:
        self.eat("a", ".")
        self.need('"')

    def imports(self) -> None:
        while self.i < self.n:
            if not self.eat(";"):
                self.import_spec()
                self.stop()

    def declaration(self) -> None:
        kind = self.now
        self.i += 1
        if kind == "type":
            self.group("(", "types_of") or self.type_spec()
        else:
            self.group("(", "specs") or self.spec()

    def types_of(self) -> None:
        while self.i < self.n:
            if not self.eat(";"):
                self.type_spec()
                self.stop()

    def type_spec(self) -> None:
        self.need("a")
        if self.now[:1] == "[" and self.t[self.i + 1] not in (";", ""):
            # parameters of a generic type, or the length of an array: both end before a type
            self.skip()
        self.eat("=")
        self.type()

    def specs(self) -> None:
        while self.i < self.n:
            if not self.eat(";"):
                self.spec()
                self.stop()

    def spec(self) -> None:
        self.need("a")
        while self.eat(","):
            self.need("a")
        if not self.at("=", ";", ""):
            self.type()
        if self.eat("="):
            self.exprs()

    # ---- types
    def type(self) -> None:
        self.one_type()
        while self.at("|"):
            self.i += 1
            self.one_type()

    def one_type(self) -> None:
        while self.eat("*", "~"):
            pass
        if self.group("[", "length"):
            return self.one_type()
        if self.eat("map"):
            self.need_group("[", "one_type_in")
            return self.one_type()
        if self.eat("chan"):
            self.eat("<-")
            return self.one_type()
        if self.eat("<-"):
            self.need("chan")
            return self.one_type()
        if self.eat("func"):
            return self.signature()
        if self.eat("struct"):
            return self.need_group("{", "fields")
        if self.eat("interface"):
            return self.need_group("{", "methods")
        if self.group("(", "one_type_in", False):
            return None
        self.need("a")
        if self.eat("."):
            self.need("a")
        if self.now == "[" :
            self.group("[", "type_args")
        return None

    def one_type_in(self) -> None:
        self.type()
        self.eat(",")

    def length(self) -> None:
        if self.i < self.n and not self.eat("..."):
            self.expr()

    def type_args(self) -> None:
        # of a generic type, or the length of an array after a name
        def one() -> None:
            if not self.attempt(self.type) or self.i < self.n and not self.at(","):
                self.fail()

        if not self.attempt(self.listed, one):
            self.expr()

    def signature(self) -> None:
        self.need_group("(", "params")
        if self.group("(", "params"):
            return
        if self.at("a", "*", "[", "[]", "map", "chan", "<-", "func", "struct", "interface"):
            self.one_type()

    def params(self) -> None:
        def one() -> None:
            self.eat("...") or True
            self.type()
            if self.i < self.n and not self.at(","):
                self.eat("...")
                self.type()

        self.listed(one)

    def fields(self) -> None:
        while self.i < self.n:
            if self.eat(";"):
                continue
            self.type()
            while self.eat(","):
                self.need("a")
            if not self.at(";", "", '"'):
                self.type()
            self.eat('"')
            self.stop()

    def methods(self) -> None:
        while self.i < self.n:
            if self.eat(";"):
                continue
            if self.at("a") and self.t[self.i + 1][:1] == "(":
                self.i += 1
                self.signature()
            else:
                self.type()
            self.stop()

    # ---- statements
    def block(self) -> None:
        while self.i < self.n:
            if self.eat(";"):
                continue
            if self.eat("case"):
                self.cases()
                continue
            if self.eat("default"):
                self.need(":")
                continue
            if self.at("a") and self.t[self.i + 1] == ":":
                self.i += 2
                continue
            self.statement()
            self.stop()

    def cases(self) -> None:
        def one() -> None:
            if not self.attempt(self.simple_case):
                self.type()

        one()
        while self.eat(","):
            one()
        self.need(":")

    def simple_case(self) -> None:
        self.simple(True)
        if not self.at(",", ":"):
            self.fail()

    def statement(self) -> None:
        if self.at("if"):
            return self.branch()
        if self.eat("for"):
            if not self.at("{", "{}"):
                self.header(True)
            return self.need_group("{", "block")
        if self.eat("switch"):
            if not self.at("{", "{}"):
                self.header(False)
            return self.need_group("{", "block")
        if self.eat("select"):
            return self.need_group("{", "block")
        if self.eat("return"):
            if not self.at(";", ""):
                self.exprs()
            return None
        if self.eat("go", "defer"):
            return self.expr()
        if self.eat("break", "continue", "goto"):
            self.eat("a")
            return None
        if self.eat("fallthrough"):
            return None
        if self.at("const", "var", "type"):
            return self.declaration()
        if self.group("{", "block"):
            return None
        return self.simple(True)

    def branch(self) -> None:
        self.need("if")
        if self.at("{", "{}", ";"):
            self.fail()
        self.header(False)
        if self.t[self.i - 1] == ";":
            self.fail()  # no condition
        self.need_group("{", "block")
        if self.eat("else"):
            if self.at("if"):
                self.branch()
            else:
                self.need_group("{", "block")

    def header(self, loop: bool) -> None:
        for _ in range(3 if loop else 2):
            if not self.at(";", "{", "{}"):
                if self.eat("range"):
                    self.expr(False)
                else:
                    self.simple(False)
            if not self.eat(";"):
                return

    def simple(self, braces: bool) -> None:
        self.exprs(braces)
        if self.now in _ASSIGN:
            self.i += 1
            if self.eat("range"):
                self.expr(braces)
            else:
                self.exprs(braces)
        elif not self.eat("++", "--") and self.eat("<-"):
            self.expr(braces)

    # ---- expressions
    def exprs(self, braces: bool = True) -> None:
        self.expr(braces)
        while self.eat(","):
            self.expr(braces)

    def expr(self, braces: bool = True) -> None:
        self.operand(braces)
        while self.now in _BINARY:
            self.i += 1
            self.operand(braces)

    def operand(self, braces: bool) -> None:
        while self.eat("+", "-", "!", "^", "*", "&", "<-", "~"):
            pass
        if self.eat("0", '"'):
            named = False
        elif self.eat("a"):
            named = True
        elif self.group("(", "paren", False):
            named = False
        elif self.eat("func"):
            self.signature()
            self.group("{", "block")
            named = False
        else:
            if not self.at("[", "[]", "map", "chan", "struct", "interface"):
                self.fail()
            self.one_type()
            if self.group("{", "elements"):
                pass
            named = False
        while True:
            if self.eat("."):
                if not self.group("(", "asserted", False):
                    self.need("a")
                continue
            if self.group("[", "index", False):
                continue
            if self.group("(", "args"):
                named = False
                continue
            if named and braces and self.group("{", "elements"):
                named = False
                continue
            return

    def asserted(self) -> None:
        self.eat("type") or self.type()

    def paren(self) -> None:
        if not self.attempt(self.whole_expr):
            self.type()

    def whole_expr(self) -> None:
        self.expr()
        if self.i < self.n:
            self.fail()

    def index(self) -> None:
        def slice_() -> None:
            for k in range(3):
                if self.i < self.n and not self.at(":"):
                    self.expr()
                if self.i == self.n:
                    return
                self.need(":")
            self.fail()

        if not self.attempt(self.listed_types):
            slice_()

    def listed_types(self) -> None:
        self.listed(self.type)

    def args(self) -> None:
        def one() -> None:
            if not self.attempt(self.arg):
                self.type()

        self.listed(one)

    def arg(self) -> None:
        self.expr()
        self.eat("...")
        if self.i < self.n and not self.at(","):
            self.fail()

    def elements(self) -> None:
        def value() -> None:
            if not self.group("{", "elements"):
                self.expr()

        def one() -> None:
            value()
            if self.eat(":"):
                value()

        self.listed(one)
