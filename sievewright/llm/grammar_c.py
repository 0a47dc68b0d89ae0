"""C: statements and expressions by grammar; declarations widely, since macros stand anywhere in them."""

from __future__ import annotations

from .grammar_base import Grammar

_BINARY = frozenset("+ - * / % & | ^ << >> && || == != < > <= >= = += -= *= /= %= &= |= ^= <<= >>=".split())
_TYPES = ("const", "extern", "static", "inline", "unsigned", "signed", "long", "int", "short", "char", "float", "double", "void", "register", "volatile", "struct", "union", "enum", "typedef", "restrict", "auto")


class C(Grammar):
    #: The language's words.
    WORDS = frozenset(
        "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split()
    )
    BLOCKS = frozenset(("block", "file", "fields"))
    TOP = "file"
    NAMES = ("a", "A", "m")

    def file(self) -> None:
        while self.i < self.n:
            if self.i == 0 and self.group("{", "block"):
                continue  # the body after a list of old parameter declarations
            if not self.eat(";"):
                self.declaration(True)

    def fields(self) -> None:
        self.file()

    def words(self) -> int:
        """Names and words of types in a row: how many plain names are among them."""
        plain = 0
        run: list[str] = []
        while self.at(*_TYPES, *self.NAMES):
            run.append(self.now)
            self.i += 1
        for k in range(len(run) - 2):
            if run[k:k + 3] == ["a"] * 3:
                self.fail()  # three plain names are no declaration
        plain = sum(c == "a" for c in run)
        return plain

    def declaration(self, outer: bool) -> None:
        """A declaration, definition or use of a macro."""
        start = self.i
        if self.at("extern") and self.t[self.i + 1] == '"':
            self.i += 2
            if self.group("{", "file"):
                return
        if outer and self.at("A", "m", "a") and self.t[self.i + 1] in ("(", "()") and self.t[self.i + 2] in ("", "A", "m", "extern", "static", "typedef", "struct", "int", "void", "const", "enum"):
            self.i += 1  # a macro's call without a semicolon
            self.skip()
            return
        while True:
            before = self.i
            self.words()
            self.typed_group()
            while self.eat("*", "^"):
                pass
            if self.at("[", "[]") and self.t[self.i + 1][:1] == "[" and self.i == start:
                self.skip()
            if self.i == before:
                break
        if self.i == start and not self.at("(", "()"):
            self.fail()
        self.declarators(outer)
        if self.i == start:
            self.fail()

    def typed_group(self) -> None:
        """The body of a structure, or the arguments of an attribute or macro between the words of a declaration."""
        before = self.t[self.i - 1] if self.i else ""
        if self.at("{", "{}"):
            kinds = self.t[max(0, self.i - 5):self.i]
            if "enum" in kinds:
                self.group("{", "enumerators")
            elif "struct" in kinds or "union" in kinds:
                self.group("{", "fields")
        elif self.at("(", "()") and before in ("A", "m") and self.t[self.i + 1] in (*_TYPES, *self.NAMES, "*", "{", "{}"):
            if self.t[self.i + 1] in ("{", "{}"):
                return
            self.skip()

    def declarators(self, outer: bool) -> None:
        while True:
            self.after_name(outer)
            if self.eat("="):
                self.value()
            if self.t[self.i - 1][:1] == "{" and not self.at(";", ","):
                return
            if self.eat(","):
                while self.eat("*", "const", "restrict", "volatile", *self.NAMES):
                    pass
                continue
            break
        if self.group("{", "block"):
            return
        if not self.eat(";"):
            if outer and self.i >= self.n:
                return  # the last one of a header may be a macro's
            self.fail()

    def after_name(self, outer: bool) -> None:
        """Parameters, lengths, bit widths, attributes after a declared name, and old parameter lists."""
        while True:
            if self.at("(", "()"):
                inner = "params" if self.i and self.t[self.i - 1][:1] in ("a", "A", "m", "(", ")") else "params"
                self.group("(", inner)
            elif self.group("[", "index"):
                pass
            elif self.at(":") and self.t[self.i + 1] in ("0", "a", "A", "m", "("):
                self.i += 1
                self.expr()
            elif self.eat('"') and self.t[self.i - 2] in ("a", "A", "m", '"', ")") or self.at(*self.NAMES, "const", "inline", "volatile", "*"):
                if self.at("*") and self.t[self.i - 1][:1] not in ("A", "m", "(", "*", "c"):
                    self.fail()
                if self.at(*self.NAMES, "const", "inline", "volatile", "*"):
                    self.i += 1
            elif outer and self.at(*_TYPES) and self.t[self.i - 1][:1] == "(":
                # old parameter declarations before the body
                while not self.at("{", "{}", ""):
                    if self.now[:1] in ("(", "["):
                        self.skip()
                    else:
                        self.i += 1
                    if self.at(";"):
                        self.i += 1
                        return
                self.fail()
            else:
                return

    def params(self) -> None:
        """Parameters or arguments: both, since a declaration looks like a call."""
        if self.n == 1 and self.at("*", "&"):
            self.i = 1
            return
        self.listed(self.param, last=False)

    def param(self) -> None:
        if self.eat("..."):
            return
        if not self.attempt(self.typed):
            self.expr()

    def typed(self) -> None:
        start = self.i
        while True:
            before = self.i
            self.words()
            self.typed_group()
            while self.eat("*", "^"):
                pass
            if self.i == before:
                break
        if self.i == start:
            self.fail()
        while self.group("(", "params") or self.group("[", "index") or self.eat(*self.NAMES):
            pass
        if self.eat("..."):
            pass
        if self.i < self.n and not self.at(","):
            self.fail()

    def enumerators(self) -> None:
        def one() -> None:
            self.need(*self.NAMES)
            self.group("(", "params")
            while self.eat(*self.NAMES):
                self.group("(", "params")
            if self.eat("="):
                self.expr()

        self.listed(one)

    def value(self) -> None:
        if not self.group("{", "elements"):
            self.expr()

    def elements(self) -> None:
        def one() -> None:
            if self.at("{", "{}"):
                self.group("{", "elements")
                return
            while self.at(".", "[") and self.t[self.i + 1][:1] != "":
                if self.eat("."):
                    self.need(*self.NAMES)
                else:
                    self.group("[", "index")
                if not self.at(".", "["):
                    self.eat("=")
            if self.at("a", "A", "m") and self.t[self.i + 1] == ":" and self.t[self.i + 2] not in ("",):
                self.i += 2
            self.value()

        self.listed(one)

    # ---- statements
    def block(self) -> None:
        while self.i < self.n:
            self.statement()

    def statement(self) -> None:
        if self.eat(";") or self.group("{", "block"):
            return None
        if self.at(*self.NAMES) and self.t[self.i + 1] == ":":
            self.i += 2
            return None
        if self.eat("if", "while"):
            self.need_group("(", "condition", False)
            if self.i < self.n:
                self.statement()
            else:
                self.fail()
            if self.eat("else"):
                self.statement()
            return None
        if self.eat("else"):
            return self.statement()
        if self.eat("switch"):
            self.need_group("(", "condition", False)
            return self.statement()
        if self.eat("for"):
            self.need_group("(", "loop", False)
            return self.statement()
        if self.eat("do"):
            self.statement()
            if self.i >= self.n:
                return None  # the condition follows in the next piece
            self.need("while")
            self.need_group("(", "condition", False)
            return self.need(";")
        if self.eat("return"):
            if not self.at(";"):
                self.value()
            return self.need(";")
        if self.eat("break", "continue"):
            return self.need(";")
        if self.eat("goto"):
            if self.eat("*"):
                self.expr()
            else:
                self.need(*self.NAMES)
            return self.need(";")
        if self.eat("case"):
            self.expr()
            if self.eat("..."):
                self.expr()
            return self.need(":")
        if self.eat("default"):
            return self.need(":")
        if self.at("a", "m") and self.t[self.i + 1] in ("volatile", "goto", "(") and self.attempt(self.assembly):
            return None
        if self.attempt(self.expression):
            return None
        return self.declaration(False)

    def assembly(self) -> None:
        self.need("a", "m")
        while self.eat("volatile", "goto", "inline"):
            pass
        if self.t[self.i - 1] in ("a", "m"):
            self.fail()
        self.skip()
        self.need(";")

    def expression(self) -> None:
        self.exprs()
        if self.at("{", "{}") and self.t[self.i - 1][:1] == "(":
            self.group("{", "block")  # a macro that is a loop
            return
        if self.t[self.i - 1][:1] == "(" and (self.at("A", "m", "a", "if", "return", "for", "while") or self.i >= self.n) and self.t[self.i - 2] in ("A", "m"):
            return  # a macro's call without a semicolon
        self.need(";")

    def loop(self) -> None:
        if self.at("a", "A", "m", *_TYPES) and self.attempt(self.loop_declaration):
            pass
        elif not self.at(";"):
            self.exprs()
            self.need(";")
        else:
            self.need(";")
        if not self.at(";"):
            self.exprs()
        self.need(";")
        if self.i < self.n:
            self.exprs()

    def loop_declaration(self) -> None:
        self.words()
        while self.eat("*"):
            self.words()
        self.declarators(False)
        if self.t[self.i - 1] != ";":
            self.fail()

    def condition(self) -> None:
        self.exprs()

    def index(self) -> None:
        while self.eat("static", "const", "restrict", "volatile"):
            pass
        if self.i < self.n:
            self.expr()

    # ---- expressions
    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def expr(self) -> None:
        self.operand()
        while True:
            if self.now in _BINARY:
                self.i += 1
            elif self.eat("?"):
                if not self.at(":"):
                    self.exprs()
                self.need(":")
            else:
                return
            self.operand()

    def operand(self) -> None:
        while self.eat("+", "-", "!", "~", "*", "&", "&&", "++", "--", "sizeof"):
            pass
        if self.at("(", "()"):
            after = self.t[self.i + 1]
            if after in ("a", "A", "m", "0", '"', "(", "!", "~", "sizeof", "{", "{}"):
                self.need_group("(", "cast")
                if not self.group("{", "elements"):
                    return self.operand()
            else:
                self.need_group("(", "paren", self.t[self.i - 1] == "sizeof")
        elif self.eat('"'):
            while self.eat('"', "A") or self.at("m", "a") and self.t[self.i + 1] == '"' and self.eat("m", "a"):
                pass
        elif self.eat("A", "m", "a"):
            while self.at('"') and self.t[self.i - 1] in ("A", '"') or self.at("A") and self.t[self.i - 1] in ("A", '"') or self.at('"') and self.t[self.i - 1] in ("m", "a") and self.i >= 2 and self.t[self.i - 2] == '"' or self.at('"') and self.t[self.i - 1] == "a" and self.t[self.i + 1] in (",", "", ";"):
                self.i += 1
        elif self.at("struct", "union", "enum", "const", "unsigned", "signed", "long", "int", "short", "char", "float", "double", "void", "volatile") and self.t[self.i - 1] in (",", "(", "") or self.at(*_TYPES):
            self.words()  # a type as a macro's argument
            while self.eat("*"):
                pass
        elif not self.eat("0"):
            self.fail()
        while True:
            if self.eat(".", "->"):
                self.need(*self.NAMES)
            elif not (self.group("(", "args") or self.group("[", "condition", False) or self.eat("++", "--")):
                return

    def args(self) -> None:
        self.params()

    def paren(self) -> None:
        if self.group("{", "block"):
            return
        if not self.attempt(self.whole):
            self.typed()

    def whole(self) -> None:
        self.exprs()
        if self.i < self.n:
            self.fail()

    def cast(self) -> None:
        self.paren()
