"""Java: declarations, types, statements and expressions."""

from __future__ import annotations

from .grammar_base import Grammar

_BINARY = frozenset("+ - * / % & | ^ && || == != < <= << = += -= *= /= %= &= |= ^= <<=".split())
_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
_PRIMITIVE = ("int", "long", "short", "byte", "char", "float", "double", "boolean", "void")


class Java(Grammar):
    #: The language's words.
    WORDS = frozenset(
        "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while record sealed permits yield when non var module open requires exports opens uses provides with to".split()
    )
    SOFT = ("record", "sealed", "permits", "yield", "when", "non", "var", "module", "open", "requires", "exports", "opens", "uses", "provides", "with", "to")
    BLOCKS = frozenset(("block", "file", "members", "any_block"))
    TOP = "file"

    def name(self) -> None:
        self.need("a", *self.SOFT)

    def file(self) -> None:
        while self.i < self.n:
            if self.eat(";"):
                continue
            self.attempt(self.modifiers)
            if self.eat("package"):
                self.dotted()
                self.need(";")
            elif self.eat("import"):
                self.eat("static", "module")
                self.name()
                while self.eat("."):
                    if self.eat("*"):
                        break
                    self.name()
                self.need(";")
            elif self.at("open", "module") and self.t[self.i + 1] in ("a", "module"):
                self.eat("open")
                self.need("module")
                self.dotted()
                self.need_group("{", "any")
            elif not self.type_declaration():
                self.member()  # a file of its own without a class

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.t[self.i + 1] != "interface":
                self.i += 1
                self.dotted()
                self.group("(", "annotation")
            elif self.now in _MODIFIERS and not (self.at("default") and self.t[self.i + 1] in (":", "->")) and not (self.at("sealed") and self.t[self.i + 1] in ("=", ".", ";", ",")) and not (self.at("synchronized") and self.t[self.i + 1][:1] == "("):
                self.i += 1
            elif self.at("non") and self.t[self.i + 1] == "-" and self.t[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def annotation(self) -> None:
        def one() -> None:
            if self.at("a", *self.SOFT) and self.t[self.i + 1] == "=":
                self.i += 2
            self.annotation_value()

        self.listed(one, last=False)

    def annotation_value(self) -> None:
        if self.at("@"):
            self.i += 1
            self.dotted()
            self.group("(", "annotation")
        elif not self.group("{", "annotation_values"):
            self.expr()

    def annotation_values(self) -> None:
        self.listed(self.annotation_value)

    # ---- types
    def annotations(self) -> None:
        while self.at("@") and self.t[self.i + 1] == "a":
            self.i += 1
            self.dotted()
            self.group("(", "annotation")

    def type(self) -> None:
        self.annotations()
        if not self.eat(*_PRIMITIVE):
            while True:
                self.annotations()
                self.name()
                if self.at("<"):
                    self.arguments()
                if not (self.at(".") and self.t[self.i + 1] in ("a", "@", *self.SOFT)):
                    break
                self.i += 1
        while True:
            self.annotations()
            if not self.eat("[]"):
                return

    def arguments(self) -> None:
        self.need("<")
        if self.eat(">"):
            return
        while True:
            self.annotations()
            if self.eat("?"):
                if self.eat("extends", "super"):
                    self.type()
            else:
                self.type()
            if self.eat(">"):
                return
            self.need(",")

    def parameters_of_type(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.name()
            if self.eat("extends"):
                self.type()
                while self.eat("&"):
                    self.type()
            if self.eat(">"):
                return
            self.need(",")

    def type_list(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    # ---- declarations
    def type_declaration(self) -> bool:
        if self.at("@") and self.t[self.i + 1] == "interface":
            self.i += 1
        record = self.at("record") and self.t[self.i + 1] == "a" and self.t[self.i + 2] in ("(", "()", "<")
        if not (self.at("class", "interface", "enum") or record):
            return False
        kind = self.now
        self.i += 1
        self.name()
        if self.at("<"):
            self.parameters_of_type()
        if kind == "record":
            self.need_group("(", "params")
        while self.eat("extends", "implements", "permits"):
            self.type_list()
        self.need_group("{", "constants" if kind == "enum" else "members")
        return True

    def constants(self) -> None:
        while self.i < self.n and not self.at(";"):
            self.annotations()
            self.name()
            self.group("(", "args")
            self.group("{", "members")
            if not self.at(";", ""):
                self.need(",")
        if self.eat(";"):
            self.members()

    def members(self) -> None:
        while self.i < self.n:
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        self.modifiers()
        if self.group("{", "block") or self.type_declaration():
            return
        if self.at("<"):
            self.parameters_of_type()
            self.annotations()
        if self.at("a", *self.SOFT) and self.t[self.i + 1][:1] in ("(", "{"):  # a constructor
            self.i += 1
            self.group("(", "params")
        else:
            self.type()
            self.name()
            if not self.group("(", "params"):
                self.declarators()
                self.need(";")
                return
            while self.eat("[]"):
                pass
        if self.eat("throws"):
            self.type_list()
        if self.eat("default"):
            self.annotation_value()
        if not self.eat(";"):
            self.need_group("{", "block")

    def params(self) -> None:
        def one() -> None:
            self.modifiers()
            self.type()
            self.annotations()
            self.eat("...")
            if self.eat("this"):
                return
            if self.at(".") or self.i >= self.n or self.at(","):
                self.fail()
            self.name()
            if self.eat("."):
                self.need("this")
            while self.eat("[]"):
                pass

        self.listed(one, last=False)

    def declarators(self) -> None:
        """The rest of a declaration after its first name."""
        while True:
            while self.eat("[]"):
                pass
            if self.eat("="):
                self.value()
            if not self.eat(","):
                return
            self.name()

    def value(self) -> None:
        if not self.group("{", "elements"):
            self.expr()

    def elements(self) -> None:
        if self.at(",") and self.n == 1:
            self.i = 1
            return
        self.listed(self.value)

    # ---- statements
    def block(self) -> None:
        while self.i < self.n:
            self.statement()

    def statement(self) -> None:
        if self.eat(";") or self.group("{", "block"):
            return None
        if self.at("a") and self.t[self.i + 1] == ":":
            self.i += 2
            return self.statement() if self.i < self.n else None
        if self.eat("if", "while"):
            self.need_group("(", "condition", False)
            self.statement()
            if self.eat("else"):
                self.statement()
            return None
        if self.eat("else"):  # of an if whose statement ended the piece before
            return self.statement()
        if self.eat("for"):
            self.need_group("(", "loop", False)
            return self.statement()
        if self.eat("do"):
            self.statement()
            self.need("while")
            self.need_group("(", "condition", False)
            return self.need(";")
        if self.at("switch"):
            self.i += 1
            self.need_group("(", "condition", False)
            self.need_group("{", "cases")
            if self.at("."):
                self.postfix()
                self.need(";")
            return None
        if self.eat("try"):
            with_ = self.group("(", "resources", False)
            self.need_group("{", "block")
            caught = False
            while self.eat("catch"):
                self.need_group("(", "caught", False)
                self.need_group("{", "block")
                caught = True
            if self.eat("finally"):
                self.need_group("{", "block")
            elif not caught and not with_:
                self.fail()
            return None
        if self.at("synchronized") and self.t[self.i + 1] == "(":
            self.i += 1
            self.need_group("(", "condition", False)
            return self.need_group("{", "block")
        if self.eat("return"):
            if not self.at(";"):
                self.expr()
            return self.need(";")
        if self.eat("throw"):
            self.expr()
            return self.need(";")
        if self.eat("break", "continue"):
            self.eat("a", *self.SOFT)
            return self.need(";")
        if self.eat("assert"):
            self.expr()
            if self.eat(":"):
                self.expr()
            return self.need(";")
        if self.at("yield") and self.t[self.i + 1] not in ("=", ".", "(", "()", "[", "++", "--", "+=", "-="):
            self.i += 1
            self.expr()
            return self.need(";")
        if self.attempt(self.local_type):
            return None
        if not self.attempt(self.local):
            self.expr()
        return self.need(";")

    def local_type(self) -> bool:
        self.modifiers()
        return self.type_declaration()

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if not self.at("=", ",", ";", "[]", ":", ""):
            self.fail()
        self.declarators()

    def condition(self) -> None:
        self.expr()

    def cases(self) -> None:
        """The body of a switch: labels with a colon or an arrow."""
        while self.i < self.n:
            if self.eat("case"):
                self.label()
                while self.eat(","):
                    self.label()
                if self.eat("when"):
                    self.expr(False)
                self.after_label()
            elif self.at("default") and self.t[self.i + 1] in (":", "->"):
                self.i += 1
                self.after_label()
            else:
                self.statement()

    def label(self) -> None:
        if self.eat("default") or self.attempt(self.pattern_label):
            return
        self.ternary_free()

    def pattern_label(self) -> None:
        self.eat("final")
        self.type()
        if self.group("(", "patterns"):
            self.eat("a")
        else:
            self.name()
        if not self.at("->", ":", ",", "when", "&&"):
            self.fail()

    def ternary_free(self) -> None:
        self.expr(False)

    def after_label(self) -> None:
        if self.eat(":"):
            return
        self.need("->")
        if self.group("{", "block"):
            return
        if self.eat("throw"):
            self.expr()
        else:
            self.expr()
        self.need(";")

    def loop(self) -> None:
        if self.attempt(self.each):
            return
        if not self.at(";") and not self.attempt(self.local_loop):
            self.exprs()
        self.need(";")
        if not self.at(";"):
            self.expr()
        self.need(";")
        if self.i < self.n:
            self.exprs()

    def local_loop(self) -> None:
        self.local()
        if not self.at(";"):
            self.fail()

    def each(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need(":")
        self.expr()

    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def resources(self) -> None:
        while self.i < self.n:
            if not self.attempt(self.resource):
                self.expr()
            if self.i < self.n:
                self.need(";")

    def resource(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need("=")
        self.expr()

    def caught(self) -> None:
        self.modifiers()
        self.type()
        while self.eat("|"):
            self.type()
        self.name()

    # ---- expressions
    def expr(self, arrows: bool = True) -> None:
        self.operand(arrows)
        while True:
            if self.eat("instanceof"):
                self.modifiers()
                self.type()
                if self.group("(", "patterns"):
                    self.eat("a")
                else:
                    self.eat("a", *self.SOFT)
                continue
            if self.eat("?"):
                self.expr(arrows)
                self.need(":")
                self.expr(arrows)
                continue
            if self.at(">"):
                while self.eat(">"):
                    pass
                self.eat("=")
            elif self.now in _BINARY:
                self.i += 1
            else:
                return
            self.operand(arrows)

    def patterns(self) -> None:
        def one() -> None:
            self.modifiers()
            self.type()
            if self.group("(", "patterns"):
                self.eat("a")
            else:
                self.name()

        self.listed(one, last=False)

    def operand(self, arrows: bool) -> None:
        while self.eat("+", "-", "!", "~", "++", "--"):
            pass
        if self.at("(", "()"):
            if self.t[self.i + 1] == "->" and arrows:
                self.need_group("(", "lambda_params")
                return self.arrow()
            after = self.t[self.i + 1]
            if self.now == "(" and (after in ("a", "0", '"', "(", "()", "!", "~", "this", "super", "new", "switch", *self.SOFT) or after in _PRIMITIVE):
                if self.at("(") and after not in ("when", "to", "with"):
                    self.need_group("(", "cast", False)
                    return self.operand(arrows)
            self.need_group("(", "paren", False)
        elif self.at("a", *self.SOFT) and self.t[self.i + 1] == "->" and arrows:
            self.i += 1
            return self.arrow()
        elif self.eat("new"):
            self.creation()
        elif self.eat("switch"):
            self.need_group("(", "condition", False)
            self.need_group("{", "cases")
        elif self.at(*_PRIMITIVE):
            self.type()
            if not self.at("::", "."):
                self.fail()
        elif self.attempt(self.type_reference):
            pass
        elif not self.eat("0", '"', "this", "super", "a", *self.SOFT):
            self.fail()
        return self.postfix()

    def type_reference(self) -> None:
        """A type before '::' or '.class' that is more than a name."""
        if not self.at("a") or self.t[self.i + 1] not in ("<", "[]", ".", "@"):
            self.fail()
        self.type()
        if self.t[self.i - 1] not in (">", "[]") or not (self.at("::") or self.at(".") and self.t[self.i + 1] == "class"):
            self.fail()

    def arrow(self) -> None:
        self.need("->")
        if not self.group("{", "block"):
            self.expr()

    def creation(self) -> None:
        self.annotations()
        if self.at("<"):
            self.arguments()
        if not self.eat(*_PRIMITIVE):
            while True:
                self.annotations()
                self.name()
                if self.at("<"):
                    self.arguments()
                if not self.eat("."):
                    break
        self.annotations()
        if self.group("(", "args"):
            self.group("{", "members")
            return
        if not self.at("[", "[]"):
            self.fail()
        sized = False
        while True:
            self.annotations()
            if self.at("[") and self.t[self.i] == "[":
                self.need_group("[", "condition", False)
                sized = True
            elif not self.eat("[]"):
                break
        if not sized:
            self.need_group("{", "elements")

    def postfix(self) -> None:
        while True:
            if self.eat("++", "--"):
                continue
            if self.eat("."):
                if self.at("<"):
                    self.arguments()
                if self.eat("new"):
                    self.creation()
                elif not self.eat("a", "this", "super", "class", *self.SOFT):
                    self.fail()
                continue
            if self.eat("::"):
                if self.at("<"):
                    self.arguments()
                self.need("a", "new", *self.SOFT)
                continue
            if self.group("(", "args") or self.group("[", "condition", False):
                continue
            if self.at("[]") and self.t[self.i + 1] in ("::", ".", "[]"):
                self.i += 1
                continue
            return

    def args(self) -> None:
        self.listed(self.expr, last=False)

    def paren(self) -> None:
        if self.n == 1 and self.eat(*_PRIMITIVE):  # a cast before a sign
            return
        self.expr()

    def cast(self) -> None:
        # what stands before an operand is a type, or the code is wrong
        self.type()
        while self.eat("&"):
            self.type()

    def lambda_params(self) -> None:
        def one() -> None:
            if self.at("a", *self.SOFT) and self.t[self.i + 1] in (",", ""):
                self.i += 1
                return
            self.modifiers()
            self.type()
            self.eat("...")
            self.name()
            while self.eat("[]"):
                pass

        self.listed(one, last=False)
