"""JavaScript and TypeScript: statements, declarations, expressions, and TypeScript's types."""

from __future__ import annotations

from .grammar_base import Grammar

_BINARY = frozenset("+ - * / % ** & | ^ && || ?? == != === !== < > <= >= << >> >>> instanceof = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
#: Words that are names where their construct does not stand.
_SOFT = "async get set static of from as type interface enum readonly declare abstract namespace module private public protected keyof is infer implements override asserts unique out accessor satisfies global let await yield require any".split()


class JavaScript(Grammar):
    #: The language's words.
    WORDS = frozenset(
        "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield".split()
    ) | frozenset(_SOFT)
    BLOCKS = frozenset(("block",))
    NAMES = ("a", *_SOFT)
    #: Words that do not begin an operand; other words may be keys and members.
    TYPED = False

    def name(self) -> None:
        self.need(*self.NAMES)

    def member_name(self) -> bool:
        """A name after a dot or of a member: any word."""
        c = self.now
        if c and (c == "a" or c in self.WORDS):
            self.i += 1
            return True
        return False

    # ---- statements
    def block(self) -> None:
        while self.i < self.n:
            if self.statement():
                continue
            self.end()

    def end(self) -> None:
        """A statement's end: a semicolon, the group's end or a new line."""
        if self.i >= self.n or self.eat(";") or self.lines[self.i]:
            return
        self.fail()

    def ended(self) -> bool:
        return self.i >= self.n or self.at(";") or self.lines[self.i]

    def statement(self) -> bool:
        """One statement; whether it needs no end."""
        c = self.now
        after = self.t[self.i + 1]
        if c == ";":
            self.i += 1
            return True
        if self.group("{", "block"):
            return True
        if c in self.NAMES and after == ":":
            self.i += 2
            return True
        if c == "if" or c == "while" or c == "with":
            self.i += 1
            self.need_group("(", "paren", False)
            return self.inner("if" if c == "if" else "")
        if c == "else":
            self.i += 1
            return self.inner("if")
        if c == "for":
            self.i += 1
            self.eat("await")
            self.need_group("(", "loop", False)
            return self.inner("")
        if c == "do":
            self.i += 1
            if not self.statement():
                self.end()
            self.need("while")
            self.need_group("(", "paren", False)
            self.eat(";")
            return True
        if c == "switch":
            self.i += 1
            self.need_group("(", "paren", False)
            self.need_group("{", "block")
            return True
        if c == "case":
            self.i += 1
            self.expr()
            self.need(":")
            return True
        if c == "default" and after == ":":
            self.i += 2
            return True
        if c == "try":
            self.i += 1
            self.need_group("{", "block")
            caught = False
            if self.eat("catch"):
                caught = True
                self.group("(", "params", False)
                self.need_group("{", "block")
            if self.eat("finally"):
                self.need_group("{", "block")
            elif not caught:
                self.fail()
            return True
        if c == "return":
            self.i += 1
            if not self.ended():
                self.exprs()
            return False
        if c == "throw":
            self.i += 1
            self.exprs()
            return False
        if c in ("break", "continue"):
            self.i += 1
            if not self.ended():
                self.name()
            return False
        if c == "debugger":
            self.i += 1
            return False
        if c in ("var", "const") or c == "let" and (after in self.NAMES or after[:1] in ("[", "{")):
            if c == "const" and after == "enum":
                self.i += 1
                return self.enum()
            self.i += 1
            self.declarators()
            return False
        if c == "@":
            while self.eat("@"):
                self.decorator()
            if not self.at("class", "export", "abstract", "default"):
                self.fail()
            return self.statement()
        if c == "function" or c == "async" and after == "function" and not self.lines[self.i + 1]:
            self.eat("async")
            self.i += 1
            self.eat("*")
            self.name()
            return self.function(True)
        if c == "class":
            self.i += 1
            return self.class_()
        if c == "import" and after not in ("(", "()", "."):
            return self.import_()
        if c == "export":
            return self.export()
        if self.TYPED and (typed := self.typed_statement()) is not None:
            return typed
        self.exprs()
        return False

    def typed_statement(self) -> bool | None:
        return None

    def inner(self, kind: str) -> bool:
        """The statement that a header governs, and an else."""
        if self.i >= self.n:
            self.fail()
        whole = self.statement()
        if kind and (whole or self.at(";", "else") or self.i < self.n and self.lines[self.i]):
            if not whole:
                self.eat(";")
                whole = self.t[self.i - 1] == ";"
            if self.at("else"):
                self.i += 1
                return self.inner("if")
        return whole

    def decorator(self) -> None:
        if self.group("(", "paren", False):
            return
        self.need("a", *self.NAMES)
        while True:
            if self.eat("."):
                if not self.member_name():
                    self.fail()
            elif not self.group("(", "args"):
                return

    def declarators(self) -> None:
        while True:
            self.target()
            self.eat("!") if self.TYPED else None
            self.annotation()
            if self.eat("="):
                self.expr()
            if not self.eat(","):
                return

    def target(self) -> None:
        if not (self.group("{", "object") or self.group("[", "array")):
            self.name()

    def annotation(self) -> None:
        pass

    def type_parameters(self) -> None:
        pass

    def function(self, statement: bool) -> bool:
        self.type_parameters()
        self.need_group("(", "params")
        self.annotation()
        if not self.group("{", "block"):
            if not (statement and self.TYPED):
                self.fail()
            return False
        return True

    def class_(self) -> bool:
        if self.at(*self.NAMES) and not (self.at("implements") and self.t[self.i + 1] == "a"):
            self.i += 1
        self.type_parameters()
        if self.eat("extends"):
            self.heritage()
        self.implemented()
        self.need_group("{", "members")
        return True

    def heritage(self) -> None:
        self.operand(False)

    def implemented(self) -> None:
        pass

    def import_(self) -> bool:
        self.i += 1
        if self.eat('"'):
            self.attributes()
            return False
        if self.at("type", "defer") and self.t[self.i + 1] not in ("from", ",", "="):
            self.i += 1
        if self.at(*self.NAMES) and not (self.at("from") and self.t[self.i + 1] == '"'):
            self.i += 1
            if self.TYPED and self.eat("="):
                self.expr()
                return False
            if not self.eat(","):
                return self.origin()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.need_group("{", "specifiers")
        return self.origin()

    def origin(self) -> bool:
        self.need("from")
        self.need('"')
        self.attributes()
        return False

    def attributes(self) -> None:
        if self.at("with", "a") and self.t[self.i + 1][:1] == "{" and not self.lines[self.i]:
            self.i += 1
            self.need_group("{", "object")

    def specifiers(self) -> None:
        def one() -> None:
            if self.at("type") and self.t[self.i + 1] not in ("as", ",", ""):
                self.i += 1
            if not self.eat('"') and not self.member_name():
                self.fail()
            if self.eat("as") and not self.eat('"') and not self.member_name():
                self.fail()

        self.listed(one)

    def export(self) -> bool:
        self.i += 1
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.t[self.i + 1] == "function":
                self.eat("async")
                self.i += 1
                self.eat("*")
                if self.at(*self.NAMES):
                    self.i += 1
                return self.function(True)
            if self.at("class"):
                self.i += 1
                return self.class_()
            if self.at("@", "abstract", "interface") and self.t[self.i + 1] in ("a", "class"):
                return self.statement()
            self.expr()
            return False
        if self.TYPED and self.at("type") and self.t[self.i + 1] in ("{", "{}", "*"):
            self.i += 1
        if self.eat("*"):
            if self.eat("as") and not self.eat('"') and not self.member_name():
                self.fail()
            return self.origin()
        if self.group("{", "specifiers"):
            if self.at("from") and not (self.lines[self.i] and self.t[self.i + 1] != '"'):
                return self.origin()
            return False
        if self.TYPED and self.eat("="):
            self.expr()
            return False
        if self.TYPED and self.at("as") and self.t[self.i + 1] == "namespace":
            self.i += 2
            self.name()
            return False
        if not self.at("var", "const", "let", "function", "class", "async", "@", *(("import", "type", "interface", "enum", "declare", "abstract", "namespace", "module", "default") if self.TYPED else ())):
            self.fail()
        if self.at("async") and self.t[self.i + 1] != "function":
            self.fail()
        return self.statement()

    def enum(self) -> bool:
        self.fail()
        return True

    # ---- headers, parameters, members
    def loop(self) -> None:
        if self.attempt(self.each):
            return
        if not self.at(";"):
            if self.eat("var", "let", "const"):
                self.declarators()
            else:
                self.exprs()
        self.need(";")
        if not self.at(";"):
            self.exprs()
        self.need(";")
        if self.i < self.n:
            self.exprs()

    def each(self) -> None:
        if self.eat("await"):
            self.need("a")
        if self.at("var", "const", "let") and self.t[self.i + 1] not in ("of", "in") or self.at("a") and self.t[self.i + 1] == "a":
            self.i += 1
            self.target()
            self.annotation()
            if self.eat("="):
                self.expr(False)
        else:
            self.operand(False)
        self.need("of", "in")
        self.exprs()
        if self.i < self.n:
            self.fail()

    def params(self) -> None:
        def one() -> None:
            while self.at("@"):
                self.i += 1
                self.decorator()
            if self.TYPED:
                while self.at("public", "private", "protected", "readonly", "override") and self.t[self.i + 1] not in (",", ":", "=", "?", ""):
                    self.i += 1
            self.eat("...")
            if not (self.TYPED and self.eat("this")):
                self.target()
            self.eat("?") if self.TYPED else None
            self.annotation()
            if self.eat("="):
                self.expr()

        self.listed(one)

    def members(self) -> None:
        while self.i < self.n:
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        while self.at("@"):
            self.i += 1
            self.decorator()
        while self.at("static", "async", "get", "set", "accessor", *(("public", "private", "protected", "readonly", "declare", "abstract", "override") if self.TYPED else ())):
            nxt = self.t[self.i + 1]
            if nxt in ("(", "()", "=", ";", "", ":", "?", "!", "<") or self.lines[self.i + 1] and self.now in ("get", "set", "static", "accessor") and nxt not in ("a",):
                break
            if self.at("static") and nxt[:1] == "{":
                self.i += 1
                self.need_group("{", "block")
                return
            self.i += 1
        self.eat("*")
        if not (self.group("[", "any" if self.TYPED else "index", False) or self.eat('"', "0") or self.member_name()):
            self.fail()
        if self.TYPED:
            self.eat("?", "!")
            self.type_parameters()
        if self.group("(", "params"):
            self.annotation()
            if not self.group("{", "block"):
                if not self.TYPED:
                    self.fail()
                self.end()
            return
        self.annotation()
        if self.eat("="):
            self.expr()
        self.end()

    # ---- expressions
    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def expr(self, in_: bool = True) -> None:
        self.operand()
        while True:
            c = self.now
            if c in _BINARY or c == "in" and in_:
                self.i += 1
                if c == ">" and self.TYPED:
                    self.eat(">")
                    self.eat(">")
                    self.eat("=")
                self.operand()
                continue
            if c == "?":
                self.i += 1
                self.middle(in_)
                self.need(":")
                self.expr(in_)
                continue
            if self.TYPED and c in ("as", "satisfies") and not self.lines[self.i]:
                self.i += 1
                self.eat("const") or self.type()
                continue
            return

    def middle(self, in_: bool) -> None:
        self.expr(True)

    def operand(self, calls: bool = True) -> None:
        while True:
            c = self.now
            if c in ("+", "-", "!", "~", "++", "--", "typeof", "void", "delete"):
                self.i += 1
                continue
            if c == "await" and self.t[self.i + 1] not in ("=>", ",", "=", ".", "") and not (self.t[self.i + 1] in _BINARY and self.t[self.i + 1] not in ("+", "-")):
                self.i += 1
                continue
            break
        if c == "yield":
            self.i += 1
            if self.eat("*") or not self.ended() and not self.at(")", "]", "}", ",", ":", "?", "in", "of"):
                self.expr()
            return
        if self.primary():
            self.postfix()

    def primary(self) -> bool:
        """An operand without what follows it; whether something may follow."""
        c, after = self.now, self.t[self.i + 1]
        if c in ("(", "()"):
            if after == "=>":
                self.need_group("(", "params")
                return self.arrow()
            if self.TYPED and after == ":" and self.attempt(self.typed_arrow):
                return False
            self.need_group("(", "paren", False)
            return True
        if c == "async" and not self.lines[self.i + 1]:
            if after in self.NAMES and self.t[self.i + 2] == "=>":
                self.i += 2
                return self.arrow()
            if after in ("(", "()") and (self.t[self.i + 2] == "=>" or self.TYPED and self.t[self.i + 2] == ":"):
                if self.attempt(self.async_arrow):
                    return False
            if after == "<" and self.TYPED and self.attempt(self.async_arrow):
                return False
            if after == "function":
                self.i += 1
                c = "function"
        if c == "function":
            self.i += 1
            self.eat("*")
            if self.at(*self.NAMES):
                self.i += 1
            self.function(False)
            return True
        if c in self.NAMES:
            if after == "=>":
                self.i += 1
                return self.arrow()
            self.i += 1
            return True
        if self.eat('"', "`", "0", "this", "super"):
            return True
        if self.group("[", "array") or self.group("{", "object"):
            return True
        if c == "class":
            self.i += 1
            self.class_()
            return True
        if c == "@":
            while self.eat("@"):
                self.decorator()
            self.need("class")
            self.class_()
            return True
        if c == "new":
            self.i += 1
            if self.eat("."):
                self.need("a")
                return True
            self.primary()
            while self.eat(".") and self.member_name() or self.group("[", "index", False):
                pass
            return True
        if c == "import":
            self.i += 1
            if self.eat("."):
                if not self.member_name():
                    self.fail()
            else:
                self.need_group("(", "args", False)
            return True
        if self.TYPED and c == "<":
            if self.attempt(self.generic_arrow):
                return False
            self.i += 1
            self.eat("const") or self.type()
            self.need(">")
            self.operand()
            return False
        self.fail()
        return False

    def generic_arrow(self) -> None:
        self.fail()

    def typed_arrow(self) -> None:
        self.fail()

    def async_arrow(self) -> None:
        self.need("async")
        self.type_parameters()
        self.need_group("(", "params")
        self.annotation()
        self.arrow()

    def arrow(self) -> bool:
        if self.lines[self.i]:
            self.fail()
        self.need("=>")
        if not self.group("{", "block"):
            self.expr()
        return False

    def postfix(self) -> None:
        while True:
            c = self.now
            if c == ".":
                self.i += 1
                if not self.member_name():
                    self.fail()
            elif c == "?.":
                self.i += 1
                if not (self.group("(", "args") or self.group("[", "index", False)):
                    if self.TYPED and self.at("<"):
                        self.type_arguments()
                    elif not self.member_name():
                        self.fail()
            elif c in ("++", "--") and not self.lines[self.i]:
                self.i += 1
            elif c == "`" or self.group("(", "args") or self.group("[", "index", False):
                if c == "`":
                    self.i += 1
            elif not (self.TYPED and self.typed_postfix()):
                return

    def typed_postfix(self) -> bool:
        return False

    def args(self) -> None:
        def one() -> None:
            self.eat("...")
            self.expr()

        self.listed(one)

    def paren(self) -> None:
        self.exprs()

    def index(self) -> None:
        self.exprs()

    def array(self) -> None:
        while self.i < self.n:
            if self.eat(","):
                continue
            self.eat("...")
            self.expr()
            if self.i < self.n:
                self.need(",")

    def object(self) -> None:
        def one() -> None:
            if self.eat("..."):
                return self.expr()
            while self.at("async", "get", "set") and self.t[self.i + 1] not in ("(", "()", ":", ",", "=", "", "<"):
                self.i += 1
            self.eat("*")
            if not (self.group("[", "index", False) or self.eat('"', "0") or self.member_name()):
                self.fail()
            self.type_parameters()
            if self.group("(", "params"):
                self.annotation()
                return self.need_group("{", "block")
            if self.eat(":"):
                return self.expr()
            if self.eat("="):
                return self.expr()
            return None

        self.listed(one)


class TypeScript(JavaScript):
    TYPED = True

    def annotation(self) -> None:
        if self.eat(":"):
            self.type(True)

    def typed_statement(self) -> bool | None:
        c, after = self.now, self.t[self.i + 1]
        named = after in self.NAMES and not self.lines[self.i + 1]
        if c == "type" and named and self.t[self.i + 2] in ("=", "<"):
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            return False
        if c == "interface" and named:
            self.i += 2
            self.type_parameters()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.need_group("{", "type_members")
            return True
        if c == "enum" and named:
            return self.enum()
        if c in ("namespace", "module") and (named or after == '"'):
            self.i += 1
            if not self.eat('"'):
                self.name()
                while self.eat("."):
                    self.name()
            if c == "module" and self.i >= self.n or self.at(";"):
                return False
            self.need_group("{", "block")
            return True
        if c == "abstract" and after == "class":
            self.i += 1
            return self.statement()
        if c == "declare" and (after in ("var", "const", "let", "function", "class", "async", "export") or after in self.NAMES) and not self.lines[self.i + 1]:
            self.i += 1
            return self.statement()
        if c == "global" and after[:1] == "{":
            self.i += 1
            return self.group("{", "block")
        return None

    def enum(self) -> bool:
        self.need("enum")
        self.name()
        self.need_group("{", "enum_members")
        return True

    def enum_members(self) -> None:
        def one() -> None:
            if not (self.eat('"') or self.group("[", "index") or self.member_name()):
                self.fail()
            if self.eat("="):
                self.expr()

        self.listed(one)

    def heritage(self) -> None:
        self.operand()
        if self.at("<"):
            self.type_arguments()

    def implemented(self) -> None:
        if self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()

    def type_parameters(self) -> None:
        if not self.eat("<"):
            return
        while not self.eat(">"):
            while self.at("const", "in", "out") and self.t[self.i + 1] in (*self.NAMES, "in"):
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.at(">"):
                self.need(",")

    def type_arguments(self) -> None:
        self.need("<")
        while not self.eat(">"):
            self.type()
            if not self.at(">"):
                self.need(",")

    def generic_arrow(self) -> None:
        self.type_parameters()
        self.need_group("(", "params")
        self.annotation()
        self.arrow()

    def typed_arrow(self) -> None:
        self.need_group("(", "params")
        self.annotation()
        self.arrow()

    def middle(self, in_: bool) -> None:
        # '(x) : y => z' is an arrow here only if a colon is left for the question mark
        def with_colon() -> None:
            self.expr(True)
            if not self.at(":"):
                self.fail()

        if not self.attempt(with_colon):
            self.TYPED = False
            try:
                self.expr(True)
            finally:
                del self.TYPED

    def typed_postfix(self) -> bool:
        if self.at("!") and not self.lines[self.i]:
            return self.eat("!")
        if self.at("<"):
            return self.attempt(self.applied)
        return False

    def applied(self) -> None:
        self.type_arguments()
        if not (self.at("(", "()", "`", "?.", ")", ",", ";", "]", "", ":", ".", "}", "&&", "||", "=", "as", "==", "===", "!==", "?") or self.lines[self.i]):
            self.fail()

    # ---- types
    def type(self, result: bool = False) -> None:
        if self.at("asserts") and self.t[self.i + 1] in (*self.NAMES, "this") and not self.lines[self.i + 1]:
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if (self.at(*self.NAMES) or self.at("this")) and self.t[self.i + 1] == "is" and not self.lines[self.i + 1]:
            self.i += 2
            return self.type()
        self.eat("|", "&")
        while True:
            self.one_type()
            if not self.eat("|", "&"):
                break
        if self.at("extends") and not self.lines[self.i] or self.at("extends"):
            i, r = self.i, len(self.roles)
            self.i += 1
            self.type()
            if not self.eat("?"):
                self.i = i
                del self.roles[r:]
                return
            self.type()
            self.need(":")
            self.type()

    def one_type(self) -> None:
        while self.at("keyof", "typeof", "unique", "readonly", "infer", "abstract", "asserts") and self.t[self.i + 1] not in (",", ";", ">", ")", "]", "|", "&", "=", "", "=>", "[]", ".") and not self.lines[self.i + 1]:
            self.i += 1
        c = self.now
        if c == "new":
            self.i += 1
            self.type_parameters()
            self.need_group("(", "params")
            self.need("=>")
            return self.type()
        if c == "<":
            self.type_parameters()
            self.need_group("(", "params")
            self.need("=>")
            return self.type()
        if c in ("(", "()"):
            if self.t[self.i + 1] == "=>":
                self.need_group("(", "params")
                self.need("=>")
                return self.type(True)
            self.need_group("(", "type_in", False)
        elif c == "-":
            self.i += 1
            self.need("0")
        elif self.group("[", "tuple") or self.group("{", "type_members") or self.eat('"', "`", "0", "void", "this"):
            pass
        elif c == "import":
            self.i += 1
            self.need_group("(", "args", False)
            while self.eat("."):
                if not self.member_name():
                    self.fail()
            if self.at("<"):
                self.type_arguments()
        else:
            self.name()
            while self.at("."):
                self.i += 1
                if not self.member_name():
                    self.fail()
            if self.at("<") and not self.lines[self.i]:
                self.type_arguments()
        if self.at("extends") and self.t[self.i - 2] == "infer":
            def constraint() -> None:
                self.i += 1
                self.one_type()
                if self.at("?"):
                    self.fail()

            self.attempt(constraint)
        while self.now[:1] == "[" and not self.lines[self.i]:
            self.group("[", "type_in")
        return None

    def type_in(self) -> None:
        self.type()

    def tuple(self) -> None:
        def one() -> None:
            self.eat("...")
            if self.member_ahead():
                self.i += 1
                self.eat("?")
                self.need(":")
            self.eat("...")
            self.type()
            self.eat("?")

        self.listed(one)

    def member_ahead(self) -> bool:
        c = self.now
        return bool(c) and (c == "a" or c in self.WORDS) and (self.t[self.i + 1] == ":" or self.t[self.i + 1] == "?" and self.t[self.i + 2] == ":")

    def type_members(self) -> None:
        while self.i < self.n:
            self.type_member()
            if self.i < self.n and not self.eat(";", ",") and not self.lines[self.i]:
                self.fail()

    def type_member(self) -> None:
        self.eat("+", "-")
        while self.at("readonly", "get", "set", "static", "public", "private") and self.t[self.i + 1] not in ("(", "()", ":", "?", ",", ";", "", "<"):
            self.i += 1
        if self.at("new") and self.t[self.i + 1] in ("(", "()", "<"):
            self.i += 1
        elif self.group("[", "any"):
            self.eat("+", "-")
            self.eat("?")
        elif self.at("(", "()", "<"):
            pass
        elif self.eat('"', "0") or self.member_name():
            self.eat("?")
        else:
            self.fail()
        self.type_parameters()
        if self.group("(", "params"):
            pass
        self.annotation()
