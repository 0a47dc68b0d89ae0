"""Rust: items, types, patterns and expressions."""

from __future__ import annotations

from .grammar_base import Grammar

_BINARY = frozenset("+ - * / % ^ & | && || << < > == != <= = += -= *= /= %= &= |= ^= <<= .. ..= ...".split())
_AFTER = frozenset(", ; => ) else".split())


class Rust(Grammar):
    #: The language's words.
    WORDS = frozenset(
        "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while macro_rules union default auto raw box _".split()
    )
    SOFT = frozenset(("macro_rules", "union", "default", "auto", "raw", "box", "self", "super", "crate"))
    BLOCKS = frozenset(("block", "items"))
    TOP = "items"

    def name(self) -> None:
        self.need("a", *self.SOFT)

    # ---- generics and types
    def angles(self, f) -> None:
        self.need("<")
        while not self.eat(">"):
            f()
            if not self.at(">"):
                self.need(",")

    def generic_param(self) -> None:
        if self.eat("'"):
            if self.eat(":"):
                self.bounds()
            return
        if self.eat("const"):
            self.name()
            self.need(":")
            self.type()
            if self.eat("="):
                self.generic_arg()
            return
        self.name()
        if self.eat(":"):
            self.bounds()
        if self.eat("="):
            self.type()

    def bounds(self) -> None:
        while True:
            if self.group("(", "bounds"):
                pass
            elif not self.eat("'"):
                while self.eat("?", "const", "async", "~"):
                    pass
                if self.at("for"):
                    self.eat("for")
                    self.angles(self.generic_param)
                if self.at("use") and self.eat("use"):
                    self.angles(self.generic_arg)
                elif self.at("a", "self", "super", "crate", "::", "<", "[") or self.now in self.SOFT:
                    self.type()
                else:
                    return
            if not self.eat("+"):
                return

    def generic_arg(self) -> None:
        if self.eat("'", "0", '"'):
            return
        if self.eat("-"):
            return self.need("0")
        if self.group("{", "block"):
            return None
        self.type()
        if self.eat("="):
            return self.generic_arg()
        if self.eat(":"):
            self.bounds()
        return None

    def path(self, types: bool) -> None:
        """A path; in types its segments take arguments without '::'."""
        if self.at("<"):
            self.eat("<")
            self.type()
            if self.eat("as"):
                self.path(True)
            self.need(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            self.name()
            if types and self.at("<"):
                self.angles(self.generic_arg)
            elif types and self.group("(", "types"):
                if self.eat("->"):
                    self.type(False)
            if not (self.at("::") and (self.t[self.i + 1] in ("a", "<", "<<") or self.t[self.i + 1] in self.SOFT)):
                return
            self.eat("::")
            if self.at("<"):
                self.angles(self.generic_arg)
                if not self.eat("::"):
                    return
            elif self.at("<<"):  # ::<<T as X>::Y>
                self.t[self.i] = "<"
                self.angles_open()
                if not self.eat("::"):
                    return

    def angles_open(self) -> None:
        """Arguments whose first begins with '<', both lexed as one code."""
        self.path(True)
        while self.eat(","):
            if self.at(">"):
                break
            self.generic_arg()
        self.need(">")

    def type(self, plus: bool = True) -> None:
        while self.eat("&", "&&"):
            self.eat("'")
            self.eat("mut")
        if self.eat("*"):
            self.need("const", "mut")
            return self.type()
        if self.group("(", "types") or self.group("[", "array_type") or self.eat("!", "_"):
            return None
        if self.eat("impl", "dyn"):
            return self.bounds()
        if self.at("for"):
            self.eat("for")
            self.angles(self.generic_param)
            return self.type()
        if self.at("fn", "unsafe", "extern"):
            while self.eat("unsafe", "extern", '"'):
                pass
            self.need("fn")
            self.need_group("(", "fn_types")
            if self.eat("->"):
                self.type()
            return None
        if self.at("<<"):
            self.t[self.i] = "<"
            self.need("<")
            self.path(True)
            if self.eat("as"):
                self.path(True)
            self.need(">")
            self.need("::")
        self.path(True)
        if self.at("!") and self.t[self.i + 1][:1] in ("(", "[", "{"):
            self.eat("!")
            self.skip()
        if plus and self.at("+") and self.t[self.i + 1] in ("a", "'", "?"):
            self.eat("+")
            self.bounds()
        return None

    def types(self) -> None:
        self.listed(self.type)

    def fn_types(self) -> None:
        def one() -> None:
            if self.eat("..."):
                return
            if (self.at("a", "_", "self") or self.now in self.SOFT) and self.t[self.i + 1] == ":":
                self.i += 2
            self.type()

        self.listed(one)

    def array_type(self) -> None:
        self.type()
        if self.eat(";"):
            self.expr()

    def where(self) -> None:
        if not self.eat("where"):
            return
        while self.i < self.n and not self.at(";", "=") and self.now[:1] != "{":
            if self.at("for"):
                self.eat("for")
                self.angles(self.generic_param)
            if not self.eat("'"):
                self.type(False)
            self.need(":")
            self.bounds()
            if not self.eat(","):
                return

    # ---- items
    def items(self) -> None:
        while self.i < self.n:
            if not self.eat(";") and not self.item():
                self.fail()

    def item(self) -> bool:
        """Whether an item begins here; if so it is read."""
        start, roles = self.i, len(self.roles)
        if self.eat("pub"):
            self.group("(", "any")
        if self.at("default") and self.t[self.i + 1] in ("fn", "impl", "type", "const", "unsafe", "async"):
            self.eat("default")
        if self.at("use") or self.at("extern") and self.t[self.i + 1] == "crate":
            self.use() if self.eat("use") else self.crate()
            return True
        if self.eat("mod"):
            self.name()
            return self.ends("items")
        if self.at("unsafe", "async", "const", "extern", "fn", "auto", "impl", "trait", "static") or self.at('"'):
            while self.at("unsafe", "async", "extern", '"', "auto") or self.at("const") and self.t[self.i + 1] in ("fn", "unsafe", "async", "extern"):
                self.i += 1
            if self.eat("fn"):
                return self.function()
            if self.eat("impl"):
                return self.implementation()
            if self.eat("trait"):
                return self.trait()
            if self.at("mod"):
                self.eat("mod")
                self.name()
                return self.ends("items")
            if self.i > start and self.t[self.i - 1] in ("extern", '"') and self.group("{", "items"):
                return True
            if self.at("const", "static") and self.t[self.i + 1] in ("a", "_", "mut", "ref", *self.SOFT):
                self.i += 1
                self.eat("mut", "ref")
                self.need("a", "_", *self.SOFT)
                if self.eat(":"):
                    self.type()
                if self.eat("="):
                    self.expr()
                self.need(";")
                return True
            self.i = start
            del self.roles[roles:]
            return False
        if self.at("struct", "enum") or self.at("union") and self.t[self.i + 1] == "a":
            kind = self.now
            self.i += 1
            self.name()
            if self.at("<"):
                self.angles(self.generic_param)
            self.where()
            if self.group("(", "tuple_fields"):
                self.where()
                self.need(";")
                return True
            return self.ends("variants" if kind == "enum" else "fields")
        if self.at("type") or self.at("trait"):
            kind = self.now
            self.i += 1
            if kind == "trait":
                return self.trait()
            self.name()
            if self.at("<"):
                self.angles(self.generic_param)
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            self.need(";")
            return True
        if self.at("macro_rules") and self.t[self.i + 1] == "!":
            self.i += 2
            self.name()
            return self.macro_body()
        if self.i == start and (self.at("a", "::", "crate", "self", "super")) and self.macro_ahead():
            self.path(False)
            self.need("!")
            if self.at("a"):
                self.eat("a")
            return self.macro_body()
        if self.i > start:
            self.fail()
        return False

    def macro_ahead(self) -> bool:
        j = self.i
        while self.t[j] in ("a", "::", "crate", "self", "super"):
            j += 1
        return self.t[j] == "!" and (self.t[j + 1][:1] == "{" or self.t[j + 1] == "a" or self.TOP_LEVEL and self.t[j + 1][:1] in ("(", "["))

    TOP_LEVEL = True

    def macro_body(self) -> bool:
        brace = self.now[:1] == "{"
        if self.now[:1] not in ("(", "[", "{"):
            self.fail()
        self.skip()
        if not brace:
            self.need(";")
        return True

    def ends(self, role: str) -> bool:
        if not self.eat(";"):
            self.need_group("{", role)
        return True

    def crate(self) -> None:
        self.i += 2
        self.name()
        if self.eat("as"):
            self.need("a", "_")
        self.need(";")

    def use(self) -> None:
        self.use_tree()
        self.need(";")

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.group("{", "use_list") or self.eat("*"):
                return
            self.name()
            if self.eat("as"):
                self.need("a", "_", *self.SOFT)
                return
            if not self.eat("::"):
                return

    def use_list(self) -> None:
        self.listed(self.use_tree)

    def function(self) -> bool:
        self.name()
        if self.at("<"):
            self.angles(self.generic_param)
        self.need_group("(", "params")
        if self.eat("->"):
            self.type()
        self.where()
        return self.ends("block")

    def params(self) -> None:
        def one() -> None:
            if self.eat("..."):
                return
            if self.eat("&"):  # &self
                self.eat("'")
            if self.at("mut") and self.t[self.i + 1] == "self":
                self.eat("mut")
            if self.eat("self"):
                if self.eat(":"):
                    self.type()
                return
            if self.t[self.i - 1] == "&":
                self.i -= 1
            self.pattern()
            if self.eat(":"):
                self.eat("...") or self.type()
            else:
                self.fail()

        self.listed(one)

    def trait(self) -> bool:
        self.name()
        if self.at("<"):
            self.angles(self.generic_param)
        if self.eat(":"):
            self.bounds()
        if self.eat("="):
            self.bounds()
        self.where()
        return self.ends("items")

    def implementation(self) -> bool:
        if self.at("<") and self.t[self.i + 1] in ("'", "a", "const", ">"):
            self.attempt(self.angles, self.generic_param)
        self.eat("const")
        self.eat("!")
        self.type()
        if self.eat("for"):
            self.type()
        self.where()
        self.need_group("{", "items")
        return True

    def visible(self) -> None:
        if self.eat("pub"):
            self.group("(", "any") if self.t[self.i + 1] in ("a", "'", "&", "*", "fn") or self.now[:1] == "(" and self.t[self.i + 1] not in (",", "") else None

    def fields(self) -> None:
        def one() -> None:
            if self.eat("pub"):
                self.group("(", "any")
            self.name()
            self.need(":")
            self.type()
            if self.eat("="):
                self.expr()

        self.listed(one)

    def tuple_fields(self) -> None:
        def one() -> None:
            self.visible()
            self.type()

        self.listed(one)

    def variants(self) -> None:
        def one() -> None:
            self.visible()
            self.name()
            self.group("(", "tuple_fields") or self.group("{", "fields")
            if self.eat("="):
                self.expr()

        self.listed(one)

    # ---- patterns
    def pattern(self, bars: bool = True) -> None:
        if bars:
            self.eat("|")
        while True:
            self.one_pattern()
            if not (bars and self.eat("|")):
                return

    def one_pattern(self) -> None:
        while self.eat("&", "&&", "ref", "mut", "box"):
            pass
        if self.group("(", "patterns") or self.group("[", "patterns") or self.eat("_"):
            return None
        if self.eat("..", "..=", "..."):
            if self.at("0", '"', "-", "a"):
                self.limit()
            return None
        if self.at("const") and self.t[self.i + 1][:1] == "{":
            self.i += 1
            self.need_group("{", "block")
            return None
        if self.at("0", '"', "-"):
            self.limit()
        else:
            self.path(False)
            if self.at("!") and self.t[self.i + 1][:1] in ("(", "[", "{"):
                self.i += 1
                self.skip()
                return None
            if self.group("(", "patterns") or self.group("{", "field_patterns"):
                return None
            if self.eat("@"):
                return self.pattern(False) if self.now[:1] != "(" else self.need_group("(", "patterns")
        if self.eat("..", "..=", "..."):
            if self.at("0", '"', "-", "a", "self", "crate", "super", "<", "::"):
                self.limit()
        return None

    def limit(self) -> None:
        if self.eat("-"):
            return self.need("0")
        if not self.eat("0", '"'):
            self.path(False)
        return None

    def patterns(self) -> None:
        self.listed(self.pattern)

    def field_patterns(self) -> None:
        def one() -> None:
            if self.eat(".."):
                return
            while self.eat("ref", "mut", "box"):
                pass
            self.need("a", "0", *self.SOFT)
            if self.eat(":"):
                self.pattern()

        self.listed(one)

    # ---- statements and expressions
    def block(self) -> None:
        self.TOP_LEVEL = False
        while self.i < self.n:
            if self.eat(";") or self.item():
                continue
            if self.eat("let"):
                self.pattern()
                if self.eat(":"):
                    self.type()
                if self.eat("="):
                    self.expr()
                    if self.eat("else"):
                        self.need_group("{", "block")
                self.need(";")
                continue
            whole = self.block_like()
            if whole and not self.at(".", "?"):
                continue
            if whole:
                self.after_operand(True)
                self.operators(True)
            else:
                start = self.i
                self.expr()
                # a macro with braces ends a statement
                if self.t[self.i - 1][:1] == "{" and self.i - start >= 3 and self.t[self.i - 2] == "!":
                    continue
            if self.i < self.n:
                self.need(";")

    def block_like(self) -> bool:
        """Whether an expression that ends with its block stands here; if so it is read."""
        if self.at("'") and self.t[self.i + 1] == ":":
            self.i += 2
        if self.at("{", "{}"):
            return self.group("{", "block")
        if self.eat("if"):
            self.condition()
            self.need_group("{", "block")
            while self.eat("else"):
                if self.eat("if"):
                    self.condition()
                    self.need_group("{", "block")
                else:
                    self.need_group("{", "block")
                    break
            return True
        if self.eat("match"):
            self.expr(False)
            self.need_group("{", "arms")
            return True
        if self.eat("while"):
            self.condition()
            self.need_group("{", "block")
            return True
        if self.eat("loop"):
            self.need_group("{", "block")
            return True
        if self.at("for") and self.t[self.i + 1] != "<":
            self.eat("for")
            self.pattern()
            self.need("in")
            self.expr(False)
            self.need_group("{", "block")
            return True
        if self.at("unsafe", "async", "const", "try") and (self.t[self.i + 1][:1] == "{" or self.t[self.i + 1] == "move" and self.t[self.i + 2][:1] == "{"):
            self.i += 1
            self.eat("move")
            return self.group("{", "block")
        return False

    def condition(self) -> None:
        self.expr(False)

    def arms(self) -> None:
        while self.i < self.n:
            self.pattern()
            if self.eat("if"):
                self.expr()
            self.need("=>")
            if self.block_like() and not self.at(".", "?", ",") and (self.at("a", "|", "_", "0", '"', "&", "-", "ref", "mut", "(", "[", "..", "self", "crate", "super", "<", "()", "[]", "::", "..=", "&&", "const", "box") or self.i >= self.n or self.now in self.SOFT):
                continue
            if self.t[self.i - 1] != "=>":
                if not self.at(","):
                    self.after_operand(True)
                    self.operators(True)
            else:
                self.expr()
            if self.i < self.n:
                self.need(",")

    def expr(self, braces: bool = True) -> None:
        """An expression; without ``braces`` no struct literal stands at its outer level."""
        if self.eat("let"):
            self.pattern()
            self.need("=")
        self.operand(braces)
        self.operators(braces)

    def begins(self, braces: bool) -> bool:
        c = self.now
        return bool(c) and (c in ("a", "0", '"', "(", "()", "[", "[]", "-", "*", "!", "&", "&&", "|", "||", "if", "match", "loop", "while", "for", "unsafe", "async", "move", "return", "break", "continue", "..", "..=", "::", "<", "'", "_", "const", "static") or c in self.SOFT or braces and c[0] == "{")

    def operators(self, braces: bool) -> None:
        while True:
            if self.eat("as"):
                self.type(False)
                continue
            c = self.now
            if c not in _BINARY:
                return
            self.i += 1
            if c in ("..", "..=", "..."):
                if not self.begins(braces):
                    continue
            elif c == ">":
                self.eat(">")
                self.eat("=")
            if self.eat("let"):
                self.pattern()
                self.need("=")
            self.operand(braces)

    def operand(self, braces: bool) -> None:
        while True:
            if self.eat("-", "*", "!"):
                continue
            if self.eat("&", "&&"):
                if self.at("raw") and self.t[self.i + 1] in ("const", "mut"):
                    self.i += 2
                self.eat("mut")
                continue
            break
        if self.eat("..", "..="):
            if self.begins(braces):
                self.operand(braces)
            return
        if self.eat("return"):
            if self.begins(braces):
                self.expr(braces)
            return
        if self.at("break", "continue"):
            self.i += 1
            self.eat("'")
            if self.begins(braces):
                self.expr(braces)
            return
        if self.at("|", "||", "move") or self.at("static", "async") and self.t[self.i + 1] in ("|", "||", "move"):
            if self.closure():
                return
        if not self.block_like():
            self.primary(braces)
        self.after_operand(braces)

    def closure(self) -> bool:
        while self.eat("static", "async", "move"):
            pass
        if self.at("{", "{}") and self.t[self.i - 1] == "move":
            return self.group("{", "block")
        if not self.eat("||"):
            self.need("|")
            while not self.eat("|"):
                self.pattern(False)
                if self.eat(":"):
                    self.type()
                if not self.at("|"):
                    self.need(",")
        if self.eat("->"):
            self.type(False)
            self.need_group("{", "block")
        else:
            self.expr()
        return True

    def primary(self, braces: bool) -> None:
        if self.eat("0", '"', "_"):
            return
        if self.group("(", "values") or self.group("[", "array"):
            return
        if self.at("<<"):
            return self.type()
        self.path(False)
        if self.at("!") and self.t[self.i + 1][:1] in ("(", "[", "{"):
            self.i += 1
            self.skip()
        elif braces and self.at("{", "{}"):
            self.group("{", "struct_values")

    def after_operand(self, braces: bool) -> None:
        while True:
            if self.eat("?"):
                continue
            if self.eat("."):
                if self.eat("await", "0"):
                    continue
                self.name()
                if self.at("::"):
                    self.eat("::")
                    self.angles(self.generic_arg)
                continue
            if self.group("(", "values") or self.group("[", "index"):
                continue
            return

    def values(self) -> None:
        self.listed(self.expr)

    def index(self) -> None:
        self.expr()

    def array(self) -> None:
        while self.i < self.n:
            self.expr()
            if self.eat(";"):
                self.expr()
                return
            if self.i < self.n:
                self.need(",")

    def struct_values(self) -> None:
        def one() -> None:
            if self.eat(".."):
                if self.begins(True):
                    self.expr()
                return
            self.need("a", "0", *self.SOFT)
            if self.eat(":"):
                self.expr()

        self.listed(one)
