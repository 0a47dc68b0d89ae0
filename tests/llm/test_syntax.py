"""Problem 6 on wide samples of valid code, and on the same code damaged."""

import random
from pathlib import Path

import pytest

from sievewright.llm import syntax

HERE = Path(__file__).parent / "samples"
SAMPLES = {"java": "wide.java.txt", "go": "wide.go.txt", "typescript": "wide.tsx.txt", "ruby": "wide.rb.txt", "rust": "wide.rs.txt", "c": "wide.c.txt"}
TEXTS = {lang: (HERE / name).read_text() for lang, name in SAMPLES.items()}
TEXTS["python"] = (Path(syntax.__file__).parent / "lexing.py").read_text() + "\n\ndef f(x):\n    match x:\n        case {'a': [1, *_]} if x:\n            return f'{x[\"a\"]!r:>{x}} {'same'} {{}}'\n    type = match = 1\n    return match(type), 1., .5j, 0xFFp0 if 0 else 1\n".replace("0xFFp0", "0xFF")
SIZES = (60, 2000, 1 << 16, 1 << 30)


@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_wide_valid_code(lang):
    for size in SIZES:
        assert syntax.check_text(TEXTS[lang], lang, None, size) is None, size


@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_verdicts_do_not_depend_on_chunks(lang):
    rng, text = random.Random(7), TEXTS[lang]
    for _ in range(60):
        a = rng.randrange(len(text))
        broken = text[:a] + text[a + rng.randrange(1, 30):]
        assert len({syntax.check_text(broken, lang, None, z) is None for z in SIZES}) == 1, broken[a - 30:a + 30]


@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_truncated_and_mutated_code_is_found(lang):
    rng, text = random.Random(3), TEXTS[lang].split("__END__")[0]
    marks = [i for i, c in enumerate(text) if c in "()[]{}"]
    hit = 0
    for _ in range(60):
        a = rng.choice(marks)
        hit += syntax.check_text(text[:a] + text[a + 1:], lang, None) is not None
    assert hit >= 54  # the rest are brackets in strings and comments
    for a in (len(text) // 3, len(text) // 2, len(text) * 5 // 6):
        cut = text[:text.index("(", a) + 1]
        assert syntax.check_text(cut, lang, None) is not None
    other = "def" if lang != "python" and lang != "ruby" else "fn"
    assert syntax.check_text(text + f"\n{other} f(a) -> b {{\n", lang, None) is not None


@pytest.mark.parametrize("lang, text", [
    ("rust", "impl Default for A {}\n"), ("rust", "fn f() { match x { Some(v) if v > 1 => 2, _ => 3 } }\n"), ("rust", "fn f() { g(&s[1..], &s[..]) }\n"), ("rust", "#!/usr/bin/env run\nfn f() {}\n"),
    ("c", "#if 0\nnot C ' at { all\n#else\nint x;\n#endif\n"), ("c", "#ifdef A\nvoid f(int a) {\n#else\nvoid f(void) {\n#endif\n}\n"),
    ("javascript", "#!/usr/bin/env node\nif (a) b()\nelse c()\nx >>>= y >>> 2\n"), ("typescript", "const a = <const>['x'], b = x as const;\n"),
])
def test_ordinary_code(lang, text):
    assert syntax.check_text(text, lang, None) is None


@pytest.mark.parametrize("lang, text", [
    ("c", "#if A\nint x;\n"), ("c", "int x;\n#endif\n"), ("rust", "fn f() { match x { 1 2 => 3 } }\n"), ("rust", "impl A for {}\n"), ("rust", "fn f() { let x = 1 let y = 2; }\n"), ("java", "class A { void f() { if () g(); } }\n"),
    ("java", "class A { void f() { for (int i = 0; i < 3) { } } }\n"), ("go", "package x\n\nfunc f() {\n\tg(a,\n\t\tb\n\t)\n}\n"), ("go", "package x\n\nfunc f() { if { } }\n"), ("typescript", "type A = string |;\n"), ("typescript", "interface A { a string }\n"),
    ("javascript", "function f() { return a b }\n"), ("javascript", "class A { x: number }\n"), ("javascript", "let = = 3\n"), ("javascript", "try { a }\n"),
])
def test_faults_of_statements(lang, text):
    assert syntax.check_text(text, lang, None) is not None
