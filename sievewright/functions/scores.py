"""Column functions for severities, risk, similarity and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename, col, extension, lines

#: Severities from worst to least, with their names in reports.
SEVERITIES = ("bug", "warning", "suggestion", "info")
#: Change types, symbol kinds and levels as they are shown.
KIND_LABELS = {"Function": "fn", "Method": "method", "Struct": "struct", "Enum": "enum", "Trait": "trait", "Impl": "impl", "Class": "class", "Interface": "interface", "Module": "mod"}
SARIF_LEVELS = {"bug": "error", "warning": "warning", "suggestion": "note", "info": "note"}
#: Words that open a branch, as they are counted.
BRANCHES = ("if ", "else if ", "elif ", "match ", "for ", "while ", "loop ", "loop{", "catch ", "catch(", "except ", "except:", "case ")
#: Extensions by how risky a change of them is.
CODE_EXTENSIONS = ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "c", "cpp", "h")
CONFIG_EXTENSIONS = ("toml", "yaml", "yml", "json")
TEXT_EXTENSIONS = ("md", "txt", "rst")


def lookup(values: dict[str, str], c: str | Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col(c))


def severity(c: str | Column) -> Column:
    """A severity's name in lower case, null if unknown."""
    low = F.lower(col(c))
    return F.when(low.isin(*SEVERITIES), low)


def severity_rank(c: str | Column) -> Column:
    """0 for the worst; null if unknown."""
    out = F.when(F.lower(col(c)) == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(F.lower(col(c)) == s, i)
    return out


def meets_threshold(c: str | Column, threshold: str) -> Column:
    return severity_rank(c) <= SEVERITIES.index(threshold)


def branch_count(line: Column) -> Column:
    """Branch words of a line, each at most once, plus one for a question mark with a colon."""
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    total = (t.contains("?") & t.contains(":")).cast("int")
    for word in BRANCHES:
        total = total + (t.startswith(word) | t.contains(" " + word)).cast("int")
    return total


def branch_delta(content: str | Column) -> Column:
    """Branches of added lines less those of removed lines."""
    each = F.transform(
        lines(content), lambda x: F.when(x.startswith("+"), branch_count(F.substr(x, F.lit(2)))).when(x.startswith("-"), -branch_count(F.substr(x, F.lit(2)))).otherwise(0)
    )
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def hunk_complexity(content: str | Column) -> Column:
    return F.least(F.lit(100.0), F.abs(branch_delta(content)) * 15.0)


def marked_lines(content: str | Column, mark: str) -> Column:
    return F.size(F.filter(lines(content), lambda x: x.startswith(mark)))


def file_type_risk(path: str | Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*CODE_EXTENSIONS), 50.0).when(ext.isin(*CONFIG_EXTENSIONS), 20.0).when(ext.isin(*TEXT_EXTENSIONS), 5.0).otherwise(30.0)


def size_risk(changed: Column) -> Column:
    return F.least(changed * 2.0, F.lit(100.0))


def diffusion_risk(n: Column) -> Column:
    return F.least(n * 20.0, F.lit(100.0))


def risk_total(size: Column, complexity: Column, diffusion: Column, coverage: Column, file_type: Column) -> Column:
    total = 0.25 * size + 0.25 * complexity + 0.2 * diffusion + 0.15 * coverage + 0.15 * file_type
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0))


def risk_level(total: Column) -> Column:
    return F.when(total <= 25.0, "low").when(total <= 50.0, "medium").when(total <= 75.0, "high").otherwise("critical")


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity in doubles; 0 for unequal lengths, empty vectors and zero norms."""
    x, y = col(a), col(b)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) != F.size(y)) | (F.size(x) <= 0) | (norms == 0), F.lit(0.0)).otherwise(F.try_divide(dot(x, y), norms))


def change_type(is_new: Column, is_deleted: Column, is_rename: Column) -> Column:
    return F.when(is_new, "add").when(is_deleted, "delete").when(is_rename, "move").otherwise("modify")


def hunk_change_type(is_new: Column, is_deleted: Column, old_lines: Column, new_lines: Column) -> Column:
    return F.when(is_new | (old_lines == 0), "add").when(is_deleted | (new_lines == 0), "delete").otherwise("modify")


def is_lock_name(path: str | Column, names: tuple[str, ...]) -> Column:
    return basename(path).isin(*names)
