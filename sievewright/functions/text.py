"""Column functions over paths, lines and text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without blanks, tabs and line breaks at either end."""
    return F.regexp_replace(col(c), r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def lines(c: str | Column) -> Column:
    """The lines of a text: no empty last line after a final break, no carriage return at a line's end."""
    parts = F.split(col(c), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def line_count(c: str | Column) -> Column:
    return F.size(lines(c))


def basename(c: str | Column) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def parent_dir(c: str | Column) -> Column:
    """The directory of a path, '' at the root."""
    return F.regexp_extract(col(c), "^(.*)/[^/]*$", 1)


def extension(c: str | Column) -> Column:
    """The part after the last dot of the file name; '' for names without one and for dot files."""
    return F.regexp_extract(basename(c), r"^.+\.([^.]*)$", 1)


def stem(c: str | Column) -> Column:
    """The file name without its extension; a dot file is its own stem."""
    return F.regexp_replace(basename(c), r"^(.+)\.[^.]*$", "$1")


def language(ext: Column) -> Column:
    """The language of an extension, case-sensitively; 'unknown' for the rest."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def path_key(c: str | Column) -> Column:
    """A path as its components, which order as directories do: a/b before a-b."""
    return F.split(col(c), "/")


def common_directory(paths: str | Column) -> Column:
    """The deepest directory that holds all paths of an array, null if that is the root."""
    dirs = F.transform(F.transform(col(paths), parent_dir), lambda p: F.split(p, "/"))
    first = F.element_at(dirs, 1)
    depth = F.aggregate(
        dirs, F.size(first),
        lambda n, d: F.aggregate(
            F.sequence(F.lit(0), F.greatest(F.least(n, F.size(d)) - 1, F.lit(0))), F.lit(0),
            lambda k, i: F.when((k == i) & (F.get(d, i) == F.get(first, i)) & (i < F.least(n, F.size(d))), k + 1).otherwise(k),
        ),
    )
    joined = F.array_join(F.slice(first, 1, depth), "/")
    return F.when(joined == "", None).otherwise(joined)


def group_label(paths: str | Column) -> Column:
    """A file's name, a common directory with a slash, or the first three names."""
    names = F.transform(col(paths), basename)
    few = F.array_join(F.slice(names, 1, 3), ", ")
    common = common_directory(paths)
    return (
        F.when(F.size(names) == 1, F.element_at(names, 1)).when(common.isNotNull(), F.concat(common, F.lit("/")))
        .when(F.size(names) > 3, F.concat(few, F.lit(", ..."))).otherwise(few)
    )


def token_estimate(c: str | Column) -> Column:
    """Bytes div 4."""
    return F.floor(F.octet_length(col(c)) / 4).cast("bigint")


def signature(c: str | Column) -> Column:
    """Cut at the first brace, else at the first colon; blanks collapsed."""
    text = col(c)
    head = F.when(text.contains("{"), F.substring_index(text, "{", 1)).when(text.contains(":"), F.substring_index(text, ":", 1)).otherwise(text)
    return F.trim(F.regexp_replace(head, r"\s+", " "))


def truncate_bytes(c: str | Column, most: int = 80) -> Column:
    """At most ``most`` bytes, ending at a whole character: the longest prefix that fits."""
    text = col(c)
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), lambda n: F.octet_length(F.substr(text, F.lit(1), n)) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(text, F.lit(1), F.array_max(fits)))


def ellipsis(c: str | Column, most: int = 320) -> Column:
    """At most ``most`` characters, the last one an ellipsis if cut."""
    text = col(c)
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(text)


def example(c: str | Column, most: int = 200) -> Column:
    text = col(c)
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)


def context_header(path: Column, kind: Column, name: Column, scope: Column, sign: Column) -> Column:
    """The lines put before a chunk; scope and signature only where there are any."""
    return F.concat_ws(
        "\n", F.concat(F.lit("# File: "), path), F.concat(F.lit("# Type: "), kind), F.concat(F.lit("# Name: "), name),
        F.concat(F.lit("# Scope: "), scope), F.when(sign != "", F.concat(F.lit("# Signature: "), sign)),
    )


def content_hash(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def comment_hash(path: Column, line: Column, message: Column) -> Column:
    """SHA-256 of path, line as four little-endian bytes, and message."""
    big = F.lpad(F.hex(line.cast("bigint")), 8, "0")
    little = F.concat(F.substring(big, 7, 2), F.substring(big, 5, 2), F.substring(big, 3, 2), F.substring(big, 1, 2))
    return F.sha2(F.concat(F.encode(path, "utf-8"), F.unhex(little), F.encode(message, "utf-8")), 256)


#: A run of token characters that looks like a secret: an sk- key, a long mix of letters and digits, or three long dotted parts.
SECRET = (
    r"(?<![A-Za-z0-9_.-])(?:(?=sk-[A-Za-z0-9_.-]{9,})|(?=[A-Za-z0-9_.-]{24,})(?=[A-Za-z0-9_.-]*[A-Za-z])(?=[A-Za-z0-9_.-]*[0-9])"
    r"|(?=[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2,}(?![A-Za-z0-9_.-])))[A-Za-z0-9_.-]+"
)


def redact(c: str | Column) -> Column:
    return F.regexp_replace(col(c), SECRET, "[REDACTED_TOKEN]")


def clean_reason(c: str | Column, extra: tuple[str, ...] = (), most: int = 320) -> Column:
    """Explicit redactions, then secret-like tokens, then the length."""
    out = strip(c)
    for token in extra:
        if token:
            out = F.replace(out, F.lit(token), F.lit("[REDACTED]"))
    return ellipsis(redact(out), most)


def error_reason(body: str | Column) -> Column:
    """What a provider's error body says: its message fields, else its first line that is not blank."""
    text = col(body)
    some = lambda p: F.nullif(strip(F.get_json_object(text, p)), F.lit(""))
    first = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != ""), F.lit(1))
    return F.coalesce(some("$.error.message"), some("$.message"), some("$.detail"), first)


def provider_error(provider: Column, status: Column, status_text: Column, body: Column, extra: tuple[str, ...] = ()) -> Column:
    reason = F.coalesce(error_reason(body), status_text, F.lit("request failed"))
    return F.concat(provider, F.lit(" API error "), F.concat_ws(" ", status.cast("string"), status_text), F.lit(": "), clean_reason(reason, extra))


def is_rate_limit(message: str | Column) -> Column:
    text = F.lower(col(message))
    return text.contains("429") | text.contains("too many requests")


def strip_fences(c: str | Column) -> Column:
    """The inside of a fenced block if the trimmed text is one, else the trimmed text."""
    text = F.trim(F.regexp_replace(col(c), r"^\s+|\s+$", ""))
    inside = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*?)\s*```$", 1)
    return F.when(text.rlike(r"(?s)^```[^\n]*\n.*```$"), F.trim(inside)).otherwise(text)


def keyword_terms(query: str | Column) -> Column:
    """The words of a query with only letters, digits and underscores kept."""
    words = F.transform(F.split(col(query), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}_]", ""))
    return F.filter(words, lambda w: w != "")


def keyword_query(query: str | Column) -> Column:
    """The quoted words joined by OR; '' if none is left."""
    return F.array_join(F.transform(keyword_terms(query), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def slug(c: str | Column) -> Column:
    words = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")
    return F.regexp_replace(F.lower(F.array_join(F.slice(words, 1, 4), "-")), r"[^\p{IsAlphabetic}\p{N}-]", "")


def glob_regex(pattern: str) -> str | None:
    """A glob as an anchored regular expression whose * and ? also match slashes; None if it is malformed."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i:i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1:end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"
