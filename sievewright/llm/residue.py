"""Problem 10: template residue, filler, error pages and notices in place of content.

Lines are normalised (case, blanks, digits) and counted by host, here a document's repo, over all
documents. Lines that recur in a host are its boilerplate and are subtracted, unless they carry
evidence themselves. A document is a case if

* an unfilled placeholder stands where a value belongs, outside of code; or
* what remains is evidence: an unfilled form, filler, an error page, a failed rendering or a demand
  to allow scripts, with no content of its own beside it.

Text that speaks of such things keeps its other sentences, and code (fenced, indented by a fence or
between backticks) carries no evidence, so neither is a case.

The counts are joined to the lines of documents that carry evidence only, so the corpus is counted
once and its text never shuffled: what moves are hashes.

Defined results: null, empty and blank texts are no cases; a null host is a host of its own;
repeated rows of a doc_id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notations of template engines and forms for a value to be filled in.
PLACEHOLDER = re.compile(
    r"""\{\{[-\s]*[A-Za-z_][\w. |]*[-\s]*\}\} | \{%[-\s]*\w+[^%\n]*%\} | <%[=-]?[^%\n]+%> | \$\{[A-Za-z_][\w.]*\} | \#\{[A-Za-z_][\w.]*\}
    | (?<![\w$])\$[A-Za-z_]+\$(?![\w$]) | (?<![\w%])%[A-Za-z_]+%(?![\w%]) | %\([A-Za-z_]+\)[sdif] | @@[A-Za-z_]+@@ | «[A-Za-z_]+» | \[\[[A-Za-z_ ]+\]\]
    | \[(?:INSERT|ENTER|ADD|YOUR|FILL\ IN)\b[^\]\n]*\] | <(?:your|insert|enter|add)\s[^>\n]{1,40}> | \bTODO:\s*(?:fill\ in|add|describe|write)\b | __\w+_PLACEHOLDER__
    | \[(?i:(?:your|the|first|last|full|insert|company|customer|client|product|project|team|user)[ _])*(?i:name|company|date|title|address|e-?mail|phone|number|amount|city|product|project|team|room|link|url|position|role|customer|client|username|department|signature|reason|version)\](?![(\[:])
    | (?<![\w{$\#%(\[:.,="'/])\{[A-Za-z_]+\}(?![\w}])""",
    re.X,
)
#: Words of lines that are about placeholders, and names of the environment.
_ABOUT = re.compile(r"(?i)\b(?:templates? engine|placeholders?|variables?|syntax|format strings?|jinja|mustache|handlebars|expands?|prints|interpolat\w+|substitut\w+|notation|grammar|literals?|such as|e\.g\.)\b")
_ENVIRONMENT = re.compile(r"(?i)\b(?:set|use|export|unset|under|in|from|read)\s+(?:the\s+)?\$\{[A-Z][A-Z0-9_]*\}")

# Evidence is told by classes of words, not by sentences: what fails, what it fails on, and a voice that speaks to a
# visitor instead of telling colleagues what was done.
#: States of failure in the corpus's languages.
_FAILS = re.compile(
    r"""(?ix)\b(?:not\ (?:be\ )?(?:found|available|exist|reached|authori[sz]ed|loaded|opened|shown|displayed|rendered|possible)|(?:could|can|does|do|did|is|was|are)(?:\ not|n['’]t)|cannot|unable\ to|failed\ to|no\ longer|never\ existed|unavailable
    |denied|forbidden|refused|(?:has|have|session)\ expired|timed?[ -]?out|too\ long|exceeded|limit\ reached|went\ wrong|unexpected\ error|error\ occurred|encountered|has\ (?:been\ )?(?:moved|removed|deleted)|been\ (?:moved|removed|deleted)|be\ broken|undergoing|down\ for|too\ many|wrong\ while
    |nicht\ (?:\w+\ )?(?:gefunden|erreichbar|verf[üu]gbar|verarbeiten|geladen|angezeigt)|verweigert|keine\ berechtigung|introuvable|indisponible|refusé|erreur\ est\ survenue|non\ trouv[ée]e?|n['’](?:a|est)\ pas|no\ (?:encontrad[oa]|disponible|se\ ha\ podido|pudo|tiene\ permiso)|ya\ no\ est[áa]|denegado)
    |見つかりません|発生しました|拒否されました|表示できません"""
)
#: What fails on a visitor.
_THINGS = re.compile(
    r"""(?ix)\b(?:pages?|site|website|servers?|service|url|address|link|resource|request(?:ed)?|repository|files?|content|session|access|permission|connection|gateway|instance|database|account|view|diff|comparison|merge\ request|pull\ request|maintenance|rate\ limit|requests
    |seite|datei|server|zugriff|anfrage|dienst|page|ressource|serveur|acc[èe]s|service|página|recurso|servidor|acceso|archivo|something|error|erreur|fehler|board|here|it)\b|ページ|サーバー|アクセス|エラー"""
)
#: A voice that speaks to a visitor: of the visitor, of itself as a page or service, or asking for patience.
_VOICE = re.compile(
    r"""(?ix)\b(?:you|your|you['’]re|sorry|oops|please|try\ again|retry|reload|refresh|log\ in\ again|sign\ in\ again|contact|check\ (?:back|the|your)|(?:this|the)\ (?:requested\ )?(?:page|site|url|resource|link|server|instance|service|upstream\ server)\ (?:\S+\ )?(?:is|was|isn['’]t|could|cannot|can|can['’]t|couldn['’]t|does|has|took|failed|encountered|did)|this\ (?:repository|file|site|server|instance|request)|on\ this\ server|requested
    |our\ (?:servers?|end|team)|we(?:['’]re)?\ (?:are\ |could|can|couldn['’]t|can['’]t|cannot)|will\ be\ back|unable\ to|failed\ to|not\ possible|bitte|sie|veuillez|vous|por\ favor|demandée?|solicitad[oa]|diese\ seite|die\ seite|der\ server|le\ service|el\ servidor|el\ recurso|la\ p[áa]gina|la\ page)\b|お探し|しばらく|してください|されました"""
)
#: Words by which colleagues tell what was done, why and when.
_TELLS = re.compile(
    r"""(?ix)^(?:handle|guard|return|fix|add|port|document|retry|show|use|set)\ |\b(?:i|i['’](?:ve|m|d|ll)|because|so\ that|so\ i|so\ the|instead|now|fix(?:e[sd])?|revert(?:ed|s)?|merged|adds?|added|renamed?|handles|handled|returns|retries|rewritten|replaced|raised|restarted|reproduce|when|whenever|after\ the|until|unless|by\ default|per\ (?:team|key|user)|twice|tests?\ (?:is|was|are|for)|was\ (?:hit|seen)|users?\ (?:saw|see|reported)|tells|shows\ the|logged|falls?\ back|still
    |weil|wenn|behoben|jetzt|nun|da\ der|parce\ que|quand|lorsque|corrig\w+|depuis|porque|cuando|ahora)\b|ように|しました。?$(?<!発生しました。)(?<!発生しました)(?<!拒否されました。)"""
)
#: The standard phrases of statuses, and of titles of failure.
_REASON = re.compile(
    r"""(?ix)^\W*(?:(?:http|error|erreur|fehler|status)(?:\ code)?\W*)*(?:[45]\d\d)?\W*(?:page\ |file\ |resource\ )?(?:not\ found|forbidden|unauthori[sz]ed|bad\ request|bad\ gateway|gateway\ time-?out|(?:service\ )?(?:temporarily\ )?unavailable|internal\ (?:server\ )?error|too\ many\ requests|gone|method\ not\ allowed|request\ time-?out|access\ denied|permission\ denied|connection\ (?:refused|timed\ out|reset)|certificate\ error|(?:api\ )?rate\ limit\ (?:exceeded|reached)|something\ went\ wrong|session\ expired|seite\ nicht\ gefunden|p[áa]gina\ no\ encontrada|page\ (?:non\ trouv[ée]e|introuvable))\s*(?:$|[.!:,;(…<\d-]|for\b|on\b|while\b)"""
)
_CODED = re.compile(r"(?i)^\W*(?:(?:http|error|erreur|fehler|status)(?:\s+code)?\W*[45]\d\d\b|[45]\d\d\W*$|[45]\d\d\s*[-–:]\s*\w)")
_RAISED = re.compile(
    r"""(?x)^\s*(?:(?:[A-Za-z_$][\w$]*\.)*\w*(?:Error|Exception|NotFound)\b\s*(?::|$)|(?:Uncaught|Fatal\ error|Unhandled)\b.*:|Traceback\ \(most\ recent|at\ [\w$.<>]+\s?\([^()\s]+:\d+\)$|File\ "[^"]+",\ line\ \d+|(?:Undefined|Undeclared)\ \w+:?\ \S+\ in\ \S+\ on\ line\ \d+|\{\s*"(?:message|error|status|code)"\s*:)
    |(?i:<title>\s*(?:[45]\d\d|error|not\ found))"""
)
#: Lines by which an error page is tracked or left: ids, versions of a server, a way out.
_TRACK = re.compile(r"(?i)^(?:(?:request|trace|incident|error|ray|reference)(?:\s+id)?:?\s+#?[0-9a-f-]{8,}|[\w.-]+/\d+(?:\.\d+)+|(?:reload|refresh)\b.{0,40}|(?:check|try|come)\b.{0,60}\b(?:link|address|again|later|back|access)\b.{0,30}|if (?:this|nothing)\b.{0,60}|our team has been notified.{0,20}|loading [\w\s]{0,30}(?:\.\.\.|…))$")
#: What a slot shows that was never given its value.
_EMPTY = r"(?:undefined|null|none|nan|\[object object\])"
_UNSET = re.compile(
    rf"(?i)\[object Object\]|NaN:NaN|\b(?:hi|hello|dear|welcome(?: back)?),?\s+{_EMPTY}\b|/(?:undefined|null)(?:/|$)|\b(?:of|by|to|from|for)\s+{_EMPTY}\W*$|^[\w ]{{1,20}}:\s{_EMPTY}(?:\s\w+\s{_EMPTY})?$|\b{_EMPTY}\s(?!or\b)\w+\s(?:\w+\s)?{_EMPTY}\b"
)
#: What every placeholder has one of, and what every line about scripts has one of in lower case.
_HINT = re.compile(r"[{%<$#@«\[]|TODO|_PLACEHOLDER__")
_SCRIPT_HINTS = ("script", "js", "ｊｓ")
#: Words about scripts and about having to allow them, in the corpus's languages.
_SCRIPTS = re.compile(r"(?i)\b(?:javascript|scripts?|scripting)\b|javascript|\bJS\b|ＪＳ|<noscript>")
_ALLOW = re.compile(
    r"(?i)\b(?:enabled?|enable|activated?|allow(?:ed)?|turn(?:ed)?(?:\s+\w+)?\s+on|switch(?:ed)?\s+on|required?|requires|needs?|must\s+run|has\s+to\s+be|have\s+to|disabled|not\s+support(?:ed)?|blocked|only\s+with|works\s+(?:only|best)|active|aktivieren|aktiviert|einschalten|activ(?:ez|er|ar|é)|habilit[ea]r?)\b|有効"
)
#: A visitor, or what a visitor wants to do.
_VISITOR = re.compile(
    r"(?i)\b(?:your?|browser|please|visitor|(?:this|the)\s+(?:\w+\s+)?(?:page|site|app|application|view(?:er)?)|nothing\s+happens|to\s+(?:continue|view|see|load|use|run|show|open|read)|continue|reload|before|bitte|um\s+die|seite|veuillez|por\s+favor|para|pour)\b|^(?:enable|activate|allow|turn on|activez|habilite)\b|表示|ください|^\W*(?:javascript|js|scripts?|scripting)\W+(?:is|are|has|have|must)\b"
)
_BROWSER = re.compile(r"(?i)\b(?:check|verif|confirm)\w*\b.{0,30}\b(?:your browser|you are (?:a )?human|your connection)|^just a moment\W*$|your browser (?:is not supported|will redirect)|^(?:please )?(?:complete|solve|verify|pass)\b.{0,30}\b(?:captcha|security check|challenge)|turn(?:ed)? (?:it|them) on in your browser|^ddos protection\b")

#: Shapes of forms: comments, prompts in italics or brackets, blanks, references and marks without content.
FORM = re.compile(
    r"""(?ix)^(?:<!--.*-->|_[^_]{3,60}[?.]_|\([^()]*\b(?:here|images?|screenshots?|expected|delete|paste|drop|describe|attach|add|insert)\b[^()]*\)|.{0,60}\((?:please\ )?delete\b[^)]*\)|a\ clear\ (?:and\ concise\ )?description\ of\ (?:what|how|the\ (?:bug|problem|issue))\b.*
    |(?:please\ )?(?:write|describe|attach|paste|add|enter|insert|put|explain|list|tell\ us)\b[^.]{0,60}\b(?:here|below)\b[^.]{0,24}\.?|(?:please\ )?(?:replace|edit|remove|delete|fill\ in)\ (?:it|this|the)\b.{0,40}\b(?:your|own|paragraph|template|text|description)\b.*|(?:closes|fixes|refs|resolves):?\s*\#?\s*$|\d+\.$|[-*]\s*\[\s?\]\s*(?:\S+(?:\s+\S+)?)?$|[-*]$|[^:]{0,40}:\s*_{4,}.*|_{4,}
    |tbd\.?$|n/a$|\.\.\.$|(?:(?:tbd|todo|to\ be\ (?:written|done|added|filled)(?:\ in)?)[\s.,;]*)+$|todo:?\ (?:write|describe|add|fill\ in)\b.{0,40}|(?:content\ )?coming\ soon\W*)$"""
)
#: Words by which filler says that it is filler.
_FILLS = re.compile(r"(?i)^(?:lorem ipsum\b|(?:this is )?(?:a |some )?(?:placeholder|sample|dummy|example) (?:text|paragraph|content|sentence)\s*(?:[.!…]|$)|(?:(?:your|insert|add|some|more) )?(?:own )?(?:content|text|description|title|paragraph) (?:goes )?here\b)")
_MOCK_LATIN = re.compile(r"(?i)\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|eiusmod|tempor|incididunt|labore|magna|aliqua)\b")
_CHECK = re.compile(r"^[-*]\s*\[\s?\]\s*\S")
_REPEAT = re.compile(r"^([^\d\n]{3,80}?)(?:\s*\1){2,}\W*$")
_KEYS = re.compile(r"(?i)^(?:(?:asdf\w*|qwer\w*|foo|bar|baz|blah|bla|test|xxx+|yyy+|zzz+|dummy)\W*){4,}$")
_ONE = re.compile(r"^([^\W\d_])\1{14,}$")
#: Frequent words of the corpus's languages; filler in mock Latin has none.
COMMON = frozenset(
    "the a an is are was be to of and or in on for with that this it we you not no if by as at from has have its but can will must may should now after before so when each any all der die das ist und ein eine den dem nicht von zu mit wird für auf im le la les un une est et de des du pas qui que pour dans el los las y en con no se es por una cuando está".split()
)
_CODE_SPAN = re.compile(r"`[^`]*`")
_HEADING = re.compile(r"^(?:#{1,6}\s.*|\*\*[^*]{1,60}\*\*:?|[^.!?]{1,40}:|[-=*_]{3,}|\W*)$")
_MENU = re.compile(r"^[^.!?。]{1,80}(?:\s[|·>»]\s[^.!?。]{1,60})+$")


_PLAIN = re.compile(r"[^_`(){}<>=;/\\\d]*$")


def mock_filler(line: str) -> bool:
    """Whether a line is words without sense: few of them over and over, none of them common."""
    if len(line) < 35 or not _PLAIN.match(line):
        return False
    words = re.findall(r"[^\W\d_]+", line.lower())
    kinds = set(words)
    return len(words) >= 12 and len(kinds) <= 0.75 * len(words) and len(kinds) <= 60 and not COMMON.intersection(kinds)


#: What every match of _FAILS has one of, in lower case.
_FAIL_HINTS = (
    "not", "n't", "n’t", "no longer", "unable to", "failed to", "never existed", "unavailable", "denied", "forbidden", "refused", "expired", "timed", "time out", "time-out", "timeout", "too long", "too many", "exceeded", "limit reached", "wrong", "unexpected error", "error occurred",
    "encountered", "has moved", "has removed", "has deleted", "been moved", "been removed", "been deleted", "be broken", "undergoing", "down for", "nicht", "verweigert", "keine berechtigung", "introuvable", "indisponible", "refusé", "survenue", "non trouv", "n'a pas", "n'est pas", "n’a pas", "n’est pas",
    "no encontrad", "no disponible", "no se ha", "no pudo", "no tiene", "ya no est", "denegado", "見つ", "発生", "拒否", "表示",
)
_BROWSER_HINTS = ("browser", "human", "moment", "captcha", "check", "challenge", "ddos", "connection", "them on")


def _says_failure(low: str) -> bool:
    """Whether sentences that make up a third of a line or more tell a visitor of a failure."""
    if not (_FAILS.search(low) and _THINGS.search(low) and _VOICE.search(low)):
        return False
    told = [m.group() for m in re.finditer(r"(?:[^.!?。]|[.!?。](?!\s|$))+[.!?。]*", low)]
    shown = sum(len(x) for x in told if _FAILS.search(x) and (_THINGS.search(x) or _VOICE.search(x)))
    return 3 * shown >= len(low)


def evidence(line: str) -> str | None:
    """What a line outside of code shows: 'error', 'script', 'form', 'filler', 'track' or None."""
    if FORM.match(line):
        return "form"
    if _RAISED.search(line):
        return "error"
    low = line.lower()
    if _CODED.match(line) or _REASON.match(line) or any(h in low for h in _FAIL_HINTS) and _says_failure(low) or ("undefined" in low or "null" in low or "nan" in low or "none" in low or "[object" in low) and _UNSET.search(line):
        return None if _TELLS.search(low) else "error"
    if any(h in low for h in _SCRIPT_HINTS) and not low.startswith("we ") and _SCRIPTS.search(line) and _ALLOW.search(line) and _VISITOR.search(line) or any(h in low for h in _BROWSER_HINTS) and _BROWSER.search(low):
        return None if _TELLS.search(low) else "script"
    if _FILLS.match(line) or ("ipsum" in low or "dolor " in low or "eiusmod" in low) and len(_MOCK_LATIN.findall(low)) >= 4 or len(line) >= 24 and _REPEAT.match(line) or _KEYS.match(line) or _ONE.match(line) or mock_filler(line):
        return "filler"
    return "track" if _TRACK.match(line) else None


_BLANKS = re.compile("[ \t\r\f\x0b]+")
_DIGITS = re.compile("[0-9]+")


def normal(line: str) -> str:
    """A line for counting: lower case, single blanks, digits as 0. The same as normal_column."""
    low = line.lower()
    if "  " in low or "\t" in low or "\r" in low or "\f" in low or "\x0b" in low:
        low = _BLANKS.sub(" ", low)
    return _DIGITS.sub("0", low.strip(" "))


def normal_column(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\f\x0b]+", " ")), "[0-9]+", "0")


def prose_lines(text: str) -> list[str]:
    """The stripped lines outside of code, code spans blanked."""
    out, fence = [], False
    for raw in re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", text):
        line = raw.strip().lstrip("﻿​").strip()
        if line.startswith(("```", "~~~")):
            fence = not fence
            continue
        if line and not fence:
            out.append(line)
    return out


_HEAD = re.compile(r"^(?:#{1,6}\s+\S.{0,80}|\*\*[^*]{1,60}\*\*:?|__[^_]{1,60}__:?|[^\W\d_][^.!?:]{0,39}:)$")


def read(text: str | None) -> tuple[bool, list[tuple[str, str, int]]]:
    """(has an unfilled placeholder, [(line, kind, weight)]) of a text with evidence or headings; no lines without.

    Kinds: evidence as above, 'track', 'head' (headings and labels), 'frame' (menus, short labels) and
    'content'. The weight is the line's length.
    """
    if not text or not text.strip():
        return False, []
    rows, placeholder, shows = [], False, False
    for line in prose_lines(text):
        bare = _CODE_SPAN.sub("`x`", line) if "`" in line else line
        if not placeholder and _HINT.search(bare) and PLACEHOLDER.search(bare) and not _ABOUT.search(bare) and not _ENVIRONMENT.search(bare):
            placeholder = True
        kind = evidence(bare)
        if kind:
            shows |= kind != "track"
        elif _HEAD.match(line):
            kind, shows = "head", True
        elif _HEADING.match(line) or _MENU.match(line) or len(line) <= 48 and not re.search(r"[.!?。,;`_(){}]", line) and len(line.split()) <= 5:
            kind = "frame"
        else:
            kind = "content"
        rows.append((line, kind, len(line)))
    if not placeholder and not shows:
        return False, []
    return placeholder, rows


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "host", "placeholder", "line", "kind", "weight"]
    types = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for doc, host, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            placeholder, rows = read(text)
            if placeholder and not rows:
                rows = [("", "frame", 0)]
            for line, kind, weight in rows:
                for c, v in zip(cols, (doc, host, placeholder, normal(line), kind, weight)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def line_counts(documents: DataFrame, host: str = "repo") -> DataFrame:
    """(host, line_hash, docs, texts): in how many documents of a host a normalised line stands.

    ``texts`` is 1 if all of them are copies of one text, else 2.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), normal_column), lambda x: x != "")
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    return (
        documents.where("text is not null")
        .select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64("text").alias("th"), F.explode(hashes).alias("line_hash"))
        .groupBy("host", "line_hash").agg(F.count("*").alias("docs"), F.when(F.min("th") == F.max("th"), 1).otherwise(2).alias("texts"))
    )


def judged(documents: DataFrame, host: str = "repo", recurrent: int = 3, content_share: float = 0.25) -> DataFrame:
    """(doc_id, placeholder, evidence, prompts, content, is_case) of the documents with evidence or headings.

    A line recurs if at least ``recurrent`` documents of its host have it that are not all copies of one
    text. A document without a placeholder is a case if its residual content weighs at most
    ``content_share`` of its evidence, or if it has headings and under them nothing but lines that recur
    (``prompts``): a form that nobody filled in, whatever its words.
    """
    base = documents.select("doc_id", "text", F.coalesce(F.col(host), F.lit("")).alias("host")).where("doc_id is not null")
    often = line_counts(documents, host).where((F.col("docs") >= recurrent) & (F.col("texts") > 1)).select("host", "line_hash", "docs")
    lines = base.select("doc_id", "host", "text").mapInArrow(
        _read_rows, "doc_id bigint, host string, placeholder boolean, line string, kind string, weight bigint"
    )
    # hashes of lines move, not their texts
    hashed = lines.select("doc_id", "host", "placeholder", "kind", "weight", F.xxhash64("line").alias("line_hash")).distinct()
    residual = hashed.join(often, ["host", "line_hash"], "left")
    shows = F.col("kind").isin("error", "script", "form", "filler")
    plain = F.col("kind").isin("content", "frame")

    def weight(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col("weight"))), F.lit(0))

    return (
        residual.groupBy("doc_id").agg(
            F.max("placeholder").alias("placeholder"),
            weight(shows).alias("evidence"),
            weight(plain & F.col("docs").isNotNull()).alias("prompts"),
            weight((F.col("kind") == "content") & F.col("docs").isNull()).alias("content"),
            weight((F.col("kind") == "frame") & F.col("docs").isNull()).alias("labels"),
            F.max(F.col("kind") == "head").alias("headed"),
        )
        .withColumn(
            "is_case",
            F.col("placeholder") | (F.col("evidence") > 0) & (F.col("content") <= F.lit(content_share) * F.col("evidence"))
            | F.col("headed") & (F.col("prompts") > 0) & (F.col("content") == 0) & (F.col("labels") == 0),
        )
        .select("doc_id", "placeholder", "evidence", "prompts", "content", "is_case")
    )


def found(documents: DataFrame, **how) -> DataFrame:
    """(doc_id) of the cases."""
    return judged(documents, **how).where("is_case").select("doc_id")


def kept(documents: DataFrame, **how) -> DataFrame:
    """The documents that are no cases."""
    return documents.join(found(documents, **how), "doc_id", "left_anti")
