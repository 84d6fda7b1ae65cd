"""Functions paired with their documentation, by island grammars.

A grammar knows only the islands that a pair is made of: documentation, annotations, the signature up to its
balanced brackets, and the body (indentation or balanced braces). All other code is water and skipped. The
documentation is an island language of its own: examples, directives, section headings, fields and prose.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.session import discard, written

#: A sentence of so few words (names left out) is boilerplate if the functions of this share of all names have it, and of so many names.
SHORT, SHARED, LEAST_NAMES = 8, 0.0005, 3

# ---------------------------------------------------------------- islands of source code

_PY_HEAD = re.compile(r"^([ \t]*)(?:((?:async[ \t]+)?def)[ \t]+([^\W\d]\w*)[ \t]*(?=[(\[])|class[ \t]+([^\W\d]\w*))", re.M)
_LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
_PY_WATER = re.compile(r"#[^\n]*|(?:[rRbBfFuUtT]{0,2})(\"\"\"|'''|\"|')")
_PY_DOC = re.compile(r"\s*(?:#[^\n]*\s*)*([rRuU]?)(\"\"\"|'''|\"|')")
#: Strings and comments of languages with braces; a documentation comment is one of them.
_BRACE_WATER = re.compile(r"""\"\"\".*?(?:\"\"\"|\Z)|"(?:[^"\\\n]|\\.)*"?|`[^`]*`?|'(?:\\.|[^'\\\n])'|(?P<block>/\*.*?(?:\*/|\Z))|(?P<lines>//[^\n]*(?:\n[ \t]*//[^\n]*)*)""", re.S)
_BRACE_NAME = re.compile(r"([A-Za-z_$][\w$]*)\s*(?=[<\[(])")
_BRACE_END = re.compile(r"[;{}]")
_NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "function", "func", "fn", "def", "guard", "match"}
_MARKS = re.compile(r"(?m)^[ \t]*(?:\*(?!/)|//[/!]?)[ \t]?")
_RUBY_HEAD = re.compile(r"^(?P<doc>(?:[ \t]*#[^\n]*\n)*)(?P<indent>[ \t]*)(?P<signature>def[ \t]+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)[^\n;]*)", re.M)


def _string_end(text: str, at: int, quote: str) -> int:
    """The place after the string that began with ``quote`` before ``at``; the line's or text's end if it is open."""
    i = at
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text.startswith(quote, i):
            return i + len(quote)
        elif text[i] == "\n" and len(quote) == 1:
            return i
        else:
            i += 1
    return len(text)


def _balanced(text: str, at: int, python: bool) -> int:
    """The place after the bracket that closes the one at ``at``; strings and comments are skipped."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return i + 1
        elif c in "\"'`" and not (c == "`" and python):
            quote = text[i : i + 3] if python and text[i : i + 3] in ('"""', "'''") else c
            i = _string_end(text, i + len(quote), quote)
            continue
        elif (python and c == "#") or (not python and text.startswith("//", i)):
            i = text.find("\n", i)
            if i < 0:
                return len(text)
        elif not python and text.startswith("/*", i):
            i = text.find("*/", i)
            if i < 0:
                return len(text)
            i += 1
        i += 1
    return len(text)


def python_islands(text: str) -> Iterator[tuple[str, str, str | None, str]]:
    """(qualified name, signature, documentation, code) of every function and method."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    water, ends = [], []  # strings and comments, in which no definition begins
    i = 0
    while m := _PY_WATER.search(text, i):
        i = _string_end(text, m.end(), m[1]) if m[1] else m.end()
        water.append(m.start())
        ends.append(i)

    def wet(at: int) -> bool:
        k = bisect_left(water, at) - 1
        return k >= 0 and at < ends[k]

    def decorated(at: int) -> int:
        """The place at which the decorators of the definition at ``at`` begin, or ``at``."""
        begin = at
        while begin:
            line = text.rfind("\n", 0, begin - 1) + 1
            if wet(line) or not text[line:begin].strip():
                break
            if text[line:begin].lstrip().startswith("@"):
                at = begin = line
            elif text[line:begin].lstrip()[0] in ")]}" or text[line:begin].rstrip().endswith((",", "(", "[", "{")):
                begin = line  # within the arguments of a decorator
            else:
                break
        return at

    outer: list[tuple[int, str]] = []  # indents and names of the classes and functions around
    for m in _PY_HEAD.finditer(text):
        if wet(m.start()):
            continue
        indent = len(m[1].expandtabs())
        while outer and outer[-1][0] >= indent:
            outer.pop()
        outer.append((indent, m[3] or m[4]))
        if m[4]:
            continue
        at = text.find("(", m.end())
        closed = _balanced(text, at, True) if at >= 0 else len(text)
        colon = text.find(":", closed)
        while colon >= 0 and text.count("[", closed, colon) > text.count("]", closed, colon):
            colon = text.find(":", colon + 1)
        colon = len(text) if colon < 0 else colon
        doc = None
        if d := _PY_DOC.match(text, colon + 1):
            end = _string_end(text, d.end(), d[2])
            doc = text[d.end() : end - len(d[2])] if text[end - len(d[2]) : end] == d[2] and end > d.end() else text[d.end() : end]
        # the body: lines that are indented more or lie in a string; comments at any indent do not end it
        line = _LINE.match(text, min(colon + 1, len(text)))
        end = line.end()
        while line.end() < len(text):
            line = _LINE.match(text, line.end())
            if wet(line.start()) or (line[2] and len(line[1].expandtabs()) > indent):
                end = line.end()
            elif line[2] and not line[2].startswith("#"):
                break
        yield ".".join(name for _, name in outer), text[m.start(2) : colon], doc, text[decorated(m.start()) : end].rstrip()


def _angles(text: str, at: int) -> int:
    """The place after the type parameters that begin at ``at``, if any; they nest."""
    depth = 0
    for i in range(at, min(len(text), at + 10_000)):
        c = text[i]
        if c in "<[":
            depth += 1
        elif c in ">]" and text[i - 1] not in "-=":
            depth -= 1
            if depth == 0:
                return i + 1
        elif depth == 0 or c in ";{}":
            break
    return at


def _notes(text: str, at: int) -> int:
    """The place after annotations and attributes: a name with balanced arguments, or ``#[...]``."""
    while m := re.compile(r"\s*(?:@\w[\w.]*|#(?=\[))").match(text, at):
        at = m.end()
        if text[at : at + 1] in ("(", "["):
            at = _balanced(text, at, False)
    return re.compile(r"\s*").match(text, at).end()


def brace_islands(text: str) -> Iterator[tuple[str, str, str | None, str]]:
    """The same for languages with doc comments before the signature and bodies in braces.

    Comments in strings open no island. Of an island the annotations belong to the code, not to the signature.
    """
    for m in _BRACE_WATER.finditer(text):
        comment = m["block"] or m["lines"]
        if not comment or not (comment.startswith(("/**", "///", "//!")) or (m["lines"] and re.match(r"\s*func\b", text[m.end() : m.end() + 80]))):
            continue
        doc = _MARKS.sub("", comment.removeprefix("/**").removesuffix("*/") if m["block"] else comment)
        notes = re.compile(r"\s*").match(text, m.end()).end()
        at = _notes(text, m.end())
        body = _BRACE_END.search(text, at)
        end = body.start() if body else len(text)
        name, opened = None, -1
        for n in _BRACE_NAME.finditer(text, at, end):
            opened = _angles(text, n.end())
            opened = re.compile(r"\s*").match(text, opened).end()
            if n[1] not in _NO_NAMES and text[opened : opened + 1] == "(":
                name = n[1]
                break
        if not name:
            continue
        closed = _balanced(text, opened, False)
        body = re.compile(r"[^;{}\n]*(?:\n\s*(?:throws|where|:)[^;{}\n]*)*\s*").match(text, closed).end()
        end = _balanced(text, body, False) if text[body : body + 1] == "{" else min(body, len(text))
        yield name, text[at:body].strip(), doc.strip(), text[notes:end].rstrip()


def ruby_islands(text: str) -> Iterator[tuple[str, str, str | None, str]]:
    """The same for Ruby: comment lines before ``def``, a body up to the ``end`` of the same indent."""
    for m in _RUBY_HEAD.finditer(text):
        close = re.compile(rf"^{m['indent']}end\b", re.M).search(text, m.end())
        doc = re.sub(r"(?m)^[ \t]*# ?", "", m["doc"]).strip()
        yield m["name"], m["signature"].strip(), doc or None, text[m.start("signature") : close.end() if close else len(text)]


GRAMMARS = {"py": python_islands, "pyi": python_islands, **dict.fromkeys(("java", "js", "ts", "c", "h", "cc", "cpp", "cs", "rs", "kt", "php", "go", "scala", "swift"), brace_islands), "rb": ruby_islands}

# ---------------------------------------------------------------- islands of documentation

# Names of sections, fields and marks in the usual documentation styles.
_SECTIONS = r"args|arguments|parameters|params|other parameters|keyword args|keyword arguments|attributes|returns?|yields?|raises?|throws|warns?|warnings?|notes?|examples?|usage|see also|references|todo|methods|receives|parameter"
#: A section's heading: one of these names, or up to three words of any language before a colon.
_SECTION = re.compile(rf"^\s*(?:(?:{_SECTIONS})\s*:?|[^\W\d]\w*(?:\s\w+){{0,2}}\s*:)\s*$", re.I)
_RULE = re.compile(r"^\s*([-=~^*#_+.])\1{2,}\s*$")
_FIELD = re.compile(r"^\s*:(param|parameter|arg|argument|key|keyword|type|raises?|except|exception|return|returns|rtype|yields?|ytype|var|ivar|cvar|vartype|meta)\b([^:]*):\s?(.*)$|^\s*@(param|arg|return|returns|throws|exception|raise|raises|type|rtype|see|since|author|version|deprecated|todo|inheritdoc|override|link)\b\s*(.*)$", re.I)
_TYPE_FIELDS = {"type", "rtype", "ytype", "vartype", "meta", "see", "since", "author", "version", "inheritdoc", "override", "link", "todo"}
_NAMED_FIELDS = {"param", "arg", "throws", "exception", "raise", "raises"}
_DIRECTIVE = re.compile(r"^\s*\.\.\s+[\w:-]+::.*$|^\s*\.\.\s.*$|^\s*\{@\w+[^}]*\}\s*$")
_ITEM = re.compile(r"^\s*\*{0,2}([A-Za-z_]\w*)\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*(?::(?=\s|$)|--|–)\s*(.*)$")
_NUMPY_ITEM = re.compile(r"^\s*\*{0,2}[A-Za-z_]\w*(?:\s*,\s*\*{0,2}[A-Za-z_]\w*)*\s+:(?:\s|$)")
_CODE = re.compile(r"^\s*(?:>>>|\.\.\.(?:\s|$)|\$ )")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n")

# Where a deferral points (with a name, or that of which it is a part), and what may stand after it.
_PLACE = r"(?:above|below|base|super|parent|module|class|superclass|docs?|documentation|interface|readme|manual|source|code|spec|elsewhere|method|function)"
_NAMED = r"(?:`[^`]*`|[\w.]*[._][\w.]*\w|(?-i:[A-Z]\w*))"
_TARGET = rf"{_PLACE}(?:['’]s?)?(?:\s{_PLACE}(?:['’]s?)?|\s{_NAMED}|\s(?:and|or)\s(?:the\s)?{_PLACE}|\s(?:of|in|on|from)\s(?:the\s|its\s|this\s)?(?:{_PLACE}|{_NAMED}))*"
_FURTHER = r"(?:,?\s(?:for|on)(?:\s(?:the|its|more|further|full|all|any|other|complete|a))*\s(?:rest|details?|information|info|more|usage|descriptions?|documentation|docs|explanations?|examples?|references?|parameters|arguments))?(?:\s(?:instead|please|there))?"

# Sentences that put off, refer elsewhere or talk to a tool instead of describing.
_EMPTY_SENTENCE = re.compile(
    rf"""^\W*(?:
    (?:todo|fixme|xxx|tbd|tba|wip|hack)\b.*
  | (?:n/?a|none|null|nil|nothing(?:\shere)?|undocumented|docstring|documentation|description|inherit(?:ed|s)?|placeholder|stub|empty|deprecated|internal|private|ditto)
  | (?:(?:auto-?\s?(?:matically\s)?)?generated\b.*)
  | (?:docstring|documentation|description|text|comment|summary)\s(?:goes|comes|to\sfollow|follows|pending|here)\b.*
  | (?:no|missing|lacks?|needs?|without|empty)\s(?:\w+\s)?(?:documentation|docs?|docstrings?|description|comments?)(?:\s(?:is|are|was|were|has|have|been|yet|available|provided|given|needed|required|necessary|exists?|present|found|written|here|so\sfar|at\sall|currently|for\snow|(?:for|of)\sth(?:is|e)\s(?:function|method|class|module)))*
  | (?:add|write|insert)\s(?:(?:the|a|an|some|more|proper|missing|your)\s)?(?:documentation|docs?|docstrings?|descriptions?|comments?)(?:\s(?:here|later|soon|now|please))?
  | (?:to\sbe|not(?:\syet)?)\s(?:documented|described|written|done|added|implemented)\b.*
  | (?:inherits?|inherited|copied|taken)\s(?:the\s)?(?:docs?|docstring|documentation|from)\b.*
  | (?:see|refer\sto|cf\.?|look\sat|consult|same\sas|as\sin|as\sabove|like\sin)\s(?:also\s)?(?:the\s|its\s)?(?!(?:that|whether|if|how|why|what|when|where|which|who)\b)(?:[\w.]+\s){{0,3}}?{_TARGET}{_FURTHER}
  | (?:check|overrides?|implements?)\s(?:also\s)?(?:the\s|its\s)?{_TARGET}{_FURTHER}
  | (?:see|refer\sto)\s:?\w*:?`[^`]*`\W*
  | (?:noqa|type:\s?ignore|pylint\b|flake8\b|mypy\b|isort\b|pragma\b|fmt\b|ruff\b|nosec|coding|pyright\b|yapf\b|nopep8).*
    )\W*$""",
    re.I | re.X | re.S,
)
_NOTE = re.compile(r"\W*(?:todo|fixme|xxx|hack|wip)\b\W*(?:(?:later|soon|now)\b\W*)?", re.I)
# Words that say nothing about behaviour when only the name's words stand beside them.
_FILLER = set("a an the this that these function method routine helper procedure callable class object module value values result results return returns param params parameter parameters arg args argument arguments type types of for to and or in on with is are be it its self cls def by from as at via given using given into".split())


def own_text(doc: str) -> list[str]:
    """The descriptive sentences of a documentation text, without examples, headings, field names and types."""
    lines = doc.replace("\r\n", "\n").replace("\r", "\n").expandtabs().split("\n")
    out: list[str] = []
    code = fence = numpy = False
    section, base = False, 0
    for k, line in enumerate(lines):
        s = line.strip()
        if _FENCE.match(line):
            fence = not fence
            continue
        if fence:
            continue
        if _CODE.match(line) and (code or s.startswith((">>>", "$ "))):
            code = True
            continue
        if not s:
            code = False
            out.append("")
            continue
        if code:  # an example's output
            continue
        if _RULE.match(line) or _DIRECTIVE.match(line):
            continue
        if _SECTION.match(line):
            section, base = True, len(line) - len(line.lstrip())
            numpy = k + 1 < len(lines) and bool(_RULE.match(lines[k + 1]))
            out.append("")
            continue
        if k + 1 < len(lines) and _RULE.match(lines[k + 1]) and lines[k + 1].strip()[0] in "-=~^":
            out.append("")  # an underlined heading
            continue
        if f := _FIELD.match(line):
            name, rest = (f[1] or f[4]).lower(), (f[3] if f[1] else f[5]) or ""
            if name in _TYPE_FIELDS:
                continue
            if f[4] and name in _NAMED_FIELDS:
                rest = rest.partition(" ")[2]
            out += ["", rest]
            continue
        indent = len(line) - len(line.lstrip())
        if section and indent < base + (0 if numpy else 1):
            section = False
        if section and numpy and _NUMPY_ITEM.match(line):
            continue
        if section and numpy and indent <= base and re.fullmatch(r"[\w.\[\], |]+", s):
            continue  # a bare type
        if section and (item := _ITEM.match(line)):
            out += ["", item[2]]
            continue
        out.append(s)
    return [s.strip() for s in _SENTENCE.split("\n".join(out)) if s.strip()]


def _names(*texts: str | None) -> set[str]:
    """The words of names, signatures and types: whole, and cut at capitals and underscores."""
    joined = " ".join(t for t in texts if t)
    words = {w.lower() for w in _WORD.findall(joined)} | {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", joined)}
    return words | {w + "s" for w in words} | {w + "es" for w in words}


def own_sentences(doc: str | None, name: str | None, signature: str | None, island: str | None = None) -> list[str]:
    """The sentences that say something in words that name, signature and types lack, in lower case, names left out.

    ``island`` is the signature with its annotations as the code has it; the stored ``signature`` runs the name
    into its first parameter. Placeholders, deferrals and notes to tools are no such sentences.
    """
    if not doc or not _WORD.search(doc):
        return []
    known, out = None, []
    for sentence in own_text(doc):
        # a note to oneself may stand before a description; alone it is a placeholder
        noted = _NOTE.match(sentence)
        sentence = sentence[noted.end() :] if noted else sentence
        if _EMPTY_SENTENCE.match(sentence):
            continue
        if known is None:
            known = _names(name, signature, (signature or "").removeprefix((name or "").rpartition(".")[2]), island)
        words = [w.lower() for w in _WORD.findall(sentence)]
        if sum(w not in known and w not in _FILLER for w in words) >= (5 if noted else 2):
            out.append(" ".join(w for w in words if w not in known))
    return out


def described(doc: str | None, name: str | None, signature: str | None, island: str | None = None, boilerplate: frozenset[int] = frozenset()) -> bool:
    """Whether the documentation says in words of its own what a function does, takes or gives.

    False for null and blank texts, mere marks, placeholders, deferrals, notes to tools, empty headings and
    fields, examples alone, texts of no other words than those of the name, the signature and its types, and
    texts of sentences that functions of many names share (``boilerplate``, see ``shared_sentences``).
    """
    return any(len(s.split()) > SHORT or _code(s) not in boilerplate for s in own_sentences(doc, name, signature, island))


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def code_island(code: str | None, name: str | None) -> tuple[str, str, str | None, str] | None:
    """The island of a function in its excerpt: the one of its name, or else the first."""
    first = None
    for island in python_islands(code or ""):
        if island[0].rpartition(".")[2] == (name or "").rpartition(".")[2]:
            return island
        first = first or island
    return first


# ---------------------------------------------------------------- Spark


def _islands(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The columns of a row and the signature of its code's island."""
    for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        island = code_island(row[4], row[2])
        yield *row, island[1] if island else None


def shared_sentences(functions: DataFrame) -> frozenset[int]:
    """Codes of the short sentences that the functions of many names share: placeholders of whatever language.

    ``functions`` has ``id, doc, name, signature, code``. A sentence is shared if functions of SHARED of all names,
    and of LEAST_NAMES, have it; names are last parts, so that versions and overrides of one function count once.
    As each function has few sentences, few can be shared by so many: the set does not grow with the functions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = [], []
            for _, doc, name, signature, _, island in _islands(batch):
                last = _code((name or "").rpartition(".")[2])
                short = {s for s in own_sentences(doc, name, signature, island) if len(s.split()) <= SHORT}
                for code in {_code(s) for s in short} or {None}:
                    names.append(last)
                    codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(codes, pa.int64())], ["name", "sentence"])

    pairs = written(functions.mapInArrow(run, "name long, sentence long").distinct())
    every = pairs.select("name").distinct().count()
    used = pairs.where("sentence is not null").groupBy("sentence").agg(F.count("*").alias("names"))
    out = frozenset(r["sentence"] for r in used.where(F.col("names") >= max(LEAST_NAMES, SHARED * every)).select("sentence").collect())
    discard(pairs)
    return out


def documented_functions(functions: DataFrame, *, id_col: str, doc_col: str, name_col: str, signature_col: str, code_col: str) -> DataFrame:
    """Code-description pairs: ``id, name, signature, description, code`` of the functions that are described.

    The code's islands give the signature with its annotations, and the documentation is judged by what it adds to
    them (see ``described``); sentences that functions of many names share add nothing. Rows whose documentation
    is null, blank or trivial drop out; a null name, signature or code is kept as null, but for a null signature,
    which is cut out of the code; repeated rows come out as often as they go in; whole texts are read.
    """
    schema = "id string, name string, signature string, description string, code string"
    rows = functions.select(*[F.col(c).cast("string") for c in (id_col, doc_col, name_col, signature_col, code_col)])
    rows = rows.where(F.trim(F.col(rows.columns[1])) != "").toDF("id", "doc", "name", "signature", "code")
    boilerplate = functions.sparkSession.sparkContext.broadcast(shared_sentences(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, doc, name, signature, code, island in _islands(batch):
                if described(doc, name, signature, island, boilerplate.value):
                    out.append((i, name, signature if signature is not None else island, "\n".join(line.rstrip() for line in doc.strip().replace("\r\n", "\n").split("\n")), code))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(5)], ["id", "name", "signature", "description", "code"])

    return rows.mapInArrow(run, schema)


def source_functions(files: DataFrame, *, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """Every function of source files: ``id, name, signature, doc, code``; the grammar goes by the path's extension.

    Files with a null text, a null path or an extension without grammar give no rows; what a grammar does not
    know is skipped, so files that do not parse give the functions that can be told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out += [(i, *island) for island in GRAMMARS[path.rpartition(".")[2].lower()](text)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(5)], ["id", "name", "signature", "doc", "code"])

    known = F.lower(F.substring_index(F.col(path_col), ".", -1)).isin(*GRAMMARS)
    return files.where(known & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), path_col, text_col).mapInArrow(run, "id string, name string, signature string, doc string, code string")
