"""Source files that do not parse: lexer-state maps and bracket summaries of chunks, then local grammars.

A file is cut into chunks. A chunk's summary says, for every lexer state that it may begin in, the state that it
ends in and the brackets that are left when those closed within the chunk are taken out. Summaries combine
associatively. A file whose combined summary ends inside of a string, or with a bracket that is open, was never
opened or is closed by another kind, does not parse; no parser is asked. For JSON the summary holds commas, colons
and values as well, so that it decides alone. The statements of Python and TOML files (cut where no bracket and no
string is open) are parsed each for itself; of a TOML file the names that its statements set are then compared.
Files of one chunk take all of these steps in the pass that reads them; chunks of longer files are shuffled by
their summaries alone.
"""

from __future__ import annotations

import ast
import re
import tomllib
import warnings
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.session import written

CHUNK_CHARS = 4096
#: The language by the extension of the path (fixed values).
LANGUAGES = {"py": "python", "pyi": "python", "json": "json", "toml": "toml"}
#: Lexer states that a chunk may begin in: outside of strings, then inside of a string of that prefix and quote.
STATES = {"python": ("", "'''", '"""', "f'''", 'f"""', "rf'''", 'rf"""'), "toml": ("", "'''", '"""'), "json": ("", '"')}
#: End of a chunk inside of a replacement field: no state that another chunk could begin in.
IN_FIELD = -1
#: Levels of brackets that the parser of TOML statements sees at once; what lies deeper is parsed before.
LEVELS = 60
CLOSES = {")": "(", "]": "[", "}": "{"}

# ---------------------------------------------------------------- bracket summaries


class _Reduction:
    """What is left of a text; feeding it what is left of the next text gives what is left of both."""

    bad = False

    def feed(self, symbol: str) -> None: ...

    def feed_all(self, symbols: str) -> None:
        for c in symbols:
            if c == "!" or self.bad:
                self.bad = True
                return
            self.feed(c)


class Brackets(_Reduction):
    """The brackets of Python or TOML text that are left: those that close what came before, then the open ones."""

    def __init__(self):
        self.closing: list[str] = []
        self.open: list[str] = []

    def feed(self, c: str) -> None:
        if c not in CLOSES:
            self.open.append(c)
        elif not self.open:
            self.closing.append(c)
        elif self.open.pop() != CLOSES[c]:
            self.bad = True

    def depth(self) -> int:
        return len(self.open) - len(self.closing)

    def left(self) -> str:
        return "!" if self.bad else "".join(self.closing + self.open)

    def complete(self) -> bool:
        return not (self.bad or self.closing or self.open)


class Json(_Reduction):
    """What is left of a JSON text when its balanced parts are reduced to values (a shift-reduce parse).

    Symbols: brackets, comma, colon, ``s`` string, ``v`` value, ``w`` several values with commas, ``m`` members.
    What precedes the text is unknown, so closing brackets may stay at the left, and a first value may be a
    member's. Any text of JSON reduces to one value; two neighbouring texts are combined by feeding one's
    symbols to the other.
    """

    def __init__(self):
        self.stack: list[str] = []
        self.opened = 0

    def _top(self, k: int = 1) -> str | None:
        return self.stack[-k] if len(self.stack) >= k else None

    def _merge(self) -> None:
        """The value on top, with the value and the comma before it if both are elements."""
        if self.stack[-1] == "s":
            self.stack[-1] = "v"
        if self._top() in ("v", "w") and self._top(2) == ",":
            before = self._top(3)
            if before in ("v", "w", "s"):
                self.stack[-3:] = ["w"]
            elif before == "m":
                self.bad = True

    def _value(self) -> None:
        """A value was put on top: with a key and a colon it is a member."""
        if self._top(2) == ":" and self._top(3) == "s":
            self.stack[-3:] = ["m"]
            self._members()

    def _members(self) -> None:
        if self._top(2) == ",":
            if self._top(3) == "m":
                self.stack[-3:] = ["m"]
            elif self._top(3) == "w" or (self._top(3) in ("v", "s") and len(self.stack) > 3 and self._top(4) != ":"):
                self.bad = True

    def feed(self, t: str) -> None:
        top = self._top()
        if t in "[{svw":
            if not (top in (None, ",", ":") or top == "[" or (top == "{" and t == "s")) or (t == "w" and top == ":" and len(self.stack) > 1):
                self.bad = True
                return
            self.stack.append(t)
            if t in "[{":
                self.opened += 1
            elif t != "w":
                self._value()
        elif t == "m":
            if top not in (None, ",", "{"):
                self.bad = True
                return
            self.stack.append(t)
            self._members()
        elif t == ":":
            if top is None or (top == "s" and self._top(2) in (None, "{", ",")):
                self.stack.append(t)
            else:
                self.bad = True
        elif t == ",":
            if top in ("v", "s", "w"):
                self._merge()
            elif top not in (None, "m", "]", "}"):
                self.bad = True
            self.stack.append(t)
        else:
            self._close(t, top)

    def _close(self, t: str, top: str | None) -> None:
        if t == "]" and top in ("v", "s", "w"):
            self._merge()
            top = self._top()
        inner = ("v", "w") if t == "]" else ("m",)
        if top == CLOSES[t] or (top in inner and self._top(2) == CLOSES[t]):
            self.stack[-1 if top == CLOSES[t] else -2 :] = ["v"]
            self.opened -= 1
            self._value()
        elif self.opened or top == "," or (t == "]" and top == "m") or (t == "}" and (top == "w" or (top in ("v", "s") and self._top(2) != ":" and len(self.stack) > 1))):
            self.bad = True
        else:
            self.stack.append(t)

    def depth(self) -> int:
        return 0  # its statements are not looked at

    def left(self) -> str:
        return "!" if self.bad else "".join(self.stack)

    def complete(self) -> bool:
        return not self.bad and self.stack in (["v"], ["s"])


def reduction(language: str) -> Brackets | Json:
    return Json() if language == "json" else Brackets()


# ---------------------------------------------------------------- lexers

#: First words that go on with a statement of the line before.
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
_PLACE = re.compile(r"""#[^\n]*|(?:(?<!\w)([rRbBuUfF]{1,2}))?(\"\"\"|'''|"|')|[()\[\]{}]|(?<!\\)\n(?=[^\s#)\]}\\])""")
_TOML_PLACE = re.compile(r"""#[^\n]*|(\"\"\"|'''|"|')|[\[\]{}]|\n(?=[ \t]*[^\s#])""")
_JSON_TOKEN = re.compile(r"""[ \t\n\r]+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)|([\[\]{},:])""")
_JSON_STRING = re.compile(r"""(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*""")
_JSON_WORD = re.compile(r"[\w.+-]")
#: In an f-string: what escapes, opens or ends.
_F_TEXT = re.compile(r"""\\N\{[^}]*\}|\\[^{}]|\{\{|\}\}|\{|\}|"+|'+|\n""", re.S)
_F_SPEC = re.compile(r"""\\.|\{|\}|"+|'+|\n""", re.S)
_F_CODE = re.compile(r"""#[^\n]*|(?:(?<!\w)([rRbBuUfF]{1,2}))?(\"\"\"|'''|"|')|[()\[\]{}]|!=|:""")
_CLOSED = {q: re.compile(rf"(?:[^\\\n{q}]|\\.)*({q}?)", re.S) for q in "'\""}


def normal(language: str, text: str) -> str:
    """Python's line ends as its parser sees them."""
    return text.replace("\r\n", "\n").replace("\r", "\n") if language == "python" else text


def cut_chunks(language: str, text: str, size: int) -> list[str]:
    """Chunks of about ``size`` characters, cut at line ends only and none after a backslash.

    JSON is cut after a line end or a mark of its own where one comes within another ``size`` characters, which
    leaves words, numbers and escapes whole.
    """
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        if language == "json":
            m = re.compile(r"[\n,:\[\]{}]").search(text, end)
            end = m.end() if m else len(text)
        else:
            while True:
                end = text.find("\n", end) + 1 or len(text)
                if end >= len(text) or text[end - 2 : end - 1] not in ("\\", "\r"):
                    break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def _string_end(text: str, at: int, quote: str, escapes: bool) -> int:
    """The place after the closing ``quote`` of three, or -1."""
    while (end := text.find(quote, at)) >= 0:
        back = end
        while escapes and back > at and text[back - 1] == "\\":
            back -= 1
        if (end - back) % 2 == 0:
            return end + len(quote)
        at = end + 1
    return -1


def _f_string(text: str, at: int, prefix: str, quote: str) -> tuple[int, str]:
    """The place after an f-string whose text goes on at ``at``, and "" or where the text ends in it.

    ``text`` for its literal part, ``field`` for a replacement field. Nested strings and fields lie on a stack.
    """
    frames: list[list] = [["text", quote, "r" in prefix.lower()]]
    while at < len(text):
        kind, q, raw = frames[-1]
        if kind in ("text", "spec"):
            m = (_F_TEXT if kind == "text" else _F_SPEC).search(text, at)
            if not m:
                break
            t = m[0]
            if raw and t.startswith("\\N{"):
                at = m.start() + 2
            elif t[0] in "\"'":
                if t[0] == q[0] and len(t) >= len(q):
                    at = m.start() + len(q)
                    while frames[-1][0] != "text":  # a format spec left open
                        frames.pop()
                    frames.pop()
                    if not frames:
                        return at, ""
                else:
                    at = m.end()
            elif t == "\n":
                if len(q) == 1:
                    while frames and frames[-1][0] != "text":
                        frames.pop()
                    frames.pop()
                    at = m.start()
                    if not frames:
                        return at, ""  # an open string of one line, which its statement will not parse with
                else:
                    at = m.end()
            elif t == "{":
                frames.append(["code", q, 0])
                at = m.end()
            elif t == "}" and kind == "spec":
                frames.pop()
                frames.pop()
                at = m.end()
            else:
                at = m.end()
            continue
        m = _F_CODE.search(text, at)
        if not m:
            at = len(text)
            break
        t, at = m[0], m.end()
        if m[2]:
            p = (m[1] or "").lower()
            if "f" in p:
                frames.append(["text", m[2], "r" in p])
            elif len(m[2]) == 3:
                at = _string_end(text, at, m[2], True)
                if at < 0:
                    break
            else:
                at = _CLOSED[m[2]].match(text, at).end()
        elif t in "([{":
            frames[-1][2] += 1
        elif t in ")]" or (t == "}" and frames[-1][2]):
            frames[-1][2] -= 1
        elif t == "}":
            frames.pop()
        elif t == ":" and not frames[-1][2]:
            frames.append(["spec", q, False])
    return len(text), "text" if len(frames) == 1 else "field"


def _lex_code(language: str, text: str, state: int, brackets: Brackets, places: list[tuple[int, int]]) -> int:
    python = language == "python"
    token, states = _PLACE if python else _TOML_PLACE, STATES[language]
    at, opened = 0, states[state]
    while True:
        if opened:
            prefix, quote = opened.rstrip("'\""), opened.lstrip("rf")
            if prefix:
                at, where = _f_string(text, at, prefix, quote)
                if where:
                    return states.index(opened) if where == "text" else IN_FIELD
            else:
                at = _string_end(text, at, quote, python or quote[0] == '"')
                if at < 0:
                    return states.index(opened)
                while not python and text[at : at + 1] == quote[0]:
                    at += 1  # up to two quotes before the closing ones are part of the string
            opened = ""
        for m in token.finditer(text, at):
            t = m[0]
            if t in "()[]{}":
                brackets.feed(t)
            elif t[0] == "\n":
                places.append((m.end(), brackets.depth()))
            elif t[0] != "#":
                prefix, quote = ((m[1] or "").lower(), m[2]) if python else ("", m[1])
                at = m.end()
                if "f" in prefix:
                    kind = ("rf" if "r" in prefix else "f") + quote
                    at, where = _f_string(text, at, kind.rstrip("'\""), quote)
                    if where:
                        return states.index(kind) if where == "text" and len(quote) == 3 else IN_FIELD if where == "field" else 0
                elif len(quote) == 3:
                    opened = quote
                elif python or quote == '"':
                    at = _CLOSED[quote].match(text, at).end()
                else:
                    at = re.compile(r"[^'\n]*'?").match(text, at).end()
                break
        else:
            return 0


def _lex_json(text: str, state: int, left: Json) -> int:
    at = 0
    if state:
        at = _JSON_STRING.match(text).end()
        if at == len(text):
            return 1
        if text[at] != '"':
            left.bad = True
            return 0
        at += 1
        left.feed("s")
    while at < len(text) and not left.bad:
        m = _JSON_TOKEN.match(text, at)
        if not m:
            if text[at] == '"' and _JSON_STRING.match(text, at + 1).end() == len(text):
                return 1
            left.bad = True
            break
        at = m.end()
        if m[1]:
            left.feed("s")
        elif m[2]:
            left.bad |= bool(_JSON_WORD.match(text, at))
            left.feed("v")
        elif m[3]:
            left.feed(m[3])
    return 0


def lex(language: str, text: str, state: int) -> tuple[int, Brackets | Json, list[tuple[int, int]]]:
    """End state, what is left of the brackets, and the places where a statement may begin with the depth there."""
    left, places = reduction(language), []
    end = _lex_json(text, state, left) if language == "json" else _lex_code(language, text, state, left, places)
    return end, left, places


def summary(language: str, text: str) -> list[tuple[int, str]]:
    """For every start state the end state and what is left."""
    out = []
    for s, opened in enumerate(STATES[language]):
        quote = opened.lstrip("rf")
        if len(quote) == 3 and quote not in text and not (opened != quote and "{" in text):
            out.append((s, ""))  # the chunk lies wholly inside of the string
        else:
            end, left, _ = lex(language, text, s)
            out.append((end, left.left()))
    return out


def _boundaries(language: str, text: str, start: int, depth: int, places: list[tuple[int, int]]) -> list[int]:
    """The places of a chunk at which a statement begins; what belongs to the one before is no beginning."""
    cuts = [p for p, d in places if d + depth == 0]
    first = text[:1] not in ("", " ", "\t", "\f", "#", "\n", "\r", "\\") if language == "python" else bool(re.match(r"[ \t]*[^\s#]", text))
    if start == 0 and depth == 0 and first:
        cuts = [0, *cuts]
    if language != "python":
        return cuts
    kept, decorated = [], False
    for p in cuts:
        if not decorated and not _GOES_ON.match(text, p):
            kept.append(p)
        decorated = text.startswith("@", p)  # what follows a decorator belongs to it
    return kept


# ---------------------------------------------------------------- local grammars

#: Long runs of unary operators and the like, which are as valid as two of them.
_UNARY = re.compile(r"((?:[-+~][ \t]*){2})(?:[-+~][ \t]*){50,}|((?:\bnot[ \t]+){2})(?:not[ \t]+){50,}|((?:\blambda[ \t]*:[ \t]*){2})(?:lambda[ \t]*:[ \t]*){50,}")


def _python_fails(piece: str) -> bool:
    try:
        ast.parse(piece)
    except (SyntaxError, ValueError):
        return True
    except RecursionError:
        return False  # the grammar took it; only its tree is too deep to be handed out
    except MemoryError:  # nested too deeply for the parser's stack, which is no error of the text
        shorter = _UNARY.sub(lambda m: m[1] or m[2] or m[3], piece)
        return shorter != piece and _python_fails(shorter)
    return False


def _toml_fails(piece: str) -> bool:
    """Parses a statement; brackets of more than LEVELS levels are parsed from the inside and become a value."""
    opened, cut, spans = [], [], []
    at = 0
    while m := _TOML_PLACE.search(piece, at):
        t, at = m[0], m.end()
        if t in "[{":
            opened.append(m.start())
        elif t in "]}" and opened:
            start = opened.pop()
            if len(opened) and len(opened) % LEVELS == 0:
                inner = [s for s in spans if s[0] > start]
                del spans[len(spans) - len(inner) :]
                spans.append((start, m.end()))
                cut.append((start, m.end(), inner))
        elif m[1]:
            if len(t) == 3:
                at = _string_end(piece, at, t, t[0] == '"')
                if at < 0:
                    break
            else:
                at = (_CLOSED[t] if t == '"' else re.compile(r"[^'\n]*'?")).match(piece, at).end()

    def shown(start: int, end: int, inner: list[tuple[int, int]]) -> str:
        out, at = [], start
        for a, b in inner:
            out += [piece[at:a], "0"]
            at = b
        return "".join([*out, piece[at:end]])

    try:
        for start, end, inner in cut:
            tomllib.loads("x = " + shown(start, end, inner))
        tomllib.loads(shown(0, len(piece), spans))
    except (ValueError, RecursionError):
        return True
    return False


_TOML_KEY = r"""(?:[A-Za-z0-9_-]+|"(?:[^"\\\n]|\\.)*"|'[^'\n]*')"""
_TOML_NAME = re.compile(rf"""[ \t]*({_TOML_KEY}(?:[ \t]*\.[ \t]*{_TOML_KEY})*)[ \t]*=[ \t]*([\[{{]?)""")
_TOML_HEAD = re.compile(rf"""[ \t]*(\[\[?[ \t]*{_TOML_KEY}(?:[ \t]*\.[ \t]*{_TOML_KEY})*[ \t]*\]\]?)""")


def toml_name(statement: str) -> str:
    """What a valid statement sets, with a plain value of its kind; "" for comments alone."""
    if head := _TOML_HEAD.match(statement):
        return head[1]
    m = _TOML_NAME.match(statement)
    return f"{m[1]} = {({'[': '[]', '{': '{}'}).get(m[2], '0')}" if m else ""


def fails(language: str, statement: str) -> bool:
    """Whether one statement of Python or TOML does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _python_fails(statement) if language == "python" else _toml_fails(statement)


def names_clash(names: list[str]) -> bool:
    """Whether the names that a TOML file's statements set contradict each other."""
    try:
        tomllib.loads("\n".join(names))
    except (ValueError, RecursionError):
        return True
    return False


def invalid(language: str, text: str) -> bool:
    """Whether a text of one chunk does not parse: its summary first, then its statements."""
    text = normal(language, text)
    end, left, places = lex(language, text, 0)
    if end or not left.complete():
        return True
    if language == "json":
        return False
    bounds = [0, *[p for p in _boundaries(language, text, 0, 0, places) if p], len(text)]
    statements = [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    if any(fails(language, s) for s in statements):
        return True
    return language == "toml" and names_clash([n for s in statements if (n := toml_name(s))])


# ---------------------------------------------------------------- Spark


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [r for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in make(*row)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_FILE = [("id", _S), ("language", _S), ("digest", _S)]
_FIRST = pa.schema([*_FILE, ("n", _I), ("chunk", _S), ("ends", pa.list_(_I)), ("left", pa.list_(_S))])
_STARTS = pa.schema([*_FILE, ("n", _I), ("last", _B), ("state", _I), ("depth", _I)])
_PARTS = pa.schema([*_FILE, ("n", _I), ("place", _I), ("kind", _S), ("part", _S)])
_FLAGGED = pa.schema(_FILE[:2])
_FILE_SQL = "id string, language string, digest string"


def _summarised(size: int, key: str, language: str, digest: str, text: str) -> list[tuple]:
    """The row of a file of one chunk that does not parse (n is -1), or a row for each chunk of a longer one."""
    text = normal(language, text)
    parts = cut_chunks(language, text, size)
    if len(parts) == 1:
        return [(key, language, digest, -1, None, None, None)] if invalid(language, text) else []
    out = []
    for n, part in enumerate(parts):
        ends, left = zip(*summary(language, part), strict=True)
        out.append((key, language, digest, n, part, ends, left))
    return out


def _started(key: str, language: str, digest: str, maps: list[dict]) -> list[tuple]:
    """Where each chunk of a file begins; one row with n -1 if the summary decides, -2 if a border lies in a field."""
    out, state, so_far = [], 0, reduction(language)
    for x in maps:
        out.append((key, language, digest, x["n"], x["n"] == len(maps) - 1, state, so_far.depth()))
        so_far.feed_all(x["left"][state])
        state = x["ends"][state]
        if state == IN_FIELD:
            return [(key, language, digest, -2, False, 0, 0)]
        if so_far.bad:
            break
    if state or not so_far.complete():
        return [(key, language, digest, -1, False, 0, 0)]
    return [] if language == "json" else out


def _parsed(key: str, language: str, digest: str, n: int, last: bool, state: int, depth: int, chunk: str) -> list[tuple]:
    """Of a chunk: its failure, the names that its statements set, and the pieces that go on in its neighbours.

    The first statement of a chunk goes with them, as a decorator may stand at the end of the chunk before.
    """
    _, _, places = lex(language, chunk, state)
    cuts = _boundaries(language, chunk, state, depth, places)
    bounds = [*cuts, len(chunk)]
    pieces = [(a, chunk[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    out = []
    row = lambda place, kind, part: out.append((key, language, digest, n, place, kind, part))
    if bounds[0]:
        row(-1, "goes on", chunk[: bounds[0]])
    for k, (at, piece) in enumerate(pieces):
        if (k == 0 and n) or (k == len(pieces) - 1 and not last):
            row(at, "begins", piece)
        elif fails(language, piece):
            return [(key, language, digest, n, 0, "bad", None)]
        elif language == "toml" and (name := toml_name(piece)):
            row(at, "name", name)
    return out


def _joined(key: str, language: str, digest: str, parts: list[dict]) -> list[tuple]:
    """Judges the statements that lie over the borders of chunks, and then the names of all statements."""
    names: list[str] = []
    run: list[str] = []

    def ended() -> bool:
        if not run:
            return False
        statement = "".join(run)
        run.clear()
        if fails(language, statement):
            return True
        if language == "toml" and (name := toml_name(statement)):
            names.append(name)
        return False

    for x in parts:
        if x["kind"] == "bad":
            return [(key, language)]
        if x["kind"] == "goes on" or (x["kind"] == "begins" and language == "python" and _decorated("".join(run))):
            run.append(x["part"])
            continue
        if ended():
            return [(key, language)]
        if x["kind"] == "begins":
            run.append(x["part"])
        else:
            names.append(x["part"])
    return [(key, language)] if ended() or (language == "toml" and names_clash(names)) else []


def _decorated(statement: str) -> bool:
    """Whether a statement so far holds decorators alone."""
    if not statement.startswith("@"):
        return False
    _, _, places = lex("python", statement, 0)
    return all(statement.startswith("@", p) for p, d in places if d == 0)


def _language(path_col: str):
    ext = F.lower(F.substring_index(F.col(path_col), ".", -1))
    return F.coalesce(*[F.when(ext == e, name) for e, name in LANGUAGES.items()])


def unparsable(files: DataFrame, *, id_col: str, path_col: str, text_col: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Files whose text does not parse in the language of their extension: ``id, language``.

    Python 3.13, JSON (without NaN and Infinity) and TOML 1.0; grammar only. Files with a null text, a null path
    or another extension are never flagged; an empty Python or TOML file is fine, an empty JSON file is not. Rows
    sent twice count once; of an id with several texts each is judged, and the id is flagged if one fails. Whole
    texts are read, an empty table gives an empty result. A chunk border inside of a replacement field of an
    f-string leaves no state to begin in; such a file is judged in one piece.
    """
    known = files.select(F.col(id_col).cast("string").alias("id"), _language(path_col).alias("language"), F.col(text_col).alias("text")).where("id is not null and language is not null and text is not null")
    rows = known.select("id", "language", F.md5("text").alias("digest"), "text")
    step = lambda make, schema: lambda batches: _rows(batches, schema, make)
    first = written(rows.mapInArrow(step(partial(_summarised, chunk_chars), _FIRST), _FILE_SQL + ", n int, chunk string, ends array<int>, left array<string>"))
    file = ["id", "language", "digest"]
    # files of more than one chunk; a file that was sent many times is reduced before anything is gathered
    chunks = first.where("n >= 0")
    maps = chunks.groupBy(*file, "n").agg(F.first(F.struct("ends", "left")).alias("m")).groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("n", "m.ends", "m.left"))).alias("maps"))
    starts = written(maps.mapInArrow(step(_started, _STARTS), _FILE_SQL + ", n int, last boolean, state int, depth int"))
    texts = chunks.dropDuplicates([*file, "n"]).select(*file, "n", "chunk")
    placed = starts.where("n >= 0").join(texts, [*file, "n"]).select(*file, "n", "last", "state", "depth", "chunk")
    parts = placed.mapInArrow(step(_parsed, _PARTS), _FILE_SQL + ", n int, place int, kind string, part string")
    flagged = "id string, language string"
    over = parts.groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("n", "place", "kind", "part"))).alias("parts")).mapInArrow(step(_joined, _FLAGGED), flagged)
    whole = texts.join(starts.where("n = -2").select(*file), file, "left_semi").groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("n", "chunk"))).alias("all"))
    whole = whole.select(*file, F.array_join(F.transform("all", lambda x: x["chunk"]), "").alias("text"))
    whole = whole.mapInArrow(step(lambda key, language, digest, text: [(key, language)] if invalid(language, text) else [], _FLAGGED), flagged)
    decided = first.where("n = -1").select("id", "language").unionByName(starts.where("n = -1").select("id", "language"))
    return decided.unionByName(over).unionByName(whole).distinct()


def unparsable_rates(files: DataFrame, flagged: DataFrame, *, id_col: str, path_col: str, text_col: str, repo_col: str) -> DataFrame:
    """``repository, language, n_files, n_unparsable, rate`` over the files that have a text and a known language."""
    every = files.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(repo_col).alias("repository"), _language(path_col).alias("language")).where("language is not null").dropDuplicates(["id"])
    bad = flagged.select("id", F.lit(1).alias("bad")).distinct()
    return every.join(bad, "id", "left").groupBy("repository", "language").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_unparsable"), F.round(F.count("bad") / F.count("*"), 6).alias("rate"))
