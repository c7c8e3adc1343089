"""One pass over a source file: expressions by precedence, what their values carry, and facts of what is done with them.

A value carries labels: data from outside, something secret, what a model said, content that others wrote, or a
parameter of a function around it. Labels follow sub-expressions: what a call of a cleaner gets stays there, and so does
what a length or a comparison says of a secret. Names are looked up in the order of the text, in the function first
and then in those around it; an assignment of something that carries nothing ends what the name carried.

Facts of a file become rows; what follows from several of them (functions that hand a parameter on, imports, tools
that a model may call) is put together by joins in dataflow.py. Nothing here raises: what isn't understood is passed
over, and groups nested over DEPTH deep are skipped whole. Strings, comments, templates, patterns and markup are read
as such. The work grows in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

from ..functions.text import is_sensitive

#: Groups nested deeper than this aren't read.
DEPTH = 120
#: Characters of a line that a fact shows.
SHOWN = 300
#: Texts whose facts a worker keeps, and characters of the longest of them.
COPIES, SHORT = 2048, 1000

# Where data from outside comes in. Members of objects, names, and calls.
SOURCE_MEMBERS = {
    ("req", "body"), ("req", "query"), ("req", "params"), ("req", "cookies"), ("req", "headers"), ("req", "url"), ("request", "body"), ("request", "query"), ("request", "params"), ("request", "cookies"), ("request", "headers"), ("request", "url"), ("request", "nextUrl"),
    ("ctx", "query"), ("ctx", "params"), ("router", "query"), ("router", "asPath"), ("window", "location"), ("document", "location"), ("document", "URL"), ("document", "referrer"), ("document", "cookie"), ("location", "search"), ("location", "hash"), ("location", "href"),
    ("event", "data"), ("e", "data"), ("process", "argv"),
}
SOURCE_NAMES, SOURCE_CALLS = ("searchParams",), ("useSearchParams", "prompt")
GET_FROM = ("searchParams", "useSearchParams")
# Content that others wrote, as calls, members and names.
UNTRUSTED_CALLS = {"fetch", "readFile", "readFileSync", "similaritySearch", "getRelevantDocuments", "maxMarginalRelevanceSearch", "retrieve", "scrape", "crawl", "load", "loadDocuments", "json", "text"}
REQUEST_ROOTS, REQUEST_PROPS, REQUEST_NAMES = {"req", "request"}, {"body", "query", "params", "nextUrl", "json", "formData"}, {"searchParams", "params", "body", "formData"}
# Calls of models, and the parts of a longer name that make create() one.
MODEL_CALLS = {"generateText", "streamText", "generateObject", "streamObject", "createCompletion", "createChatCompletion"}
MODEL_PARTS = {"completions", "messages", "chat", "responses"}
PROMPT_KEYS, TOOL_KEYS = ("prompt", "system", "input", "messages"), ("tools", "toolset", "experimental_activeTools")
RUN_KEYS, TOOL_WORDS = ("execute", "func", "handler"), ("parameters", "inputSchema", "description", "schema", "name")
# Environment variables that are secrets, aren't, or are public by their start; what says nothing of a secret.
ENV_SECRET = re.compile(
    "KEY|SECRET|TOKEN|PASSWORD|PASSWD|PWD|CREDENTIAL|PRIVATE|MNEMONIC|SEED|WEBHOOK|SIGNING|ENCRYPT|SALT|DSN|DATABASE_URL|DB_URL|REDIS_URL|MONGO|POSTGRES|MYSQL|CONNECTION_STRING|ACCESS_KEY|CLIENT_SECRET|AUTH_TOKEN|SERVICE_ACCOUNT|SESSION_SECRET|COOKIE_SECRET|JWT", re.I
)
ENV_HARMLESS = {"NODE_ENV", "PORT", "HOST", "HOSTNAME", "TZ", "LANG", "PWD", "HOME", "PATH", "CI", "VERCEL", "VERCEL_ENV", "VERCEL_REGION", "VERCEL_URL", "NEXT_RUNTIME", "TERM", "SHELL", "USER", "LOGNAME", "TMPDIR", "DEBUG"}
ENV_PUBLIC = ("NEXT_PUBLIC_", "REACT_APP_", "VITE_", "PUBLIC_", "EXPO_PUBLIC_", "GATSBY_", "STORYBOOK_", "NPM_", "NPM_CONFIG_")
QUIET_PROPS, QUIET_CALLS = {"length", "size", "byteLength"}, {"slice", "substring", "substr", "Boolean"}
COMPARED = {"===", "!==", "==", "!=", "<", ">", "<=", ">=", "instanceof", "in"}

#: Ours: calls whose result no longer carries what they got from outside.
CLEANER = re.compile(r"(sanitize|escape|validate)([A-Z_]\w*)?|encodeURIComponent|encodeURI|parseInt|parseFloat|Number|Boolean|BigInt")
CLEANER_ROOTS = {"DOMPurify", "z"}

_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))+")
_NUMBER = re.compile(r"\d[\w.]*|\.\d[\w.]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.|\\\n)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.|\\\n)*(?:'|(?=\n)|\Z)", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_SIGN = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[^\w\s]")
_GENERIC = re.compile(r"<[\w\s,.\[\]|&$\"'{}:;?<>]{0,200}?>(?=\s*\()")
_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*(?:'([^'\n]+)'|\"([^\"\n]+)\")")
_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?(?=[\s/>{])")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$:-]*")
_SET = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_BINDS = {
    "??": 4, "||": 4, "&&": 5, "|": 6, "^": 7, "&": 8, "==": 9, "!=": 9, "===": 9, "!==": 9, "<": 10, ">": 10, "<=": 10, ">=": 10, "instanceof": 10, "in": 10, "<<": 11, ">>": 11, ">>>": 11, "+": 12, "-": 12, "*": 13, "/": 13, "%": 13, "**": 14,
}
_UNARY = {"!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await", "yield"}
_SKIPPED = {"return", "throw", "else", "do", "try", "finally", "break", "continue", "case", "default", "export", "abstract", "declare", "debugger"}
_MODIFIERS = {"public", "private", "protected", "readonly", "static", "async", "get", "set", "override", "abstract", "declare", "accessor"}
_BEFORE_GROUP = {"if", "while", "for", "switch", "catch", "with"}

NOTHING: dict[str, tuple] = {}


class Value:
    """What an expression is and carries. carried: a label, to (what it was, line, class); path: the names of a member chain; fields: an object's."""

    __slots__ = ("carried", "shape", "path", "fields", "start", "end", "function", "quiet")

    def __init__(self, carried=NOTHING, shape="other", path=None, start=0, end=0, fields=None, function=None, quiet=False):
        self.carried, self.shape, self.path, self.start, self.end, self.fields, self.function, self.quiet = carried, shape, path, start, end, fields, function, quiet


def merged(a: dict, b: dict) -> dict:
    """Labels of both; of one label, what came first in the text counts."""
    return b if not a else a if not b else {**b, **a}


def without(carried: dict, kind: str) -> dict:
    """Without labels of a kind, of parameters too."""
    return {k: v for k, v in carried.items() if k.split(":", 1)[0] != kind} if carried else carried


def plain_literal(expression: str) -> bool:
    """A quoted text, number or template without a hole."""
    e = expression.strip()
    return bool(re.fullmatch(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[0-9][0-9_.]*|true|false|null|undefined", e) or re.fullmatch(r"`[^`]*`", e) and "${" not in e)


class Reader:
    """Reads one text; facts: (kind, line, column, name, parts, ord, value, shape, scope, code, carried) in the order of the text."""

    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0
        self.seen: tuple[int, str] = (-1, "")
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.scopes: list[dict[str, dict]] = [{}]
        self.names: list[str] = [""]
        self.facts: list[tuple] = []
        self.closing: dict[int, int] = {}

    # --- places and tokens

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def code(self, at: int) -> str:
        k = bisect_right(self.breaks, at - 1)
        start = self.breaks[k - 1] + 1 if k else 0
        end = self.breaks[k] if k < len(self.breaks) else len(self.text)
        return self.text[start : min(end, start + 4 * SHOWN)].strip()[:SHOWN]

    def fact(self, kind, at, name, parts=(), k=0, value: Value | None = None, extra=(), carried=None):
        k_line = self.line(at)
        start = self.breaks[k_line - 2] + 1 if k_line > 1 else 0
        shown = self.text[value.start : value.end].strip() if value is not None and value.shape not in ("function", "markup") else ""
        carried = value.carried if carried is None and value is not None else carried or NOTHING
        if value is not None and value.quiet:
            carried = without(carried, "sensitive")
        self.facts.append((kind, k_line, at - start + 1, name, [*parts], k, shown, value.shape if value is not None else "other", self.names[-1], self.code(at), [*extra], carried))

    def blank(self) -> bool:
        """Goes past blanks and comments; whether there was a line's end."""
        if "!" <= self.text[self.at : self.at + 1] <= "~" and self.text[self.at] != "/":
            return False
        m = _BLANK.match(self.text, self.at)
        if m:
            self.at = m.end()
            return "\n" in m[0]
        return False

    def peek(self) -> str:
        """The next sign, word, or kind of literal: a quote, a digit; empty at the end. What was seen last is kept: most places are looked at several times."""
        if self.seen[0] != self.at:
            self.blank()
            self.seen = (self.at, self._next())
        return self.seen[1]

    def _next(self) -> str:
        if self.at >= len(self.text):
            return ""
        m = _NAME.match(self.text, self.at)
        if m:
            return m[0]
        c = self.text[self.at]
        if c in "\"'`" or c.isdigit():
            return c
        m = _SIGN.match(self.text, self.at)
        return m[0] if m else c

    def take(self, token: str) -> bool:
        if token and self.peek() == token:
            self.at += len(token)
            return True
        return False

    def close_of(self, at: int) -> int:
        """Where the bracket at `at` closes, quotes and comments apart; -1 if it doesn't. Each bracket is looked for once."""
        if at not in self.closing:
            stack, i, n = [], at, len(self.text)
            text = self.text
            while i < n:
                c = text[i]
                if c in "\"'":
                    m = _STRING.match(text, i)
                    i = max(m.end(), i + 1) if m else i + 1
                    continue
                if c == "`":
                    i = text.find("`", i + 1) + 1 or n
                    continue
                if c == "/" and text[i + 1 : i + 2] in ("/", "*"):
                    m = _BLANK.match(text, i)
                    i = m.end() if m else i + 1
                    continue
                if c in "([{":
                    stack.append(i)
                elif c in ")]}":
                    if not stack:
                        break
                    self.closing[stack.pop()] = i
                    if not stack:
                        break
                i += 1
            for left in stack:
                self.closing[left] = -1
            self.closing.setdefault(at, -1)
        return self.closing[at]

    def skip_group(self) -> None:
        end = self.close_of(self.at)
        self.at = end + 1 if end >= 0 else len(self.text)

    # --- names

    def look(self, name: str) -> dict:
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        return NOTHING

    def bind(self, name: str, carried: dict, own: bool) -> None:
        scope = self.scopes[-1]
        if not own:
            scope = next((s for s in reversed(self.scopes) if name in s), scope)
        scope[name] = carried

    def assigned(self, name: str, value: Value, at: int, own: bool) -> None:
        """A name takes what the value carries; a sensitive name of something not literal makes it a secret."""
        carried = without(value.carried, "sensitive") if value.quiet else value.carried
        if is_sensitive(name) and value.shape not in ("literal", "template", "function") and "sensitive" not in carried:
            carried = {**carried, "sensitive": (name, self.line(at), "secret.credential")}
        self.fact("assign", at, name, (name,), value=value, extra=(value.function or "",), carried=carried)
        self.bind(name, carried, own)

    # --- statements

    def statements(self, end: str = "") -> None:
        self.depth += 1
        while True:
            t = self.peek()
            start = self.at
            if not t or t == end:
                break
            self.statement(t)
            if self.at <= start:
                self.at = start + max(1, len(t))
        self.depth -= 1

    def statement(self, t: str) -> None:
        if t in (";", ",", ":", ")", "]", "}"):
            self.at += 1
        elif t == "{":
            self.block()
        elif t == "@":
            self.at += 1
        elif t == "import" and self.text[self.at + 6 : self.at + 7] not in ("(", "."):
            self.imported()
        elif t in ("const", "let", "var", "using"):
            self.at += len(t)
            self.declared()
        elif t == "class":
            self.classed()
        elif t in ("interface", "namespace", "enum") and _NAME.match(self.text, self._after(t)):
            at = self.text.find("{", self.at)
            self.at = at if at >= 0 else len(self.text)
            if t == "namespace":
                self.block()
            elif at >= 0:
                self.skip_group()
        elif t == "type" and re.compile(r"type\s+[A-Za-z_$][\w$]*\s*(?:<[^=\n]*>)?\s*=").match(self.text, self.at):
            self.at = self.text.index("=", self.at) + 1
            self.type()
        elif t in _BEFORE_GROUP:
            self.at += len(t)
            self.take("await")
            if self.peek() == "(":
                self.at += 1
                self.statements(")")
                self.take(")")
        elif t in _SKIPPED:
            self.at += len(t)
        else:
            self.expression(1)

    def _after(self, word: str) -> int:
        m = _BLANK.match(self.text, self.at + len(word))
        return m.end() if m else self.at + len(word)

    def block(self) -> None:
        if self.depth > DEPTH:
            self.skip_group()
            return
        self.at += 1
        self.statements("}")
        self.take("}")

    def imported(self) -> None:
        m = _IMPORT.match(self.text, self.at)
        if m and not m[0].startswith("import type"):
            for part in m[1].split(","):
                names = re.split(r"\s+as\s+", part.strip())
                if names[0] and not names[0].startswith("type "):
                    self.fact("import", self.at, names[-1].strip(), (names[0].strip(),), extra=(m[2] or m[3],))
        if m:
            self.at = m.end()
            return
        end = re.compile(r"['\"][^'\"\n]*['\"]|[;\n]").search(self.text, self.at + 6)
        self.at = end.end() if end else len(self.text)

    def declared(self) -> None:
        while True:
            t = self.peek()
            at = self.at
            if t in ("{", "["):
                end = self.close_of(at)
                if end < 0:
                    return
                names, self.at = self.pattern(at, end), end + 1
            elif _NAME.match(t or " "):
                names = [t]
                self.at += len(t)
            else:
                return
            self.take("!")
            if self.take(":"):
                self.type()
            if self.peek() in ("of", "in"):
                self.at += 2
                value = self.expression(2)
                for n in names:
                    self.bind(n, value.carried, True)
            elif self.take("="):
                value = self.expression(2, names[0] if t not in ("{", "[") else "")
                for n in names:
                    self.assigned(n, value, at, True)
            else:
                for n in names:
                    self.bind(n, NOTHING, True)
            if not self.take(","):
                return

    def pattern(self, start: int, end: int) -> list[str]:
        """Names that a pattern between brackets binds."""
        inside = re.sub(r"=(?!>)[^,{}\[\]]*", "", self.text[start + 1 : end])
        inside = re.sub(r"[\w$]+\s*:(?=\s*[\w$\[{])", "", inside)
        return re.findall(r"[A-Za-z_$][\w$]*", inside)

    def type(self) -> None:
        """Goes past a type."""
        while True:
            line = self.blank()
            t = self.peek()
            if t in ("{", "(", "["):
                if line and t in ("(", "["):
                    return
                self.skip_group()
            elif t == "<":
                m = re.compile(r"<[^;(){}=]{0,400}?>+(?=\s*[\[\]=,;){|&\n>]|\s*$)").match(self.text, self.at)
                self.at = m.end() if m else self.at + 1
            elif t and t[0] in "\"'`0123456789":
                self.operand("")
            elif _NAME.match(t or " "):
                self.at += len(t)
                if t in ("keyof", "typeof", "readonly", "infer", "unique", "is", "extends", "new", "asserts"):
                    continue
            elif t in ("|", "&", "?", "."):
                self.at += 1
                continue
            else:
                return
            nxt = self.blank()
            t = self.peek()
            if t == "=>":
                self.at += 2
                continue
            if t in ("|", "&", ".", "is", "extends") or t in ("[", "<") and not nxt:
                continue
            return

    def classed(self) -> None:
        self.at += len("class")
        m = re.compile(r"[^{;]*").match(self.text, self.at)
        self.at = m.end()
        if self.peek() != "{":
            return
        if self.depth > DEPTH:
            self.skip_group()
            return
        self.at += 1
        self.depth += 1
        while True:
            t = self.peek()
            start = self.at
            if not t or t == "}":
                break
            if t == "{":
                self.block()
            elif t == "@":
                self.at += 1
                self.expression(15)
            elif t in _MODIFIERS and self._follows(t):
                self.at += len(t)
            elif _NAME.match(t) or t in ("#", "[", "*") or t[0] in "\"'`":
                self.member(t)
            if self.at <= start:
                self.at = start + max(1, len(t))
        self.depth -= 1
        self.take("}")

    def _follows(self, word: str) -> bool:
        """Whether a modifier is one here, a name follows it."""
        rest = self.text[self._after(word) : self._after(word) + 1]
        return bool(rest) and rest not in "(=;:,?}!<"

    def member(self, t: str) -> None:
        """A method or field of a class."""
        if t in ("#", "*"):
            self.at += 1
            t = self.peek()
        at, name = self.at, t
        if t == "[":
            self.skip_group()
            name = ""
        elif t and t[0] in "\"'`":
            self.operand("")
        else:
            self.at += len(t)
        if self.peek() == "<":
            m = _GENERIC.match(self.text, self.at)
            self.at = m.end() if m else self.at
        if self.peek() == "(":
            self.function(name or f"@{at}", at)
            return
        self.take("?") or self.take("!")
        if self.take(":"):
            self.type()
        if self.take("="):
            self.assigned(name, self.expression(2, name), at, True)

    # --- functions

    def parameters(self, start: int, end: int) -> list[list[str]]:
        """Names of each parameter of a list between parentheses."""
        out, begin, i = [], start + 1, start + 1
        text = self.text
        while i <= end:
            c = text[i]
            if i == end or c == ",":
                part = text[begin:i].strip()
                if part:
                    out.append(self.parameter(begin, i))
                begin = i + 1
            elif c in "([{":
                close = self.close_of(i)
                i = close if i < close < end else i
            elif c in "\"'`":
                m = _STRING.match(text, i)
                i = m.end() - 1 if m and m.end() <= end else i
            elif c == "<":
                m = re.compile(r"<[^()=]*>").match(text, i, end)
                i = m.end() - 1 if m else i
            i += 1
        return out

    def parameter(self, begin: int, end: int) -> list[str]:
        m = re.compile(r"\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?\s*").match(self.text, begin, end)
        at = m.end()
        if self.text[at : at + 1] in ("{", "["):
            close = self.close_of(at)
            return self.pattern(at, close) if at < close < end else []
        m = _NAME.match(self.text, at, end)
        return [m[0]] if m else []

    def function(self, name: str, at: int, arrow: bool = False, single: str | None = None) -> Value:
        """A function from its parameter list on; name: what it is called by, or its place."""
        start = at
        if single is not None:
            params = [[single]]
        else:
            open_at, close = self.at, self.close_of(self.at)
            if close < 0:
                self.at += 1
                return Value(start=start, end=self.at)
            params = self.parameters(open_at, close)
            self.at = close + 1
        if self.take(":"):
            self.type()
        if arrow:
            self.take("=>")
        scope = {}
        for k, names in enumerate(params):
            for n in names:
                scope[n] = {f"{kind}:{name}:{k}": (n, self.line(at), "param") for kind in ("inject", "sensitive", "agency")}
        self.facts.append(("function", self.line(at), 1, name, [", ".join(n) for n in params], len(params), "", "function", self.names[-1], self.code(at), [], NOTHING))
        self.scopes.append(scope)
        self.names.append(name)
        if self.peek() == "{":
            self.block()
        elif arrow:
            self.depth += 1
            if self.depth <= DEPTH:
                self.expression(2)
            self.depth -= 1
        self.scopes.pop()
        self.names.pop()
        return Value(shape="function", start=start, end=self.at, function=name)

    def arrow_ahead(self) -> bool:
        """Whether the parenthesis here opens the parameters of an arrow function."""
        end = self.close_of(self.at)
        if end < 0:
            return False
        m = _BLANK.match(self.text, end + 1)
        at = m.end() if m else end + 1
        if self.text.startswith("=>", at):
            return True
        return self.text[at : at + 1] == ":" and bool(re.compile(r":\s*[\w$.\[\]<>|&\s,'\"]{1,200}?=>").match(self.text, at))

    # --- expressions

    def expression(self, least: int, called: str = "") -> Value:
        """An expression whose operators bind at least so tightly (1: commas, 2: assignments, 3: choices); called: the name that it is given."""
        if self.depth >= DEPTH:
            return self.passed_over()
        self.depth += 1
        left = self.operand(called)
        while True:
            line = self.blank()
            t = self.peek()
            at = self.at
            if t in (".", "?."):
                self.at += len(t)
                nxt = self.peek()
                if t == "?." and nxt in ("(", "["):
                    continue
                if nxt == "#":
                    self.at += 1
                    nxt = self.peek()
                m = _NAME.match(nxt or " ")
                if not m:
                    break
                self.at += len(nxt)
                left = self.chained(left, nxt)
            elif t == "[" and not (line and left.shape == "function"):
                self.at += 1
                index = self.expression(1)
                self.take("]")
                left = Value(merged(left.carried, index.carried), "member", left.path, left.start, self.at, quiet=left.quiet)
            elif t == "(" and not (left.shape == "function" and line):
                left = self.call(left)
            elif t == "<" and left.path and (m := _GENERIC.match(self.text, self.at)):
                self.at = m.end()
            elif t == "`" and not line:
                hole = self.operand("")
                left = Value(NOTHING, "call", None, left.start, hole.end)
            elif t == "!" and not line and self.text[at + 1 : at + 2] != "=":
                self.at += 1
            elif t in ("++", "--") and not line:
                self.at += 2
            elif t in ("as", "satisfies") and not line:
                self.at += len(t)
                self.type()
            elif t in _SET and least <= 2:
                self.at += len(t)
                left = self.set(left, t, at)
            elif t == "?" and least <= 3:
                self.at += 1
                one = self.expression(2)
                self.take(":")
                two = self.expression(2)
                left = Value(merged(left.carried, merged(one.carried, two.carried)), "choice", None, left.start, two.end)
            elif t in _BINDS and least <= _BINDS[t] and not (line and t == "<" and _TAG.match(self.text, at)):
                self.at += len(t)
                right = self.expression(_BINDS[t] + (t != "**"))
                lone = (left.carried if not left.quiet else without(left.carried, "sensitive"), right.carried if not right.quiet else without(right.carried, "sensitive"))
                left = Value(merged(*lone), "binary", None, left.start, right.end, quiet=t in COMPARED)
            elif t == "," and least <= 1:
                self.at += 1
                if self.peek() in ("", ")", "]", "}"):
                    break
                right = self.expression(2)
                left = Value(merged(left.carried, right.carried), right.shape, right.path, left.start, right.end, right.fields, right.function)
            else:
                break
        self.depth -= 1
        return left

    def passed_over(self) -> Value:
        """Something nested too deep, without what it carries."""
        start = self.at
        t = self.peek()
        if t in ("(", "[", "{"):
            self.skip_group()
        elif t and t[0] in "\"'`0123456789":
            self.at += 1
            m = _STRING.match(self.text, self.at - 1)
            self.at = max(self.at, m.end() if m else 0)
        elif t not in (")", "]", "}", ";", ",", ""):
            self.at += len(t)
        while self.peek() in ("(", "["):
            self.skip_group()
        return Value(start=start, end=self.at)

    def operand(self, called: str) -> Value:
        t = self.peek()
        at = self.at
        if not t or t in (")", "]", "}", ";", ",", ":"):
            return Value(start=at, end=at)
        if t in ('"', "'"):
            m = _STRING.match(self.text, at)
            self.at = m.end() if m else at + 1
            return Value(NOTHING, "literal", None, at, self.at)
        if t == "`":
            return self.template()
        if t[0].isdigit() or t == "." and _NUMBER.match(self.text, at):
            self.at = _NUMBER.match(self.text, at).end()
            return Value(NOTHING, "literal", None, at, self.at)
        if t in ("/", "/=") and (m := _PATTERN.match(self.text, at)):
            self.at = m.end()
            return Value(NOTHING, "literal", None, at, self.at)
        if t == "(":
            if self.arrow_ahead():
                return self.function(called or f"@{at}", at, arrow=True)
            self.at += 1
            inside = self.expression(1)
            if self.peek() != ")":
                self.statements(")")
            self.take(")")
            return Value(inside.carried, inside.shape if inside.shape in ("literal", "template", "function") else "group", inside.path, at, self.at, inside.fields, inside.function, inside.quiet)
        if t == "[":
            return self.listed()
        if t == "{":
            return self.object()
        if t == "<":
            return self.markup()
        if t in _UNARY:
            self.at += len(t)
            if t == "yield":
                self.take("*")
            inside = self.expression(14, called)
            return Value(inside.carried, "literal" if inside.shape == "literal" else "group" if t in ("await", "yield") else "unary", inside.path if t == "await" else None, at, self.at, inside.fields, inside.function, inside.quiet or t in ("!", "typeof", "void", "delete"))
        if t == "...":
            self.at += 3
            inside = self.expression(2)
            return Value(inside.carried, "spread", None, at, self.at, quiet=inside.quiet)
        if t == "new":
            self.at += 3
            if self.take("."):
                self.take("target")
                return Value(start=at, end=self.at)
            made = self.operand("")
            while self.take("."):
                name = self.peek()
                self.at += len(name)
                made = self.chained(made, name)
            if (self.peek() == "<") and (m := _GENERIC.match(self.text, self.at)):
                self.at = m.end()
            if self.peek() == "(":
                made = self.call(made, at)
            return Value(made.carried, "new", None, at, self.at)
        if t == "class":
            self.classed()
            return Value(start=at, end=self.at)
        if t == "async" and re.compile(r"async\s*(?:\(|function\b|[A-Za-z_$][\w$]*\s*=>)").match(self.text, at):
            self.at += 5
            if self.peek() == "(" and not self.arrow_ahead():
                return Value(NOTHING, "name", ["async"], at, self.at)
            return self.operand(called)
        if t == "function":
            self.at += 8
            self.take("*")
            name = self.peek()
            if _NAME.match(name or " "):
                self.at += len(name)
            else:
                name = ""
            if self.peek() == "<" and (m := _GENERIC.match(self.text, self.at)):
                self.at = m.end()
            return self.function(name or called or f"@{at}", at) if self.peek() == "(" else Value(start=at, end=self.at)
        if t in ("true", "false", "null", "undefined"):
            self.at += len(t)
            return Value(NOTHING, "literal", None, at, self.at)
        m = _NAME.match(self.text, at)
        if m:
            self.at = m.end()
            if re.compile(r"\s*=>").match(self.text, self.at):
                return self.function(called or f"@{at}", at, arrow=True, single=t)
            return Value(self.named(t, at), "name", [t], at, self.at)
        self.at += len(t)
        return Value(start=at, end=self.at)

    def named(self, name: str, at: int) -> dict:
        found = self.look(name)
        if name in SOURCE_NAMES:
            found = merged({"inject": (name, self.line(at), "")}, found)
        if name in REQUEST_NAMES and not any(name in s for s in self.scopes):
            found = merged({"untrusted": (name, self.line(at), "")}, found)
        return found

    def chained(self, left: Value, prop: str) -> Value:
        """left.prop"""
        path = [*(left.path or ()), prop][-8:]
        at = left.start
        carried = without(left.carried, "sensitive") if left.quiet else left.carried
        pair = tuple(path[-2:])
        if pair in SOURCE_MEMBERS:
            carried = merged({"inject": (".".join(path), self.line(at), "")}, carried)
        if len(path) > 1 and (path[-2] in REQUEST_ROOTS and prop in REQUEST_PROPS) or path[0] in REQUEST_NAMES:
            carried = merged({"untrusted": (".".join(path), self.line(at), "")}, carried)
        if path == ["process", "env", prop]:
            if prop.upper() not in ENV_HARMLESS and not prop.upper().startswith(ENV_PUBLIC) and ENV_SECRET.search(prop):
                carried = {**carried, "sensitive": (f"process.env.{prop}", self.line(at), "secret.env")}
        elif is_sensitive(prop):
            carried = {**carried, "sensitive": (".".join(path[-2:]), self.line(at), "secret.credential")}
        return Value(carried, "member", path, at, self.at, quiet=prop in QUIET_PROPS)

    def call(self, callee: Value, at: int | None = None) -> Value:
        """callee(...): a fact for each argument, and what the result carries."""
        start = callee.start if at is None else at
        path = callee.path or []
        name = path[-1] if path else ""
        self.at += 1
        args: list[Value] = []
        while True:
            t = self.peek()
            before = self.at
            if not t or t == ")":
                break
            if t == ",":
                self.at += 1
                continue
            args.append(self.expression(2))
            if self.at <= before:
                self.at = before + max(1, len(t))
        self.take(")")
        for k, a in enumerate(args):
            self.fact("arg", start, ".".join(path), path, k, a, extra=[args[0].shape if args else "", self.text[args[0].start : min(args[0].end, args[0].start + SHOWN)].strip(), str(len(args))])
        if not args and path:
            self.fact("call", start, ".".join(path), path)
        passed = NOTHING
        for a in args:
            passed = merged(passed, a.carried)
        passed = without(passed, "sensitive")  # what becomes of a secret inside a call can't be told
        if CLEANER.fullmatch(name) or path and path[0] in CLEANER_ROOTS:
            passed = without(passed, "inject")
        model = name in MODEL_CALLS or name == "create" and bool(MODEL_PARTS & set(path))
        objects = next((a for a in args if a.fields is not None), None)
        if (name in MODEL_CALLS or name == "create") and objects is not None:
            prompt = NOTHING
            for key in PROMPT_KEYS:
                if key in objects.fields:
                    prompt = merged(prompt, objects.fields[key].carried)
            tools: list[str] = []
            for key in TOOL_KEYS:
                if key in objects.fields:
                    own = objects.fields[key]
                    tools += [n for f, v in (own.fields or {}).items() for n in (f, (v.path or [""])[0] if v.shape == "name" else "") if n] or (own.path or [])[:1]
            self.fact("model", start, name, path, extra=sorted(set(tools)), carried=prompt)
        if name == "tool" and len(path) == 1 and args and args[0].shape == "function":
            self.fact("tool", start, args[0].function)
        line = self.line(start)
        carried = merged(without(callee.carried, "sensitive") if name in QUIET_CALLS or callee.quiet else callee.carried, passed)
        if model:
            carried = {"model": (f"{name}(...)", line, "")}
        if len(path) == 1 and name in SOURCE_CALLS or name == "get" and len(path) > 1 and (path[0] in GET_FROM or path[-2] in GET_FROM):
            carried = merged({"inject": (f"{'.'.join(path[-2:])}(...)", line, "")}, carried)
        if name in UNTRUSTED_CALLS:
            carried = merged({"untrusted": (f"{name}(...)", line, "")}, carried)
        inner = next((a for a in args if a.function), None) if name == "tool" else None
        return Value(carried, "call", path, start, self.at, function=inner.function if inner else objects.function if name == "tool" and objects else None, quiet=name in QUIET_CALLS)

    def set(self, left: Value, sign: str, at: int) -> Value:
        """left = ..., and what the name or member gets."""
        name = left.path[0] if left.shape == "name" and left.path else ""
        right = self.expression(2, name if sign == "=" else "")
        value = right if sign in ("=", "||=", "&&=", "??=") else Value(merged(left.carried, right.carried), "binary", None, right.start, right.end)
        if name:
            self.assigned(name, value, left.start, False)
        elif left.path and left.shape == "member":
            self.fact("field", left.start, ".".join(left.path), left.path, value=value)
        return Value(value.carried, value.shape, value.path, left.start, right.end, value.fields, value.function)

    def template(self) -> Value:
        """A template: its holes are expressions."""
        at, carried, holes = self.at, NOTHING, False
        self.at += 1
        mark = re.compile(r"[^`\\$]+|\\.|\$(?!\{)|`|\$\{", re.S)
        while m := mark.match(self.text, self.at):
            self.at = m.end()
            if m[0] == "`":
                break
            if m[0] == "${":
                holes = True
                inside = self.expression(1)
                carried = merged(carried, without(inside.carried, "sensitive") if inside.quiet else inside.carried)
                if self.peek() != "}":
                    self.statements("}")
                self.take("}")
        return Value(carried, "template" if holes else "literal", None, at, self.at)

    def listed(self) -> Value:
        at, carried = self.at, NOTHING
        self.at += 1
        while True:
            t = self.peek()
            before = self.at
            if not t or t == "]":
                break
            if t == ",":
                self.at += 1
                continue
            v = self.expression(2)
            carried = merged(carried, without(v.carried, "sensitive") if v.quiet else v.carried)
            if self.at <= before:
                self.at = before + max(1, len(t))
        self.take("]")
        return Value(carried, "list", None, at, self.at)

    def object(self) -> Value:
        """An object: its fields, methods among them."""
        at, carried, fields = self.at, NOTHING, {}
        self.at += 1
        while True:
            t = self.peek()
            before = self.at
            if not t or t == "}":
                break
            if t == ",":
                self.at += 1
                continue
            if t == "...":
                v = self.operand("")
            else:
                while t in ("async", "get", "set", "*") and self._follows(t):
                    self.at += len(t)
                    t = self.peek()
                key, key_at = t, self.at
                if t == "[":
                    self.skip_group()
                    key = f"@{key_at}"
                elif t in ('"', "'"):
                    s = self.operand("")
                    key = self.text[s.start + 1 : s.end - 1]
                elif t[0].isdigit():
                    self.operand("")
                else:
                    self.at += len(t)
                if self.peek() == "<" and (m := _GENERIC.match(self.text, self.at)):
                    self.at = m.end()
                if self.peek() == "(":
                    v = self.function(key, key_at)
                elif self.take(":"):
                    v = self.expression(2, f"{key}@{key_at}" if key in RUN_KEYS else key)
                else:
                    v = Value(self.named(key, key_at), "name", [key], key_at, self.at)
                    if self.take("="):
                        self.expression(2)
                fields[key] = v
            carried = merged(carried, without(v.carried, "sensitive") if v.quiet else v.carried)
            if self.at <= before:
                self.at = before + max(1, len(t))
        self.take("}")
        run = next((fields[k] for k in RUN_KEYS if k in fields and fields[k].function), None)
        if run is not None and any(w in fields for w in TOOL_WORDS):
            self.fact("tool", run.start, run.function)
        return Value(carried, "object", None, at, self.at, fields, run.function if run else None)

    def markup(self) -> Value:
        """An element with its attributes and children, or what else starts with <."""
        at = self.at
        generic = re.compile(r"<\s*[A-Z][\w$]*\s*(?:,|\bextends\b)[^>()]*>(?=\s*\()").match(self.text, at)
        if generic:
            self.at = generic.end()
            return self.operand("")
        m = re.compile(r"<\s*>").match(self.text, at) or _TAG.match(self.text, at)
        if not m:
            self.at += 1
            return Value(start=at, end=self.at)
        fragment = m[0].endswith(">")
        name = "" if fragment else m[1] or ""
        self.at = m.end()
        while not fragment:
            t = self.peek()
            before = self.at
            if t == ">" or t == "/" or not t:
                break
            if t == "{":
                self.at += 1
                if self.peek() != "}":
                    self.expression(1)
                self.take("}")
            elif a := _ATTRIBUTE.match(self.text, self.at):
                self.at = a.end()
                if self.take("="):
                    self.attribute(a[0], before)
            if self.at <= before:
                self.at = before + 1
        if not fragment and self.take("/"):
            self.take(">")
            return Value(NOTHING, "markup", None, at, self.at)
        if not fragment:
            self.take(">")
        closing = f"</{name}"
        if self.text.find(closing, self.at) < 0:  # a cast, not an element
            return self.expression(14) if self.peek() not in ("", ")", "]", "}", ";") else Value(start=at, end=self.at)
        self.depth += 1
        while self.at < len(self.text):
            nxt = re.compile(r"[{<]").search(self.text, self.at)
            if not nxt:
                self.at = len(self.text)
                break
            self.at = nxt.start()
            if nxt[0] == "{":
                if self.depth > DEPTH:
                    self.skip_group()
                    continue
                self.at += 1
                if self.peek() != "}":
                    self.expression(1)
                if self.peek() != "}":
                    self.statements("}")
                self.take("}")
            elif re.compile(r"<\s*/").match(self.text, self.at):
                end = self.text.find(">", self.at)
                self.at = end + 1 if end >= 0 else len(self.text)
                break
            elif self.depth > DEPTH:
                self.at += 1
            else:
                before = self.at
                self.markup()
                self.at = max(self.at, before + 1)
        self.depth -= 1
        return Value(NOTHING, "markup", None, at, self.at)

    def attribute(self, name: str, at: int) -> None:
        t = self.peek()
        if t == "{":
            self.at += 1
            value = self.expression(1)
            self.take("}")
        else:
            value = self.operand("")
        self.fact("attr", at, name, (name,), value=(value.fields or {}).get("__html", value) if name == "dangerouslySetInnerHTML" else value, extra=("__html" if value.fields and "__html" in value.fields else "",))


def _read(text: str) -> list[tuple]:
    reader = Reader(text)
    reader.statements()
    return reader.facts


_kept = lru_cache(COPIES)(_read)


def facts_of(text: str) -> list[tuple]:
    """The facts of a text, in order. A worker keeps those of the last COPIES short texts, for files that are copies; not to be changed by the caller."""
    return _kept(text) if len(text) <= SHORT else _read(text)
