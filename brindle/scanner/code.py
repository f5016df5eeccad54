"""Extraction from programming languages, on tokens: one walk with a table of each language's ways.

A string is bound by the nearest of: its key (`key: "v"`, `"key" => "v"`), the call it is an
argument of (setters of names and headers, calls of functions defined in the file), and the
assignment whose right side it stands in, through brackets, operators, casts and calls. A
string without any is a bare value. Joined literals (`"a" + "b"`) are one value.

Without a real parser, a string in an unusual construct may be bound to a farther name than a
parser would choose, or be a bare value; texts that don't parse are walked all the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from brindle.scanner.items import Item

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}
_PLAIN = r'"(?:[^"\\\n]|\\.)*"'
_SINGLE = r"'(?:[^'\\\n]|\\.)*'"
_TRIPLE = r'"""(?:[^\\]|\\.)*?"""' + r"|'''(?:[^\\]|\\.)*?'''"


@dataclass(frozen=True)
class Language:
    strings: str  # the pattern of string literals, with their prefixes
    comments: str = r"//[^\n]*|/\*[\s\S]*?\*/"
    words: str = r"[A-Za-z_$@][A-Za-z0-9_$]*"
    chars: str = r"(?!)"  # character literals, which aren't strings
    constants: tuple[str, ...] = ("const", "final", "static")
    variables: tuple[str, ...] = ("let", "var", "val", "def")
    definitions: tuple[str, ...] = ("function", "func", "fn", "fun", "def", "sub")
    pair: str = "Element"  # what `key: value` in braces is
    arrow: bool = False  # whether `key => value` is a pair
    join: tuple[str, ...] = ("+",)
    lines: bool = False  # whether a line's end ends a statement
    typed: bool = False  # whether `Type name(` defines a function
    headers: tuple[str, ...] = ()
    header_receiver: bool = False  # whether the receiver must look like headers
    setters: tuple[str, ...] = ()
    setter_kind: str = "Variable"
    lone_setters: bool = False  # whether `setName("v")` names its value
    pairs_of: tuple[str, ...] = ()  # calls of alternating keys and values
    infix: str | None = None  # a word between key and value
    calls: bool = True  # whether calls are joined to definitions in the file
    logins: bool = False
    literal: str = ""  # of a raw string: quotes are doubled, not escaped
    extra: dict = field(default_factory=dict)  # call -> argument number that is named after the first one
    argument: str = "Argument"


_C = dict(chars=r"'(?:[^'\\\n]|\\.[^'\n]*)'")
LANGUAGES = {
    "JavaScript": Language(rf"{_PLAIN}|{_SINGLE}|`(?:[^`\\]|\\.)*`", pair="Property", constants=("const",), headers=("setHeader", "setRequestHeader"), logins=True),
    "Python": Language(rf"[A-Za-z]{{0,2}}(?:{_TRIPLE}|{_PLAIN}|{_SINGLE})", comments=r"#[^\n]*", constants=(), definitions=("def",), lines=True, headers=("add_header", "putheader"), setters=("putenv", "setdefault")),
    "Go": Language(rf"{_PLAIN}|`[^`]*`", lines=True, definitions=("func",), constants=("const",), headers=("Set", "Add"), header_receiver=True, setters=("Setenv",), **_C),
    "Java": Language(rf"{_TRIPLE}|{_PLAIN}", typed=True, constants=("final",), headers=("addHeader", "addRequestProperty", "setHeader", "setRequestProperty"), setters=("put", "set", "setProperty", "setAttribute", "putIfAbsent"), lone_setters=True, pairs_of=("of",), **_C),
    "Kotlin": Language(rf"{_TRIPLE}|{_PLAIN}", lines=True, constants=("val",), variables=("var",), headers=("addHeader", "header", "setHeader", "setRequestProperty"), infix="to", extra={"buildConfigField": 1}, **_C),
    "CSharp": Language(rf'[$@]{{0,2}}"""[\s\S]*?"""|(?:@|\$@|@\$)"(?:[^"]|"")*"|\$?{_PLAIN}', typed=True, constants=("const", "readonly"), headers=("Add", "Append", "TryAddWithoutValidation"), header_receiver=True, setters=("SetEnvironmentVariable",), setter_kind="EnvironmentVariable", calls=False, **_C),
    "Dart": Language(rf"r?(?:{_TRIPLE}|{_PLAIN}|{_SINGLE})", typed=True, constants=("const", "final")),
    "Swift": Language(rf'#*"""[\s\S]*?"""#*|#+"[^"\n]*"#+|{_PLAIN}', lines=True, constants=("let",), variables=("var",), setters=("setenv",)),
    "Groovy": Language(rf"{_TRIPLE}|{_PLAIN}|{_SINGLE}", lines=True, typed=True, lone_setters=True, calls=False, extra={"buildConfigField": 1}),
    "Php": Language(rf"{_PLAIN}|{_SINGLE}", comments=r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/", arrow=True, join=(".",), headers=("addHeader", "setHeader", "withAddedHeader", "withHeader"), setters=("define", "setcookie", "putenv"), setter_kind="Constant"),
    "Ruby": Language(rf"{_PLAIN}|{_SINGLE}|%[qQ]?\([^)\n]*\)", comments=r"#[^\n]*", words=r":?[A-Za-z_][A-Za-z0-9_]*[?!]?|[$@]+[A-Za-z_][A-Za-z0-9_]*", constants=(), lines=True, arrow=True, headers=("add_field",)),
    "Rust": Language(rf'b?r(#*)"[\s\S]*?"\1|b?{_PLAIN}', chars=r"'(?:[^'\\\n]|\\[^'\n]+)'", constants=("const", "static"), variables=("let",), headers=("add_header", "addheader", "header", "set_header"), setters=("insert", "put", "set", "set_var", "setdefault", "setenv"), lone_setters=True),
    "PowerShell": Language(r'@"\r?\n[\s\S]*?\n"@|' + r"@'\r?\n[\s\S]*?\n'@|" + r'"(?:[^"`]|`.|"")*"|' + r"'(?:[^']|'')*'", comments=r"#[^\n]*|<#[\s\S]*?#>", words=r"\$?[A-Za-z_](?:[A-Za-z0-9_:]|-(?=[A-Za-z]))*|-[A-Za-z]+", lines=True, constants=(), variables=()),
}
LANGUAGES["TypeScript"] = LANGUAGES["JavaScript"]
_KEYWORDS = frozenset("return new throw await yield if while for switch case else elif in is not and or typeof instanceof unless until when match with catch raise assert print echo".split())
_OPENS = {"(": ")", "[": "]", "{": "}"}


@lru_cache(maxsize=32)
def _lexer(name: str) -> re.Pattern:
    own = LANGUAGES[name]
    return re.compile(
        rf"(?P<comment>{own.comments})|(?P<string>{own.strings.replace(r'(#*)', r'(?P<hash>#*)').replace(chr(92) + '1', '(?P=hash)')})|(?P<char>{own.chars})|(?P<word>{own.words})|(?P<number>[0-9][0-9A-Za-z_.]*)"
        r"|(?P<line>\n)|(?P<op>===|!==|==|!=|<=|>=|=>|:=|->|::|\?\?=|\|\|=|&&=|\+=|<-|\?\?|\?\.|\|\||&&|[^\sA-Za-z0-9_])"
    )


def unquoted(literal: str) -> str:
    """The value of a string literal: its prefix and quotes off, common escapes read."""
    body = re.sub(r"^(?:[A-Za-z]{0,2}#*|[$@]{1,2}|%[qQ]?)(?=[\"'`(])", "", literal) if literal[:1] not in "\"'`" else literal
    raw = bool(re.match(r"[A-Za-z]?[rR]|@|\$@|@\$|#", literal)) or literal[:1] == "`" and "\\" not in literal
    body = body.rstrip("#")
    for quote in ('"""', "'''"):
        if body.startswith(quote) and body.endswith(quote) and len(body) >= 6:
            return body[3:-3] if raw else _unescaped(body[3:-3])
    if body[:2] in ('@"', "@'"):
        return body[2:-2].strip("\r\n")
    inner = body[1:-1]
    if literal.startswith(("@", "$@")):
        return inner.replace('""', '"')
    return inner if raw else _unescaped(inner)


def _unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    read = lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else _ESCAPES.get(m[4], m[4])
    return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|([\s\S]))", lambda m: read(m) if not (m[2] and int(m[2], 16) > 0x10FFFF) else m[0], text)


@dataclass
class _Frame:
    open: str = ""
    callee: str = ""
    qualified: bool = False
    receiver: str = ""
    defines: bool = False
    inherited: tuple[str, str] | None = None
    bound: tuple[str, str] | None = None
    key: tuple[str, str] | None = None
    argument: int = 0
    first: str | None = None  # the first argument, if it is a string
    ternary: int = 0
    begin: int = 0  # the token where the current statement or item begins
    params: list[str] = field(default_factory=list)

    def binding(self):
        return self.key or self.bound or self.inherited


class _Walk:
    def __init__(self, name: str, text: str, known: dict[str, list[str]] | None = None):
        self.name, self.own, self.text = name, LANGUAGES[name], text
        self.tokens: list[tuple[str, str, int, int]] = []
        for m in _lexer(name).finditer(text):
            if m.lastgroup not in ("comment", "char", "hash") or m["string"] is not None:
                kind = "string" if m["string"] is not None else m.lastgroup
                self.tokens.append((kind, m.group(), m.start(), m.end()))
        self.items: list[Item] = []
        self.calls: list[tuple[str, int, Item]] = []
        self.defined: dict[str, list[str]] = dict(known or {})
        self.stack = [_Frame()]
        self.joined: tuple[int, int] | None = None  # the last string's token and item, which a `+` may continue

    def word(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def before(self, i: int) -> int:
        i -= 1
        while i >= 0 and self.tokens[i][0] == "line":
            i -= 1
        return i

    def after(self, i: int) -> int:
        i += 1
        while i < len(self.tokens) and self.tokens[i][0] == "line":
            i += 1
        return i

    def assignee(self, i: int) -> tuple[str, str] | None:
        """Name and assignment type of what stands left of the token."""
        frame = self.stack[-1]
        part = [t for t in self.tokens[frame.begin : i] if t[0] != "line"]
        if not part:
            return None
        words = {t[1] for t in part if t[0] == "word"}
        colon = next((k for k, t in enumerate(part) if t[1] == ":" and k and part[k - 1][0] == "word"), None)
        last = len(part) - 1 if colon is None or frame.open == "{" and part[-1][0] == "word" and not words & {*self.own.variables, *self.own.constants} and colon == 0 else colon - 1
        while last > 0 and part[last][1] in ("?", "!"):
            last -= 1
        kind, name = part[last][0], part[last][1]
        if name == "]" and last >= 2 and part[last - 1][0] == "string":
            env = any(t[1] in ("ENV", "environ", "env") for t in part)
            return unquoted(part[last - 1][1]), "Variable" if env and self.name == "Ruby" else "Element"
        if name == "]" and last >= 2 and part[last - 1][0] == "word" and part[last - 1][1].startswith(":"):
            return part[last - 1][1][1:], "Element"
        if kind != "word":
            return None
        if self.name == "PowerShell" and name.lower().startswith("$env:"):
            return name[5:], "EnvironmentVariable"
        name = name.lstrip("$@:") or name
        if frame.open == "(" and frame.defines:
            return name, "Parameter"
        if frame.open == "(" and frame.callee:
            return name, self.own.argument
        if part[0][1] == "<" or self.stack[-1].open == "<":
            return name, "Attribute"
        if words & set(self.own.constants) or self.name == "Ruby" and name[:1].isupper():
            return name, "Constant"
        member = last and part[last - 1][1] in (".", "->", "?.", "::")
        return name, "Property" if member else "Variable"

    def closes_statement(self, i: int) -> bool:
        """Whether the line break at i ends a statement."""
        if not self.own.lines or self.stack[-1].open in ("(", "["):
            return False
        last, following = self.word(self.before(i)), self.word(self.after(i))
        return not (last and last[-1] in "=+,.&|?:([{\\" or following and following[0] in "+.?&|:)]}" and following != "::")

    def run(self) -> list[Item]:
        for i, (kind, text, start, end) in enumerate(self.tokens):
            frame = self.stack[-1]
            if kind == "line":
                if self.closes_statement(i):
                    frame.bound, frame.begin, frame.ternary = None, i + 1, 0
            elif kind == "string":
                self.string(i, text, start, end)
            elif kind == "word":
                if self.own.infix and text == self.own.infix and self.kind(self.before(i)) == "string":
                    self.take_key(self.before(i), "Element")
            elif text in _OPENS:
                self.open(i, text)
            elif text in (")", "]", "}"):
                self.close(i, text)
            elif text == ";":
                frame.bound = frame.key = None
                frame.begin, frame.ternary = i + 1, 0
            elif text == ",":
                if frame.defines:
                    self.parameter(i)
                frame.bound = frame.key = None
                frame.argument, frame.begin, frame.ternary = frame.argument + 1, i + 1, 0
            elif text in ("=", ":=", "+=", "??=", "||="):
                found = self.assignee(i)
                if found and frame.open == "{" and frame.inherited and not frame.bound:
                    found = found[0], "Element"
                frame.bound = found or frame.bound
            elif text == "?":
                frame.ternary += self.word(self.after(i)) not in (":", "=", ",", ")", ">")
            elif text == "=>" and self.own.arrow or text == ":":
                self.colon(i, text)
        return [*self.items, *self.joins()]

    def colon(self, i: int, text: str) -> None:
        frame, prev = self.stack[-1], self.before(i)
        if frame.ternary and text == ":":
            frame.ternary -= 1
            return
        if frame.defines and text == ":":
            return
        if self.kind(prev) not in ("word", "string") or prev < frame.begin or self.own.typed and frame.open == "{" and self.kind(prev) == "word" and not frame.inherited and self.name == "CSharp":
            return
        if frame.open not in _OPENS or self.before(prev) >= frame.begin and self.word(self.before(prev)) not in ("{", "(", "[", ",", "..."):
            return
        self.take_key(prev, self.own.argument if frame.open == "(" and self.kind(prev) == "word" else "Element" if text == "=>" or frame.open != "{" else self.own.pair)

    def take_key(self, at: int, kind: str) -> None:
        text = self.word(at)
        name = unquoted(text) if self.kind(at) == "string" else text.lstrip("$@:")
        self.stack[-1].key = name, kind
        if self.kind(at) == "string" and self.items and self.joined and self.joined[0] == at:
            self.items.pop()  # it was a key and no value
            self.joined = None

    def open(self, i: int, text: str) -> None:
        outer, prev = self.stack[-1], self.before(i)
        frame = _Frame(text, begin=i + 1)
        word = self.word(prev) if self.kind(prev) == "word" and self.word(prev) not in _KEYWORDS else ""
        if text == "(":
            frame.callee = word
            link = self.before(prev)
            frame.qualified = bool(word) and self.word(link) in (".", "->", "::", "?.")
            frame.receiver = "".join(t[1] for t in self.tokens[max(0, link - 6) : link] if t[0] == "word") if frame.qualified else ""
            typed = self.own.typed and self.kind(link) == "word" and self.word(link) not in _KEYWORDS and not frame.qualified
            frame.defines = bool(word) and (self.word(link) in self.own.definitions or typed or self.name == "PowerShell" and word.lower() == "param")
        block = text == "{" and (self.word(prev) in (")", "=>", "{", "}", ";", "") or word and not outer.binding())
        frame.inherited = None if frame.defines or block else outer.binding()
        self.stack.append(frame)

    def close(self, i: int, text: str) -> None:
        if len(self.stack) == 1:
            return
        frame = self.stack[-1]
        if _OPENS[frame.open] != text:  # unbalanced: the nearest frame that this closes, if any
            at = next((k for k in range(len(self.stack) - 1, 0, -1) if _OPENS[self.stack[k].open] == text), None)
            if at is None:
                return
            del self.stack[at + 1 :]
            frame = self.stack[-1]
        if frame.defines:
            self.parameter(i)
            self.defined[frame.callee] = frame.params
        self.stack.pop()
        if text == "}" and self.stack[-1].open in ("{", "") and self.word(self.after(i)) not in (",", ")", "]", ".", ";", "?.", "||", "??", "+"):
            self.stack[-1].bound, self.stack[-1].begin = None, i + 1

    def parameter(self, i: int) -> None:
        frame = self.stack[-1]
        part = [t for t in self.tokens[frame.begin : i] if t[0] != "line"]
        equals = next((k for k, t in enumerate(part) if t[1] == "="), len(part))
        names = [t for t in part[:equals] if t[0] == "word"]
        colon = next((k for k, t in enumerate(part[:equals]) if t[1] == ":"), None)
        if colon:
            names = [t for t in part[:colon] if t[0] == "word"]
        if names:
            one = names[0] if self.name == "Go" else names[-1]
            frame.params.append(one[1].lstrip("$@&*"))

    def string(self, i: int, text: str, start: int, end: int) -> None:
        frame, value, prev = self.stack[-1], unquoted(text), self.before(i)
        if self.joined and (self.word(prev) in self.own.join and self.before(prev) == self.joined[0] or prev == self.joined[0] and self.name in ("Python", "Ruby", "Dart") and (i - 1 == prev or frame.open == "(")):
            old = self.items[self.joined[1]]
            self.items[self.joined[1]] = Item(old.kind, old.name, old.assignment_type, old.value + value, old.start, end, old.scope)
            self.joined = i, self.joined[1]
            return
        if frame.open == "[" and self.word(self.after(i)) == "]" and self.word(self.after(self.after(i))) == "=":
            return  # the key of a subscript
        item = self.bind(frame, value, start, end)
        if frame.open == "(" and frame.argument == 0 and frame.first is None:
            frame.first = value
        if item is None:
            return
        self.items.append(item)
        self.joined = i, len(self.items) - 1
        if self.own.calls and frame.open == "(" and frame.callee and not frame.qualified and not frame.defines and not frame.key:
            self.calls.append((frame.callee, frame.argument, item))

    def bind(self, frame: _Frame, value: str, start: int, end: int) -> Item | None:
        own, named = self.own, lambda name, kind: Item("assignment", name, kind, value, start, end)
        if frame.key:
            lower = frame.key[0].lower()
            if any(f.key and f.key[0].lower() == "headers" or f.bound and f.bound[0].lower() == "headers" for f in self.stack):
                return Item("header", frame.key[0], "Header", value, start, end)
            if self.name == "Swift" and lower in ("forhttpheaderfield", "forheader", "forkey", "key") and self.items:
                last = self.items.pop()
                return Item("header" if "header" in lower else "assignment", value, "Header" if "header" in lower else "Argument", last.value, last.start, last.end)
            return named(*frame.key)
        if frame.open == "(" and frame.callee and not frame.defines and not frame.bound:
            callee, at = frame.callee, frame.argument
            if callee in own.headers and (not own.header_receiver or "header" in frame.receiver.lower()):
                return None if at == 0 else Item("header", frame.first, "Header", value, start, end) if at == 1 and frame.first else Item("value", None, None, value, start, end)
            if callee in own.setters and (at == 0 or at == 1 and frame.first):
                return None if at == 0 else named(frame.first, own.setter_kind)
            if callee in own.extra and at == own.extra[callee] + 1 and self.items:
                name = self.items[-1].value if self.items[-1].end < start else None
                return named(name, "Constant") if name else None
            if callee in own.pairs_of and frame.receiver.endswith("Map"):
                if at % 2 == 0:
                    frame.first = value
                    return None
                return named(frame.first, "Element") if frame.first else None
            if self.name == "Php" and callee == "header" and ":" in value:
                name, _, rest = value.partition(":")
                return Item("header", name.strip(), "Header", rest.strip(), start, end)
            if self.name == "Kotlin" and callee in ("bearerAuth", "basicAuth"):
                return Item("header", "Authorization", "Header", value, start, end)
            if own.logins and re.search("login|signin|authenticate|logon", callee, re.I):
                return named("password", "Argument")
            if own.lone_setters and frame.qualified and (m := re.fullmatch(r"(?:set|with)?_?([A-Za-z]\w*)", callee)) and at == 0 and callee[:3] in ("set", "wit"):
                return named(callee, "Variable")
        if self.name == "PowerShell" and (option := self.option(start)):
            return named(*option)
        if bound := frame.binding():
            return named(*bound)
        return Item("value", None, None, value, start, end)

    def option(self, start: int) -> tuple[str, str] | None:
        """The `-Name` before a PowerShell argument."""
        line = self.text[self.text.rfind("\n", 0, start) + 1 : start]
        if re.search(r"ConvertTo-SecureString\s+(?:-String\s+)?$", line, re.I):
            return "password", "Argument"
        m = re.search(r"-([A-Za-z]\w*)\s+$", line)
        return (m[1], "Argument") if m else None

    def joins(self) -> list[Item]:
        """Arguments of calls, named by the parameters of the functions they call; the last definition of a name counts."""
        found = []
        for callee, at, item in self.calls:
            params = self.defined.get(callee, [])
            if at < len(params) and item.kind == "value":
                found.append(Item("assignment", params[at], "Argument", item.value, item.start, item.end))
        return found


def extract(language: str, text: str, known: dict[str, list[str]] | None = None) -> list[Item]:
    """The items of a text; ``known`` has functions defined elsewhere, with their parameters."""
    return _Walk(language, text, known).run()


def definitions(language: str, text: str) -> dict[str, list[str]]:
    walk = _Walk(language, text)
    walk.run()
    return walk.defined
