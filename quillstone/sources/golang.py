"""Declarations of Go source texts: a scanner and a parser of everything but bodies.

Works on one text at a time and needs no session; :mod:`quillstone.sources.loader`
runs it over files in Arrow batches. Offsets are bytes of the UTF-8 text plus
one, so that 0 stays "no position". Bodies and values are passed over by their
brackets; what they hold isn't checked. Tokens are held for one statement at a
time, and declarations are given one by one, so that a long file needs little
beside its text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

_TOKEN = re.compile(
    r"""(?P<blank>[ \t\r﻿]+)
    |(?P<newline>\n)
    |(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<string>`[^`]*`|"(?:\\[^\n]|[^"\\\n])*")
    |(?P<rune>'(?:\\[^\n][^'\n]*|[^'\\\n])')
    |(?P<number>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?|(?:[0-9]|\.[0-9])[0-9_.]*(?:[eE][+-]?[0-9_]+|[oObB][0-9_]+)?)i?)
    |(?P<name>[^\W\d]\w*)
    |(?P<sign><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|[=!<>:+\-*/%&|^]=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.VERBOSE | re.DOTALL,
)
_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_KEYWORDS = {"break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_DIRECTIVE = re.compile(r"[a-z0-9]+:[a-z0-9]|line |extern |export ")


#: The number of a constant in its group, outside quotes.
_IOTA = re.compile(r"\biota\b")


class GoSyntaxError(ValueError):
    """A text that isn't Go, with the line of the first fault."""


#: A whole declaration of the plainest kind with its comment, at the start of a line.
_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_PLAIN = re.compile(
    rf"""\n*(?P<doc>(?://[^\n]*\n)*)(?P<whole>
    type\ ({_NAME})\ (struct\ \{{\n?\}}|interface\ \{{\n?\}}|{_NAME})
    |(?:var|const)\ ({_NAME})(?:\ ({_NAME}))?\ =\ ([0-9]+)
    |func\ ({_NAME})(\((?:({_NAME})\ ({_NAME}))?\)(?:\ ({_NAME}))?)\ \{{([A-Za-z0-9_\ \t\n=.,;:+*<>-]*)\}}
    )(?:\n|\Z)""",
    re.VERBOSE,
)


@dataclass(slots=True)
class Token:
    kind: str  # name, keyword, string, rune, number, sign, eof
    text: str
    start: int  # characters
    stop: int
    line: int
    doc: str = ""  # the comment group that ends on the line above


def _doc_text(comments: list[str]) -> str:
    """What a comment group says: no marks, no directives, no trailing blanks; one blank line at most."""
    lines: list[str] = []
    for c in comments:
        if c.startswith("//"):
            body = c[2:]
            if _DIRECTIVE.match(body):
                continue
            lines.append(body[1:] if body[:1] == " " else body)
        else:
            lines += c[2:-2].split("\n")
    out: list[str] = []
    for x in (x.rstrip() for x in lines):
        if x or (out and out[-1]):
            out.append(x)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out) + "\n" if out else ""


@lru_cache(1024)
def _plain_doc(lines: str) -> str:
    return _doc_text(lines.split("\n")[:-1])


class _Scanner:
    """Tokens with their doc comments, semicolons at line ends put in; a statement at a time."""

    def __init__(self, source: str):
        self.source = source
        self.at, self.line = 0, 1
        self.group: list[str] = []  # comments that stand alone, up to group_end
        self.group_end = -1
        self.last_line = 0  # where the last token begins
        self.stop = 0  # where the last token ends

    def statement(self) -> list[Token]:
        """The tokens up to the next semicolon outside brackets, or up to the end of the text, which is twice there to look ahead."""
        source, n, at, line, out = self.source, len(self.source), self.at, self.line, []
        ends_line = False  # whether a newline here makes a semicolon
        depth = 0
        while True:
            m = _TOKEN.match(source, at) if at < n else None
            if m is None and at < n:
                raise GoSyntaxError(f"line {line}: unexpected {source[at]!r}")
            kind, text = (m.lastgroup, m.group()) if m else ("eof", "")
            over = False
            lines = text.count("\n") if kind == "comment" else 0
            trailing = self.last_line == line
            if ends_line and (kind in ("newline", "eof") or (kind == "comment" and (lines or text.startswith("//")))):
                out.append(Token("sign", ";", at, at, line))
                self.last_line, self.stop = line, at
                ends_line, over = False, depth <= 0
            if kind == "eof":
                out += [Token("eof", "", n, n, line)] * 2
                break
            at = m.end()
            if kind == "newline":
                line += 1
            elif kind == "comment":
                if trailing:
                    self.group, self.group_end = [], -1
                else:
                    self.group = [*self.group, text] if self.group_end >= line - 1 else [text]
                    self.group_end = line + lines
                line += lines
            elif kind != "blank":
                doc = _doc_text(self.group) if self.group and self.group_end == line - 1 else ""
                self.group, self.group_end = [], -1
                if kind == "name" and text in _KEYWORDS:
                    kind = "keyword"
                out.append(Token(kind, text, m.start(), at, line, doc))
                self.last_line, self.stop = line, at
                line += text.count("\n")
                ends_line = kind in ("name", "string", "rune", "number") or text in _ENDS
                if kind == "sign":
                    depth += (text in _CLOSE) - (text in (")", "]", "}"))
                    over = text == ";" and depth <= 0
            if over:
                break
        self.at, self.line = at, line
        return out

    def plain(self) -> re.Match | None:
        """Past a declaration of the plainest kind, if one begins here."""
        if self.group or (self.at and self.source[self.at - 1] != "\n"):
            return None
        m = _PLAIN.match(self.source, self.at)
        if m is None or not _KEYWORDS.isdisjoint(m.groups()[2:]):
            return None
        self.line += self.source.count("\n", self.at, m.end())
        self.at, self.stop, self.last_line = m.end(), m.end("whole"), 0
        return m


class _Parser:
    def __init__(self, source: str):
        self.source = source
        self.scanner = _Scanner(source)
        self.tokens: list[Token] = []  # of one statement
        self.at = 0
        # byte offsets of characters, where they differ
        self.wide = array("q", (i for i, c in enumerate(source) if ord(c) > 127) if not source.isascii() else ())
        total, self.extra = 0, array("q", [0])
        for i in self.wide:
            total += len(source[i].encode()) - 1
            self.extra.append(total)

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self) -> Token:
        """The next statement's first token, where one has ended."""
        if self.at >= len(self.tokens):
            self.tokens, self.at = self.scanner.statement(), 0
        return self.now

    def fail(self, wanted: str):
        raise GoSyntaxError(f"line {self.now.line}: {wanted} expected, {self.now.text or 'end of file'!r} found")

    def take(self, text: str | None = None, kind: str | None = None) -> Token:
        t = self.now
        if (text is not None and t.text != text) or (kind is not None and t.kind != kind) or t.kind == "eof":
            self.fail(text or kind or "token")
        self.at += 1
        return t

    def had(self, text: str) -> bool:
        if self.now.text == text and self.now.kind in ("sign", "keyword"):
            self.at += 1
            return True
        return False

    def pos(self, char: int) -> int:
        return char + self.extra[bisect_right(self.wide, char - 1)] + 1 if self.wide else char + 1

    def text(self, first: int, stop: int) -> str:
        """Source from token ``first`` up to token ``stop``."""
        return self.source[self.tokens[first].start : self.tokens[stop - 1].stop] if stop > first else ""

    def group(self) -> None:
        """Past a bracketed group, brackets inside it included."""
        if self.now.text not in _CLOSE:
            self.fail("opening bracket")
        want = [_CLOSE[self.take().text]]
        while want:
            t = self.take()
            if t.kind == "sign" and t.text in _CLOSE:
                want.append(_CLOSE[t.text])
            elif t.kind == "sign" and t.text in (")", "]", "}"):
                if t.text != want.pop():
                    self.at -= 1
                    self.fail("closing bracket")

    def upto(self, *stops: str) -> None:
        """Past an expression, to one of the signs outside all brackets."""
        while not (self.now.kind == "sign" and self.now.text in stops):
            if self.now.kind == "eof":
                self.fail(stops[0])
            if self.now.kind == "sign" and self.now.text in _CLOSE:
                self.group()
            elif self.now.kind == "sign" and self.now.text in (")", "]", "}"):
                self.fail(stops[0])
            else:
                self.at += 1

    # types

    def type_(self) -> str:
        """Past one type; its kind: struct, interface, star, name or type."""
        t = self.now
        if t.text == "struct":
            self.at += 1
            self.group()
            return "struct"
        if t.text == "interface":
            self.at += 1
            self.group()
            return "interface"
        if self.had("*"):
            return "star" if self.type_() == "name" else "type"
        if self.had("("):
            self.type_()
            self.take(")")
            return "type"
        if t.text == "[":
            self.group()
            self.type_()
            return "type"
        if self.had("map"):
            self.group()
            self.type_()
            return "type"
        if self.had("chan"):
            self.had("<-")
            self.type_()
            return "type"
        if self.had("<-"):
            self.take("chan")
            self.type_()
            return "type"
        if self.had("func"):
            self.signature()
            return "type"
        if t.kind == "name":
            self.at += 1
            kind = "name"
            while self.had("."):
                self.take(kind="name")
                kind = "type"
            if self.now.text == "[" and self.now.kind == "sign":
                self.group()
                kind = "type"
            return kind
        self.fail("type")
        return ""

    def starts_type(self) -> bool:
        t = self.now
        return t.kind == "name" or t.text in ("struct", "interface", "map", "chan", "func") or (t.kind == "sign" and t.text in ("*", "(", "[", "<-"))

    def parameters(self) -> list[dict]:
        """Past '(...)': names, types and dots. Names stand for all or for none."""
        self.take("(")
        parts: list[tuple[int, int, int, bool]] = []  # first token, type's first, stop, dots
        while not self.had(")"):
            first = begin = self.at
            dots = self.had("...")
            if dots:
                begin = self.at
                self.type_()
            else:
                self.type_()
                if self.now.text not in (",", ")"):  # what seemed a type is a name
                    begin = self.at
                    dots = self.had("...")
                    if dots:
                        begin = self.at
                    self.type_()
            parts.append((first, begin, self.at, dots))
            if not self.had(","):
                self.had(";")
                self.take(")")
                break
        named = any(self.tokens[a].kind == "name" and b > a for a, b, _, _ in parts)
        out: list[dict] = []
        waiting: list[str] = []
        for a, b, stop, dots in parts:
            if not named:
                out.append({"name": "", "type": self.text(b, stop), "is_variadic": dots})
            elif b == a:
                waiting.append(self.text(a, stop))
            else:
                out += [{"name": x, "type": self.text(b, stop), "is_variadic": dots} for x in [*waiting, self.tokens[a].text]]
                waiting = []
        return out

    def signature(self) -> tuple[list[dict], list[dict], str]:
        """Past parameters and results."""
        first = self.at
        params = self.parameters()
        results: list[dict] = []
        if self.now.text == "(" and self.now.kind == "sign":
            results = self.parameters()
        elif self.starts_type():
            begin = self.at
            self.type_()
            results = [{"name": "", "type": self.text(begin, self.at), "is_variadic": False}]
        return params, results, self.text(first, self.at)

    def fields(self) -> list[dict]:
        self.take("struct")
        self.take("{")
        out: list[dict] = []
        while not self.had("}"):
            first, doc = self.at, self.now.doc
            names: list[str] = []
            nxt = self.tokens[self.at + 1]
            if self.now.kind == "name" and not (nxt.kind == "sign" and nxt.text in (".", ";", "}")) and nxt.kind != "string" and not self._generic_embedded():
                names.append(self.take(kind="name").text)
                while self.had(","):
                    names.append(self.take(kind="name").text)
            begin = self.at
            self.type_()
            kind = self.text(begin, self.at)
            tag = self.take().text if self.now.kind == "string" else ""
            out.append({"names": names, "type": kind, "tag": tag, "doc": doc, "start": self.pos(self.tokens[first].start), "stop": self.pos(self.tokens[self.at - 1].stop)})
            if not self.had(";") and self.now.text != "}":
                self.fail("end of field")
        return out

    def _generic_embedded(self) -> bool:
        """Name[args] that ends its line embeds a type; otherwise it is a field of an array."""
        if self.tokens[self.at + 1].text != "[":
            return False
        back = self.at
        self.at += 1
        self.group()
        t = self.now
        self.at = back
        return t.kind == "string" or t.text in (";", "}")

    def interface_methods(self) -> list[dict]:
        self.take("interface")
        self.take("{")
        out: list[dict] = []
        while not self.had("}"):
            first, doc = self.at, self.now.doc
            if self.now.kind == "name" and self.tokens[self.at + 1].text == "(":
                name = self.take().text
                _, _, text = self.signature()
                one = {"name": name, "signature": text, "embedded": ""}
            else:
                self.upto(";", "}")
                one = {"name": "", "signature": "", "embedded": self.text(first, self.at)}
            out.append({**one, "doc": doc, "start": self.pos(self.tokens[first].start), "stop": self.pos(self.tokens[self.at - 1].stop)})
            if not self.had(";") and self.now.text != "}":
                self.fail("end of method")
        return out

    # declarations

    def specs(self, one) -> None:
        """One spec, or several in parentheses."""
        if self.had("("):
            while not self.had(")"):
                one()
                if not self.had(";") and self.now.text != ")":
                    self.fail("end of declaration")
        else:
            one()

    def declarations(self) -> Iterator[tuple[str, dict]]:
        """Each declaration with the list of the file that it belongs to, in order; first and last ("file", what is known of the file)."""
        doc = self.ahead().doc
        pos = self.pos(self.take("package").start)
        yield "file", {"doc": doc, "package_pos": pos, "package": self.take(kind="name").text}
        self.take(";")
        out: dict = {k: [] for k in DECLARATIONS}
        while self.ahead().text == "import" and self.now.kind == "keyword":
            self.at += 1

            def one_import() -> None:
                first, doc = self.at, self.now.doc
                name = ""
                if self.now.kind == "name" or self.now.text == ".":
                    name = self.take().text
                path = self.take(kind="string")
                out["imports"].append({"path": path.text.strip('"`'), "name": name, "doc": doc, "start": self.pos(self.tokens[first].start), "stop": self.pos(path.stop)})

            self.specs(one_import)
            self._end()
            yield from self._drained(out)
        while True:
            if self.at >= len(self.tokens) and (m := self.scanner.plain()):
                yield self.plain(m)
                continue
            doc = self.ahead().doc
            if self.now.kind == "eof":
                break
            if self.now.text == "func" and self.now.kind == "keyword":
                self.function(out, doc)
            elif self.now.kind == "keyword" and self.now.text == "type":
                self.at += 1
                self.specs(lambda d=doc: self.type_spec(out, d))
            elif self.now.kind == "keyword" and self.now.text in ("var", "const"):
                rows = out["variables" if self.take().text == "var" else "constants"]
                last: list = ["", [], 0]  # a constant without type and value repeats the ones before; and its number
                self.specs(lambda d=doc, r=rows, x=last: self.value_spec(r, d, x))
            else:
                self.fail("declaration")
            self._end()
            yield from self._drained(out)
        yield "file", {"stop": self.pos(self.scanner.stop)}

    def _drained(self, out: dict) -> Iterator[tuple[str, dict]]:
        for k, rows in out.items():
            for row in rows:
                yield k, row
            rows.clear()

    def plain(self, m: re.Match) -> tuple[str, dict]:
        """What the other methods make of a declaration that ``_PLAIN`` matches."""
        comment, whole, type_, underlying, value, of, given, func, signature, param, param_type, result, body = m.groups()
        doc = _plain_doc(comment) if comment else ""
        if type_:
            kind = "struct" if underlying.startswith("struct ") else "interface" if underlying.startswith("interface ") else "type"
            return "types", {"name": type_, "kind": kind, "params": "", "alias": False, "underlying": underlying, "fields": [], "methods": [], "doc": doc, "start": self.pos(m.start(3)), "stop": self.pos(m.end("whole"))}
        if value:
            return "variables" if whole.startswith("var") else "constants", {"name": value, "type": of or "", "value": given, "given": True, "spec": "", "doc": doc, "start": self.pos(m.start(5)), "stop": self.pos(m.end(5))}
        one = lambda name, kind: [{"name": name, "type": kind, "is_variadic": False}]
        return "functions", {"name": func, "receiver": None, "parameters": one(param, param_type) if param else [], "results": one("", result) if result else [], "signature": signature, "body": body.lstrip(" \t").removeprefix("\n"), "doc": doc, "start": self.pos(m.start("whole")), "stop": self.pos(m.end("whole"))}

    def _end(self) -> None:
        if self.now.kind != "eof":
            self.take(";")

    def function(self, out: dict, doc: str) -> None:
        first = self.at
        self.take("func")
        receiver = None
        if self.now.text == "(":
            begin = self.at
            self.take("(")
            name = ""
            if self.now.kind == "name" and self.tokens[self.at + 1].text not in (")", ".", "[", ","):
                name = self.take().text
            elif self.now.kind == "name" and self.tokens[self.at + 1].text == "[":
                back = self.at
                self.at += 1
                self.group()
                named = self.now.text not in (")", ",")
                self.at = back
                if named:
                    name = self.take().text
            begin = self.at
            kind = self.type_()
            text = self.text(begin, self.at)
            self.had(",")
            self.take(")")
            base = text.lstrip("*")
            receiver = {"name": name, "type": base if kind in ("star", "name") else "", "is_pointer": text.startswith("*"), "full": base}
        name = self.take(kind="name").text
        generic = self.at
        if self.now.text == "[":
            self.group()
        generic_text = self.text(generic, self.at)
        params, results, text = self.signature()
        body = None
        if self.now.text == "{":
            begin = self.at
            self.group()
            body = self.source[self.tokens[begin].stop : self.tokens[self.at - 1].start].lstrip(" \t").removeprefix("\n")
        out["functions"].append({"name": name, "receiver": receiver, "parameters": params, "results": results, "signature": generic_text + text, "body": body, "doc": doc, "start": self.pos(self.tokens[first].start), "stop": self.pos(self.tokens[self.at - 1].stop)})

    def type_spec(self, out: dict, group_doc: str) -> None:
        first, doc = self.at, self.now.doc
        name = self.take(kind="name").text
        params = ""
        if self.now.text == "[" and self._type_parameters():
            begin = self.at
            self.group()
            params = self.text(begin, self.at)
        alias = self.had("=")
        begin = self.at
        kind = {"struct": "struct", "interface": "interface"}.get(self.type_(), "type")
        underlying = self.text(begin, self.at)
        stop = self.at
        fields: list[dict] = []
        methods: list[dict] = []
        if kind != "type":
            self.at = begin
            fields, methods = (self.fields(), []) if kind == "struct" else ([], self.interface_methods())
            self.at = stop
        out["types"].append({"name": name, "kind": kind, "params": params, "alias": alias, "underlying": underlying, "fields": fields, "methods": methods, "doc": group_doc or doc, "start": self.pos(self.tokens[first].start), "stop": self.pos(self.tokens[stop - 1].stop)})

    def _type_parameters(self) -> bool:
        """[T any] begins a generic type; [5]int and []int are arrays."""
        a, b = self.tokens[self.at + 1], self.tokens[self.at + 2]
        if a.kind != "name":
            return False
        return not (b.kind == "sign" and b.text in ("]", "+", "-", "/", "<<", ">>", "(", ".", "%", "&", "|"))

    def value_spec(self, rows: list[dict], doc: str, last: list) -> None:
        names = [self.take(kind="name")]
        while self.had(","):
            names.append(self.take(kind="name"))
        kind, values = "", []
        if self.now.text not in ("=", ";", ")"):
            begin = self.at
            self.type_()
            kind = self.text(begin, self.at)
        if self.had("="):
            while True:
                begin = self.at
                self.upto(",", ";", ")")
                values.append(self.text(begin, self.at))
                if not self.had(","):
                    break
        given = len(values)
        if kind or values:
            last[:2] = [kind, values]
        else:
            kind, values = last[0], last[1]
        values = [_IOTA.sub(str(last[2]), v) for v in values]
        last[2] += 1
        joint = given == 1 and len(names) > 1  # one call gives all the values
        for i, t in enumerate(names):
            spec = "" if not joint else ", ".join(x.text for x in names) if not i else "-"
            rows.append({"name": t.text, "type": kind, "value": values[i] if i < len(values) else "", "given": i < given, "spec": spec, "doc": doc, "start": self.pos(t.start), "stop": self.pos(t.stop)})


#: The lists of a file's declarations.
DECLARATIONS = ("imports", "types", "functions", "variables", "constants")


def declarations(source: str) -> Iterator[tuple[str, dict]]:
    """The declarations of one file one by one, each with the name of its list.
    A fault raises :class:`GoSyntaxError` where it is met: what came before
    counts only once the last has come."""
    return (x for x in _Parser(source).declarations() if x[0] != "file")


def parse(source: str) -> dict:
    """The declarations of one file: package, doc, imports, types (fields,
    methods), functions, variables, constants; raises :class:`GoSyntaxError`."""
    out: dict = {k: [] for k in DECLARATIONS}
    for what, row in _Parser(source).declarations():
        if what == "file":
            out |= row
        else:
            out[what].append(row)
    return out


_BUILD = re.compile(r"^//go:build\s+(.*)$", re.MULTILINE)
_SYSTEMS = {"aix", "android", "darwin", "dragonfly", "freebsd", "illumos", "ios", "js", "linux", "netbsd", "openbsd", "plan9", "solaris", "wasip1", "windows"}
_MACHINES = {"386", "amd64", "arm", "arm64", "loong64", "mips", "mips64", "mips64le", "mipsle", "ppc64", "ppc64le", "riscv64", "s390x", "wasm"}


def build_tags(source: str) -> list[str]:
    """The names in a file's build line, which stands before the package clause."""
    head = re.split(r"^package\s", source, maxsplit=1, flags=re.MULTILINE)[0]
    m = _BUILD.search(head)
    return sorted(set(re.findall(r"[\w.]+", m.group(1)))) if m else []


def is_built(name: str, source: str, tags: tuple[str, ...] = (), system: str = "linux", machine: str = "amd64") -> bool:
    """Whether a build on that system takes the file: by its name's ending and its build line."""
    on = {system, machine, "gc", "cgo", *tags} | ({"unix"} if system in ("aix", "android", "darwin", "dragonfly", "freebsd", "illumos", "ios", "linux", "netbsd", "openbsd", "solaris") else set())
    parts = name.removesuffix(".go").removesuffix("_test").split("_")[1:]
    if parts and parts[-1] in _MACHINES:
        if parts[-1] != machine or (len(parts) > 1 and parts[-2] in _SYSTEMS and parts[-2] != system):
            return False
    elif parts and parts[-1] in _SYSTEMS and parts[-1] != system:
        return False
    head = re.split(r"^package\s", source, maxsplit=1, flags=re.MULTILINE)[0]
    m = _BUILD.search(head)
    return _holds(m.group(1), on) if m else True


def _holds(line: str, on: set[str]) -> bool:
    """The value of a build line: names, !, &&, || and parentheses."""
    parts = re.findall(r"&&|\|\||[!()]|[\w.]+", line.split("//")[0])
    at = 0

    def either() -> bool:
        nonlocal at
        out = both()
        while at < len(parts) and parts[at] == "||":
            at += 1
            out = both() or out
        return out

    def both() -> bool:
        nonlocal at
        out = one()
        while at < len(parts) and parts[at] == "&&":
            at += 1
            out = one() and out
        return out

    def one() -> bool:
        nonlocal at
        if at >= len(parts):
            return False
        at += 1
        if parts[at - 1] == "!":
            return not one()
        if parts[at - 1] == "(":
            out = either()
            at += 1
            return out
        return parts[at - 1] in on or bool(re.fullmatch(r"go1(\.\d+)?", parts[at - 1]))

    return either()


def is_generated(source: str) -> bool:
    """The usual line of generated files, before the package clause."""
    head = re.split(r"^package\s", source, maxsplit=1, flags=re.MULTILINE)[0]
    return bool(re.search(r"^// Code generated .* DO NOT EDIT\.$", head, re.MULTILINE))


def line_starts(source: str) -> list[int]:
    """Where each line begins, in bytes plus one."""
    out, at = [], 1
    for line in source.encode().split(b"\n"):
        out.append(at)
        at += len(line) + 1
    return out
