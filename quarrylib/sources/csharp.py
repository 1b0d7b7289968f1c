"""Declarations of C# source: a lexer and a parser that reads down to members and scans their bodies.

Plain Python without Spark. Errors are skipped over: what can't be read costs a token, not the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed values.
PREDEFINED = frozenset(
    "bool byte sbyte short ushort int uint long ulong char float double decimal string object void nint nuint var".split()
)
MODIFIERS = frozenset(
    "public private protected internal static abstract sealed partial readonly virtual override async extern unsafe new volatile const required file ref fixed scoped".split()
)
TYPE_WORDS = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "delegate": "delegate", "record": "record"}
BRANCHES = frozenset("if while do for foreach catch".split())
NOT_TYPES = frozenset(
    "return throw await yield new if else while do for foreach switch case default break continue goto try catch finally lock checked unchecked is as in out ref this base typeof sizeof nameof "
    "null true false using namespace class struct interface enum delegate event operator where when and or not stackalloc with params get set init add remove value".split()
) - {"value"}

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<str>(?:\$+"{3,}|\$@"|@\$"|\$"|@"|"{3,}|"))
      | (?P<chr>'(?:\\.[^'\n]*|[^'\\\n])')
      | (?P<num>\.?[0-9](?:[0-9A-Fa-fxXbB_]|\.[0-9]|[eE][+-]|[uUlLfFdDmM])*)
      | (?P<id>@?[^\W\d]\w*)
      | (?P<op>=>|\?\?=?|\?\.(?![0-9])|::|&&|\|\||==|!=|<=|>=|->|\+\+|--|[+\-*/%&|^]=|\.\.|.)""",
    re.X | re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    end_line: int


def lex(src: str, offset: int = 0, line: int = 1) -> list[Token]:
    """Tokens without white space, comments and preprocessor lines; holes of interpolated strings as in parentheses."""
    out: list[Token] = []
    i, n, fresh = 0, len(src), True
    while i < n:
        if fresh and (m := re.compile(r"[ \t]*#[^\n]*").match(src, i)):
            i = m.end()
            continue
        m = TOKEN.match(src, i)
        text, kind = m[0], m.lastgroup
        if kind == "str":
            end, holes = _string(src, i, text)
            whole = src[i:end]
            last = line + whole.count("\n")
            out.append(Token("str", whole, offset + i, offset + end, line, last))
            for a, b in holes:
                at = line + src.count("\n", i, a)
                out.append(Token("op", "(", offset + a, offset + a, at, at))
                out += lex(src[a:b], offset + a, at)
                out.append(Token("op", ")", offset + b, offset + b, at, at))
            i, line, fresh = end, last, False
            continue
        end = m.end()
        last = line + text.count("\n")
        if kind == "space":
            fresh = "\n" in text or (fresh and not text.startswith("/"))
        else:
            out.append(Token(kind, text.lstrip("@") if kind == "id" else text, offset + i, offset + end, line, last))
            fresh = False
        i, line = end, last
    return out


def _string(src: str, i: int, opening: str) -> tuple[int, list[tuple[int, int]]]:
    """The end of a string literal that opens at ``i``, and the holes of an interpolated one."""
    n, j, holes = len(src), i + len(opening), []
    dollars = opening.count("$")
    quotes = opening.count('"')
    if quotes >= 3:
        end = src.find('"' * quotes, j)
        stop = n if end < 0 else end
        if dollars:
            k = j
            while (k := src.find("{" * dollars, k, stop)) >= 0:
                b = src.find("}" * dollars, k, stop)
                if b < 0:
                    break
                holes.append((k + dollars, b))
                k = b
        while end >= 0 and end + quotes < n and src[end + quotes] == '"':
            end += 1
        return (n if end < 0 else end + quotes), holes
    verbatim = "@" in opening
    while j < n:
        c = src[j]
        if c == '"':
            if verbatim and src.startswith('""', j):
                j += 2
                continue
            return j + 1, holes
        if c == "\n" and not verbatim:
            return j, holes
        if c == "\\" and not verbatim:
            j += 2
            continue
        if dollars and c in "{}":
            if src.startswith(c * 2, j):
                j += 2
                continue
            if c == "{":
                a, depth = j + 1, 0
                j += 1
                stop = None
                while j < n and not (src[j] == "}" and depth == 0):
                    if src[j] in "([{":
                        depth += 1
                    elif src[j] in ")]}":
                        depth -= 1
                    elif src[j] == ":" and depth == 0 and stop is None:
                        stop = j
                    elif src[j] == '"':
                        j = _string(src, j, '"')[0] - 1
                    elif src[j] == "\n" and not verbatim:
                        return j, holes
                    j += 1
                holes.append((a, stop if stop is not None else j))
        j += 1
    return n, holes


@dataclass
class Method:
    name: str
    line_start: int
    line_end: int
    complexity: int
    attributes: list[str]
    signature_types: list[str]
    signature: str

    @property
    def loc(self) -> int:
        return self.line_end - self.line_start + 1


@dataclass
class Type:
    kind: str
    fqn: str
    line_start: int
    line_end: int = 0
    members: int = 0
    complexity: int = 0
    methods: list[Method] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    referenced: list[str] = field(default_factory=list)

    @property
    def loc(self) -> int:
        return self.line_end - self.line_start + 1


@dataclass
class File:
    usings: list[str] = field(default_factory=list)
    namespaces: list[str] = field(default_factory=list)
    types: list[Type] = field(default_factory=list)
    references: list[str] = field(default_factory=list)


def parse(src: str) -> File:
    return _Parser(src).run()


class _Parser:
    def __init__(self, src: str):
        self.src, self.out = src, File()
        self.t = lex(src.removeprefix("﻿"))
        if src.startswith("﻿"):
            self.src = src[1:]
        self.n = len(self.t)
        self.close = self._brackets()

    def _brackets(self) -> dict[int, int]:
        """Where each opening bracket closes; one that doesn't closes at the end."""
        pair, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
        for i, t in enumerate(self.t):
            if t.kind != "op":
                continue
            if t.text in "([{":
                stack.append(i)
            elif t.text in pair:
                while stack and self.t[stack[-1]].text != pair[t.text] and t.text == "}":
                    out[stack.pop()] = i  # an open ( or [ ends with its block
                if stack and self.t[stack[-1]].text == pair[t.text]:
                    out[stack.pop()] = i
        for i in stack:
            out[i] = self.n - 1
        return out

    def is_(self, i: int, *texts: str) -> bool:
        return i < self.n and self.t[i].text in texts and self.t[i].kind in ("op", "id")

    def text(self, i: int) -> str:
        return self.t[i].text if i < self.n else ""

    def run(self) -> File:
        self.body(0, self.n, "", None)
        return self.out

    # ------------------------------------------------------------ names of types

    def type_at(self, i: int, end: int) -> tuple[int, list[str]] | None:
        """The place after a type and the simple names in it, or None."""
        while self.is_(i, "ref", "readonly", "scoped"):
            i += 1
        if i >= end:
            return None
        names: list[str] = []
        if self.is_(i, "("):
            stop = self.close.get(i, end)
            k, parts = i + 1, 0
            while k < stop:
                got = self.type_at(k, stop)
                if not got:
                    return None
                k, more = got
                names += more
                parts += 1
                if k < stop and self.t[k].kind == "id":
                    k += 1
                if k < stop:
                    if not self.is_(k, ","):
                        return None
                    k += 1
            if parts < 2:
                return None
            i = stop + 1
        elif self.t[i].kind == "id" and self.t[i].text not in NOT_TYPES:
            while True:
                last = self.t[i].text
                i += 1
                args: list[str] = []
                if self.is_(i, "<"):
                    got = self.type_args(i, end)
                    if got is None:
                        break
                    i, args = got
                if self.is_(i, ".", "::") and i + 1 < end and self.t[i + 1].kind == "id":
                    i += 1
                    continue
                names += [last] if last not in PREDEFINED else []
                names += args
                break
        else:
            return None
        while i < end:
            if self.is_(i, "?", "*"):
                i += 1
            elif self.is_(i, "[") and all(self.text(k) == "," for k in range(i + 1, self.close.get(i, i + 1))):
                i = self.close[i] + 1
            else:
                break
        return i, names

    def type_args(self, i: int, end: int) -> tuple[int, list[str]] | None:
        names: list[str] = []
        k = i + 1
        while k < end:
            if self.is_(k, ">"):
                return k + 1, names
            if self.is_(k, ","):
                k += 1
                continue
            if self.is_(k, "in", "out"):
                k += 1
            got = self.type_at(k, end)
            if not got:
                return None
            k, more = got
            names += more
            if not self.is_(k, ",", ">"):
                return None
        return None

    def refer(self, names: list[str], owner: Type | None) -> None:
        self.out.references += names
        if owner is not None:
            own = owner.fqn.rsplit(".", 1)[-1]
            owner.referenced += [x for x in names if x != own]

    # ------------------------------------------------------------ declarations

    def attributes(self, i: int, end: int, owner: Type | None) -> tuple[int, list[str], list[list[str]]]:
        """The place after attribute lists, the attributes as text, and the names to refer to once the owner is known."""
        out: list[str] = []
        names: list[list[str]] = []
        while self.is_(i, "[") and i < end:
            stop = self.close.get(i, end)
            k = i + 1
            if k + 1 < stop and self.t[k].kind == "id" and self.is_(k + 1, ":") and not self.is_(k + 2, ":"):
                k += 2
            while k < stop:
                got = self.type_at(k, stop)
                if not got:
                    k += 1
                    continue
                first = k
                k, found = got
                name = self.src[self.t[first].start : self.t[k - 1].end]
                bare = name.split("<")[0].rsplit(".", 1)[-1].rsplit("::", 1)[-1]
                bare = bare.removesuffix("Attribute") or ""
                args = ""
                if self.is_(k, "("):
                    shut = self.close.get(k, stop)
                    args = " ".join(self.src[self.t[k].end : self.t[shut].start].replace('"', "'").split())
                    self.expression(k + 1, shut, owner)
                    k = shut + 1
                if bare:
                    out.append(f"{bare}({args})" if args else bare)
                names.append(found)
                while k < stop and not self.is_(k, ","):
                    k += 1
                k += 1
            i = stop + 1
        return i, out, names

    def body(self, i: int, end: int, ns: str, owner: Type | None) -> None:
        """The declarations of a file, a namespace or a type."""
        while i < end:
            first = i
            i, attrs, attr_names = self.attributes(i, end, owner)
            start = first
            mods = i
            while i < end and self.t[i].kind == "id" and self.t[i].text in MODIFIERS and not (self.is_(i, "file", "required", "scoped") and not (i + 1 < end and self.t[i + 1].kind == "id")):
                i += 1
            if i >= end:
                return
            word = self.t[i].text if self.t[i].kind == "id" else ""
            if owner is None and word in ("using", "global") and not self.is_(i + 1, "("):
                i = self.using(i, end)
            elif owner is None and word == "namespace":
                i, ns = self.namespace(i, end, ns)
            elif owner is None and self.is_(mods, "extern") and word == "alias":
                i = self.skip_to(i, end, ";") + 1
            elif word in TYPE_WORDS and self.is_type(i, end):
                i = self.type_(i, end, start, ns, owner, attrs, attr_names)
            elif owner is not None:
                for x in attr_names:
                    self.refer(x, owner)
                i = self.member(i, end, start, mods, owner, attrs)
            else:
                for x in attr_names:
                    self.refer(x, None)
                i = self.top(i, end)
            if i <= first:
                i = first + 1

    def is_type(self, i: int, end: int) -> bool:
        if self.t[i].text == "record":
            return i + 1 < end and self.t[i + 1].kind == "id" and (self.is_(i + 1, "class", "struct") or self.is_(i + 2, "(", "{", ";", ":", "<", "where"))
        if self.t[i].text == "delegate":
            return not self.is_(i + 1, "*", "(", "{")
        return i + 1 < end and self.t[i + 1].kind == "id"

    def skip_to(self, i: int, end: int, *texts: str) -> int:
        """The place of one of some tokens outside of brackets, or the end."""
        while i < end:
            if self.is_(i, *texts):
                return i
            i = self.close[i] + 1 if i in self.close else i + 1
        return end

    def using(self, i: int, end: int) -> int:
        stop = self.skip_to(i, end, ";")
        k = i + 1
        while self.is_(k, "using", "static", "unsafe"):
            k += 1
        if self.is_(k + 1, "="):
            k += 2
        got = self.type_at(k, stop)
        if got and got[0] == stop:
            name = self.src[self.t[k].start : self.t[stop - 1].end]
            if "<" not in name and "(" not in name and name not in PREDEFINED:
                self.out.usings.append("".join(name.split()))
        return stop + 1

    def namespace(self, i: int, end: int, ns: str) -> tuple[int, str]:
        k = i + 1
        while k < end and (self.t[k].kind == "id" or self.is_(k, ".")):
            k += 1
        name = "".join(t.text for t in self.t[i + 1 : k])
        full = f"{ns}.{name}" if ns else name
        if name:
            self.out.namespaces.append(full)
        if self.is_(k, "{"):
            stop = self.close.get(k, end)
            self.body(k + 1, min(stop, end), full, None)
            return stop + 1, ns
        return k + 1, full

    def type_(self, i: int, end: int, start: int, ns: str, owner: Type | None, attrs: list[str], attr_names: list[list[str]]) -> int:
        kind = TYPE_WORDS[self.t[i].text]
        result: list[str] = []
        if kind == "record" and self.is_(i + 1, "class", "struct"):
            kind = "record_struct" if self.is_(i + 1, "struct") else "record"
            i += 1
        i += 1
        if kind == "delegate":
            got = self.type_at(i, end)
            if not got:
                return i
            i, result = got
        if i >= end or self.t[i].kind != "id":
            return i
        name = self.t[i].text
        prefix = owner.fqn if owner else ns
        me = Type(kind, f"{prefix}.{name}" if prefix else name, self.t[start].line, attributes=attrs)
        self.out.types.append(me)
        i += 1
        if kind == "delegate":
            self.refer(result, owner)  # the declaration's own type is read before its name
        for x in attr_names:
            self.refer(x, me)
        if self.is_(i, "<"):
            got = self.type_args(i, end)
            i = got[0] if got else i + 1
        if self.is_(i, "("):
            shut = self.close.get(i, end)
            self.parameters(i + 1, shut, me)
            i = shut + 1
        if self.is_(i, ":"):
            i += 1
            while i < end:
                got = self.type_at(i, end)
                if not got:
                    break
                i, names = got
                me.bases += names
                self.refer(names, me)
                if self.is_(i, "("):
                    i = self.close.get(i, end) + 1
                if not self.is_(i, ","):
                    break
                i += 1
        i = self.skip_to(i, end, "{", ";")
        if self.is_(i, "{"):
            stop = min(self.close.get(i, end), end)
            if kind == "enum":
                self.expression(i + 1, stop, me)
            else:
                self.body(i + 1, stop, ns, me)
            me.complexity = self.branches(start, stop)
            i = stop
        me.line_end = self.t[min(i, self.n - 1)].end_line
        return i + 1

    def parameters(self, i: int, end: int, owner: Type | None) -> list[str]:
        """Names in the types of a parameter list, referred to."""
        out: list[str] = []
        while i < end:
            i, _, names = self.attributes(i, end, owner)
            for x in names:
                self.refer(x, owner)
            while self.is_(i, "this", "params", "in", "out", "ref", "scoped", "readonly"):
                i += 1
            got = self.type_at(i, end)
            if got and got[0] < end and self.t[got[0]].kind == "id":
                out += got[1]
                self.refer(got[1], owner)
                i = got[0] + 1
            stop = self.skip_to(i, end, ",")
            self.expression(i, stop, owner)
            i = stop + 1
        return out

    def member(self, i: int, end: int, start: int, mods: int, owner: Type, attrs: list[str]) -> int:
        """One member of a type; the place after it."""
        if self.is_(i, ";"):
            return i + 1
        if self.is_(i, "event"):
            got = self.type_at(i + 1, end)
            stop = self.skip_to(got[0] if got else i + 1, end, ";", "{", "=")
            if got:
                self.refer(got[1], owner)
            owner.members += 1
            return self.rest(stop, end, owner)
        if self.is_(i, "~") and i + 1 < end and self.t[i + 1].kind == "id":
            return self.method(i + 1, i + 2, end, start, mods, owner, attrs, self.t[i + 1].text, [])
        if self.is_(i, "implicit", "explicit"):
            k = self.skip_to(i, end, "operator")
            got = self.type_at(k + 1, end)
            if got and self.is_(got[0], "("):
                self.refer(got[1], owner)
                return self.method(k, got[0], end, start, mods, owner, attrs, "<anonymous>", got[1])
            return self.rest(self.skip_to(i, end, ";", "{", "=>"), end, owner)
        simple = owner.fqn.rsplit(".", 1)[-1]
        if self.is_(i, simple) and self.is_(i + 1, "("):
            return self.method(i, i + 1, end, start, mods, owner, attrs, simple, [])
        got = self.type_at(i, end)
        if not got:
            return self.close[i] + 1 if i in self.close else i + 1
        k, names = got
        if self.is_(k, "operator"):
            at = self.skip_to(k + 1, end, "(") if not self.is_(k + 1, "(") else k + 1
            self.refer(names, owner)
            return self.method(k, at, end, start, mods, owner, attrs, "<anonymous>", names)
        name_at = k
        while k + 1 < end and self.t[k].kind == "id":  # an interface's member may be named with it
            after = k + 1
            if self.is_(after, "<") and (args := self.type_args(after, end)):
                after = args[0]
            if self.is_(after, "."):
                k = after + 1
                name_at = k
                continue
            if self.is_(after, "("):
                self.refer(names, owner)
                return self.method(k, after, end, start, mods, owner, attrs, self.t[name_at].text, names)
            k = after
            break
        if self.is_(name_at, "this") and self.is_(name_at + 1, "["):
            shut = self.close.get(name_at + 1, end)
            self.refer(names, owner)
            self.parameters(name_at + 2, shut, owner)
            owner.members += 1
            return self.rest(self.skip_to(shut + 1, end, "{", "=>", ";"), end, owner)
        if name_at >= end or self.t[name_at].kind != "id":
            return max(k, i + 1)
        self.refer(names, owner)
        owner.members += 1
        return self.rest(self.skip_to(k, end, "{", "=>", ";", "="), end, owner)

    def rest(self, i: int, end: int, owner: Type) -> int:
        """What follows a member's head: a block and maybe a value, or up to the semicolon; the place after it."""
        if self.is_(i, "{"):
            shut = min(self.close.get(i, end), end)
            self.statements(i + 1, shut, owner)
            i = shut + 1
            if not self.is_(i, "="):
                return i
        stop = self.skip_to(i, end, ";")
        self.expression(i, stop, owner)
        return stop + 1

    def method(self, name_at: int, opening: int, end: int, start: int, mods: int, owner: Type, attrs: list[str], name: str, result: list[str]) -> int:
        shut = min(self.close.get(opening, end), end - 1)
        types = self.parameters(opening + 1, shut, owner)
        signature = " ".join(self.src[self.t[mods].start : self.t[shut].end].split())
        k = self.skip_to(shut + 1, end, "{", "=>", ";")
        if self.is_(shut + 1, ":"):
            self.expression(shut + 2, k, owner)
        if self.is_(k, "{"):
            last = min(self.close.get(k, end), end)
            self.statements(k + 1, last, owner)
        else:
            last = self.skip_to(k, end, ";")
            self.expression(k, last, owner)
        last = min(last, self.n - 1)
        owner.members += 1
        owner.methods.append(
            Method(name, self.t[start].line, self.t[last].end_line, self.branches(start, last), attrs, sorted({*result, *types}), signature)
        )
        return last + 1

    def top(self, i: int, end: int) -> int:
        """A statement outside of types."""
        stop = self.skip_to(i, end, ";", "{")
        if self.is_(stop, "{"):
            shut = min(self.close.get(stop, end), end)
            self.expression(i, stop, None)
            self.statements(stop + 1, shut, None)
            return shut + 1
        self.statements(i, stop, None)
        return stop + 1

    # ------------------------------------------------------------ bodies

    def statements(self, i: int, end: int, owner: Type | None) -> None:
        self.declared(i, end, owner)
        self.expression(i, end, owner)

    def declared(self, i: int, end: int, owner: Type | None) -> None:
        """A local declaration at the start of a statement: its type, and a local function's parameters."""
        while self.is_(i, "using", "const", "await", "static", "async", "unsafe", "ref", "readonly") and not self.is_(i + 1, "("):
            i += 1
        got = self.type_at(i, end) if i < end else None
        if not got or got[0] >= end or self.t[got[0]].kind != "id" or self.t[got[0]].text in NOT_TYPES:
            return
        k = got[0] + 1
        if self.is_(k, "=", ";", ",") or k == end:
            self.refer(got[1], owner)
        elif self.is_(k, "<", "("):
            if self.is_(k, "<"):
                args = self.type_args(k, end)
                k = args[0] if args else end
            if self.is_(k, "(") and self.is_(self.skip_to(self.close.get(k, end) + 1, end, "{", "=>", ";"), "{", "=>"):
                self.parameters(k + 1, self.close[k], owner)

    def expression(self, i: int, end: int, owner: Type | None) -> None:
        """Types in what is created, cast, tested and asked for, and local declarations in the blocks of a range."""
        while i < end:
            t = self.t[i]
            if t.kind == "op":
                if t.text in ("{", "}", ";") and i + 1 < end:
                    self.declared(i + 1, end, owner)
                elif t.text == "(":
                    if i and self.is_(i - 1, "for", "using", "fixed"):
                        self.declared(i + 1, self.close.get(i, end), owner)
                    self.cast(i, end, owner)
            elif t.kind == "id":
                if t.text == "new" and (got := self.type_at(i + 1, end)):
                    if not self.is_(got[0], "[") and not self.is_(got[0] - 1, "]"):
                        self.refer(got[1], owner)
                elif t.text == "typeof" and self.is_(i + 1, "(") and (got := self.type_at(i + 2, end)):
                    self.refer(got[1], owner)
                elif t.text in ("as", "is") and i and not self.is_(i - 1, "(", ",", "=", "{", ";") and (got := self.type_at(i + 1, end)):
                    designated = got[0] < end and self.t[got[0]].kind == "id" and self.t[got[0]].text not in NOT_TYPES
                    if t.text == "as" or not (designated or self.is_(got[0], "{", "(")):
                        self.refer(got[1], owner)
            i += 1

    def cast(self, i: int, end: int, owner: Type | None) -> None:
        shut = self.close.get(i, end)
        if i and (self.t[i - 1].kind in ("num", "str", "chr") or self.is_(i - 1, ")", "]", ">") or (self.t[i - 1].kind == "id" and self.t[i - 1].text not in ("return", "await", "in", "throw", "else", "case", "when", "and", "or", "not"))):
            return
        got = self.type_at(i + 1, shut)
        if not got or got[0] != shut or shut + 1 >= end:
            return
        after = self.t[shut + 1]
        word = after.kind in ("num", "str", "chr") or (after.kind == "id" and after.text not in ("is", "as", "in", "and", "or", "when", "switch", "with"))
        if word or (after.text in ("!", "~")) or (after.text == "(" and self.t[i + 1].text[:1].isupper()):
            self.refer(got[1], owner)

    def branches(self, i: int, end: int) -> int:
        """Branches in a range: if, while, do, for, foreach, case, catch, conditional operators and when clauses."""
        count, skip = 0, set()
        k = i
        while k < min(end + 1, self.n):
            t = self.t[k]
            if t.kind == "id" and not self.is_(k - 1, ".", "?."):
                if t.text in BRANCHES:
                    count += k not in skip
                    if t.text == "do":
                        after = self.close.get(k + 1, k) + 1 if self.is_(k + 1, "{") else self.skip_to(k + 1, end, "while")
                        skip.add(after)
                elif t.text == "case":
                    count += not self.is_(k - 1, "goto")
                elif t.text == "when":
                    back = k - 1
                    caught = self.is_(back, ")") and self.is_(self._open(back) - 1, "catch")
                    named = self.is_(k + 1, "=", ";", ",", ")", ".", "in")
                    count += not caught and not named and not self.is_(back, "catch") and (self.t[back].kind != "op" or self.is_(back, ")", "}", "]", ">"))
            elif t.kind == "op" and t.text == "?" and self.ternary(k, end):
                count += 1
            k += 1
        return count

    def _open(self, shut: int) -> int:
        return next((a for a, b in self.close.items() if b == shut and self.t[a].text == "("), 0)

    def ternary(self, i: int, end: int) -> bool:
        open_, k = 1, i + 1
        while k <= min(end, self.n - 1):
            if self.is_(k, ";", ",", ")", "]", "}"):
                return False
            if self.is_(k, "?"):
                open_ += 1
            elif self.is_(k, ":"):
                open_ -= 1
                if not open_:
                    return True
            k = self.close[k] + 1 if k in self.close else k + 1
        return False


def signatures(src: str) -> dict[int, str]:
    """The signature of the method that starts on a line, with its attributes, without them."""
    return {m.line_start: m.signature for t in parse(src).types for m in t.methods}
