"""What C++ and Java files declare: namespaces, packages, classes and the like, functions and methods.

A lexer finds the tokens, comments and literals aside; brackets are matched once. Then one walk over the tokens keeps a stack of
the open scopes and looks, at each ``;`` and ``{``, at what stands before it. Bodies of functions are passed over, and so
are initial values, so what they hold is never taken for a declaration. A file whose brackets or literals do not end is partial:
what can be read of it is given.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, replace

_COMMON = r"""(?P<skip>//[^\n]*|/\*.*?\*/)|(?P<open>/\*.*)"""
_TAIL = r"""|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<sign>::|->|[-+*/%^&|~!=<>]=|.)|(?P<space>\s+)"""
LEXERS = {
    "cpp": re.compile(_COMMON + r"""|(?P<line>(?m:^)[ \t]*\#(?:\\\n|[^\n])*)|(?P<raw>R"(?P<mark>[^()\\\s"]{0,16})\(.*?\)(?P=mark)")""" + _TAIL, re.S),
    "java": re.compile(_COMMON + r'''|(?P<raw>""".*?""")''' + _TAIL, re.S),
}
#: Words before a bracket that make it no list of parameters, and words that begin what is no declaration of a function.
NO_NAME = {"if", "for", "while", "switch", "catch", "return", "sizeof", "decltype", "alignas", "noexcept", "throw", "throws", "static_assert", "requires", "explicit", "new", "delete", "__attribute__", "__declspec", "synchronized", "assert"}
NO_HEAD = {"using", "typedef", "return", "throw", "goto", "new", "delete", "case", "else", "import", "co_return"}
COMMENT_LINE = re.compile(r"\s*(?://|/\*|\*|#)")
KINDS = {"cpp": {"class", "struct", "enum", "union", "namespace"}, "java": {"class", "interface", "enum", "record"}}
AGGREGATES = {"class", "struct", "interface", "enum", "namespace", "package"}


@dataclass(frozen=True)
class Symbol:
    symbol_type: str
    name: str
    qualified_name: str
    parent: str | None
    signature: str
    line_start: int
    line_end: int
    comment: str
    start: int
    end: int
    has_body: bool
    overloaded: bool = False

    @property
    def aggregate(self) -> bool:
        return self.symbol_type in AGGREGATES


@dataclass
class Scope:
    kind: str  # of the symbol that it belongs to; "" where it adds nothing to names
    qualified: str | None
    end: int
    constants: bool = False  # an enum's list of them, up to the first semicolon


class Source:
    """The tokens of a file, and the token that closes each bracket."""

    def __init__(self, language: str, text: str):
        self.text, self.partial = text, False
        self.tokens: list[tuple[str, str, int, int]] = []
        for m in LEXERS[language].finditer(text):
            kind = m.lastgroup if m.lastgroup != "mark" else "raw"
            if kind in ("skip", "space", "line") or m[0].isspace():
                continue
            if kind == "open" or kind == "sign" and m[0] in "\"'":
                self.partial = True
                continue
            self.tokens.append(("text" if kind == "raw" else kind, m[0], *m.span()))
        self.close: dict[int, int] = {}
        held: list[int] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for i, (_, t, _, _) in enumerate(self.tokens):
            if t in ("(", "[", "{"):
                held.append(i)
            elif t in pairs:
                if held and self.tokens[held[-1]][1] == pairs[t]:
                    self.close[held.pop()] = i
                else:
                    self.partial = True
        for i in held:
            self.close[i], self.partial = len(self.tokens), True
        self.feeds = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_right(self.feeds, at - 1) + 1

    def word(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "word"

    def after_angles(self, i: int) -> int:
        """Behind the closing angle that belongs to the one at i; behind i itself if there is none before the head ends."""
        depth, j = 0, i
        while j < len(self.tokens):
            t = self.word(j)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j + 1
            if t in (";", "{"):
                break
            j = self.close.get(j, j) + 1
        return i + 1

    def before_angles(self, i: int) -> int:
        """The opening angle that belongs to the closing one at i, or i."""
        depth = 0
        for j in range(i, max(i - 200, -1), -1):
            depth += (self.word(j) == ">") - (self.word(j) == "<")
            if depth == 0:
                return j
        return i

    def raw(self, i: int, j: int) -> str:
        """The text from token i up to token j, j itself aside."""
        return self.text[self.tokens[i][2] : self.tokens[j - 1][3]] if i < j else ""


def _flat(s: Source, a: int, z: int) -> list[int]:
    """Tokens of a head that lie in no bracket; opening round ones are among them."""
    out, i = [], a
    while i < z:
        out.append(i)
        i = s.close.get(i, i) + 1
    return out


def _type_head(s: Source, language: str, flat: list[int], z: int) -> tuple[str, str, int] | None:
    """(kind, name, first token) if a head names a class, namespace or the like, and is not a function that returns one."""
    for p, i in enumerate(flat):
        t = s.word(i)
        if t in ("(", "=") and not (p and s.word(flat[p - 1]) in ("alignas", "__attribute__", "__declspec") or language == "java" and p >= 2 and s.word(flat[p - 2]) == "@"):
            return None
        if t == "<":
            return None  # in a list of template arguments, or a type with some
        if s.is_word(i) and t in KINDS[language] and not (language == "java" and p and s.word(flat[p - 1]) in (".", "@")):
            break
    else:
        return None
    kind, names, first = s.word(i), [], i
    rest = [j for j in flat[p + 1 :] if s.word(j) not in ("[", "alignas", "__attribute__", "__declspec") and not (s.word(j) == "(" and s.word(j - 1) in ("alignas", "__attribute__", "__declspec"))]
    if kind == "enum" and rest and s.word(rest[0]) in ("class", "struct"):
        rest = rest[1:]
    if kind == "namespace":
        at = [j for j in rest if s.is_word(j) or s.word(j) == "::"]
        if len(at) < len(rest):
            return None  # an alias
        first = flat[p - 1] if p and s.word(flat[p - 1]) == "inline" else i
        return kind, s.raw(at[0], at[-1] + 1) if at else "", first
    end = 0
    for n, j in enumerate(rest):
        if not s.is_word(j) or s.word(j) in ("final", "extends", "implements", "permits"):
            end = n
            break
        names.append(j)
        end = n + 1
    if not names:
        return ("", "", i) if kind != "record" or language == "cpp" else None
    last, name = rest[end] if end < len(rest) else None, s.word(names[-1])
    if language == "java":
        return ("" if kind == "record" else kind), s.word(names[0]), i
    if last is not None and s.word(last) == "<":
        behind = s.after_angles(last)
        name, end = s.raw(names[-1], behind), next((n for n, j in enumerate(rest) if j >= behind), len(rest))
        last = rest[end] if end < len(rest) else None
    if last is not None and s.word(last) not in (":", "final"):
        return None  # a variable, pointer or function of that type
    if len(names) > 1 and last is None and s.word(z) == ";":
        return None  # struct A x;
    return ("" if kind == "union" else kind), name, i


def _function_head(s: Source, language: str, flat: list[int], scope: Scope, ends: str) -> tuple[str, str | None] | None:
    """(name, qualifier) if a head declares a function."""
    words = [s.word(i) for i in flat]
    if not flat or words[0] in NO_HEAD:
        return None
    if "operator" in words and language == "cpp":
        p = words.index("operator")
        q = next((q for q in range(p + 1, len(words)) if words[q] == "("), None)
        if q == p + 1:  # operator()
            second = next((r for r in range(q + 1, len(words)) if words[r] == "("), None)
            if second is None:
                return None
            name, first = s.raw(flat[p], s.close[flat[q]] + 1), p
        elif q is None:
            return None
        else:
            name, first = s.raw(flat[p], flat[q]), p
    else:
        p = next((p for p, t in enumerate(words) if t == "(" and p and s.word(flat[p] - 1) not in NO_NAME and not (language == "java" and p >= 2 and "@" in words[max(0, p - 2) : p])), None)
        if p is None or "=" in words[:p]:
            return None
        first = p - 1
        if language == "cpp" and words[first] == ">":
            opening = s.before_angles(flat[first])
            first = next((n for n, i in enumerate(flat) if i == opening - 1), -1)
        if first < 0 or not s.is_word(flat[first]):
            return None
        name = s.raw(flat[first], flat[p])
        if first and words[first - 1] == "~":
            name, first = "~" + name, first - 1
    qualifier, start = None, first
    while start >= 2 and words[start - 1] == "::":
        before = start - 2
        if words[before] == ">":
            opening = s.before_angles(flat[before])
            before = next((n for n, i in enumerate(flat) if i == opening - 1), before)
        if not s.is_word(flat[before]):
            break
        start = before
    if start < first:
        qualifier = s.raw(flat[start], flat[first - 1]).strip()
    own = (scope.qualified or "").rpartition("::")[2] if scope.kind in ("class", "struct", "interface", "enum") else None
    typed = start > 0 and any(s.is_word(i) or s.word(i) == ">" for i in flat[:start]) or name.startswith(("~", "operator"))
    bare = name.partition("<")[0]
    if ends == ";":
        opening = next(i for i in flat if s.word(i) == "(" and i > flat[first])
        inside = s.tokens[opening + 1] if opening + 1 < len(s.tokens) else ("", "", 0, 0)
        if not typed and bare != own and qualifier is None:
            return None  # a call
        if language == "cpp" and inside[0] in ("number", "text"):
            return None  # a variable with an initial value
    elif language == "java" and not typed and bare != own:
        return None
    return name, qualifier


def _known_classes(symbols: list[Symbol]) -> set[str]:
    return {x.qualified_name for x in symbols if x.symbol_type in ("class", "struct")}


def scan(language: str, text: str) -> tuple[list[Symbol], bool]:
    """(symbols in order of their place, whether the file could only be read in part) of a C++ (``cpp``) or Java file.

    A function that is declared or defined under a qualified name is a method if the file declares that class. Of equal
    symbols of one name the first one with a body stays, else the first.
    """
    s = Source(language, text)
    out: list[Symbol] = []
    loose: list[int] = []  # functions under a qualified name
    scopes = [Scope("", None, len(s.tokens))]
    package = ""
    lines = text.split("\n")

    def add(kind: str, name: str, first: int, body: int | None, last: int, qualifier: str | None = None) -> str:
        """The symbol between two tokens; gives its qualified name."""
        up = scopes[-1].qualified
        qualified = f"{qualifier}::{name}" if qualifier else f"{up}::{name}" if up else name
        start, end = s.tokens[first][2], s.tokens[min(last, len(s.tokens) - 1)][3]
        row = s.line(start) - 1
        above = row
        while above > 0 and COMMENT_LINE.match(lines[above - 1]):
            above -= 1
        signature = text[start : s.tokens[body][2] if body is not None else end].strip()
        if qualifier:
            loose.append(len(out))
        out.append(Symbol(kind, name, qualified, qualifier or up, signature, above + 1, max(row + 1, s.line(end)), "\n".join(lines[above:row]).strip(), start, end, body is not None))
        return qualified

    i = head = 0
    round_seen = equal_at = -1  # the last opening round bracket and sign of a value
    colon = False  # behind the parameters of a constructor, members are set
    while i < len(s.tokens):
        scope, t = scopes[-1], s.word(i)
        if i == scope.end:
            scopes.pop()
            i, head, colon = i + 1, i + 1, False
        elif t in ("(", "["):
            round_seen = max(round_seen, i) if t == "(" else round_seen
            i = s.close[i] + 1
        elif t == "template" and s.word(i + 1) == "<":
            i = head = s.after_angles(i + 1)
        elif t == "friend" and i == head or t == "extern" and s.tokens[i + 1 : i + 2] and s.tokens[i + 1][0] == "text":
            i = head = i + 1 + (t == "extern")
            if t == "extern" and s.word(i) == "{":
                scopes.append(Scope("", scope.qualified, s.close[i]))
                i = head = i + 1
        elif t == ":" and language == "cpp" and head < i and s.word(head) in ("public", "private", "protected") and i - head <= 2:
            i = head = i + 1
        elif t == ":" and round_seen >= head:
            i, colon = i + 1, True
        elif t == "}":
            i = head = i + 1
        elif t == ";":
            if scope.constants:
                scope.constants = False
            else:
                flat = _flat(s, head, i)
                if language == "java" and flat and s.word(flat[0]) == "package":
                    if named_package := s.raw(head + 1, i).strip():
                        package = named_package
                        add("package", package, head, None, i)
                elif flat and not (named := _type_head(s, language, flat, i)) and (f := _function_head(s, language, flat, scope, ";")):
                    add("method" if language == "java" or scope.kind in ("class", "struct") else "function", f[0], head, None, i, f[1])
                elif flat and named and named[0] not in ("", "namespace") and named[1] and language == "cpp":
                    add(named[0], named[1], named[2], None, i - 1)
            i, head, colon = i + 1, i + 1, False
        elif t == "{":
            end = s.close[i]
            value = scope.constants or equal_at >= head or colon and (s.is_word(i - 1) or s.word(i - 1) == ">")
            flat = [] if value else _flat(s, head, i)
            words = [s.word(j) for j in flat]
            if value:
                i = end + 1
            elif named := _type_head(s, language, flat, i):
                kind, name, first = named
                inner = add(kind, name, head if language == "java" else first, i, end) if kind and name else scope.qualified
                scopes.append(Scope(kind or scope.kind, inner, end, language == "java" and kind == "enum"))
                i = head = i + 1
            elif f := _function_head(s, language, flat, scope, "{"):
                add("method" if language == "java" or scope.kind in ("class", "struct") else "function", f[0], head, i, end, f[1])
                i, head, colon = end + 1, end + 1, False
            elif language == "cpp" and flat and "(" not in words and s.word(end + 1) in (",", ";"):
                i, equal_at = end + 1, i  # a variable with an initial value; others may follow
            else:
                i, head, colon = end + 1, end + 1, False
        else:
            equal_at = i if t == "=" and s.word(i - 1) != "operator" else equal_at
            i += 1
    known = _known_classes(out)
    for n in loose:
        x = out[n]
        if x.symbol_type == "method" or x.parent in known:
            out[n] = replace(x, symbol_type="method")
        else:
            out[n] = replace(x, parent=x.parent.rpartition("::")[0] or None)
    if package:
        out = [x if x.symbol_type == "package" else replace(x, qualified_name=f"{package}::{x.qualified_name}", parent=f"{package}::{x.parent}" if x.parent else package) for x in out]
    return _distinct(out), s.partial


def plain_signature(signature: str) -> str:
    """A signature without qualifiers of the name, names of parameters and white space: what makes two symbols one."""
    bare = re.sub(r"\b(?:[A-Za-z_]\w*::)+(?=[~A-Za-z_]\w*\s*\()", "", signature)
    return re.sub(r"\s+", "", re.sub(r"\s+[A-Za-z_]\w*(?=[,)])", "", bare)).rstrip(";")


def _distinct(symbols: list[Symbol]) -> list[Symbol]:
    kept: dict[tuple[str, str], Symbol] = {}
    for x in symbols:
        k = x.qualified_name, plain_signature(x.signature)
        if k not in kept or x.has_body > kept[k].has_body:
            kept[k] = x
    many = Counter(x.qualified_name for x in kept.values())
    found = sorted(kept.values(), key=lambda x: (x.start, x.end, x.qualified_name))
    return [replace(x, overloaded=many[x.qualified_name] > 1) for x in found]
