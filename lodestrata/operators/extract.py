"""Facts from source code: definitions, calls, imports, bases, sizes and complexity.

Python files go through the standard library's parser. Other languages are taken apart into words,
strings and marks, without comments, and read by what stands next to what: a name before a bracket is
a definition, a declaration, an instance or a call. Brackets are paired once and every step moves
forward, so time is linear in a file's length. Code is read, never run.

Cases: null and empty texts and unknown extensions have no facts; Python code that doesn't parse has
one ``syntax-error``; a null path has no extension; repeated rows give repeated facts; other columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import ast
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "path string, fact string, name string, detail string, line long, value long"
LANGUAGES = {".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".java": "java", ".kt": "kotlin", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "c"}

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r"\"(?:[^\"\\\n]+|\\.)*+(?:\"|(?=\n)|\Z)", r"'(?:[^'\\\n]+|\\.)*+(?:'|(?=\n)|\Z)"
_NOISE = {
    "js": [_LINE, _BLOCK],
    "java": [_LINE, _BLOCK],
    "kotlin": [_LINE, _BLOCK],
    "go": [_LINE, _BLOCK],
    "rust": [_LINE, _BLOCK, r"#!?\[[^\]]*\]", r"'[A-Za-z_]\w*(?!')"],
    "c": [r"^[ \t]*#[ \t]*if[ \t]+0\b.*?(?:^[ \t]*#[ \t]*endif\b[^\n]*|\Z)", r"^[ \t]*#(?![ \t]*include\b)(?:[^\n\\/]+|/(?![*])|\\(?:\r?\n|.))*+", _LINE, _BLOCK],
}
_STRINGS = {
    "js": [_DOUBLE, _SINGLE, r"`(?:[^`\\]+|\\.)*+(?:`|\Z)"],
    "java": [r'""".*?(?:"""|\Z)', _DOUBLE, _SINGLE],
    "kotlin": [r'""".*?(?:"""|\Z)', _DOUBLE, _SINGLE],
    "go": [_DOUBLE, _SINGLE, r"`[^`]*(?:`|\Z)"],
    "rust": [r'r(?P<raw>#*)".*?(?:"(?P=raw)|\Z)', r"\"(?:[^\"\\]+|\\.)*+(?:\"|\Z)", r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"],
    "c": [_DOUBLE, _SINGLE],
}
_WORD = r"(?P<include>^[ \t]*#[ \t]*include[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"))|(?P<string>{strings})|(?P<noise>{noise})|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>\d[\w.]*|::|->|=>|\?\.|\?\?|&&|\|\||[^\s\w])"
LEXERS = {x: re.compile(_WORD.format(strings="|".join(_STRINGS[x]), noise="|".join(_NOISE[x])), re.S | re.M) for x in _NOISE}
_LOOSE = {x: re.compile("|".join(f"(?:{p})" for p in [*_STRINGS[x], *_NOISE[x]]), re.S | re.M) for x in _NOISE}

#: Words before a bracket that make no call, by language.
KEYWORDS = {
    "js": frozenset("if for while switch catch return typeof delete function class import export throw do else with in of try case default break continue yield await async var let const super instanceof void".split()),
    "java": frozenset("if for while switch catch return synchronized try do else case default break continue throw throws new super instanceof assert class enum interface import package".split()),
    "kotlin": frozenset("if for while when catch return try do else throw super in is as fun class object interface import package constructor init get set".split()),
    "go": frozenset("if for switch select return func go defer range case default break continue import package type struct interface map chan var const else fallthrough goto".split()),
    "rust": frozenset("if for while loop match return fn let mut ref move in as use mod impl trait struct enum where else break continue unsafe async await dyn pub type const static".split()),
    "c": frozenset("if for while switch catch return sizeof delete new do else case default throw static_cast dynamic_cast const_cast reinterpret_cast decltype typeid using template alignof noexcept static_assert defined operator requires goto".split()),
}
#: Words of which one before a name makes it a statement, not a declaration.
STATEMENTS = frozenset("return else throw case goto do new delete await yield in of typeof instanceof assert break continue default co_return if while for switch".split())
#: Traits of the standard library, which are no bases.
STANDARD_TRAITS = frozenset(
    "Sized Send Sync Unpin Copy Clone Debug Display Default Eq PartialEq Ord PartialOrd Hash Into From TryFrom TryInto Iterator AsRef AsMut Deref DerefMut Drop Error ToString FromStr".split()
)
#: Branches of a function's complexity, by language.
BRANCHES = {
    "js": frozenset("if for while switch case catch when".split()),
    "java": frozenset("if for while switch case catch when".split()),
    "kotlin": frozenset("if for while switch case catch when".split()),
    "go": frozenset("if for switch case select".split()),
    "rust": frozenset("if for while loop match case".split()),
    "c": frozenset("if for while switch do catch case".split()),
}
JOINS = (".", "::", "->", "?.")
OPEN, CLOSE = "([{", {")": "(", "]": "[", "}": "{"}


@dataclass
class Definition:
    name: str
    at: int  # of its name's token
    kind: str  # function or class
    first: int = -1  # tokens of the body's brackets, or -1
    last: int = -1
    parameters: list[str] = field(default_factory=list)


class Tokens:
    """A text's words, strings and marks, with paired brackets."""

    def __init__(self, text: str, language: str):
        self.language, self.words, self.at, self.kinds = language, [], [], []
        for m in LEXERS[language].finditer(text):
            if m.lastgroup != "noise" and m.lastgroup is not None:
                self.words.append(m[0])
                self.at.append(m.start())
                self.kinds.append("string" if m.lastgroup == "raw" or m["string"] else m.lastgroup)
        self.lines = [m.start() for m in re.finditer("\n", text)]
        n = len(self.words)
        self.pair, open_ = [-1] * n, []
        for i, w in enumerate(self.words):
            if self.kinds[i] != "mark":
                continue
            if w in OPEN:
                open_.append(i)
            elif w in CLOSE:
                # a bracket that is never closed doesn't hide the ones around it
                while open_ and self.words[open_[-1]] != CLOSE[w]:
                    open_.pop()
                if open_:
                    self.pair[i], self.pair[open_[-1]] = open_[-1], i
                    open_.pop()

        #: for each place, the next { ; } or = that isn't in brackets
        self.stop = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            w = self.words[i] if self.kinds[i] == "mark" else ""
            self.stop[i] = i if w in ("{", ";", "}", "=") else self.stop[self.pair[i] + 1] if w in ("(", "[") and self.pair[i] > i else self.stop[i + 1]

    def __len__(self) -> int:
        return len(self.words)

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) and self.kinds[i] != "string" else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.words) and self.kinds[i] == "word"

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.at[i]) + 1 if 0 <= i < len(self.at) else len(self.lines) + 1

    def after(self, i: int) -> int:
        """What follows the pair that opens at i."""
        return self.pair[i] + 1 if 0 <= i < len(self.pair) and self.pair[i] > i else len(self.words)

    def past_generics(self, i: int) -> int:
        """What follows <...> at i, where that reads as type parameters, else i."""
        if self.word(i) != "<":
            return i
        depth = 0
        for k in range(i, min(i + 200, len(self.words))):
            w = self.word(k)
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif w in (";", "{", "}", "&&", "||"):
                return i
        return i

    def chain(self, i: int) -> tuple[str, int]:
        """The dotted name that ends at i, and the token before it."""
        parts, p = [self.words[i]], i - 1
        while self.word(p) in JOINS and self.named(p - 1):
            if self.words[p] == "->":
                break
            parts.append(self.words[p - 1])
            p -= 2
        return ".".join(parts[::-1]), p

    def chain_from(self, i: int, join: str = ".") -> tuple[str, int]:
        """The dotted name that begins at i, and what follows it and its type parameters."""
        parts = []
        while self.named(i):
            parts.append(self.words[i])
            i = self.past_generics(i + 1)
            if self.word(i) not in (".", "::"):
                break
            i += 1
        return join.join(parts), i


def _names(t: Tokens, open_: int) -> list[str]:
    """Names of the parameters between brackets: one for each part between commas."""
    end, out, at, depth, own = t.pair[open_], [], open_ + 1, 0, []
    if end < 0:
        return []
    while at <= end:
        w = t.word(at)
        if at == end or w == "," and not depth:
            if own:
                words = [t.words[i] for i in own if t.named(i)]
                stop = next((k for k, i in enumerate(own) if t.word(i) in (":", "=")), len(own))
                head = [t.words[i] for i in own[:stop] if t.named(i)]
                first = t.language in ("js", "kotlin", "go", "rust")
                out.append((head[0] if first and t.language != "rust" else head[-1]) if head else words[0] if words else "")
            own = []
        else:
            own.append(at)
            depth += (w in ("<", "(", "[", "{")) - (w in (">", ")", "]", "}"))
        at += 1
    return [] if out == ["void"] else out


def _finish(t: Tokens, d: Definition, brace: int) -> Definition:
    if t.word(brace) == "{" and t.pair[brace] > brace:
        d.first, d.last = brace, t.pair[brace]
    return d


class Reader:
    """Definitions, calls, instances, bases and imports of one file."""

    def __init__(self, text: str, language: str):
        self.t = Tokens(text, language)
        self.language = language
        self.definitions: list[Definition] = []
        self.imports: list[tuple[str, int]] = []
        self.bases: list[tuple[str, int, str]] = []
        self.calls: list[tuple[str, int]] = []
        self.instances: list[tuple[str, int]] = []
        #: names that are neither called nor defined: declarations, annotations, initialisers
        self.silent: set[int] = set()
        self._heads()
        self._brackets()

    def _heads(self) -> None:
        """What keywords introduce."""
        t, reader = self.t, getattr(self, f"_head_{self.language}")
        for i, kind in enumerate(t.kinds):
            if kind == "include":
                self.imports.append((re.search(r"[<\"]([^>\"]+)", t.words[i])[1], i))
            elif kind == "word" and t.word(i - 1) not in (".", "?."):
                reader(i, t.words[i])

    def _class(self, i: int, brace: int | None = None) -> None:
        d = Definition(self.t.words[i], i, "class")
        self.silent.add(i)
        self.definitions.append(_finish(self.t, d, brace if brace is not None else -1))

    def _function(self, i: int, open_: int, brace: int = -1) -> None:
        d = Definition(self.t.words[i], i, "function", parameters=_names(self.t, open_) if self.t.word(open_) == "(" else [])
        if self.t.word(i - 1) == "~":
            d.name = "~" + d.name
        self.silent.add(i)
        self.definitions.append(_finish(self.t, d, brace))

    def _text(self, i: int) -> str:
        return self.t.words[i].strip("\"'`")

    def _next_brace(self, i: int) -> int:
        """The next { before a ; or }, past brackets."""
        k = self.t.stop[min(i, len(self.t))]
        return k if self.t.word(k) == "{" else -1

    def _head_js(self, i: int, w: str) -> None:
        t = self.t
        if w in ("import", "export"):
            if w == "import" and t.kinds[i + 1 : i + 2] == ["string"]:
                self.imports.append((self._text(i + 1), i + 1))
            elif w == "import" and t.word(i + 1) == "(" and t.kinds[i + 2 : i + 3] == ["string"]:
                self.imports.append((self._text(i + 2), i + 2))
            else:
                for k in range(i + 1, min(i + 400, len(t) - 1)):
                    if t.word(k) in (";", "=", "("):
                        break
                    if t.word(k) == "from" and t.kinds[k + 1] == "string":
                        self.imports.append((self._text(k + 1), k + 1))
                        break
        elif w == "require" and t.word(i + 1) == "(" and t.kinds[i + 2 : i + 3] == ["string"]:
            self.imports.append((self._text(i + 2), i + 2))
        elif w == "class" and t.named(i + 1) and t.word(i + 1) != "extends":
            self._class(i + 1, self._next_brace(i + 2))
            k = t.past_generics(i + 2)
            if t.word(k) == "extends" and t.named(k + 1):
                self.bases.append((t.chain_from(k + 1)[0], k + 1, t.words[i + 1]))
        elif w == "function":
            k = i + 1 + (t.word(i + 1) == "*")
            if t.named(k):
                p = t.past_generics(k + 1)
                self._function(k, p, self._next_brace(t.after(p)) if t.word(p) == "(" else -1)
        elif w in ("const", "let", "var") and t.named(i + 1):
            k = i + 2
            while t.word(k) not in ("=", ";", "", ",") and k < i + 40:
                k += 1
            if t.word(k) == "=":
                k += 1 + (t.word(k + 1) == "async")
                arrow = t.after(k) if t.word(k) == "(" else k + 1
                if t.word(arrow) == ":":
                    while t.word(arrow) not in ("=>", ";", "{", "") and arrow < k + 200:
                        arrow += 1
                if t.word(arrow) == "=>" and (t.word(k) == "(" or t.named(k)):
                    self._function(i + 1, k, arrow + 1)
                    self.definitions[-1].parameters = self.definitions[-1].parameters or [t.words[k]] * t.named(k)
                elif t.word(k) == "function":
                    p = k + 1 + t.named(k + 1)
                    self._function(i + 1, p, self._next_brace(t.after(p)))

    def _types(self, k: int, of: str, drop: tuple[str, ...] = ()) -> int:
        """Names between commas, as bases."""
        t = self.t
        while t.named(k):
            name, after = t.chain_from(k)
            if name not in drop:
                self.bases.append((name, k, of))
            self.silent.add(after - 1 if t.word(after - 1) != ">" else k)
            k = after
            if t.word(k) == "(":
                self.silent.update(range(k - 1, k))
                k = t.after(k)
            if t.word(k) != ",":
                break
            k += 1
        return k

    def _head_java(self, i: int, w: str) -> None:
        t = self.t
        if w == "import":
            k = i + 1 + (t.word(i + 1) == "static")
            name, after = t.chain_from(k)
            if name:
                self.imports.append((name + ".*" * (t.word(after) == "*"), k))
        elif w in ("class", "interface", "enum", "record") and t.named(i + 1):
            k = t.past_generics(i + 2)
            k = t.after(k) if t.word(k) == "(" else k
            for word in ("extends", "implements", "extends"):
                if t.word(k) == word:
                    k = self._types(k + 1, t.words[i + 1], ("Object",))
            self._class(i + 1, self._next_brace(k))

    def _head_kotlin(self, i: int, w: str) -> None:
        t = self.t
        if w == "import":
            name, _ = t.chain_from(i + 1)
            if name:
                self.imports.append((name, i + 1))
        elif w in ("class", "interface", "object") and t.named(i + 1):
            k = t.past_generics(i + 2)
            while t.word(k) in ("private", "public", "protected", "internal", "constructor"):
                k += 1
            k = t.after(k) if t.word(k) == "(" else k
            if t.word(k) == ":":
                k = self._types(k + 1, t.words[i + 1], ("Any",))
            self._class(i + 1, k if t.word(k) == "{" else -1)
        elif w == "fun":
            k = t.past_generics(i + 1)
            name, after = t.chain_from(k)
            if name and t.word(after) == "(":
                end = after - 1
                while not t.named(end):
                    end -= 1
                self._function(end, after, self._next_brace(t.after(after)))
        elif w in ("val", "var") and t.named(i + 1):
            k = i + 2
            while t.word(k) not in ("=", ";", "", ",", ")", "{") and t.line(k) == t.line(i):
                k += 1
            if t.word(k) == "=" and (t.word(k + 1) in ("{", "fun") or t.word(k + 1) == "(" and t.word(t.after(k + 1)) == "->"):
                self._function(i + 1, k + 1, k + 1)

    def _head_go(self, i: int, w: str) -> None:
        t = self.t
        first = lambda k: self._text(k).split("/")[0]
        if w == "import":
            if t.word(i + 1) == "(":
                self.imports += [(first(k), k) for k in range(i + 2, t.after(i + 1) - 1) if t.kinds[k] == "string"]
            else:
                k = i + 1 + (t.kinds[i + 1 : i + 2] != ["string"])
                if t.kinds[k : k + 1] == ["string"]:
                    self.imports.append((first(k), k))
        elif w == "func":
            k = t.after(i + 1) if t.word(i + 1) == "(" else i + 1
            if t.named(k):
                p = t.after(k + 1) if t.word(k + 1) == "[" else k + 1
                if t.word(p) == "(":
                    self._function(k, p, self._next_brace(t.after(p)))
        elif w == "type" and t.named(i + 1) and t.word(i + 2) in ("struct", "interface"):
            brace, kind = i + 3, t.words[i + 2]
            self._class(i + 1, brace)
            k, end = brace + 1, t.after(brace) - 1
            while k < end:
                line = t.line(k)
                stop = k
                while stop < end and t.line(stop) == line and t.word(stop) != ";":
                    stop += 1
                start = k + (t.word(k) == "*")
                name, after = t.chain_from(start)
                if kind == "struct" and name and after >= stop and name != "error":
                    self.bases.append((name, start, t.words[i + 1]))
                elif kind == "interface" and t.named(k):
                    self.silent.add(k)
                k = max(stop, k + 1)

    def _head_rust(self, i: int, w: str) -> None:
        t = self.t
        if w == "use":
            parts, k = [], i + 1
            while t.named(k) and t.words[k] != "as":
                parts.append(t.words[k])
                k += 1
                if t.word(k) != "::":
                    break
                k += 1
            if parts and parts[0] not in ("crate", "self", "super"):
                self.imports.append(("::".join(parts), i + 1))
        elif w == "fn" and t.named(i + 1):
            p = t.past_generics(i + 2)
            self._function(i + 1, p, self._next_brace(t.after(p)))
        elif w in ("struct", "enum", "trait") and t.named(i + 1):
            k = t.past_generics(i + 2)
            if w == "trait" and t.word(k) == ":":
                while t.word(k) in (":", "+"):
                    name, after = t.chain_from(k + 1, "::")
                    if name and name not in STANDARD_TRAITS:
                        self.bases.append((name, k + 1, t.words[i + 1]))
                    k = max(after, k + 1)
            self._class(i + 1, self._next_brace(k))

    def _head_c(self, i: int, w: str) -> None:
        t = self.t
        if w in ("class", "struct", "union") and t.named(i + 1):
            k = i + 2 + (t.word(i + 2) == "final")
            k = t.past_generics(k)
            found = []
            if t.word(k) == ":":
                while t.word(k) in (":", ","):
                    k += 1
                    while t.word(k) in ("public", "private", "protected", "virtual"):
                        k += 1
                    name, after = t.chain_from(k, "::")
                    found.append((name, k, t.words[i + 1]))
                    k = max(after, k + 1)
            if t.word(k) == "{":
                self.bases += [x for x in found if x[0]]
                self._class(i + 1, k)

    def _brackets(self) -> None:
        """Names before a bracket."""
        t, words, body_until = self.t, self.t.words, -1
        bodies = {d.first: d.last for d in self.definitions if d.kind == "function" and d.first >= 0}
        for i in range(len(t)):
            if i in bodies:
                body_until = max(body_until, bodies[i])
            if not t.named(i) or i in self.silent:
                continue
            open_ = i + 1
            if self.language == "go" and t.word(open_) == "[":
                open_ = t.after(open_)
            if t.word(open_) != "(" or words[i] in KEYWORDS[self.language]:
                continue
            name, p = t.chain(i)
            before, after = t.word(p), t.after(open_)
            if before == "@" or before == "!" and t.word(p - 1) == "macro_rules" or "operator" in (words[i], before):
                continue
            if getattr(self, f"_defines_{self.language}", lambda *a: False)(i, p, open_, after, i < body_until):
                if self.language == "c" and self.definitions and self.definitions[-1].at == i:
                    body_until = max(body_until, self.definitions[-1].last)
                continue
            if i in self.silent:
                continue
            parts = name.split(".")
            if before == "new" and self.language != "js":
                self.instances.append((name, i))
                continue
            if before == "new":
                self.instances.append((name, i))
            if self.language == "c" and (before == "~" or len(parts[0]) > 1 and parts[0].isupper()):
                continue
            if parts[0] in ("self", "Self", "this", "super", "crate") and len(parts) > 1:
                name = parts[-1]
            if parts[0] in KEYWORDS[self.language]:
                continue
            self.calls.append((name, i))

    def _defines_js(self, i, p, open_, after, inside) -> bool:
        t = self.t
        if p != i - 1 or t.word(p) not in ("", "{", "}", ";", ",", "*", "static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract") and t.line(p) == t.line(i):
            return False
        if t.word(p) in (")", "=", "(", "=>", "&&", "||", "?", ":", "+", "return"):
            return False
        if t.word(after) == ":":  # a result type
            k = after
            while t.word(k) not in ("{", ";", "=", "=>", ",", "") and k < after + 60:
                k = t.after(k) if t.word(k) in ("(", "[") else k + 1
            after = k
        if t.word(after) != "{":
            return False
        self._function(i, open_, after)
        return True

    def _defines_java(self, i, p, open_, after, inside) -> bool:
        t = self.t
        if p != i - 1:
            return False
        before = t.word(p)
        if t.word(after) == "throws":
            while t.word(after) not in ("{", ";", ""):
                after += 1
        end = t.word(after)
        typed = before in (">", "]") or t.named(p) and before not in KEYWORDS["java"] and before not in STATEMENTS
        if end == "{" and (typed or before in ("", "{", "}", ";")) or end == ";" and typed:
            if before == ">" and t.word(p - 1) == "-":
                return False
            self._function(i, open_, after)
            return True
        return False

    def _defines_c(self, i, p, open_, after, inside) -> bool:
        t = self.t
        leaf = t.words[i]
        while t.word(after) in ("const", "volatile", "noexcept", "override", "final", "requires", "&"):
            after += 1
            if t.word(after) == "(":
                after = t.after(after)
        end = t.word(after)
        if end == "->":
            k = after
            while t.word(k) not in ("{", ";", "") and k < after + 30:
                k += 1
            after, end = k, t.word(k)
        before = t.word(p)
        if end == ";" or end == "=" and t.word(after + 1) == "0" and t.word(after + 2) == ";":
            q = p
            while t.word(q) in ("*", "&"):
                q -= 1
            if before == "~" or (t.named(q) or t.word(q) == ">") and t.word(q) not in STATEMENTS and p != i and t.word(i - 1) not in (".", "->"):
                self.silent.add(i)
                return True
            return False
        if inside or len(leaf) > 1 and leaf.isupper() or t.word(i - 1) in (".", "->"):
            return False
        if end == ":":  # initialisers
            k, own = after + 1, []
            while t.named(k):
                _, k = t.chain_from(k)
                own.append(k - 1)
                if t.word(k) not in ("(", "{"):
                    return False
                k = t.after(k)
                if t.word(k) != ",":
                    break
                k += 1
            if t.word(k) != "{":
                return False
            self.silent.update(own)
            after, end = k, "{"
        if end != "{":
            return False
        self._function(i, open_, after)
        return True

    def complexity(self, d: Definition) -> int:
        t, out, branches = self.t, 1, BRANCHES[self.language]
        for i in range(d.at, (d.last if d.first >= 0 else min(d.at + 60, len(t) - 1)) + 1):
            w = t.word(i)
            if d.first < 0 and w in (";", "}"):
                break
            if w in branches or w in ("&&", "||"):
                out += 1
            elif w == "?":
                follows = t.word(i + 1)
                out += follows in (";", ")", "}") if self.language == "rust" else self.language != "go" and follows not in (":", ".", "?", ">", ",")
        return out

    def facts(self) -> Iterator[tuple[str, str, str, int, int]]:
        t = self.t
        for name, i in self.imports:
            yield "import", name, "", t.line(i), 0
        for d in self.definitions:
            first = t.line(d.at)
            yield d.kind, d.name, "", first, (t.line(d.last) - first + 1) if d.first >= 0 else 1
            if d.kind == "function":
                yield "complexity", d.name, "", first, self.complexity(d)
                yield "parameters", d.name, ",".join(d.parameters), first, len(d.parameters)
        for name, i in self.calls:
            yield "call", name, "", t.line(i), 0
        for name, i in self.instances:
            yield "new", name, "", t.line(i), 0
        for name, i, of in self.bases:
            yield "base", name, of, t.line(i), 0


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_complexity(node: ast.AST) -> int:
    """One, and one for each branch, loop, with, try and handler, and each further and/or."""
    steps = ast.If | ast.For | ast.While | ast.With | ast.Try | ast.ExceptHandler
    return 1 + sum(isinstance(n, steps) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


#: What decorators that register a function have in their names.
REGISTERING = ("route", "register", "callback", "handler", "listener", "command", "event", "hook", "middleware", "before_", "after_", "app.", "blueprint", "api.", "task", "job")


def python_facts(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(fact, name, detail, line, value) of Python code."""
    tree = parsed(text)
    if tree is None:
        if text.strip():
            yield "syntax-error", "", "", 1, 0
        return
    owner = {f: c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
    for node in ast.walk(tree):
        line = getattr(node, "lineno", 0)
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name, "", line, 0
                yield "alias", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], line, 0
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            yield "import", module, "", line, node.level
            for a in node.names:
                whole = f"{module}.{a.name}" if node.module else module + a.name
                yield "import", whole, "", line, node.level
                yield "alias", a.asname or a.name, whole, line, node.level
        elif isinstance(node, ast.Call) and (name := _dotted(node.func)):
            yield "call", name, "", line, len(node.args)
        elif isinstance(node, ast.ClassDef):
            yield "class", node.name, "", line, (node.end_lineno or line) - line + 1
            for b in node.bases:
                if (name := _dotted(b)) and name != "object":
                    yield "base", name, node.name, line, 0
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            a = node.args
            names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
            yield "function", node.name, owner.get(node, ""), line, (node.end_lineno or line) - line + 1
            yield "complexity", node.name, owner.get(node, ""), line, python_complexity(node)
            yield "parameters", node.name, ",".join(names), line, len(a.args) + len(a.kwonlyargs)
            for d in node.decorator_list:
                name = _dotted(d.func if isinstance(d, ast.Call) else d) or ""
                if any(k in name.lower() for k in REGISTERING):
                    yield "registered", node.name, name, line, 0
            if any(isinstance(d, ast.List | ast.Dict | ast.Set) for d in a.defaults + [x for x in a.kw_defaults if x]):
                yield "mutable-default", node.name, "", line, 0
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            yield "bare-except", "", "", line, 0
        elif isinstance(node, ast.Assign) and any(isinstance(x, ast.Name) and x.id == "__all__" for x in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            for e in node.value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    yield "export", e.value, "", line, 0
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and re.fullmatch(r"\w{2,64}", node.value):
            yield "string", node.value, "", line, 0


def without_noise(text: str, language: str = "js") -> str:
    """Comments and strings as spaces; lines stay where they are."""
    return _LOOSE[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def extension(path: str | None) -> str:
    m = re.search(r"\.[A-Za-z0-9_]+$", path or "")
    return m[0].lower() if m else ""


def facts_of(path: str | None, text: str | None) -> Iterator[tuple[str, str, str, int, int]]:
    kind = extension(path)
    if kind == ".py":
        return python_facts(text or "")
    return Reader(text or "", LANGUAGES[kind]).facts() if kind in LANGUAGES else iter(())


def function_bodies(path: str | None, text: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(name, first line, last line, text) of every function with a body."""
    text, kind = text or "", extension(path)
    if kind == ".py":
        lines = text.splitlines(keepends=True)
        for node in ast.walk(parsed(text) or ast.Module([], [])):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield node.name, node.lineno, node.end_lineno, "".join(lines[node.lineno - 1 : node.end_lineno])
    elif kind in LANGUAGES:
        r = Reader(text, LANGUAGES[kind])
        for d in r.definitions:
            if d.kind == "function" and d.first >= 0:
                yield d.name, r.t.line(d.at), r.t.line(d.last), text[r.t.at[d.at] : r.t.at[d.last] + 1]


def per_file(files: DataFrame, function, schema: str) -> DataFrame:
    """path and the rows of function(path, text) for every file (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [(p, *x) for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in function(p, t)]
                kinds = kinds or [pa.int64() if f.endswith("long") else pa.float64() if f.endswith("double") else pa.bool_() if f.endswith("boolean") else pa.string() for f in schema.split(", ")]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return files.select("path", "text").mapInArrow(run, schema)


def facts(files: DataFrame) -> DataFrame:
    """path, fact, name, detail, line, value of every file (path, text)."""
    return per_file(files, facts_of, SCHEMA)


def bodies(files: DataFrame) -> DataFrame:
    """path, name, first, last, body of every function."""
    return per_file(files, function_bodies, "path string, name string, first long, last long, body string")


def symbols(found: DataFrame) -> DataFrame:
    """path, symbols: the distinct names of functions and classes of facts(), in order."""
    names = found.where("fact in ('function', 'class')").groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("symbols"))
    return names


def parameters(found: DataFrame) -> DataFrame:
    """path, name, place (from 0), parameter of facts(), stars and defaults aside."""
    own = found.where("fact = 'parameters' and detail != ''")
    return own.select("path", "name", F.posexplode(F.split("detail", ",")).alias("place", "parameter"))


def references(path: str | None, text: str | None, target: str) -> bool:
    """Whether a file refers to a dotted name: Python by imports, attributes and names, other
    languages by its last part as a word."""
    text = text or ""
    if extension(path) != ".py":
        return re.search(rf"\b{re.escape(target.rsplit('.', 1)[-1])}\b", text) is not None
    root = target.split(".")[0]
    for n in ast.walk(parsed(text) or ast.Module([], [])):
        if isinstance(n, ast.Import) and any(a.name == target or a.name.startswith(target + ".") for a in n.names):
            return True
        if isinstance(n, ast.ImportFrom) and n.module in (target, root) or isinstance(n, ast.Name) and n.id == root:
            return True
    return False


def verified(candidates: DataFrame) -> DataFrame:
    """candidates (path, text, target) with ``refers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [references(p, t, x or "") for p, t, x in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(hit, pa.bool_())], ["path", "target", "refers"])

    return candidates.select("path", "text", "target").mapInArrow(run, "path string, target string, refers boolean")


def dependencies(found: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module, origin of Python imports: standard, local (a module of modules (module), or
    relative) or third_party, by the first part of the name."""
    root = F.element_at(F.split("name", r"\."), 1)
    own = found.where("fact = 'import' and path like '%.py'").select("path", F.when(F.col("name").startswith("."), ".").otherwise(root).alias("module")).distinct()
    local = F.broadcast(modules.select(F.element_at(F.split("module", r"\."), 1).alias("module")).distinct().withColumn("local", F.lit(True)))
    kind = F.when((F.col("module") == ".") | F.col("local"), "local").when(F.col("module").isin(*sys.stdlib_module_names), "standard").otherwise("third_party")
    return own.join(local, "module", "left").select("path", "module", kind.alias("origin"))


def in_string(code: Column, place: Column) -> Column:
    """Whether a 1-based place of a line of code is between quotes: an odd number of the same
    quotes, escaped ones aside, before it."""
    before = F.regexp_replace(F.substr(code, F.lit(1), place - 1), r"\\.", "")
    odd = lambda q, other: F.length(F.regexp_replace(F.regexp_replace(before, f"{other}[^{other}]*{other}", ""), f"[^{q}]", "")) % 2 == 1
    return odd("'", '"') | odd('"', "'")


def docstring_lines(lines: DataFrame, file: str = "file") -> DataFrame:
    """lines (file, line, code) with ``quoted``: within or on the edge of a triple-quoted string
    that isn't assigned. A running count of delimiters, by a window over each file."""
    n = F.regexp_count("code", F.lit("\"\"\"|'''"))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(file).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bare = F.col("code").rlike("^\\s*[rRbBuUfF]{0,2}(\"\"\"|''')")
    opens = F.when((n > 0) & (before % 2 == 0), bare)
    out = lines.withColumn("__inside", before % 2 == 1).withColumn("__opens", opens)
    last = F.last("__opens", ignorenulls=True).over(Window.partitionBy(file).orderBy("line"))
    return out.withColumn("quoted", F.coalesce(last, F.lit(False)) & (F.col("__inside") | F.coalesce("__opens", F.lit(False)))).drop("__inside", "__opens")


def brace_depth(lines: DataFrame, file: str = "file") -> DataFrame:
    """lines with ``depth``: open braces behind each line, a running sum."""
    step = F.regexp_count("code", F.lit(r"\{")) - F.regexp_count("code", F.lit(r"\}"))
    return lines.withColumn("depth", F.sum(step).over(Window.partitionBy(file).orderBy("line")))


def loops(depths: DataFrame, file: str = "file", words: str = r"\b(for|while)\b") -> DataFrame:
    """file, line, until: loops of brace_depth() and the first later line whose depth is back at
    the one before the loop's own line."""
    w = Window.partitionBy(file).orderBy("line")
    marked = depths.withColumn("outer", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    heads = marked.where(F.col("code").rlike(words) & (F.col("depth") > F.col("outer"))).select(file, F.col("line").alias("head"), "outer")
    ends = heads.join(depths.select(file, F.col("line").alias("later"), "depth"), file).where("later > head and depth <= outer")
    return ends.groupBy(file, "head").agg(F.min("later").alias("until")).select(file, F.col("head").alias("line"), "until")
