"""Declarations, exports and imports of JavaScript and TypeScript files, as rows.

One pass of tokens over each file (``mapInArrow``) gives a table of declarations and a table of module references; files meet each
other only in joins afterwards (``loomgraph.operators.resolve``).  The scanner knows strings, templates, comments, regular expressions
and brackets; it reads the top level of a file, of its namespaces, and of class and interface bodies.  It is not a type checker: calls,
references and overload symbols need types and aren't extracted.

Defined results: a file with unbalanced brackets or an open string or comment gives one row of kind MALFORMED and nothing else; empty
and null contents give only the FILE row; repeated declarations of one name and kind in a scope (overloads) are one row, at the first
place, with the text of all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .ship import map_arrow

DECLARATIONS = "path string, kind string, name string, qualified_name string, container string, exported boolean, default_export boolean, start_line int, start_column int, declaration string, implementation string"
REFERENCES = "path string, form string, specifier string, imported string, local string, start_line int"

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/|^\#![^\n]*)
      |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<word>[A-Za-z_$\u0080-￿#][\w$\u0080-￿]*)
      |(?P<number>\.?\d(?:[\w.]|(?<=[eE])[+-])*)
      |(?P<mark>=>|\?\?=|\.\.\.|\*\*=|[=!]==|&&=|\|\|=|>>>=|<<=|>>=|[-+*/%&|^!=<>]=|\?\.|\?\?|&&|\|\||\+\+|--|[{}()\[\];,<>.?:=+\-*/%&|^!~@`])""",
    re.S | re.X,
)
#: After these a / begins a regular expression; so it does after a mark that ends no value.
_BEFORE_REGEX = frozenset("return typeof case in of delete void instanceof new throw else do yield await".split())
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Malformed(ValueError):
    pass


class Token:
    __slots__ = ("kind", "text", "at")

    def __init__(self, kind: str, text: str, at: int):
        self.kind, self.text, self.at = kind, text, at


def tokens(text: str) -> list[Token]:
    """Tokens without white space and comments; a template is one token."""
    out: list[Token] = []
    at, n = 0, len(text)
    while at < n:
        last = out[-1] if out else None
        if text[at] == "`":
            end = _template_end(text, at)
            out.append(Token("template", text[at:end], at))
            at = end
            continue
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (last is None or last.text in _BEFORE_REGEX or last.kind == "mark" and last.text not in (")", "]", "}", "++", "--")):
            m = _REGEX.match(text, at)
            if m:
                out.append(Token("regex", m.group(), at))
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        if m is None or text.startswith("/*", at) and m.lastgroup != "space":
            raise Malformed(f"unexpected {text[at : at + 10]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    return out


def _template_end(text: str, at: int) -> int:
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                c = text[at]
                if c == "`":
                    at = _template_end(text, at)
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    raise Malformed("open template")


def partners(ts: list[Token]) -> dict[int, int]:
    """Opening bracket -> closing bracket."""
    out, stack = {}, []
    for i, t in enumerate(ts):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in _PAIRS:
            if not stack or ts[stack[-1]].text != _PAIRS[t.text]:
                raise Malformed(f"unexpected {t.text}")
            out[stack.pop()] = i
    if stack:
        raise Malformed(f"open {ts[stack[-1]].text}")
    return out


_MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override const".split())


class File:
    """One file's declarations and module references."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.found: dict[tuple, dict] = {}
        self.references: list[tuple] = []
        self.ts = tokens(text)
        self.pair = partners(self.ts)
        self.common = self._common_exports()
        self.lines = [0] + [m.end() for m in re.finditer("\n", text)]
        self.body(0, len(self.ts), "", path)

    def word(self, i: int) -> str | None:
        return self.ts[i].text if i < len(self.ts) else None

    def place(self, i: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.lines, self.ts[i].at)
        return line, self.ts[i].at - self.lines[line - 1] + 1

    def joined(self, a: int, b: int) -> str:
        return " ".join(t.text for t in self.ts[a:b])

    def has_jsx(self, a: int, b: int) -> bool:
        return self.path.lower().endswith(("x", ".js", ".mjs", ".cjs")) and any(self.ts[k].text == "<" and self.ts[k - 1].text in ("(", "return", "=>", "?", ":", "&&", ",", "{") and (self.ts[k + 1].kind == "word" or self.ts[k + 1].text == ">") for k in range(max(a, 1), b - 1))

    def skip(self, i: int, ends: tuple[str, ...], stop: int) -> int:
        """From i on the first of ``ends`` outside brackets, or ``stop``."""
        while i < stop and self.ts[i].text not in ends:
            i = self.pair[i] + 1 if i in self.pair else i + 1
        return min(i, stop)

    def statement_end(self, i: int, stop: int) -> int:
        """Past the statement that begins at i: a semicolon, or a line end after a whole expression."""
        while i < stop:
            if self.ts[i].text == ";":
                return i + 1
            j = self.pair[i] + 1 if i in self.pair else i + 1
            if j < stop and "\n" in self.text[self.ts[j - 1].at : self.ts[j].at] and self.ts[j].text not in (".", "?.", "=>", "+", "-", "*", "&&", "||", "??", "?", ":", ",", "=", ")", "]", "}", "|", "&", "extends", "implements", "as", "(", "[") and self.ts[j - 1].text not in ("=>", "=", "+", "-", "*", "&&", "||", "??", "?", ":", ",", "(", "[", "{", "|", "&", ".", "extends", "=", "return", "as"):
                return j
            i = j
        return stop

    def add(self, kind: str, name: str, scope: str, container: str, exported: bool, default: bool, a: int, body: int | None, b: int) -> None:
        qualified = scope + name
        declared = self.joined(a, b if body is None else body)
        inner = None if body is None else self.joined(body, b)
        key = (kind, qualified)
        if key in self.found:
            f = self.found[key]
            f["declaration"] += " ; " + declared
            f["implementation"] = f["implementation"] or inner
            return
        line, col = self.place(a)
        self.found[key] = dict(path=self.path, kind=kind, name=name, qualified_name=qualified, container=container, exported=exported, default_export=default, start_line=line, start_column=col, declaration=declared, implementation=inner)

    def callable_kind(self, name: str, a: int, b: int) -> str:
        return "COMPONENT" if re.fullmatch("[A-Z][A-Za-z0-9]*", name) and self.has_jsx(a, b) else "FUNCTION"

    def body(self, i: int, stop: int, scope: str, container: str) -> None:
        while i < stop:
            i = max(self.statement(i, stop, scope, container), i + 1)

    def statement(self, i: int, stop: int, scope: str, container: str) -> int:
        a = i
        while self.word(i) == "@":  # a decorator
            i = i + 2
            while self.word(i) in (".", "("):
                i = self.pair[i] + 1 if i in self.pair else i + 2
        exported = default = False
        while i < stop and self.ts[i].text in _MODIFIERS and self.word(i + 1) not in ("=", ":", "(", ";", ".", ","):
            if self.ts[i].text == "const" and self.word(i + 1) != "enum":
                break
            exported |= self.ts[i].text == "export"
            default |= self.ts[i].text == "default"
            i += 1
        if i >= stop:
            return stop
        w, nxt = self.ts[i].text, self.ts[i + 1] if i + 1 < stop else None
        if w == "import" and nxt is not None and nxt.text not in ("(", "."):
            return self.imports(i, stop)
        if self.ts[a].text == "export" and w in ("{", "*", "type") and (w != "type" or nxt is not None and nxt.text in ("{", "*")):
            return self.reexport(i + (w == "type"), stop)
        if w in ("namespace", "module") and nxt is not None and nxt.kind in ("word", "string"):
            j = self.skip(i + 1, ("{", ";"), stop)
            if self.word(j) == "{":
                name = self.joined(i + 1, j).replace(" ", "").strip("\"'")
                self.body(j + 1, self.pair[j], f"{scope}{name}.", container)
                return self.pair[j] + 1
        if w == "function":
            k = i + 1 + (self.word(i + 1) == "*")
            if k < stop and self.ts[k].kind == "word":
                return self.function(a, k, stop, scope, container, exported, default)
        if w in ("class", "interface") and nxt is not None and nxt.kind == "word" and nxt.text not in ("extends", "implements"):
            return self.members(a, i, stop, scope, container, exported, default)
        if w == "enum" and nxt is not None and nxt.kind == "word":
            j = self.skip(i + 2, ("{",), stop)
            end = self.pair.get(j, stop - 1) + 1
            self.add("ENUM", nxt.text, scope, container, exported, False, a, None, end)
            return end
        if w == "type" and nxt is not None and nxt.kind == "word" and self.word(i + 2) in ("=", "<"):
            end = self.statement_end(i, stop)
            self.add("TYPE_ALIAS", nxt.text, scope, container, exported, False, a, None, end)
            return end
        if w in ("const", "let", "var"):
            return self.variables(a, i + 1, stop, scope, container, exported, default)
        end = self.statement_end(i, stop)
        if w == "exports" and nxt is not None and nxt.text == "." and self.word(i + 3) == "=":
            name = self.ts[i + 2].text
            kind = self.callable_kind(name, i + 4, end) if self.is_function(i + 4, end) else "VARIABLE"
            self.add(kind, name, scope, container, True, False, a, i + 4, end)
        if i in self.pair:  # a block
            return self.pair[i] + 1
        return end

    def function(self, a, k, stop, scope, container, exported, default) -> int:
        name = self.ts[k].text
        j = self.skip(k + 1, ("(",), stop)
        j = self.skip(self.pair.get(j, j) + 1, ("{", ";"), stop) if j < stop else stop
        # a result type may be an object: the body is the last braces before what follows
        if j < stop and self.word(j) == "{" and self.word(j - 1) in (":", "|", "&") and self.pair[j] + 1 < stop and self.word(self.pair[j] + 1) in ("{", "|", "&"):
            j = self.skip(self.pair[j] + 1, ("{", ";"), stop)
        has_body = j < stop and self.word(j) == "{"
        end = self.pair[j] + 1 if has_body else min(j + 1, stop)
        kind = self.callable_kind(name, j, end) if has_body else "FUNCTION"
        self.add(kind, name, scope, container, exported or name in self.common, default, a, j if has_body else None, end if has_body else j)
        return end

    def is_function(self, i: int, end: int) -> bool:
        if self.word(i) == "async":
            i += 1
        if self.word(i) == "function":
            return True
        if i in self.pair and self.ts[i].text == "(":
            j = self.pair[i] + 1
            return self.word(j) == "=>" or self.word(j) == ":" and self.word(self.skip(j, ("=>", ",", ";"), end)) == "=>"
        if self.word(i) == "<":
            return self.word(self.skip(self.skip(i, ("(",), end) + 0, ("=>", ";"), end)) == "=>"
        return i < end and self.ts[i].kind == "word" and self.word(i + 1) == "=>"

    def variables(self, a, i, stop, scope, container, exported, default) -> int:
        end = self.statement_end(i, stop)
        last = end - (end > i and self.ts[end - 1].text == ";")
        while i < last:
            name, start = self.ts[i], i
            eq = self.skip(i, ("=", ","), last)
            after = self.skip(eq, (",",), last) if eq < last and self.word(eq) == "=" else eq
            if eq < last and self.word(eq) == "=":
                self.required(i, eq, after)
                if name.kind == "word":
                    out = exported or name.text in self.common
                    if self.is_function(eq + 1, after):
                        self.add(self.callable_kind(name.text, eq, after), name.text, scope, container, out, default, start, eq + 1, after)
                    elif out:
                        self.add("VARIABLE", name.text, scope, container, out, default, start, eq + 1, after)
            i = after + 1
        return end

    def members(self, a, i, stop, scope, container, exported, default) -> int:
        kind, name = ("CLASS" if self.ts[i].text == "class" else "INTERFACE"), self.ts[i + 1].text
        j = self.skip(i + 2, ("{",), stop)
        end = self.pair.get(j, stop - 1) + 1
        out = exported or kind == "CLASS" and name in self.common
        self.add(kind, name, scope, container, out, default and kind == "CLASS", a, j if kind == "CLASS" else None, end)
        for part, place in self.heritage(i + 2, j):
            self.references.append((self.path, part[0], None, part[1], scope + name, place))
        k = j + 1
        while k < end - 1:
            start = k
            while self.word(k) == "@" or self.ts[k].text in _MODIFIERS and self.word(k + 1) not in ("(", ":", "=", ";", "?"):
                k += 2 if self.word(k) == "@" else 1
                while k < end - 1 and self.word(k) == "(":
                    k = self.pair[k] + 1
            accessor = self.word(k) in ("get", "set") and self.word(k + 1) not in ("(", ":", "=", ";", "?", "<")
            k += accessor + (self.word(k) == "*")
            label = self.ts[k]
            after = self.pair[k] + 1 if k in self.pair else k + 1
            after += self.word(after) == "?"
            if self.word(after) == "<":
                after = self.skip(after, ("(",), end - 1)
            if self.word(after) == "(" and label.kind in ("word", "string", "number") or self.word(after) == "(" and label.text == "[":
                close = self.pair[after]
                stop_at = self.skip(close + 1, ("{", ";", ",") if kind == "CLASS" else (";", ","), end - 1) if self.word(close + 1) == ":" or self.word(close + 1) in ("{", ";", ",") else close + 1
                if kind == "CLASS" and self.word(stop_at) == "{" and self.word(stop_at - 1) == ":":
                    stop_at = self.skip(self.pair[stop_at] + 1, ("{", ";"), end - 1)
                has_body = self.word(stop_at) == "{"
                fin = self.pair[stop_at] + 1 if has_body else stop_at
                text = label.text.strip("\"'") if label.text != "[" else self.joined(k, after).replace(" ", "")
                if kind == "CLASS" and text == "constructor":
                    self.add("CONSTRUCTOR", "constructor", f"{scope}{name}.", scope + name, False, False, start, stop_at if has_body else None, fin)
                elif not accessor:
                    self.add("METHOD", text, f"{scope}{name}.", scope + name, False, False, start, stop_at if has_body else None, fin)
                k = fin
            else:
                k = self.statement_end(k, end - 1)
            while k < end - 1 and self.word(k) in (";", ","):
                k += 1
            k = max(k, start + 1)
        return end

    def heritage(self, i: int, j: int) -> Iterator[tuple[tuple[str, str], int]]:
        form = None
        depth = 0
        while i < j:
            t = self.ts[i]
            depth += (t.text == "<") - (t.text == ">")
            if t.text in ("extends", "implements") and not depth:
                form = t.text.upper()
            elif form and not depth and t.kind == "word" and self.word(i - 1) in ("extends", "implements", ","):
                k = i
                while self.word(k + 1) == "." and k + 2 < j:
                    k += 2
                yield (form, self.joined(i, k + 1).replace(" ", "")), self.place(i)[0]
            i += 1

    def imports(self, i: int, stop: int) -> int:
        end = self.statement_end(i, stop)
        k = next((k for k in range(i + 1, end) if self.ts[k].kind == "string" and (k == i + 1 or self.ts[k - 1].text in ("from", "("))), None)
        if k is None:
            return end
        spec, line = self.ts[k].text[1:-1], self.place(i)[0]
        end = max(k + 1, min(end, k + 1 + (self.word(k + 1) == ";")))
        names: list[tuple[str, str]] = []
        j = i + 1 + (self.word(i + 1) == "type" and self.word(i + 2) not in ("from", ","))
        while j < k - 1:
            if self.ts[j].text == "{":
                names += self.names(j)
                j = self.pair[j]
            elif self.ts[j].text == "*" and self.word(j + 1) == "as":
                names.append(("*", self.ts[j + 2].text))
                j += 2
            elif self.ts[j].kind == "word" and self.ts[j].text != "from":
                names.append(("default", self.ts[j].text))
            j += 1
        for imported, local in names or [(None, None)]:
            self.references.append((self.path, "IMPORT", spec, imported, local, line))
        return end

    def names(self, j: int) -> list[tuple[str, str]]:
        """(outer, inner) of { a, b as c, type d }."""
        out, k = [], j + 1
        while k < self.pair[j]:
            stop = self.skip(k, (",",), self.pair[j])
            words = [t.text.strip("\"'") for t in self.ts[k:stop]]
            if len(words) > 1 and words[0] == "type" and words[1] != "as":
                words = words[1:]
            if words:
                out.append((words[0], words[-1]))
            k = stop + 1
        return out

    def reexport(self, i: int, stop: int) -> int:
        line = self.place(i)[0]
        if self.word(i) == "*":
            k = i + (3 if self.word(i + 1) == "as" else 1)
            spec = self.ts[k + 1].text[1:-1] if self.word(k) == "from" and k + 1 < stop else None
            self.references.append((self.path, "EXPORT_STAR", spec, "*", self.ts[i + 2].text if k == i + 3 else None, line))
            return self.statement_end(k, stop)
        close = self.pair[i]
        spec = self.ts[close + 2].text[1:-1] if self.word(close + 1) == "from" and close + 2 < stop else None
        for inner, outer in self.names(i):
            self.references.append((self.path, "EXPORT", spec, inner, outer, line))
        return min(stop, close + (3 if spec is not None else 1))

    def required(self, i: int, eq: int, after: int) -> None:
        """const x = require("y"), with properties of it or a pattern of names."""
        if self.word(eq + 1) == "require" and self.word(eq + 2) == "(" and eq + 3 < len(self.ts) and self.ts[eq + 3].kind == "string":
            spec, line = self.ts[eq + 3].text[1:-1], self.place(i)[0]
            if self.ts[i].text == "{":
                k = i + 1
                while k < self.pair[i]:
                    stop = self.skip(k, (",",), self.pair[i])
                    words = [t.text for t in self.ts[k:stop] if t.kind == "word"]
                    if words:
                        self.references.append((self.path, "REQUIRE", spec, words[0], words[-1], line))
                    k = stop + 1
            else:
                self.references.append((self.path, "REQUIRE", spec, "*", self.ts[i].text, line))

    def _common_exports(self) -> set[str]:
        """Names that the file puts on exports or on module.exports."""
        out, ts = set(), self.ts
        for i in range(len(ts) - 3):
            if ts[i].text == "exports" and (i == 0 or ts[i - 1].text != ".") and ts[i + 1].text == "." and ts[i + 3].text == "=":
                out.add(ts[i + 2].text)
            if ts[i].text == "module" and ts[i + 1].text == "." and ts[i + 2].text == "exports" and ts[i + 3].text == "=" and i + 4 in self.pair and ts[i + 4].text == "{":
                k = i + 5
                while k < self.pair[i + 4]:
                    if ts[k].kind == "word" and self.word(k + 1) in (",", ":", "}"):
                        out.add(ts[k].text)
                    k = self.skip(k, (",",), self.pair[i + 4]) + 1
        return out


def read_file(path: str, text: str | None) -> tuple[list[dict], list[tuple]]:
    """(declarations, references) of one file; the file itself comes first."""
    head = dict(path=path, kind="FILE", name=path.rsplit("/", 1)[-1], qualified_name=path, container=None, exported=False, default_export=False, start_line=1, start_column=1, declaration=None, implementation=None)
    try:
        f = File(path, text or "")
    except (Malformed, IndexError, KeyError, RecursionError):
        named = re.search(r"function\s+([A-Za-z_$][\w$]*)", text or "")
        return [head | {"kind": "MALFORMED", "name": named.group(1) if named else head["name"]}], []
    return [head, *f.found.values()], f.references


def declarations(files: DataFrame) -> DataFrame:
    """Rows of DECLARATIONS of files (path, content)."""
    return _rows(files, 0, DECLARATIONS)


def references(files: DataFrame) -> DataFrame:
    """Rows of REFERENCES: IMPORT, EXPORT, EXPORT_STAR and REQUIRE with their specifier, EXTENDS and IMPLEMENTS with the name meant."""
    return _rows(files, 1, REFERENCES)


def _rows(files: DataFrame, which: int, schema: str) -> DataFrame:
    def work(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            out: list = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                got = read_file(path, content.decode("utf-8", "replace") if content is not None else None)[which]
                out += [tuple(r.values()) for r in got] if which == 0 else got
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return map_arrow(files.select("path", "content"), work, schema)
