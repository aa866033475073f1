"""Imports and definition spans of one source file, found on its token stream.

Strings, comments, templates and regular expressions are recognised first, so nothing inside them counts;
brackets are paired, statements and blocks delimited, and imports and definitions read off the tokens.  Broken code never fails: a string without an end is a lone quote, a closing
bracket without a partner is skipped, an opening one reaches to the end of the file.

All places are code points.  Spans are those of the grammar nodes that the reference cuts:

* Python: ``def`` (with ``async``) and ``class`` blocks without their decorators, up to the last token of the
  last statement that is indented deeper than the head (or stands on its line).
* JavaScript and TypeScript: declared functions (not function expressions, generators or signatures), declared
  classes with their decorators, methods of classes and object literals with their modifiers, arrow functions
  wherever they stand; in TypeScript also interfaces and type aliases.  Function types are no arrow functions.
  Abstract classes are another node, which the reference does not cut; ``abstract_classes`` adds them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    name: str


ANONYMOUS = "anonymous"
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}

# ------------------------------------------------------------------------------------------------ Python
_PY_STRING = (r"(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*+(?:\"\"\"|\Z)|'''(?:[^\\']|\\.|'(?!''))*+(?:'''|\Z)"
              r"|\"(?:[^\\\"\n]|\\.)*+\"|'(?:[^\\'\n]|\\.)*+')")
_PY_TOKEN = re.compile(
    r"(?:[ \t\f\r]++|\\\r?\n|#[^\n]*+)*+"                 # skipped
    r"(?:(?P<newline>\n)|(?P<string>(?i:[rbuft]{0,3})" + _PY_STRING + ")"
    r"|(?P<name>[^\W\d]\w*+)|(?P<number>\.?\d[\w.]*+)|(?P<op>.)|\Z)", re.S)
#: What follows the first tokens of a line, where only brackets, strings and ends of lines matter.
_PY_REST = re.compile(r"(?P<plain>[^\"'()\[\]{}\n#\\]++)|(?P<newline>\n)|(?P<skip>#[^\n]*+|\\\r?\n)|(?P<string>"
                      + _PY_STRING + r")|(?P<op>.)", re.S)
_HARD = ("import", "def", "class")


def python_lines(text: str, last: int | None = None) -> list[list[tuple[str, str, int, int]]]:
    """Logical lines as lists of (kind, text, start, end) tokens without white space and comments.

    With ``last``, reading ends with the line that holds that place.

    A keyword that no expression can hold, first on its line, ends brackets that were left open.
    """
    lines, line, depth, first = [], [], 0, True
    for m in _PY_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind is None:                        # the end
            break
        if kind == "newline":
            first = True
            if not depth and line:
                lines.append(line)
                line = []
            if not depth and last is not None and m.start(kind) > last:
                break
            continue
        value = m[kind]
        if depth and first and kind == "name" and value in _HARD:
            depth = 0
            lines.append(line)
            line = []
        first = False
        if kind == "op":
            if value in OPEN:
                depth += 1
            elif value in CLOSE:
                depth = max(0, depth - 1)
        line.append((kind, value, m.start(kind), m.end()))
    return [x for x in [*lines, line] if x]


#: Tokens that tell whether a line is the head of a definition.
_HEAD = 4


def _python_heads(text: str):
    """(first tokens, whether a colon follows them, end of the last token) of the lines of ``python_lines``."""
    at, n = 0, len(text)
    head, colon, end, depth, first = [], False, 0, 0, True
    while at < n:
        if first or len(head) < _HEAD:
            m = _PY_TOKEN.match(text, at)
            kind, at = m.lastgroup, m.end()
            if kind is None:
                break
            value = m[kind]
        else:
            m = _PY_REST.match(text, at)
            kind, at = m.lastgroup, m.end()
            if kind == "skip":
                continue
            value = m[kind]
            if kind == "plain":
                told = value.rstrip(" \t\f\r")
                if told:
                    colon, end = colon or ":" in told, m.start() + len(told)
                continue
        if kind == "newline":
            first = True
            if not depth and head:
                yield head, colon, end
                head, colon = [], False
            continue
        if depth and first and kind == "name" and value in _HARD:
            depth = 0
            if head:
                yield head, colon, end
            head, colon = [], False
        first = False
        if kind == "op":
            if value in OPEN:
                depth += 1
            elif value in CLOSE:
                depth = max(0, depth - 1)
        if len(head) < _HEAD:
            head.append((kind, value, m.start(kind), at))
        elif value == ":":
            colon = True
        end = at
    if head:
        yield head, colon, end


def _statements(line):
    """First token places of the simple statements of a logical line, also behind the colon of a one-line block."""
    yield 0
    depth = 0
    for i, (kind, value, _, _) in enumerate(line):
        if kind == "op":
            depth += (value in OPEN) - (value in CLOSE)
            if value in ";:" and depth <= 0 and i + 1 < len(line):
                yield i + 1


def _dotted(line, i: int) -> tuple[str, int]:
    """The dotted name at token ``i`` and the place behind it."""
    name = ""
    while i < len(line) and line[i][0] == "name" and (not name or name.endswith(".")):
        name += line[i][1]
        i += 1
        if i + 1 < len(line) and line[i][1] == "." and line[i + 1][0] == "name":
            name += "."
            i += 1
    return name, i


def python_imports(text: str) -> list[str]:
    """Imported modules in the order of discovery: later statements first, names of one statement as written.

    ``import a.b as c, d`` gives ``a.b`` and ``d``; ``from ..m import x`` gives ``m``; ``from . import x`` and
    ``from __future__ import x`` give nothing.
    """
    if "import" not in text:
        return []
    found = []
    for line in python_lines(text, text.rfind("import")):
        for at in _statements(line):
            if line[at][0] != "name":
                continue
            names = []
            if line[at][1] == "import":
                i = at
                while i < len(line) and line[i][1] in ("import", ","):
                    name, i = _dotted(line, i + 1)
                    if name:
                        names.append(name)
                    if i < len(line) and line[i][1] == "as":
                        i += 2
            elif line[at][1] == "from":
                i = at + 1
                while i < len(line) and line[i][1] == ".":
                    i += 1
                name, i = _dotted(line, i) if i < len(line) and line[i][1] != "import" else ("", i)
                future = name == "__future__" and i == at + 2
                if name and not future and i < len(line) and line[i][1] == "import":
                    names.append(name)
            if names:
                found.append(names)
    return [name for names in reversed(found) for name in names]


def python_spans(text: str) -> list[Span]:
    if "def" not in text and "class" not in text:
        return []
    out, stack, last = [], [], 0
    for line, colon, end in _python_heads(text):
        start = line[0][2]
        indent = len(text[text.rfind("\n", 0, start) + 1:start].replace("\f", "").expandtabs(8))
        while stack and stack[-1][0] >= indent:
            _, begin, kind, name = stack.pop()
            out.append(Span(begin, last, kind, name))
        words = [t[1] for t in line[:3]]
        at = 1 if words[0] == "async" and len(words) > 1 and words[1] == "def" else 0
        if words[at] in ("def", "class") and len(line) > at + 2 and line[at + 1][0] == "name":
            after = line[at + 2][1]
            if (colon or any(t[1] == ":" for t in line[at + 2:])) and after in ("([" if words[at] == "def" else "([:"):
                stack.append((indent, start, "function" if words[at] == "def" else "class", line[at + 1][1]))
        last = end
    return out + [Span(begin, last, kind, name) for _, begin, kind, name in reversed(stack)]


# ------------------------------------------------------------------------------- JavaScript and TypeScript
_ID = r"[^\W\d][\w$]*+|\$[\w$]*+"
_JS_TOKEN = re.compile(
    r"(?:\s++|//[^\n]*+|/\*.*?(?:\*/|\Z)|\A\#![^\n]*+)*+"  # skipped
    r"(?:(?P<string>\"(?:[^\\\"\n]|\\.)*+\"|'(?:[^\\'\n]|\\.)*+')"
    r"|(?P<name>\#?(?:" + _ID + r"))|(?P<number>\.?\d[\w.]*+)"
    r"|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|[<>]=|\+\+|--|\*\*=?|[-+*%&|^]=|.)|\Z)", re.S)
_JS_TEMPLATE = re.compile(r"(?:[^\\`$]|\\.|\$(?!\{))*+(`|\$\{|\Z)", re.S)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*+")
#: Names after which an operand follows.
_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "throw", "do", "else",
                   "yield", "await", "extends", "default"}
_TYPE_WORDS = {"is", "keyof", "typeof", "extends", "infer", "asserts", "readonly", "unique", "as", "satisfies", "new"}
_MODIFIERS = {"public", "private", "protected", "static", "override", "readonly", "async", "get", "set", "*", "declare", "accessor"}
_NO_IDENTIFIER = {"this", "null", "true", "false", "undefined", "super"}
#: First tokens of a line that carry an expression on.
_CONTINUES = {".", "?.", "?", ":", ",", "=", "=>", "(", "[", "`", "instanceof", "in", "as", "satisfies", "of"}


def _within(places: list[int], first: int, last: int) -> list[int]:
    return places[bisect_left(places, first):bisect_left(places, last)]


class _Script:
    """Tokens of a script with paired brackets, and the reading of its statements."""

    def __init__(self, text: str, typescript: bool):
        self.text, self.typescript = text, typescript
        self.kind, self.value, self.start, self.end = [], [], [], []
        self.match: dict[int, int] = {}
        self.parent: list[int] = []             # token of the innermost open bracket
        self._read()
        self.types: set[int] = set()            # arrows that stand in types
        self.braces: dict[int, str] = {}        # what opening braces hold, where known from their head
        self.ends: dict[int, int] = {}          # last tokens of arrow functions' expressions by their first
        self.arrows = [i for i, v in enumerate(self.value) if v == "=>"]
        self.curlies = [i for i, v in enumerate(self.value) if v == "{"]
        self.colons: dict[int, list[int]] = {}
        for i, v in enumerate(self.value):
            if v == ":":
                self.colons.setdefault(self.parent[i], []).append(i)

    # -- tokens
    def _add(self, kind, start, end, mark=""):
        self.kind.append(kind)
        self.value.append(mark + self.text[start:end])
        self.start.append(start)
        self.end.append(end)

    def _read(self):
        text, at, stack, n = self.text, 0, [], len(self.text)
        kinds, values, starts, ends, parents = self.kind, self.value, self.start, self.end, self.parent
        token = _JS_TOKEN.match
        while at < n:
            m = token(text, at)
            kind, at = m.lastgroup, m.end()
            if kind is None:                    # the end
                break
            value, begin = m[kind], m.start(kind)
            if kind == "op":
                if value == "/" and self._operand_next():
                    m = _JS_REGEX.match(text, begin)
                    if m:
                        kind, value, at = "regex", m.group(), m.end()
                elif value == "`":
                    at = self._template(begin, at, stack)
                    continue
                elif value in CLOSE:
                    if not self._close(value, stack):
                        continue
                    self._place(stack)
                    self._add(kind, begin, at)
                    self.match[self._opened] = len(values) - 1
                    self.match[len(values) - 1] = self._opened
                    if values[self._opened] == "${":
                        at = self._template(at, at, stack)
                    continue
            parents.append(stack[-1] if stack else -1)
            kinds.append(kind)
            values.append(value)
            starts.append(begin)
            ends.append(at)
            if kind == "op" and value in OPEN:
                stack.append(len(values) - 1)

    def _place(self, stack):
        self.parent.append(stack[-1] if stack else -1)

    def _template(self, start, at, stack):
        """One piece of a template, up to its end or to an embedded expression."""
        m = _JS_TEMPLATE.match(self.text, at)
        self._place(stack)
        embedded = m.group(1) == "${"
        # the mark keeps a piece of text from reading like an operator
        mark = "" if self.text[start:start + 1] == "`" else "`"
        self._add("string" if not embedded else "template", start, m.end() - 2 * embedded, mark)
        if embedded:
            self._place(stack)
            self._add("op", m.end() - 2, m.end())
            stack.append(len(self.value) - 1)
        return m.end()

    def _close(self, value, stack) -> bool:
        """Whether a closing bracket has a partner; a brace closes what is left open inside it."""
        for i in range(len(stack) - 1, -1, -1):
            opener = self.value[stack[i]]
            if OPEN[opener] == value:
                self._opened = stack[i]
                del stack[i:]
                return True
            if opener in ("{", "${"):
                return False
        return False

    def _operand_next(self) -> bool:
        """Whether an operand, not an operator, stands next."""
        if not self.value:
            return True
        kind, value = self.kind[-1], self.value[-1]
        if kind == "name":
            return value in _BEFORE_OPERAND and not (len(self.value) > 1 and self.value[-2] in (".", "?."))
        return kind in ("op", "template") and value not in (")", "]", "}", "<", "++", "--")

    # -- helpers
    def val(self, i: int) -> str:
        return self.value[i] if 0 <= i < len(self.value) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.value) and self.kind[i] == "name"

    def new_line(self, i: int) -> bool:
        """Whether a line break lies before token ``i``."""
        return i <= 0 or "\n" in self.text[self.end[i - 1]:self.start[i]]

    def closing(self, i: int) -> int:
        """The partner of the opening bracket ``i``, or the last token where it has none."""
        return self.match.get(i, len(self.value) - 1)

    def opening(self, i: int) -> int:
        return self.match.get(i, i)

    def ends_operand(self, i: int) -> bool:
        if i < 0:
            return False
        kind, value = self.kind[i], self.value[i]
        if kind == "name":
            return value not in _BEFORE_OPERAND and value not in _TYPE_WORDS or self.val(i - 1) in (".", "?.")
        return kind in ("string", "regex", "number") or value in (")", "]", "}", ">", "++", "--")

    def at_statement(self, i: int) -> bool:
        """Whether a statement can begin at token ``i``."""
        p = i - 1
        if p < 0 or self.val(p) in (";", "}") or self.val(p) in ("{", "${") and self.block(p) != "object":
            return True
        if self.val(p) in ("export", "declare") or self.val(p) == "default" and self.val(p - 1) == "export":
            return True
        if self.val(p) == ":" and self.block(self.parent[p]) == "block" and not self.ternary(p):
            return True                         # behind a label or a case
        if self.val(p) in ("else", "do"):
            return True
        return self.new_line(i) and (self.ends_operand(p) or self.val(p) in ("return", "break", "continue"))

    def ternary(self, colon: int) -> bool:
        """Whether the colon at ``colon`` answers a question mark."""
        i, open_ = colon - 1, 0
        while i >= 0 and self.parent[i] == self.parent[colon] or i in self.match and self.match[i] < i:
            if i in self.match and self.match[i] < i:
                i = self.match[i] - 1
                continue
            value = self.value[i]
            if value in (";", ",") or value in ("case", "default") and self.val(i - 1) != ".":
                return False
            if value == ":":
                open_ += 1
            elif value == "?" and not (self.typescript and self.val(i + 1) in (":", ",", ")", "=")):
                if not open_:
                    return True
                open_ -= 1
            i -= 1
        return False

    def block(self, i: int) -> str:
        """What the opening brace at ``i`` holds: block, object, class or type (other brackets: their sign)."""
        if i < 0:
            return "block"
        value = self.value[i]
        if value == "${":
            return "expression"
        if value != "{":
            return value
        if i not in self.braces:
            p = i - 1
            if p < 0 or self.val(p) in (")", ";", "{", "}", "=>", "else", "do", "try", "finally") or self.val(p) == ">":
                kind = "block"
            elif self.val(p) == ":":
                kind = "object" if self.block(self.parent[p]) in ("object", "(", "[") or self.ternary(p) else "block"
            elif self.ends_operand(p):
                kind = "block"
            else:
                kind = "object"
            self.braces[i] = kind
        return self.braces[i]

    # -- types
    def past_angles(self, i: int) -> int:
        """The place behind the type arguments that open at ``i``; ``i`` itself if they do not close."""
        depth, j = 0, i
        while j < len(self.value):
            value = self.value[j]
            if value == "<":
                depth += 1
            elif value == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif value in OPEN:
                j = self.closing(j)
            elif value in CLOSE or value == ";":
                return i
            elif value == "=>":
                self.types.add(j)
            j += 1
        return i

    def past_type(self, i: int, brace_ends: bool) -> int:
        """The place behind the type at ``i``; a brace after a whole operand ends it (it opens a body)."""
        operand = False                         # whether the type so far is whole
        while i < len(self.value):
            value = self.value[i]
            if value == "<":
                after = self.past_angles(i)
                if after == i:
                    return i
                i, operand = after, True
                continue
            if value in OPEN:
                if value == "{" and operand and brace_ends:
                    return i
                if value == "{" and operand and self.new_line(i):
                    return i
                if value == "{":
                    self.braces[i] = "type"
                self.types.update(_within(self.arrows, i, self.closing(i)))
                i, operand = self.closing(i) + 1, True
                continue
            if value == "=>" and operand and self.val(i - 1) == ")":
                self.types.add(i)
                operand = False
            elif value in ("|", "&", ".", "?", ":", "extends", "is", "-", "+") or value in _TYPE_WORDS and self.kind[i] == "name":
                if value in ("?", ":") and brace_ends and value == ":":
                    return i
                operand = False
            elif self.kind[i] in ("name", "string", "number"):
                if operand:
                    return i
                operand = True
            else:
                return i
            i += 1
        return i

    def past_annotation(self, i: int, brace_ends: bool = True) -> int:
        return self.past_type(i + 1, brace_ends) if self.val(i) == ":" and self.typescript else i

    # -- imports
    def imports(self) -> list[str]:
        found = []
        for i, value in enumerate(self.value):
            if self.kind[i] != "name" or self.val(i - 1) in (".", "?."):
                continue
            if value == "import":
                source = self._source(i + 1)
                if source >= 0:
                    found.append((i, 0, self._unquoted(source)))
            elif value == "require" and self.val(i - 1) != "new" and not (
                    self.val(i - 1) == "=" and self.val(i - 3) == "import"):
                at = i + 1 + (self.val(i + 1) == "?.")
                if self.val(at) != "(":
                    continue
                edge = self.closing(at)
                for j in range(at + 1, edge):
                    if self.kind[j] == "string" and self.parent[j] == at and self.value[j][0] != "`" \
                            and self.val(j - 1) in ("(", ",") and self.val(j + 1) in (")", ","):
                        found.append((i, j, self._unquoted(j)))
        return [path for _, _, path in sorted(found, key=lambda f: (-f[0], f[1]))]

    def _unquoted(self, i: int) -> str:
        return self.value[i].strip("\"'")

    def _source(self, i: int) -> int:
        """The string that an import clause at ``i`` reads from, or -1."""
        while i < len(self.value):
            value = self.value[i]
            if self.kind[i] == "string":
                return i if value[0] != "`" and self.val(i - 1) in ("import", "from") else -1
            if value == "{":
                i = self.closing(i)
            elif self.kind[i] != "name" and value not in (",", "*"):
                return -1
            i += 1
        return -1

    # -- definitions
    def spans(self, abstract_classes: bool) -> list[Span]:
        out = []
        for i, value in enumerate(self.value):
            if self.kind[i] == "name":
                if value == "class" and self.val(i - 1) not in (".", "?."):
                    self._class(i, out, abstract_classes)
                elif value == "function":
                    self._function(i, out)
                elif self.typescript and value == "interface" and self.is_name(i + 1) and self.at_statement(i):
                    self._interface(i, out)
                elif self.typescript and value == "type" and self.is_name(i + 1) and self.at_statement(i):
                    self._alias(i, out)
            elif value == "(":
                self._method(i, out)
                if self.typescript:
                    self._annotations(i)
        heads = {i: head for i in self.arrows if (head := self._arrow_head(i))}
        # from the last arrow back, so that the end of a chain is found once
        for i in reversed(heads):
            self._arrow(i, *heads[i], out)
        return out

    def _span(self, first: int, last: int, kind: str, name: str) -> Span:
        return Span(self.start[first], self.end[last], kind, name)

    def _annotations(self, i: int) -> None:
        """Arrows in the types of the parameters of the list at ``i`` and of variables are no functions."""
        for j in self.colons.get(i, ()):
            if not self.ternary(j):
                self.past_type(j + 1, False)

    def _class(self, i: int, out: list, abstract_classes: bool) -> None:
        abstract = self.val(i - 1) == "abstract"
        first = i - abstract
        while self.val(first - 1) in (")",) or self.is_name(first - 1):         # decorators
            j = first - 1
            if self.val(j) == ")":
                j = self.opening(j) - 1
            while self.is_name(j) and self.val(j - 1) == ".":
                j -= 2
            if not (self.is_name(j) and self.val(j - 1) == "@"):
                break
            first = j - 1
        named = self.is_name(i + 1) and self.val(i + 1) not in ("extends", "implements")
        j = i + 1
        while j < len(self.value) and self.value[j] != "{":
            value = self.value[j]
            if value == "<":
                after = self.past_angles(j)
                j = after if after > j else j + 1
            elif value in ("(", "["):
                j = self.closing(j) + 1
            elif value in CLOSE or value in (";", "=", "=>"):
                return
            else:
                j += 1
        if j >= len(self.value):
            return
        self.braces[j] = "class"
        if named and self.at_statement(first) and (not abstract or abstract_classes):
            out.append(self._span(first, self.closing(j), "class", self.value[i + 1]))

    def _function(self, i: int, out: list) -> None:
        first = i - (self.val(i - 1) == "async")
        if self.val(first - 1) in (".", "?.") or not self.is_name(i + 1) or not self.at_statement(first):
            return
        j = self.past_angles(i + 2) if self.val(i + 2) == "<" else i + 2
        if self.val(j) != "(":
            return
        j = self.past_annotation(self.closing(j) + 1)
        if self.val(j) == "{":
            self.braces[j] = "block"
            out.append(self._span(first, self.closing(j), "function", self.value[i + 1]))

    def _interface(self, i: int, out: list) -> None:
        j = i + 2
        while j < len(self.value) and self.value[j] != "{":
            if self.value[j] == "<":
                after = self.past_angles(j)
                j = after if after > j else j + 1
            elif self.kind[j] == "name" or self.value[j] in (",", "."):
                j += 1
            else:
                return
        if j < len(self.value):
            self._type_body(j)
            out.append(self._span(i, self.closing(j), "type", self.value[i + 1]))

    def _type_body(self, brace: int) -> None:
        self.types.update(_within(self.arrows, brace, self.closing(brace)))
        self.braces.update(dict.fromkeys(_within(self.curlies, brace, self.closing(brace)), "type"))

    def _alias(self, i: int, out: list) -> None:
        j = self.past_angles(i + 2) if self.val(i + 2) == "<" else i + 2
        if self.val(j) != "=":
            return
        j = self.past_type(j + 2 if self.val(j + 1) in ("|", "&") else j + 1, False)
        out.append(self._span(i, j if self.val(j) == ";" else j - 1, "type", self.value[i + 1]))

    def _method(self, i: int, out: list) -> None:
        holder = self.block(self.parent[i])
        if holder not in ("class", "object"):
            return
        name = i - 1
        if self.val(name) == ">" and self.typescript:
            depth = 0
            while name > self.parent[i]:
                depth += (self.value[name] == ">") - (self.value[name] == "<")
                name -= 1
                if not depth:
                    break
        if self.val(name) in ("?", "!"):
            name -= 1
        if name <= self.parent[i]:
            return
        first = self.opening(name) if self.val(name) == "]" else name
        if self.kind[name] not in ("name", "string", "number") and self.val(name) != "]":
            return
        if self.kind[name] == "name" and self.val(name) == "function" and self.val(name - 1) in (":", "=", "async", "("):
            return
        while self.val(first - 1) in _MODIFIERS and self.parent[first - 1] == self.parent[i]:
            first -= 1
        p = first - 1
        starts = p == self.parent[i] or self.val(p) in (",", ";", "}") or holder == "class" and (
            self.new_line(first) or self.val(p) == ")")
        if not starts or self.val(first) == "function":
            return
        j = self.past_annotation(self.closing(i) + 1)
        if self.val(j) == "{":
            self.braces[j] = "block"
            plain = self.kind[name] == "name" and not self.value[name].startswith("#")
            out.append(self._span(first, self.closing(j), "function", self.value[name] if plain else ANONYMOUS))

    def _head(self, arrow: int) -> tuple[int, str]:
        """First token of the arrow function whose arrow is at ``arrow`` and its single parameter's name, or -1."""
        p = arrow - 1
        if self.val(p) != ")" and self.typescript:
            j, depth = p, 0                     # back over a return type to the parameter list
            while j > 0:
                value = self.value[j]
                if value in CLOSE:
                    j = self.opening(j)
                elif value in ("(", "{", "[", "${", ";", "=", "=>", ",") and not depth:
                    break
                elif value == ":" and not depth and self.val(j - 1) == ")" and not self.ternary(j):
                    p = j - 1
                    break
                depth += (value == ">") - (value == "<")
                j -= 1
        elif self.val(p) == ")" and self.typescript and self.val(self.opening(p) - 1) in (":", "|", "&"):
            q = self.opening(p) - 1
            while q > 0 and self.val(q) in ("|", "&") and self.is_name(q - 1):
                q -= 2
            if self.val(q) == ":" and self.val(q - 1) == ")" and not self.ternary(q):
                p = q - 1
        if self.val(p) == ")":
            first = self.opening(p)
            if self.val(first - 1) == ">" and self.typescript:
                j, depth = first - 1, 0
                while j > 0:
                    depth += (self.value[j] == ">") - (self.value[j] == "<")
                    if not depth:
                        break
                    j -= 1
                if self.val(j - 1) == "async" or not self.ends_operand(j - 1):
                    first = j
            name = ""
        elif self.is_name(p):
            first, name = p, self.value[p]
        else:
            return -1, ""
        if self.val(first - 1) == "async" and not self.new_line(first):
            first -= 1
        return first, name

    def _in_type(self, first: int) -> bool:
        """Whether a parameter list at ``first`` belongs to a function type."""
        p = first - 1
        value = self.val(p)
        if value in ("|", "&", "<", "as", "satisfies", "keyof", "new") and self.typescript:
            return value not in ("|", "&") or self._in_type(p - 1)
        if value != ":" or not self.typescript:
            return False
        holder = self.block(self.parent[p])
        return holder != "object" and not self.ternary(p)

    def _arrow_head(self, i: int) -> tuple[int, str] | None:
        """First token and single parameter of the arrow function at ``i``; None for the arrow of a type."""
        first, name = (-1, "") if i in self.types else self._head(i)
        if first >= 0 and self._in_type(first):
            self.past_type(first, False)
            self.types.add(i)
            return None
        return (first, name) if first >= 0 else None

    def _arrow(self, i: int, first: int, name: str, out: list) -> None:
        if self.val(i + 1) == "{":
            self.braces[i + 1] = "block"
            last = self.closing(i + 1)
        else:
            last = self.ends[i + 1] = self._expression_end(i + 1)
            if last == i + 1 and self.kind[last] == "name" and not name:
                name = self.value[last] if self.value[last] not in _NO_IDENTIFIER else ""
        if last > i:
            out.append(self._span(first, last, "function", name or ANONYMOUS))

    def _expression_end(self, i: int) -> int:
        """The last token of the expression at ``i``."""
        asked, j = 0, i
        while j < len(self.value):
            value = self.value[j]
            if j > i and self.new_line(j) and self.ends_operand(j - 1) and value not in _CONTINUES \
                    and (self.kind[j] != "op" or value in ("{", "@", "}", "++", "--", "!")) and self.kind[j] != "template" \
                    and not (self.kind[j] == "string" and value[0] == "`"):
                break
            if value in OPEN:
                j = self.closing(j)
            elif value in CLOSE or value in (",", ";"):
                break
            elif value == "?":
                asked += 1
            elif value == ":":
                if not asked:
                    break
                asked -= 1
            elif value == "=>" and not asked and j + 1 in self.ends:
                return self.ends[j + 1]
            j += 1
        return min(j, len(self.value)) - 1


def script_imports(text: str, typescript: bool) -> list[str]:
    """Sources of ``import`` statements and strings given to ``require``, later ones first.

    Re-exports, ``import()`` and ``import x = require()`` are not among them.
    """
    return _Script(text, typescript).imports() if "import" in text or "require" in text else []


def script_spans(text: str, typescript: bool, abstract_classes: bool = False) -> list[Span]:
    return _Script(text, typescript).spans(abstract_classes) if "{" in text or "=" in text else []


# ------------------------------------------------------------------------------------------- both
def imports_of(text: str | None, language: str | None) -> list[str]:
    if language == "python":
        return python_imports(text or "")
    return script_imports(text or "", language == "typescript") if language in ("javascript", "typescript") else []


def spans_of(text: str | None, language: str | None, abstract_classes: bool = False) -> list[Span]:
    if language == "python":
        return python_spans(text or "")
    if language in ("javascript", "typescript"):
        return script_spans(text or "", language == "typescript", abstract_classes)
    return []
