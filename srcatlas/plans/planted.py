"""What the planted snippets import and define, stated by hand from the reference's rules (oracle only).

Per language and snippet: the imports in discovery order, and the definitions in emission order as (kind, name,
first characters, last characters) of the cut text, which runs from the first to the next following last ones.
Nothing here is read by a job.
"""

from __future__ import annotations

from ..sources.snippets import BY_LANGUAGE, sql_text

JS_IMPORTS = {1: ["tpl{k}", "pkg{k}", "second{k}", "./m{k}x"],
              2: ["./side{k}.css", "../m{k}", "c{k}", "./b{k}"]}
JS_DEFINITIONS = {
    3: [("function", "load{k}", "async function load{k}(", "  });\n}"),
        ("function", "anonymous", "(item) => {", "- {k};\n  }")],
    4: [("class", "Box{k}", "class Box{k}", "now'; }\n}"),
        ("function", "anonymous", "['computed' + 1]", "now'; }"),
        ("function", "anonymous", "async (event)", "Date.now())"),
        ("function", "size{k}", "get size{k}", "extra.length; }"),
        ("function", "walk{k}", "static async *walk{k}", "; }\n  }")],
    5: [("function", "anonymous", "(state, ownProps", "'kept')"),
        ("function", "entry", "entry => entry.id", "'kept'"),
        ("function", "run{k}", "run{k}(input", "done.value) }"),
        ("function", "done", "done => done.value", "done.value"),
        ("function", "value{k}", "get value{k}", "outer.value }")]}

IMPORTS = {
    "python": {2: ["eps{k}", "zeta{k}", "delta{k}", "gamma{k}", "beta{k}", "alpha{k}"], 3: ["pkg.sub{k}"],
               8: ["after{k}.sub.mod"], 9: ["ünï{k}"], 12: ["__future__"]},
    "javascript": JS_IMPORTS,
    "typescript": {**JS_IMPORTS, 7: ["./types{k}"], 10: ["@/m{k47}"]}}

DEFINITIONS = {
    "python": {
        1: [("function", "f{k}", "def f{k}", "total * {k}")],
        4: [("class", "C{k}", "class C{k}", "def short(self): return 1"),
            ("function", "short", "def short", "return 1"),
            ("function", "fetch{k}", "async def fetch{k}", "for i in items}"),
            ("function", "inner{k}", "def inner{k}", "+ 1000000000000")],
        5: [("class", "B{k}", "class B{k}", "return self.item_with_long_name"),
            ("function", "get", "def get", "return self.item_with_long_name"),
            ("function", "g{k}", "def g{k}", "return value, other")],
        6: [("function", "a{k}", "def a{k}", "second,\n]")],
        7: [("function", "long{k}", "def long{k}", "return value")],
        8: [("function", "q{k}", "def q{k}", "return pattern, note")],
        9: [("class", "É{k}", "class É{k}", "pass"),
            ("function", "généré{k}", "def généré{k}", "from None")],
        10: [("class", "U{k}", "class U{k}", "= 1, 2"), ("function", "t{k}", "def t{k}", "one * 2")]},
    "javascript": JS_DEFINITIONS,
    "typescript": {
        **JS_DEFINITIONS,
        7: [("type", "Union{k}", "type Union{k}", "'square' };"), ("type", "Handler{k}", "type Handler{k}", "Promise<void>;"),
            ("type", "Shape{k}", "interface Shape{k}", "=> void\n}")],
        8: [("function", "concrete{k}", "concrete{k}()", "the same'; }"),
            ("class", "Widget{k}", "@Component", "void;\n}"),
            ("function", "lookup", "lookup(value", "};\n  }"),
            ("function", "constructor", "constructor(", "super(); }")],
        9: [("function", "anonymous", "async <T,>", "map(await value)"),
            ("function", "anonymous", "(a) => String", "stay here'"),
            ("function", "over{k}", "function over{k}(value: any)", "{k};\n}")],
        10: [("class", "Inner{k}", "class Inner{k}", "stay'; }")]}}


def imports_sql() -> str:
    """SELECTs (language, t, ord, path) over ``b``, a row per planted import of a file."""
    rows = [f"SELECT repo_name, rel_path, language, 0 AS grp, {i} AS ord, {sql_text(path)} AS import_path FROM b "
            f"WHERE language = '{lang}' AND doc_id % {len(BY_LANGUAGE[lang])} = {t}"
            for lang, planted in IMPORTS.items() for t, paths in planted.items() for i, path in enumerate(paths)]
    return "\nUNION ALL ".join(rows)


def definitions_sql() -> str:
    """SELECTs of every planted definition: ord in emission order, line offsets in the snippet, whole text."""
    rows = []
    for lang, planted in DEFINITIONS.items():
        for t, found in planted.items():
            code = BY_LANGUAGE[lang][t]
            for i, (kind, name, first, last) in enumerate(found):
                start = code.index(first)
                text = code[start:code.index(last, start) + len(last)]
                before, inside = code[:start], text
                n0 = f"{before.count(chr(10))}" + " + 200 - 1" * ("{long}" in before)
                n1 = f"{inside.count(chr(10))}" + " + 200" * ("{long}" in inside)
                rows.append(f"SELECT repo_name, rel_path, language, {i} AS ord, '{kind}' AS chunk_type, {sql_text(name)} AS name, "
                            f"base_lines + 1 + {n0} AS start_line, base_lines + 1 + {n0} + {n1} AS end_line, {sql_text(text)} AS whole "
                            f"FROM b WHERE language = '{lang}' AND doc_id % {len(BY_LANGUAGE[lang])} = {t}")
    return "\nUNION ALL ".join(rows)
