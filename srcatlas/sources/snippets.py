"""Code that the derived corpus plants in its files, by language.

Stand-in input only: ``{k}`` is the file's number, ``{k47}`` that of a file under ``frontend/src`` of the same
repository, ``{long}`` and ``{lines}`` are repeated lines.  What each snippet imports and defines by the
reference's rules is stated in ``plans.planted``, which only the oracle reads.
"""

from __future__ import annotations

PYTHON = ["", '''def f{k}(first, second):
    total = first + second
    return total * {k}
DONE = 1
''', r'''import alpha{k}; import beta{k}
if DEBUG: import gamma{k}
try: import delta{k}
except ImportError: from . import nothing
import eps{k}, \
    zeta{k} as z
''', '''"""
import notreal{k}
def not_a_def():
    pass
"""
# import neither
x = 'import nor_this'
from ...pkg.sub{k} import (a,
    b)
''', '''@decorated(
    option=1)
class C{k}(Base):
    """It's a class: def no(): pass"""
    limit = {'a': [1,
2]}

    @property
    async def fetch{k}(self, items: list[int] = [1, 2]) -> dict[str, int]:
        # comment
        def inner{k}(value_of_item):
            return value_of_item + 1000000000000
        return {i: inner{k}(i) for i in items}

    def short(self): return 1
    # trailing comment
AFTER = 1
''', '''def g{k}[T](value: T, other: T, third: T) -> tuple[T, T]:
    return value, other
class B{k}[T]:
    item_with_long_name: T = None
    def get(self): return self.item_with_long_name
END = 1
''', '''def a{k}(
first,
second=(1,
    2),
):
    return [
first,
second,
]
Z = 1
''', '''def long{k}(value):
{long}    return value
T = 1
''', r'''# don't use """ here
def q{k}(text):
    pattern = rb'\d"""' + b"it's \" fine"
    note = f"""def nope(): {text}
import nope
"""
    return pattern, note
import after{k}.sub.mod as am
''', '''def généré{k}(source, début=0):
    yield from source
    raise ValueError(début) from None
class É{k}: pass
import ünï{k}
''', '''if True:
	def t{k}(argument_number_one):
		return argument_number_one * 2
else:
	class U{k}(object):
		attribute_one, attribute_two = 1, 2
N = 0
''', "{lines}", '''from __future__ import division
from .. import sibling
from . import a, b
import __future__
''']

JAVASCRIPT = ["", '''const a{k} = require('./m{k}x'), b = require("pkg{k}", 'second{k}');
// require('no')
/* import x from 'no' */
const s = "require('no')", t = `require('no') ${require('tpl{k}')}`;
foo.require('no'); require(`no`); require.resolve('no');
''', '''import{b}from'./b{k}';import*as c from"c{k}"
import d, {
  e as f
} from '../m{k}'
import './side{k}.css'
export * from './no'
const lazy = import('./no')
''', r'''export async function load{k}(
  first,
  { second, third } = {},
) {
  const re = /[/}]\}/g, half = first / 2 / third;
  return items.map((item) => {
    return item.value * first + second - {k};
  });
}
function* gen() { yield 'not a declaration that is cut, but long enough' }
const expr{k} = function named(argument) { return 'not cut either, but long enough' };
''', '''export default class Box{k} extends Base {
  #secret = '}';
  static async *walk{k}(tree, depth = 0) {
    for (const node of tree) { yield `${node.name}: {${depth}`; }
  }
  get size{k}() { return this.items.length + this.extra.length; }
  handle = async (event) => this.queue.push(event, Date.now());
  ['computed' + 1](one, two) { return one + two + 'long enough now'; }
}
''', '''const api{k} = {
  get value{k}() { return this.inner.value + this.outer.value },
  run{k}(input, output) { return input.pipe(output).then(done => done.value) },
  plain: function (x) { return x + 'function expressions are not cut here' },
}
const pick{k} = (state, ownProps, dispatch) => state.items
  .filter(entry => entry.id === ownProps.id && entry.kind === 'kept')
const next = 1
''', "{lines}"]

TYPESCRIPT = [*JAVASCRIPT, '''import type { A } from './types{k}'
import fs = require('./no{k}')
interface Shape{k}<T extends { id: number }> extends Base<T> {
  area(scale: number): string; onChange: (next: T) => void
}
export type Handler{k}<T> = (event: { detail: T }, done: () => void) => Promise<void>;
type Union{k} =
  | { kind: 'circle'; radius: number }
  | { kind: 'square' };
''', '''@Component({ selector: 'x-{k}', template: `<a>{{ value }}</a>` })
class Widget{k}<T> implements OnInit {
  constructor(private readonly service: Service<T>, public cb: (x: number) => string) { super(); }
  lookup(value: string): { id: number; names: string[] } {
    return { id: 1, names: [value] };
  }
  overload(a: string): void;
}
abstract class Abstract{k} { concrete{k}(): string { return 'methods of it are cut all the same'; } }
''', '''export function over{k}(value: string): string;
export function over{k}(value: any): value is string {
  return typeof value === 'string' && value.length > {k};
}
const typed{k}: (a: number) => string = (a) => String(a) + 'is long enough to stay here';
const generic{k} = async <T,>(value: T, map: (x: T) => T): Promise<T> => map(await value);
''', '''declare module 'x' { export function inside(a: string): void }
import settings from '@/m{k47}';
namespace N{k} {
  export class Inner{k} { field = { nested: { deep: true } }; other = 'long enough to stay'; }
}
''']

BY_LANGUAGE = {"python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT}


def sql_text(code: str) -> str:
    """``code`` as a SQL expression over columns ``k``, ``k47`` and ``nl`` that Spark and DuckDB read alike."""
    import re

    parts = []
    for piece in re.split(r"(\{k\}|\{k47\}|\{long\}|\{lines\}|\n|\\|\t|\$)", code):
        special = {"{k}": "k", "{k47}": "k47", "\n": "nl", "\\": "chr(92)", "\t": "chr(9)",
                   "$": "chr(36)",         # a dollar and a brace are a variable to Spark's SQL
                   "{long}": "repeat(concat('    value = value + 1', nl), 200)",
                   "{lines}": "repeat(concat('setting(1);', nl), 120)"}.get(piece)
        if special or piece:
            parts.append(special or "'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})" if parts else "''"


def planted_sql() -> str:
    """The snippet of a file, chosen by its number among those of its language."""
    whens = [f"WHEN language = '{lang}' AND doc_id % {len(codes)} = {i} THEN {sql_text(code)}"
             for lang, codes in BY_LANGUAGE.items() for i, code in enumerate(codes) if code]
    return "CASE " + "\n         ".join(whens) + " ELSE '' END"
