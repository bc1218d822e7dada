"""Declarations and module references of small files written by hand."""

from loomgraph.sources import extract


def found(path, text):
    rows, refs = extract.read_file(path, text)
    return {(r["kind"], r["qualified_name"]): r for r in rows[1:]}, [r[1:5] for r in refs]


def test_declarations():
    d, _ = found("a.ts", """
import x from './x';
export default function main(a: number): { b: string } { return { b: `${a}}` }; }
export async function load() {}
function hidden() { function inner() {} }
export class Store<T> extends Base implements I1, ns.I2 {
  private items: T[] = [];
  constructor(private n = 1) { super(); }
  static async get<T>(key: string): Promise<T> { return null as any; }
  set size(v: number) {}
  'quoted'() {}
  arrow = () => 1;
}
interface Shape { area(): number; name: string; scale?(by: number): void }
export type Id = string | { a: 1 };
export const enum Color { Red, Green }
export const limit = 5, twice = (n) => n * 2;
const quiet = 1;
let fn = function () {};
namespace Deep.In { export function far() {} }
""")
    assert set(d) == {("FUNCTION", "main"), ("FUNCTION", "load"), ("FUNCTION", "hidden"), ("CLASS", "Store"), ("CONSTRUCTOR", "Store.constructor"), ("METHOD", "Store.get"), ("METHOD", "Store.quoted"), ("INTERFACE", "Shape"), ("METHOD", "Shape.area"), ("METHOD", "Shape.scale"), ("TYPE_ALIAS", "Id"), ("ENUM", "Color"), ("VARIABLE", "limit"), ("FUNCTION", "twice"), ("FUNCTION", "fn"), ("FUNCTION", "Deep.In.far")}
    assert d["FUNCTION", "main"]["default_export"] and d["FUNCTION", "main"]["exported"] and not d["FUNCTION", "hidden"]["exported"]
    assert d["METHOD", "Store.get"]["container"] == "Store" and d["CLASS", "Store"]["start_line"] == 6
    assert d["FUNCTION", "load"]["implementation"] == "{ }" and d["INTERFACE", "Shape"]["implementation"] is None


def test_module_references():
    _, r = found("a.ts", """import def, { a, b as c, type T } from "./m";
import * as ns from 'pkg/sub'
import './side.js';
export { a, c as d } from './m';
export * from "./all";
export * as grouped from './g';
export { ns };
class A extends B implements I, J.K<L, M> {}
const { p, q: r } = require('./common');
const whole = require("fs");
""")
    assert r == [("IMPORT", "./m", "default", "def"), ("IMPORT", "./m", "a", "a"), ("IMPORT", "./m", "b", "c"), ("IMPORT", "./m", "T", "T"), ("IMPORT", "pkg/sub", "*", "ns"), ("IMPORT", "./side.js", None, None), ("EXPORT", "./m", "a", "a"), ("EXPORT", "./m", "c", "d"), ("EXPORT_STAR", "./all", "*", None), ("EXPORT_STAR", "./g", "*", "grouped"), ("EXPORT", None, "ns", "ns"), ("EXTENDS", None, "B", "A"), ("IMPLEMENTS", None, "I", "A"), ("IMPLEMENTS", None, "J.K", "A"), ("REQUIRE", "./common", "p", "p"), ("REQUIRE", "./common", "q", "r"), ("REQUIRE", "fs", "*", "whole")]


def test_common_js_components_and_overloads():
    d, _ = found("a.js", "function one() {}\nconst two = 2;\nexports.three = (x) => x;\nmodule.exports = { one, two, other: 1 };\n")
    assert d["FUNCTION", "one"]["exported"] and d["VARIABLE", "two"]["exported"] and d["FUNCTION", "three"]["exported"]
    d, _ = found("a.tsx", "export function Card() { return <div>{1}</div>; }\nexport const Row = () => <p/>;\nconst lower = () => <p/>;\n")
    assert ("COMPONENT", "Card") in d and ("COMPONENT", "Row") in d and ("FUNCTION", "lower") in d
    d, _ = found("a.ts", "export function f(a: string): void;\nexport function f(a: number): void;\nexport function f(a: any) { return a / 2; }\n")
    assert list(d) == [("FUNCTION", "f")] and d["FUNCTION", "f"]["declaration"].count(" ; ") == 2 and d["FUNCTION", "f"]["implementation"] == "{ return a / 2 ; }"


def test_odd_files():
    for text in ("function broken( {", "const a = `open", "/* open", "let s = 'x\n'"):
        rows, refs = extract.read_file("b.ts", text)
        assert [r["kind"] for r in rows] == ["MALFORMED"] and not refs
    assert extract.read_file("b.ts", "function broken( {")[0][0]["name"] == "broken"
    assert [r["kind"] for r in extract.read_file("d/b.ts", None)[0]] == ["FILE"]
    d, _ = found("r.js", "const re = /[/{]\\/(/g, n = a / b / c; // } {\n/* } */ function after() {}\n")
    assert ("FUNCTION", "after") in d


def test_tables(spark):
    files = spark.createDataFrame([("a.ts", b"export function f() {}\nimport x from './b';"), ("b.ts", None), ("c.ts", b"(")], "path string, content binary")
    assert {(r.path, r.kind, r.qualified_name) for r in extract.declarations(files).collect()} == {("a.ts", "FILE", "a.ts"), ("a.ts", "FUNCTION", "f"), ("b.ts", "FILE", "b.ts"), ("c.ts", "MALFORMED", "c.ts")}
    assert [tuple(r) for r in extract.references(files).collect()] == [("a.ts", "IMPORT", "./b", "default", "x", 2)]
    assert extract.declarations(files.limit(0)).count() == 0
