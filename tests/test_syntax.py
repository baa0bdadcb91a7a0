"""Declarations in source code, marked by hand: «kind» stands before each one."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.functions import chunking, syntax

SCRIPT = r'''«import»import { a } from "./a";
«import»import type { B } from './b'
const lazy = import("./c"), url = import.meta.url;
// export class Hidden {} and function hidden() {
/* import x from "y";
function hidden() {} */
const text = "class Hidden {", odd = 'it\'s {';
const deep = `a ${ [1, 2].map((x) => `${x} }`).join("{") } class Hidden {
function hidden() {`;
const brace = /[{/]function hidden\(\) {/g.test(text);

«export»export «class»class Store extends Base<{ a: number }> implements Iface {
  private count = 0;
  handler = () => { return 1; };
  @Input() name: string;

  «method»constructor(private readonly db: Database) {
    super();
    if (db) {
      while (true) { break }
    }
  }
  @Memo({ ttl: 3 })
  «method»public static async load<A, B extends { x: 1 }>(id: A): Promise<{ b: B }> {
    switch (id) { case 1: { run(); break; } default: { run() } }
    return { b: null };
  }
  «method»get size(): number { return this.count }
  abstract later(): void;
  «method»#secret() {}
}

«export»export default «func»async function main(argv: string[] = []): Promise<void> {
  «func»const inner = async (x: number): Promise<number> => x + 1;
  «func»function nested() { return { «method»run() { return 1 }, plain: 2, call: run(3) } }
}

function overload(a: string): void;
«func»function overload(a: any) {}
function* gen() {}
«func»const fn = function () {};
«func»let short = x => x * 2
const called = wrap((x) => x), chosen = (a) ? b => b : null;
const typed: (a: string) => void = other;
const value = {
  «method»async go() {},
  x: 1,
};
abstract class NotMarked { «method»m() {} }
«class»@Component({ selector: "x" })
class Decorated {}
«export»@Component({ selector: "x", «method»run() { return 1 } }) @Other()
export «class»class Sent {}
'''
TYPED = '''«iface»interface Shape { area(): number; nested: { a(): void } }
«export»export «iface»interface Other {
  run(): { a: string }
}
«type»type Alias = { a: string; f(): void }
«export»export «type»type Generic<T> = T | null
«enum»enum Colour { Red, Green }
«export»export «enum»const enum Fast { A = 1 }
declare module "x" {
  «class»class Inner {}
}
'''
MARKUP = '''«import»import React from "react"
«export»export «func»const View = ({ a }: Props) => {
  return <div onClick={() => go(a)}>{a ? <b>text</b> : null}</div>
}
«export»export default «func»function App() { return <View a={1} /> }
'''
PYTHON = r'''"""Module.
class Hidden:
    pass
"""
from __future__ import annotations
«import»import os, sys; «import»import re
«import»from a.b import (
    c,
    d,
)
# def hidden():
x = {"def": 1, 'class': """
def hidden(): pass"""}
y = call(
    lambda: 1,
    import_=2)
z = 1 + \
    2

«decorated»@one
@two(a=[1,
    2])
«class»class A(Base):
    name = r"\""

    «func»def plain(self, x: int = (1)) -> dict: return {}

    «decorated»@property
    «func»async def later(self):
        «func»def inner(): pass
        yield from other
        importer = defer = classes = 1

if sys: «import»import json
«class»class B: pass
'''
GO = '''package main

«import»import (
	"fmt"
)
«import»import "os"

«type»type Point struct { X, Y int }
«type»type (
	A int
	B string
)
// func hidden() {}
var raw = `
func hidden() {
type Hidden struct {`

«method»func (p *Point) Len() float64 {
	f := func(a int) int { return a }
	«type»type local int
	return 0
}
var table = []func(int) error{
	func(a int) error { return nil },
}
«func»func main() { fmt.Println("func x() {", '{', '\\'') }
«func»func Generic[T any](a T) (b T) { return a }
'''
RUST = r'''«import»use std::fmt;
«import»pub(crate) use a::{b, c};
/* fn hidden() {} /* nested struct */ struct Hidden; */
const S: &str = r#"fn hidden() { " struct Hidden "#;
const C: char = '{'; const Q: char = '\'';

#[derive(Debug, Clone)] «struct»pub struct P<'a> { x: &'a str }
#[derive(Debug)]
«struct»struct Unit;
«enum»pub enum E { A, B { c: u8 } }
«type»pub type Alias<T> = Result<T, E>;
«mod»mod outer {
    «mod»pub mod inner;
    «func»pub(super) async unsafe fn deep() {}
}
«trait»pub unsafe trait T { type Item; fn only_signature(&self) -> [u8; 3];
    «func»fn with_body<'b>(&'b self) where Self: Sized { } }
«impl»impl<'a> T for P<'a> {
    «type»type Item = u8;
    «func»fn only_signature(&self) -> [u8; 3] { let f = |x: u8| x; [0; 3] }
    «func»pub extern "C" fn ext() -> impl fmt::Debug { match 1 { 1 => { 2 } _ => 3 } }
}
macro_rules! made { () => { fn hidden() {} struct Hidden; } }
thing! { fn hidden() {} }
«func»fn main() { println!("{}", "fn x() {"); if !{ true } { } }
'''


def marked(text):
    want, out, at = {}, [], 0
    for m in re.finditer("«([a-z]+)»", text):
        out.append(text[at : m.start()])
        here = sum(map(len, out))
        want[here] = max(syntax.WORTH[m[1]], want.get(here, 0))
        at = m.end()
    return "".join([*out, text[at:]]), sorted(want.items())


@pytest.mark.parametrize(
    "path, text",
    [("a.ts", SCRIPT), ("b.MTS", TYPED), ("c.cts", SCRIPT + TYPED), ("d.tsx", MARKUP), ("d2.jsx", MARKUP), ("e.py", PYTHON), ("f.go", GO), ("x/y.rs", RUST)],
)
def test_hand_marked(path, text):
    plain, want = marked(text)
    show = lambda points: [(w, plain[p : p + 30]) for p, w in points]
    assert show(syntax.points(plain, path)) == show(want)
    assert syntax.points(plain, path) == want


def test_javascript_has_no_types():
    plain, _ = marked(TYPED)
    assert [w for _, w in syntax.points(plain, "a.js")] == [90, 90, 90, 100]


def test_defined_cases():
    assert syntax.points("class A {}", "a.md") == syntax.points("class A {}", None) == syntax.points(None, "a.ts") == syntax.points("", "a.py") == []
    assert syntax.points("class A {\n m() {\n `open ${ {", "a.ts") == [(0, 100), (11, 90)]
    assert syntax.points("/* open\nfn a() {}", "a.rs") == [] and syntax.points('"""open\ndef a(): pass', "a.py") == []
    assert syntax.points("fn a() {}\n" * 20_000, "a.rs") == [(10 * i, 90) for i in range(20_000)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["class A", " {", "}", "(", ")", "`", "${", "'", '"', "/", "*", "//", "\n", "=>", "=", "const f", "export ", "fn x", "def y", "func z", "#[", "]", "!", "@", ";", ":", "\\", "r#"])))
def test_any_text_ends(parts):
    text = "".join(parts)
    for path in ("a.ts", "a.py", "a.go", "a.rs"):
        found = syntax.points(text, path)
        assert found == sorted(found) and all(0 <= p < len(text) for p, _ in found)


def test_chunks_begin_at_declarations(spark):
    """Long files: functions of 1,000 characters, cut where one begins, not inside."""
    body = "".join(f"function f{i:03}() {{\n{'  call(1);' * 97}\n\n}}\n" for i in range(40))
    docs = spark.createDataFrame([(1, "a.ts", body), (2, "a.md", body), (3, "b.ts", None), (4, None, body)], "id long, path string, body string")
    rows = sorted(tuple(r) for r in chunking.chunked(docs, "id", overlap=0, path="path").collect())
    texts = {k: [r[3] for r in rows if r[0] == k] for k in (1, 2, 3, 4)}
    assert all("".join(texts[k]) == body for k in (1, 2, 4)) and texts[3] == [""]
    assert all(c.startswith("function f") for c in texts[1]) and len(texts[1]) > 10
    assert texts[2] == texts[4] and not all(c.startswith("function f") for c in texts[2])
    found = chunking.declarations(docs, "id", "path").collect()
    assert {r.id for r in found} == {1} and len(found) == 40
    assert chunking.declarations(docs.limit(0), "id", "path").count() == 0


def test_merged_points():
    assert chunking.merged([(3, 1), (5, 20)], [(3, 90), (5, 1), (4, 2)]) == [(3, 90), (4, 2), (5, 20)]
