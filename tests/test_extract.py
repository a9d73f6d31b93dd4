from quillmesh.operators import extract as X

GO = '''package a
import (
\t"fmt"
\tu "x/util" // "no"
)
type Store struct {
\tn int
}
func (s *Store) Get(k string) (string, error) {
\tif ok(k) { return fmt.Sprint("a(b)"), nil }
\treturn load(k), nil
}
func load(k string) string { return k }
'''
JS = '''import { a,
  b } from './x'
// function gone() {}
class Cart extends Base {
  async total(rate) {
    if (rate) { return sum(this.items) }
    return new Money(`f(${1})`)
  }
}
function sum(items) {
  return items.reduce(add)
}
'''
JAVA = '''import java.util.List;
public class Box {
  private final int n = 1;
  public List<String> names(int k) throws IOException {
    return fetch(k).sort();
  }
  abstract void later();
  void run() { while (n > 0) { step(); } }
}
'''
RUST = '''use std::fmt;
impl Shape for Square {
    fn area(&self) -> f64 { side(self) * Self::scale(2) }
}
pub fn side<T>(x: &'static T) -> f64 { x.len() }
'''
CPP = '''#include "a/b.h"
class Tree : public Node {
 public:
  int depth() const { return walk(this); }
  int later();
};
static int walk(Node* n) {
  if (n) { return n->next(); }
  return 0;
}
'''


def test_definitions_end_where_their_brackets_close():
    entities, imports, calls = X.code_facts("go", GO.encode())
    assert entities == [("class", "Store", 6, 8), ("method", "Get", 9, 12), ("function", "load", 13, 13)]
    assert [m for m, _, _ in imports] == ["fmt", "x/util"]
    assert calls == [("ok", ("method", "Get", 9)), ("Sprint", ("method", "Get", 9)), ("load", ("method", "Get", 9))]
    entities, imports, calls = X.code_facts("javascript", JS.encode())
    assert entities == [("class", "Cart", 4, 9), ("method", "total", 5, 8), ("function", "sum", 10, 12)] and imports == [("./x", 0, [])]
    assert calls == [("sum", ("method", "total", 5)), ("reduce", ("function", "sum", 10))]
    entities, imports, calls = X.code_facts("java", JAVA.encode())
    assert entities == [("class", "Box", 2, 9), ("method", "names", 4, 6), ("method", "later", 7, 7), ("method", "run", 8, 8)]
    assert imports == [("java.util.List", 0, [])] and [c[0] for c in calls] == ["fetch", "sort", "step"]
    entities, _, calls = X.code_facts("rust", RUST.encode())
    assert entities == [("class", "Square", 2, 4), ("method", "area", 3, 3), ("function", "side", 5, 5)]
    assert calls == [("side", ("method", "area", 3)), ("len", ("function", "side", 5))]
    entities, imports, calls = X.code_facts("cpp", CPP.encode())
    assert entities == [("class", "Tree", 2, 6), ("method", "depth", 4, 4), ("function", "walk", 7, 10)]
    assert imports == [("a/b.h", 0, [])] and calls == [("walk", ("method", "depth", 4)), ("next", ("function", "walk", 7))]


def test_sql_and_broken_texts():
    sql = "create table t(a int);\nCREATE OR REPLACE FUNCTION s.f(a int)\nreturns int as $$ select g(1); $$\nlanguage sql;\nselect 1;"
    assert X.code_facts("sql", sql.encode()) == ([("function", "f", 2, 4)], [], [])
    entities, imports, calls = X.code_facts("python", b"import os\ndef f(:\n    g()\ndef h():\n    return g(\n")
    assert ("os", 0, ["os"]) in imports and any(e[1] == "h" for e in entities)
    for language in ("go", "javascript", "typescript", "java", "rust", "cpp", "sql", "python"):
        assert X.code_facts(language, b"") == ([], [], [])
        X.code_facts(language, b"}}} ((( { \" ' ` func f( class")
    assert X.code_facts("go", b"\xff") is None


def test_ruled_out_ratios_change_no_score(spark):
    import pandas as pd

    from quillmesh.functions import text as T

    asked = "smal brused brass"
    texts = ["small brushed brass", "", None, "brass", "smal brused brass x", "unrelated words of another sort", "brusedd", "SMALL smel"]
    names = ["small", "", None, "b", "smal", None, "brus", "smal brused brass"]
    ids = [f"part::{k}" for k in range(len(texts))]

    def plain(t, n, i):
        best = max(T.ratio(asked, x or "") for x in (t, n, i))
        near = max((T.ratio(a, b) for a in set(T._words(asked)) for b in set(T._words(t or ""))), default=0.0)
        return max(best, near * 0.95 if near >= 0.8 else 0.0)

    got = T.ratio_scores(asked).func(pd.Series(texts), pd.Series(names), pd.Series(ids))
    assert list(got) == [plain(*row) for row in zip(texts, names, ids)]
