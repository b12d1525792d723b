import random
import re
import time

from pyspark.sql import functions as F

from sourceloom.functions import java
from sourceloom.operators.fragments import call_edges_of, edges_of_fragments, fragments_of, read_sources

FOO = """package a.b;
public class Foo extends Bar {
  public Foo() {
  }
  private int run(int x) { return help(x); }
  public void io() throws E {
  }
  protected void help(
 int y) {
  }
  void pkg() {
  }
}
"""
N = """public void a() { b(); }
private int b() { toString(); }
public String toString() { a(); }
"""

# The patterns that say what is a package, class, method and call.
PATTERNS = {
    java.package_of: (r"^\s*package\s+([\w\.]+)\s*;", re.MULTILINE),
    java.classes_of: (r"class\s+(\w+)", 0),
    java.methods_of: (r"(?:public|protected|private).*?\s+(\w+)\s*\(.*?\)\s*{", 0),
    java.call_sites_of: (r"(\w+)\s*\(", 0),
}


def sources(spark, **files):
    rows = [(name, bytearray(code.encode())) for name, code in files.items()]
    return read_sources(spark.createDataFrame(rows, "file_path string, content binary"))


def test_foo(spark):
    row = sources(spark, Foo=FOO).first()
    assert (row.package, row.classes, row.methods, row.calls) == ("a.b", ["Foo"], ["Foo", "run"], ["Foo", "run"])
    assert row.n_fragments == 3
    got = {(r.type, r.symbol, tuple(r.calls)) for r in fragments_of(sources(spark, Foo=FOO)).collect()}
    assert got == {
        ("class", "a.b.Foo", ("Foo", "run")),
        ("method", "a.b.Foo.Foo", ("a.b.Foo.run",)),
        ("method", "a.b.Foo.run", ("a.b.Foo.Foo",)),
    }
    assert {tuple(r) for r in call_edges_of(sources(spark, Foo=FOO)).collect()} == {
        ("a.b.Foo.Foo", "a.b.Foo.run"),
        ("a.b.Foo.run", "a.b.Foo.Foo"),
    }


def test_fixed_names_are_never_called(spark):
    want = {("a", "b"), ("b", "a"), ("toString", "a"), ("toString", "b")}
    assert {tuple(r) for r in call_edges_of(sources(spark, N=N)).collect()} == want
    assert {tuple(r) for r in edges_of_fragments(fragments_of(sources(spark, N=N))).collect()} == want


def test_two_classes_overloads_and_no_package(spark):
    code = "class A { public int f(int a) { } public int f() { g(); } }\nclass B { public int g() { f(1); } }\n"
    rows = fragments_of(sources(spark, A=code)).collect()
    assert sorted((r.type, r.symbol) for r in rows) == [
        ("class", "A"), ("class", "B"), ("method", "A.f"), ("method", "A.f"), ("method", "A.g"),
    ]
    assert {tuple(r.calls) for r in rows if r.symbol == "A.f"} == {("A.g", "A.g")}


def test_empty_and_nameless_files(spark):
    rows = sources(spark, E="", T="just text (in brackets)").collect()
    assert all(r.n_fragments == 0 and r.package is None for r in rows)
    assert fragments_of(sources(spark, E="")).count() == 0


def random_text(rng):
    words = ["public", "private ", "protected", "class", "package", " a", "b", "été", "x1_", "²", " ", "\n", "\t", "(",
             ")", "{", "}", ";", ".", " ", "\x1c", "\x85", " ", "foo(", ") {", "static int", "\r", ",", "()\n{"]
    return "".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))


def test_patterns_match_the_same_as_python(values):
    rng = random.Random(7)
    cases = [random_text(rng) for _ in range(6000)] + [FOO, N, "été()", "class É1 {", "private void\nname\n(int a)\n{"]
    for make, (pattern, flags) in PATTERNS.items():
        for case, got in zip(cases, values(make, cases)):
            want = re.findall(pattern, case, flags)
            if make is java.package_of:
                assert got == (want[0] if want else None), repr(case)
            else:
                assert got == want, (make.__name__, repr(case))


def test_long_lines_do_not_explode(values):
    line, one_line = "private foo(x; " * 10_000, "public void a(int b) { } " * 10_000
    cases = [line, "private " * 10_000, line + "\nprivate int a() {", one_line]
    start = time.time()
    assert values(java.methods_of, cases) == [[], [], ["a"], ["a"] * 10_000]
    assert values(java.package_of, ["\n" * 200_000]) == [None]
    calls, blanks = "public ){" + " f(" * 300_000, "public " + " " * 1_000_000 + "x"
    assert values(java.methods_of, [calls, blanks, calls + " g\n(int a) {"]) == [[], [], ["g"]]
    assert time.time() - start < 30


def test_every_pair_of_a_file_is_an_edge(spark):
    rng = random.Random(3)
    names = ["m%d" % i for i in range(12)] + ["toString", "wait"]
    files, want = {}, 0
    for f in range(20):
        chosen = [rng.choice(names) for _ in range(rng.randrange(8))]
        files[f"F{f}"] = f"package p{f};\n" + "".join(f"public void {m}() {{ }}\n" for m in chosen)
        declared = set(chosen)
        callable_ = declared - {"toString", "wait"}
        want += sum(1 for m in declared for c in callable_ if m != c)
    edges = call_edges_of(sources(spark, **files))
    assert edges.count() == want
    assert edges.where(F.col("caller") == F.col("callee")).count() == 0


def test_calls_read_backwards_are_those_of_the_pattern(values):
    from sourceloom.functions.text import SPACE, WORD

    forward = rf"((?<!{WORD}){WORD}++){SPACE}*+\("  # as it was matched word by word
    rng = random.Random(7)
    alphabet = ["a", "Z9", "_", "é", "\U0001d538", "٣", "(", "(", ")", " ", "\n", "\t", "\x1c", "\x85", " ", ",", "́", "-"]
    texts = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 3, 8, 40]))) for _ in range(400)] + ["f(", "(", "f", "", None, "f (g(", "é (x)"]
    want = values(lambda v: F.regexp_extract_all(v, F.lit(forward), F.lit(1)), texts)
    assert values(java.call_sites_of, texts) == want
    plan = values(lambda v: F.get(F.transform(F.array(java.call_sites_of(v)), lambda names: F.size(names)), F.lit(0)), ["f(g(x)) (h (", None])
    assert plan == [3, None]


def test_derived_sources_are_those_of_the_plain_pattern(spark, values):
    from catalog.spark_queries import java_source

    texts = ["hello.\nabcdefgh.\na.\nab.\nABc.\nhe11o.\n x.y.\nabc.d.\n", ",", "", "ab,cd.\nef,\U0001d538,"]
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, r"(\p{L}),", "$1(),"), r"([a-z]{2,4})\.\n", "private void $1() { $1(); }\n")
    docs = spark.createDataFrame([(i, t, "es", "src9") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = [r.code for r in docs.select("doc_id", java_source().alias("code")).orderBy("doc_id").collect()]
    assert got == [body + "\n}\n" for body in values(plain, texts)]
