"""Declarations of C++ and Java files, and the chunks made of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.symbols import plain_signature, scan
from tessera.operators import code
from tessera.operators.chunking import Budget, word_spans

CPP = {
    "class Low { int field = f(1); static const int k{2}; void go(int a = g(3)); };": ["class Low", "method Low::go"],
    "template <class T, int N = (1 > 0)> struct Vec<T*> : Base<T> { Vec() : a{1}, b(2) { x(); } ~Vec(); };": ["struct Vec<T*>", "method Vec<T*>::Vec", "method Vec<T*>::~Vec"],
    "struct S { bool operator==(const S& o) const { return f({}); } int operator()(int x); explicit operator bool() const; };": ["struct S", "method S::operator==", "method S::operator()", "method S::operator bool"],
    "enum class E : int { A, B = (1) }; enum { X }; struct Ahead; struct Ahead value; union U { int u; };": ["enum E", "struct Ahead"],
    'extern "C" { int in_c(void); } extern "C" int one(char);': ["function in_c", "function one"],
    "namespace { int hidden(int) { return 1; } } namespace alias = a::b; inline namespace v2 { void late(); }": ["function hidden", "namespace v2", "function v2::late"],
    "auto f = [](int x) { return x; }; int list[] = {1, f(2)}; int q(5); typedef int (*fp)(int); using Z = int(int); call(x);": [],
    "struct S make(int) { return {}; } std::map<int, std::vector<int>> w::W<int>::get() const noexcept { return {}; }": ["function make", "function w::W<int>::get"],
    "class EXPORT Big final : public P { friend class Q; virtual void pv() = 0; Big(Big&&) = default; public slots: void s(); };": ["class Big", "class Big::Q", "method Big::pv", "method Big::Big", "method Big::s"],
    "const char* s = \"};{\"; char c = '{'; auto r = R\"x( } )x\"; // {\n#define B { \\\n }\nvoid after() {}": ["function after"],
    "namespace n { class A { void f(int); }; }\nvoid n::A::f(int value) {}\nint n::g() { class Local { void no(); }; return 0; }": ["namespace n", "class n::A", "method n::A::f", "function n::g"],
}
JAVA = {
    "package a.b; /* } */ @Ann(v = {1}) public final class J<T extends K> extends L implements M { int[] g = {1}; Runnable r = () -> { run(); }; static { init(); } { inst(); } J() { super(); } }": ["package a.b", "class a.b::J", "method a.b::J::J"],
    "enum E { A, B(1) { int x() { return 1; } }, C; int n() { return 0; } E(int i) {} }": ["enum E", "method E::n", "method E::E"],
    'class K { @Override public <U> Map<U, T> go(U t, @Nn int... q) throws X, Z { for (;;) {} } String s = """ } """; abstract int size(); record R(int a) { int b() { return a; } } }': ["class K", "method K::go", "method K::size", "method K::b"],
    "interface In { default void d() {} void e(); } @interface An { int v() default 1; } class After {}": ["interface In", "method In::d", "method In::e", "class After"],
}


@pytest.mark.parametrize(("language", "text", "want"), [("cpp", *x) for x in CPP.items()] + [("java", *x) for x in JAVA.items()])
def test_declarations(language, text, want):
    found, partial = scan(language, text)
    assert [f"{x.symbol_type} {x.qualified_name}" for x in found] == want and not partial


def test_parents_overloads_and_comments():
    text = "// above\n// it\nnamespace n {\n\n/* docs */\nvoid f(int a);\nvoid f(double);\nvoid f(int b) {\n}\n}\n"
    found, _ = scan("cpp", text)
    assert [(x.name, x.signature, x.parent, x.line_start, x.line_end, x.comment, x.overloaded) for x in found] == [
        ("n", "namespace n", None, 1, 10, "// above\n// it", False), ("f", "void f(double);", "n", 7, 7, "", True), ("f", "void f(int b)", "n", 8, 9, "", True),
    ]
    assert plain_signature("void n::A::f(int value, char c)") == plain_signature("void f( int , char )") == "voidf(int,char)"


@pytest.mark.parametrize("text", ["class A { void f( {\n", "void f() {", "int x = 1; /* no end", 'char* s = "\n;', "}", "void f() )"])
def test_broken_files_are_partial(text):
    assert scan("cpp", text)[1]


def test_any_text_is_read_without_error():
    rng = random.Random(4)
    words = ["class", "A", "B", "{", "}", "(", ")", ";", "::", "<", ">", "~", "operator", "template", "namespace", "=", ":", ",", "enum", "friend", "@", "int", '"', "'", "/*", "\n", "[", "]", "package", "extern", '"C"']
    for _ in range(4000):
        text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        for language in ("cpp", "java"):
            for x in scan(language, text)[0]:
                assert x.name and 1 <= x.line_start <= x.line_end <= text.count("\n") + 1 and text[x.start : x.end]


def test_long_files_take_linear_time():
    text = "void f(int a) { g({1}); }\n" * 20_000 + "int x = {1}, y = {2}" + ", z = {3}" * 20_000 + ";\n" + "a : " * 50_000
    assert len(scan("cpp", text)[0]) == 1


def test_chunks_of_symbols(spark):
    budget = Budget(hard=60, lines=8, repeat=2)
    body = "".join(f"  x{i} += {i};\n" for i in range(30))
    files = [("r", "a/b.cpp", f"class A {{\n  void f();\n  void g();\n}};\n// long\nvoid A::f() {{\n{body}}}\n"), ("r", "c.h", "\n".join(f"int v{i} = {i};" for i in range(20))), ("r", "d.py", "def f(): pass"), ("r", "e.java", None), ("r", "f.java", "")]
    read = code.read_symbols(code.git_documents(spark.createDataFrame(files, "repo string, path string, text string"), "main", "c"), budget)
    symbols = {r.qualified_name: r for r in code.git_symbols(read, "now").collect()}
    chunks = code.symbol_chunks(read).orderBy("file_path", "part_index").collect()
    assert set(symbols) == {"A", "A::f", "A::g"} and symbols["A::f"].parent_symbol == "A" and symbols["A::f"].line_start == 5
    assert {c.chunk_id for c in chunks} >= {s.chunk_id for s in symbols.values()}
    assert next(c.text for c in chunks if c.symbol == "A") == "// r · a/b.cpp · A\n\nclass A\nvoid g();\nvoid A::f()"
    parts = [c for c in chunks if c.symbol == "A::f"]
    assert len(parts) > 3 and [c.part_index for c in parts] == list(range(len(parts))) and {c.part_total for c in parts} == {len(parts)}
    assert all(c.text.startswith("// r · a/b.cpp · A::f\n\n// long\n\n") and len(word_spans(c.text)) == c.token_count <= budget.hard for c in parts)
    assert parts[0].line_start == 6 and parts[-1].line_end == 37 and all(b.line_start == a.line_end - 1 for a, b in zip(parts, parts[1:], strict=False))
    windows = [c for c in chunks if c.content_kind == "code_window" and c.file_path == "c.h"]
    assert [(c.line_start, c.line_end) for c in windows] == [(1, 8), (7, 14), (13, 20)]
    assert [c.text for c in chunks if c.file_path == "f.java"] == ["// r · f.java"]
    assert code.symbol_metrics(read).collect()[0].asDict() == {"files": 3, "symbols": 3, "chunks": len(chunks), "partial": 0, "fallback": 2, "cut_parts": len(parts)}


def test_files_of_one_partition_are_read_in_many_tasks(spark):
    files = spark.createDataFrame([("r", f"a{i}.cpp", f"class C{i} {{ void go(); }};") for i in range(64)], "repo string, path string, text string").coalesce(1)
    read = code.read_symbols(code.git_documents(files, "main", "c"))
    assert sum(read.rdd.mapPartitions(lambda p: [any(True for _ in p)]).collect()) > 1
    assert code.git_symbols(read, "now").count() == 128


def test_opening_chunks_are_found_in_their_file(spark):
    """Those that a join by id gives, for cut symbols, equal names and files without symbols too; without any join."""
    texts = [
        "namespace n {\nclass A { void f(); };\nvoid A::f() {\n" + "  x += 1;\n" * 40 + "}\n}\n", "int x = 1;\n" * 30, "class B { int a(); }; class B { int a(); };", "",
        "class C {\n" + "".join(f"  void some_function_{i}(int first, int second);\n" for i in range(30)) + "};\n", "struct S { void g(); }; void broken( {",
    ]
    files = spark.createDataFrame([("r", f"f{i}.cpp", t) for i, t in enumerate(texts)], "repo string, path string, text string")
    read = code.read_symbols(code.git_documents(files, "b", "c"), Budget(target=60, hard=120, lines=12, repeat=3)).cache()
    for kinds in (("namespace", "class"), ("method",), ("struct", "class", "method", "function", "namespace")):
        wanted = code.git_symbols(read, "now").where(F.col("symbol_type").isin(*kinds)).select("chunk_id")
        want = sorted(map(repr, code.symbol_chunks(read).join(wanted, "chunk_id", "left_semi").select("chunk_id", "file_path", "text").collect()))
        made = code.opening_chunks(read, kinds)
        assert want and sorted(map(repr, made.select("chunk_id", "file_path", "text").collect())) == want
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
