"""Typed tokens and rules that read code."""

import pytest
from pyspark.sql import functions as F

from sparquill.functions import analysis as A
from sparquill.functions.code_tokens import tokenize, typed_tokens

CASES = [
    ("python", "def scale(v, by=2):\n    return by * v", "[FUNCDEF]scale [IDENTIFIER]by [IDENTIFIER]v [VARDECL]by [VARDECL]v"),
    ("python", "class B(A):\n    @property\n    def n(self):\n        return self._n", "[CALL]property [CLASS]B [FUNCDEF]n [IDENTIFIER]A [IDENTIFIER]_n [IDENTIFIER]self [VARDECL]self"),
    ("python", "from a.b import c as d\nimport os, sys", "[MODULE]a.b [PKG]d [PKG]os [PKG]sys"),
    ("python", 'v = f"{w}"\nraise ValueError("x")', "[IDENTIFIER]w [VARDECL]v"),
    ("python", "try:\n    go()\nexcept Exception as e:\n    pass", "[CALL]go [IDENTIFIER]e"),
    ("java", "interface D { void draw(); }", "[CLASS]D [FUNCDECL]draw"),
    ("java", "static long join(long p, Key q) { return Util.both(p, q); }", "[CALL]both [FUNCDEF]join [IDENTIFIER]Util [IDENTIFIER]p [IDENTIFIER]q [VARDECL]p [VARDECL]q"),
    ("java", "import com.x.Y;", "[PKG]com.x.Y"),
    ("java", "List<String> l = new ArrayList<>(); l.add(x);", "[CALL]add [IDENTIFIER]l [IDENTIFIER]x [OBJECTCREATION]ArrayList<> [VARDECL]l"),
    ("cpp", "struct P { int x; };", "[CLASS]P [VARDECL]x"),
    ("cpp", "void A::go(int n) { run(n); }", "[CALL]run [FUNCDEF]A::go [FUNCDEF]go [IDENTIFIER]n [VARDECL]n"),
    ("solidity", "contract C { function f(uint a) public { x.push(a); } }", "[CALL]x.push [CLASS]C [FUNCDEF]f [IDENTIFIER]a [VARDECL]a"),
    ("xml", '<mapper><select id="one">q</select><p id="two"/></mapper>', "[FUNCDEF]one"),
    ("text", "un été x_1", "un x_1"),
]


@pytest.mark.parametrize("language,code,want", CASES)
def test_tokens(language, code, want):
    assert sorted(f"[{t}]{n}" if t else n for t, n, _, _ in typed_tokens(code, language)) == sorted(want.split(" "))


def test_positions_are_bytes(spark):
    df = spark.createDataFrame([(1, "é = 1\nf(é)", "python"), (2, None, "python"), (3, "", "java")], "doc_id long, text string, programming_language string")
    assert [(r.token, r.line, r.col) for r in tokenize(df).orderBy("line", "col").collect()] == [("[VARDECL]é", 0, 0), ("[CALL]f", 1, 0), ("[IDENTIFIER]é", 1, 2)]


def test_rules():
    assert A.base_class_name("a::b::C<D, E<F, G>>") == {"namespaces": ["a", "b"], "base_class_name": "C", "type_arguments": ["D", "E<F, G>"]}
    assert A.call_name("ns::make<int, F<X>>(1)") == {"base_name": "make", "type_arguments": ["int", "F<X>"]}
    assert A.definition_name("template<class T>\nT Box<T>::get() const { return x; }") == "get"
    assert A.definition_name("async def run(x):\n    pass") == "run"
    assert A.substitute("Pair<P, Q>", {"P": "Q", "Q": "int"}) == "Pair<Q, int>"
    assert A.type_parameters("map<K, vector<T>>") == ["K", "T"]
    assert A.element_type("std::map<string, vector<int>>") == "vector<int>"
    assert A.element_type("mapping(address => uint)") == "uint"
    assert A.element_type("int[3]") == "int"
    assert A.is_chained("a.b().c()") and not A.is_chained("a.b()")
    assert [s["kind"] for s in A.segments("a + f(b - 1) * 2")] == ["identifier", "function_call", "literal"]
    assert A.latest_assignment("1: x = 1\n2: y = 3\n3: x = y + 2;", "x") == {"expression": "y + 2", "line": 3}
    assert A.detect_language("pragma solidity ^0.8; contract C { mapping(address => uint256) b; }")["language"] == "solidity"
    assert A.detect_language("  ")["language"] == "unknown"
    assert A.class_body("x\nclass A {\n int f() { return 1; }\n};\n", "A") == "class A {\n int f() { return 1; }\n}"
    assert A.template_parameters("template <typename T, int N> class A {}") == ["T", "N"]
    fields = A.member_variables("class A { public: static const int n = 3; private: std::string s; void f(); };")
    assert [(f["name"], f["type"], f["access"], f["default_value"], f["is_static"], f["is_const"]) for f in fields] == [("n", "int", "public", "3", True, True), ("s", "std::string", "private", None, False, False)]


def test_calls_and_headers():
    got = A.call_expressions('3: int f() { return a->b(x, "g(") + c(); } // d()\n4: new E(1);')
    assert [(c["call_expr"], c["line_number"]) for c in got][1:] == [('a->b(x, "g(")', 3), ("c()", 3), ("new E(1)", 4)]
    kinds = {c: A.call_kind(c)["call_type"] for c in ("a.b()", "A::b()", "A::A()", "f<int>(x)", "new B(1)", "~B()", "go()", "operator()()")}
    assert list(kinds.values()) == ["member_method", "static_method", "constructor", "template_function", "constructor", "destructor", "function", "call_operator"]
    assert A.call_kind("ns::A::b(1)")["qualified_names"] == ["ns::A::b", "b"]
    assert A.declared_type("const std::vector<int>& v = x;\nint n;", "v") == "const std::vector<int>&"
    assert A.declared_type("b = Box(1)\nx: int = 3\ns = 'a'", "b") == "Box" and A.declared_type("x: int = 3", "x") == "int" and A.declared_type("s = 'a'", "s") == "string"
    assert A.declared_type("y = 1", "zz") is None
    assert A.function_types("def f(self, a: int, b: dict[str, int] = None) -> list[str]:") == {"parameter_types": ["int", "dict[str, int]"], "return_types": ["list[str]"]}
    assert A.function_types("public static Map<K, V> go(final List<T> xs, int n) {") == {"parameter_types": ["final List<T>", "int"], "return_types": ["Map<K, V>"]}
    assert A.function_types("function g(uint a, address b) public returns (bool ok, uint) {") == {"parameter_types": ["uint", "address"], "return_types": ["bool", "uint"]}
    body = "class A {\npublic:\n  A(int n) : n_(n) {}\n  ~A();\n  static int make(int k) { return k; }\n  int n_;\n};"
    assert [(f["name"], f["kind"], f["is_complete"]) for f in A.member_functions(body)] == [("A", "constructor", True), ("~A", "destructor", False), ("make", "static_method", True)]


def test_builtin_types(spark):
    from sparquill.operators.callgraph import builtin_types

    df = spark.createDataFrame([("String", "size"), (None, "len"), ("x", "len"), (None, None)], "container string, function string")
    assert [r.return_type for r in builtin_types(df).orderBy("container", "function").collect()] == [None, "int", "size_t", None]


@pytest.mark.parametrize("name", sorted(A.RULES))
def test_rules_as_udfs(spark, name):
    df = spark.createDataFrame([("a::B<C>(1)",), ("",), (None,)], "x string")
    assert df.select(A.as_udf(name)(F.col("x"))).count() == 3


def test_resolution():
    from sparquill.functions import resolution as R

    box = "template <typename T>\nclass Box {\npublic:\n  Box(T v) : v_(v) {}\n  T get() const { return v_; }\n  Box<T>* next() { return n_; }\n  int operator()(int k) { return k; }\n  T v_;\n  Box<T>* n_;\n};"
    lib = {"Box": box}
    given = {"b": "Box<std::string>", "m": "map<int, vector<Box<int>>>", "p": "std::unique_ptr<Box<long>>"}
    f = {"make": "Box<char> make(int n) { return Box<char>(n); }"}
    info = lambda e: R.callee_info(e, given, lib, f)
    assert info("b.next()->get()")["return_type"] == "std::string"
    assert info("b.get().size()")["return_type"] == "size_t"
    assert info("p->get()")["return_type"] == "long" and info("make(1).get()")["return_type"] == "char"
    assert info("m[1]")["return_type"] == "vector<Box<int>>" and info("m.at(1).front().get()")["return_type"] == "int"
    assert info("b.v_")["return_type"] == "std::string" and info("b.nothing()") is None and info("who()") is None
    assert info("Box<int>(3).next()")["return_type"] == "Box<int>*"
    assert "operator()" in R.call_operator(box) and R.constructor(box, "Box").startswith("Box(T v)")
    assert R.call_operator("class A:\n    def __call__(self):\n        return 1\n    def g(self): pass") == "def __call__(self):\n        return 1"
    assert R.header_names("void ns::A<int>::run(int x)") == {"full_name": "ns::A::run", "short_name": "run"}
    assert R.locate("4: x\n5: f( a,b )", "f(a, b)") == (5, "f( a,b )") and R.locate("1: x", "") is None
    assert R.nearest_definition([{"line": 3}, {"line": 9}], 8) == {"line": 9} and R.nearest_definition([], 1) is None
    kind = lambda e: R.expression_type(e, given, lib, f)
    assert [kind(e) for e in ("1 + 2.5", '"a" + b.get()', "1 == 2", "p->get()", "3", "zz")] == ["float", "string", "boolean", "long", "integer", None]
