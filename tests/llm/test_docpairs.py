import pytest

from codeloom.llm.docpairs import doc_pairs, documented_symbols, linked_counts, symbol_table
from codeloom.llm.docpairs_text import documentation, lines_of, prose, worthwhile
from codeloom.llm.signatures import has_body, header, module_of, normal_signature

LONG = "Collects the open records of a page."


def doc(text, line, lang, end=None):
    lines = lines_of(text)
    return documentation(lines, line, end or len(lines), lang)[0]


@pytest.mark.parametrize(
    "text,line,lang,has",
    [
        (f'def f():\n    """{LONG}"""\n    return 1', 1, "python", True),
        (f"def f(\n    a: str = ')',\n    b={{'x': 1}},\n) -> dict[str, int]:\n    # note\n\n    r'''{LONG}'''\n    pass", 1, "python", True),
        (f'@deco("(")\nasync def f(): "{LONG}"', 1, "python", True),
        (f'def f():\n    x = 1\n    """{LONG}"""', 1, "python", False),
        (f'def f():\n    """{LONG}""".strip()', 1, "python", False),
        (f'def f():\n    f"""{LONG}"""', 1, "python", False),
        (f'def f():\n    b"{LONG}"', 1, "python", False),
        (f"# {LONG}\ndef f():\n    pass", 2, "python", False),
        (f'def f():\n    """{LONG}\n', 1, "python", False),
        (f"/** {LONG} */\nfunction f() {{}}", 2, "typescript", True),
        (f"/**\n * {LONG}\n */\n@traced()\n@other\nf() {{}}", 6, "java", True),
        (f"/**\n * {LONG}\n */\n\nfunction f() {{}}", 5, "javascript", False),
        (f"/** {LONG} */\n@a\n\nfunction f() {{}}", 4, "typescript", False),
        (f"/* {LONG} */\nfunction f() {{}}", 2, "javascript", False),
        (f"// {LONG}\nfunction f() {{}}", 2, "javascript", False),
        (f"let x = 1; /** {LONG} */\nfunction f() {{}}", 2, "javascript", False),
        (f"/** {LONG} */\n/* plain */\nfunction f() {{}}", 3, "javascript", False),
        ("/***/\nfunction f() {}", 2, "javascript", False),
        (f"/** {LONG} */\n@Anno(\n  value = 1\n)\nvoid f() {{}}", 5, "java", True),
        (f"/// {LONG}\n#[inline]\nfn f() {{}}", 3, "rust", True),
        (f"//// {LONG}\nfn f() {{}}", 2, "rust", False),
        (f"// {LONG}\nfn f() {{}}", 2, "rust", False),
        (f"//! {LONG}\nfn f() {{}}", 2, "rust", False),
        (f"/** {LONG} */\nfn f() {{}}", 2, "rust", True),
        (f"// {LONG}\nfunc F() {{}}", 2, "go", True),
        (f"/*\n{LONG}\n*/\nfunc F() {{}}", 4, "go", True),
        (f"// {LONG}\n//go:noinline\nfunc F() {{}}", 3, "go", True),
        ("//go:noinline\nfunc F() {}", 2, "go", False),
        (f"// {LONG}\n\n//go:noinline\nfunc F() {{}}", 4, "go", False),
        (f"﻿/** {LONG} */\r\nfunction f() {{}}\r\n", 2, "javascript", True),
        ("function f() {}", 1, "javascript", False),
        (f"/** {LONG} */\nfunction f() {{}}", 2, None, False),
        (f"/** {LONG} */\nfunction f() {{}}", 99, "javascript", False),
    ],
)
def test_own_documentation(text, line, lang, has):
    got = doc(text, line, lang)
    assert (got is not None) == has
    if has:
        assert LONG in got


def test_docstring_over_many_lines():
    body = "\n".join(f"    line {i}" for i in range(200))
    text = f'def f(\n{"".join(f"    a{i}=None," + chr(10) for i in range(60))}):\n    """{LONG}\n{body}\n    """\n    return 1'
    assert "line 199" in doc(text, 1, "python")


@pytest.mark.parametrize(
    "text,name,worth",
    [
        (LONG, "f", True), ("Short one.", "f", False), ("TODO: document this function", "f", False), ("Description goes here.", "f", False), ("No description provided.", "f", False),
        ("The load shared record function.", "loadSharedRecord", False), ("load_shared_record method.", "A.load_shared_record", False), ("Loads the shared record.", "loadSharedRecord", False),
        ("@param a\n@param b\n@returns", "f", False), ("@param a the record to start from, never null", "f", True), ("Args:\n    a:\n    b:\n\nReturns:", "f", False), ("Args:\n    a: the record that is read first\n", "f", True),
        ("{@inheritDoc}", "f", False), ("--------------------------------", "f", False), ("<p></p><br/><b></b>            ", "f", False), ("Проверка собирает новые символы перед сборкой.", "f", True), ("検査ツールは古い記号を次の実行までダウンロードする。", "f", True),
        ("", "f", False), (None, "f", False), (LONG, None, True), ("TODO: measure this once the queue is in place.", "f", True),
    ],
)
def test_worthwhile(text, name, worth):
    assert worthwhile(text, name) == worth


def test_prose():
    assert prose("A {@link Foo} of `x`.\n@return the answer") == "A Foo of x. the answer"
    assert worthwhile("Short one.", "f", least=5) and not worthwhile("Nothing to say about this.", "f", placeholders={"nothing to say about this"})
    assert not worthwhile("Loads records from the long queue.", "load_records", filler={"from", "the", "long", "queue"})


@pytest.mark.parametrize(
    "text,name,lang,kinds",
    [
        ("func f(a, b int) {", "f", "go", "int,int"), ("func f(a int, b int) (x, y error) {", "f", "go", "int,int"), ("func (s *Server) Get(id string) error {", "Server.Get", "go", "string"), ("func (s *Server) Put(n int)", "Server.Put", "go", "int"),
        ("func f(int, string)", "f", "go", "int,string"), ("func f(ch chan int, g func(a int) string, xs ...string) {", "f", "go", "chan int,func(a int)string,...string"), ("func F[T any](m map[K]T) T {", "F", "go", "map[K]T"),
        ("public int f(final Map<String, List<A>> m, int n) throws X {", "C.f", "java", "Map<String,List<A>>,int"), ("int f(int a[], String... b) {", "C.f", "java", "int[],String..."), ("@A(v = \")\") public <T extends Comparable<T>> void f(@NotNull T t, int[] x);", "C.f", "java", "T,int[]"),
        ("@Override\n@A(\n x = 1\n)\npublic void f(\n int a, // one (\n int b\n) {", "C.f", "java", "int,int"), ("def f(self, a: str = '(', b: int = 3, *args, k: 'Foo' = (1, 2), **kw) -> int:", "C.f", "python", "str,int,**,Foo,***"),
        ("@deco(\n  '('\n)\nasync def f(\n  a, # x\n  b=[1, 2],\n):\n    return", "f", "python", "*,*"), ("def f(self, a):", "f", "python", "*,*"), ("fn f<T: Into<(A, B)>>(&self, a: i64, mut b: Vec<(u8, i64)>) -> R<()> {", "X.f", "rust", "i64,Vec<(u8,i64)>"),
        ("export function f<T extends (a: X) => Y>(a: number, b?: string[], ...r: any[]): void;", "f", "typescript", "number,string[],...any[]"), ("export const f = async (a: number, {b}: {b: string}) => {", "f", "typescript", "number,{b:string}"), ("const f = x => x + 1", "f", "javascript", "*"),
        ("f(a, b = {x: ')'}, [c, d]) {", "C.f", "javascript", "*,*,*"), ("declare function f(cb: (e: Error) => void): { a: number };", "f", "typescript", "(e:Error)=>void"), ("", "f", "go", None), ("x", "x", "java", None), ("f()", None, None, ""),
    ],
)
def test_normal_signatures(text, name, lang, kinds):
    lines = lines_of(text)
    assert normal_signature(header(lines, 1, len(lines), lang), name, lang) == kinds


def test_headers_have_no_length_limit():
    lines = ["def f("] + [f"    parameter_{i}: int{i}," for i in range(500)] + ["):", "    return 1"]
    assert normal_signature(header(lines, 1, len(lines), "python"), "f", "python") == ",".join(f"int{i}" for i in range(500))


def test_bodies_and_modules():
    assert has_body("void f() {", "a.java", "java") and not has_body("void f();", "a.java", "java") and not has_body("func f(a int)", "a.go", "go") and not has_body("def f(a):", "a.pyi", "python")
    got = [module_of(p, x) for p, x in (("a/b.d.ts", "typescript"), ("a/b.js", "javascript"), ("a/b.pyi", "python"), ("a-stubs/b/__init__.py", "python"), ("a/b.go", "go"), ("a/mod.rs", "rust"), (None, None))]
    assert got == ["a/b", "a/b", "a/b", "a/b", "a", "a", ""]


def tables(spark):
    files = spark.createDataFrame([(1, "a.ts", None, "x"), (2, "b", "PY ", "x"), (3, "c.java", "java", "x")], "id long, path string, lang string, content string")
    text = f"/** {LONG} */\nexport function f(a: number): void;\nfunction g(a) {{\n}}\n"
    contents = spark.createDataFrame([(1, text), (2, f'def p(x):\n    """{LONG}"""\n'), (3, None)], "file_id long, content string")
    symbols = spark.createDataFrame(
        [
            (10, 1, "a.ts#f", "f", "function", None, 2, 2, "active"), (11, 1, "a.ts#g", "g", "function", "function g(", 3, 4, "active"), (12, 2, "b#p", "p", "function", "def p(", 1, 2, "Active "),
            (13, 2, "b#p", "p", "function", None, 1, 2, "deleted"), (14, 2, "b#C", "C", "class", None, 1, 2, "active"), (15, None, "n#n", "n", "function", None, 1, 1, "active"), (16, 2, "b#q", "q", "method", None, None, 2, "active"),
            (17, 2, "b#r", None, "method", None, 9, 2, "active"), (18, 3, "c#r", "r", "method", None, 1, 2, "active"),
        ],
        "id long, file_id long, key string, name string, kind string, signature string, start_line int, end_line int, status string",
    )
    return files, contents, symbols


def test_tables(spark):
    files, contents, symbols = tables(spark)
    assert sorted(r[0] for r in documented_symbols(files, contents, symbols).collect()) == [10, 12]
    pairs = {r["symbol_id"]: r for r in doc_pairs(files, contents, symbols).collect()}
    assert set(pairs) == {10, 12} and {r["doc_source"] for r in pairs.values()} == {"own"} and pairs[12]["signature"] == "def p(x):" and pairs[12]["code"].startswith("def p") and pairs[12]["lang"] == "python"
    assert {r["symbol_id"] for r in symbol_table(files, contents, symbols).collect()} == {10, 11, 12}
    assert documented_symbols(files, contents.limit(0), symbols).collect() == []


OTHER = "Waits until the queue has room for one more."


def linked(spark, sources):
    """doc_source and doc by key; sources: path -> (text, [(name, first line, last line)])."""
    files, contents, symbols = [], [], []
    for f, (path, (text, own)) in enumerate(sources.items(), 1):
        files.append((f, path, None))
        contents.append((f, text))
        symbols += [(100 * f + k, f, f"{path}#{name}", name, "method" if "." in name else "function", None, a, z, "active", "x") for k, (name, a, z) in enumerate(own)]
    args = [
        spark.createDataFrame(files, "id long, path string, lang string"), spark.createDataFrame(contents, "file_id long, content string"),
        spark.createDataFrame(symbols, "id long, file_id long, key string, name string, kind string, signature string, start_line int, end_line int, status string, doc string"),
    ]
    ids = {s[0]: s[2] for s in symbols}
    pairs = doc_pairs(*args).collect()
    found = {ids[r[0]] for r in documented_symbols(*args).collect()}
    either = {ids[r[0]] for r in documented_symbols(*args, own=False).collect()}
    got = {r["key"]: (r["doc_source"], " ".join(prose(r["doc"]).split())) for r in pairs}
    assert set(got) == either and {k for k, v in got.items() if v[0] == "own"} == found
    counts = {r["doc_source"]: r["n"] for r in linked_counts(*args).groupBy("doc_source").agg({"n_pairs": "sum"}).withColumnRenamed("sum(n_pairs)", "n").collect()}
    sources = [r["doc_source"] for r in pairs]
    assert counts == {x: sources.count(x) for x in sources}
    return got


def test_overloads_in_typescript(spark):
    declared = f"/** {LONG} */\nfunction f(a: number): void;\n/** {OTHER} */\nfunction f(a: string): void;\n"
    got = linked(spark, {"p/a.d.ts": (declared, [("f", 2, 2), ("f", 4, 4)]), "p/a.ts": ("function f(x: string) {\n  return 1;\n}\nfunction h() {\n}\n", [("f", 1, 3), ("h", 4, 5)]), "q/a.ts": ("function f(x: string) {\n}\n", [("f", 1, 2)])})
    assert got == {"p/a.d.ts#f": got["p/a.d.ts#f"], "p/a.ts#f": ("declaration", OTHER)}


def test_untyped_definitions_go_by_the_number_of_parameters(spark):
    stub = f'def f(a: int, b: str) -> int:\n    """{LONG}"""\ndef g(a: int) -> int:\n    """{OTHER}"""\ndef g(a: str) -> int:\n    """{LONG}"""\nclass C:\n    def m(self, x: int) -> None:\n        """{OTHER}"""\n'
    code = f'def f(a, b=""):\n    """TODO"""\n    return 1\ndef g(a):\n    return 2\nclass C:\n    def m(self, x):\n        return 3\ndef k(a):\n    """{LONG}"""\n    return 4\n'
    got = linked(spark, {"p/a.pyi": (stub, [("f", 1, 2), ("g", 3, 4), ("g", 5, 6), ("C.m", 8, 9)]), "p/a.py": (code, [("f", 1, 3), ("g", 4, 5), ("C.m", 7, 8), ("k", 9, 11)])})
    assert {k: v for k, v in got.items() if k.startswith("p/a.py#")} == {"p/a.py#f": ("declaration", LONG), "p/a.py#C.m": ("declaration", OTHER), "p/a.py#k": ("own", LONG)}


def test_go_declarations_of_the_package_and_receivers(spark):
    declared = f"package p\n// {LONG}\nfunc Sum(a, b int) int\n// {OTHER}\nfunc (s *Server) Get(id string) error\n"
    code = "package p\nfunc Sum(x int, y int) int {\n\treturn 1\n}\nfunc (s *Server) Get(n int) error {\n}\n"
    got = linked(spark, {"p/decl.go": (declared, [("Sum", 3, 3), ("Server.Get", 5, 5)]), "p/body_amd64.go": (code, [("Sum", 2, 4), ("Server.Get", 5, 6)]), "q/body.go": (code, [("Sum", 2, 4)])})
    assert {k: v for k, v in got.items() if "decl" not in k} == {"p/body_amd64.go#Sum": ("declaration", LONG)}


def test_a_trivial_declaration_lends_nothing_and_own_documentation_goes_first(spark):
    declared = f"/** TODO */\nfunction f(a: number): void;\n/** {LONG} */\nfunction g(a: number): void;\n"
    code = f"function f(a: number) {{\n}}\n/** {OTHER} */\nfunction g(a: number) {{\n}}\n"
    got = linked(spark, {"a.d.ts": (declared, [("f", 2, 2), ("g", 4, 4)]), "a.ts": (code, [("f", 1, 2), ("g", 4, 5)])})
    assert got == {"a.d.ts#g": ("own", LONG), "a.ts#g": ("own", OTHER)}
