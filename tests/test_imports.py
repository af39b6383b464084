"""Import statements and where they lead, case by case."""

from pyspark.sql import functions as F

from codeloom.operators import resolve

TEXTS = {
    "a.ts": "import x, { y } from './b';\nimport {\n  z,\n} from \"./c\";\nimport './side';\nexport * from '../d';\nconst e = require('e');\nawait import('./f');\nlet s = 'plain';\n",
    "a.py": "import os\nimport a.b as c\nfrom . import x\nfrom ..p.q import (\n  r,\n)\n    from .late import y\nfrom here on this is prose\n",
    "a.go": 'package a\nimport "fmt"\nimport (\n\t"m/x"\n\talias "m/y" // c\n\n\t_ "m/z"\n)\n',
    "a.rs": "use crate::a::B;\npub use self::c::{d, e};\nuse super::f;\nmod g;\npub(crate) mod h;\nmod inline { }\n",
    "A.java": "import a.b.C;\nimport static a.b.D.m;\nimport a.e.*;\nclass A {}\n",
    "a.md": "import x from './b';\n",
}


def frame(spark, texts):
    files = spark.createDataFrame([(i, p, "active") for i, p in enumerate(texts)], "id long, path string, status string")
    return files, spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "file_id long, content string")


def test_statements(spark):
    files, contents = frame(spark, TEXTS)
    got = {}
    for r in resolve.imports(files, contents).collect():
        got.setdefault(r["path"], set()).add(r["specifier"])
    assert got == {
        "a.ts": {"./b", "./c", "./side", "../d", "e", "./f"}, "a.py": {"os", "a.b", ".", "..p.q", ".late"}, "a.go": {"fmt", "m/x", "m/y", "m/z"},
        "a.rs": {"crate::a::B", "self::c", "super::f", "self::g", "self::h"}, "A.java": {"a.b.C", "a.b.D.m", "a.e"},
    }


def edges(spark, paths, asked, **more):
    files = spark.createDataFrame([(p, "active") for p in paths] + [("gone.ts", "deleted")], "path string, status string")
    found = spark.createDataFrame([(p, resolve.FAMILY[p.rsplit(".", 1)[1]], s) for p, s in asked], "path string, family string, specifier string")
    return {(r["from_file"], r["specifier"], r["to_file"]) for r in resolve.resolve_imports(found, files, **more).collect()}


def test_relative_scripts(spark):
    paths = ["a/x.ts", "a/b.ts", "a/c/index.ts", "d.tsx", "a/e.js", "a/e.ts"]
    got = edges(spark, paths, [("a/x.ts", s) for s in ("./b", "./b.js", "./c", "../d", "../d.js", "./e", "./e.js", "./x", "./none", "../../up", "react", "./../gone")])
    assert {(s, t) for _, s, t in got} == {("./b", "a/b.ts"), ("./b.js", "a/b.ts"), ("./c", "a/c/index.ts"), ("../d", "d.tsx"), ("../d.js", "d.tsx"), ("./e", "a/e.ts"), ("./e.js", "a/e.js")}


def test_python_rust_and_java(spark):
    paths = ["p/a.py", "p/q/__init__.py", "p/b.py", "top.py", "src/deep.py", "src/lib.rs", "src/net.rs", "src/net/tcp.rs", "src/util/mod.rs", "src/main/java/a/b/C.java", "src/main/java/a/b/D.java", "x/Y.java"]
    got = edges(spark, paths, [("p/a.py", s) for s in (".b", ".q", "..top", "top", "p.b", "deep", "os")])
    assert {(s, t) for _, s, t in got} == {(".b", "p/b.py"), (".q", "p/q/__init__.py"), ("..top", "top.py"), ("top", "top.py"), ("p.b", "p/b.py"), ("deep", "src/deep.py")}
    asked = [("src/lib.rs", "crate::net::tcp::Stream"), ("src/lib.rs", "self::net"), ("src/net.rs", "self::tcp"), ("src/net/tcp.rs", "super::super::util::f"), ("src/net/tcp.rs", "crate::util"), ("src/net.rs", "std::io"), ("src/net.rs", "crate::none")]
    assert edges(spark, paths, asked) == {("src/lib.rs", "crate::net::tcp::Stream", "src/net/tcp.rs"), ("src/lib.rs", "self::net", "src/net.rs"), ("src/net.rs", "self::tcp", "src/net/tcp.rs"), ("src/net/tcp.rs", "super::super::util::f", "src/util/mod.rs"), ("src/net/tcp.rs", "crate::util", "src/util/mod.rs")}
    got = edges(spark, paths, [("x/Y.java", s) for s in ("a.b.C", "a.b.C.m", "a.b", "java.util.List")])
    assert {(s, t) for _, s, t in got} == {(s, f"src/main/java/a/b/{n}.java") for s in ("a.b.C", "a.b.C.m", "a.b") for n in "CD"}


def test_repositories_packages_and_modules(spark):
    texts = [
        ("pnpm-workspace.yaml", "packages:\n  # ours\n  - 'packages/*'\n  - \"tools/cli\"\n  - '!packages/no'\n  - 'deep/**'\nother:\n  - x/*\n"), ("package.json", '{"workspaces": ["elsewhere/*"]}'), ("packages/core/package.json", '{"name": "@w/core", "main": "./dist/index.js"}'),
        ("packages/core/sub/package.json", '{"name": "@w/sub"}'), ("tools/cli/package.json", '{"name": "cli"}'), ("elsewhere/e/package.json", '{"name": "e"}'), ("deep/a/package.json", '{"name": "deep"}'), ("go.mod", "module example.com/m\n\ngo 1.22\n"), ("packages/x/package.json", "not json"),
    ]
    t = spark.createDataFrame(texts, "path string, content string")
    packages, modules = resolve.workspace_packages(t), resolve.go_modules(t)
    assert {tuple(r) for r in packages.collect()} == {("@w/core", "packages/core", "./dist/index.js"), ("cli", "tools/cli", None)}
    assert {tuple(r) for r in resolve.workspace_packages(t.where("path <> 'pnpm-workspace.yaml'")).collect()} == {("e", "elsewhere/e", None)} and [tuple(r) for r in modules.collect()] == [("example.com/m", "")]
    assert resolve.workspace_packages(t.limit(0)).collect() == []
    paths = ["packages/core/dist/index.ts", "packages/core/util.ts", "tools/cli/src/index.ts", "app.ts", "main.go", "net/a.go", "net/b.go", "net/sub/c.go"]
    got = edges(spark, paths, [("app.ts", s) for s in ("@w/core", "@w/core/util", "cli", "react", "@w/corex")] + [("main.go", s) for s in ("example.com/m/net", "fmt", "example.com/mx", "example.com/m")], packages=packages, modules=modules)
    assert got == {("app.ts", "@w/core", "packages/core/dist/index.ts"), ("app.ts", "@w/core/util", "packages/core/util.ts"), ("app.ts", "cli", "tools/cli/src/index.ts"), ("main.go", "example.com/m/net", "net/a.go"), ("main.go", "example.com/m/net", "net/b.go")}
    got = edges(spark, ["r/one/src/a.rs", "r/one/src/b.rs", "r/two/src/b.rs"], [("r/one/src/a.rs", "crate::b")], repo=F.substring_index("path", "/", 2))
    assert got == {("r/one/src/a.rs", "crate::b", "r/one/src/b.rs")}
