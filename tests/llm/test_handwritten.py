import random

import pytest

from codeloom.llm.handwritten import unwritten_files
from codeloom.llm.rules import judge

PERSON = "import { a } from './a';\n\n/** Reads the records of a page and keeps the first. */\nexport function read(page) {\n  const rows = load(page);\n  if (rows.length > 3) {\n    return rows[0];\n  }\n  return null;\n}\n"
ACCESSORS = "".join(f"export function getThing{i}(m) {{\n  return m.f{i};\n}}\n\n" for i in range(1, 9))
MIN = "".join(f"function {c}(a,b){{return a+b*{i}}}var {c}=a?b:{i};" for i, c in enumerate("abcdefghij")) * 3


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("src/a.js", PERSON, None), ("src/admin.js", PERSON, None), ("src/vendors.py", PERSON, None), ("src/generators/a.js", PERSON, None), ("src/a.js", "// Code generated by tool v1. DO NOT EDIT.\n" + PERSON, "generated"),
        ("src/a.js", "// Licence line\n\n/* @generated from a.idl */\n" + PERSON, "generated"), ("src/a.js", PERSON + "\nconst BANNER = 'Code generated by tool. DO NOT EDIT.';\n", None), ("src/a.js", PERSON + "// Code generated by tool. DO NOT EDIT.\n", None),
        ("src/a.js", "// Detects minified and vendored files.\n" + PERSON, None), ("src/a.js", "// The template below ends up in auto-generated files, this one is written by hand.\n" + PERSON, None), ("src/a.js", "// Compares generated output with the accepted one.\n" + PERSON, None),
        ("src/a.js", "// Writes the generated page; do not edit the page by hand while it runs.\n" + PERSON, None), ("src/a.js", ACCESSORS, "generated"), ("src/a.js", "".join(f"export * from './part{i}';\n" for i in range(20)), None), ("src/a.py", "".join(f"case({i}, 'x')\ncheck({i * 7})\n" for i in range(9)), "generated"), ("src/a.js", "// This module checks that\n// generated by nobody is what it says, so look\n" + PERSON, None),
        ("src/a.js", "// Reads what was written by the pipeline, never changes it.\n" + PERSON, None), ("src/a.js", "/*\n * Licence.\n * DO NOT EDIT\n */\n" + PERSON, "generated"), ("src/a.py", "# Diese Datei wurde automatisch erzeugt (x), bitte nicht bearbeiten.\nx = 1\n", "generated"), ("src/a.js", PERSON + ACCESSORS[:60] + "\n}\n", None), ("gen/a.js", PERSON, "generated"), ("src/a_pb2.py", "x = 1\n", "generated"),
        ("src/a.js", MIN, "minified"), ("src/a.js", "// " + "long words of a comment " * 60 + "\n" + PERSON, None), ("src/a.py", MIN, None), ("src/a.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n' + PERSON + "//# sourceMappingURL=a.js.map\n", "compiled"),
        ("src/a.js", '"use strict";\n' + PERSON, None), ("src/a.py", "DATA = (\n" + "    12, 4353, 0x1f, 99.5,\n" * 60 + ")\n", "data"), ("src/a.py", "DATA = (1, 2, 3)\n", None), ("src/a.ts", "export const d = [\n" + '    {"w": 12, "k": "abc"},\n' * 60 + "];\n", "data"), ("src/a.js", "", None), ("src/a.js", None, None),
    ],
)
def test_rules(path, text, kind):
    assert judge(path, path.rsplit(".", 1)[-1], text) == kind


def source(rng, n=40):
    return "\n".join(f"value_{rng.randrange(10**9)} = compute_{rng.randrange(10**9)}(x)" for _ in range(n))


def test_copies_edited_copies_and_hot_groups(spark):
    rng = random.Random(2)
    catalog = [source(rng) for _ in range(4)]
    other = source(rng)
    rows, files = [], []

    def add(i, path, text):
        files.append((i, path, "x", "y"))
        rows.append((i, text))

    for i in range(60):  # one third of all files are edited copies of one package
        lines = catalog[0].split("\n")
        lines[rng.randrange(len(lines))] = f"edited_{i} = changed_line_number(x)"
        add(i, f"apps/r{i}/src/a.py", "\r\n".join(lines))
    for i in range(100, 220):
        add(i, f"apps/r{i}/src/b.py", source(rng) + "\n" + "\n".join(catalog[1].split("\n")[:4]))
    add(300, "apps/q/vendor/lib/c.py", other)
    add(301, "apps/z/src/c.py", other + "\nmore_of_my_own = 1\n")
    add(302, "apps/q/src/c.py", other)  # the same repository's own file, of which the vendor folder has a copy
    add(303, "apps/q/vendor/readme.md", "prose")
    add(304, "apps/q/Third_Party/x.py", "x = 1")
    add(305, "apps/q/src/e.py", "")
    f = spark.createDataFrame(files, "id long, path string, lang string, content string")
    c = spark.createDataFrame([*rows, (999, "no such file"), (998, None)], "file_id long, content string")
    v = spark.createDataFrame([("p", t) for t in catalog], "package_name string, content string")
    got = {r["file_id"]: r["reason"] for r in unwritten_files(f, c, v).collect()}
    assert got == {**{i: "vendored" for i in range(60)}, 300: "vendored", 301: "vendored", 304: "vendored"}
    assert unwritten_files(f.limit(0), c.limit(0), v.limit(0)).collect() == []


@pytest.mark.parametrize("in_catalog", [True, False])
def test_package_in_twenty_edited_vendor_copies(spark, in_catalog):
    rng = random.Random(7)
    package = source(rng).split("\n")
    common = [f"from __future__ import feature_{k}" for k in range(3)]
    files, rows = [], []

    def add(i, path, lines):
        files.append((i, path))
        rows.append((i, "\n".join(lines)))

    def edited(i):
        lines = package[:]
        lines[rng.randrange(len(lines))] = f"edited_{i} = changed_line_number(x)"
        return lines if i % 2 else lines[::-1]

    for i in range(20):
        add(i, f"apps/r{i}/vendor/lib/a.py", edited(i))
    for i in range(100, 105):
        add(i, f"apps/s{i}/src/a.py", edited(i))
    for i in range(200, 220):  # unrelated packages that have nothing but common lines with each other
        add(i, f"apps/r{i}/vendor/lib/b.py", common + source(rng).split("\n"))
    add(300, "apps/t/src/c.py", common + ["one_line_of_my_own = 1"])
    f = spark.createDataFrame(files, "id long, path string")
    c = spark.createDataFrame(rows, "file_id long, content string")
    v = spark.createDataFrame([("p", "\n".join(package))] if in_catalog else [], "package_name string, content string")
    got = {r["file_id"] for r in unwritten_files(f, c, v).where("reason = 'vendored'").collect()}
    assert got == {*range(20), *range(100, 105), *range(200, 220)}


@pytest.mark.parametrize("versions,in_catalog", [(12, True), (50, True), (50, False)])
def test_nothing_contained_is_lost(spark, versions, in_catalog):
    """A package with many versions, and every copy that exact containment over all lines finds, for all files by all references."""
    rng = random.Random(versions)
    lines = source(rng, 60).split("\n")
    made = []
    for v in range(versions):  # each version changes two lines of the one before
        lines = lines[:]
        for _ in range(2):
            lines[rng.randrange(len(lines))] = f"version_{v}_{rng.randrange(10**6)} = changed_line_number(x)"
        made.append(lines)
    boiler = [f"from __future__ import feature_{k}" for k in range(6)]
    others = [boiler + source(rng, 20).split("\n") for _ in range(30)]
    files = [(i, f"apps/v{i}/vendor/p.py", x) for i, x in enumerate(made if not in_catalog else [])] + [(100 + i, f"apps/u{i}/vendor/q.py", x) for i, x in enumerate(others)]
    for i in range(80):
        k = rng.randrange(len(made))
        mine = rng.sample(made[k], rng.randrange(20, 61)) + [f"own_{i}_{j} = something_else(x)" for j in range(rng.randrange(0, 30))]
        files.append((1000 + i, f"apps/w{i}/src/a.py", mine))
    files.append((2000, "apps/w/src/b.py", boiler))  # nothing but lines that everybody has, all of them in one reference
    files.append((2001, "apps/w/src/c.py", boiler + [f"mine_{k} = value_of(x)" for k in range(2)]))
    references = [("", set(x)) for x in (made if in_catalog else [])] + [(p.split("/")[1], set(x)) for _, p, x in files if "/vendor/" in p]
    want = {}
    for i, p, x in files:
        shares = [len(set(x) & r) / len(set(x)) for home, r in references if home != p.split("/")[1]]
        need = 0.9 if set(x) <= {*boiler, "mine_0 = value_of(x)", "mine_1 = value_of(x)"} else 0.6
        if max(shares) >= need:
            want[i] = round(max(shares), 6)
    f = spark.createDataFrame([(i, p) for i, p, _ in files], "id long, path string")
    c = spark.createDataFrame([(i, "\n".join(x)) for i, _, x in files], "file_id long, content string")
    v = spark.createDataFrame([("\n".join(x),) for x in (made if in_catalog else [])], "content string")
    got = {r["file_id"]: round(r["containment"], 6) for r in unwritten_files(f, c, v).where("containment is not null").collect()}
    assert got == want and 2000 in want and 2001 not in want and len(want) > 30


BANNER = "/*!\n" + " * Permission is granted to use, copy and change this software for any purpose.\n" * 120 + " */\n"
MODULE = '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n'
HELPER = "var __importDefault = (this && this.__importDefault) || function (mod) {\n" + "    // keeps the default\n" * 30 + "    return mod;\n};\n"


@pytest.mark.parametrize(
    "text,kind",
    [
        (BANNER + MODULE + PERSON, "compiled"), (BANNER.replace("/*!", "//").replace(" */", "//").replace(" *", "//") + MODULE + PERSON, "compiled"), (MODULE.replace("\n", "\n" + HELPER, 1) + PERSON, "compiled"),
        (BANNER + "// Code generated by tool. DO NOT EDIT.\n" + PERSON, "generated"), (BANNER + PERSON, None), (BANNER + '"use strict";\n' + PERSON, None), (BANNER + "const MODULE = `\n" + MODULE + "`;\n" + PERSON, None),
        (BANNER + "/*\n" + MODULE + "*/\n" + PERSON, None), (BANNER + PERSON + "// Code generated by tool. DO NOT EDIT.\n", None),
    ],
)
def test_marks_below_long_heads(text, kind):
    assert judge("src/a.js", "js", text) == kind
