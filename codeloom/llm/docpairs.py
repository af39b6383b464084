"""Functions paired with their documentation, from a table of symbols and the files' contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_word
from codeloom.llm.arrow import struct_lists
from codeloom.llm.docpairs_text import FILLER, LEAST, PLACEHOLDERS, documentation, language, lines_of, worthwhile
from codeloom.llm.signatures import has_body, header, module_of, normal_signature
from codeloom.plans.lineage import cut

KINDS = ("function", "method")
TABLE = "symbol_id long, file_id long, key string, lang string, module string, name string, signature string, norm_signature string, n_parameters int, typed boolean, has_body boolean, doc string, doc_line int, worth boolean, code string"
SCHEMA = pa.schema(
    [
        ("symbol_id", pa.int64()), ("file_id", pa.int64()), ("key", pa.string()), ("lang", pa.string()), ("module", pa.string()), ("name", pa.string()), ("signature", pa.string()), ("norm_signature", pa.string()),
        ("n_parameters", pa.int32()), ("typed", pa.bool_()), ("has_body", pa.bool_()), ("doc", pa.string()), ("doc_line", pa.int32()), ("worth", pa.bool_()), ("code", pa.string()),
    ]
)


def _extractor(with_text: bool, least: int, placeholders: set[str], filler: set[str]):
    def rows_of(file_id, path, lines, family, symbols):
        module = module_of(path, family)
        for sid, key, name, given, a, z in symbols:
            if a is None or z is None or not 1 <= a <= len(lines) or z < a:
                continue
            head = header(lines, a, z, family)
            body = has_body(head, path or "", family)
            norm = normal_signature(head, name, family)
            if norm is None:  # the lines hold no whole declaration, so the table's signature is asked
                norm = normal_signature(given, name, family)
            doc, at = documentation(lines, a, z, family)
            worth = worthwhile(doc, name, least, placeholders, filler)
            kinds = norm.split(",") if norm else []
            signature, code = None, None
            if with_text:
                signature = given if given and given.strip() and ")" in given else head
                code = "\n".join(lines[a - 1 : z])
            elif body or not family:
                doc = None  # a definition lends its documentation to nobody
            yield sid, file_id, key if with_text else None, family, module, name, signature, norm, len(kinds), any(k.strip("*.") for k in kinds), body, doc, at, worth, code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                symbols = struct_lists(b.column("symbols"), "id", "key", "name", "signature", "start_line", "end_line")
                rows = []
                for file_id, path, lang, content, own in zip(*(b.column(c).to_pylist() for c in ("file_id", "path", "lang", "content")), symbols):
                    rows.extend(rows_of(file_id, path, lines_of(content), language(path, lang), own))
                columns = list(zip(*rows)) if rows else [[] for _ in SCHEMA]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    return run


def symbol_table(files: DataFrame, contents: DataFrame, symbols: DataFrame, with_text: bool = True, least: int = LEAST, placeholders: set[str] = PLACEHOLDERS, filler: set[str] = FILLER) -> DataFrame:
    """The qualified table of symbols across files: one row per active function or method with what its file says of it.

    module and name qualify it: module is the file without its ending (the directory for Go and Java, whose packages are
    directories), name that of the table (`Class.method`). norm_signature holds the types of its parameters, n_parameters their
    number, typed whether any has a type; has_body tells a definition from a declaration. doc is its own documentation, worth
    whether that says something, see docpairs_text.worthwhile for least, placeholders and filler. key, signature (the file's own where the
    column is null or cut short) and code are null without with_text, and so is the doc of definitions.

    Symbols without usable lines, or of files without content, have no row. The symbols of a file are brought to its content,
    so that each text is read and split once.
    """
    live = symbols.where((normal_word(F.col("status")) == "active") & normal_word(F.col("kind")).isin(*KINDS) & F.col("file_id").isNotNull())
    text = F.col("key") if with_text else F.lit(None).cast("string")
    per_file = live.groupBy("file_id").agg(F.collect_list(F.struct("id", text.alias("key"), "name", "signature", "start_line", "end_line")).alias("symbols"))
    named = files.select(F.col("id").alias("file_id"), "path", "lang")
    texts = contents.select("file_id", "content").where("content is not null")
    return texts.join(per_file, "file_id").join(named, "file_id", "left").select("file_id", "path", "lang", "content", "symbols").mapInArrow(_extractor(with_text, least, set(placeholders), set(filler)), TABLE)


def _twice(*parts: Column) -> list[Column]:
    """Two 64-bit hashes that stand for the parts, so that no strings are shuffled."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def resolved(table: DataFrame) -> DataFrame:
    """symbol_id, lang, doc_source, declared_doc of every row of a symbol table, before any filtering.

    Documented declarations - symbols without a body, or in a file that only declares - are joined with the definitions of
    the same language, module, qualified name and overload. An overload is told by its normalised signature; a definition whose
    parameters have no types takes the declaration with as many parameters, if all those have one signature. Of several declarations of one
    overload one that says something goes first, then the one of the smallest id. doc_source is `own` where the symbol's own documentation says something,
    else `declaration` where the declared one does, else null. The table is written once without its strings but declared documentation, as two sides read
    it; declarations are reduced to one row per overload first, so that each definition meets one row.
    """
    family = F.when(F.col("lang").isin("typescript", "javascript"), "script").otherwise(F.coalesce("lang", F.lit("")))
    names = _twice(family, F.coalesce("module", F.lit("")), F.coalesce("name", F.lit("")))
    lean = table.select("symbol_id", "lang", names[0].alias("n1"), names[1].alias("n2"), F.xxhash64("norm_signature").alias("sig"), F.col("norm_signature").isNotNull().alias("whole"), "n_parameters", "typed", "has_body", "worth", "doc")
    lean = cut(lean)

    def place(overload: Column) -> list[Column]:
        return [h.alias(k) for h, k in zip(_twice(F.col("n1"), F.col("n2"), overload), ("k1", "k2"))]

    exact, loose = F.struct(F.lit("=").alias("by"), F.col("sig").alias("x")), F.struct(F.lit("#").alias("by"), F.col("n_parameters").cast("long").alias("x"))
    offers = lean.where("doc is not null and not has_body and whole").withColumn("overload", F.explode(F.array(exact, loose)))
    best = F.min(F.struct((~F.col("worth")).alias("empty"), "symbol_id", "doc")).alias("best")
    offers = offers.select(*place(F.col("overload")), "sig", "worth", "symbol_id", "doc").groupBy("k1", "k2").agg(F.min("sig").alias("a"), F.max("sig").alias("z"), best)
    offers = offers.where("a = z").select("k1", "k2", "best")  # one signature among as many parameters
    asked = lean.select("symbol_id", "lang", *place(F.when(F.col("typed") | ~F.col("has_body"), exact).otherwise(loose)), "has_body", "worth")
    met = asked.join(offers, ["k1", "k2"], "left")
    lent = F.col("has_body") & F.col("best").isNotNull() & ~F.col("best.empty")
    return met.select("symbol_id", "lang", F.when(F.col("worth"), "own").when(lent, "declaration").alias("doc_source"), F.when(~F.col("worth") & lent, F.col("best.doc")).alias("declared_doc"))


def documented_symbols(files: DataFrame, contents: DataFrame, symbols: DataFrame, own: bool = True) -> DataFrame:
    """symbol_id of each active function or method whose resolved documentation says something; own: only its own, not a declaration's."""
    found = resolved(symbol_table(files, contents, symbols, with_text=False))
    return found.where("doc_source = 'own'" if own else "doc_source is not null").select("symbol_id")


def doc_pairs(files: DataFrame, contents: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, key, lang, signature, code, doc, doc_source of functions and methods with documentation worth keeping.

    doc_source is `own` where the documentation stands at the function itself, `declaration` where it stands at its separate
    declaration, see resolved. Own pairs come straight from the texts; the table without texts is resolved beside it, and only the
    code of definitions that take a declaration's documentation is brought to it. A null name or path counts as an empty one.
    """
    columns = ["symbol_id", "key", "lang", "signature", "code"]
    own = symbol_table(files, contents, symbols).where("worth").select(*columns, "doc", F.lit("own").alias("doc_source"))
    lent = resolved(symbol_table(files, contents, symbols, with_text=False)).where("doc_source = 'declaration'").select("symbol_id", "declared_doc")
    theirs = symbol_table(files, contents, symbols.join(lent.select(F.col("symbol_id").alias("id")), "id", "left_semi"))
    return own.unionByName(theirs.join(lent, "symbol_id").select(*columns, F.col("declared_doc").alias("doc"), F.lit("declaration").alias("doc_source")))


def linked_counts(files: DataFrame, contents: DataFrame, symbols: DataFrame) -> DataFrame:
    """lang, doc_source, n_pairs: how many documented functions have their own documentation and how many a declaration's."""
    found = resolved(symbol_table(files, contents, symbols, with_text=False))
    return found.where("doc_source is not null").groupBy("lang", "doc_source").agg(F.count(F.lit(1)).alias("n_pairs"))
