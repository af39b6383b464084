"""One form for texts that look alike but are made of different characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.plans.lineage import cut

#: letters of other scripts that look like a Latin letter, each before the letter it stands for (fixed values); they hold besides
#: what the Unicode table of confusable characters gives, see confusables
LOOKALIKES = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϲc ϳj ϹC ͿJ "
    "ⅠI ⅤV ⅩX ⅬL ⅭC ⅮD ⅯM ⅰi ⅴv ⅹx ⅼl ⅽc ⅾd ⅿm օo ᴏo "
    "‐- ‑-"
)
#: scripts whose letters are looked up in the table of confusable characters (fixed values, as character names begin)
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
#: small letters that the table takes for Latin ones, but whose usual shape a reader tells from them (fixed values)
TOLD_APART = "гαγισυρϱѡҽιᴦագզռցքӏꙇᴨⲅⲣ"
#: characters of category So, Mn or Lo that show nothing (fixed values)
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
#: kinds of compatibility decomposition whose result reads the same (fixed values)
SAME_READING = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"}

#: stands for a joiner between emoji, which changes what is shown; the last code point, never assigned
_JOINED = 0x10FFFD
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}"
#: a run of characters beyond ASCII, with the ASCII character before it, which marks of the run may belong to
_PIECE = r"[\x00-\x7F]?[^\x00-\x7F]+"


def _invisible(cp: int, category: str) -> bool:
    if cp in (0x09, 0x0A, 0x0D):
        return False
    return category in ("Cf", "Cc") or cp in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


def confusables(spark: SparkSession) -> dict[int, int]:
    """Letters of SCRIPTS that the Unicode table of confusable characters (UTS 39, in the version of the ICU library that Spark brings
    along: 16.0 with ICU 77) gives the same skeleton as exactly one ASCII letter of the same case, without those TOLD_APART.

    What the table says of digits, signs and letters of the Latin script is left out: 0 and O, 1 and l, rn and m are told apart here.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    mine = [cp for cp in range(0x80, 0x20000) if unicodedata.name(chr(cp), "").split(" ")[0] in SCRIPTS and unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lo")]
    latin = [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]
    skeletons = checker.getSkeleton(0, "\u0001".join([*map(chr, mine), *latin])).split("\u0001")
    by_skeleton: dict[str, list[str]] = {}
    for c, k in zip(latin, skeletons[len(mine) :]):
        by_skeleton.setdefault(k, []).append(c)
    out = {}
    for cp, k in zip(mine, skeletons):
        category = unicodedata.category(chr(cp))
        like = [c for c in by_skeleton.get(k, ()) if c.isupper() == (category != "Ll")]
        if len(like) == 1 and chr(cp) not in TOLD_APART:
            out[cp] = ord(like[0])
    return out


def mappings(more: dict[int, int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(code point, [(code point, combining class), ...]) for every code point that doesn't stay as it is or is a mark.

    The rows follow from the Unicode data of Python, the lists above and more, look-alike letters as confusables gives them: about 6,000,
    whatever the corpus. Canonical decompositions are applied in full; of the compatibility ones only those whose result reads the
    same, so that superscripts, circled digits and the like stay what they are. Hangul syllables stay whole, as recomposing makes them.
    """
    alike = (more or {}) | {ord(x[0]): ord(x[1]) for x in LOOKALIKES.split()}

    def fold(cp: int) -> list[int]:
        c = chr(cp)
        category = unicodedata.category(c)
        if cp == _JOINED:
            return [0x200D]
        if _invisible(cp, category):
            return []
        if category == "Zs":
            return [0x20]
        if cp in alike:
            return [alike[cp]]
        if 0xAC00 <= cp <= 0xD7A3:
            return [cp]
        parts = unicodedata.decomposition(c).split()
        if not parts:
            return [cp]
        tag = parts.pop(0) if parts[0][0] == "<" else ""
        to = [int(x, 16) for x in parts]
        joined = tag == "<compat>" and len(to) > 1 and category[0] == "L" and all(unicodedata.category(chr(x))[0] == "L" for x in to)
        if tag and not joined and not (tag in SAME_READING and (0x20 not in to or len(to) == 1)):
            return [cp]
        return [y for x in to for y in fold(x)]

    rows = []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        to = fold(cp) if unicodedata.category(chr(cp)) != "Cn" or cp == _JOINED else [cp]
        if to != [cp] or unicodedata.combining(chr(cp)):
            rows.append((cp, [(x, unicodedata.combining(chr(x))) for x in to]))
    return rows


_TABLE: list | None = None


def mapping_table(spark: SparkSession) -> DataFrame:
    global _TABLE
    if _TABLE is None:
        _TABLE = mappings(confusables(spark))
    return spark.createDataFrame(_TABLE, "cp int, outs array<struct<out:int,ccc:int>>")


def _plain(text: Column) -> Column:
    """What ASCII needs: control characters show nothing, and a carriage return before a line feed neither."""
    stripped = F.regexp_replace(text, "\r(?=\n)|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.when(text.rlike(r"[\x00-\x08\x0B-\x1F\x7F]"), stripped).otherwise(text)  # a plain class finds the few texts that have some


@F.pandas_udf(T.StringType())
def _recompose(points: pd.Series) -> pd.Series:
    return points.map(lambda p: unicodedata.normalize("NFC", "".join(map(chr, p))))


def _ids(c: str) -> list[Column]:
    """Two 64-bit hashes that stand for a string in shuffles."""
    return [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]


def canonical_pieces(pieces: DataFrame) -> DataFrame:
    """p1, p2 -> form for strings p1, p2, piece that are distinct and partitioned by p1, p2.

    The code points are exploded with their positions, mapped by a broadcast join, marks are put in the order of their
    classes after each starter, and the string is rebuilt and recomposed. The windows and groups keep the partitioning,
    so only the short strings were shuffled. A piece of which nothing is left has no row.
    """
    kept = F.regexp_replace("piece", f"([{_EMOJI}]\\x{{FE0F}}?)\\x{{200D}}(?=[{_EMOJI}])", "$1" + chr(_JOINED))
    points = pieces.select("p1", "p2", F.posexplode(F.split(kept, "")).alias("at", "ch")).where("ch <> ''").select("p1", "p2", "at", F.ascii("ch").alias("cp"))
    own = F.array(F.struct(F.col("cp").alias("out"), F.lit(0).alias("ccc")))
    mapped = points.join(F.broadcast(mapping_table(pieces.sparkSession)), "cp", "left")
    parts = mapped.select("p1", "p2", "at", F.posexplode(F.coalesce("outs", own)).alias("sub", "o"))
    starter = F.sum(F.when(F.col("o.ccc") == 0, 1).otherwise(0)).over(Window.partitionBy("p1", "p2").orderBy("at", "sub"))
    ordered = parts.withColumn("starter", starter).groupBy("p1", "p2").agg(
        F.sort_array(F.collect_list(F.struct("starter", F.col("o.ccc").alias("ccc"), "at", "sub", F.col("o.out").alias("out")))).alias("l")
    )
    return ordered.select("p1", "p2", _recompose(F.transform("l", lambda x: x["out"])).alias("form"))


def _odd(text: Column) -> Column:
    """Whether a text holds more than ASCII: more bytes than characters."""
    return F.coalesce(F.octet_length(text) > F.char_length(text), F.lit(False))


def changed_pieces(df: DataFrame, text: str) -> DataFrame:
    """piece, form of the distinct pieces beyond ASCII of the texts whose form differs from them. Written once."""
    pieces = df.select(F.explode(F.regexp_extract_all(text, F.lit(_PIECE), 0)).alias("piece")).distinct()
    pieces = cut(pieces.select(*[h.alias(n) for h, n in zip(_ids("piece"), ("p1", "p2"))], "piece").repartition("p1", "p2"))
    forms = pieces.join(canonical_pieces(pieces), ["p1", "p2"], "left").select("piece", F.coalesce("form", F.lit("")).alias("form"))
    return cut(forms.where("form <> piece"))


def canonical_texts(df: DataFrame, text: str = "text", broadcast_chars: int = 8_000_000) -> DataFrame:
    """t1, t2 -> form for the distinct texts of df that hold more than ASCII; t1, t2 are hashes of the text without control characters.

    Texts are shuffled once, to be treated once each; their pieces keep that partitioning, are replaced by a join with the
    pieces that change, and put together again. These are broadcast if they have at most broadcast_chars characters; beyond
    that the join shuffles, with the same result.
    """
    raw = F.col(text).cast("string")
    plain = df.where(_odd(raw)).select(_plain(raw).alias("plain"))  # the filter goes by the text as it is, so that it's stripped once
    changed = changed_pieces(plain, "plain")
    size = changed.agg(F.sum(F.char_length("piece") + F.char_length("form") + 16).alias("n")).first()["n"] or 0
    changed = F.broadcast(changed) if size <= broadcast_chars else changed
    texts = plain.select(*[h.alias(n) for h, n in zip(_ids("plain"), ("t1", "t2"))], "plain").groupBy("t1", "t2").agg(F.first("plain").alias("plain"))
    rows = texts.select("t1", "t2", F.posexplode(F.regexp_extract_all("plain", F.lit(_PIECE), 0)).alias("pos", "piece"))
    forms = rows.join(changed, "piece", "left").groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("form", "piece").alias("form")))).alias("forms"))
    # the ASCII between the pieces is one part longer than the pieces
    parts = F.split("plain", _PIECE, -1)
    woven = F.concat_ws("", F.flatten(F.zip_with(parts, F.concat(F.col("forms.form"), F.array(F.lit(""))), lambda a, b: F.array(a, b))))
    return texts.join(forms, ["t1", "t2"]).select("t1", "t2", woven.alias("form"))


def same_form(df: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """df with one more column: the text in the form that equal-looking texts share.

    Full-width and half-width forms, ligatures and digraphs, presentation forms, every kind of blank but tabs and line ends,
    combining marks in any order, and Cyrillic, Greek and other letters that look Latin come out as one; characters that show
    nothing go, but for joiners between emoji. CR LF becomes LF. Case, accents, digits, superscripts and line ends stay
    different. A null text has a null form; the empty text and one of invisible characters only have an empty form. Texts of
    ASCII only are not shuffled for their forms; other texts are treated once, however many rows hold them. A column of df
    that is named as form is replaced.
    """
    base = df.drop(form).withColumn("__plain", _plain(df[text].cast("string")))
    keyed = base.withColumns({"__t1": _ids("__plain")[0], "__t2": _ids("__plain")[1]})
    odd = _odd(F.col("__plain"))
    forms = canonical_texts(df, text).select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("form").alias("__form"))
    rest = keyed.where(~odd).withColumn(form, F.col("__plain"))
    hard = keyed.where(odd).join(forms, ["__t1", "__t2"], "left").withColumn(form, F.coalesce("__form", F.lit(""))).drop("__form")
    return rest.unionByName(hard).drop("__plain", "__t1", "__t2")


def _keyed(src: DataFrame) -> DataFrame:
    """id, form hash f1, f2 and text hash x1, x2 of each row of src (id, text) whose text has a visible character."""
    def named(c: str, a: str, b: str) -> list[Column]:
        return [h.alias(n) for h, n in zip(_ids(c), (a, b))]

    def plain(rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.select("id", "text", _plain(F.col("text")).alias("plain")).select("id", *named("text", "x1", "x2"), *named("plain", a, b))

    odd = _odd(F.col("text"))
    ascii = plain(src.where(~odd & F.col("text").rlike(r"[^\s\x00-\x1F\x7F]")), "f1", "f2")
    hard = plain(src.where(odd), "t1", "t2")
    forms = canonical_texts(src, "text").where(F.col("form").rlike(r"[^\s]")).select("t1", "t2", *named("form", "f1", "f2"))
    return ascii.unionByName(hard.join(forms, ["t1", "t2"]).drop("t1", "t2"))


def lookalike_groups(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, f1, f2, x1, x2, n_texts of each row whose text has a visible character and looks like a different text of df.

    Rows with the same (f1, f2) look alike, with the same (x1, x2) they are the same string; n_texts says how many strings look like the
    row's, itself included. A null id gives no row. This form serves any number of copies and spellings: it is as long as df at most.
    Only 128-bit hashes of forms and texts are kept of the rows, and rows are counted before they are shuffled by form.
    """
    src = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    keyed = cut(_keyed(src))
    texts = keyed.select("f1", "f2", "x1", "x2").distinct().groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    return keyed.join(texts, ["f1", "f2"])


def group_members(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, group_id (the smallest id that looks like it), text_id (the smallest id of the same string), n_texts of each row that lookalike_groups gives."""
    rows = lookalike_groups(df, id, text)
    texts = rows.groupBy("f1", "f2", "x1", "x2").agg(F.min("id").alias("text_id"))
    groups = texts.groupBy("f1", "f2").agg(F.min("text_id").alias("group_id"))
    return rows.join(texts, ["f1", "f2", "x1", "x2"]).join(groups, ["f1", "f2"]).select(F.col("id").alias(id), "group_id", "text_id", "n_texts")


def lookalike_pairs(df: DataFrame, id: str = "doc_id", text: str = "text", block: int = 1000) -> DataFrame:
    """Pairs of ids, the smaller first, whose different texts look alike.

    Pairs of texts come first: the texts of a form are dealt into blocks of about `block`, and each two blocks are joined. Then the rows
    of a text are dealt likewise, and two texts are joined block by block, so that no task holds more than two blocks
    however many spellings a form and copies a text has. Copies of the same string are never compared.
    """
    rows = cut(lookalike_groups(df, id, text).select("id", "f1", "f2", "x1", "x2", "n_texts"))
    texts = rows.groupBy("f1", "f2", "x1", "x2").agg(F.count(F.lit(1)).alias("n"), F.max("n_texts").alias("m"))

    def dealt(n: Column, *by: str) -> Column:
        """The block of a row among ceil(n / block)."""
        return F.pmod(F.xxhash64(*map(F.col, by), F.lit("block")), F.ceil(n / F.lit(block))).cast("int")

    texts = texts.withColumn("b", dealt(F.col("m"), "x1", "x2"))
    left = texts.select("f1", "f2", F.col("b").alias("ba"), F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("n").alias("na"))
    left = left.join(texts.select("f1", "f2", "m").distinct(), ["f1", "f2"]).withColumn("bb", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / F.lit(block)) - 1).cast("int")))).drop("m")
    right = texts.select("f1", "f2", F.col("b").alias("bb"), F.col("x1").alias("b1"), F.col("x2").alias("b2"), F.col("n").alias("nb"))
    pairs = left.join(right, ["f1", "f2", "bb"]).where("a1 < b1 or (a1 = b1 and a2 < b2)")
    last = lambda n: (F.ceil(F.col(n) / F.lit(block)) - 1).cast("int")
    pairs = pairs.select("a1", "a2", "b1", "b2", "nb", F.explode(F.sequence(F.lit(0), last("na"))).alias("ka"))
    pairs = pairs.select("a1", "a2", "b1", "b2", "ka", F.explode(F.sequence(F.lit(0), last("nb"))).alias("kb"))
    blocks = rows.join(texts.select("x1", "x2", "n"), ["x1", "x2"]).select("x1", "x2", "id", dealt(F.col("n"), "id").alias("k"))
    x = blocks.select(F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("k").alias("ka"), F.col("id").alias("x"))
    y = blocks.select(F.col("x1").alias("b1"), F.col("x2").alias("b2"), F.col("k").alias("kb"), F.col("id").alias("y"))
    both = pairs.join(x, ["a1", "a2", "ka"]).join(y, ["b1", "b2", "kb"])
    return both.select(F.least("x", "y").alias(f"{id}_a"), F.greatest("x", "y").alias(f"{id}_b"))
