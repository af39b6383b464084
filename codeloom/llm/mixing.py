"""Mixing documents of several sources so that each source has its target share of the tokens.

Documents whose source is unknown belong to every source to some degree: a classifier, fitted on a bounded sample of the
labelled rows, gives their posteriors. Rows of the same source, or of nearly the same posteriors, form cells, whose expected token
totals are summed up over all rows; nonnegative rates of the cells are fitted by projected-gradient least squares so that the
expected totals match the targets, and turned into whole copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_word
from codeloom.llm.encoding import VOCABULARY, _encoder
from codeloom.plans.lineage import cut

OTHER = ""
FEATURES = 1024
SAMPLE_PER_SOURCE = 600
STEPS = 50_000
TOLERANCE = 1e-9
SHARE_TOLERANCE = 0.01
BUCKETS = 64
EDGE_ROWS = 50_000
LEVELS = 5


@dataclass
class Model:
    """Softmax regression over hashed token counts."""

    labels: list[str]
    weights: np.ndarray

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        z = np.hstack([features, np.ones((len(features), 1), dtype=np.float32)]) @ self.weights
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def features_of(ids: list[int], size: int = FEATURES) -> np.ndarray:
    """Counts of a whole text's tokens, hashed to `size` places, damped and of length 1; the last place holds the text's length."""
    out = np.zeros(size, dtype=np.float32)
    if ids:
        a = np.asarray(ids, dtype=np.int64)
        places = ((a * 2654435761) >> 7) % (size - 1)
        out[: size - 1] = np.log1p(np.bincount(places, minlength=size - 1))
        out /= np.linalg.norm(out) or 1.0
        out[size - 1] = np.log1p(len(ids)) / 10
    return out


def fit(features: np.ndarray, labels: list[str], rounds: int = 300, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent with momentum from zero; the same rows give the same weights."""
    names = sorted(set(labels))
    y = np.eye(len(names), dtype=np.float32)[[names.index(x) for x in labels]]
    x = np.hstack([features, np.ones((len(features), 1), dtype=np.float32)]).astype(np.float32)
    w = np.zeros((x.shape[1], len(names)), dtype=np.float32)
    speed = np.zeros_like(w)
    share = (1 / np.maximum(y.sum(axis=0), 1) / len(names))[y.argmax(axis=1)][:, None]  # each label weighs the same
    for _ in range(rounds):
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (x.T @ ((p - y) * share) + decay * w)
        w = w + speed
    return Model(names, w)


def sample_threshold(wanted: int, rows: int) -> int:
    """The 64-bit hash up to which a row belongs to a sample of about `wanted` of `rows`, whatever their number."""
    return -(1 << 63) + min(1 << 64, (wanted << 64) // max(1, rows)) - 1


def _sized(shared, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                counts, rows = [], []
                for text, sampled in zip(part["text"], part["sampled"]):
                    ids = encoder.encode(text) if sampled else None
                    counts.append(len(ids) if sampled else encoder.count(text))
                    rows.append(features_of(ids, size) if ids else None)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "source": part["source"].to_numpy(), "n_tokens": counts, "f": rows})

    return run


def _believed(shared, model_shared, places: list[int], size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, model = _encoder(shared), model_shared.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                ids = [encoder.encode(t) for t in part["text"]]
                p = model.posteriors(np.stack([features_of(i, size) for i in ids]))
                full = np.zeros((len(part), max(places) + 1))
                for k, place in enumerate(places):
                    full[:, place] += p[:, k]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_tokens": [len(i) for i in ids], "p": list(full)})

    return run


@dataclass
class Targets:
    """The mixes as arrays: weights[m, d] sum to 1 over the sources that have documents, caps[m, d]."""

    mixes: list[str]
    domains: list[str]
    shares: np.ndarray
    weights: np.ndarray
    caps: np.ndarray
    total: np.ndarray


def _targets(rows: list, hard: dict[str, float]) -> Targets:
    mixes = sorted({r["mix_name"] for r in rows})
    domains = sorted({r["source"] for r in rows}) + [OTHER]
    shares, caps = np.zeros((len(mixes), len(domains))), np.zeros((len(mixes), len(domains)))
    for r in rows:
        m, d = mixes.index(r["mix_name"]), domains.index(r["source"])
        shares[m, d] += max(0.0, r["target_share"] or 0.0)
        caps[m, d] = max(caps[m, d], r["max_repeats"] if r["max_repeats"] is not None else 1, 0)
    have = np.array([hard.get(d, 0.0) for d in domains])
    live = shares * (have > 0) * (caps > 0)
    weights = np.divide(live, live.sum(axis=1, keepdims=True), out=np.zeros_like(live), where=live.sum(axis=1, keepdims=True) > 0)
    room = np.where(weights > 0, caps * have / np.where(weights > 0, weights, 1), np.inf).min(axis=1)
    return Targets(mixes, domains, shares, weights, caps, np.where(np.isfinite(room), room, 0.0))


def fit_rates(totals: np.ndarray, wanted: np.ndarray, caps: np.ndarray, start: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, bool]:
    """Rates r of cells, 0 <= r <= caps, that make r @ totals match `wanted` in least squares, and whether the steps converged.

    totals[c, d]: expected tokens of cell c in source d; wanted[d]. Errors count relative to what is wanted, sources that nobody wants
    don't count; rates count relative to their start, which sets the scale of each cell. Accelerated projected gradient with the step 1 / L, L the greatest
    eigenvalue; it has converged when a step of the plain projected gradient moves no relative rate by more than `tolerance`.
    """
    asked = np.flatnonzero(wanted > 0)
    scale = np.where(start > 0, start, 1.0)
    most = caps / scale
    x = np.clip(np.where(start > 0, 1.0, 0.0), 0, most)
    if not len(asked) or not len(x):
        return x * scale, True
    a = (totals[:, asked] * scale[:, None] / wanted[asked]).T
    lipschitz = np.linalg.norm(a, 2) ** 2 or 1.0

    def ahead(z: np.ndarray) -> np.ndarray:
        return np.clip(z - a.T @ (a @ z - 1.0) / lipschitz, 0, most)

    y, speed = x, 1.0
    for _ in range(steps):
        new = ahead(y)
        if np.abs(new - x).max() <= tolerance and np.abs(ahead(new) - new).max() <= tolerance:
            return new * scale, True
        if (y - new) @ (new - x) > 0:  # the momentum points uphill: start it anew
            speed, y = 1.0, x
            new = ahead(x)
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        y, speed, x = new + (speed - 1) / faster * (new - x), faster, new
    return x * scale, False


def _cuts(mixes: list[str], rates: dict[tuple[int, str], tuple[float, float]], likely: dict[str, int], sizes: pd.DataFrame, buckets: int) -> list[tuple]:
    """(mix, cell, size class, base, at, left): rows of buckets below `at` get base + 1 copies, of the bucket `at` as long as
    the middle of each lies within a running total of left, others base. Size classes are cut at whole buckets, and what a class misses or
    exceeds is carried to the next, so that a few very long texts don't spoil a share; the class with the most rows comes last and
    is cut within a bucket. What is left over of a cell is carried to the next one of the same likely source, the source's own last.
    rates: by (mix, cell) the rate and its cap; likely: the number of the most likely source of a cell."""
    out = []
    left_over: dict[tuple[int, int], float] = {}
    parted = dict(list(sizes.groupby("cell")))
    for cell in sorted(parted, key=lambda c: (not c.startswith("|"), c)):
        of_cell = parted[cell]
        rows = of_cell.groupby("size_class")["n"].sum()
        order = [c for c in sorted(rows.index, reverse=True) if c != rows.idxmax()] + [rows.idxmax()]
        steps = {c: g.sort_values("bucket") for c, g in of_cell.groupby("size_class")}
        steps = {c: (g["t"].to_numpy().astype(float), g["bucket"].to_numpy(), np.concatenate(([0.0], np.cumsum(g["t"].to_numpy().astype(float))))) for c, g in steps.items()}
        for m, mix in enumerate(mixes):
            rate, cap = rates.get((m, cell), (0.0, 0.0))
            if rate <= 0:
                continue
            base, carry = int(np.floor(rate + 1e-9)), left_over.get((m, likely[cell]), 0.0)
            for c in order:
                tokens, numbers, until = steps[c]
                more = max(0.0, rate - base) * until[-1] + carry
                more_here = min(max(more, 0.0), until[-1] if base < cap else 0.0)
                if c != order[-1]:
                    k = int(np.abs(until - more_here).argmin())
                    left, got = 0.0, until[k]
                else:
                    k = min(int(np.searchsorted(until, more_here, "right")) - 1, len(tokens))
                    left, got = more_here - until[k], more_here
                carry = more - got
                at = int(numbers[k]) if k < len(numbers) else buckets
                out.append((mix, cell, int(c), base, at, float(left)))
            left_over[m, likely[cell]] = carry
    return out


def _edge(each: DataFrame, edge_rows: int) -> DataFrame:
    """The rows of the buckets that are cut within, with their copies. A bucket is parted by a second hash into parts of about edge_rows rows;
    the parts are summed up and put in order, and each finds its own rows' running totals, so that no bucket is sorted in one task."""
    by = ["mix_name", "cell", "size_class"]
    edge = each.where("bucket = at").withColumn("place", F.xxhash64("id", F.lit("edge")))
    sized = edge.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(edge_rows)).alias("parts"))
    edge = edge.join(sized, by).withColumn("part", F.floor((F.col("place") / F.lit(float(1 << 64)) + 0.5) * F.col("parts")).cast("int"))
    sums = edge.groupBy(*by, "part").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy(*by, "part").orderBy("place", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.join(sums, [*by, "part"]).withColumn("so_far", F.col("before") + F.sum("n_tokens").over(inside))
    return edge.withColumn("copies", F.col("base") + F.when(F.col("so_far") - F.col("n_tokens") / 2 < F.col("left"), 1).otherwise(0))


@dataclass
class Mixed:
    rows: DataFrame
    report: DataFrame


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    vocabulary: str = VOCABULARY,
    sample_per_source: int = SAMPLE_PER_SOURCE,
    features: int = FEATURES,
    share_tolerance: float = SHARE_TOLERANCE,
    buckets: int = BUCKETS,
    edge_rows: int = EDGE_ROWS,
) -> Mixed:
    """Rows chosen for every mix, and the shares reached.

    targets: mix_name, source, target_share (a weight within its mix), max_repeats; a small table of settings, read by the
    driver. Sources are compared without blanks and letter case. The size of a mix is the greatest at which every source that
    has documents reaches its share within its cap by labelled rows: the scarcest source sets it. rows: mix_name, id, source, n_tokens,
    copies (1 to max_repeats; other documents are not chosen). report: mix_name, source, target_share (within the mix), wanted_share
    (after leaving out sources without documents), reached_share, tokens, docs, rate (fitted, of the labelled rows), status: `reached` if
    reached_share is within share_tolerance of wanted_share, `missed` if not, `no documents`, or `not asked` (of a source that only another mix names).

    A document without a source counts by its posteriors, so its tokens are shared among the sources in the report; its
    cap is that of its most likely source. The classifier is fitted on at most about sample_per_source labelled rows of each
    source, picked by a hash of the id; everything else covers all rows. A document of a source that no mix names, or
    without tokens (null and empty texts), is not chosen. A null id is an id like others.

    Cells are the sources and, for rows without one, the most likely source, the next one and LEVELS steps of its probability: their number follows
    from the settings. The rate r of a cell holds for its rows: each gets floor(r) copies, and those that get one more are cut off at
    a token total per size class, bucket by bucket of a hash of the id, and part by part in the bucket that is cut, so no cell is sorted in one task. Each text is tokenised once.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    asked = [r.asDict() for r in targets.select("mix_name", normal_word(F.col("source")).alias("source"), "target_share", "max_repeats").where("mix_name is not null and source is not null").collect()]
    docs = documents.select(F.col(id).alias("id"), F.coalesce(normal_word(F.col(source)), F.lit("")).alias("source"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    names = sorted({r["source"] for r in asked})
    labelled = docs.where(F.col("source").isin(*names)) if names else docs.limit(0)
    # how many rows each source has sets who is in its sample; no text is read for it
    count = {r["source"]: r["count"] for r in labelled.groupBy("source").count().collect()}  # a row for each source of the settings
    limit = F.lit(None).cast("long")
    for s, n in count.items():
        limit = F.when(F.col("source") == s, F.lit(sample_threshold(sample_per_source, n))).otherwise(limit)
    sampled = F.coalesce(F.xxhash64("id", F.lit("sample")) <= limit, F.lit(False))
    sized = cut(labelled.withColumn("sampled", sampled).mapInPandas(_sized(shared, features), f"id {kind}, source string, n_tokens long, f array<float>").where("n_tokens > 0"))
    domains = [*names, OTHER]
    wide = len(domains)
    hard = {r["source"]: float(r["t"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    t = _targets(asked, hard)

    # posteriors of the rows without a source
    soft = None
    got = sized.where("f is not null").select("source", "f").toPandas()  # the sample
    if got["source"].nunique() > 1:
        order = np.lexsort([got["f"].map(lambda x: float(np.sum(x))).to_numpy(), got["source"].to_numpy().astype(str)])  # the same order every time
        model = fit(np.stack([np.asarray(x, dtype=np.float32) for x in got["f"]])[order], got["source"].to_numpy()[order].tolist())
        places = [domains.index(x) for x in model.labels]
        believed = docs.where("source = ''").mapInPandas(_believed(shared, spark.sparkContext.broadcast(model), places, features), f"id {kind}, n_tokens long, p array<double>")
        soft = believed.where("n_tokens > 0").select("id", "n_tokens", F.expr(f"transform(sequence(0, {wide - 1}), k -> coalesce(get(p, k), 0D))").alias("p"))

    # cells: the sources, and what posteriors have in common
    none = F.lit(None)
    rows = sized.select("id", "source", "n_tokens", F.col("source").alias("cell"), none.cast("array<double>").alias("p"))
    if soft is not None:
        top = F.array_max("p")
        first = F.array_position("p", top)
        rest = F.transform("p", lambda x, i: F.when(i == F.col("first") - 1, -1.0).otherwise(x))
        celled = soft.withColumn("first", first).withColumn("next", F.array_position(rest, F.array_max(rest)))
        cell = F.concat_ws("|", F.lit(""), F.col("first") - 1, F.col("next") - 1, F.least(F.floor(top * LEVELS), F.lit(LEVELS - 1)))
        rows = rows.unionByName(celled.select("id", none.cast("string").alias("source"), "n_tokens", cell.alias("cell"), "p"))
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("id", F.lit("bucket")), F.lit(buckets)).cast("int"), "size_class": F.floor(F.log2("n_tokens")).cast("int")})
    if soft is not None:
        rows = cut(rows)
    share = [F.coalesce(F.sum(F.col("n_tokens") * F.get("p", F.lit(d))), F.lit(0.0)).alias(f"v{d}") for d in range(wide)]
    sizes = rows.groupBy("cell", "size_class", "bucket").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), *share).toPandas()  # cells, times size classes (about 30), times buckets, at most

    cells = sorted(sizes["cell"].unique())
    likely = {c: int(c.split("|")[1]) if c.startswith("|") else domains.index(c) for c in cells}
    sums = sizes.groupby("cell")[["t", *[f"v{d}" for d in range(wide)]]].sum()
    totals = np.array([sums.loc[c].to_numpy()[1:] if c.startswith("|") else sums.loc[c, "t"] * np.eye(wide)[likely[c]] for c in cells]).reshape(len(cells), wide).astype(float)
    have = np.array([hard.get(d, 0.0) for d in domains])
    scale = np.divide(t.total[:, None] * t.weights, have, out=np.zeros_like(t.weights), where=have > 0)
    caps = np.where(t.weights > 0, t.caps, 0)
    rates: dict[tuple[int, str], tuple[float, float]] = {}
    for m in range(len(t.mixes)):
        most = np.array([caps[m, likely[c]] for c in cells])
        start = np.array([scale[m, likely[c]] for c in cells])
        fitted, _ = fit_rates(totals, t.total[m] * t.weights[m], most, np.minimum(start, most))
        rates |= {(m, c): (float(r), float(k)) for c, r, k in zip(cells, fitted, most)}

    cuts = _cuts(t.mixes, rates, likely, sizes, buckets)
    if cuts:
        plan = spark.createDataFrame(cuts, "mix_name string, cell string, size_class int, base int, at int, left double")
        each = rows.join(F.broadcast(plan), ["cell", "size_class"])  # at most a row for each mix, cell and size class
        beyond = each.where("bucket <> at").withColumn("copies", F.col("base") + F.when(F.col("bucket") < F.col("at"), 1).otherwise(0))
        columns = ["mix_name", "id", "source", "n_tokens", F.col("copies").cast("int").alias("copies"), "p"]
        chosen = _edge(each, edge_rows).select(*columns).unionByName(beyond.select(*columns)).where("copies > 0")
    else:
        chosen = spark.createDataFrame([], f"mix_name string, id {kind}, source string, n_tokens long, copies int, p array<double>")
    label = F.element_at(F.array(*map(F.lit, domains)), F.col("d") + 1)
    made = (F.col("n_tokens") * F.col("copies")).cast("double")
    parts = chosen.where("source is not null").groupBy("mix_name", "source").agg(F.sum(made).alias("tokens"), F.count(F.lit(1)).cast("double").alias("docs"))
    spread = chosen.where("source is null").select("mix_name", made.alias("w"), F.posexplode("p").alias("d", "share")).where("share > 0")
    parts = parts.unionByName(spread.groupBy("mix_name", label.alias("source")).agg(F.sum(F.col("w") * F.col("share")).alias("tokens"), F.sum("share").alias("docs")))
    wants = [
        (mix, s, float(t.shares[m, d] / t.shares[m].sum()) if t.shares[m].sum() else 0.0, float(t.weights[m, d]), rates.get((m, s), (0.0, 0.0))[0])
        for m, mix in enumerate(t.mixes) for d, s in enumerate(t.domains) if t.shares[m, d] > 0
    ]
    want = spark.createDataFrame(wants, "mix_name string, source string, target_share double, wanted_share double, rate double")
    got_tokens = parts.where("source <> ''").groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    whole = got_tokens.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    reached = F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0))
    status = (
        F.when(F.col("target_share").isNull(), "not asked")
        .when(F.coalesce("wanted_share", F.lit(0.0)) <= 0, "no documents")
        .when(F.abs(reached - F.col("wanted_share")) <= share_tolerance, "reached")
        .otherwise("missed")
    )
    report = (
        want.join(got_tokens, ["mix_name", "source"], "full")
        .join(whole, "mix_name", "left")
        .select(
            "mix_name", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("wanted_share", F.lit(0.0)).alias("wanted_share"), reached.alias("reached_share"),
            F.coalesce("tokens", F.lit(0.0)).alias("tokens"), F.coalesce("docs", F.lit(0.0)).alias("docs"), F.coalesce("rate", F.lit(0.0)).alias("rate"), status.alias("status"),
        )
    )
    return Mixed(chosen.drop("p").withColumnRenamed("id", id), report)
