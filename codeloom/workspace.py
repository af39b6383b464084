"""One object for a caller: the tables of a workspace under one directory, and what can be asked of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.markdown import parse_pages
from codeloom.operators import baseline_ops, graph, impact, ledger, orphans, resolve, search, snapshots, status, verify
from codeloom.sources.tables import table


class Workspace:
    """Lazy access to the tables; every method returns a DataFrame, or a dictionary of them for a report."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    @cached_property
    def edges(self) -> DataFrame:
        return resolve.file_edges(self.table("calls"), self.table("files"))

    @cached_property
    def duty(self) -> DataFrame:
        return ledger.obligations(self.table("extracted_anchors"))

    @cached_property
    def pages(self) -> DataFrame:
        docs = self.table("documents").where("wiki_path is not null and text is not null")
        return resolve.latest(docs.select("wiki_path", "text", "doc_id"), ["wiki_path"], [F.desc("doc_id")])

    @property
    def active(self) -> DataFrame:
        return self.table("symbols").where("status = 'active'")

    def status(self, top: int = 10) -> dict[str, DataFrame]:
        files, symbols = self.table("files"), self.table("symbols")
        return {
            "files": status.count_by(files, "lang", "status"),
            "symbols": status.count_by(symbols, "kind", "status"),
            "top_files": status.top_files(files, symbols, top),
            "undocumented": ledger.undocumented(symbols, self.duty),
            "orphans": self.orphans(),
        }

    def impact(self, symbol_key: str, max_depth: int = 5, max_nodes: int = 200) -> dict[str, DataFrame]:
        """Callers of a symbol, and the pages that document it or them."""
        if not 1 <= max_depth <= 20 or not 1 <= max_nodes <= 2000:
            raise ValueError("max_depth is from 1 to 20, max_nodes from 1 to 2000")
        callers = graph.blast_radius(resolve.call_edges(self.table("calls")), symbol_key, max_depth, max_nodes)
        keys = callers.select(F.col("caller").alias("symbol_key")).unionByName(self.spark.createDataFrame([(symbol_key,)], "symbol_key string"))
        return {"callers": callers, "pages": self.duty.join(F.broadcast(keys.distinct()), "symbol_key", "left_semi").select("wiki_path", "symbol_key")}  # at most max_nodes + 1 keys

    def change_impact(self, changed: DataFrame) -> DataFrame:
        """changed: path."""
        return impact.change_impact(changed, self.table("symbols"), self.duty, self.edges)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        if not 1 <= limit <= 100:
            raise ValueError("limit is from 1 to 100")
        return search.search(self.pages, query, limit=limit)

    def read(self, wiki_path: str) -> DataFrame:
        return self.pages.where(F.col("wiki_path") == wiki_path).select("wiki_path", "text")

    def verify(self) -> DataFrame:
        return verify.verify_pages(parse_pages(self.pages), self.table("symbols"), self.table("doc_pages"))

    def baseline(self, entries: DataFrame | None = None) -> DataFrame:
        """States of baseline entries (default: one bootstrapped from the present symbols)."""
        symbols = self.active.groupBy("key").agg(F.max("name").alias("name"), F.max("content_hash").alias("content_hash"))
        entries = baseline_ops.bootstrap(self.duty, symbols) if entries is None else entries
        return ledger.evaluate_baseline(entries, symbols, self.duty)

    def changes(self) -> DataFrame:
        return snapshots.snapshot_changes(self.table("symbol_snapshots"))

    def orphans(self) -> DataFrame:
        """Orphaned references, direct and inherited."""
        return orphans.workspace_orphans(*(self.table(n) for n in ("files", "symbols", "shared_symbols", "calls", "doc_pages", "extracted_anchors")))

    def communities(self) -> DataFrame:
        return graph.communities(self.edges.select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")))
