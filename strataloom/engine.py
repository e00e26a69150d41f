"""An index over source trees: refresh, status, errors and search on published snapshots."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.extract import extracted
from strataloom.extract.lex import extension_language
from strataloom.extract.tables import kind_of
from strataloom.functions.vectors import HashVector, Vector
from strataloom.operators import search, snapshots, units
from strataloom.runtime import cut, drop, is_empty
from strataloom.sources.tree import fingerprints, read_tree

PARSER = "structure-1"
_UNITS = "repo string, path string, unit string, symbol_id int, qualified_name string, start_line int, end_line int, identity string, source_hash string, n_bytes int, input string, unit_id long"


@dataclass
class Refreshed:
    """What a refresh did; generation is unchanged where nothing was to do."""

    generation: int
    updated: int = 0
    deleted: int = 0
    functions: int = 0
    prepared: int = 0


class Engine:
    """Structure and vectors of the trees of repositories, in a ``SnapshotStore``.

    Tables: files (repo, path, hash, language, fingerprint, parser_version), sources (hash, source),
    declarations, units (with lasting unit_id), diagnostics, vectors (embedding_key, profile_key, vector).
    """

    def __init__(self, spark: SparkSession, root: str, provider: Vector | None = None):
        self.spark, self.store, self.provider = spark, snapshots.SnapshotStore(spark, root), provider or HashVector()

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.has(name) else self.spark.createDataFrame([], schema)

    def refresh_structure(self, tree: str, repo: str, rules: list[str] | None = None) -> Refreshed:
        """Bring one repository's tables up to date with its tree.

        Files are told to have changed by their fingerprint (size and modification time), by an
        older parser, or because they could not be read before. Only those are read and parsed.
        The list of files is taken again before publishing; if it changed meanwhile, nothing is
        published and the call fails. Unchanged files keep their rows, units of a lasting
        identity their id. Without any change no generation is made.
        """
        now = self.store.current()["generation"]
        old = self._table("files", "repo string, path string, hash string, language string, fingerprint string, parser_version string, n_bytes long")
        seen = cut(fingerprints(self.spark, tree, repo, rules))
        mine = old.where(F.col("repo") == repo)
        failed = self._table("diagnostics", "repo string, path string, code string, message string, start_line int").where((F.col("repo") == repo) & (F.col("code") == "read")).select("repo", "path").distinct()
        same = mine.where(F.col("parser_version") == PARSER).join(failed, ["repo", "path"], "left_anti").select("repo", "path", "fingerprint")
        changed = cut(seen.join(same, ["repo", "path", "fingerprint"], "left_anti").select("repo", "path", "fingerprint"))
        removed = cut(mine.join(seen, ["repo", "path"], "left_anti").select("repo", "path"))
        out = Refreshed(now, changed.count(), removed.count())
        if not out.updated and not out.deleted:
            drop(seen, changed, removed)
            return out
        files, unread = read_tree(self.spark, tree, repo, rules)
        read = cut(files.join(changed, ["repo", "path"]).withColumn("language", extension_language(F.col("path"))).withColumn("parser_version", F.lit(PARSER)))
        rows = cut(extracted(read.select(F.concat_ws(":", "hash", "language").alias("key"), "language", "source").distinct(), "key"))
        at = read.select("repo", "path", "language", F.concat_ws(":", "hash", "language").alias("key"))
        of = lambda what: at.join(kind_of(rows, what), "key").drop("key")
        decls = of("declaration").select("repo", "path", "language", "id", "parent_id", "ordinal", "kind", "name", "qualified_name", "signature", "description", "attributes", "start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column", "text")
        faults = of("fault").select("repo", "path", F.lit("parse").alias("code"), F.col("text").alias("message"), "start_line")
        faults = faults.unionByName(unread.join(changed, ["repo", "path"]).select("repo", "path", F.lit("read").alias("code"), "message", F.lit(None).cast("int").alias("start_line")))
        touched = cut(changed.select("repo", "path").unionByName(removed).distinct())
        kept = lambda name, new: (self.store.read(name).join(touched, ["repo", "path"], "left_anti").unionByName(new) if self.store.has(name) else new)
        made = units.assembled(decls, of("chunk").select("repo", "path", "id", "scope", "text", "start_line", "end_line", "start_byte"), keep_input=True)
        before = self._table("units", _UNITS)
        ids = snapshots.reconcile_ids(before.select("identity", "unit_id"), kept("units", made.withColumn("unit_id", F.lit(None).cast("long"))).select("identity"), "identity", "unit_id")
        every = kept("units", made.withColumn("unit_id", F.lit(None).cast("long"))).drop("unit_id").join(ids, "identity")
        new_sources = read.select("hash", "source").distinct()
        if self.store.has("sources"):
            have = self.store.read("sources")
            new_sources = have.unionByName(new_sources.join(have.select("hash"), "hash", "left_anti"))
        again = fingerprints(self.spark, tree, repo, rules)
        if not is_empty(again.exceptAll(seen).union(seen.exceptAll(again))):
            raise RuntimeError("the tree changed during the refresh")
        files_now = kept("files", read.select("repo", "path", "hash", "language", "fingerprint", "parser_version", "n_bytes"))
        out.functions = decls.where("text IS NOT NULL").count()
        out.generation = self.store.publish(
            {"files": files_now, "sources": new_sources, "declarations": kept("declarations", decls.drop("text")), "diagnostics": kept("diagnostics", faults), "units": every.select(*[c.split()[0] for c in _UNITS.split(", ")])}, now
        )
        drop(seen, changed, removed, touched, read, rows)
        return out

    def refresh(self, tree: str, repo: str, rules: list[str] | None = None) -> Refreshed:
        """Structure first, then vectors of units that the provider's profile lacks; other profiles stay as they are."""
        out = self.refresh_structure(tree, repo, rules)
        store = self._table("vectors", "embedding_key string, profile_key string, vector array<double>")
        new = cut(units.embedded(self._table("units", _UNITS), store, self.provider))
        out.prepared = new.count()
        if out.prepared:
            out.generation = self.store.publish({"vectors": store.unionByName(new)}, out.generation)
        drop(new)
        return out

    def status(self) -> DataFrame:
        """Files, units and vectors that are there and that are missing, by repository."""
        f = self.store.read("files").groupBy("repo").agg(F.count("*").alias("n_files"))
        u = units.associated(self.store.read("units"), self._table("vectors", "embedding_key string, profile_key string, vector array<double>"), self.provider.profile)
        u = u.groupBy("repo").agg(F.count("*").alias("n_units"), F.count("embedding_key").alias("n_vectors"))
        return f.join(u, "repo", "left").na.fill(0)

    def errors(self) -> DataFrame:
        """Saved messages in the order of files and lines."""
        return self.store.read("diagnostics").orderBy("repo", "path", "start_line", "message")

    def search(self, texts: list[str], limit: int | None | str = None, low: float = 0.3, selection: search.Selection | None = None) -> DataFrame:
        """Units near any of the texts: query, unit_id, repo, path, name, lines, score, rank, omitted.

        Fails if a selected unit has no vector in the provider's profile.
        """
        v = self.provider.embed(sorted(set(texts)), True)
        asked = self.spark.createDataFrame([(t, [float(x) for x in r]) for t, r in zip(sorted(set(texts)), v, strict=True)], "query_id string, vector array<double>")
        u = self.store.read("units")
        if selection:
            u = u.where(selection.files(F.col("path")) & selection.named(F.col("qualified_name")))
        store = self._table("vectors", "embedding_key string, profile_key string, vector array<double>").where(F.col("profile_key") == self.provider.profile)
        at = units.associated(u, store, self.provider.profile)
        missing = at.where("embedding_key IS NULL").limit(1).count()
        if missing:
            raise RuntimeError("units without a vector: refresh first")
        keyed = at.select("unit_id", F.col("unit").alias("channel"), F.col("embedding_key").alias("key"))
        vectors = store.join(keyed.select(F.col("key").alias("embedding_key")).distinct(), "embedding_key", "left_semi").select(F.col("embedding_key").alias("key"), "vector")
        one = search.merged(search.unit_hits(asked, keyed, vectors, low), ["unit_id"], ["query_id"])
        top = search.limited(one, ["unit_id"], search.resolved_limit(limit))
        return top.join(u.select("unit_id", "repo", "path", "qualified_name", "start_line", "end_line"), "unit_id").orderBy("rank")

    def cached_search(self, texts: list[str], limit: int | None | str = None, low: float = 0.3) -> DataFrame:
        """As ``search`` without a selection, kept under the generation: the same question of the same generation is answered from its table."""
        now = self.store.current()["generation"]
        asked = hashlib.sha256(json.dumps([sorted(set(texts)), search.resolved_limit(limit), low, self.provider.profile]).encode()).hexdigest()[:32]
        path = f"{self.store.root}/results/{now}/{asked}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            self.search(texts, limit, low).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).orderBy("rank")


def unindexed(spark: SparkSession, tree: str, repo: str, rules: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables read and parsed from a tree without an index: files, declarations, imports, calls, spans, faults."""
    files, _ = read_tree(spark, tree, repo, rules)
    files = files.withColumn("language", extension_language(F.col("path")))
    rows = extracted(files.select(F.concat_ws(":", "hash", "language").alias("key"), "language", "source").distinct(), "key")
    at = files.select("repo", "path", "language", F.concat_ws(":", "hash", "language").alias("key"))
    of = lambda *what: at.join(rows.where(F.col("what").isin(*what)), "key").drop("key")
    return {"files": files, "declarations": of("declaration"), "imports": of("import"), "calls": of("call"), "spans": of("comment", "test"), "faults": of("fault")}
