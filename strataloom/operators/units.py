"""Search units: assembling, embedding what is missing, and associating keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.vectors import Vector, embed_table
from strataloom.operators.callgraph import CALLABLE
from strataloom.operators.sections import occurrences


def embedding_input(language, kind, name, signature, description, source):
    """The text that a unit is embedded by: what is there of its parts, a line each."""
    return F.concat_ws("\n", language, kind, name, signature, F.nullif(F.trim(description), F.lit("")), source)


def assembled(decls: DataFrame, chunks: DataFrame, keep_input: bool = False) -> DataFrame:
    """Units of three kinds with ``identity``: callables, other declarations that are described, and chunks.

    decls: repo, path, language, id, kind, name, qualified_name, signature, description, start_line,
    end_line, start_byte, text; chunks: repo, path, id, scope, text, start_line, end_line,
    start_byte. Identity is the hash of file, kind, name and the occurrence among equal names of a
    file, so it outlives changes elsewhere.
    """
    callable_ = F.col("kind").isin(CALLABLE)
    d = decls.where(callable_ | (F.coalesce("description", F.lit("")) != "")).withColumn("unit", F.when(callable_, "callable").otherwise("description"))
    text = F.when(callable_, embedding_input("language", "kind", "qualified_name", "signature", "description", "text")).otherwise(embedding_input("language", "kind", "qualified_name", "signature", "description", F.lit(None)))
    d = d.select("repo", "path", "unit", F.col("id").alias("symbol_id"), "qualified_name", "start_line", "end_line", "start_byte", text.alias("input"))
    c = chunks.select("repo", "path", F.lit("chunk").alias("unit"), F.lit(None).cast("int").alias("symbol_id"), F.array_join("scope", " / ").alias("qualified_name"), "start_line", "end_line", "start_byte", F.col("text").alias("input"))
    u = occurrences(d.unionByName(c), ["repo", "path", "unit"], "qualified_name", ["start_byte", "symbol_id"])
    identity = F.sha2(F.concat_ws("\x1f", "repo", "path", "unit", "qualified_name", "occurrence"), 256)
    return u.select("repo", "path", "unit", "symbol_id", "qualified_name", "start_line", "end_line", identity.alias("identity"), F.sha2("input", 256).alias("source_hash"), F.octet_length("input").alias("n_bytes"), *(["input"] if keep_input else []))


def missing_inputs(units: DataFrame, store: DataFrame, profile: str) -> DataFrame:
    """(key, input): distinct inputs that the store (embedding_key, profile_key) has no vector of in a profile.

    units: input. The key is the hash of profile and input, so equal texts are embedded once.
    """
    key = F.sha2(F.concat_ws("\x1f", F.lit(profile), "input"), 256)
    want = units.where("input IS NOT NULL").select(key.alias("key"), "input").distinct()
    have = store.where(F.col("profile_key") == profile).select(F.col("embedding_key").alias("key"))
    return want.join(have, "key", "left_anti")


def embedded(units: DataFrame, store: DataFrame, provider: Vector) -> DataFrame:
    """(embedding_key, profile_key, vector) of what is missing, to be appended to the store.

    Only usable vectors come out, so a text that a provider fails on stays missing. Running it
    again after an append gives nothing.
    """
    made = embed_table(missing_inputs(units, store, provider.profile), "key", "input", provider)
    return made.select(F.col("key").alias("embedding_key"), F.lit(provider.profile).alias("profile_key"), "vector")


def associated(units: DataFrame, store: DataFrame, profile: str) -> DataFrame:
    """``units`` (with input) with ``embedding_key``: null where the profile has no vector of the text."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(profile), "input"), 256)
    have = store.where(F.col("profile_key") == profile).select(F.col("embedding_key").alias("_k")).distinct()
    return units.withColumn("_k", key).join(have.withColumn("embedding_key", F.col("_k")), "_k", "left").drop("_k")
