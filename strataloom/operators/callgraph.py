"""Calls resolved by scopes, receivers and imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLABLE = ["function", "method", "constructor", "generator"]
CONTAINERS = ["class", "struct", "impl", "interface", "trait", "module", "namespace", "enum"]
_SELF = ["self", "this", "Self", "cls", "super"]
_SCRIPTS = ["javascript", "typescript", "jsx", "tsx"]


def import_keys(imports: DataFrame) -> DataFrame:
    """``imports`` (repo, path, language, target, ...) with ``key``: one row for each file key that a target may name.

    A key is what ``file_keys`` gives for a file: Python modules by path without extension or
    package, relative script paths resolved against the importing file, the last segment of Go
    packages, Java classes and Rust modules by path. Leading dots of Python are dropped.
    """
    t, lang = F.col("target"), F.col("language")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    dots = F.length(F.regexp_extract(t, r"^((?:\.\./)*)", 1)) / 3
    up = F.regexp_replace(F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - 1 - dots.cast("int"), F.lit(0))), "/"), r"(.)$", "$1/")
    bare = F.regexp_replace(F.regexp_replace(t, r"^(?:\./|(?:\.\./)+)", ""), r"\.[cm]?[jt]sx?$|/index$", "")
    key = (
        F.when(lang == "python", F.array(F.replace(F.regexp_replace(t, r"^\.+", ""), F.lit("."), F.lit("/")), F.concat_ws("/", F.nullif(F.replace(F.regexp_replace(t, r"^\.+", ""), F.lit("."), F.lit("/")), F.lit("")), "name")))
        .when(lang.isin(_SCRIPTS) & t.startswith("."), F.array(F.concat(up, bare)))
        .when(lang == "go", F.array(F.regexp_extract(t, r"([^/]+)$", 1)))
        .when(lang == "java", F.array(F.replace(t, F.lit("."), F.lit("/"))))
        .when(lang == "rust", F.array(F.regexp_replace(F.replace(t, F.lit("::"), F.lit("/")), r"^(?:crate|self|super)/?", "")))
        .when(lang == "c", F.array(F.regexp_replace(t, r"\.[ch]$", "")))
    )
    return imports.withColumn("key", F.explode(F.array_distinct(key))).where("key <> ''")


def file_keys(files: DataFrame) -> DataFrame:
    """(repo, path, language, key): the keys under which a file (repo, path, language) can be imported.

    Every suffix of its path without extension; of scripts the whole path only; of Go its folder's name.
    """
    stem = F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), r"/(?:__init__|index|mod)$", "")
    parts = F.split(stem, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    key = F.when(F.col("language").isin(_SCRIPTS), F.array(stem)).when(F.col("language") == "go", F.array(F.element_at(F.split(F.concat(F.lit("/"), "path"), "/"), -2))).otherwise(suffixes)
    return files.select("repo", "path", "language", F.explode(key).alias("key")).where("key <> ''")


def static(attributes: Column, kind: Column, signature: Column) -> Column:
    """Whether a member can be called through its type: constructors, static members, and functions without self."""
    return (kind == "constructor") | F.coalesce(F.array_contains(attributes, "static"), F.lit(False)) | (F.coalesce(signature, F.lit("")).rlike(r"^(pub )?(async )?fn ") & ~F.coalesce(signature, F.lit("")).rlike(r"\bself\b"))


def resolved_calls(decls: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, src_path, src_id, dst_path, dst_id): calls of callables with exactly one possible target.

    decls: repo, path, language, id, parent_id, kind, name, scope, attributes, signature; calls: repo,
    path, parent_id (the calling callable), name, target (receiver); imports: repo, path, language,
    target, name, alias, wildcard. A name alone means a callable at the top or of an enclosing
    scope (in Python and scripts never a class's member), a self word a member of the nearest
    container, a type's name its members, an imported name or namespace what its file declares,
    and a Python class without other candidates its constructor. All joins are on names within a
    repository; candidates of all rules are counted together.
    """
    d = decls.where(F.col("name").isNotNull())
    parent = decls.select("repo", "path", F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"))
    target = d.where(F.col("kind").isin(CALLABLE)).join(parent, ["repo", "path", "parent_id"], "left")
    target = target.select(F.col("repo").alias("t_repo"), F.col("path").alias("dst_path"), F.col("id").alias("dst_id"), F.col("name").alias("t_name"), "language", F.col("parent_id").alias("holder"), "parent_kind", "parent_name", F.col("scope").alias("dst_scope"), "kind", "attributes", "signature")
    owner = d.where(F.col("kind").isin(CALLABLE)).select("repo", "path", F.col("id").alias("src_id"), F.concat("scope", F.array("name")).alias("own"), F.col("parent_id").alias("up"), F.col("language").alias("lang"))
    c = calls.where("parent_id IS NOT NULL").select("repo", "path", F.col("parent_id").alias("src_id"), "name", F.col("target").alias("receiver")).distinct().join(owner, ["repo", "path", "src_id"])
    script = F.col("lang").isin("python", *_SCRIPTS)
    here = c.join(target, (F.col("repo") == F.col("t_repo")) & (F.col("path") == F.col("dst_path")) & (F.col("name") == F.col("t_name")))
    inner = F.col("dst_scope") == F.slice("own", 1, F.size("dst_scope"))
    bare = here.where(F.col("receiver").isNull() & (F.col("holder").isNull() | (inner & (~script | F.col("parent_kind").isin(*CALLABLE, "module", "namespace")))))
    own_type = here.where(F.col("receiver").isin(_SELF) & (F.col("holder") == F.col("up")))
    typed = here.where((F.col("receiver") == F.col("parent_name")) & ~F.col("receiver").isin(_SELF))
    # imports: local name, and the files that the path may mean
    i = import_keys(imports).join(file_keys(decls.select("repo", "path", "language").distinct()).withColumnRenamed("path", "dst_path").drop("language"), ["repo", "key"])
    local = F.coalesce("alias", F.when(F.col("language") == "go", F.regexp_extract("target", r"([^/]+)$", 1)).otherwise(F.coalesce(F.nullif("name", F.lit("*")), F.regexp_extract("target", r"(\w+)$", 1))))
    i = i.select(F.col("repo").alias("i_repo"), F.col("path").alias("i_path"), F.col("dst_path").alias("i_dst"), "wildcard", F.col("name").alias("imported"), local.alias("local")).distinct()
    from_here = (F.col("repo") == F.col("i_repo")) & (F.col("path") == F.col("i_path"))
    in_there = (F.col("repo") == F.col("t_repo")) & (F.col("i_dst") == F.col("dst_path"))
    named = c.where("receiver IS NULL").join(i.where("imported IS NOT NULL"), from_here & ((F.col("local") == F.col("name")) | (F.col("wildcard") & (F.col("imported") == "*"))))
    named = named.withColumn("wanted", F.when(F.col("wildcard"), F.col("name")).otherwise(F.col("imported")))
    named = named.join(target.where("holder IS NULL"), in_there & (F.col("wanted") == F.col("t_name")))
    space = c.where("receiver IS NOT NULL").join(i, from_here & (F.col("receiver") == F.col("local"))).join(target, in_there & (F.col("name") == F.col("t_name")))
    space = space.where(F.col("holder").isNull() | ((F.col("parent_name") == F.col("imported")) & static(F.col("attributes"), F.col("kind"), F.col("signature"))))
    columns = ["repo", "path", "src_id", "dst_path", "dst_id"]
    parts = [x.select(*columns, F.coalesce(F.col("called"), F.lit("")).alias("called"), "receiver") for x in (p.withColumn("called", F.col("name")) for p in (bare, own_type, typed, named, space))]
    found = reduce(DataFrame.unionByName, parts)
    # a class that is called: its constructor, where no callable has the name
    made = d.where("kind = 'class' AND language = 'python'").select(F.col("repo").alias("m_repo"), F.col("path").alias("m_path"), F.col("id").alias("m_id"), F.col("name").alias("class_name"))
    made = made.join(target.where("kind = 'constructor' AND t_name = '__init__'"), (F.col("m_repo") == F.col("t_repo")) & (F.col("m_path") == F.col("dst_path")) & (F.col("m_id") == F.col("holder"))).select("m_repo", "dst_path", "dst_id", "class_name")
    new = c.where("receiver IS NULL AND lang = 'python'").join(made, (F.col("repo") == F.col("m_repo")) & (F.col("path") == F.col("dst_path")) & (F.col("name") == F.col("class_name")))
    new = new.select(*columns, F.col("name").alias("called"), "receiver").join(found.select("repo", "path", "src_id", "called").distinct(), ["repo", "path", "src_id", "called"], "left_anti").select(*columns, "called", "receiver")
    every = found.unionByName(new).distinct()
    n = every.groupBy("repo", "path", "src_id", "called", "receiver").agg(F.count("*").alias("n"), F.first("dst_path").alias("dst_path"), F.first("dst_id").alias("dst_id"))
    return n.where("n = 1").select("repo", F.col("path").alias("src_path"), "src_id", "dst_path", "dst_id").distinct()


def resolved_references(decls: DataFrame, uses: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, src_path, src_id, dst_path, dst_id): uses of names with exactly one declaration that they can mean.

    decls, imports: as for ``resolved_calls``; uses: repo, path, parent_id (the innermost declaration, null at the
    top), name. A name means the top declaration of its file, or what an import of its file binds it
    to; where both or several are possible, there is no reference. A declaration does not refer to itself.
    """
    top = decls.where("parent_id IS NULL AND name IS NOT NULL").select(F.col("repo").alias("t_repo"), F.col("path").alias("dst_path"), F.col("id").alias("dst_id"), F.col("name").alias("t_name"))
    u = uses.select("repo", "path", F.col("parent_id").alias("src_id"), "name").distinct()
    here = u.join(top, (F.col("repo") == F.col("t_repo")) & (F.col("path") == F.col("dst_path")) & (F.col("name") == F.col("t_name")))
    i = import_keys(imports).join(file_keys(decls.select("repo", "path", "language").distinct()).withColumnRenamed("path", "i_dst").drop("language"), ["repo", "key"])
    i = i.where("name IS NOT NULL").select(F.col("repo").alias("i_repo"), F.col("path").alias("i_path"), "i_dst", F.col("name").alias("imported"), F.coalesce("alias", "name").alias("local")).distinct()
    there = u.join(i, (F.col("repo") == F.col("i_repo")) & (F.col("path") == F.col("i_path")) & (F.col("name") == F.col("local")))
    there = there.join(top, (F.col("repo") == F.col("t_repo")) & (F.col("i_dst") == F.col("dst_path")) & (F.col("imported") == F.col("t_name")))
    columns = ["repo", "path", "src_id", "name", "dst_path", "dst_id"]
    every = here.select(*columns).unionByName(there.select(*columns)).distinct()
    n = every.groupBy("repo", "path", "src_id", "name").agg(F.count("*").alias("n"), F.first("dst_path").alias("dst_path"), F.first("dst_id").alias("dst_id")).where("n = 1")
    out = n.where(~((F.col("path") == F.col("dst_path")) & F.col("src_id").eqNullSafe(F.col("dst_id"))))
    return out.select("repo", F.col("path").alias("src_path"), "src_id", "dst_path", "dst_id").distinct()


def import_cycles(edges: DataFrame, depth: int = 64) -> DataFrame:
    """(repo, path): files that import themselves by way of others; edges: repo, src_path, dst_path.

    Ends that nothing enters or that lead nowhere are cut off again and again; what stays lies
    on a circle or between two. ``depth`` bounds the rounds; a longer tail is an error.
    """
    from strataloom.runtime import cut, drop

    left = cut(edges.select("repo", "src_path", "dst_path").where("src_path IS NOT NULL AND dst_path IS NOT NULL").distinct())
    n = left.count()
    for _ in range(depth):
        starts, ends = left.select("repo", F.col("src_path").alias("dst_path")).distinct(), left.select("repo", F.col("dst_path").alias("src_path")).distinct()
        new = cut(left.join(starts, ["repo", "dst_path"], "left_semi").join(ends, ["repo", "src_path"], "left_semi").select("repo", "src_path", "dst_path"))
        drop(left)
        left, m = new, new.count()
        if m == n:
            return left.select("repo", F.col("src_path").alias("path")).distinct()
        n = m
    raise RuntimeError(f"chains of over {depth} files lead to no circle")
