"""Resolution of import specifiers to files and packages, and of re-exports, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.values import directory_name, package_reference
from loomgraph.sources.shared import materialize, release

#: Which endings stand in for a written one, and what is tried where none is written, in this order.
INSTEAD = {".js": (".ts", ".tsx"), ".mjs": (".mts",), ".cjs": (".cts",)}
ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx")
INDEXES = ("/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: Of a package's own entries.
ENTRY_INSTEAD = {".js": (".ts", ".tsx", ".d.ts"), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts")}
ENTRY_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts")
ENTRY_INDEXES = ("/index.ts", "/index.tsx", "/index.mts", "/index.cts", "/index.js", "/index.jsx")
OUTPUTS = ("build", "dist", "lib")


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` seen from the folder ``base`` (. for the root), . and .. worked out; null where it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(base != ".", base), relative), "/"), lambda p: ~p.isin("", "."))
    # a .. takes the last part away; one too many marks the path by a lone ..
    step = lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).when((F.size(done) == 0) | F.array_contains(done, ".."), F.array(F.lit(".."))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    out = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(out, ".."), F.array_join(out, "/"))


def relative_candidates(base: Column) -> Column:
    """Files that a relative specifier may mean, first hit wins."""
    swapped = [F.when(F.lower(base).endswith(end), F.concat(F.substring(base, F.lit(1), F.length(base) - len(end)), F.lit(e))) for end, new in INSTEAD.items() for e in new]
    return F.array_compact(F.array(base, *swapped, *[F.concat(base, F.lit(e)) for e in (*ENDINGS, *INDEXES)]))


def entry_candidates(target: Column, package_root: Column) -> Column:
    """Files that an entry of a package may mean: as written, by its source, by an ending or index; then the same below src for outputs."""

    def around(t: Column) -> list[Column]:
        low, name = F.lower(t), F.substring_index(t, "/", -1)
        swapped = [F.when(low.endswith(end), F.concat(F.substring(t, F.lit(1), F.length(t) - len(end)), F.lit(e))) for end, new in ENTRY_INSTEAD.items() for e in new]
        bare = ~F.substring(name, F.lit(2), F.length(name)).contains(".")
        return [t, *swapped, *[F.when(bare, F.concat(t, F.lit(e))) for e in (*ENTRY_ENDINGS, *ENTRY_INDEXES)]]

    below = F.when(package_root == ".", target).otherwise(F.substring(target, F.length(package_root) + 2, F.length(target)))
    first = F.lower(F.substring_index(below, "/", 1))
    rest = F.regexp_extract(below, "^[^/]+/(.+)$", 1)
    source = F.when(first.isin(*OUTPUTS) & (rest != ""), F.concat_ws("/", F.when(package_root != ".", package_root), F.lit("src"), rest))
    return F.array_compact(F.array(*around(target), *around(source)))


def owning_package(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Adds package, package_root of the workspace package that a specifier names: equal to its name or below it.

    Of several the one with the longest root folder, then the least name.  The names a specifier can mean are its own prefixes at
    each /, so the packages are met by an equi-join.
    """
    parts = F.split("specifier", "/")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = imports.select("specifier").distinct().withColumn("package", F.explode(names))
    p = packages.select(F.col("name").alias("package"), F.col("root").alias("package_root"))
    best = asked.join(p, "package").groupBy("specifier").agg(F.min(F.struct((-F.length("package_root")).alias("w"), "package", "package_root")).alias("m"))
    return imports.join(best.select("specifier", "m.package", "m.package_root"), "specifier", "left")


def first_hit(asked: DataFrame, keys: list[str], files: DataFrame) -> DataFrame:
    """(keys, file): of each row's ``candidates`` the first that ``files`` (path) has, upper and lower case alike."""
    have = files.select(F.lower("path").alias("low"), F.col("path").alias("file"))
    tried = asked.select(*keys, F.posexplode("candidates").alias("pos", "candidate")).withColumn("low", F.lower("candidate"))
    return tried.join(have, "low").groupBy(*keys).agg(F.min(F.struct("pos", "file")).alias("m")).select(*keys, "m.file")


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file_path, specifier, kind, target, reason) of imports (file_path, specifier).

    packages: name, root, entry (what the package says its file is for ``subpath``, here of the package itself; null: ./src/index).
    In this order: a workspace package's file, a relative file, an external package; else unresolved, with the reason.
    """
    pairs = materialize(imports.select("file_path", "specifier").distinct(), "imports")
    # what a specifier names is worked out once for each folder that asks, and written: the optimizer would repeat it in each candidate
    folder = F.when(F.col("file_path").isNotNull(), directory_name(F.col("file_path")))
    asked = pairs.select(folder.alias("folder"), "specifier").distinct()
    i = owning_package(asked, packages)
    entry = packages.select(F.col("name").alias("package"), "entry")
    i = i.join(entry, "package", "left")
    below = F.substring("specifier", F.length("package") + 2, F.length("specifier"))
    wanted = F.when(F.col("specifier") == F.col("package"), F.coalesce("entry", F.lit("./src/index"))).otherwise(F.concat(F.lit("./"), below))
    by_package, by_path = F.col("package").isNotNull(), F.col("package").isNull() & F.col("specifier").startswith(".")
    i = i.withColumn("wanted", wanted)
    base = F.when(by_package, F.when(F.col("wanted").startswith("./"), F.col("package_root"))).when(by_path, F.col("folder"))
    i = i.withColumn("base", base)
    means = joined_path(F.col("base"), F.when(by_package, F.col("wanted")).otherwise(F.col("specifier")))
    i = materialize(i.withColumn("means", F.when(F.col("base").isNotNull(), means)), "specifiers")
    below_root = (F.col("package_root") == ".") | F.startswith("means", F.concat("package_root", F.lit("/")))
    # paths that many specifiers mean are looked up once
    meant = i.where("means IS NOT NULL").where(F.when(by_package, below_root).otherwise(True)).select("means", "package_root").distinct()
    of_root = F.when(F.col("package_root").isNotNull(), entry_candidates(F.col("means"), F.col("package_root"))).otherwise(relative_candidates(F.col("means")))
    tried = materialize(meant.withColumn("candidates", of_root), "candidates")
    hits_table = materialize(first_hit(tried, ["means", "package_root"], files), "hits")
    release(tried)
    same_root = F.col("package_root").eqNullSafe(F.col("hit_root"))
    hits = hits_table.select(F.col("means").alias("hit"), F.col("package_root").alias("hit_root"), "file")
    found = i.join(hits, (F.col("means") == F.col("hit")) & same_root, "left")
    external = package_reference(F.col("specifier"))
    kind = F.when(F.col("file").isNotNull(), "FILE").when(~by_package & ~by_path & external.isNotNull(), "EXTERNAL_PACKAGE").otherwise("UNRESOLVED")
    target = F.coalesce("file", F.when(~by_package & ~by_path, external["package"]))
    reason = F.when(F.col("kind") == "UNRESOLVED", F.when(by_package | by_path, "OUTSIDE_ANALYSIS_SCOPE").otherwise("UNSUPPORTED_SYNTAX"))
    named = found.select("folder", "specifier", "package", kind.alias("kind"), target.alias("target"))
    named = materialize(named.select(F.col("folder").alias("of_folder"), F.col("specifier").alias("of"), "kind", "target", reason.alias("reason")), "resolved")
    release(i, hits_table)
    of = folder.eqNullSafe(F.col("of_folder")) & F.col("specifier").eqNullSafe(F.col("of"))
    return pairs.join(named, of).select("file_path", "specifier", "kind", "target", "reason")


def star_exports(own: DataFrame, stars: DataFrame, top_level: DataFrame) -> DataFrame:
    """(file, entity): what each file exports once star re-exports have spread.

    own: (file, entity) exported by name; stars: (file, target) of ``export * from``; top_level: (file, entity) declared as exported,
    which stands in for a target file without exports of its own.  Rounds end when nothing new is exported; they are as many as the
    longest chain of re-exports.
    """
    has = own.select("file").distinct()
    fallback = top_level.join(has, "file", "left_anti").join(stars.select(F.col("target").alias("file")).distinct(), "file", "left_semi")
    # a file without exports that re-exports nothing itself offers what it declares; one that gains exports offers those instead
    relays = stars.select("file").distinct()
    known = materialize(own.select("file", "entity").distinct(), "exports")
    offer = materialize(fallback.join(relays, "file", "left_anti").select("file", "entity").union(known).distinct(), "exports")
    links = stars.select(F.col("target").alias("from"), "file").distinct()
    fresh = offer
    while True:
        gained = fresh.select(F.col("file").alias("from"), "entity").join(links, "from").select("file", "entity").distinct()
        fresh = materialize(gained.join(known, ["file", "entity"], "left_anti"), "exports")
        if fresh.isEmpty():
            break
        after = materialize(known.union(fresh), "exports")
        release(known)
        known = after
    return known


def bindings(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(file_path, local, entity): local names of imports (file_path, target_file, imported, local) and the exported entities they mean.

    imported is ``default`` for a default import; exports: file, name, default_export, entity.  Of several the least entity.
    """
    by_default = F.coalesce(F.col("imported") == "default", F.lit(False))
    asked = imports.select("file_path", "local", "target_file", by_default.alias("by_default"), F.when(by_default, "").otherwise(F.col("imported")).alias("name"))
    # one entity a name and one a default import before files meet, so a file's imports don't meet all its exports
    e = exports.select(F.col("file").alias("target_file"), "name", "default_export", "entity")
    named = e.select("target_file", F.lit(False).alias("by_default"), "name", "entity")
    offered = named.union(e.where("default_export").select("target_file", F.lit(True), F.lit(""), "entity"))
    offered = offered.groupBy("target_file", "by_default", "name").agg(F.min("entity").alias("entity"))
    return asked.join(offered, ["target_file", "by_default", "name"]).groupBy("file_path", "local").agg(F.min("entity").alias("entity"))


#: Which kind a bare name means first.
SYMBOL_KINDS = ("FUNCTION", "COMPONENT", "VARIABLE", "CLASS", "INTERFACE")


def symbols(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_path, name, stable_key): the top-level entity that a name (file_path, name) means, by the order of ``SYMBOL_KINDS``."""
    rank = F.array_position(F.array(*[F.lit(k) for k in SYMBOL_KINDS]), F.col("kind"))
    e = entities.select("file_path", F.col("qualified_name").alias("name"), "stable_key", rank.alias("r")).where("r > 0")
    return names.join(e, ["file_path", "name"]).groupBy("file_path", "name").agg(F.min(F.struct("r", "stable_key")).alias("m")).select("file_path", "name", "m.stable_key")


def preferred_program(memberships: DataFrame) -> DataFrame:
    """(file_path, config_path): of the programs of a file (file_path, config_path or null, is_root) the one whose context is used.

    First one that names the file as a root, then one whose folder holds it, then the deepest folder, then the least path.
    """
    folder = F.regexp_replace(directory_name(F.coalesce("config_path", F.lit(""))), "^\\.$", "")
    owns = F.col("config_path").isNotNull() & ((folder == "") | F.startswith(F.col("file_path"), F.concat(folder, F.lit("/"))))
    order = F.struct((~F.col("is_root")).alias("a"), (~owns).alias("b"), (-F.length(folder)).alias("c"), F.coalesce("config_path", F.lit("~")).alias("d"), F.col("config_path"))
    return memberships.groupBy("file_path").agg(F.min(order).alias("m")).select("file_path", "m.config_path")
