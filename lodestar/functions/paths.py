"""Absolute paths of any kind as columns: drives, shares and POSIX, their roots, and where they lie in a container.

A path has a kind (``c:``, ``//host`` or ``/``) and parts. Drives and shares ignore case; a backslash separates there, and is a
character like any other in a POSIX path. Surrounding quotes and white space go, as does what a trailing separator adds. A path
that goes up is no path: its parts are null.

A root is a folder that is mounted under an alias; a path belongs to the root with the longest matching path. Candidate roots are found by equality: all
prefixes of the roots have a few lengths, and a path is cut to these and no others, so it costs as many rows as roots have lengths,
however deep it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.arrays import let

#: Roots that are broadcast; more are joined.
MOST_BROADCAST = 100_000


def bare(path: Column) -> Column:
    """Without white space and quotes around it."""
    t = F.btrim(path)
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"^\"(.*)\"$", "$1"), "^'(.*)'$", "$1"))


def parsed(path: Column) -> Column:
    """(kind, parts); null for what is no absolute path or goes up."""

    def of(p: Column) -> Column:
        slashed = F.replace(p, F.lit("\\"), F.lit("/"))
        drive, share = F.regexp_like(p, F.lit(r"^[A-Za-z]:([\\/]|$)")), F.regexp_like(slashed, F.lit("^//[^/]"))
        kind = F.when(drive, F.lower(F.left(p, F.lit(2)))).when(share, F.lower(F.regexp_extract(slashed, "^(//[^/]+)", 1))).when(p.startswith("/"), "/")
        rest = F.when(drive, F.substring(slashed, F.lit(3), F.length(p))).when(share, F.regexp_replace(slashed, "^//[^/]+", "")).otherwise(p)
        parts = F.filter(F.split(rest, "/"), lambda x: ~x.isin("", "."))
        return F.when(kind.isNotNull() & ~F.array_contains(parts, ".."), F.struct(kind.alias("kind"), parts.alias("parts")))

    return let(bare(path), of)


def folded(kind: Column, parts: Column) -> Column:
    """The parts as they are compared: without case, but for POSIX paths."""
    return F.when(kind == "/", parts).otherwise(F.transform(parts, F.lower))


def path_text(kind: Column, parts: Column) -> Column:
    """The path in its usual form: ``C:\\a``, ``\\\\host\\share`` or ``/a``."""
    back = F.array_join(parts, "\\")
    share = F.concat(F.replace(kind, F.lit("/"), F.lit("\\")), F.when(F.size(parts) > 0, F.concat(F.lit("\\"), back)).otherwise(""))
    return F.when(kind == "/", F.concat(F.lit("/"), F.array_join(parts, "/"))).when(kind.startswith("//"), share).otherwise(F.concat(F.upper(kind), F.lit("\\"), back))


def root_alias(path: Column) -> Column:
    """The name of a root: its drive, ``unc`` and host, or nothing, and its parts, in small letters, with underscores between."""

    def of(p: Column) -> Column:
        first = F.when(p["kind"] == "/", F.array().cast("array<string>")).when(p["kind"].startswith("//"), F.array(F.lit("unc"), F.substring(p["kind"], F.lit(3), F.length(p["kind"])))).otherwise(F.array(F.left(p["kind"], F.lit(1))))
        name = F.regexp_replace(F.regexp_replace(F.lower(F.array_join(F.concat(first, p["parts"]), "_")), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
        return F.when(name == "", "root").otherwise(name)

    return let(parsed(path), of)


def _prefix(kind: Column, parts: Column, n: Column) -> Column:
    return F.concat_ws("/", kind, F.array_join(F.slice(folded(kind, parts), F.lit(1), n), "/"))


def root_aliases(roots: DataFrame) -> DataFrame:
    """Roots (root_id, root_path) -> the same with alias: of equal names the later ones, by id, get _2, _3 and so on, whichever is free.

    Roots are what is mounted into one container, a list that is written by hand: they are looked at in one row.
    """
    listed = roots.where(parsed(F.col("root_path")).isNotNull()).select(F.struct("root_id", "root_path", root_alias(F.col("root_path")).alias("name")).alias("r"))
    taken = F.array().cast("array<string>")

    def add(seen: Column, r: Column) -> Column:
        names = F.transform(F.sequence(F.lit(1), F.size(seen) + 1), lambda n: F.when(n == 1, r["name"]).otherwise(F.concat(r["name"], F.lit("_"), n.cast("string"))))
        return F.concat(seen, F.array(F.element_at(F.filter(names, lambda x: ~F.array_contains(seen, x)), 1)))

    whole = listed.agg(F.sort_array(F.collect_list("r")).alias("all")).withColumn("names", F.aggregate("all", taken, add))
    return whole.select(F.explode(F.zip_with("all", "names", lambda r, n: F.struct(r["root_id"].alias("root_id"), r["root_path"].alias("root_path"), n.alias("alias")))).alias("x")).select("x.*")


def path_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths (id, path) and roots (root_id, root_path) -> (id, root_id, rel_path): the most specific root of each path that has one.

    Of roots with the same path the smallest id.
    """
    r = roots.select("root_id", parsed(F.col("root_path")).alias("p")).where("p IS NOT NULL").select("root_id", F.col("p.kind").alias("kind"), F.col("p.parts").alias("parts"))
    r = r.select("kind", F.size("parts").alias("depth"), _prefix(F.col("kind"), F.col("parts"), F.size("parts")).alias("prefix"), "root_id").groupBy("kind", "depth", "prefix").agg(F.min("root_id").alias("root_id"))
    depths = r.groupBy(F.col("kind").alias("of")).agg(F.sort_array(F.collect_set("depth")).alias("depths"))  # a row for each drive, share and POSIX
    p = paths.select("id", parsed(F.col("path")).alias("p")).where("p IS NOT NULL").select("id", F.col("p.kind").alias("kind"), F.col("p.parts").alias("parts"))
    near = F.broadcast if r.count() <= MOST_BROADCAST else lambda df: df
    cut = p.join(near(depths), F.col("kind") == F.col("of")).select("id", "kind", "parts", F.explode(F.filter("depths", lambda d: d <= F.size("parts"))).alias("depth"))
    met = cut.withColumn("prefix", _prefix(F.col("kind"), F.col("parts"), F.col("depth"))).join(near(r.select("prefix", "root_id")), "prefix")
    best = met.groupBy("id").agg(F.max_by(F.struct("root_id", "parts", "depth"), "depth").alias("b"))
    return best.select("id", F.col("b.root_id").alias("root_id"), F.array_join(F.slice("b.parts", F.col("b.depth") + 1, F.greatest(F.size("b.parts"), F.lit(1))), "/").alias("rel_path"))


def host_to_container(paths: DataFrame, roots: DataFrame, mount: str = "/roots") -> DataFrame:
    """Paths (id, path), roots (root_id, root_path, alias) -> (id, root_id, container_path): where the path lies under the mounts."""
    found = path_roots(paths, roots).join(roots.select("root_id", "alias"), "root_id")
    return found.select("id", "root_id", F.concat_ws("/", F.lit(mount), "alias", F.nullif("rel_path", F.lit(""))).alias("container_path"))


def container_to_host(paths: DataFrame, roots: DataFrame, mount: str = "/roots") -> DataFrame:
    """Paths (id, container_path) back to (id, root_id, path)."""
    below = F.when(F.startswith("container_path", F.lit(mount + "/")), F.substring("container_path", F.lit(len(mount) + 2), F.length("container_path")))
    parts = F.filter(F.split(below, "/"), lambda x: ~x.isin("", "."))
    rows = paths.select("id", parts.alias("parts")).where((F.size("parts") > 0) & ~F.array_contains("parts", ".."))
    root = roots.select("root_id", "alias", parsed(F.col("root_path")).alias("p"))
    host = path_text(F.col("p.kind"), F.concat("p.parts", F.slice("parts", F.lit(2), F.size("parts"))))
    return rows.join(root, F.element_at("parts", 1) == F.col("alias")).select("id", "root_id", host.alias("path"))
