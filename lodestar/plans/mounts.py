"""Queries over paths of all kinds: their roots, and where they lie in a container."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import paths as P
from lodestar.plans.base import Query

#: Roots for each brand and kind of path, in another case where that does not matter; a file's path has the kind of its id's remainder.
ROOTS = """b AS (SELECT DISTINCT split_part(rel_path, '/', 1) AS brand FROM files),
    n AS (SELECT brand, row_number() OVER (ORDER BY brand)::BIGINT AS k FROM b),
    roots AS (SELECT k * 3 AS root_id, 'c:/DATA/' || upper(brand) AS root_path, 'c' AS kind, 'c:/data/' || lower(brand) AS key, 'c_data_' || replace(lower(brand), '#', '_') AS alias FROM n WHERE k % 2 = 0
      UNION ALL SELECT k * 3 + 1, '\\\\srv\\SHARE\\' || brand, 's', '//srv/share/' || lower(brand), 'unc_srv_share_' || replace(lower(brand), '#', '_') FROM n WHERE k % 4 > 0
      UNION ALL SELECT k * 3 + 2, '/srv/' || brand, 'p', '/srv/' || brand, 'srv_' || replace(lower(brand), '#', '_') FROM n
      UNION ALL SELECT 0, 'C:\\', 'c', 'c:', 'c' UNION ALL SELECT 1, '/', 'p', '', 'root'),
    p AS (SELECT f.id, f.rel_path, CASE f.id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 's' ELSE 'p' END AS kind, CASE f.id % 3 WHEN 0 THEN 'C:/Data/' || f.rel_path WHEN 1 THEN '//Srv/share/' || f.rel_path ELSE '/srv/' || f.rel_path END AS whole FROM files f),
    k AS (SELECT *, CASE kind WHEN 'p' THEN whole ELSE lower(whole) END AS key FROM p),
    m AS (SELECT k.id, arg_max(r.root_id, length(r.key)) AS root_id, arg_max(r.alias, length(r.key)) AS alias, substring(any_value(k.whole), max(length(r.key)) + 2) AS rel_path FROM k JOIN roots r ON r.kind = k.kind AND starts_with(k.key, r.key || '/') GROUP BY k.id)"""


def files_and_roots(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    back = F.replace("rel_path", F.lit("/"), F.lit("\\"))
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("C:\\Data\\"), back)).when(F.col("id") % 3 == 1, F.concat(F.lit('"\\\\Srv\\share\\'), back, F.lit('"'))).otherwise(F.concat(F.lit("/srv/"), "rel_path", F.lit("/")))
    brands = files.select(F.substring_index("rel_path", "/", 1).alias("brand")).distinct().agg(F.sort_array(F.collect_set("brand")).alias("all"))
    numbered = brands.select(F.posexplode("all").alias("at", "brand")).select("brand", (F.col("at") + 1).cast("long").alias("k"))
    of = lambda n, text: numbered.select((F.col("k") * 3 + n).alias("root_id"), text.alias("root_path"), "k")
    made = of(0, F.concat(F.lit("c:/DATA/"), F.upper("brand"))).where("k % 2 = 0").unionByName(of(1, F.concat(F.lit("\\\\srv\\SHARE\\"), "brand")).where("k % 4 > 0")).unionByName(of(2, F.concat(F.lit("/srv/"), "brand")))
    top = files.sparkSession.createDataFrame([(0, "C:\\"), (1, "/")], "root_id long, root_path string")
    return files.select("id", path.alias("path")), P.root_aliases(made.drop("k").unionByName(top))


QUERIES: dict[str, Query] = {
    "mount_roots": Query(("files",), lambda f: P.path_roots(*files_and_roots(f)).select("id", "root_id", "rel_path"), f"WITH {ROOTS} SELECT id, root_id, rel_path FROM m"),
    "root_aliases": Query(("files",), lambda f: files_and_roots(f)[1], f"WITH {ROOTS} SELECT root_id, root_path, alias FROM roots"),
    "host_to_container": Query(("files",), lambda f: P.host_to_container(*files_and_roots(f)), f"WITH {ROOTS} SELECT id, root_id, '/roots/' || alias || '/' || rel_path AS container_path FROM m"),
    "container_to_host": Query(
        ("files",),
        lambda f: (lambda paths, roots: P.container_to_host(P.host_to_container(paths, roots).select("id", "container_path"), roots))(*files_and_roots(f)),
        f"WITH {ROOTS} SELECT m.id, m.root_id, CASE r.kind WHEN 'p' THEN '/' || ltrim(r.root_path, '/') || CASE WHEN r.root_path = '/' THEN '' ELSE '/' END || m.rel_path WHEN 'c' THEN rtrim(replace(upper(left(r.root_path, 1)) || substring(r.root_path, 2), '/', '\\'), '\\') || '\\' || replace(m.rel_path, '/', '\\') ELSE r.root_path || '\\' || replace(m.rel_path, '/', '\\') END AS path FROM m JOIN roots r ON r.root_id = m.root_id",
    ),
}
