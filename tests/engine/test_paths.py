"""Paths of all kinds against literal cases."""

from __future__ import annotations

import pytest

from lodestar.functions import paths as P


@pytest.fixture
def roots(spark):
    return lambda *found: P.root_aliases(spark.createDataFrame(list(enumerate(found)), "root_id long, root_path string"))


def mapped(spark, roots, *found):
    rows = P.host_to_container(spark.createDataFrame(list(enumerate(found)), "id long, path string"), roots).collect()
    by = {r.id: r.container_path for r in rows}
    return [by.get(i) for i in range(len(found))]


def test_aliases(roots):
    of = lambda *found: [r.alias for r in roots(*found).orderBy("root_id").collect()]
    assert of("C:\\", "D:\\Data\\Projects", "\\\\fileserver\\projects", "/mnt/shares", "/", "/Größe & co/") == ["c", "d_data_projects", "unc_fileserver_projects", "mnt_shares", "root", "gr_e_co"]
    assert of("C:\\a_b", "C:\\a\\b", "/x", "/x_2", "\\x", "/X", "/x/", "relative") == ["c_a_b", "c_a_b_2", "x", "x_2", "x_3", "x_4"]


def test_kinds_and_roots(spark, roots):
    drive = roots("C:\\")
    assert mapped(spark, drive, "C:\\Users\\x\\Downloads", "c:/Users/x/Downloads", "C:\\", "'c:\\a\\.\\b\\'") == ["/roots/c/Users/x/Downloads", "/roots/c/Users/x/Downloads", "/roots/c", "/roots/c/a/b"]
    assert mapped(spark, roots("D:\\", "D:\\Data"), "D:\\Data\\x", "d:\\DATA", "D:\\Database") == ["/roots/d_data/x", "/roots/d_data", "/roots/d/Database"]
    assert mapped(spark, roots("\\\\srv\\share", "/data"), "\\\\SRV\\share\\Team\\A", "/data/proj", "/Data/proj", "/data/a\\b", ' "/data/with space" ') == ["/roots/unc_srv_share/Team/A", "/roots/data/proj", None, "/roots/data/a\\b", "/roots/data/with space"]
    assert mapped(spark, roots("C:\\Docs"), "C:\\Windows", "C:\\Docs\\..\\Windows", "D:\\Docs", "/etc", "Docs", "", None, "C:\\docs") == [None] * 7 + ["/roots/c_docs"]


def test_round_trip(spark, roots):
    found = roots("C:\\", "\\\\srv\\share", "/data", "/")
    hosts = ["C:\\Users\\x\\Downloads", "\\\\srv\\share\\a\\b", "/data/p/q", "C:\\", "\\\\srv\\share", "/data", "/other/place", "/"]
    there = P.host_to_container(spark.createDataFrame(list(enumerate(hosts)), "id long, path string"), found)
    back = {r.id: r.path for r in P.container_to_host(there.select("id", "container_path"), found).collect()}
    assert [back[i] for i in range(len(hosts))] == hosts
    odd = spark.createDataFrame([(1, "/elsewhere/c/x"), (2, "/roots/unknown/x"), (3, "/roots/c/../x"), (4, "/roots"), (5, None), (6, "/roots/c//a/")], "id long, container_path string")
    assert [(r.id, r.path) for r in P.container_to_host(odd, found).collect()] == [(6, "C:\\a")]
