"""Readers and writers on small files."""

from quadrille.sources import files

XML = """<?xml version='1.0'?><TiePointSet xmlns:gml="http://www.opengis.net/gml"><MasterPath>m.tif</MasterPath>
<SimpleTiePoint><ground><gml:Point><gml:coord><X>1.5</X><Y>2</Y><Z>3</Z></gml:coord></gml:Point></ground><image><gml:Point><gml:coord><X>7</X><Y>8</Y></gml:coord></gml:Point></image><score>9</score></SimpleTiePoint>
<SimpleTiePoint><ground><gml:Point><gml:coord><X>4</X><Y>5</Y><Z>6</Z></gml:coord></gml:Point></ground><image><gml:Point><gml:coord><X>1</X><Y>2</Y></gml:coord></gml:Point></image><score>3</score></SimpleTiePoint></TiePointSet>"""


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_gcp_text_round_trip(spark, tmp_path):
    p = put(tmp_path / "g", "a.txt", "1  0.0 27.5   5.0 6.0 7.0  \n\nbad line\n2 1 2 3 4 x\n")
    rows = files.read_gcp_text(spark, p)
    got = rows.orderBy("point_id").collect()
    assert [r.corrupt for r in got if r.corrupt] == ["bad line", "2 1 2 3 4 x"] or sorted(r.corrupt for r in got if r.corrupt) == ["2 1 2 3 4 x", "bad line"]
    good = rows.filter("corrupt is null").drop("corrupt")
    assert [tuple(r) for r in good.collect()] == [("a.txt", "1", 0.0, 27.5, 5.0, 6.0, 7.0)]
    files.write_gcp(good, str(tmp_path / "out"))
    files.write_gcp(good, str(tmp_path / "out"), append=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_tiepoint_xml(spark, tmp_path):
    got = files.read_tiepoint_xml(spark, put(tmp_path / "x", "t.xml", XML)).orderBy("gx").collect()
    assert [tuple(r) for r in got] == [(1.5, 2.0, 3.0, 7.0, 8.0, 9.0), (4.0, 5.0, 6.0, 1.0, 2.0, 3.0)]
    assert [tuple(r) for r in files.read_tiepoint_header(spark, str(tmp_path / "x")).collect()] == [("t.xml", "m.tif", None)]


def test_line_features_round_trip(spark, tmp_path):
    p = put(tmp_path / "l", "s.txt", "A-1\tStraightLine\t2\n   12.5  -3.75\n   14  9\nA-2\tPolygon\t3\n 1 2\n 3 4\n -5e1 6\n")
    one = files.read_line_features(spark, p)
    rows = sorted((r.id, r.type, [tuple(x) for x in r.points]) for r in one.collect())
    assert rows == [("A-1", "StraightLine", [(12.5, -3.75), (14.0, 9.0)]), ("A-2", "Polygon", [(1.0, 2.0), (3.0, 4.0), (-50.0, 6.0)])]
    files.write_line_features(one, str(tmp_path / "again"))
    again = files.read_line_features(spark, str(tmp_path / "again"))
    assert sorted((r.id, r.type, [tuple(x) for x in r.points]) for r in again.collect()) == rows


def test_descriptors(spark, tmp_path):
    a = files.read_descriptor_files(spark, put(tmp_path / "a", "i.txt", "3 2\n1 2 .1 .2 .3 7 8 9\n3 4 .1 .2 .3 10 11 12\n"))
    assert [(r.kp_id, r.x, r.y, r.descr) for r in a.orderBy("kp_id").collect()] == [(0, 1, 2, [7, 8, 9]), (1, 3, 4, [10, 11, 12])]
    s = files.read_descriptor_files(spark, put(tmp_path / "s", "i.txt", "1 2\n5 6 .5 .25\n 7 8\n"), "scale")
    assert [(r.x, r.y, r["shape"], r.descr) for r in s.collect()] == [(6, 5, [0.5, 0.25], [7, 8])]
    for k, text in enumerate(("200 1\n" + "1 " * 205, "3 2\n1 2 3", "x y")):  # a rejected file is one row that says so
        bad = files.read_descriptor_files(spark, put(tmp_path / f"b{k}", "i.txt", text)).collect()
        assert [(r.image_id, r.kp_id, r.descr, r.corrupt) for r in bad] == [("i.txt", None, None, " ".join(text.split()[:2]))]


def test_keywords_and_listing(spark, tmp_path):
    p = put(tmp_path / "k", "p.txt", "datum:  WGE\norigin:  ( 1.0, 2.0 )\nurl: a:b\nnothing\n")
    put(tmp_path / "k", "q.dat", "x")
    assert files.read_keyword_list(spark, f"{p}/p.txt").first()["keys"] == {"datum": "WGE", "origin": "( 1.0, 2.0 )", "url": "a:b"}
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), "*.dat").collect()] == ["q.dat"]


def test_lists_of_a_file_are_told_apart_by_prefix(spark, tmp_path):
    p = put(tmp_path / "m", "m.txt", " a.id: 1\n a.url: x:y.z\nb.id :2\nid: 3\n b.band.n: 4\n")
    got = {r.prefix: r["keys"] for r in files.read_keyword_list(spark, p, prefixed=True).collect()}
    assert got == {"a": {"id": "1", "url": "x:y.z"}, "b": {"id": "2", "band.n": "4"}, None: {"id": "3"}}


def test_tiepoint_files_follow_points_not_sets(spark, tmp_path):
    rows = [(float(i), 2.0, i // 3 * 1.0, 4.0, 5.0, 6.0) for i in range(50)] + [(1.0, None, 3.0, None, None, None)]
    points = spark.createDataFrame(rows, "gx double, gy double, gz double, x double, y double, score double").coalesce(1)
    files.write_tiepoint_xml(points, str(tmp_path / "t"), per_file=20)
    names = list((tmp_path / "t").glob("part-*"))
    assert len(names) == 3 and all(n.read_text().strip().endswith("</TiePointSet>") for n in names)
    key = lambda r: tuple((v is None, v or 0.0) for v in r)
    assert sorted(map(tuple, files.read_tiepoint_xml(spark, str(tmp_path / "t")).collect()), key=key) == sorted(rows, key=key)


def test_sources_of_many_sets_write_few_files(spark, tmp_path):
    """A file or a folder for each set made time grow with the sets."""
    from quadrille.plans import source_queries

    sets = 300
    spark.range(sets).selectExpr("id s_suppkey", "concat('n.', id) s_name", "id % 25 s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(4 * sets).selectExpr("id div 4 l_suppkey", "id l_orderkey", "1 l_linenumber", "id l_partkey", "double(id % 50) l_quantity", "double(id) l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    for query, rows in ((source_queries.read_keyword_list, sets), (source_queries.write_gcp, 4 * sets), (source_queries.read_tiepoint_xml, 4 * sets)):
        got = query(spark, str(tmp_path))
        assert got.count() == rows and len(got.inputFiles()) <= 16
