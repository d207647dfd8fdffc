from __future__ import annotations

import json
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioworks.operators import load, manifests, resolve
from folioworks.sources import files, readers

RDF = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="https://www.ica.org/standards/RiC/ontology#">'


def shapefile(folder, stem, extents, names):
    """Writes the three files; an extent is four numbers, None (a null shape) or a kind of shape."""
    shp, shx = bytearray(100), bytearray(100)
    for i, e in enumerate(extents):
        body = struct.pack("<i", 0 if e is None else e) if e is None or isinstance(e, int) else struct.pack("<i4d", 5, *e) + b"p" * (i % 5 * 2)
        shx += struct.pack(">2i", len(shp) // 2, len(body) // 2)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
    dbf = struct.pack("<B3xIHH20x", 3, len(names), 97, 31) + b"autre".ljust(11, b"\0") + b"C" + bytes(4) + bytes([10]) + bytes(15) + b"fichier".ljust(11, b"\0") + b"C" + bytes(4) + bytes([20]) + bytes(15) + b"\r"
    dbf += b"".join(b" " + b"x".ljust(10) + n.encode("latin-1").ljust(20) for n in names)
    for kind, data in (("shp", shp), ("shx", shx), ("dbf", dbf)):
        (folder / f"{stem}.{kind}").write_bytes(bytes(data))


def listing(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


@pytest.fixture
def known(spark):
    files.register(spark)
    return spark


def test_shapefiles_by_record_ranges(known, tmp_path):
    """A table larger than a partition and a batch gives what the reader of whole files gives; other kinds of shapes and uneven counts are errors."""
    n = files.BATCH * 2 + 77
    extents = [None if i % 10 == 3 else (float(i), 0.5, i + 1.0, 2.5) for i in range(n)]
    shapefile(tmp_path, "one", extents, [f"d/é{i}_A.tif" if i % 7 else "?" for i in range(n)])
    shapefile(tmp_path, "two", [(1.0, 2.0, 3.0, 4.0)], ["x/B_2.tif"])
    got = known.read.format("shapefile_extents").option("rowsPerPartition", 3000).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == -(-n // 3000) + 1
    assert rows(got.drop("stem")) == rows(readers.shapefile_bboxes(readers.read_shapefiles(known, str(tmp_path))))
    assert rows(got.where("stem = 'two'")) == [("B_2", 1.0, 2.0, 3.0, 4.0, "two")] and got.where("stem in ('two', 'x')").rdd.getNumPartitions() == 1
    (tmp_path / "bad").mkdir()
    shapefile(tmp_path / "bad", "points", [1], ["a.tif"])
    with pytest.raises(Exception, match="kind 1 among polygons"):
        known.read.format("shapefile_extents").load(str(tmp_path / "bad")).collect()
    (tmp_path / "odd").mkdir()
    shapefile(tmp_path / "odd", "uneven", [None], ["a.tif", "b.tif"])
    with pytest.raises(Exception, match="2 records but 1 shapes"):
        known.read.format("shapefile_extents").load(str(tmp_path / "odd")).collect()
    (tmp_path / "none").mkdir()
    assert known.read.format("shapefile_extents").load(str(tmp_path / "none")).isEmpty()


def test_rdf_as_a_stream(known, tmp_path):
    node = lambda i: f'<c:Record r:about="https://x/facomponent/n{i}/"><c:title>T {i} &amp; é</c:title><c:beginningDate>18{i % 100:02d}-01</c:beginningDate><c:includesOrIncluded r:resource="https://x/n{i + 1}"/></c:Record>'
    for k in range(3):
        (tmp_path / f"aid{k}.rdf").write_text(RDF + "\n".join(node(i) for i in range(k * 5000, k * 5000 + 5000)) + "<c:Record/></r:RDF>", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("not one of them")
    got = known.read.format("rdf_nodes").option("bytesPerPartition", 1000).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    whole = readers.rdf_nodes(known.read.text(str(tmp_path) + "/*.rdf", wholetext=True))
    assert rows(got.drop("path")) == rows(whole) and got.count() == 15_000
    one = got.where(F.col("path") == str(tmp_path / "aid1.rdf"))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 5000
    (tmp_path / "aid0.rdf").write_text(RDF + node(1))
    with pytest.raises(Exception, match="ParseError"):
        got.collect()


def test_jpeg_heads(known, tmp_path):
    good = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc2\x00\x0b\x08\x02\x58\x03\x20" + b"\0" * 100_000
    (tmp_path / "a.jpg").write_bytes(good)
    (tmp_path / "b.JPEG").write_bytes(b"no")
    (tmp_path / "c.png").write_bytes(good)
    got = {p.rsplit("/", 1)[-1]: (w, h) for p, w, h in rows(known.read.format("jpeg_sizes").load(str(tmp_path)))}
    assert got == {"a.jpg": (800, 600), "b.JPEG": (8000, 6000)}


def test_a_file_for_each_row(known, tmp_path):
    out = tmp_path / "out"
    f = known.createDataFrame([(f"m{i}.json", f"é{i}") for i in range(50)], "name string, content string").repartition(4)
    load.write_files(f, "name", "content", str(out))
    assert listing(out) == sorted(["_counts.json", *(f"m{i}.json" for i in range(50))]) and (out / "m7.json").read_text(encoding="utf-8") == "é7"
    assert json.loads((out / "_counts.json").read_text()) == {"bytes": sum(len(f"é{i}".encode()) for i in range(50)), "files": 50}
    f.limit(1).write.format("file_per_row").mode("overwrite").save(str(out))
    assert len(listing(out)) == 2
    load.write_files(f.limit(0), "name", "content", str(tmp_path / "empty"))
    assert listing(tmp_path / "empty") == ["_counts.json"]


@pytest.mark.parametrize("bad", [("m1.json", "again"), ("../up", "x"), ("", "x"), (None, "x"), ("_hidden", "x"), ("n", None)])
def test_a_failing_task_leaves_nothing(known, tmp_path, bad):
    f = known.createDataFrame([(f"m{i}.json", "x") for i in range(20)] + [bad], "name string, content string").repartition(5)
    with pytest.raises(Exception, match="no file can be written|two rows have one file name"):
        load.write_files(f, "name", "content", str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or [f for f in listing(tmp_path / "out") if not f.startswith("_staging-")] == []


def test_static_manifests_are_files(known, tmp_path):
    """The shape of the catalogue's own static manifests: keys in their order, one canvas, one image, level 2."""
    f = known.createDataFrame([(f"79{i}", f"Section {i}", "3 P 4/2", "1827", f"/a/p_{i}.jpg") for i in range(12)], "id string, t string, c string, d string, s string")
    text = manifests.static_manifest("t", "c", "d", "id", "s", "https://p", "https://a", "https://w", "/mnt", "x")
    load.write_files(f, F.concat("id", F.lit(".json")), text, str(tmp_path / "out"))
    m = json.loads((tmp_path / "out" / "793.json").read_text(encoding="utf-8"))
    assert list(m) == ["@context", "@id", "@type", "label", "metadata", "attribution", "sequences"] and m["@id"] == "https://p/793.json" and m["label"] == "Section 3 — 3 P 4/2 (1827)"
    (canvas,) = m["sequences"][0]["canvases"]
    assert list(canvas) == ["@id", "@type", "label", "width", "height", "images"] and canvas["images"][0]["resource"]["service"]["profile"].endswith("level2.json")
    assert len(listing(tmp_path / "out")) == 13


DOC = "insee string, type string, section_lettre string, feuille_num int, annee int, cote string, archive_url string, iiif_manifest string, image_url string, licence_overlay_ok boolean"


def documents(spark, n=10):
    return spark.createDataFrame([(None if i % 5 == 0 else f"01{i:03d}", "feuille", None, i, 1800 + i, "l'été", f"http://u{i}", None, "", i % 2 == 0) for i in range(n)], DOC)


def test_seed_files_count_in_one_pass(known, tmp_path):
    out = tmp_path / "seed"
    seen = known.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    load.write_seed_sql(documents(known).mapInArrow(look, DOC), str(out))
    assert seen.value == 10 and (out / "header.txt").read_text() == "-- rows: 8; without a code: 2\n"
    text = known.read.text(str(out))
    assert text.where("value like 'insert%'").count() == 8
    back = readers.seed_rows(known.read.text(str(out), wholetext=True), ["insee", "cote", "annee"], {"annee": "int"})
    assert rows(back) == rows(documents(known).where("insee is not null").select("insee", "cote", "annee"))


def test_jdbc(spark):
    """Against the Derby that Spark ships, in memory: rows, nulls, batches, appending."""
    url = "jdbc:derby:memory:catalogue;create=true"
    properties = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    docs = documents(spark, 1203)
    load.write_jdbc(docs.where("feuille_num < 700"), url, "document", properties, 100)
    load.write_jdbc(docs.where("feuille_num >= 700"), url, "document", properties)
    back = spark.read.jdbc(url, "document", properties=properties).toDF(*docs.columns)
    assert rows(back) == rows(docs)


def test_guard_refuses_the_write_from_the_same_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = documents(spark, 100).mapInArrow(look, DOC)
    assert resolve.write_guarded(docs, str(tmp_path / "ok"), ["01"]) == (80, 0) and seen.value == 100
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 100
    for bad, why in ((docs, "80 of 80 rows lie outside"), (docs.where("insee is null"), "no row is resolved")):
        with pytest.raises(resolve.WrongDepartment, match=why):
            resolve.write_guarded(bad, str(tmp_path / "bad"), ["02"])
    with pytest.raises(FileExistsError):
        resolve.write_guarded(docs, str(tmp_path / "ok"), ["01"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ok"]


def test_unreadable_manifests_are_counted(spark):
    from pyspark.sql import Observation

    lines = [json.dumps({"a": {"label": "x"}, "b": None, "c": 5}), json.dumps({"d": None}), "[1]", "no json", None, "{}"]
    figures = Observation()
    got = manifests.read_manifests(spark.createDataFrame([(x,) for x in lines], "value string"), figures)
    assert rows(got) == [("a", '{"label":"x"}'), ("c", "5")] and figures.get == {"read": 2, "unreadable": 2, "lost": 4}


class Record:
    """A stream of one RDF description with many links, made as it is read."""

    def __init__(self, n):
        self.texts = self.made(n)

    @staticmethod
    def made(n):
        yield RDF + '<c:Record r:about="https://x/facomponent/top"><c:title>T</c:title>'
        for i in range(0, n, 1000):
            yield "".join(f'<c:includesOrIncluded r:resource="https://x/n{j}"/>' for j in range(i, i + 1000))
        yield '</c:Record><c:Record r:about="https://x/n0"/></r:RDF>'

    def read(self, _=-1):
        return next(self.texts, "").encode()


@pytest.mark.parametrize("links", [True, False])
def test_a_node_of_any_number_of_children_is_not_held(links):
    """100,000 children, as links or left out, take no more memory than a few thousand."""
    import tracemalloc

    n = 100_000
    tracemalloc.start()
    found = 0
    for row in readers.rdf_links(Record(n)) if links else readers.rdf_rows(Record(n), links=False):
        assert not links or row == ("top", f"n{found}", found)
        assert links or row[1:] == (("T", "")[found], None, None, None, None, None, None, None)
        found += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == (n if links else 2) and peak < 3_000_000


def test_files_in_parts(known, tmp_path):
    """A file's rows are appended in their order, packed or not, and read again as nodes and as links."""
    part = lambda i, k: f'<c:Record r:about="https://x/n{i}">' * (k == 0) + f'<c:includesOrIncluded r:resource="https://x/c{i}_{k}"/>' + "</c:Record>" * (k == 2)
    f = known.createDataFrame([(f"aid{i}.rdf{('', '.zst', '.gz')[i % 3]}", k, part(i, k)) for k in range(3) for i in range(9)], "name string, k int, content string")
    load.write_files_in_parts(f.repartition(3, "name").sortWithinPartitions("name", "k"), str(tmp_path / "out"), RDF, "</r:RDF>")
    assert len(listing(tmp_path / "out")) == 10 and (tmp_path / "out" / "aid0.rdf").read_text() == RDF + part(0, 0) + part(0, 1) + part(0, 2) + "</r:RDF>"
    edges = rows(known.read.format("rdf_edges").load(str(tmp_path / "out")).drop("path"))
    assert edges == sorted(((f"n{i}", f"c{i}_{k}", k) for k in range(3) for i in range(9)), key=str)
    nodes = known.read.format("rdf_nodes").load(str(tmp_path / "out"))
    assert rows(readers.rdf_edges(nodes)) == edges and rows(nodes.select("id", "children"))[4] == ("n4", ["c4_0", "c4_1", "c4_2"])
    with pytest.raises(Exception, match="two rows have one file name"):
        load.write_files_in_parts(f.repartition(3, "name").sortWithinPartitions("k", "name"), str(tmp_path / "bad"))
