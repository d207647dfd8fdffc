from __future__ import annotations

import json
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioworks.operators import manifests, stats
from folioworks.sources import readers
from folioworks.streaming import inserts, keyed


def lines(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, pos long")


def test_text_readers(spark):
    got = rows(readers.notices_tsv(lines(spark, "1\tark:a\tT", "", "2\tx", "1\tark:b\tU\tmore", "\tark\tz")))
    assert got == [("1", "ark:b", "U\tmore")]
    assert rows(readers.commune_tree(lines(spark, "1~Nom~id~a~b", "x")), "nom", "leaves") == [("Nom", "a~b")]
    f = spark.createDataFrame([("a", "x ark:/1/ab ark:/1/cd", 0), ("a", "ark:/1/ab longname9", 1), ("b", "longname9\tz", 0), ("b", "short", 1)], "file string, value string, pos long")
    assert rows(readers.extract_arks(f, "1"), "file", "ark") == [("a", "ab"), ("a", "cd"), ("b", "longname9")]


def test_csv_71_is_latin1_with_untidy_header(spark, tmp_path):
    text = " INSEE;Cartes ;Date;Cotes;N° section;Lien vers image Open Data;Lien ark vers Image AD71\n7;PARCELLAIRE;1825 env.;3 P;b2;http://i;\nx;PARCELLAIRE;;;;http://i;\n1234;MASSE DE CULTURE;;;;http://j;http://ark\n8;AUTRE;;;;http://k;\n"
    (tmp_path / "a.csv").write_bytes(text.encode("latin-1"))
    got = rows(readers.read_opendata_71(spark, str(tmp_path)))
    assert got == [("71007", "feuille", "B", 1825, "3 P", "http://i", "http://i"), ("711234", "feuille", None, None, "", "http://ark", "http://j")]


def shapefile(extents, names):
    shp = b"\0" * 100
    for i, e in enumerate(extents):
        body = struct.pack("<i", 0) if e is None else struct.pack("<i4d", 5, *e)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
    dbf = struct.pack("<B3xIHH20x", 3, len(names), 65, 21) + b"fichier".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20]) + b"\0" * 15 + b"\r"
    return shp, dbf + b"".join(b" " + n.encode("latin-1").ljust(20) for n in names)


def test_shapefiles_go_by_position(spark, tmp_path):
    for stem, e, n in (("one", [(1, 2, 3, 4), None], ["d/AB_1.tif", "d/CD_2.tif"]),):
        shp, dbf = shapefile(e, n)
        (tmp_path / f"{stem}.shp").write_bytes(shp)
        (tmp_path / f"{stem}.dbf").write_bytes(dbf)
    assert rows(readers.shapefile_bboxes(readers.read_shapefiles(spark, str(tmp_path)))) == [("AB_1", 1.0, 2.0, 3.0, 4.0)]
    shp, dbf = shapefile([(1, 2, 3, 4)], ["a.tif", "b.tif"])
    bad = spark.createDataFrame([("x", bytearray(dbf), bytearray(shp))], "stem string, dbf binary, shp binary")
    with pytest.raises(Exception, match="2 records but 1 shapes"):
        readers.shapefile_bboxes(bad).collect()


def test_seed_rows_keep_codes_as_text(spark):
    text = "-- x\ninsert into document (insee, annee, cote) values ('01195', 1825, 'l''a; (b)');\ninsert into document (insee, annee, cote) values (null, null, '');"
    assert rows(readers.seed_rows(lines(spark, text), ["insee", "annee", "cote"])) == [("01195", "1825", "l'a; (b)"), (None, None, "")]
    with pytest.raises(Exception, match="1 values for 2 columns"):
        readers.seed_rows(lines(spark, "insert into document (a, b) values ('x');"), ["a"]).collect()


def test_html(spark):
    html = '<div id="item_7"><p class="titres"> <span>Plan</span><p id="detailn_7"><p class="cotes"><b/><span>3 P</span><p class="dates"><span>1827</span></p><a href="lienImage(12)"><img data-src="/a.jpg"></div><div id="item_8"></div>'
    p = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert rows(readers.parse_item_blocks(p, details=True)) == [(1, "7", "Plan", "3 P", "1827", "12", "/a.jpg")]
    toc = spark.createDataFrame([(1, "<a onclick='showEntry(3)' x>Plans du cadastre</a><a onclick='showEntry(4)'> </a><a onclick='showEntry(5)'>ÉTATS et plans</a>")], "page_id int, html string")
    assert rows(readers.select_plan_groups(readers.parse_toc(toc)), "node_id") == [("3",)]


def test_rdf(spark):
    text = """<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="https://www.ica.org/standards/RiC/ontology#" xmlns:d="http://purl.org/dc/terms/">
      <c:Record r:about="https://x/facomponent/n1/"><c:title>Sevran</c:title><c:beginningDate>1825-01</c:beginningDate><c:endDate>s.d.</c:endDate><c:includesOrIncluded r:resource="https://x/facomponent/n2"/>
      <c:hasInstantiation r:resource="https://x//iiif/a/manifest#p"/><d:source>a/daoloc/1.jpg</d:source><d:source>b/daogrp/2.jpg</d:source><d:source>c/daoloc/vignette.jpg</d:source><c:heldBy r:resource="https://x/service/9"/></c:Record></r:RDF>"""
    n = readers.rdf_nodes(lines(spark, text))
    assert rows(n, "id", "title", "begin_year", "end_year", "manifest", "image", "service_uri") == [("n1", "Sevran", 1825, None, "https://x/iiif/a/manifest", "b/daogrp/2.jpg", "https://x/service/9")]
    assert rows(readers.rdf_edges(n)) == [("n1", "n2", 0)]


def test_alias_and_config(spark):
    a = lines(spark, json.dumps({"16": {"Vieux": "16001", "_note": "x"}, "_doc": "text"}))
    assert rows(readers.read_alias(a)) == [("16", "Vieux", "16001")]
    c = spark.createDataFrame([("a", "p", "1"), ("b", "p", "")], "code string, portail string, naan string")
    assert readers.portal_config(c, ["a"]).count() == 1
    with pytest.raises(ValueError, match="b, c"):
        readers.portal_config(c, ["a", "b", "c"])


def test_jpeg_header(spark):
    good = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc2\x00\x0b\x08\x02\x58\x03\x20" + b"\0" * 20
    f = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None)], "id int, content binary")
    got = {r["id"]: tuple(r["d"]) for r in f.select("id", readers.image_dimensions("content").alias("d")).collect()}
    assert got == {1: (800, 600), 2: (8000, 6000), 3: (8000, 6000)}


def test_manifests(spark):
    m = {"metadata": [{"label": "Lieu", "value": "A"}, {"label": "Date", "value": "1827"}, {"label": "Lieu", "value": "B"}],
         "sequences": [{"canvases": [{"width": 10, "height": 20, "images": [{"resource": {"@id": "r", "service": [{"@id": "http://h/iiif/1", "profile": "http://iiif.io/api/image/2/level1.json"}]}}]}]}], "service": {"@id": "http://auth", "profile": "auth"}}
    v3 = {"items": [{"items": [{"items": [{"body": {"service": [{"id": "http://v3/info.json"}]}}]}]}]}
    f = spark.createDataFrame([(1, json.dumps(m)), (2, json.dumps(v3)), (3, json.dumps({"thumbnail": "t.jpg"})), (4, json.dumps({"thumbnail": {"@id": "u.jpg"}})), (5, "bad{"), (6, None)], "id int, j string")
    v = manifests.parse("j")
    got = {r["id"]: r for r in f.select("id", manifests.meta(v, ["Lieu", "Date"]).alias("first"), manifests.meta(v, ["Lieu"], True).alias("last"), manifests.image_service(v).alias("s"), manifests.thumbnail(v).alias("t"), manifests.dimensions(v).alias("d"),
                                        manifests.first_service_deep("j", "/iiif/").alias("deep"), manifests.rewrite_image_services("j", "P").alias("new")).collect()}
    assert (got[1]["first"], got[1]["last"], got[1]["s"], tuple(got[1]["d"]), got[1]["deep"]) == ("A", "B", "http://h/iiif/1", (10, 20), "http://h/iiif/1")
    assert [got[i]["t"] for i in range(1, 7)] == ["http://h/iiif/1/full/200,/0/default.jpg", "http://v3/full/200,/0/default.jpg", "t.jpg", "u.jpg", None, None]
    new = json.loads(got[1]["new"])
    assert new["sequences"][0]["canvases"][0]["images"][0]["resource"]["service"][0]["@id"] == "P/iiif/http%3A%2F%2Fh%2Fiiif%2F1" and new["service"]["@id"] == "http://auth"


def test_static_manifest_golden(spark):
    """The values of one published manifest: its label, picture and service."""
    f = spark.createDataFrame([("Section A", "3 P PLAN 4/2", "1827", "791649769", "/num_ext/frad021_3p/frad021_3p_plan_004/frad021_3p_plan_004_002.jpg")], "t string, c string, d string, i string, s string")
    m = json.loads(f.select(manifests.static_manifest("t", "c", "d", "i", "s", "https://p", "https://a", "https://w", "/mnt/lustre/ad21", "x")).first()[0])
    resource = m["sequences"][0]["canvases"][0]["images"][0]["resource"]
    assert m["label"] == "Section A — 3 P PLAN 4/2 (1827)" and m["@id"] == "https://p/791649769.json" and m["metadata"][1] == {"label": "Date", "value": "1827"}
    assert resource["@id"] == "https://a/cache/mnt_lustre_ad21_num_ext_frad021_3p_frad021_3p_plan_004_frad021_3p_plan_004_002_4000_4000_0_0_0_0_img.jpg"
    assert resource["service"]["@id"] == "https://w/static-iiif/%2Fmnt%2Flustre%2Fad21%2Fnum_ext%2Ffrad021_3p%2Ffrad021_3p_plan_004%2Ffrad021_3p_plan_004_002.jpg"


def test_streams(spark, tmp_path):
    f = spark.createDataFrame([(i, i // 3, f"2024-01-01 00:00:{i // 4 * 10 + i % 4:02d}") for i in range(12)], "event_id long, k long, t string")
    f = f.select("event_id", F.concat(F.lit("u"), "k").alias("archive_url"), F.to_timestamp("t").alias("ts"), F.lit("01").alias("dept"),
                 F.concat(F.lit("0100"), (F.col("event_id") % 2).cast("string")).alias("insee"), F.lit("section").alias("type"), F.when(F.col("event_id") > 2, "m").alias("iiif_manifest"), (F.col("event_id") > 4).alias("licence_overlay_ok"))
    source = str(tmp_path / "in")
    f.where("event_id < 7").coalesce(1).write.parquet(source)
    kinds = "event_id long, archive_url string, ts timestamp, dept string, insee string, type string, iiif_manifest string, licence_overlay_ok boolean"
    args = (str(tmp_path / "out"), str(tmp_path / "ck"))
    keyed.run(keyed.unique_rows(inserts.read_inserts(spark, source, kinds)), *args)
    f.where("event_id >= 7").coalesce(1).write.mode("append").parquet(source)
    keyed.run(keyed.unique_rows(inserts.read_inserts(spark, source, kinds)), *args)
    assert rows(spark.read.parquet(args[0]), "archive_url", "event_id") == [("u0", 0), ("u1", 3), ("u2", 6), ("u3", 9)]
    assert sorted(r["n"] for r in inserts.bursts(f, "5 seconds").collect()) == [4, 4, 4]
    inserts.running_stats(inserts.read_inserts(spark, source, kinds), str(tmp_path / "s"), str(tmp_path / "sc"))
    got = inserts.read_stats(spark, str(tmp_path / "s")).drop("last")
    assert got.columns[1:] == stats.stats_by_dept(f).columns[1:] and rows(got) == rows(stats.stats_by_dept(f)) == [("01", 12, 7, 9, 0, 12, 0, 2)]
    assert rows(inserts.burst_refreshes(f, "5 seconds"), "n", "depts") == [(4, ["01"])] * 3
    q = inserts.dedupe_within(inserts.read_inserts(spark, source, kinds)).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mc")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 4


def test_no_manifest_ends_a_job(spark):
    """Ids that aren't text, deep nesting, half surrogates, text that isn't JSON."""
    service = {"@context": "http://iiif.io/api/image/2/context.json", "@id": "https://x/iiif/SERIE_1", "profile": "level2"}
    odd = [{"service": dict(service, **{"@id": v})} for v in (5, None, True, [], {}, ["a"], {"@id": "https://x/iiif/SERIE_9"}, "")]
    texts = [json.dumps(x) for x in odd] + [json.dumps({"service": {"@id": 5, "id": "https://x/iiif/SERIE_2", "type": "ImageService3"}}), "[" * 200_000 + "]" * 200_000, '{"a":' * 5000 + "1" + "}" * 5000, "{", "", None, "5", '"x"', "null", "[1, null]", json.dumps({"service": 7}), json.dumps({"service": [7, None, "https://x/iiif/SERIE_3"]})]
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = f.select("i", manifests.first_service_deep("t", "/iiif/SERIE_").alias("found"), manifests.rewrite_image_services("t", "https://p").alias("new")).collect()
    found = {r["i"]: r["found"] for r in got if r["found"]}
    assert found == {len(odd): "https://x/iiif/SERIE_2", len(texts) - 1: "https://x/iiif/SERIE_3"}
    new = {r["i"]: json.loads(r["new"]) for r in got if r["new"]}
    assert all(new[i] == x for i, x in enumerate(odd)) and new[len(odd)]["service"]["@id"] == "https://p/iiif/https%3A%2F%2Fx%2Fiiif%2FSERIE_2"


def test_only_services_are_asked_for_their_declaration(monkeypatch):
    """A manifest of 500 canvases has 500 declarations to look at, not one for each object in it."""
    monkeypatch.setattr(manifests, "_per_text", lambda f: lambda _: f)
    rewrite = manifests.rewrite_image_services(None, "https://p")
    service = {"@id": "https://s/1", "profile": "http://iiif.io/api/image/2/level2.json"}
    canvases = [{"id": f"c{i}", "images": [{"resource": {"id": "i", "service": dict(service) if i % 2 else [dict(service)]}}]} for i in range(500)]
    written, write = [], json.dumps
    monkeypatch.setattr(manifests.json, "dumps", lambda *a, **k: written.append(0) or write(*a, **k))
    new = rewrite(text := write({"items": canvases, "profile": "http://iiif.io/api/image/2"}))
    assert len(written) == 501 and new == text.replace("https://s/1", "https://p/iiif/https%3A%2F%2Fs%2F1")
