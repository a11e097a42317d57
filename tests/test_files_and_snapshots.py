import io
import zipfile

from pyspark.sql import functions as F

from noticelake.operators import snapshots
from noticelake.sources import files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def packed(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(name, text)
    return out.getvalue()


def test_document_texts(spark, tmp_path):
    docx = packed("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    contents = {"a.docx": docx, "b.odt": packed("content.xml", "<o><p>x</p> <p>y</p></o>"), "c.docx": b"broken", "d.doc": b"old", "e.bin": b"?", "f.odt": packed("other.xml", "<o/>"), "g.odt": packed("content.xml", "<o/>")}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    found = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(found) == set(contents)
    assert found["a.docx"].text == "one two cell" and found["a.docx"].pages[0].page_number == 1
    assert found["b.odt"].text == "x y" and found["b.odt"].kind == "odt"
    for name, kind in (("c.docx", "docx"), ("d.doc", "doc_legacy"), ("e.bin", "unsupported"), ("f.odt", "odt"), ("g.odt", "odt")):
        assert (found[name].status, found[name].kind, found[name].pages, found[name].text) == ("error", kind, [], ""), name
        assert found[name].error


def test_document_kind(spark):
    rows = [("Application/PDF; q=1", None, "pdf"), (None, "http://a/b.ODT?x=.pdf", "odt"), ("text/html", "http://a/", "unsupported"), ("application/msword", "x.docx", "doc_legacy"), (None, None, "unsupported")]
    for r in spark.createDataFrame(rows, "t string, u string, want string").select("want", files.document_kind(F.col("t"), F.col("u")).alias("have")).collect():
        assert r.have == r.want


def test_listing_source(spark, tmp_path):
    spark.dataSource.register(files.ListingSource)
    row = '<table><tr><td>2026-07-0{}</td><td><a href="/n/{}">t {}</a></td></tr></table>'
    for k in range(3):
        (tmp_path / f"{k}.html").write_text(row.format(k, k, k))
    (tmp_path / "skip.txt").write_text(row.format(5, 5, 5))
    df = spark.read.format("listing").option("base", "http://h/").option("files_per_task", 2).load(str(tmp_path))
    assert sorted((r.published, r.title, r.url, r.status) for r in df.collect()) == [(f"2026-07-0{k}", f"t {k}", f"http://h/n/{k}", "success") for k in (1, 2)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("listing").load(str(tmp_path / "none")).count() == 0


def test_snapshots_turn_whole(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/state", "k int, v string"
    assert snapshots.load(spark, folder, schema).count() == 0
    snapshots.save(spark.createDataFrame([(1, "a")], schema), folder)
    first = snapshots.load(spark, folder, schema)
    snapshots.save(first.union(spark.createDataFrame([(2, "b")], schema)), folder)
    assert first.count() == 1  # a reader of the old state keeps it
    assert sorted(map(tuple, snapshots.load(spark, folder, f"{schema}, late int").collect())) == [(1, "a", None), (2, "b", None)]


def test_insert_set_and_cache(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, at string")
    rows = spark.createDataFrame([(2, "new", None), (3, "late", None), (3, "first", None)], "k int, v string, at string")
    out = snapshots.insert_or_ignore(table, rows, "k", ["v"])
    assert sorted(map(tuple, out.select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "first")]
    done = snapshots.set_once(table, spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k", {"at": F.lit("now")})
    assert done.columns == table.columns and sorted(map(tuple, done.collect())) == [(1, "a", "now"), (2, "b", "x")]
    cache = spark.createDataFrame([(1, "success"), (2, "error")], "k int, status string")
    hit, miss = snapshots.cached(table.select("k"), cache, "k", errors=False)
    assert [r.k for r in hit.collect()] == [1] and [r.k for r in miss.collect()] == [2]
    assert snapshots.cached(table.select("k"), cache, "k")[1].count() == 0


def test_migrate_flat_and_cells(spark, tmp_path):
    old = spark.createDataFrame([(1, None), (2, "d")], "k int, seen string")
    new = snapshots.migrate(old, "k long, seen string, checks string", {"seen": F.lit("fill")})
    assert sorted(map(tuple, new.collect())) == [(1, "fill", None), (2, "d", None)]
    nested = spark.createDataFrame([(1, ["a", "b"])], "k int, l array<string>")
    assert snapshots.flat(nested).first().l == '["a","b"]'
    snapshots.export(nested, f"{tmp_path}/out")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out/csv").first().l == '["a","b"]'
    cells = spark.createDataFrame([('["x"]',), ("broken",), (None,)], "c string").select(snapshots.json_list(F.col("c")).alias("l")).collect()
    assert [r.l for r in cells] == [["x"], [], []]
