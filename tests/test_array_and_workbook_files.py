"""Array files against NumPy, with what is read counted; workbooks written by this library and by hand."""

import datetime
import io
import json
import os
import zipfile

import numpy as np
import pytest

from tarn.sources import arrays, workbooks


@pytest.fixture
def table(spark, tmp_path):
    arrays.register(spark)
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), i % 3 == 0, [float(x) for x in rng.normal(size=5)]) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, x double, flag boolean, v array<double>").repartitionByRange(3, "id").sortWithinPartitions("id")
    path = str(tmp_path / "bundle")
    df.write.format("arrays").option("rows", 20).mode("append").save(path)
    return path, rows


def load(spark, path, **options):
    return spark.read.format("arrays").options(**options).load(path)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bundles_come_back_and_numpy_reads_them(spark, table):
    path, rows = table
    df = load(spark, path, rows=7)
    assert df.schema.simpleString() == "struct<id:bigint,x:double,flag:boolean,v:array<double>>"
    assert as_rows(df) == sorted(rows)
    with open(f"{path}/manifest.json") as f:
        listed = json.load(f)["shards"]
    assert sum(s["rows"] for s in listed) == 103 and max(s["rows"] for s in listed) <= 20
    assert sorted(os.listdir(path)) == sorted([s["name"] for s in listed] + ["manifest.json"])
    got = [np.load(f"{path}/{s['name']}") for s in listed]
    assert np.concatenate([g["v"] for g in got]).shape == (103, 5)
    assert sorted(np.concatenate([g["id"] for g in got]).tolist()) == list(range(103))


def test_slices_and_places(spark, table):
    path, rows = table
    got = as_rows(load(spark, path, rows=6, start=17, stop=70, columns="v,id", place="at"))
    assert got == sorted((r[3], r[0], r[0]) for r in rows[17:70])
    assert load(spark, path, start=103).count() == 0 and load(spark, path, start=50, stop=20).count() == 0


class Counted(io.BytesIO):
    total = 0

    def read(self, *n):
        out = super().read(*n)
        self.total += len(out)
        return out


@pytest.mark.parametrize("kind", ["npz", "compressed", "npy"])
def test_only_the_bytes_of_a_range_are_read(kind):
    x = np.arange(100_000.0).reshape(-1, 10)
    data = io.BytesIO()
    {"npz": lambda: np.savez(data, a=x, b=x[:, 0]), "compressed": lambda: np.savez_compressed(data, a=x), "npy": lambda: np.save(data, x)}[kind]()
    file = Counted(data.getvalue())
    found = {m.name: m for m in arrays.members(file, f"f.{kind if kind == 'npy' else 'npz'}")}
    a = found["values" if kind == "npy" else "a"]
    assert a.shape == x.shape and (a.at < 0) == (kind == "compressed")
    file.total = 0
    assert (arrays.rows_of(file, a, 4000, 4010) == x[4000:4010]).all()
    if kind != "compressed":
        assert file.total == 10 * 10 * 8


def test_files_of_others(spark, tmp_path):
    arrays.register(spark)
    x = np.arange(24, dtype=np.float32).reshape(8, 3)
    np.save(tmp_path / "a.npy", x)
    assert as_rows(load(spark, str(tmp_path / "a.npy"), rows=3)) == [(r.tolist(),) for r in x]
    np.savez_compressed(tmp_path / "b.npz", x=x, k=np.arange(8, dtype=np.int32))
    assert as_rows(load(spark, str(tmp_path / "b.npz"), rows=3, columns="k,x", start=2)) == [(k, x[k].tolist()) for k in range(2, 8)]
    np.savez(tmp_path / "c.npz", x=x, k=np.arange(7))
    with pytest.raises(Exception, match="differ in length"):
        load(spark, str(tmp_path / "c.npz")).collect()
    np.save(tmp_path / "d.npy", np.array(["text"]))
    with pytest.raises(Exception, match="no column"):
        load(spark, str(tmp_path / "d.npy")).collect()
    os.mkdir(tmp_path / "none")
    with pytest.raises(Exception, match="no array files"):
        load(spark, str(tmp_path / "none"))


def test_writes_are_seen_whole_or_not_at_all(spark, table):
    path, rows = table
    before = sorted(os.listdir(path))
    bad = spark.createDataFrame([(i, 1.0, True, [1.0] * (5 if i < 90 else 4)) for i in range(100)], "id long, x double, flag boolean, v array<double>")
    with pytest.raises(Exception, match="different lengths"):
        bad.repartition(4).write.format("arrays").option("rows", 5).mode("append").save(path)
    assert sorted(os.listdir(path)) == before and as_rows(load(spark, path)) == sorted(rows)
    with pytest.raises(Exception, match="nulls"):
        spark.createDataFrame([(1, None, True, [1.0])], "id long, x double, flag boolean, v array<double>").write.format("arrays").mode("append").save(path)
    more = spark.createDataFrame([(500, 0.5, False, [0.0] * 5)], "id long, x double, flag boolean, v array<double>")
    more.write.format("arrays").mode("append").save(path)
    assert load(spark, path).count() == 104
    more.write.format("arrays").mode("overwrite").save(path)
    assert as_rows(load(spark, path)) == [(500, 0.5, False, [0.0] * 5)]
    assert len(os.listdir(path)) == 2
    more.limit(0).write.format("arrays").mode("overwrite").save(path)
    assert load(spark, path, columns="v").collect() == [] and load(spark, path).columns == ["id", "x", "flag", "v"]


def book(path, sheets):
    with open(path, "wb") as f:
        workbooks.write(f, sheets)


def test_workbooks_of_tables(spark, tmp_path, sf_dir):
    nation = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect())
    region = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect())
    when = datetime.datetime(2001, 2, 3, 4, 5, 6)
    odd = [(1, None, " a <b> & \"c\" é ", True, datetime.date(1999, 12, 31), when, 0.1), (None, None, "", None, None, None, None), (3, 2.5, None, False, None, None, -1e-7)]
    book(tmp_path / "a.xlsx", {"nation": (["key", "name", "region"], nation), "r & s": (["key", "name"], region), "empty": ([], [])})
    book(tmp_path / "b.xlsx", {"odd": (["n", "gap", "text", "flag", "day", "time", "x"], odd), "nation": (["region", "key"], [(7, 99)])})
    (tmp_path / "other.txt").write_text("no workbook")
    got = workbooks.read(spark, str(tmp_path))
    by = {}
    for r in got.collect():
        by.setdefault((os.path.basename(r["file"]), r["place"], r["sheet"]), {})[r["row"]] = r["cells"]
    assert sorted(by) == [("a.xlsx", 0, "nation"), ("a.xlsx", 1, "r & s"), ("a.xlsx", 2, "empty"), ("b.xlsx", 0, "odd"), ("b.xlsx", 1, "nation")]
    assert by["a.xlsx", 0, "nation"] == dict(enumerate([["key", "name", "region"], *([str(k), n, str(r)] for k, n, r in nation)], 1))
    cells = by["b.xlsx", 0, "odd"]
    assert cells[2] == ["1", None, ' a <b> & "c" é ', "true", "1999-12-31", "2001-02-03 04:05:06", "0.1"]
    assert cells[3] == [None, None, ""] and cells[4] == ["3", "2.5", None, "false", None, None, "-1e-07"]
    assert got.rdd.getNumPartitions() == 5
    n = workbooks.table(spark, str(tmp_path), "nation", "key int, name string, missing date")
    assert sorted((r["key"], r["name"], r["missing"]) for r in n.collect() if r["name"]) == [(k, x, None) for k, x, _ in nation]
    assert n.filter("name IS NULL").collect()[0]["key"] == 99
    o = workbooks.table(spark, str(tmp_path), "odd", "n int, gap double, day date, time timestamp, flag boolean").collect()
    assert [tuple(r) for r in o if r["n"] == 1] == [(1, None, datetime.date(1999, 12, 31), when, True)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        workbooks.table(spark, str(tmp_path), "nation", "name int").collect()


def test_workbooks_as_others_write_them(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{link}"><workbookPr date1904="1"/><sheets><sheet name="S" sheetId="4" r:id="x"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Target="/xl/worksheets/any.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/any.xml": f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c r="AB3" t="s"><v>1</v></c></row><row r="9"><c s="1"><v>1</v></c><c s="2"><v>1.5</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>f</v></c><c><v>12345678901</v></c></row><row/></sheetData></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    got = {r["row"]: r["cells"] for r in workbooks.read(spark, str(tmp_path / "x.xlsx"), "S").collect()}
    assert got[3] == [None, "one", *[None] * 25, "rich text"]
    assert got[9] == ["1904-01-02", "1.5", None, "f", "12345678901"] and got[10] == []
    assert workbooks.read(spark, str(tmp_path / "x.xlsx"), "none").count() == 0
