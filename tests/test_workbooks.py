"""Workbooks: what is written is read, and results are ranked from one."""

import zipfile

from unskew import cli
from unskew.sources import xlsx


def test_round_trip(spark, tmp_path):
    made = [("a<b & c", 1.5, True, None), ("", -2.0, False, "x"), (None, None, None, " y ")]
    path = str(tmp_path / "r.xlsx")
    xlsx.write(path, {"First": spark.createDataFrame(made, "m string, v double, ok boolean, t string"), "Second": spark.range(3)})
    got = xlsx.read(spark, path)
    assert got.dtypes == [("m", "string"), ("v", "double"), ("ok", "boolean"), ("t", "string")]
    assert [tuple(r) for r in got.collect()] == made
    xlsx.write(path, {"Empty": spark.createDataFrame(made, "m string, v double, ok boolean, t string").limit(0)})
    assert xlsx.read(spark, path).collect() == [] and xlsx.read(spark, path).columns == ["m", "v", "ok", "t"]


def test_shared_strings_gaps_and_errors(spark, tmp_path):
    path = str(tmp_path / "s.xlsx")
    xlsx.write(path, {"S": spark.range(1)})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="AB2"><v>3</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="AB3" t="e"><v>#DIV/0!</v></c></row><row r="4"/></sheetData></worksheet>'
    with zipfile.ZipFile(path) as z:
        kept = {n: z.read(n) for n in z.namelist() if "sheet1" not in n}
    with zipfile.ZipFile(path, "w") as z:
        for n, v in kept.items():
            z.writestr(n, v)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>na</t></si><si><r><t>v</t></r><r><t>al</t></r></si></sst>")
    assert [r.asDict() for r in xlsx.read(spark, path).collect()] == [{"na": None, "val": 3.0}, {"na": "val", "val": None}]


def test_rank_reads_workbooks_and_tables_alike(spark, tmp_path):
    cells = [(m, d, "keel", *[v + i / 10] * 5, "") for m, v in (("SPE", 0.5), ("mdo", 0.6)) for i, d in enumerate(("x_5", "y_10"))]
    names = ["F1_mean", "GMean_mean", "AUC_mean", "AUPRC_mean", "Runtime_mean"]
    rows = spark.createDataFrame(cells, f"Model string, Dataset string, Source string, {', '.join(f'{n} double' for n in names)}, Error string")
    rows.write.parquet(str(tmp_path / "r.parquet"))
    xlsx.write(str(tmp_path / "r.xlsx"), {"Results": rows.orderBy("Model", "Dataset")})
    want = cli.rank(spark, [str(tmp_path / "r.parquet")]).collect()
    assert want and cli.rank(spark, [str(tmp_path / "r.xlsx")]).collect() == want
