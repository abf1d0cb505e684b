"""CSV, Parquet and spreadsheets: round trips, defaults, formats and refusals."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.plans.schema import ColumnSpec, FieldSelector, TableSpec, quarantine
from tessera.sources import csv, excel, parquet
from tessera.sources.paths import ReadError, UnsafePath, guarded

SPEC = TableSpec(
    [
        ColumnSpec("id", "int", "ID", order=1, required=True),
        ColumnSpec("name", "string", "Name", order=2, required=True),
        ColumnSpec("email", "string", "Email"),
        ColumnSpec("active", "boolean", "Active"),
        ColumnSpec("salary", "decimal(12,2)", "Salary", number_format="$#,##0.00"),
        ColumnSpec("born", "date", "Birth Date"),
    ]
)
ROWS = [(1, 'Ann "A", Ü', "a@x", True, Decimal("12345.67"), dt.date(1980, 1, 2)), (2, "Bob", None, None, None, None)]


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame(ROWS, SPEC.struct())


@pytest.mark.parametrize("codec", ["UNCOMPRESSED", "SNAPPY", "GZIP", "LZ4"])
def test_parquet_round_trip(spark, staff, tmp_path, codec):
    parquet.write(staff, path := f"{tmp_path}/p", SPEC, compression=codec, metadata={"made": "here"})
    assert sorted(map(tuple, parquet.read(spark, path, SPEC).collect())) == ROWS
    assert parquet.can_read(spark, path) and not parquet.can_read(spark, f"{tmp_path}/none")
    assert [x[0] for x in parquet.schema_info(spark, path) if x[2]] == ["id", "name"]


def test_parquet_refusals_and_defaults(spark, staff, tmp_path):
    path = f"{tmp_path}/p"
    with pytest.raises(ValueError, match="codec"):
        parquet.write(staff, path, compression="BROTLI")
    with pytest.raises(PySparkException, match="required"):
        parquet.write(staff.withColumn("name", F.lit(None).cast("string")), path, SPEC)
    parquet.write(staff, path, SPEC, select=FieldSelector(SPEC).fields("id", "email"))
    more = TableSpec([ColumnSpec("id", "int"), ColumnSpec("email", default="none"), ColumnSpec("score", "int"), ColumnSpec("n", "bigint", primitive=True)])
    assert sorted(map(tuple, parquet.read(spark, path, more, type_defaults={"int": 9}).collect())) == [(1, "a@x", 9, 0), (2, "none", 9, 0)]
    with pytest.raises(ValueError, match="at most"):
        parquet.read_table(spark, path, max_size=1)


def test_csv_round_trip(spark, staff, tmp_path):
    csv.write(staff, path := f"{tmp_path}/c", SPEC)
    raw = csv.read_table(spark, path, escape='"')
    assert raw.columns == [c.effective_name for c in SPEC.columns] and {t for _, t in raw.dtypes} == {"string"}
    assert sorted(map(tuple, csv.read(spark, path, SPEC, escape='"').collect())) == ROWS


def test_csv_oddities(spark, tmp_path):
    (tmp_path / "a.csv").write_text("note\nmore\n id ,,id\n1,x\n2,y,7,8\n\n")
    got = csv.read_table(spark, f"file://{tmp_path}/a.csv", skip_lines=2)
    assert got.columns == ["id", "Column2"] and sorted(map(tuple, got.collect()), key=repr) == [("7", "y"), (None, "x")]
    (tmp_path / "b.csv").write_text("1;2\n3;\n")
    bare = csv.read_table(spark, f"file://{tmp_path}/b.csv", headers=False, separator=";")
    assert bare.columns == ["Column1", "Column2"] and sorted(map(tuple, bare.collect()), key=repr) == [("1", "2"), ("3", None)]


def test_quarantine_names_the_cells(spark):
    raw = spark.createDataFrame([(0, "1", "2024-01-01"), (1, "x", "soon"), (2, None, "")], "pos int, ID string, Birth string")
    spec = TableSpec([ColumnSpec("id", "int", "ID"), ColumnSpec("born", "date", "Birth")])
    assert sorted(map(tuple, quarantine(raw, spec, "pos").collect())) == [(1, "born", 1, "soon"), (1, "id", 0, "x")]


def test_excel_round_trip(spark, tmp_path):
    spec = TableSpec([ColumnSpec("id", "int", "ID"), ColumnSpec("name", "string", "Name", bold=True, width=20), ColumnSpec("at", "timestamp_ntz", "At"), ColumnSpec("born", "date", "Born"), ColumnSpec("pay", "double", "Pay", number_format="0.00"), ColumnSpec("ok", "boolean", "Ok")])
    rows = [(1, "Ann <&>", dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(1980, 5, 6), 1.5, True), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, spec.struct())
    path = str(tmp_path / "b.xlsx")
    excel.write_workbook({"One": (df, spec), "Two": df.select("id")}, path, writers={"pay": lambda c, v: v and v * 2})
    want = [(1, "Ann <&>", dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(1980, 5, 6), 3.0, True), rows[1]]
    assert sorted(map(tuple, excel.read(spark, path, spec, "One").collect())) == want
    assert excel.read_table(spark, path, "Two").count() == 2
    lower = TableSpec([ColumnSpec("who", "string", "NAME", default="UNKNOWN")])
    assert sorted(r.who for r in excel.read(spark, path, lower, "One").collect()) == ["Ann <&>", "UNKNOWN"]
    with pytest.raises(ReadError, match="no such sheet"):
        excel.read_table(spark, path, "Three")
    with pytest.raises(ValueError, match="at least one"):
        excel.write_workbook({}, path)


def test_serial_dates():
    for day in (dt.date(1900, 1, 1), dt.date(1900, 2, 28), dt.date(1900, 3, 1), dt.date(2024, 2, 29)):
        assert excel.from_serial(excel.to_serial(day)).date() == day
    assert excel.to_serial(dt.date(1900, 1, 1)) == 1 and excel.to_serial(dt.date(1900, 3, 1)) == 61


def test_paths_and_errors():
    assert guarded("/a/b..c.csv") and guarded("/a/../b.csv") and guarded("viewfs://s/in/x")
    for bad in ("../x", "a/../../x"):
        with pytest.raises(UnsafePath):
            guarded(bad)
    error = ReadError("bad", row=9, column=27, sheet="S", field="f", value="v")
    assert error.cell_reference == "AB10" and "cell AB10" in str(error)


def test_selector():
    pick = FieldSelector(SPEC)
    assert pick.required_only().names() == ["id", "name"] and pick.of_type("date").names() == ["born"]
    assert pick.columns("Email", "zzz").names() == ["email"] and pick.with_formatting().names() == ["salary"]
    assert pick.fields("id", "email").exclude("id").count() == 1 and not pick.fields("zzz").has_matches()
    assert pick.order_by_name().names()[0] == "active" and TableSpec.of(SPEC.struct()).column("salary").number_format == "$#,##0.00"


def test_excel_cells_keep_formats_formulas_and_errors(spark, tmp_path):
    rows = [
        (0, 0, "A", "text", None, None), (0, 1, "B", "text", None, None), (0, 2, "Total", "text", None, None),
        (1, 0, "10", "number", "#,##0.00", None), (1, 1, "2024-05-06", "date", "yyyy-mm-dd", None), (1, 2, "30", "number", None, "A2+20"),
        (2, 0, "true", "boolean", None, None), (2, 1, "2024-05-06T07:08:09", "datetime", "yyyy-mm-dd hh:mm", None), (2, 2, "#DIV/0!", "error", None, "A2/0"),
        (3, 2, None, "text", None, "NOW()"),
    ]
    cells = spark.createDataFrame(rows, excel.CELLS)
    excel.write_cells(cells, path := str(tmp_path / "c.xlsx"))
    back = sorted(map(tuple, excel.read_cells(spark, path).collect()))
    assert back == rows
    spec = TableSpec([ColumnSpec("total", "int", "Total")])
    assert [r.total for r in excel.read(spark, path, spec).collect()] == [30, None]
    met = []
    got = excel.read(spark, path, spec, on_error=lambda c: met.append((c.reference, c.formula)) or "-1").collect()
    assert [r.total for r in got] == [30, -1, -1] and met == [("C3", "A2/0"), ("C4", "NOW()")]
    with pytest.raises(ReadError, match="C3"):
        excel.read(spark, path, spec, on_error=excel.refuse)


def test_excel_styles(spark, tmp_path):
    import zipfile

    spec = TableSpec([ColumnSpec("a", alignment="CENTER", wrap=True, background="#00ff00", color="112233"), ColumnSpec("b", "int", bold=True, frozen=True)])
    excel.write(spark.createDataFrame([("x", 1)], spec.struct()), path := str(tmp_path / "s.xlsx"), spec)
    styles = zipfile.ZipFile(path).read("xl/styles.xml").decode()
    assert '<alignment horizontal="center" wrapText="1"/>' in styles and 'fgColor rgb="FF00FF00"' in styles and '<color rgb="FF112233"/>' in styles and "<b/>" in styles


def test_parquet_row_groups_metadata_and_empty_tables(spark, staff, tmp_path):
    import pyarrow.parquet as pq

    parquet.write(spark.range(1000).coalesce(1), path := f"{tmp_path}/g", row_group_rows=300, metadata={"made": "here"})
    assert pq.ParquetFile(next((tmp_path / "g").glob("*.parquet"))).num_row_groups == 4 and parquet.metadata_of(spark, path) == {"made": "here"}
    with pytest.raises(ValueError, match="no row"):
        parquet.write(staff.limit(0), f"{tmp_path}/e")
    parquet.write(staff.limit(0), f"{tmp_path}/e", allow_empty=True)
    assert parquet.read_table(spark, f"{tmp_path}/e").count() == 0


def test_parquet_errors_name_the_row(spark, tmp_path):
    spark.createDataFrame([("1", "2024-01-02"), ("x", "2024-01-02"), ("3", "soon")], "n string, d string").coalesce(1).write.parquet(path := f"{tmp_path}/p")
    for spec, said in ((ColumnSpec("n", "int"), "'x' as int in row 1"), (ColumnSpec("d", "date"), "'soon' as date in row 2")):
        with pytest.raises(PySparkException, match=said):
            parquet.read(spark, path, TableSpec([spec]), strict=True).collect()


def test_formats_by_name(spark, staff, tmp_path):
    from tessera import sources

    for name, options, reading in (("csv", {"separator": ";"}, {"separator": ";", "escape": '"'}), ("parquet", {"compression": "ZSTD"}, {}), ("excel", {}, {})):
        sources.of(name).to_file(path := f"{tmp_path}/f.{name}", **options).write(staff, SPEC)
        assert sorted(map(tuple, sources.of(name).from_file(spark, path, **reading).read(SPEC).collect())) == ROWS
        assert sources.of(name).from_file(spark, path, **reading).table().count() == 2
    with pytest.raises(ValueError):
        sources.of("orc")


def test_csv_skips_lines_of_each_file(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.csv").write_text(f"note {n}\nid;name\n" + "".join(f"{n}{i};x\n" for i in range(300)))
    got = csv.read_table(spark, f"file://{tmp_path}", separator=";", skip_lines=1)
    assert got.columns == ["id", "name"] and got.count() == 600 and got.filter("id like 'note%' or id = 'id'").count() == 0
    plain = csv.read_table(spark, f"file://{tmp_path}", separator=";", headers=False, multi_line=False)
    assert plain.count() == 604
