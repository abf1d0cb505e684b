"""Registered queries of sources, sinks, display and the operators that end on the driver,
each with SQL for what must come back.  Files go to the scratch folder."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import coerce, text
from tessera.operators import aggregate as agg
from tessera.operators import display, project, sorting
from tessera.plans.queries import c, query, t
from tessera.plans.schema import ColumnSpec, TableSpec
from tessera.sources import csv, excel, literal, parquet, scratch
from tessera.sources.paths import UnsafePath, guarded

# tables from values


@query("SELECT 1 AS id, 'a' AS name, DATE '2024-01-02' AS day UNION ALL SELECT 2, NULL, NULL")
def src_literal(spark, d):
    import datetime

    return literal.of(spark, [(1, "a", datetime.date(2024, 1, 2)), (2, None, None)], "id int, name string, day date")


@query("SELECT 7 AS id, 'x' AS name")
def src_table(spark, d):
    return literal.empty(spark, "id int, name string").unionByName(literal.of(spark, [(7, "x")], "id int, name string"))


# columns and rows on the driver

_T = """(SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '12' WHEN 1 THEN ' 3.7 ' WHEN 2 THEN 'yes' WHEN 3 THEN '99999999999' WHEN 4 THEN '-8.9'
 WHEN 5 THEN '2024-02-29' WHEN 6 THEN '' ELSE '2024-02-29T10:11' END AS s FROM part)"""


def _mixed(spark, d):
    words = ["12", " 3.7 ", "yes", "99999999999", "-8.9", "2024-02-29", "", "2024-02-29T10:11"]
    return t(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, words)), (c("p_partkey") % 8).cast("int")).alias("s"))


@query(f"""SELECT p_partkey, CASE WHEN contains(s, '.') THEN CAST(trunc(TRY_CAST(trim(s) AS DOUBLE)) AS INT) ELSE TRY_CAST(trim(s) AS INT) END AS i,
 CASE WHEN contains(s, '.') THEN CAST(trunc(TRY_CAST(trim(s) AS DOUBLE)) AS BIGINT) ELSE TRY_CAST(trim(s) AS BIGINT) END AS l,
 TRY_CAST(trim(s) AS DOUBLE) AS f, CASE WHEN s = 'yes' THEN true END AS b, s AS shown FROM {_T}""")
def table_column(spark, d):
    rows = _mixed(spark, d)
    kinds = {"i": "int", "l": "bigint", "f": "double", "b": "boolean", "shown": "string"}
    return rows.select("p_partkey", *(project.typed_column(rows, "s", k).alias(n) for n, k in kinds.items()))


@query(f"""SELECT p_partkey, CASE WHEN length(s) = 10 THEN TRY_CAST(s AS DATE) END AS d, CASE WHEN length(s) = 16 THEN TRY_CAST(s AS TIMESTAMP) END AS at,
 CASE WHEN length(s) = 16 THEN s[12:] || ':00' END AS clock, CAST(TRY_CAST(trim(s) AS DECIMAL(30, 2)) AS DOUBLE) AS n FROM {_T}""")
def cast_temporal(spark, d):
    rows = _mixed(spark, d)
    s = c("s")
    return rows.select(
        "p_partkey", coerce.as_date(s).alias("d"), coerce.as_datetime(s).alias("at"),
        coerce.as_time(F.when(F.length(s) == 16, F.substring(s, 12, 5))).alias("clock"), coerce.as_decimal(s, scale=2).cast("double").alias("n"),
    )


@query("SELECT n_name FROM nation")
def column(spark, d):
    names = project.column_values(t(spark, d, "nation"), "n_name", "n_nationkey")
    return literal.of(spark, [(n,) for n in names], "n_name string")


@query("SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS at, n_name FROM nation")
def for_each(spark, d):
    met = []
    project.for_each_indexed(t(spark, d, "nation"), "n_name", lambda at, row: met.append((at, row.n_name)))
    return literal.of(spark, met, "at bigint, n_name string")


@query("""SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'),
 ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) AS v(name, type)""")
def column_types(spark, d):
    return literal.of(spark, list(project.column_types(t(spark, d, "orders")).items()), "name string, type string")


@query("SELECT * FROM region")
def copy(spark, d):
    return project.copy(t(spark, d, "region"))


@query("""SELECT count(*) AS size, count(*) = 0 AS empty, true AS has, CAST(4 AS BIGINT) AS columns, min(s_suppkey) AS first, max(s_suppkey) AS last,
 max(CASE WHEN s_suppkey = 3 THEN s_name END) AS cell FROM supplier""")
def size_props(spark, d):
    rows = t(spark, d, "supplier")
    one = (
        project.size(rows), project.is_empty(rows), project.has_column(rows, "s_name") and not project.has_column(rows, "S_Name_"), project.column_count(rows),
        project.first_row(rows, "s_suppkey").first().s_suppkey, project.last_row(rows, "s_suppkey").first().s_suppkey,
        project.cell(rows.filter("s_suppkey >= 2"), 1, "s_name", "s_suppkey"),
    )
    return literal.of(spark, [one], "size bigint, empty boolean, has boolean, columns bigint, first bigint, last bigint, cell string")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 7")
def row_at(spark, d):
    return project.row_at(t(spark, d, "orders"), 7, "o_orderkey").select("o_orderkey", "o_orderdate")


# groups


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def grp_apply(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    kept = agg.group_by(rows, "o_custkey").apply(lambda g: g.head(2), order=[c("o_totalprice").desc_nulls_last(), c("o_orderkey").asc_nulls_last()])
    return kept.select("o_custkey", "o_orderkey")


@query("SELECT p_brand, max(p_size) AS top, count(*) AS n FROM part GROUP BY p_brand")
def grp_compute(spark, d):
    return agg.group_by(t(spark, d, "part"), "p_brand").compute(top=F.max("p_size"), n=F.count(F.lit(1)))


@query("SELECT least(100, count(*)) AS drawn, least(100, count(*)) AS members, least(100, count(*)) AS again FROM orders")
def sample(spark, d):
    """How many are drawn, how many of them are distinct rows of the table, and how many are
    drawn again from the same rows dealt otherwise."""
    rows = t(spark, d, "orders")
    one = sorting.sample(rows, 100, "o_orderkey", seed=42)
    two = sorting.sample(rows.repartition(5), 100, "o_orderkey", seed=42).select("o_orderkey", F.lit(1).alias("twice"))
    members = one.join(rows.select("o_orderkey", F.lit(1).alias("there")), "o_orderkey", "left").join(two, "o_orderkey", "left")
    return members.agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct(F.when(c("there") == 1, c("o_orderkey"))).alias("members"), F.count("twice").alias("again"))


# display


@query("""WITH l AS (SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || '  ' || n_name AS line FROM nation)
SELECT 'n_nationkey  n_name' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY k) FROM l WHERE k < 2) || chr(10) || '...' || chr(10)
 || (SELECT string_agg(line, chr(10) ORDER BY k) FROM l WHERE k >= 23) || chr(10) || chr(10) || '[25 rows x 2 columns]' AS shown""")
def tabular_string(spark, d):
    return literal.of(spark, [(display.tabular(t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 4),)], "shown string")


@query("""WITH l AS (SELECT r_regionkey AS k, r_name, lpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || '  ' || r_name AS line FROM region WHERE r_regionkey < 3)
SELECT 'r_regionkey  r_name' || chr(10) || '-----------  ' || repeat('-', greatest(6, max(length(r_name)))) || chr(10)
 || string_agg(line, chr(10) ORDER BY k) || chr(10) || '... 2 more rows' AS shown FROM l""")
def table_tabular(spark, d):
    return literal.of(spark, [(display.table_text(t(spark, d, "region"), "r_regionkey", 3),)], "shown string")


@query("""SELECT * FROM (VALUES ('yyyy-MM-dd', 'yyyy-MM-dd'), ('hh:mm a', 'hh:mm AM/PM'), ('EEE dd', 'DDD dd'), ('EEEE', 'DDDD'), ('HH:mm:ss.SSS', 'HH:mm:ss.000'),
 ('dd''a''MM', 'dd''a''MM')) AS v(pattern, shown)""")
def java_to_excel_fmt(spark, d):
    given = ["yyyy-MM-dd", "hh:mm a", "EEE dd", "EEEE", "HH:mm:ss.SSS", "dd'a'MM"]
    return literal.of(spark, [(p, text.excel_date_format(p)) for p in given], "pattern string, shown string")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey <= 60 THEN DATE '1900-01-01' + CAST(p_partkey - 1 AS INT) ELSE DATE '1900-03-01' + CAST(p_partkey * 20 - 61 AS INT) END AS DATE) AS d FROM part")
def excel_dateserial(spark, d):
    n = F.when(c("p_partkey") <= 60, c("p_partkey")).otherwise(c("p_partkey") * 20)
    return t(spark, d, "part").select("p_partkey", text.excel_serial_date(n.cast("string")).alias("d"))


# paths and formats by name


@query("SELECT * FROM (VALUES ('/a/b..c.csv', true), ('/a/../b', true), ('../x', false), ('a/../../x', false), ('viewfs://s/in/x', true)) AS v(path, safe)")
def io_pathguard(spark, d):
    def safe(path: str) -> bool:
        try:
            return bool(guarded(path))
        except UnsafePath:
            return False

    return literal.of(spark, [(p, safe(p)) for p in ("/a/b..c.csv", "/a/../b", "../x", "a/../../x", "viewfs://s/in/x")], "path string, safe boolean")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def io_facade(spark, d):
    spec = TableSpec([ColumnSpec("r_regionkey", "int"), ColumnSpec("r_name")])
    out = []
    for name, reading in (("parquet", {}), ("csv", {"escape": '"'}), ("excel", {})):
        path = scratch.folder(spark, "facade") + (".xlsx" if name == "excel" else "")
        sources.of(name).to_file(path).write(t(spark, d, "region"), spec)
        out.append(sources.of(name).from_file(spark, path, **reading).read(spec))
    return out[0].unionByName(out[1]).unionByName(out[2])


# CSV


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, NULLIF(CASE WHEN n_nationkey % 2 = 0 THEN 'a;b' ELSE '' END, '') AS note FROM nation")
def src_csv_opts(spark, d):
    """Lines left out before the header, another separator and quote."""
    body = t(spark, d, "nation").select((c("n_nationkey") + 3).alias("at"), F.concat_ws(";", "n_nationkey", "n_name", F.when(c("n_nationkey") % 2 == 0, F.lit("'a;b'")).otherwise(F.lit(""))).alias("line"))
    top = literal.of(spark, [(0, "made by hand"), (1, "25 rows"), (2, "key;name;note")], "at int, line string")
    top.unionByName(body).orderBy("at").select("line").coalesce(1).write.text(path := scratch.folder(spark, "lines"))
    return csv.read_table(spark, path, separator=";", quote="'", skip_lines=2)


@query("""SELECT '''' || n_nationkey || '''|''' || n_name || '''|' || CASE WHEN n_regionkey = 1 THEN '''''' ELSE '''it''''s ' || n_regionkey || '''' END AS line FROM nation""")
def snk_csv_opts(spark, d):
    shown = F.when(c("n_regionkey") != 1, F.concat(F.lit("it's "), c("n_regionkey").cast("string")))
    rows = t(spark, d, "nation").select("n_nationkey", "n_name", shown.alias("note"))
    csv.write(rows, path := scratch.folder(spark, "csv"), headers=False, separator="|", quote="'", escape="'")
    return spark.read.text(path).select(c("value").alias("line"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def snk_csv_table(spark, d):
    csv.write(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path := scratch.folder(spark, "csv"), single_file=False)
    return csv.read_table(spark, path, multi_line=False)


# Parquet


@query("SELECT * FROM (VALUES ('id', 'int', true), ('name', 'string', false), ('day', 'date', false)) AS v(name, type, required)")
def src_parquet_schema(spark, d):
    spec = TableSpec([ColumnSpec("id", "int", required=True), ColumnSpec("name"), ColumnSpec("day", "date")])
    parquet.write(literal.of(spark, [(1, "a", None)], "id int, name string, day date"), path := scratch.folder(spark, "parquet"), spec)
    return literal.of(spark, parquet.schema_info(spark, path), "name string, type string, required boolean")


@query("SELECT count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS total FROM nation")
def src_parquet_foreach(spark, d):
    met: list[Row] = []
    parquet.for_each(parquet.read_table(spark, f"{d}/nation.parquet"), met.append)
    return literal.of(spark, [(len(met), sum(r.n_regionkey for r in met))], "n bigint, total bigint")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(trunc(o_totalprice) AS INT) AS price, CAST(o_custkey AS DOUBLE) AS customer,
 CASE WHEN o_orderkey % 2 = 0 THEN true ELSE false END AS even, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS INT) END AS loose FROM orders""")
def src_parquet_conv(spark, d):
    """Text, wider and narrower numbers of a file brought to the types of a specification."""
    rows = t(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), c("o_totalprice").alias("price"), c("o_custkey").alias("customer"),
        F.when(c("o_orderkey") % 2 == 0, "true").otherwise("false").alias("even"), F.when(c("o_orderkey") % 3 == 0, "n/a").otherwise(c("o_custkey").cast("string")).alias("loose"),
    )
    parquet.write(rows, path := scratch.folder(spark, "parquet"))
    spec = [ColumnSpec("o_orderkey", "bigint"), ColumnSpec("day", "date", date_format="dd/MM/yyyy"), ColumnSpec("price", "int"), ColumnSpec("customer", "double")]
    return parquet.read(spark, path, TableSpec([*spec, ColumnSpec("even", "boolean"), ColumnSpec("loose", "int")]))


@query("SELECT true AS allowed, true AS refused")
def src_parquet_limits(spark, d):
    def reads(most: int) -> bool:
        try:
            return bool(parquet.read_table(spark, f"{d}/region.parquet", max_size=most).columns)
        except ValueError:
            return False

    return literal.of(spark, [(reads(1 << 30), not reads(10))], "allowed boolean, refused boolean")


@query("SELECT * FROM supplier")
def snk_parquet_table(spark, d):
    parquet.write(t(spark, d, "supplier"), path := scratch.folder(spark, "parquet"))
    return parquet.read_table(spark, path)


@query("SELECT s_suppkey, printf('%.2f', s_acctbal) AS s_acctbal, 'tests' AS made FROM supplier")
def snk_parquet_opts(spark, d):
    """Codec, rows of a row group, metadata, and decimals as text."""
    rows = t(spark, d, "supplier").select("s_suppkey", c("s_acctbal").cast("decimal(12,2)").alias("s_acctbal"))
    parquet.write(rows, path := scratch.folder(spark, "parquet"), compression="GZIP", row_group_rows=20, metadata={"made": "tests"}, decimals_as_text=True)
    return parquet.read_table(spark, path).withColumn("made", F.lit(parquet.metadata_of(spark, path)["made"]))


# spreadsheets


def _book(spark) -> str:
    return scratch.folder(spark, "book") + ".xlsx"


_SUPPLIERS = TableSpec([ColumnSpec("s_suppkey", "bigint", "Key", required=True), ColumnSpec("s_name", "string", "Name"), ColumnSpec("s_acctbal", "double", "Balance", number_format="#,##0.00"), ColumnSpec("day", "date", "Day")])


def _suppliers(spark, d):
    day = F.when(c("s_suppkey") % 3 != 0, F.date_add(F.lit("2020-01-01").cast("date"), c("s_suppkey").cast("int")))
    return t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", day.alias("day"))


_SUPPLIED = "SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(DATE '2020-01-01' + CAST(s_suppkey AS INT) AS DATE) END AS day FROM supplier"


@query(_SUPPLIED)
def src_excel(spark, d):
    excel.write(_suppliers(spark, d), path := _book(spark), _SUPPLIERS)
    return excel.read(spark, path, _SUPPLIERS)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS Key, s_name AS Name FROM supplier")
def snk_excel(spark, d):
    spec = TableSpec([ColumnSpec("s_suppkey", "bigint", "Key"), ColumnSpec("s_name", "string", "Name"), ColumnSpec("s_acctbal", "double", hidden=True)])
    excel.write(_suppliers(spark, d).drop("day"), path := _book(spark), spec, sheet="Suppliers")
    return excel.read_table(spark, path, "Suppliers")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS row, CAST(0 AS INT) AS "column", CAST(n_nationkey * 1000 AS VARCHAR) AS value, 'number' AS kind, '#,##0' AS format, CAST(NULL AS VARCHAR) AS formula FROM nation
UNION ALL SELECT n_nationkey, 1, n_name, 'text', NULL, NULL FROM nation
UNION ALL SELECT n_nationkey, 2, strftime(DATE '2024-01-01' + n_nationkey, '%Y-%m-%d'), 'date', 'dd/mm/yyyy', NULL FROM nation""")
def src_excel_table(spark, d):
    """Each cell with its kind and format."""
    rows = t(spark, d, "nation")
    spec = TableSpec([ColumnSpec("n", "int", number_format="#,##0"), ColumnSpec("n_name"), ColumnSpec("day", "date", date_format="dd/mm/yyyy")])
    day = F.date_add(F.lit("2024-01-01").cast("date"), c("n_nationkey"))
    excel.write(rows.orderBy("n_nationkey").select((c("n_nationkey") * 1000).alias("n"), "n_name", day.alias("day")), path := _book(spark), spec, headers=False)
    return excel.read_cells(spark, path)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 9 ELSE 1 END AS rank, 'none' AS note FROM nation WHERE n_nationkey >= 3")
def src_excel_opts(spark, d):
    """Without a header, from a later row, with defaults by type and by field."""
    rows = t(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", F.when(c("n_nationkey") % 2 == 1, 1).alias("rank"))
    excel.write(rows, path := _book(spark), headers=False)
    spec = TableSpec([ColumnSpec("n_nationkey", "int", column_index=0), ColumnSpec("n_name", column_index=1), ColumnSpec("rank", "int", column_index=2), ColumnSpec("note")])
    return excel.read(spark, path, spec, headers=False, start_row=3, type_defaults={"int": 9}, defaults={"note": "none"})


_FORMULAS = [
    (0, 0, "a", "text", None, None), (0, 1, "total", "text", None, None), (1, 0, "1", "number", None, None), (1, 1, "30", "number", None, "A2+29"),
    (2, 0, "2", "number", None, None), (2, 1, "#DIV/0!", "error", None, "A3/0"), (3, 0, "3", "number", None, None), (3, 1, None, "text", None, "NOW()"),
]


@query("SELECT * FROM (VALUES (1, 30, 30), (2, NULL, -1), (3, NULL, -1)) AS v(a, total, handled)")
def src_excel_formula(spark, d):
    """Stored values of formulas; a failed one is blank, or what the handler makes of it."""
    excel.write_cells(literal.of(spark, _FORMULAS, excel.CELLS), path := _book(spark))
    spec = TableSpec([ColumnSpec("a", "int"), ColumnSpec("total", "int")])
    handled = excel.read(spark, path, spec, on_error=lambda cell: "-1").withColumnRenamed("total", "handled")
    return excel.read(spark, path, spec).join(handled, "a")


@query("SELECT CAST(\"row\" AS BIGINT) AS \"row\", formula, kind, value FROM (VALUES (1, 'A2+29', 'number', '30'), (2, 'A3/0', 'error', '#DIV/0!'), (3, 'NOW()', 'text', NULL)) AS v(\"row\", formula, kind, value)")
def snk_excel_table(spark, d):
    """Formulas stand as formulas in what is written from cells, twice over."""
    excel.write_cells(literal.of(spark, _FORMULAS, excel.CELLS), path := _book(spark))
    excel.write_cells(excel.read_cells(spark, path), again := _book(spark))
    return excel.read_cells(spark, again).filter("formula IS NOT NULL").select("row", "formula", "kind", "value")


@query("SELECT 'n' AS sheet, CAST(n_nationkey AS VARCHAR) AS key FROM nation UNION ALL SELECT 'r', CAST(r_regionkey AS VARCHAR) FROM region")
def snk_excel_multi(spark, d):
    excel.write_workbook({"n": t(spark, d, "nation").select("n_nationkey"), "r": t(spark, d, "region").select("r_regionkey")}, path := _book(spark))
    sheets = [excel.read_table(spark, path, s).select(F.lit(s).alias("sheet"), c(k).alias("key")) for s, k in (("n", "n_nationkey"), ("r", "r_regionkey"))]
    return sheets[0].unionByName(sheets[1])


@query("SELECT 'center' AS aligned, '1' AS wrapped, 'FF00FF00' AS ground, 'FF112233' AS ink, '24' AS width")
def snk_excel_style(spark, d):
    """What the workbook's parts say of a styled column."""
    import io
    import re
    import zipfile

    spec = TableSpec([ColumnSpec("r_name", alignment="CENTER", wrap=True, background="00FF00", color="112233", width=24)])
    excel.write(t(spark, d, "region").select("r_name"), path := _book(spark), spec)
    book = zipfile.ZipFile(io.BytesIO(bytes(spark.read.format("binaryFile").load(path).first().content)))
    styles, sheet = book.read("xl/styles.xml").decode(), book.read("xl/worksheets/sheet1.xml").decode()
    found = [re.search(p, styles)[1] for p in ('horizontal="(center)"', 'wrapText="(1)"', 'fgColor rgb="(FF00FF00)"', '<color rgb="(FF112233)"')]
    return literal.of(spark, [(*found, re.search('width="([0-9]+)"', sheet)[1])], "aligned string, wrapped string, ground string, ink string, width string")


@query("SELECT CAST(n_nationkey * 10 AS VARCHAR) AS n_nationkey, lower(n_name) AS n_name, CAST(n_regionkey AS VARCHAR) || '!' AS n_regionkey FROM nation")
def snk_cellwriter(spark, d):
    """A writer of a field goes before the one for all others."""
    writers = {"n_nationkey": lambda spec, v: v * 10, "n_name": lambda spec, v: v.lower(), "*": lambda spec, v: f"{v}!"}
    excel.write(t(spark, d, "nation"), path := _book(spark), writers=writers)
    return excel.read_table(spark, path)
