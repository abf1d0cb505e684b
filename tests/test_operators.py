"""Operators on the small fixtures with known answers, nulls and ties, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import coerce, text
from tessera.operators import aggregate as agg
from tessera.operators import display, joins, ordered, project, reshape, setops, sorting

PEOPLE = [(0, "Alice", 30, "Eng"), (1, "Bob", 25, "Sales"), (2, "Charlie", 35, "Eng"), (3, "Diana", 28, "Sales"), (4, "Eve", 32, "Eng")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "pos int, name string, age int, dept string")


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([("Eng", "SF"), ("Sales", "NYC"), ("HR", "Chicago")], "dept string, location string")


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_known_sums(people):
    r = people.agg(agg.sum_of("age").alias("s"), agg.mean_of("age").alias("m"), agg.max_of("age").alias("x"), agg.min_of("age").alias("n")).first()
    assert (r.s, r.m, r.x, r.n) == (150, 30.0, 35, 25)
    none = people.filter("age > 99").agg(agg.sum_of("age").alias("s"), agg.mean_of("age").alias("m")).first()
    assert (none.s, none.m) == (0, None)
    mean = {r.dept: r["mean"] for r in agg.group_by(people, "dept").mean("age").collect()}
    assert mean["Eng"] == pytest.approx(32.333, abs=1e-3)


def test_order_goldens(people):
    assert [r.cum_sum for r in ordered.cum_sum(people, "age", "pos").orderBy("pos").collect()] == [30, 55, 90, 118, 150]
    assert [r.rolling_mean for r in ordered.rolling_mean(people, "age", 3, "pos").orderBy("pos").collect()][:3] == [None, None, 30.0]
    assert [r.shifted for r in ordered.shift(people, "name", 1, "pos").orderBy("pos").collect()][:3] == [None, "Alice", "Bob"]
    assert [r.shifted for r in ordered.shift(people, "name", -1, "pos").orderBy("pos").collect()][-2:] == ["Eve", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_unpartitioned_order_equals_a_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "BLOCK", 7)
    rnd = random.Random(seed)
    n = rnd.randint(1, 90)
    rows = [(i, rnd.choice([None, *range(9)])) for i in range(n)]
    df = spark.createDataFrame(rnd.sample(rows, n), "pos int, v int").repartition(5)

    def got(out, name):
        return [r[name] for r in out.orderBy("pos").collect()]

    run, filled, last = [], [], None
    for _, v in rows:
        run.append((run[-1] if run else 0) + (v or 0))
        last = v if v is not None else last
        filled.append(last)
    assert got(ordered.with_index(df, "pos"), "index") == list(range(n))
    assert got(ordered.cum_sum(df, "v", "pos"), "cum_sum") == run
    assert got(ordered.forward_fill(df, "v", "pos"), "v") == filled
    for k in (-3, 0, 2):
        assert got(ordered.shift(df, "v", k, "pos"), "shifted") == [rows[i - k][1] if 0 <= i - k < n else None for i in range(n)]
    mean = []
    for i in range(n):
        own = [v for _, v in rows[max(0, i - 3) : i + 1] if v is not None]
        mean.append(sum(own) / len(own) if i >= 3 and own else None)
    assert got(ordered.rolling_mean(df, "v", 4, "pos"), "rolling_mean") == pytest.approx(mean)


@pytest.mark.parametrize("ranges", [None, 1, 7, 50])
def test_ordered_by_any_keys(spark, ranges):
    """Several keys, a value that most rows share, nulls and descending expressions."""
    rnd = random.Random(7)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"k{rnd.randint(0, 5)}", rnd.random(), i, i % 5 or None) for i in range(400)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b double, pos int, v int").repartition(5)
    orders = {
        "names": (["a", "b"], lambda r: (r[0] is not None, r[0] or "", r[1])),
        "falling": ([F.col("a").desc(), F.col("b").asc()], lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""] + [0] * (4 - len(r[0] or "")), r[1])),
        "first": ([F.col("a").desc_nulls_first(), F.col("pos").desc()], lambda r: (r[0] is not None, [-ord(c) for c in r[0] or ""] + [0] * (4 - len(r[0] or "")), -r[2])),
        "one": (F.col("b").desc(), lambda r: -r[1]),
    }
    for order, key in orders.values():
        want = sorted(rows, key=key)
        run, last, expected = 0, None, {}
        for at, r in enumerate(want):
            run, last = run + (r[3] or 0), r[3] if r[3] is not None else last
            expected[r[2]] = (at, run, last)
        index = {r.pos: r["index"] for r in ordered.with_index(df, order, ranges=ranges).collect()}
        sums = {r.pos: r.cum_sum for r in ordered.cum_sum(df, "v", order, ranges=ranges).collect()}
        fill = {r.pos: r.v for r in ordered.forward_fill(df, "v", order, ranges=ranges).collect()}
        assert {p: (index[p], sums[p], fill[p]) for p in index} == expected


def test_ranges_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLED", 64)
    monkeypatch.setattr(ordered, "ROWS", 100)
    keys, bounds = ordered._bounds(spark.range(5000), "id", None)
    assert 20 < len(bounds) < 90 and bounds == sorted(bounds)
    assert ordered._bounds(spark.range(60), "id", None)[1] == []
    got = ordered.cum_sum(spark.range(5000), "id", "id").collect()
    assert {r.id: r.cum_sum for r in got} == {i: i * (i + 1) // 2 for i in range(5000)}


def test_order_needs_a_bounded_table(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        ordered.cum_sum(stream, "value", "timestamp")
    with pytest.raises(ValueError):
        ordered.sort_keys([])


def test_joins(people, places):
    pairs = joins.full_join(people, places, "dept", "dept")
    assert pairs.count() == 6
    assert pairs.filter(~joins.has_left()).select("right.location").first()[0] == "Chicago"
    left = joins.left_join(people.filter("dept = 'Eng'"), places.filter("dept = 'HR'"), "dept", "dept")
    assert left.filter(joins.has_right()).count() == 0 and left.count() == 3
    assert joins.right_join(people, places, "dept", "dept").count() == 6
    assert joins.cross_join(places, places).count() == 9
    assert values(joins.semi_join(places, people, "dept", "dept", anti=True), "dept") == [("HR",)]
    with pytest.raises(ValueError):
        joins.pairs(people, places, ["dept", "name"], "dept")
    with pytest.raises(ValueError):
        joins.on()


def test_null_parts_of_composite_keys_match(spark):
    a = spark.createDataFrame([(1, None), (None, None), (2, "x")], "k int, s string")
    assert joins.join_multi(a, a, ["k", "s"], ["k", "s"]).count() == 3
    assert joins.inner_join(a, a, ["k", "s"], ["k", "s"]).count() == 1


def test_project(people, spark):
    holes = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "name string, value int")
    assert project.drop_null(holes, "value").count() == 2
    assert values(project.where_in(holes, "value", [1, None]), "name") == [("a",), ("b",)]
    assert values(project.where_in(holes, "value", []), "name") == []
    assert values(project.reject(holes, F.col("value") > 2), "name") == [("a",), ("b",)]
    assert project.all_of(holes.filter("false"), F.lit(False)).first()[0] and not project.any_of(holes.filter("false"), F.lit(True)).first()[0]
    assert project.column_values(people, "age", "pos", "double") == [30.0, 25.0, 35.0, 28.0, 32.0]
    assert [r.name for r in project.index_by(people, "dept", "pos").orderBy("dept").collect()] == ["Eve", "Diana"]
    assert project.cell(people, 2, "name", "pos") == "Charlie" and project.drop_columns(people, "age", "zzz").columns == ["pos", "name", "dept"]
    for bad in (lambda: project.select_columns(people, "zzz"), lambda: project.rename_column(people, "zzz", "y")):
        with pytest.raises(ValueError, match="no column zzz"):
            bad()
    with pytest.raises(IndexError):
        project.cell(people, 99, "name", "pos")
    seen = []
    project.for_each_indexed(people, "pos", lambda i, r: seen.append((i, r.name)))
    assert seen[4] == (4, "Eve")


def test_aggregate(people, spark):
    holes = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, s string")
    assert holes.agg(agg.distinct_of("s").alias("a"), agg.distinct_of("k", "s").alias("b")).first() == (2, 2)
    tied = spark.createDataFrame([(0, 5), (1, 9), (2, 9), (3, 5)], "pos int, v int")
    assert agg.max_by(tied, "v", "pos").first().pos == 1 and agg.min_by(tied, "v", "pos").first().pos == 0
    assert [r.pos for r in agg.n_largest(tied, 3, "v", "pos").collect()] == [1, 2, 0]
    grouped = agg.group_by(people, "dept")
    assert grouped.size() == 2 and grouped.get("Eng").count() == 3 and grouped.get("none").count() == 0
    assert [tuple(r) for r in agg.key_order(people, ["dept"], "pos").collect()] == [("Eng",), ("Sales",)]
    assert {k.dept: g.count() for k, g in grouped.groups()} == {"Eng": 3, "Sales": 2}
    assert grouped.apply(lambda g: g.nlargest(1, "age")).count() == 2
    assert agg.stats(people, "age").first() == (5, 150, 25, 30.0, 35)


def test_apply_hands_over_many_groups_at_once(spark, capsys):
    """Groups are those of applyInPandas, types too, but not handed over one by one."""
    big = 2**60
    rows = [(i, i % 40 or None, None if i % 7 == 0 else big + i, None if i % 11 == 0 else i % 2 == 0, float(i % 3), f"s{i}") for i in range(400)]
    rows += [(i, 99, big + i, True, -0.0, None) for i in range(400, 430)]
    df = spark.createDataFrame(rows, "pos int, k int, big bigint, flag boolean, f double, s string")

    def seen(g):
        import pandas as pd

        g = g.sort_values("pos")
        cells = [[(type(v).__name__, str(v)) for v in g[c]] for c in g.columns]
        return pd.DataFrame({"seen": [f"{[str(t) for t in g.dtypes]} {sorted(g.index)} {cells}"]})

    def mixed(g):
        g = g.sort_values("pos")
        return g.head(g.pos.iloc[0] % 3)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        for fn, kind in ((seen, "seen string"), (mixed, df.schema), (lambda g: g, df.schema)):
            for keys in (("k",), ("f",), ("k", F.col("pos") % 2)):
                assert values(agg.group_by(df, *keys).apply(fn, kind), "*") == values(df.groupBy(*keys).applyInPandas(fn, kind), "*")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    agg.group_by(df, "k").apply(mixed).explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    with pytest.raises(PySparkException, match="pandas frame of 6 columns"):
        agg.group_by(df, "k").apply(lambda g: g.assign(more=1)).collect()
    nested = df.select("k", F.array("big").alias("a"))
    assert agg.group_by(nested, "k").apply(lambda g: g.head(1)).count() == 41
    assert agg.group_by(df, "k").apply(lambda key, g: g.head(1)).count() == 41


def test_apply_in_order(spark):
    rows = [(i, i % 5, float(i * 37 % 100), i * 53 % 301) for i in range(300)] + [(300, 0, None, 1), (301, 0, float("nan"), None), (302, 6, None, None), (303, 6, None, 4), (304, 6, 1.0, None), (305, 7, 5.0, 9), (306, 7, 5.0, 2)]
    df = spark.createDataFrame(rows, "pos int, k int, v double, w int").repartition(7)
    order = [F.col("v").desc_nulls_last(), F.col("w").asc_nulls_last()]
    first = agg.group_by(df, "k").apply(lambda g: g.head(2)[["pos", "k"]], "pos int, k int", order)
    assert values(first, "pos", "k") == values(agg.group_by(df, "k").top(2, *order), "pos", "k")
    assert {(301, 0), (304, 6), (303, 6), (305, 7), (306, 7)} <= set(values(first, "pos", "k"))
    with pytest.raises(ValueError):
        agg.group_by(df, "k").apply(lambda key, g: g, order="pos")


def test_sort_and_sample(people):
    assert [r.name for r in sorting.tail(people, 2, "pos").collect()] == ["Diana", "Eve"]
    assert sorting.slice_rows(people, -3, 2, "pos").count() == 2 and sorting.slice_rows(people, 4, 99, "pos").count() == 1
    assert values(sorting.slice_deep(people, 1, 3, "pos"), "name") == [("Bob",), ("Charlie",)]
    one, two = (values(sorting.sample(people.repartition(n), 3, "pos", 7), "pos") for n in (1, 4))
    assert one == two and len(one) == 3
    with pytest.raises(ValueError):
        sorting.head(people, -1, "pos")


def test_sets_and_shape(people, spark):
    assert setops.concat(people, people, part="part").count() == 10
    wide = setops.concat_tables(people.select("name"), people.select("age"))
    assert wide.filter("name IS NULL").count() == 5
    assert values(setops.distinct_by(people, "dept", order="pos"), "name") == [("Alice",), ("Bob",)]
    with pytest.raises(ValueError):
        setops.distinct_by(people, order="pos")
    scores = spark.createDataFrame([("Alice", 90, 85, None), ("Bob", 70, 75, 80)], "name string, Q1 int, Q2 int, Q3 int")
    assert reshape.melt(scores, ["name"], ["Q1", "Q2", "Q3"]).count() == 6
    mixed = reshape.melt(spark.createDataFrame([(1, "x", 2)], "id int, a string, b int"), ["id"], ["a", "b"])
    assert values(mixed, "value") == [("2",), ("x",)]
    tags = spark.createDataFrame([("Alice", "a,b"), ("Bob", None), ("Eve", "drop-me")], "name string, tags string")
    got = reshape.explode(tags, "tags", lambda c: F.when(c == "drop-me", F.array().cast("array<string>")).otherwise(F.split(c, ",")))
    assert values(got, "name", "tags") == [("Alice", "a"), ("Alice", "b"), ("Bob", None)]


def test_coerce(spark):
    words = ["12", " 3.7 ", "-2.9", "1e20", "x", "", None, "YES", "no", "t", "9999999999", "1.0e20"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, s string")
    s = F.col("s")
    got = df.orderBy("i").select(coerce.as_int(s).alias("i"), coerce.as_boolean(s).alias("b"), coerce.as_double(s).alias("d")).collect()
    assert [r.i for r in got] == [12, 3, -2, None, None, None, None, None, None, None, None, 2**31 - 1]
    assert [r.b for r in got][7:10] == [True, False, None] and got[3].d == 1e20
    one = spark.range(1).select(
        coerce.as_int(F.lit(3.99), "double").alias("a"), coerce.as_int(F.lit(1 << 33 | 5), "bigint").alias("b"), coerce.as_int(F.lit(True), "boolean").alias("c"),
        coerce.as_date(F.lit(" 2024-02-29 ")).alias("d"), coerce.as_date(F.lit("2023-02-29")).alias("e"), coerce.as_datetime(F.lit("2024-01-02T03:04:05")).alias("f"),
        coerce.as_time(F.lit("03:04")).alias("g"), coerce.as_decimal(F.lit("1.50"), scale=2).alias("h"), coerce.as_boolean(F.lit(0), "int").alias("k"),
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.g, str(one.h), one.k) == (3, 5, 1, dt.date(2024, 2, 29), None, dt.datetime(2024, 1, 2, 3, 4, 5), "03:04:00", "1.50", False)
    with pytest.raises(PySparkException, match="Cannot coerce"):
        df.select(coerce.as_int(s, strict=True)).collect()


def test_parse_and_format(spark):
    formats = ["MM/dd/yyyy", "dd-MMM-yyyy"]
    days = spark.createDataFrame([("2024-01-15",), ("01/15/2024",), ("15-Jan-2024",), (" ",), (None,)], "s string")
    assert [r[0] for r in days.select(text.parse_date(F.col("s"), "yyyy-MM-dd", formats)).collect()] == [dt.date(2024, 1, 15)] * 3 + [None, None]
    with pytest.raises(PySparkException, match="Cannot parse date"):
        spark.range(1).select(text.parse_date(F.lit("junk"), strict=True)).collect()
    one = spark.range(1).select(
        text.strip_timezone(F.lit("2024-01-15T10:30:00+02:00[Europe/Paris]")).alias("a"), text.format_number(F.lit(0.125), "0.00").alias("b"),
        text.format_number(F.lit(1234.5), "$#,##0.00").alias("c"), text.format_value(F.lit(None).cast("string"), "string").alias("d"),
        text.format_value(F.lit("abcdef"), "string", max_length=3).alias("e"), text.parse_value(F.lit("yes"), "boolean").alias("f"),
        text.parse_value(F.lit(" "), "int", default=7).alias("g"), text.zone_of(F.lit("2024-01-15T10:30:00Z")).alias("h"),
        text.excel_serial_date(F.lit("45306")).alias("i"), text.excel_serial_date(F.lit("1")).alias("j"),
    ).first()
    assert one == (dt.datetime(2024, 1, 15, 10, 30), "0.12", "$1,234.50", "", "abc", False, 7, "Z", dt.date(2024, 1, 15), dt.date(1900, 1, 1))
    with pytest.raises(PySparkException, match="required"):
        spark.range(1).select(text.parse_value(F.lit(""), "int", required=True)).collect()
    shown = {"hh:mm a": "hh:mm AM/PM", "EEEE d MMM": "DDDD d MMM", "E": "DDD", "HH:mm:ss.SSS": "HH:mm:ss.000", "yyyy'T'HH": "yyyy'T'HH", "": "", None: None}
    assert {k: text.excel_date_format(k) for k in shown} == shown


def test_display(people, spark):
    many = spark.range(100).select(F.col("id").cast("int").alias("id"))
    out = display.tabular(many, "id", 10)
    assert "..." in out and out.endswith("[100 rows x 1 columns]") and "99" in out and "50" not in out
    assert display.tabular(people.filter("false"), "pos") == "Empty Dataset"
    assert display.table_text(many, "id", 5).endswith("... 95 more rows")
