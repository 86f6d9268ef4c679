"""Files, pages, the table store and the run log."""

import csv
import datetime as dt
import io
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from caselake.plans import timeline, vaccination
from caselake.session import scratch_path, shared_dir
from caselake.sources import delimited, html, landing
from caselake.sources.joblog import JobLog

LINES = ["Tỉnh\tTổng số ca lây nhiễm\tSố ca lây nhiễm mới\tTổng số ca tử vong\tNgày",
         "Bà Rịa\t2.96\t10\t0\t01-25-2021", "Đắk Lắk\t31.07\t1\t\t1-5-2021"]


@pytest.mark.parametrize("encoding,mark,newline", [
    ("utf-16-le", b"\xff\xfe", "\n"), ("utf-16-be", b"\xfe\xff", "\r\n"), ("utf-8", b"\xef\xbb\xbf", "\n"),
    ("utf-8", b"", "\r\n")])
def test_tsv_in_every_encoding(spark, tmp_path, encoding, mark, newline):
    path = tmp_path / "in.tsv"
    path.write_bytes(mark + (newline.join(LINES) + newline).encode(encoding))
    df = delimited.read_tsv(spark, str(path))
    assert df.columns == ["province_name", "total_cases", "new_cases", "total_deaths", "date_raw"]
    assert [tuple(r) for r in df.orderBy("province_name").collect()] == [
        ("Bà Rịa", "2.96", "10", "0", "01-25-2021"), ("Đắk Lắk", "31.07", "1", None, "1-5-2021")]


def test_utf16_file_is_split(spark, tmp_path):
    path = tmp_path / "big.tsv"
    body = [f"Bà Rịa {i}\t{i}.07\t{i}\t0\t01-25-2021" for i in range(20000)]
    path.write_bytes("\n".join([LINES[0], *body, ""]).encode("utf-16"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200001")
    try:
        df = delimited.read_tsv(spark, str(path))
        assert df.select(F.spark_partition_id()).distinct().count() > 3
        assert df.distinct().count() == 20000
        assert df.filter(~F.col("province_name").rlike("^Bà Rịa [0-9]+$")).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_csv_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,iso_code,date\n1,VNM,2021-01-01\n")
    df = delimited.read_columns_csv(spark, str(tmp_path / "a.csv"), ["iso_code", "date"])
    assert [tuple(r) for r in df.collect()] == [("VNM", "2021-01-01")]
    with pytest.raises(ValueError):
        delimited.read_columns_csv(spark, str(tmp_path / "a.csv"), ["population"])
    assert delimited.first_existing(spark, [str(tmp_path / "no.csv"), str(tmp_path / "a.csv")]).endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        delimited.first_existing(spark, [str(tmp_path / "no.csv")])


RECORDS = [("a", "plain", "1"), ("b", "q \"z\"", "2"), ("c", "two\nlines", "3"), ("d", "a,b", "4"), ("e", "\"\n\n\"x\n,", "5"), ("f", "", "6"),
           ("g", "n" * 30, "7"), ("h", "\"", "8"), ("i", "end\n", "9")]


def _csv_text(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("limit", ["40", "1000", "128m"])
def test_csv_records_over_several_lines_and_blocks(spark, tmp_path, limit):
    """Equal to a plain reader, however the files are split; bad records are told apart."""
    folder = tmp_path / "csv"
    folder.mkdir()
    rows = [(f"{k}{i}", v, n) for i in range(30) for k, v, n in RECORDS]
    (folder / "a.csv").write_text(_csv_text([("k", "v", "n"), *rows]))
    (folder / "b.csv").write_text(_csv_text([("k", "v", "n"), ("z", "one", "1")]) + "\n \nshort,row\nx,1,2,3\n" + _csv_text([("y", "l\n1", "2")])
                                  + "open,\"never closed\nmore,1\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    try:
        good, bad = delimited.read_records(spark, str(folder), ["k", "v", "n"], order="id")
        got = [(r.k, r.v, r.n) for r in good.orderBy("id").collect()]
        assert got == [(k, v or None, n) for k, v, n in rows] + [("z", "one", "1"), ("short", "row", None), ("y", "l\n1", "2")]
        assert sorted((r.file.endswith("/b.csv"), r.record, r.reason) for r in bad.collect()) == [
            (True, 'open,"never closed\nmore,1', "quote not closed"), (True, "x,1,2,3", "more fields than the header")]
        found = delimited.read_columns_csv(spark, str(folder / "a.csv"), ["n", "k"], order="id")
        assert [(r.k, r.n) for r in found.orderBy("id").collect()] == [(k, n) for k, _, n in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_csv_records_over_several_pieces_of_a_block(spark, tmp_path, monkeypatch, bits):
    """Records, the header among them, that begin in one piece and end some pieces later."""
    monkeypatch.setattr(delimited, "PIECE", bits, raising=False)
    rows = [(f"{k}{i}", v, n) for i in range(5) for k, v, n in RECORDS]
    (tmp_path / "a.csv").write_text(_csv_text([("k", "v", "a\nlong\nname"), *rows]))
    (tmp_path / "b.csv").write_text(_csv_text([("k", "v", "a\nlong\nname"), ("z", "l\n\n\nm", "1")]) + "open,\"never\n\nclosed\nmore,1\n")
    good, bad = delimited.read_records(spark, str(tmp_path), ["k", "v"], order="id")
    assert [(r.k, r.v) for r in good.orderBy("id").collect()] == [(k, v or None) for k, v, _ in rows] + [("z", "l\n\n\nm")]
    assert [(r.record, r.reason) for r in bad.collect()] == [('open,"never\n\nclosed\nmore,1', "quote not closed")]


def test_csv_block_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    """One block, also if many lie in it, is no single task's."""
    monkeypatch.setattr(delimited, "PIECE", 6, raising=False)
    (tmp_path / "a.csv").write_text(_csv_text([("k", "v"), *((str(i), "l\n1" if i % 1000 == 0 else "x") for i in range(20_000))]))
    small = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        good, _ = delimited.read_records(spark, str(tmp_path), ["k"])
        dealt = [r["count"] for r in good.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", small)
    assert sum(dealt) == 20_000 and max(dealt) < 10_000


def test_csv_with_doubled_quotes_on_one_line(spark, tmp_path):
    (tmp_path / "q.csv").write_text('k,v\n1,"q ""z"""\n2,"a,""b"""\n')
    df = delimited.read_columns_csv(spark, str(tmp_path / "q.csv"), ["k", "v"])
    assert sorted(map(tuple, df.collect())) == [("1", 'q "z"'), ("2", 'a,"b"')]
    assert "FileScan csv" in df._jdf.queryExecution().executedPlan().toString()


def test_tsv_without_a_mark_and_with_bad_bytes(spark, tmp_path):
    text = "\n".join(LINES) + "\n"
    for encoding in ("utf-16-le", "utf-16-be"):
        (tmp_path / "unmarked.tsv").write_bytes(text.encode(encoding))
        assert delimited.read_tsv(spark, str(tmp_path / "unmarked.tsv")).count() == 2
    (tmp_path / "latin.tsv").write_bytes(text.replace("Đắk Lắk", "Lé").replace("Bà Rịa", "La").replace("ỉ", "i").replace("ổ", "o").replace(
        "ố", "o").replace("ễ", "e").replace("ớ", "o").replace("ử", "u").encode("latin-1"))
    with pytest.raises(ValueError, match="latin.tsv.*UTF-8 at 0"):
        delimited.read_tsv(spark, str(tmp_path / "latin.tsv"))
    read = delimited.read_tsv(spark, str(tmp_path / "latin.tsv"), fallbacks=["ISO-8859-1"])
    assert "Lé" in {r[0] for r in read.collect()}
    (tmp_path / "half.tsv").write_bytes(b"\xff\xfe" + text.encode("utf-16-le").replace("R".encode("utf-16-le"), b"\x00\xd8"))
    with pytest.raises(ValueError, match="half.tsv.*UTF-16LE"):
        delimited.read_tsv(spark, str(tmp_path / "half.tsv"))


def test_snapshot_files_begin_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi"', 1), ("two\nlines", 2)], "province_name string, population long").coalesce(1)
    delimited.write_csv_snapshot(rows, str(tmp_path / "s"), "u", F.lit(dt.date(2024, 1, 1)))
    [file] = [p for p in (tmp_path / "s").iterdir() if p.suffix == ".csv"]
    assert file.read_bytes().startswith(b"\xef\xbb\xbfprovince_name,population,source_url,snapshot_date\n")
    plain = list(csv.reader(io.StringIO(file.read_text("utf-8-sig"))))
    assert plain[1:] == [['say "hi"', "1", "u", "2024-01-01"], ["two\nlines", "2", "u", "2024-01-01"]]
    one = rows.filter("population = 1")
    delimited.write_csv_snapshot(one, str(tmp_path / "one"), "u", F.lit(dt.date(2024, 1, 1)))
    schema = one.withColumn("source_url", F.lit("")).withColumn("snapshot_date", F.lit(dt.date(2024, 1, 1))).schema
    assert [tuple(r) for r in delimited.read_csv_snapshot(spark, str(tmp_path / "one"), schema).collect()] == [
        ('say "hi"', 1, "u", dt.date(2024, 1, 1))]


def test_order_over_several_files(spark, tmp_path):
    """Of rows with one key the last row of the last file wins, however Spark packs the files."""
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(12):
        lines = ["iso_code,date", *[f"K{i}-{j},2021-01-01" for j in range(40 * (12 - i))]]
        (folder / f"part-{i:02d}.csv").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for limit in ("700", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            df = delimited.read_columns_csv(spark, str(folder), ["iso_code", "date"], order="id")
            names = [r.iso_code for r in df.orderBy("id").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert names == [f"K{i}-{j}" for i in range(12) for j in range(40 * (12 - i))]
    with pytest.raises(ValueError, match="id"):
        landing.land_daily(df.drop("id"), "x.csv")


def test_folder_with_files_of_several_encodings(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    for i, (encoding, mark) in enumerate([("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"), ("utf-8", b"")]):
        (folder / f"{i}.tsv").write_bytes(mark + ("\n".join(LINES) + "\n").encode(encoding))
    df = delimited.read_tsv(spark, str(folder))
    assert df.count() == 8 and df.groupBy("province_name", "total_cases").count().count() == 2


def test_scratch_of_a_run_is_removed(spark):
    from caselake.session import materialize, scratch_run

    with pytest.raises(RuntimeError):
        with scratch_run(spark):
            path = scratch_path(spark, "x")
            materialize(spark.range(3), "y")
            folder = os.path.dirname(path).removeprefix("file://")
            assert len([n for n in os.listdir(folder)]) == 1
            raise RuntimeError
    assert not os.path.exists(folder)


def test_recent_days_is_inclusive(spark):
    df = spark.range(0, 10).select(F.date_add(F.lit(dt.date(2021, 1, 1)), F.col("id").cast("int")).alias("date"))
    assert landing.recent_days(df, "date", 4).count() == 5


def test_landing_checks(spark):
    rows = spark.createDataFrame([("iso_code",), ("iso_code",)], "iso_code string")
    with pytest.raises(ValueError):
        landing.check_landing(rows)
    with pytest.raises(ValueError):
        landing.check_landing(rows.filter("false"))
    landing.check_landing(rows.unionByName(spark.createDataFrame([("VNM",)], "iso_code string")))


PAGE = """<TABLE border=1><tr><td>skip</td></tr></TABLE>
<table><thead><tr><th>Tỉnh<br/></th><th>Ca</th><th>Chết</th><th>Mới</th></tr></thead>
<tr><td><b>Hà&nbsp;Nội</b><sup>[1]</sup></td><td>1.234</td><td>n.a.</td><td> 5 </td></tr>
<tr><td></td><td>1</td><td>1</td><td>1</td></tr></table>
<table class='x'><tr><th>LOCALITY</th><th>Population (2019)</th><th>Doses
distributed</th><th>Doses administered</th><th>Doses administered per 100</th></tr>
<tr><td>Long An province</td><td>1,000</td><td>900</td><td>500</td><td></td></tr></table>
<table><tr><th>d</th><th>a</th><th>b</th><th>c</th><th>e</th></tr><tr><td>2021-01-01</td><td/><td></td><td>5</td><td>5</td></tr>
<tr><td colspan="3">2021-01-02</td><td>70</td><td>1</td></tr><tr><td COLSPAN='3'>Jan</td><td>70</td><td>1</td></tr>
<tr><td>2021-01-03</td><td>&amp;</td><td></td><td>60</td><td>2</td></tr></table>"""


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string")


def test_tables_of_a_real_looking_page(spark):
    cells = html.html_cells(pages(spark, PAGE, "no table here"))
    got = {(r.table_no, r.row_no, r.cell_no): r.cell for r in cells.collect()}
    assert got[0, 0, 0] == "skip" and got[1, 0, 0] == "Tỉnh" and got[1, 1, 0] == f"Hà{chr(160)}Nội[1]"
    assert got[2, 0, 2] == "Doses distributed" and got[3, 2, 2] == "2021-01-02" and got[3, 2, 3] == "70"


def cells_of(spark, page):
    rows = {}
    for r in html.html_cells(pages(spark, page)).orderBy("table_no", "row_no", "cell_no").collect():
        rows.setdefault((r.table_no, r.row_no), []).append(r.cell)
    return rows


def test_hidden_tables_are_no_tables(spark):
    page = ("<!-- <table><tr><td>no</td></tr></table> --><script>var t='<table><tr><td>no</td></tr></table>';</script>"
            "<style>td{}</style><TABLE><track src=x><tr><td>yes</td></tr></TABLE><!-- <table><tr><td>open comment")
    assert cells_of(spark, page) == {(0, 0): ["yes"]}


def test_nested_tables(spark):
    page = ("<table><tr><td>a<table><tr><td>n1</td><td>n2</td></tr><tr><td>n3<table><tr><td>deep</td></tr></table></td></tr></table></td>"
            "<td>b</td></tr><tr><td>c</td></tr></table><table><tr><td>last</td></tr></table >")
    assert cells_of(spark, page) == {
        (0, 0): ["a n1 n2 n3 deep", "b"], (0, 1): ["c"], (1, 0): ["n1", "n2"], (1, 1): ["n3 deep"], (2, 0): ["deep"], (3, 0): ["last"]}


def test_pages_without_end_tags(spark):
    page = ("<table><caption>not a cell<thead><tr><th>h1<th>h2<tbody><tr><td>a<td>b<tr><td>c<td><b>d</b><tfoot><tr><td>e<td></table>"
            "<table><td>loose<td>cells<tr><td>own row</table><table><tr><td>nested <table><tr><td>in<td>ner</table> after<td>x</table>")
    assert cells_of(spark, page) == {
        (0, 0): ["h1", "h2"], (0, 1): ["a", "b"], (0, 2): ["c", "d"], (0, 3): ["e", ""], (1, 0): ["loose", "cells"], (1, 1): ["own row"],
        (2, 0): ["nested in ner after", "x"], (3, 0): ["in", "ner"]}


def test_quoted_markup_is_no_markup(spark):
    page = ("""<table class="a>b"><tr title='<td>no</td>'><td title='x>y'>v</td><td data-x="</td><td>" colspan=2>w</td></tr>"""
            """<tr><td title="colspan=3">one</td><td title='never closed>two</td></tr></table>"""
            """<img alt="<table><tr><td>no</td></tr></table>"><p>a < b and 2 <3</p><table><tr><td>1 < 2 <i>& 3 > 2</i></td></tr></table>""")
    assert cells_of(spark, page) == {(0, 0): ["v", "w", "w"], (0, 1): ["one", "two"], (1, 0): ["1 < 2 & 3 > 2"]}
    assert cells_of(spark, "<table><tr><td>\x01td\x02\x03x</td></tr></table>") == {(0, 0): ["tdx"]}


def test_character_references(spark):
    cases = {"&#91;3&#93;": "[3]", "a&#8211;b": "a–b", "a&#xA0;b": "a\xa0b", "&eacute;t&eacute;": "été", "&amp;lt;": "&lt;", "&#x1F600;": "😀",
             "&#X41;&#0066;&#67 x": "ABC x", "&#150;&#x80;&#129;": "–€\x81", "&#0;&#xD800;&#1114112;": "���", "&copy 1&amp&nbsp2": "© 1&&nbsp2",
             "&unknown; & &; &#; &#x; &#12345678;": "&unknown; & &; &#; &#x; &#12345678;", "AT&amp;T&hellip;": "AT&T…", "&&lt;&": "&<&"}
    page = "".join(f"<table><tr><td>{raw}</td></tr></table>" for raw in cases)
    assert [v for _, [v] in sorted(cells_of(spark, page).items())] == list(cases.values())


def test_footnotes_written_as_references_do_not_hide_a_place(spark):
    page = PAGE.replace("<sup>[1]</sup>", "<sup>&#91;1&#93;</sup>").replace("&nbsp;", "&#xA0;").replace("</td>", "")
    cases = timeline.province_cases(timeline.page_province_text(pages(spark, page))).collect()
    assert [(r.province_name, r.total_cases) for r in cases] == [("Hà Nội", 1234)]


def test_list_items_without_end_tags(spark):
    page = ("<ul><li><a href='>1'>One</a><li>\n<a href=2>Tw<b>o</b></a>\n<li><a href=3>Three</a> more<li><b><a href=4>Four</a></b>"
            "<li><a href=5>Five</a><ul><li><a href=6>Six&#33;</a></ul><li><a>no attribute</a><li><a href=7>a</a><a href=8>b</a></ul>")
    assert [r["item"] for r in html.html_list_items(pages(spark, page)).orderBy("item_no").collect()] == ["One", "Two", "Five", "Six!"]


def test_spans_in_both_directions(spark):
    page = ("<table><tr><th rowspan=2>h</th><th colspan='2'>w</th></tr><tr><th>x</th><th>y</th></tr>"
            "<tr><td>1</td><td rowspan=\"3\">2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr><tr><td colspan=1>6</td><td>7</td></tr>"
            "<tr><td>8</td></tr></table>")
    assert cells_of(spark, page) == {
        (0, 0): ["h", "w", "w"], (0, 1): ["h", "x", "y"], (0, 2): ["1", "2", "3"], (0, 3): ["4", "2", "5"], (0, 4): ["6", "2", "7"],
        (0, 5): ["8"]}
    wide = cells_of(spark, "<table><tr><td colspan=999999999>x</td><td>y</td></tr></table>")
    assert len(wide[0, 0]) == 1001


def test_list_items(spark):
    page = ("<ul><li><a href=1>One</a> (2020)</li><li><a href=2>Two</a></li><li class=x> <A href=3><b>Three</b></A>\n</li>"
            "<link><li><a href=4>Four</a> and <a href=5>five</a></li><!-- <li><a href=6>Six</a></li> --></ul>")
    assert [r["item"] for r in html.html_list_items(pages(spark, page)).orderBy("item_no").collect()] == ["Two", "Three"]


def test_locality_table_by_header_words(spark):
    rows = html.locality_rows(pages(spark, PAGE)).collect()
    assert [r.asDict() for r in rows] == [{
        "page_id": 0, "province_name": "Long An province", "population": "1,000", "doses_distributed": "900",
        "doses_per_100": "", "doses_administered": "500"}]
    clean = vaccination.clean_localities(html.locality_rows(pages(spark, PAGE))).first()
    assert (clean.province_name, clean.population, clean.doses_per_100) == ("Long An", 1000, 50.0)


def test_missing_tables_fail_the_run(spark):
    with pytest.raises(PySparkException, match="no locality table"):
        html.locality_rows(pages(spark, "<table><tr><td>x</td></tr></table>")).collect()
    with pytest.raises(PySparkException, match="too few tables"):
        timeline.page_timeline_text(pages(spark, "<table><tr><td>x</td></tr></table>")).collect()
    with pytest.raises(PySparkException, match="no column for population"):
        html.locality_rows(pages(spark, PAGE.replace("Population", "People"))).collect()
    assert html.locality_rows(pages(spark, "nothing"), strict=False).collect() == []


def test_province_and_timeline_by_position(spark):
    cases = timeline.province_cases(timeline.page_province_text(pages(spark, PAGE))).collect()
    assert [(r.province_name, r.total_cases, r.total_deaths, r.new_cases) for r in cases] == [("Hà Nội", 1234, 0, 5)]
    daily = timeline.timeline_daily(timeline.page_timeline_text(pages(spark, PAGE))).orderBy("full_date").collect()
    # the first body row is a heading by rule; counts never go below zero
    assert [(str(r.full_date), r.total_cases, r.new_cases, r.new_deaths) for r in daily] == [
        ("2021-01-02", 70, 0, 0), ("2021-01-03", 60, 0, 1)]


def test_rename_by_header(spark):
    df = spark.createDataFrame([("a", "1", "2", "3")], ["By  Locality", "Population", "Doses distributed",
                                                     "Doses administered"])
    assert vaccination.rename_by_header(df).columns == [
        "province_name", "population", "doses_distributed", "doses_administered", "doses_per_100"]
    with pytest.raises(ValueError, match="population"):
        vaccination.rename_by_header(df.drop("Population"))


def test_replace_and_read(spark, store):
    assert store.read("dim_date").count() == 0 and not store.exists("dim_date")
    days = spark.createDataFrame([(20210101, dt.date(2021, 1, 1), 2021, 1, 53, 1)],
                                 "date_id int, full_date date, year int, month int, week int, quarter int")
    assert store.replace("dim_date", days) == 1
    before = store.read("dim_date")
    # a table may be rebuilt from itself, and a reader keeps the version it opened
    assert store.replace("dim_date", store.read("dim_date").unionByName(days)) == 2
    assert before.count() == 1 and store.read("dim_date").count() == 2


def test_unfinished_version_is_ignored(spark, store):
    days = spark.createDataFrame([(20210101,)], "date_id int")
    store.replace("dim_date", days)
    os.makedirs(os.path.join(store.root, "dim_date", "v-broken"))
    open(os.path.join(store.root, "dim_date", "_lists", "abc.draft"), "w").close()
    assert store.read("dim_date").count() == 1


def test_write_that_breaks_leaves_the_old_rows(spark, store):
    """An error in the middle of a merge's write, and one in the check of a landing."""
    keys, name = ["province_id", "date_id"], "fact_province_daily"
    store.merge(name, fact(spark, (1, 20200101, 1), (1, 20210101, 2)), keys, "month_id")
    before = sorted(map(str, store.read(name).collect()))
    bad = fact(spark, (1, 20210101, 9), (2, 20210102, 9)).withColumn(
        "new_cases", F.when(F.col("province_id") == 2, F.raise_error(F.lit("broken half-way"))).otherwise(F.col("new_cases")))
    with pytest.raises(PySparkException):
        store.merge(name, bad, keys, "month_id")
    assert sorted(map(str, store.read(name).collect())) == before
    with pytest.raises(ValueError, match="refused"):
        store.replace(name, fact(spark, (7, 20200101, 1)), check=lambda rows: (_ for _ in ()).throw(ValueError("refused")))
    assert sorted(map(str, store.read(name).collect())) == before


def test_old_folders_go_after_a_stated_number_of_writes(spark, store):
    days = spark.createDataFrame([(20210101,)], "date_id int")
    for _ in range(6):
        store.replace("dim_date", days)
    names = os.listdir(os.path.join(store.root, "dim_date"))
    assert len([n for n in names if n.startswith("v-")]) == 3 and store.read("dim_date").count() == 1


def test_added_column_has_its_default_in_older_rows_only(spark, store):
    from pyspark.sql import types as T

    from caselake.sources.store import TableStore

    old = T.StructType().add("k", T.IntegerType())
    new = T.StructType().add("k", T.IntegerType()).add("n", T.LongType())
    TableStore(spark, store.root, {"t": old}, {}).replace("t", spark.createDataFrame([(1,)], "k int"))
    later = TableStore(spark, store.root, {"t": new}, {"t": {"n": 0}})
    later.append("t", spark.createDataFrame([(2, None), (3, 5)], "k int, n bigint"))
    assert {r.k: r.n for r in later.read("t").collect()} == {1: 0, 2: None, 3: 5}


def test_merge_of_some_columns(spark, store):
    keys, name = ["province_id", "date_id"], "fact_province_daily"
    full = fact(spark, (1, 20210101, 2)).withColumns({c: F.lit(7).cast("bigint") for c in (
        "new_deaths", "total_cases", "total_deaths", "recovered", "active_cases")})
    store.merge(name, full, keys, "month_id")
    store.merge(name, fact(spark, (1, 20210101, 5), (2, 20210101, 6)), keys, "month_id", update=["new_cases"])
    got = {r.province_id: (r.new_cases, r.new_deaths, r.recovered, r.total_cases) for r in store.read(name).collect()}
    assert got == {1: (5, 7, 7, 7), 2: (6, 0, 0, None)}


def fact(spark, *rows):
    return spark.createDataFrame(
        [(p, d, n, d // 100) for p, d, n in rows], "province_id int, date_id int, new_cases bigint, month_id int")


def test_merge_rewrites_touched_months_only(spark, store):
    keys = ["province_id", "date_id"]
    name = "fact_province_daily"
    store.merge(name, fact(spark, (1, 20200101, 1), (1, 20210101, 2), (2, 20210101, 3)), keys, "month_id")
    untouched = [f for f in store.folders(name) if f["part"] == "202001"]
    delta = fact(spark, (1, 20210101, 20), (3, 20210102, 30))
    store.merge(name, delta, keys, "month_id")
    store.merge(name, delta, keys, "month_id")  # again: nothing changes
    got = {(r.province_id, r.date_id): r.new_cases for r in store.read(name).collect()}
    assert got == {(1, 20200101): 1, (1, 20210101): 20, (2, 20210101): 3, (3, 20210102): 30}
    assert [f for f in store.folders(name) if f["part"] == "202001"] == untouched
    assert store.read(name, [202101]).count() == 3


def test_run_log(spark, store):
    log = JobLog(spark, store.root)
    with log.run("one") as done:
        done(7)
    with pytest.raises(RuntimeError):
        with log.run("two"):
            raise RuntimeError("broken")
    rows = log.read().orderBy("job_id").collect()
    assert [(r.job_name, r.status, r.rows_processed, r.error_message) for r in rows] == [
        ("one", "success", 7, None), ("two", "failed", 0, "broken")]
    assert all(r.finished_at >= r.started_at for r in rows) and rows[0].job_id < rows[1].job_id
    with log.run("three"):
        last = log.read().orderBy(F.col("job_id").desc()).first()
        assert (last.job_name, last.status, last.finished_at) == ("three", "running", None)
    with pytest.raises(ValueError):
        log.append("x", "odd", 0, rows[0].started_at, None)


def test_shared_folder_follows_the_session(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named and scratch_path(spark, "x").startswith(named)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
