"""CSV and XML files read by byte ranges, against DuckDB and Python's own readers."""

import csv
import random

import duckdb
import pytest
from prosemill.sources import readers, records, writers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_in_many_tasks_equals_duckdb(spark, tmp_path, small_splits):
    """Documents with line breaks in one file of more than 100 splits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    writers.csv(docs, str(tmp_path / "d"), "doc_id", single=True)
    (file,) = (tmp_path / "d").glob("part-*.csv")
    assert records.pieces(spark, str(file), "\n").rdd.getNumPartitions() > 100
    got = [tuple(r) for r in readers.csv(spark, str(file)).orderBy("row_id").collect()]
    want = duckdb.sql(f"SELECT * FROM read_csv('{file}', header=true, all_varchar=true, quote='\"', escape='\"', delim=',', max_line_size=10000000)").fetchall()
    assert sum("\n" in r[0] for r in want) > 20
    assert got == [(*(c or "" for c in r), i) for i, r in enumerate(want)]


def test_odd_cells_over_files(spark, tmp_path, small_splits):
    """Quotes, both line ends, blank lines, cells over many splits, a header with a line break; rows in file order."""
    rng = random.Random(3)
    cells = ["a", "", 'q"x"', "two\nlines", "cr\r\nlf", '"\n"', ",;", " lead ", "é\n\né", "\n"]
    rows = [[rng.choice(cells) if rng.random() > 0.03 else "long\n" * 900 for _ in range(3)] + [str(i)] for i in range(400)]
    for name, lo, hi, end in (("a.csv", 0, 150, "\n"), ("b.csv", 150, 150, "\n"), ("c.csv", 150, 400, "\r\n")):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["x", "y", "line\nhead", "n"])
            for i, r in enumerate(rows[lo:hi]):
                w.writerow(r)
                if i % 50 == 0:
                    f.write(end)  # a blank line is no row
    got = readers.csv(spark, str(tmp_path))
    assert got.columns == ["x", "y", "line\nhead", "n", "row_id"]
    assert [list(r) for r in got.orderBy("row_id").collect()] == [[*r, i] for i, r in enumerate(rows)]
    assert readers.csv(spark, str(tmp_path), ["n"], row_id=False).columns == ["n"]


def test_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"one\ntwo,x\n')
    with pytest.raises(ValueError, match="inside a quoted cell"):
        readers.csv(spark, str(tmp_path / "a.csv"))


def test_wrong_number_of_cells_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"one\ntwo",x,y\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.csv(spark, str(tmp_path / "a.csv")).collect()


def test_positions_of_a_file_without_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"a\nb",1\nc,2\n')
    assert [tuple(r) for r in readers.truth(spark, str(tmp_path / "t.csv")).orderBy("row_id").collect()] == [("a\nb", 0), ("c", 1)]


def test_xml_in_many_tasks(spark, tmp_path, small_splits):
    """Entities longer than a split, nested ones, and the last of equal names, in both forms."""
    rng = random.Random(4)
    body = "".join(f"<drug type='t'><name>D{i % 70}</name><description>no &amp; {i} {'y' * rng.randint(0, 4000)}</description><drug-interactions><drug-interaction><name>q</name></drug-interaction></drug-interactions>{'<p><drug><name>in</name></drug><drug><name>in</name></drug></p>' * (i % 4)}<indication>late</indication><atc-code code='A{i}'>x</atc-code><atc-code code='B'/></drug>\n" for i in range(120))
    (tmp_path / "k.xml").write_text(f"<?xml version='1.0'?>\n<drugbank>{body}</drugbank>")
    path = str(tmp_path / "k.xml")
    assert records.pieces(spark, path, "</drug>").rdd.getNumPartitions() > 50
    last = {i % 70: i for i in range(120)}
    lenient = {r.name_key: r for r in readers.knowledge_base(spark, path).collect()}
    strict = {r.name_key: r for r in readers.knowledge_base(spark, path, strict=True).collect()}
    assert set(lenient) == set(strict) == {f"d{k}" for k in last}
    for k, i in last.items():
        a, b = lenient[f"d{k}"], strict[f"d{k}"]
        assert a.description == b.description and a.description.startswith(f"no & {i}")
        assert (a.indication, a.atc_codes) == ("late", [f"A{i}", "B"])
        assert (b.indication, b.atc_codes) == (("late", [f"A{i}"]) if i % 4 == 0 else ("", []))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<d><drug><name> A </name><name>B</name><description/><description>x<b>no</b>y</description>", ("A", "xy", "", [])),
        ("<drug><name>A</name><!-- <drug> --><description>one<!-- c --> two<![CDATA[no]]></description><indication/><p><indication>i</indication></p>", ("A", "onetwo", "i", [])),
        ("<drug a='>'><name><![CDATA[no]]></name><name>&#65;&lt;</name><atc-code x='1' code=\"A&amp;1\">t</atc-code><atc-code code='B'/><atc-code code='A2'></atc-code>", ("A<", "", "", ["A&amp;1", "A2"])),
        ("<name>before</name><drug><description>d</description>", ("", "d", "", [])),
        ("late</indication></drugbank>", ("", "", "", [])),
    ],
)
def test_strict_entity(text, want):
    assert records.strict_entity(text) == want


@pytest.mark.parametrize("text", ["<drug><name>&nbsp;</name>", "<drug><name>a < b</name>"])
def test_strict_entity_fails_on_broken_markup(text):
    with pytest.raises(ValueError, match="entity|markup"):
        records.strict_entity(text)
