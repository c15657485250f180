import datetime as dt
import zipfile

import pytest

from opsmetrics.sources.readers import read_call_log, read_targets, register_sheet
from opsmetrics.sources.schema import CALL_LOG
from opsmetrics.sources.sheet import Workbook, _shows_date, date_text

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
SHARED = ["L1", "A", "", "Rich text"]


def cell(place, value, kind=None, style=None):
    attributes = f' t="{kind}"' * bool(kind) + f' s="{style}"' * (style is not None)
    if kind == "inlineStr":
        return f'<c r="{place}"{attributes}><is><t>{value}</t></is></c>'
    return f'<c r="{place}"{attributes}><v>{value}</v></c>'


def row(number, *cells):
    """Values as (value, kind, style); None leaves the cell out."""
    text = "".join(cell(f"{chr(65 + i)}{number}", *c) for i, c in enumerate(cells) if c)
    return f'<row r="{number}">{text}</row>'


def names(*texts):
    return [(text, "inlineStr") for text in texts]


def write(path, sheets, dimension=None):
    """A workbook of the sheets (name, rows); styles 1 and 2 are dates."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>'
                         for i, (n, _) in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}">'
                      f"<sheets>{listed}</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{i}" Type="t" Target="worksheets/s{i}.xml"/>'
                        for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels",
                      f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        items = "".join(f"<si><t>{t}</t></si>" for t in SHARED[:3])
        items += "<si><r><t>Rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si>"
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts>'
                      '<numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs>'
                      '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'
                      "</styleSheet>")
        stated = f'<dimension ref="A1:K{dimension}"/>' if dimension else ""
        for i, (_, rows) in enumerate(sheets, 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}">{stated}'
                          f"<sheetData>{''.join(rows)}</sheetData></worksheet>")


def read(spark, path, **options):
    register_sheet(spark)
    return spark.read.format("sheet").options(**options).load(str(path))


def test_cells(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    write(path, [("Other", [row(1, *names("x"))]), ("Calls", [
        row(3, *names("Text", "Number", "Day", "Flag")),
        row(4, (0, "s"), ("10.0",), (42736, None, 1), (1, "b")),
        row(5, (3, "s"), ("0.25",), (42736.5, None, 2), (0, "b")),
        row(7, None, None, None, None),
        row(8, (2, "s"), ("#N/A", "e"), None, ("made", "str")),
        row(9, (2, "s"), (5,), None, None)])])
    expected = [("L1", "10", "2017-01-01", "true"),
                ("Rich text", "0.25", "2017-01-01 12:00:00", "false"),
                (None, None, None, "made"), (None, "5", None, None)]
    for sheet in ("2", "Calls"):
        found = read(spark, path, sheet=sheet)
        assert found.columns == ["Text", "Number", "Day", "Flag"]
        assert [tuple(r) for r in found.collect()] == expected
    bare = read(spark, path, sheet="2", header="false").collect()
    assert len(bare) == 5 and bare[0].column_1 == "Text"
    with pytest.raises(Exception, match="no sheet 3"):
        read(spark, path, sheet="3").collect()
    with pytest.raises(Exception, match="missing.xlsx"):
        read(spark, tmp_path / "missing.xlsx").collect()


@pytest.mark.parametrize("dimension", [None, 3, 101, 5000])
def test_ranges_of_rows(spark, tmp_path, dimension):
    """No row is lost or read twice, whatever the sheet states of its size."""
    path = str(tmp_path / "a.xlsx")
    write(path, [("S", [row(1, *names("n"))] + [row(i + 2, (i,)) for i in range(100)])],
          dimension)
    found = read(spark, path, rowsPerPartition="7")
    assert sorted(int(r.n) for r in found.collect()) == list(range(100))
    assert found.rdd.getNumPartitions() == max(1, -(-(dimension or 1) // 7))


def test_a_range_ends_its_read(tmp_path):
    path = str(tmp_path / "a.xlsx")
    write(path, [("S", [row(i, (i,)) for i in range(1, 51)] + ["<broken>"])])
    book = Workbook(path)
    assert [n for n, _ in book.rows(book.part_of("1"), 10, 12)] == [10, 11, 12]


def test_schema_folder_and_errors(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"f{i}.xlsx", [("S", [
            row(1, *names("k", "v", "d")), row(2, (i,), (f"{i}.5",), (42736 + i, None, 1))])])
    register_sheet(spark)
    found = (spark.read.format("sheet").schema("k int, v double, d date")
             .load(str(tmp_path)).orderBy("k").collect())
    assert [(r.k, r.v, r.d.isoformat()) for r in found] == [
        (0, 0.5, "2017-01-01"), (1, 1.5, "2017-01-02"), (2, 2.5, "2017-01-03")]
    write(tmp_path / "g.xlsx", [("S", [row(1, *names("k")), row(2, (1,), (2,))])])
    with pytest.raises(Exception, match="more than 1 columns"):
        read(spark, tmp_path / "g.xlsx").collect()
    write(tmp_path / "h.xlsx", [("S", [])])
    with pytest.raises(Exception, match="is empty"):
        read(spark, tmp_path / "h.xlsx").collect()
    assert spark.read.format("sheet").schema("a int").load(str(tmp_path / "h.xlsx")).count() == 0


def test_call_log_and_targets_from_sheets(spark, log, long_targets, tmp_path):
    rows = [row(1, *names(*[c.upper() for c in log.columns]))]
    epoch = dt.date(1899, 12, 30)
    for i, r in enumerate(log.collect(), 2):
        rows.append(row(i, *[
            ((v - epoch).days, None, 1) if c == "call_date"
            else (v, "inlineStr") if isinstance(v, str) else (v,)
            for c, v in r.asDict().items()]))
    targets = [row(1, *names(*long_targets.columns))] + [
        row(i, (r.yr_mo,), (r.metric, "inlineStr"), (r.target,))
        for i, r in enumerate(long_targets.collect(), 2)]
    path = str(tmp_path / "a.xlsx")
    write(path, [("Calls", rows), ("Targets", targets)])
    found = read_call_log(spark, path, "sheet")
    assert [(f.name, f.dataType) for f in found.schema] == [
        (f.name, f.dataType) for f in CALL_LOG]
    assert sorted(found.collect()) == sorted(log.collect())
    assert sorted(read_targets(spark, path, "sheet", sheet="Targets").collect()) == sorted(
        long_targets.collect())


def test_day_numbers_and_formats():
    assert date_text(1) == "1900-01-01" and date_text(61) == "1900-03-01"
    assert date_text(0, True) == "1904-01-01" and date_text(43000.75) == "2017-09-22 18:00:00"
    assert _shows_date("dd/mm/yyyy") and _shows_date("[h]:mm") and _shows_date("m/d/yy h:mm")
    assert not any(map(_shows_date, ["General", "0.00", '0 "days"', "[Red]0.0", "#,##0\\d"]))
