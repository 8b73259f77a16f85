"""Writers of results: workbooks, pages and text grids. They take tables that are reports, of a bounded number of rows."""

from __future__ import annotations

import html
import json
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a report table at most.
REPORT_ROWS = 100_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def column_letters(i: int) -> str:
    """K4: letters of a column from 0: the names of one letter come first, then those of two, and so on, each as a number of base 26."""
    letters, shorter = 1, 0
    while i - shorter >= 26**letters:
        shorter += 26**letters
        letters += 1
    return "".join(chr(65 + (i - shorter) // 26**k % 26) for k in reversed(range(letters)))


def sheet_name(name: str) -> str:
    """K4: a name that a workbook accepts."""
    return re.sub(r"[:\\/?*\[\]]", "-", name)[:31] or "hoja"


def shown(v: object) -> str:
    """A value as a report prints it."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "si" if v else "no"
    if isinstance(v, float):
        return f"{v:,.2f}"
    return f"{v:,d}" if isinstance(v, int) else str(v)


def report_rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report table of more than {REPORT_ROWS} rows; write it as Parquet")
    return rows


def _cell(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        v = "si" if v else "no"
    if isinstance(v, float):
        return f'<c r="{ref}"><v>{v:.6f}</v></c>' if v == v and abs(v) != float("inf") else ""
    if isinstance(v, int):
        return f'<c r="{ref}"><v>{v}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> str:
    """K4: an XLSX file with one sheet a table: frozen header, filter, numbers as numbers."""
    names = [sheet_name(n) for n in sheets]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            rows = [tuple(df.columns), *map(tuple, report_rows(df))]
            body = "".join(f'<row r="{r}">' + "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            area = f"A1:{column_letters(len(df.columns) - 1)}{len(rows)}"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData><autoFilter ref="{area}"/></worksheet>')
    return path


def html_report(title: str, sections: list[tuple[str, str, DataFrame | None]]) -> str:
    """K6, K7: a page of headed texts and tables."""
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for head, text, df in sections:
        out.append(f"<h2>{html.escape(head)}</h2><p>{html.escape(text)}</p>")
        if df is not None:
            rows = "".join("<tr>" + "".join(f"<td>{html.escape(shown(v))}</td>" for v in r) + "</tr>" for r in report_rows(df))
            out.append("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + f"</tr>{rows}</table>")
    return "".join([*out, "</body></html>"])


def write_docx(path: str, title: str, sections: list[tuple[str, str, DataFrame | None]]) -> str:
    """K5: the same sections as a text document."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def para(text: str, bold: bool = False) -> str:
        return f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = [para(title, True)]
    for head, text, df in sections:
        body += [para(head, True), para(text)]
        if df is not None:
            rows = [tuple(df.columns), *map(tuple, report_rows(df))]
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(shown(v), i == 0)}</w:tc>" for v in r) + "</w:tr>" for i, r in enumerate(rows)) + "</w:tbl>" + para(""))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{w}"><w:body>{"".join(body)}</w:body></w:document>')
    return path


def manifest(sources: DataFrame, parameters: dict, metrics: DataFrame) -> str:
    """What a run read, with which parameters, and what it measured."""
    rows = [r.asDict() for r in report_rows(sources)]
    one = metrics.limit(1).collect()
    return json.dumps({"fuentes": rows, "parametros": parameters, "metricas": one[0].asDict() if one else {}}, ensure_ascii=False, sort_keys=True, default=str)


def write_reference_csv(df: DataFrame, path: str) -> None:
    """K9: especie;dmc_cm as one text file that opens with a byte order mark; a list of species is small."""
    df.select(F.col("especie").alias("\ufeffespecie"), "dmc_cm").coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True, encoding="UTF-8")


def ascii_grid_lines(cells: DataFrame, value: str, columns: int, nodata: float = -9999.0) -> DataFrame:
    """K2: rows of a text grid (r, line); missing cells get the no-data value. A row of the grid is built by one task, and is as long as the grid is wide."""
    g = cells.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("long"), F.col(value).cast("double")))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(nodata)).cast("string")), " ")
    return g.select("r", line.alias("linea"))


def features(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """K1: one GeoJSON feature a row as text, to be written by ``write.text``: a point from a struct (x, y), a line from an array of such points, a polygon from an array of rings, which are closed if they are open. Written row by row in the JVM, so a layer of any size streams; null geometries stay null."""
    kind = df.schema[geometry].dataType
    pair = lambda p: F.array(p["x"], p["y"])
    g = F.col(geometry)
    if kind.typeName() == "struct":
        name, places = "Point", pair(g)
    elif kind.elementType.typeName() == "struct":
        name, places = "LineString", F.transform(g, pair)
    else:
        closed = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
        name, places = "Polygon", F.transform(g, lambda r: F.transform(closed(r), pair))
    shape = F.when(g.isNotNull(), F.struct(F.lit(name).alias("type"), places.alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))
