"""Readers of texts, markup and office files; runs; the incremental ingest."""

import io
import zipfile

from pyspark.sql import functions as F

from normloom.operators import outline as O
from normloom.operators import runs as U
from normloom.sources import markup as M
from normloom.sources import readers as S
from normloom.streaming.ingest import ingest_once


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Art. 1º</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:tab/><w:t>Texto </w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r></w:p><w:p/><w:p/></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def odt() -> bytes:
    xml = '<x xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h>Um</text:h><text:p>Dois <text:span>três</text:span></text:p></x>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", xml)
    return out.getvalue()


def test_readers_by_type(spark):
    html = "<html><head><title>no</title></head><body><h1>Um</h1><p>a <b>b</b>\n c<p></p><p></p><ol><li>x<li>y</ol><table><tr><td>t</td></tr></table><img src=i>".encode()
    rows = [(1, M.HTML, html), (2, M.DOCX, docx()), (3, M.ODT, odt()), (4, M.TEXT, b"um\ndois\n\ntres"), (5, "image/png", b"x"), (6, M.DOCX, b"broken"), (7, M.HTML, None)]
    blocks = S.documents(spark.createDataFrame(rows, "doc_id long, mime string, content binary"))
    got = {}
    for r in blocks.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.raw, r.list_item, r.problem))
    assert [x[:3] for x in got[1]] == [("paragraph", "Um", None), ("paragraph", "a b c", None), ("paragraph", "", None), ("paragraph", "x", 1), ("paragraph", "y", 2), ("table", "t", None), ("image", "", None)]
    assert [x[1] for x in got[2]] == ["Art. 1º Texto 2", ""]
    assert [x[1] for x in got[3]] == ["Um", "Dois três"]
    assert [x[1] for x in got[4]] == ["um dois", "tres"]
    assert got[5] == got[6] == [(None, None, None, 15)] and 7 not in got
    assert {r.doc_id for r in S.conversion_problems(blocks).collect()} == {5, 6}
    runs = blocks.where("doc_id = 2 and pos = 0").first().runs
    assert [(r.text, r.b, r.sup) for r in runs] == [("Art. 1º ", True, False), ("Texto ", False, False), ("2", False, True)]


def test_lists_become_provisions(spark):
    rows = [(1, 0, "Art. 1º Um:", None), (1, 1, "primeiro;", 1), (1, 2, "segundo.", 2)]
    nodes = O.outline(spark.createDataFrame(rows, "doc_id long, pos int, raw string, list_item int"))
    assert [r.id for r in nodes.orderBy("at").collect()] == ["art1", "art1_cpt", "art1_cpt_inc1", "art1_cpt_inc2"]


def test_files_rules_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Art. 1º Um.\n\nArt. 2º Dois.")
    (tmp_path / "b.bin").write_bytes(b"x")
    files = {r.path.rsplit("/", 1)[-1]: r for r in S.files(spark, str(tmp_path)).collect()}
    assert files["a.txt"].mime == M.TEXT and len(files["a.txt"].digest) == 32
    assert S.files(spark, str(tmp_path)).where(S.accepted(F.col("mime"))).count() == 1
    assert S.line_files(spark, f"{tmp_path}/a.txt").count() == 3
    rules = tmp_path / "rules"
    rules.write_text("# no\n/^art/,starts\n|a.b|,middle\nbroken\n")
    assert {tuple(r) for r in S.regex_rules(spark, str(rules)).collect()} == {("^art", "starts"), ("a.b", "middle")}
    one = S.bytes_of(spark, b"um\ndois", M.TEXT, 9)
    assert [r.raw for r in S.lines(S.documents(one)).collect()] == ["um dois"]


def test_xml_paragraphs_are_whole(spark):
    xml = "<a><p>Art. 1 <b>Lei <i>nova</i></b> &amp; vale</p><q><p>no</p></q><p><b>Negrito</b></p><p/><p>fim</p></a>"
    got = S.xml_paragraphs(spark.createDataFrame([(1, xml), (2, None), (3, "")], "doc_id long, xml string"))
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(1, 0, "Art. 1 Lei nova & vale"), (1, 1, "Negrito"), (1, 2, ""), (1, 3, "fim")]


def test_runs(spark):
    df = spark.createDataFrame([("abcdef",)], "t string")
    runs = F.array(U.run(F.substring("t", 1, 2), b=True), U.run(F.lit("")), U.run(F.substring("t", 3, 2), b=True), U.run(F.substring("t", 5, 2)))
    row = df.select(U.merge(runs).alias("m"), U.to_markup(U.merge(runs)).alias("x"), U.text(U.cut_left(runs, F.lit(3))).alias("l"), U.text(U.cut_right(runs, F.lit(3))).alias("r"), U.to_markup(U.plain(runs)).alias("p")).first()
    assert len(row.m) == 2 and row.x == "<b>abcd</b>ef" and (row.l, row.r, row.p) == ("def", "abc", "abcdef")
    css = spark.createDataFrame([("Font-Weight: bold; vertical-align:super; color:red; text-indent: 1cm; margin-left: 2mm",)], "c string").select(U.style_of(F.col("c")).alias("s"), U.indent_mm(F.col("c")).alias("i")).first()
    assert css.s.b and css.s.sup and not css.s.i and css.i == 12.0
    assert spark.createDataFrame([("e\u0301",), (None,)], "t string").select(U.nfc("t")).collect()[0][0] == "é"


def test_blocks(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(["", "a", "", "", "b", ""])], "doc_id long, pos int, raw string")
    assert [r.raw for r in U.collapse_empty(df).orderBy("pos").collect()] == ["", "a", "", "b", ""]
    assert [r.raw for r in U.trim_ends(df).orderBy("pos").collect()] == ["a", "", "", "b"]


def test_incremental_ingest(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, "um\ndois\n\ntres")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    got = ingest_once(spark, f"{tmp_path}/docs")
    assert sorted((r.doc_id, r.pos, r.raw) for r in got.collect()) == sorted((k, p, x) for k in range(3) for p, x in enumerate(["um dois", "tres"]))


def test_command_line(spark, tmp_path, capsys):
    from normloom.cli import main

    law = tmp_path / "law.txt"
    law.write_text("LEI Nº 5, DE 1998\n\nDispõe sobre x.\n\nO CONGRESSO NACIONAL decreta:\n\nArt. 1º Um.\n\nArt. 3º Dois.\n")
    assert main(["parse", str(law), "--id", "1998;5"]) == 0
    out = capsys.readouterr()
    assert 'URN="urn:lex:br:federal:lei:1998;5"' in out.out and '<Artigo id="art3">' in out.out and "<Ementa>Dispõe sobre x.</Ementa>" in out.out
    assert "\t3\t" in out.err
    assert main(["parse-body", str(law), "--output", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/xml").count() == 1
    assert main(["parse", "-", "--info", "--override", '{"heading_optional": true}']) == 0
