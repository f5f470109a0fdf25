"""Outline, amendments, validation, matching, rendering and parts."""

import random
import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from normloom.operators import matching as M
from normloom.operators import outline as O
from normloom.operators import render as R
from normloom.operators import segment as S
from normloom.operators import validate as V
from normloom.plans import registry
from normloom.sources import profiles as P
from normloom.sources import readers

TEXT = """CAPÍTULO I
DISPOSIÇÕES GERAIS
Art. 1º Esta Lei trata de:
I – primeiro;
a) letra;
II – segundo.
§ 1º Parágrafo.
Art. 2º O art. 5º da Lei passa a vigorar:
“Art. 5º Novo texto.”(NR)
Do prazo
Art. 3º Texto que,
continua aqui."""


def lines(spark, *texts):
    return spark.createDataFrame([(d, k, x) for d, t in enumerate(texts, 1) for k, x in enumerate(t.split("\n"))], "doc_id long, pos int, raw string")


def outline(spark, *texts):
    return O.outline(lines(spark, *texts))


def test_outline(spark):
    rows = outline(spark, TEXT).orderBy("at").collect()
    assert [r.id for r in rows] == ["cap1", "art1", "art1_cpt", "art1_cpt_inc1", "art1_cpt_inc1_ali1", "art1_cpt_inc2", "art1_par1", "art2", "art2_cpt", "art2_cpt_alt1", "art2_cpt_alt1_art5", "art2_cpt_alt1_art5_cpt", "art3", "art3_cpt"]
    by = {r.id: r for r in rows}
    assert by["cap1"].name == "DISPOSIÇÕES GERAIS" and by["art3"].title == "Do prazo"
    assert by["art3_cpt"].content == "Texto que, continua aqui."
    new = by["art2_cpt_alt1_art5_cpt"]
    assert (new.content, new.close_quote, new.note) == ("Novo texto.", True, "NR") and by["art2_cpt_alt1_art5"].open_quote
    assert by["art1"].parent_at == by["cap1"].at and by["art2_cpt_alt1"].parent_at == by["art2_cpt"].at


def test_outline_of_decomposed_text(spark):
    import unicodedata

    text = "Art. 1º É vedada a Alienação:\nI – Órgão;\nII –  Ação x\u0302 do “ Órgão ”.\nArt. 2º A União:\n“Art. 5º À Nação.” (NR)"
    fields = ["at", "id", "kind", "title", "content", "note"]
    made, want = (outline(spark, unicodedata.normalize(form, text)).select(*fields).orderBy("at").collect() for form in ("NFD", "NFC"))
    assert made == want
    assert [r.content for r in made if r.content] == ["É vedada a Alienação:", "Órgão;", "Ação x\u0302 do “Órgão”.", "A União:", "À Nação."]


def test_outline_of_nothing(spark):
    assert outline(spark, "").count() == 0
    assert O.outline(lines(spark, "x").limit(0)).count() == 0


def test_one_shuffle(spark):
    plan = outline(spark, TEXT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stray_paragraph_cuts_the_outline(spark):
    rows = {r.id: r for r in outline(spark, "Art. 1º Um.\nSolto. Fim.\n§ 1º Dois.").collect()}
    assert set(rows) == {"art1", "art1_cpt", None, "par1"}
    assert rows["par1"].parent_at is None and rows[None].unit == "paragraph"


def test_parts_and_generics_are_numbered(spark):
    rows = outline(spark, "PARTE GERAL\nArt. 1º Um:\nMulta - leve;\nInfração - grave.\nPARTE II\nArt. 2º Dois.\nPARTE ESPECIAL").orderBy("at").collect()
    assert [r.num for r in rows if r.kind == "part"] == [1, 2, 2]
    assert [r.id for r in rows if r.kind == "generic"] == ["art1_cpt_dpg1", "art1_cpt_dpg2"]


def test_amendments_merge_and_close(spark):
    rows = outline(spark, "Art. 1º Muda:\n“Art. 2º Um.” (NR)\n\n“Art. 3º Dois:\nI - .....\nII - fim.” (AC)\nArt. 4º Fim.").orderBy("at").collect()
    assert [r.id for r in rows if r.unit == "amendment"] == ["art1_cpt_alt1"]
    assert {r.id for r in rows} >= {"art1_cpt_alt1_art2_cpt", "art1_cpt_alt1_art3_cpt_inc2", "art4"}
    assert [r.note for r in rows if r.note] == ["NR", "AC"]
    assert [r.omitted for r in rows if r.id == "art1_cpt_alt1_art3_cpt_inc1"] == [True]


def test_unclosed_amendment(spark):
    row = O.unclosed(lines(spark, "Art. 1º Muda:\n“Art. 2º Um.\nI - dois;", TEXT)).collect()
    assert [(r.doc_id, r.context) for r in row] == [(1, ["“Art. 2º Um.", "I - dois;"])]


def stack_parents(levels):
    """Parents of a run of levels by a plain stack."""
    stack, out = [], []
    for k, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        out.append(stack[-1] if stack else None)
        stack.append(k)
    return out


def test_outline_equals_a_stack(spark):
    rng = random.Random(4)
    made = {110: "Art. {n}º Texto.", 120: "§ {n}º Texto.", 130: "{r} – texto;", 140: "{l}) texto;", 150: "{n}. texto;", 50: "CAPÍTULO {r}", 70: "SEÇÃO {r}"}
    docs, want = [], {}
    for d in range(1, 25):
        chosen = [rng.choice(list(made)) for _ in range(40)]
        docs.append("\n".join(made[x].format(n=rng.randint(1, 9), r="IVX"[rng.randint(0, 2)], l="abe"[rng.randint(0, 2)]) for x in chosen))
        at, levels = [], []
        for k, x in enumerate(chosen):
            at.append(4 * k)
            levels.append(x)
            if x == 110:
                at.append(4 * k + 1)
                levels.append(120)
        for a, p in zip(at, stack_parents(levels)):
            want[d, a] = None if p is None else at[p]
    got = {(r.doc_id, r["at"]): r.parent_at for r in outline(spark, *docs).collect()}
    assert got == want


SEQUENCES = [
    ("Art. 1º a.\nArt. 2º b.\nArt. 2º-A. c.\nArt. 3º d.", []),
    ("Art. 1º a.\nArt. 3º b.", [3]),
    ("Art. 2º a.\nArt. 1º b.", [2]),
    ("Art. 1º a.\nArt. 1º b.", [3, 5, 19]),
    ("Art. 1º a:\n§ 1º b.\n§ 2º c.", []),
    ("Art. 1º a:\nII - b;\nIII - c.", [4]),
    ("Art. 1º a:\nI - x:\na) b;\nj) y;\nl) z.", [3]),
    ("Art. 1º a:\na) b.", [7]),
    ("Art. 1º a.\n...\nArt. 2º b.", [20]),
    ("Art. 1º a <table>.", [21]),
    ("Art. 1º a <ol>.", [18]),
    ("Art. 1º a:\n§ 1º b.\nParágrafo único. c.\n§ 3º d.", [3, 5, 6, 19]),
]


def test_validation(spark):
    nodes = outline(spark, *(s for s, _ in SEQUENCES))
    got = {r.doc_id: r.codes for r in V.validate(nodes).groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("codes")).collect()}
    assert {d: got.get(d, []) for d in range(1, len(SEQUENCES) + 1)} == {d: c for d, (_, c) in enumerate(SEQUENCES, 1)}
    docs = spark.createDataFrame([(1,), (99,)], "doc_id long")
    assert [r.doc_id for r in V.empty_body(docs, nodes).collect()] == [99]


MATCHES = [("art5", "art5", 10, ""), ("art5", "art5_par1", 9, ""), ("art5_par1", "par1", 8, "art5_"), ("art5_par1", "art5", 7, ""), ("art5", "par1", 6, "art5_"), ("art5", "inc2", 6, "art5_cpt_"), ("art5_cpt_inc2_ali1", "inc2", 4, "art5_cpt_"), ("art9", "cap1", 0, ""), ("art5_par1", "art5_par1u", 10, "")]


def test_match_classes(spark):
    df = spark.createDataFrame([m[:2] for m in MATCHES], "u string, f string").select("u", "f", M.classify(F.col("u"), F.col("f")).alias("m")).select("u", "f", "m.*")
    assert [tuple(r) for r in df.collect()] == MATCHES


def test_best_base_and_rewriting(spark):
    cited = spark.createDataFrame([(1, 7, "urn:lex:br:federal:lei:1990;1!art2"), (1, 7, "urn:lex:br:federal:lei:1980;2!art9"), (1, 7, "bad")], "doc_id long, run_parent int, urn string")
    frags = spark.createDataFrame([(1, 7, "par1"), (1, 7, "par2")], "doc_id long, run_parent int, fragment string")
    keys = ["doc_id", "run_parent"]
    best = M.best_matches(M.matches(cited, frags, keys), keys)
    chosen = M.best_base(best, keys)
    assert [r.base for r in chosen.collect()] == ["urn:lex:br:federal:lei:1980;2"]
    assert {r.full_fragment for r in M.rewritten(best, chosen, keys).collect()} == {"art9_par1", "art9_par2"}


def test_links_and_overrides(spark):
    nodes = M.find_links(outline(spark, "Art. 1º A urn:lex:br:federal:lei:1990;1!art5 muda:\n“§ 1º Novo.” (NR)"))
    keys = ["doc_id", "run_parent"]
    cited, frags = M.amendment_links(nodes)
    best = M.best_matches(M.matches(cited, frags, keys), keys)
    named = M.with_overrides(nodes, M.rewritten(best, M.best_base(best, keys), keys))
    assert [r.override_id for r in named.collect() if r.override_id] == ["art1_cpt_alt1_art5_par1"]
    assert M.find_links(nodes, use=False).where(F.size("links") > 0).count() == 0


def test_rendering(spark):
    nodes = outline(spark, TEXT)
    xml = R.xml_body(nodes).first().body
    root = ElementTree.fromstring(f"<a>{xml}</a>")
    assert [x.get("id") for x in root.iter() if x.get("id")] == [r.id for r in nodes.orderBy("at").collect()]
    assert root.find("Capitulo/Artigo[2]/Caput/Alteracao/Artigo/Caput").get("notaAlteracao") == "NR"
    ElementTree.fromstring(f"<a>{R.html_body(nodes).first().body}</a>")
    row = spark.createDataFrame([("<m/>", "<t/>", "LEI 1")], "m string, t string, c string").select(R.zip_bundle("m", "t", "c").alias("z")).first()
    with zipfile.ZipFile(BytesIO(bytes(row.z))) as z:
        assert z.namelist() == ["proposicao.xml", "texto.xml"] and z.comment == b"LEI 1"


def test_a_quoted_chapter_holds_its_articles(spark):
    text = "Art. 1º Muda:\n“CAPÍTULO II\nDO PRAZO\nArt. 5º Um:\nI - dois;\nArt. 6º Três.” (NR)\nArt. 2º Fim."
    root = ElementTree.fromstring(f"<a>{R.xml_body(outline(spark, text)).first().body}</a>")
    chapter = root.find("Artigo/Caput/Alteracao/Capitulo")
    assert [x.get("id") for x in chapter.findall("Artigo")] == ["art1_cpt_alt1_art5", "art1_cpt_alt1_art6"]
    assert chapter.find("Artigo/Caput/Inciso/p").text == "dois;" and len(root.findall("Artigo")) == 2


def test_depth_has_no_bound(spark):
    above = ["PARTE GERAL", "LIVRO I", "TÍTULO I", "SUBTÍTULO I", "CAPÍTULO I", "SUBCAPÍTULO I", "SEÇÃO I", "SUBSEÇÃO I"]
    units = ["Art. 1º Um:", "§ 1º a:", "I - b:", "a) c:", "1. d:"]
    quoted = ["“" + above[0], *above[1:], *units[:-1], "1. fim.” (NR)"]
    body = R.xml_body(outline(spark, "\n".join([*above, *units, *quoted]))).first().body
    depth = lambda e: 1 + max((depth(x) for x in e), default=0)
    assert depth(ElementTree.fromstring(f"<a>{body}</a>")) >= 2 * 13 + 2


def test_amended_summary(spark):
    rows = outline(spark, "Art. 1º A ementa passa a ser:\n“Dispõe sobre x.” (NR)\nArt. 2º O art. 5º muda:\n“Texto solto.” (NR)")
    marked = O.summaries(rows)
    assert [(r.content, r.klass) for r in marked.where("unit = 'paragraph'").orderBy("at").collect()] == [("Dispõe sobre x.", "summary"), ("Texto solto.", None)]
    root = ElementTree.fromstring(f"<a>{R.xml_body(marked).first().body}</a>")
    assert root.find("Artigo/Caput/Alteracao/Ementa").get("id") == "art1_cpt_alt1_ementa"
    assert [p.code for p in V.validate(marked).collect() if p.code == 16] == [16]


def test_tables_and_images_reach_the_outline(spark):
    html = b"<p>Art. 1&ordm; Um,</p><table><tr><td>t</td></tr></table><p>Solto. Fim.</p><img src=x><p>Art. 2&ordm; Dois.</p>"
    blocks = readers.documents(readers.bytes_of(spark, html, "text/html", 1))
    nodes = O.outline(readers.lines(blocks))
    assert [r.kind for r in nodes.orderBy("at").collect()] == ["article", "paragraph", "table", "paragraph", "image", "article", "paragraph"]
    assert 21 in {r.code for r in V.validate(nodes).collect()}
    flags = O.feature_flags(nodes).first().features
    assert flags["table"] and flags["image"]
    assert "<table><tr><td>t</td></tr></table>" in R.xml_body(nodes).first().body


def test_bases_are_ranked_by_partial_before_neighbour(spark):
    keys = ["doc_id", "run_parent"]
    rows = [(1, 7, "a", None, None, None, "f", 6, "u"), (1, 7, "b", None, None, None, "f", 4, "u"), (1, 8, "a", None, None, None, "f", 0, "u"), (1, 8, "b", None, None, None, "f", 4, "u")]
    best = spark.createDataFrame(rows, "doc_id long, run_parent int, base string, year int, month int, day int, fragment string, level int, urn string")
    assert {r.run_parent: r.base for r in M.best_base(best, keys).collect()} == {7: "b", 8: "b"}


@pytest.mark.parametrize(
    "text, group, there",
    [("projeto lei n", "heading_start", True), ("red1;;substitutivo ao projeto de decreto legislativo", "heading_start", True), ("o congressso nacional decreto", "preamble", True), ("a camara dos deputados promulgo", "preamble", True), ("faco saber que ele", "preamble", False), ("faco saber que o presidente da republica", "preamble", True), ("autora: x", "post_heading", True), ("nº 5", "heading_more", True)],
)
def test_default_patterns(text, group, there):
    assert bool(re.search(P.find("br", "senado.federal", "projeto.lei;pls").pattern(group), text)) == there


def test_parts(spark):
    profile = P.find("br", "senado.federal", "projeto.lei;pls")
    bill = "SENADO\nPROJETO DE LEI DO SENADO\nNº 5, DE 1998\n(Do Senador)\nDispõe sobre x.\nO Congresso Nacional decreta:\nArt. 1º Um.\nSala das Sessões\nDito.\nJUSTIFICAÇÃO\nMais.\nJUSTIFICAÇÃO"
    parts = S.parts(lines(spark, bill, "Só texto."), profile)
    assert [r.part for r in parts.where("doc_id = 1").orderBy("pos").collect()] == ["before", "heading", "heading", "after_heading", "summary", "preamble", "body", "marker", "place_date", "marker", "justification", "justification"]
    rows = {r.doc_id: r for r in S.documents(parts, profile).collect()}
    assert rows[1].heading == "PROJETO DE LEI DO SENADO Nº 5, DE 1998" and not rows[1].no_heading
    assert rows[2].no_heading and rows[2].no_body
    codes = {r.code for r in V.document_problems(S.documents(parts, profile)).where("doc_id = 2").collect()}
    assert codes == {8, 9}
    assert [r.raw for r in S.body(parts).collect()] == ["Art. 1º Um."]


def test_profiles(spark):
    known = P.built_in()
    assert len(known) == len({(p.authority, p.type) for p in known}) == 36
    assert P.override(known[0], heading_optional=True, annex=["^x"]).annex == ("^x",)
    assert P.merge_overrides({"a": 1, "b": 2}, {"b": None, "a": 3}) == {"a": 3, "b": 2}
    assert P.profiles(spark).count() == 36
    with pytest.raises(TypeError):
        P.override(known[0], nothing=1)


def test_the_outline_reads_lines_in_one_pass(spark):
    plan = outline(spark, TEXT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") <= 1 and plan.count("Sort ") <= 1
    few = O.outline(lines(spark, TEXT), columns=["ord", "id"])
    assert few.columns == ["doc_id", "ord", "id"]
    assert [r.id for r in few.orderBy("ord").collect()] == [r.id for r in outline(spark, TEXT).orderBy("at").collect()]


def test_amendments_below_generics_are_named_by_their_numbers(spark):
    rows = outline(spark, "Art. 1º Um:\nMulta - leve;\nMulta - grave:\n“Art. 5º Novo.” (NR)").collect()
    assert {"art1_cpt_dpg2", "art1_cpt_dpg2_alt1", "art1_cpt_dpg2_alt1_art5_cpt"} <= {r.id for r in rows}


def test_problems_and_bodies_need_no_windows(spark):
    texts = [TEXT, *(s for s, _ in SEQUENCES), "Art. 1º Muda:\n“CAPÍTULO II\nDO PRAZO\nArt. 5º Um:\nI - dois;\nSolto. Fim.\nArt. 6º Três.” (NR)\n...\nSolto. Fim.\n§ 1º Um."]
    whole = outline(spark, *texts)
    found = V.validate(O.outline(lines(spark, *texts), columns=V.COLUMNS), optional=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("Window ") <= 1
    assert sorted(map(str, found.collect())) == sorted(map(str, V.validate(whole, optional=True).collect()))
    for body in (R.xml_body, R.html_body):
        made = body(O.outline(lines(spark, *texts), columns=R.COLUMNS))
        assert made._jdf.queryExecution().executedPlan().toString().count("Window ") <= 1
        assert sorted(made.collect()) == sorted(body(whole).collect())


def test_labels_of_both_readings_agree(spark):
    from normloom.functions import labels as L
    from normloom.functions import text as X
    from normloom.operators import nesting as N

    texts = ["Art. 5º-A. O prazo", "Artigo único. x", "Art. 1.234. y", "Parágrafo primeiro-B. z", "§ 3º-B Texto", "XIV-A – texto", "II -) x", "aa) x", "12) x", "1.2.3 x", "2001 foi", "d - x", "Pena – x", "MEDIDA  ADMINISTRATIVA - x", "PARTE ÚNICA", "PARTE SEGUNDA", "PARTE XPTO-A", "LIVRO III", "LIVRO NOVO", "SUBCAPÍTULO I", "Seção Única", "TÍTULO II-A", "Mil reais", "", "Art. 99999999999 x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize(F.col("t")).alias("norm"))
    for compatible in (False, True):
        for r in df.select("*", L.parse(F.col("norm"), compatible).alias("p")).collect():
            assert N.normalize(r.t) == r.norm
            assert N.parse(r.norm, compatible) == (None if r.p is None else (tuple(r.p.label), r.p.taken)), r.t


def test_matches_of_runs_equal_the_joined_ones(spark):
    texts = ["Art. 1º A urn:lex:br:federal:lei:1990;1!art5 e a urn:lex:br:federal:lei:1980;2!art9_par1 mudam:\n“§ 1º Um.\nI - dois;” (NR)\nArt. 2º Muda:\n“§ 1º Um.” (NR)", "“Art. 5º Sem nada em volta.” (NR)", TEXT, "Art. 1º A urn:lex:br:federal:lei:1990;1!art5 muda:\nTexto solto. Fim.\n“§ 1º Um.\nPar. Fim.\n§ 1º Um.” (NR)"]
    keys = ["doc_id", "run_parent"]
    cited, frags = M.amendment_links(M.find_links(outline(spark, *texts)))
    joined = M.matches(cited, frags, keys)
    runs = M.amendment_runs(lines(spark, *texts)).withColumn("content", F.coalesce("around", F.lit("")))
    found = M.run_matches(M.find_links(runs), keys)
    assert found.count() > 4 and sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))
    best = M.best_matches(joined, keys)
    named = M.best_rewritten(M.best_matches(found, keys), keys)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and plan.count("Exchange") == 2
    assert sorted(named.collect()) == sorted(M.rewritten(best, M.best_base(best, keys), keys).collect())


def test_texts_in_order_give_the_outline_of_their_lines(spark):
    texts = [TEXT, *(s for s, _ in SEQUENCES), "Art. 1º Muda:\n“Art. 2º Um.\n\n\nSolto,\n \nI - .....” (NR)\n\n“Art. 3º Dois:\nII - fim.” (AC)\n\n” a\nArt. 4º Fim,\nque segue.", "“x\n..."]
    whole = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(O.outline(whole)) == rows(outline(spark, *texts))
    apart = whole.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    assert rows(O.outline(apart)) == rows(outline(spark, *texts))
    assert "Exchange" not in O.outline(whole)._jdf.queryExecution().executedPlan().toString()


def test_norms_are_dealt_once(spark):
    from normloom.plans import corpus

    plan = corpus.lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "explode" not in plan


ODD = ["Art. 1º Muda:\n“CAPÍTULO II\nDO PRAZO\nArt. 5º Um:\nI - dois;\nSolto. Fim.\nArt. 6º Três.” (NR)\n...\nSolto. Fim.\n§ 1º Um.", "PARTE GERAL\nLIVRO NOVO\nDOS <BENS>\nSEÇÃO ÚNICA\nArt. 1.234-B. Um & \"dois\":\nMulta - x;\nPena - y.\nDo prazo\nArtigo único. Fim <ol>:\naa) b;\n1. c <TABLE>.", "Art. 1º Um:\nI - a:\n...\na) b;\nII-A - c.\nArt. 1º A:\n“§ 1º Um.\nParágrafo único. Dois.\na) três.\nArt. 9º Q.” (AC)\n“§ 1º Um.” (NR)", "Solto. Fim.\n“Solto. Fim.\nI - x.” (NR)"]


def test_problems_and_bodies_of_one_pass(spark):
    texts = [TEXT, *(s for s, _ in SEQUENCES), *ODD]
    given, whole = lines(spark, *texts), outline(spark, *texts)
    found = V.problems(given)
    for made in (found, R.bodies(given), R.bodies(given, html=True)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Window ") == 1
    assert sorted(map(str, found.collect())) == sorted(map(str, V.validate(whole).collect()))
    assert sorted(R.bodies(given).collect()) == sorted(R.xml_body(whole).collect())
    assert sorted(R.bodies(given, html=True).collect()) == sorted(R.html_body(whole).collect())


def test_labels_and_paths_are_shown_alike(spark):
    from normloom.functions import labels as L
    from normloom.functions.levels import LEVELS
    from normloom.operators import nesting as N

    rows = [(x.kind, x.level, n, c, u, name) for x in LEVELS for n in (None, 0, 1, 9, 10, 27, 1999, 4321) for c in (None, 0, 27) for u in (False, True) for name in (None, "XPTO ")]
    df = spark.createDataFrame(rows, L.SCHEMA)
    shown = L.display(F.col("kind"), F.col("num"), F.col("comp"), F.col("is_unique"), F.col("name"))
    for r in df.select("*", F.trim(shown).alias("shown")).collect():
        assert N.display(r.kind, r.num, r.comp, r.is_unique, r.name) == r.shown, r
    paths = outline(spark, TEXT, *ODD).select("id", "path", L.path_text(F.col("path")).alias("shown")).collect()
    as_row = lambda x: (None, None, None, x.kind, x.level, x.num, x.comp, x.is_unique, x.name)
    assert [N.path_text([as_row(x) for x in r.path]) for r in paths] == [r.shown for r in paths]


def test_norms_of_orders_are_dealt_to_all_tasks(spark):
    from normloom.plans import corpus

    spread = corpus.varied_lines(spark, "/root/testdata/sf0.001")
    spread.collect()
    assert spread.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_paths_and_features_of_one_pass(spark):
    from normloom.functions import labels as L

    texts = [TEXT, *(s for s, _ in SEQUENCES), *ODD, "Art. 1º A ementa muda:\nPena - y."]
    given, whole = lines(spark, *texts), outline(spark, *texts)
    want = whole.select("doc_id", "ctx", "id", L.path_text(F.col("path")).alias("shown"))
    assert sorted(map(str, O.path_texts(given).collect())) == sorted(map(str, want.collect()))
    flags = {r.doc_id: (r.features, r.provisions) for r in O.feature_flags(whole).collect()}
    made = O.document_features(given)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = [r.asDict() for r in made.collect()]
    assert {r.pop("doc_id"): (r, r.pop("provisions")) for r in rows} == flags


def test_json_of_one_pass(spark, monkeypatch):
    import pyarrow as pa

    from normloom.operators import nesting as N

    odd = "CAPÍTULO I\nDO \"PRAZO\" \\ \x01\x1f\x7f\x08\u2028 </A>\nArt. 1º Texto \"a\\b\" \x0b\x1b\x02 \U0001f600 é:\nMulta - \x0e\"x\";\nDo \"título\"\x03\n§ 1º Um."
    texts = [TEXT, *(s for s, _ in SEQUENCES), *ODD, odd, "Art. 1º Um.\n" * 3, "..."]
    whole, given = outline(spark, *texts), lines(spark, *texts)
    want = sorted(R.debug_json(whole).collect())
    made = R.node_json(given)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(made.collect()) == want
    # few nodes at once, by number and by size: the same text
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(1, len(texts) + 1)), "text": texts})]
    for bound, value, most in (("ROWS", 2, 2), ("SIZE", 1, 1)):
        monkeypatch.setattr(N.NodeJson, bound, value)
        out = list(N.outlined(iter(batches), [], False, False, N.NodeJson))
        assert all(0 < b.num_rows <= most for b in out)
        assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == [tuple(r) for r in want]
    fields = {"id": pa.string(), "kind": pa.string(), "level": pa.int32(), "content": pa.string(), "title": pa.string(), "omitted": pa.bool_()}
    read = R.node_json(given, fields)
    assert "to_json" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, read.collect())) == sorted(map(str, whole.select("doc_id", *fields).collect()))
    assert R.node_json(given.limit(0), fields).count() == 0
    styled = given.withColumn("runs", F.lit(None).cast("array<struct<text:string,b:boolean,i:boolean,sup:boolean,sub:boolean,href:string>>"))
    assert sorted(R.node_json(styled).collect()) == sorted(R.debug_json(O.outline(styled)).collect())
    assert sorted(map(str, R.node_json(styled, fields).collect())) == sorted(map(str, read.collect()))


def test_json_is_not_made_by_expressions(spark):
    plan = registry.load()[0]["debug_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and "get_json_object" not in plan and plan.count("MapInArrow") == 1 and plan.count("Exchange") == 2


def test_worker_holds_no_lines_that_are_done():
    import gc

    import pyarrow as pa

    from normloom.operators import nesting as N

    texts = [TEXT, *(s for s, _ in SEQUENCES), *ODD, "Art. 1º A ementa muda:\nPena - y."]
    plain = {"doc_id": list(range(len(texts))), "text": texts}
    rows = [(d, k, raw, [N._run(raw)]) for d, t in enumerate(texts) for k, raw in enumerate(t.split("\n"))]
    styled = dict(zip(("doc_id", "pos", "raw", "runs"), map(list, zip(*rows))))
    for sink, columns in ((N.Nodes, ["id", "path", "leaf", "due", "n_same"]), (N.Kinds, ["kind", "quoted", "n", "n_docs"]), (N.Paths, ["ctx", "id", "shown"]), (N.Problems, list(N.Problems.TYPES)), (N.XmlBodies, ["body"]), (N.NodeJson, [])):
        for given in (plain, styled):
            # the collector is off while documents are read, so what it would find then is held until a task ends
            gc.collect()
            gc.disable()
            try:
                assert list(N._outlined(iter([pa.RecordBatch.from_pydict(given)]), columns, given is styled, False, sink))
                assert gc.collect() == 0, (sink, given is styled)
            finally:
                gc.enable()


def test_kinds_of_one_pass(spark, monkeypatch):
    import pyarrow as pa

    from normloom.operators import nesting as N

    texts = [TEXT, *(s for s, _ in SEQUENCES), *ODD, "..."]
    given = lines(spark, *texts)
    given = given.unionByName(given.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    want = O.outline(given).groupBy("kind", (F.col("ctx") > 0).alias("quoted")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    made = O.kinds(given)
    assert sorted(made.collect()) == sorted(want.collect()) and made.columns == want.columns
    # few lines at once: each document still counts once
    monkeypatch.setattr(N, "BATCH", 1)
    batches = list(N.outlined(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 1, 2], "text": ["CAPÍTULO I\nArt. 1º Um.", "Art. 2º Dois.", "Art. 1º Um."]})]), list(N.Kinds.TYPES), False, False, N.Kinds))
    assert len(batches) == 2
    assert sum(r["n"] for b in batches for r in b.to_pylist() if r["kind"] == "article") == 3
    assert sum(r["n_docs"] for b in batches for r in b.to_pylist() if r["kind"] == "article") == 2
