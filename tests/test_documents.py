"""Parsers, sections, records, chunks, retrieval, drafts, tasks, evaluation, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, draft, evaluation, records, retrieval, tasks, thresholds
from quillspark.sources import docx, files, html, tree
from quillspark.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx() -> bytes:
    p = lambda inner, style="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{style}{chr(34)}/>' if style else ''}</w:pPr>{inner}</w:p>"
    r = lambda t, pr="": f'<w:r><w:rPr>{pr}</w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>'
    item = lambda t, n: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{n}"/></w:numPr></w:pPr>{r(t)}</w:p>'
    body = (
        p(r("Intro")) + p(r("One"), "H1") + p(r("a ") + r("bold", "<w:b/>") + r(" and", "<w:b/>") + r("x", "<w:i/>") + r("2", '<w:vertAlign w:val="superscript"/>'))
        + p(r("Sub"), "H2") + '<w:p><w:commentRangeStart w:id="7"/>' + r("anchored") + "</w:p><w:p>" + r("more") + '<w:commentRangeEnd w:id="7"/></w:p>'
        + item("i1", 1) + item("i2", 1) + item("j1", 2) + p(r("Two"), "H1") + "<w:tbl><w:tr><w:tc>" + p(r("c1")) + "</w:tc><w:tc>" + p(r("c2", "<w:b/>")) + p(r("c3")) + "</w:tc></w:tr></w:tbl>"
        + p(r("One"), "H1") + p(r("later"))
    )
    styles = '<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style>'
    note = '<w:comment w:id="7" w:author="A" w:date="2020-01-01"><w:p><w:r><w:t>why?</w:t></w:r></w:p></w:comment>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        z.writestr("word/comments.xml", f"<w:comments {W}>{note}</w:comments>")
    return out.getvalue()


PAGE = "<html><body><p>Lead</p><h1>One</h1><p>a <strong>bold</strong> <em>it</em></p><h2>Sub</h2><ul><li>x</li><li><p>y</p></li></ul><table><tr><th>h</th><td>1</td></tr><tr></tr></table><h1>One</h1><p>z</p></body></html>"


@pytest.fixture(scope="module")
def parsed(spark):
    files = [("f/a.docx", bytearray(make_docx())), ("f/b.html", bytearray(PAGE.encode())), ("f/c.txt", bytearray(b"x")), ("f/d.docx", bytearray(b"broken"))]
    df = spark.createDataFrame(files, "path string, content binary")
    return df, docx.blocks(df).persist()


def test_docx_blocks(parsed):
    rows = sorted((r for r in parsed[1].collect() if r["doc_id"] == "f/a.docx" and r["type"] != "style"), key=lambda r: (r["node"], r["block_pos"]))
    assert [(r["h1"], r["h2"], r["type"]) for r in rows] == [(None, None, "paragraph"), ("One", None, "paragraph"), ("One", None, "paragraph"), ("One", "Sub", "paragraph"), ("One", "Sub", "paragraph"), ("One", "Sub", "list"), ("One", "Sub", "list"), ("Two", None, "table")]
    assert rows[1]["text_rich"] == "a <b>bold and</b><i>x</i><sup>2</sup>" and rows[2]["text"] == "later"
    assert [i["text"] for i in rows[5]["items"]] == ["i1", "i2"]
    assert rows[7]["rows"] == [["c1", "c2\nc3"]] and rows[7]["rows_rich"] == [["c1", "<b>c2</b>\nc3"]]


def test_comments(parsed):
    (c,) = docx.comment_rows(parsed[0]).collect()
    assert (c["id"], c["author"], c["text"], c["anchor_heading_path"], c["anchor_text"], c["anchor_context"]) == ("7", "A", "why?", ["One", "Sub"], "anchoredmore", "anchored more")


def test_html_blocks_and_errors(parsed):
    rows = sorted((r for r in parsed[1].collect() if r["doc_id"] == "f/b.html"), key=lambda r: (r["node"], r["block_pos"]))
    assert [(r["h1"], r["h2"], r["type"], r["text"]) for r in rows if r["type"] != "style"] == [(None, None, "paragraph", "Lead"), ("One", None, "paragraph", "a bold it"), ("One", "Sub", "list", None), ("One", "Sub", "paragraph", "y"), ("One", "Sub", "table", None), ("One", None, "paragraph", "z")]
    assert [r["style"] for r in rows if r["type"] == "style"] == [{"bold": ["bold"], "italic": ["it"]}]
    s = docx.batch_summary(parsed[1]).first()
    assert (s["total"], s["parsed"], s["failed"]) == (4, 2, 2)


def test_sections(spark, parsed):
    s = {(r["doc_id"], r["pos"]): (r["section_key"], r["text"]) for r in tree.sections(parsed[1].where("error is null")).collect()}
    assert [s["f/a.docx", k][0] for k in range(6)] == ["a [paragraph 1]", "a > One [paragraph 1]", "a > One [paragraph 2]", "a > One > Sub [paragraph 1]", "a > One > Sub [paragraph 2]", "a > Two [table 1] [row 1]"]
    assert s["f/a.docx", 5][1] == "c1 | <b>c2</b>\nc3" and not any(k[0] == "f/b.html" for k in s)
    h = {r["section_path"]: r["html"] for r in tree.section_html(parsed[1].where("error is null")).collect()}
    assert h["a > Two"] == "<table>\n  <tr><td>c1</td><td><b>c2</b>\nc3</td></tr>\n</table>" and h["a > One"].endswith("</p>\n<p>later</p>")


def test_json_tree(spark):
    text = '{"title": "T", "level": 0, "path": [], "blocks": [{"type": "paragraph", "text_rich": "r\\u00a0x"}], "children": [{"title": "A", "level": 1, "path": ["A"], "blocks": [{"type": "table", "rows_rich": [["a", " "], ["", "b"]]}], "children": [{"title": "B", "level": 2, "path": ["A", "B"], "blocks": [{"type": "paragraph", "text_rich": "q"}]}]}]}'
    t = spark.createDataFrame([("d", text)], "doc_id string, j string").select("doc_id", F.from_json("j", tree.TREE).alias("t")).select("doc_id", "t.*")
    assert [tuple(r) for r in tree.sections(tree.blocks_of_trees(t)).orderBy("pos").collect()] == [("d", 0, "T [paragraph 1]", "r x"), ("d", 1, "T > A [table 1] [row 1]", "a"), ("d", 2, "T > A [table 1] [row 2]", "b"), ("d", 3, "T > A > B [paragraph 1]", "q")]


def test_records(spark):
    body = "word " * 50
    block = lambda page, y, text: ("x/doc.pdf", page, text, [0.0, float(y)], 10.0, False, 10.0)
    rows = [block(p, y, t) for p in (1, 2, 3) for y, t in enumerate((f"Report page {p}", "Top line", f"{p} Part", f"{body}on page {'abc'[p - 1]}", "foot one", "foot two"))]
    rows.append(block(4, 1, body))
    b = spark.createDataFrame(rows, "source_file string, page int, text string, bbox array<double>, font_size double, is_bold boolean, body_font double")
    assert {r["key"] for r in records.repeated_edges(b).collect()} == {"report page", "top line", "foot one", "foot two"}
    merged = records.merge_blocks(b).collect()
    text = sorted((r for r in merged if r["kind"] == "text"), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["page"], r["section_path"]) for r in text] == [("doc::text::00001", 1, ["1 Part"]), ("doc::text::00002", 2, ["2 Part"]), ("doc::text::00003", 3, ["3 Part"]), ("doc::text::00004", 4, ["3 Part"])]
    paths = spark.createDataFrame([r for r in merged if r["kind"] == "page"], merged and "source_file string, doc_id string, page int, raw_text string, section_path array<string>, kind string")
    asked = spark.createDataFrame([("x/doc.pdf", 9), ("x/doc.pdf", 2)], "source_file string, page int")
    assert {r["page"]: r["section_path"] for r in records.section_path_as_of(asked, paths).collect()} == {9: ["3 Part"], 2: ["2 Part"]}


def test_tables_and_overlaps(spark):
    t = spark.createDataFrame([("x/d.pdf", 1, 1, ["S", "Leaf"], [["h", ""], ["a", "b"], ["", ""], ["c"]])], "source_file string, page int, table_no int, section_path array<string>, cells array<array<string>>")
    rows = {r["doc_id"]: r for r in records.table_records(t).collect()}
    assert rows["d::table::001::row::002"]["raw_text"] == "h: c | column_2: " and rows["d::table::001"]["table_title"] == "Leaf" and rows["d::table::001::row::001"]["priority"] == 1.3
    assert rows["d::table::001::row::001"]["text"].split("\n")[:5] == ["Source: x/d.pdf", "Page: 1", "Block type: table_row", "Section path: S > Leaf", "Table title: Leaf"]
    e = spark.createDataFrame([("1. this is the first entry of all 2. and this one is the second entry",), ("1. alone here",)], "t string")
    assert [[tuple(x) for x in r[0]] for r in e.select(records.enumerated(F.col("t"))).collect()] == [[(1, "1. this is the first entry of all"), (2, "2. and this one is the second entry")], []]


def test_split_text():
    text = "\n\n".join(f"Paragraph {k}. " + "some words here. " * 12 for k in range(20))
    parts = records.split_text(text, 300, 50)
    assert all(0 < len(p) <= 300 for p in parts) and "".join(parts).replace(" ", "").count("Paragraph") >= 20
    assert records.split_text("x" * 1000, 300, 0) == ["x" * 300] * 3 + ["x" * 100] and records.split_text("", 10, 2) == []


def test_retrieval(spark):
    corpus = spark.createDataFrame(
        [("c1", "red list threshold b2,", "S1", 1, "text", None, None, None), ("c2", "red fox", "S1", 1, "text", None, None, None), ("c3", "supporting information rows", "Required_and_Recommended_Supporting_Information.pdf", 2, "table", "t1", "Table 1 x", None), ("c4", "other", "S2", 3, "table_row", "t2", "Table 2 y", 4)],
        "chunk_id string, search_text string, source_file string, page int, block_type string, table_id string, table_title string, row_id int",
    ).withColumns({"text": F.col("search_text"), "section_title": F.lit("s"), "priority": F.lit(1.0)})
    asked = spark.createDataFrame([(1, "red red b2,"), (2, "what supporting information is required?")], "query_id int, text string")
    parents = spark.createDataFrame([("Required_and_Recommended_Supporting_Information.pdf", "t1", "Table 1 x", 2, "Content:\nPage 1 a\nx\nPage 2 b", "s")], "source_file string, table_id string, table_title string, page int, text string, section_title string")
    hits = retrieval.bm25(asked, retrieval.index(corpus)).where("query_id = 1").orderBy("sparse_rank").collect()
    assert [h["chunk_id"] for h in hits] == ["c1", "c2"]
    out = retrieval.answer(asked, corpus, parents)
    rows = {(r["query_id"], r["result"]): r for r in out.collect()}
    # c1 and c2 share a place, so one of them is left
    assert [k for k in rows if k[0] == 1] == [(1, 1)] and rows[1, 1]["chunk_id"] == "c1"
    assert rows[2, 1]["chunk_id"] == "c3" and rows[2, 1]["parent_text"].startswith("Content:") and rows[2, 2]["chunk_id"] == "c4" and rows[2, 2]["forced_for_coverage"]
    lines = {r["query_id"]: r["scaffold"] for r in retrieval.scaffold(out).collect()}
    assert lines[1].split("\n")[3] == "- Section: s | Source: S1 | Page: 1 | Evidence: red list threshold b2,"
    assert out.select(retrieval.parent_rows(F.lit("Content:\nPage 1 a\nx\nPage 2 b"))).first()[0] == ["Page 1 a", "Page 2 b"]


def test_thresholds(spark):
    q = spark.createDataFrame([("EOO and AOO for criterion B",), ("what is D2?",), ("criterion A",), ("extinction probability",), ("where is it",), ("number of locations",)], "t string")
    rows = q.select(thresholds.criterion(F.col("t")), thresholds.answer(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["B", "D", "A", "E", None, "B"]
    assert rows[0][1] == f"{thresholds.EOO}\n{thresholds.AOO}" and rows[1][1] == thresholds.D2 and rows[2][1].startswith("Criterion A: Population reduction\n") and rows[4][1] is None


def test_draft(spark):
    s = spark.createDataFrame([(1, 0, "D > Threats [paragraph 1]", "logging of species"), (1, 1, "D > Distribution [paragraph 1]", "<b>Found</b> in forests"), (1, 2, "D > Distribution [paragraph 1]", "<b>Found</b> in forests"), (1, 3, "D [paragraph 1]", " ")], "doc_id long, pos int, section_key string, text string")
    kept = draft.store(s)
    assert kept.count() == 2
    asked = spark.createDataFrame([(1, 1, "What threats are known?"), (2, 1, "where is the forest found"), (3, 1, "the of")], "query_id int, doc_id long, text string")
    hits = {(r["query_id"], r["hit"]): (r["section_path"], r["score"]) for r in draft.retrieve(asked, kept).collect()}
    assert hits[1, 1][0] == "D > Threats" and hits[2, 1][0] == "D > Distribution" and hits[3, 1] == ("D > Threats", 0.0)


def test_tasks(spark):
    rules = spark.createDataFrame([("a", "full_document"), ("b", "relevant_sections: Red List Assessment"), ("c", "section_type:*")], "name string, scope string")
    parts = spark.createDataFrame([("d", 0, "Redlist Assessment"), ("d", 1, "Other")], "doc_id string, pos int, title string")
    plan = tasks.plan(rules, parts)
    assert {(r["rule_name"], r["task"]): r["section_paths"] for r in plan.collect()} == {("a", 0): ["Redlist Assessment", "Other"], ("b", 0): ["Redlist Assessment"], ("c", 0): ["Redlist Assessment"], ("c", 1): ["Other"]}

    def model(prompt):
        if "Other" in prompt:
            raise RuntimeError("busy")
        return '```json\n[{"section_path": ["A", "B"], "issue": "i", "severity": "low", "suggestion": "s"}]\n```'

    done = tasks.run(plan.withColumn("prompt", F.array_join("section_paths", ",")), model)
    s = tasks.summarize(done).first()
    assert (s["rules_attempted"], s["rules_succeeded"], s["rules_failed"], s["total_findings"], s["token_estimation_used"]) == (4, 2, 2, 2, True)
    assert done.where("rule_name = 'b'").first()["findings"][0]["section_path"] == "A > B"
    with pytest.raises(Exception, match="Unknown scope"):
        tasks.plan(spark.createDataFrame([("x", "nothing")], "name string, scope string"), parts).collect()


def test_evaluation(spark):
    a = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c x")], "doc_id long, text string")
    r = evaluation.overlap(a, b).first()
    assert (round(r["precision"], 6), round(r["recall"], 6), round(r["f1"], 6)) == (0.666667, 0.666667, 0.666667)
    one = spark.range(1).select(
        evaluation.recall(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), evaluation.ordered_accuracy(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("b"))),
        evaluation.cell_accuracy(F.array(F.array(F.lit("a"), F.lit("b"))), F.array(F.array(F.lit("a")))),
    ).first()
    assert tuple(one) == (0.5, 0.5, 0.5)


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 5}:00:00", k % 2, "a", 1.0) for k in range(10)]
    e = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(f"{tmp_path}/in")
    s = events.read(spark, f"{tmp_path}/in", e.schema)
    q = events.tumbling(s).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, events.tumbling(e).collect()))
    assert events.sessions(e).count() == 10
    done = events.review_each(s, lambda b: b.groupBy("event_type").count(), f"{tmp_path}/out", f"{tmp_path}/check")
    done.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").first()["count"] == 10


def test_files(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "r.jsonl").write_text('{"doc_id": "a", "text": "x", "section_path": ["A", "B"], "priority": null}\n\n{"text": "y"}\n{"text": " "}\n')
    rows = {r["text"]: r for r in files.read_records(spark, f"{tmp_path}/*/r.jsonl").collect()}
    assert set(rows) == {"x", "y"} and rows["y"]["doc_id"] == "p1::line::00003" and rows["y"]["priority"] == 1.0 and rows["x"]["section_path"] == ["A", "B"]
    (tmp_path / "p2").mkdir()
    (tmp_path / "p2" / "r.jsonl").write_text('{"text": "z"}\n\n{"text": \n')
    with pytest.raises(Exception, match="Malformed record: .*p2/r.jsonl, line 3"):
        files.read_records(spark, f"{tmp_path}/*/r.jsonl").collect()
    with pytest.raises(Exception, match="No retrieval records|PATH_NOT_FOUND"):
        files.load_records(spark, str(tmp_path))
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "r1.md").write_text("---\nscope: full_document\nseverity: 'high'\ncategory: c\n---\nBody here\n")
    assert tuple(files.read_rules(spark, f"{tmp_path}/rules").first()) == ("r1", "full_document", "high", "c", "Body here")
    (tmp_path / "rules" / "r2.md").write_text("---\nscope: x\n---\nB")
    with pytest.raises(Exception, match="missing front matter"):
        files.read_rules(spark, f"{tmp_path}/rules").collect()


def test_supporting_rows_and_prompts(spark):
    entry = "Required supporting information {} 1. first entry that is long enough 2. second entry that is long enough"
    pages = spark.createDataFrame([("r.pdf", 1, entry.format("Table 1")), ("r.pdf", 2, "3. third entry goes on here too 4. fourth entry goes on as well"), ("r.pdf", 3, entry.format("Table 2"))], "source_file string, page int, text string")
    rows = records.supporting_rows(pages).orderBy("table_id", "row_id").collect()
    assert [(r["table_id"], r["row_id"], r["page"]) for r in rows] == [("table_1", None, 1), ("table_1", 1, 1), ("table_1", 2, 1), ("table_1", 3, 2), ("table_1", 4, 2), ("table_2", None, 3), ("table_2", 1, 3), ("table_2", 2, 3)]
    assert rows[0]["raw_text"].split("\n")[2] == "Page 1 | Entry 1: 1. first entry that is long enough" and rows[3]["metadata"]["entry_number"] == 3
    schema = "query_id int, result int, source_file string, page int, block_type string, section_title string, table_title string, text string, parent_text string"
    found = spark.createDataFrame([(1, 1, "s", 2, "table", "t", "Table 1: x", "Content:\nPage 1 a", None), (1, 2, "s", 3, "table_row", "t", "Table 2: y", "row two", "Content:\nPage 9 z"), (2, 1, "s", 1, "text", "t", None, "plain", None)], schema)
    asked = spark.createDataFrame([(1, "what extra supporting info is required?"), (2, "EOO threshold?"), (3, "nothing")], "query_id int, text string")
    p = {r["query_id"]: r["prompt"] for r in answers.prompts(asked, found).collect()}
    assert p[1].index(answers.FOR_SOME + "\n- row two") < p[1].index(answers.FOR_ALL + "\n- Page 1 a") and "  Parent context: Content:" in p[1]
    assert thresholds.EOO in p[2] and "| Evidence: plain" in p[2] and "No reference scaffold available." in p[3] and "No draft has been uploaded" in p[3]


def test_command_line(spark, tmp_path):
    """parse, index and ask, from files to files."""
    import json

    from quillspark import __main__ as cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>A</h1><p>Some text.</p>")
    (tmp_path / "in" / "b.docx").write_bytes(b"no zip")
    told = cli.parse(spark, f"{tmp_path}/in", f"{tmp_path}/parsed")
    assert (told["total"], told["parsed"], told["failed"]) == (2, 1, 1) and told["errors"][0]["file"].endswith("b.docx")
    assert spark.read.json(f"{tmp_path}/parsed/documents").where("doc_title = 'a'").count() > 0
    doc = tmp_path / "records" / "d1"
    doc.mkdir(parents=True)
    lines = [{"doc_id": f"r{k}", "source_file": "s.pdf", "page": k, "block_type": "text", "text": f"Source: s\nContent:\n{t}", "raw_text": t, "section_path": ["A"]} for k, t in enumerate(("locations of wolves", "the range of bears", "wolves and bears"))]
    lines.append({"doc_id": "r9", "source_file": "s.pdf", "page": 1, "block_type": "table_row", "text": "Content:\nrow", "metadata": {"fallback": True}})
    (doc / "retrieval_blocks.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    told = cli.build(spark, f"{tmp_path}/records", f"{tmp_path}/index", 800, 100)
    assert (told["raw_record_count"], told["table_row_count"], told["fallback_table_row_count"], told["chunk_size"]) == (4, 1, 1, 800)
    with pytest.raises(FileExistsError):
        cli.build(spark, f"{tmp_path}/records", f"{tmp_path}/index", 800, 100)
    found = cli.ask(spark, f"{tmp_path}/index", ["Where are bears?"], 2)
    assert found and {r["chunk_id"].split("::")[0] for r in found} <= {"r1", "r2"}
    assert cli.arguments(["index", "a", "b", "--chunk-size", "5"]).chunk_size == 5


def test_embed(spark):
    from quillspark.operators import retrieval

    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in retrieval.embed(rows, "id", "text", lambda: lambda ts: [[t.count("a"), t.count("b")] for t in ts]).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.0, 0.0]}
