"""Rules that SQL oracles do not reach: scalar models, quirks, parsers, increments and order independence."""

import difflib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import chunking, fusion, governance, graph, traversal
from graphloom.sources import parsers
from graphloom.streaming.incremental import ingest


def norm(s):
    return re.sub(r"\s+", "", s.lower())


def grams(s):
    s = norm(s)
    return set() if not s else {s} if len(s) < 2 else {s[i : i + 2] for i in range(len(s) - 1)}


def tokens(s):
    out = set()
    for run in re.findall(r"[a-z0-9]+|[一-鿿]+", norm(s)):
        out |= set(run) if re.fullmatch(r"[一-鿿]{1,4}", run) else {run}
    return out


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def name_model(q, c):
    a, b = norm(q), norm(c)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = a[:64], b[:64]
    s = 0.30 * difflib.SequenceMatcher(None, a, b).ratio() + 0.25 * jac(grams(q), grams(c)) + 0.20 * jac(tokens(q), tokens(c)) + 0.15 * (1 - lev(x, y) / max(len(x), len(y)))
    return max(s, 0.88) if len(a) >= 2 and (a in b or b in a) else s


WORDS = ["", " ", "a", "B", "ab", "a b", "知识", "知识图谱", "知识图谱库", "知 x1", "café", "Supplier#1", "supplier #12", "x" * 70, "x" * 70 + "y", "abc" * 80]


def test_scalar_functions_match_python_models(spark):
    rng = random.Random(3)
    names = WORDS + ["".join(rng.choice("ab 知识1") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "q string, c string")
    got = df.select("q", "c", fn.name_similarity(F.col("q"), F.col("c")).alias("s"), fn.keyword_tokens(F.col("q")).alias("t"), fn.ngrams(F.col("q")).alias("g")).collect()
    for r in got:
        assert set(r.t) == tokens(r.q) and set(r.g) == grams(r.q)
        assert r.s == pytest.approx(name_model(r.q, r.c), abs=1e-9), (r.q, r.c)


def test_blocking_loses_no_pair(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcx") for _ in range(rng.randint(1, 7))) for _ in range(70)} | {"a", "b"})
    df = spark.createDataFrame([("T", n) for n in names], "entity_type string, name string")
    found = {(r.a, r.b) for r in fusion.name_pairs(df, 0.82).collect()}
    assert found == {(a, b) for a in names for b in names if a < b and round(name_model(a, b), 9) >= 0.82}


def test_clean_headings_json_masks(spark):
    df = spark.createDataFrame([(" a  \n\n\n\n b　\n\n",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(fn.clean(F.col("t"))).collect()] == ["a\n\nb", "", "x"]
    lines = ["# A", "### B c", "1.2 Title", "1.2.3.4.5.6.7.8 Deep", "一、概述", "第三章 方法", "plain", "####### seven"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(fn.heading_level(F.col("t"))).collect()] == [chunking.heading_level(x) for x in lines] == [1, 3, 2, 6, 2, 1, 0, 0]
    df = spark.createDataFrame([("abcdefghij",), ("short",)], "t string")
    assert [r[0] for r in df.select(fn.mask_secret(F.col("t"))).collect()] == ["abcd**ghij", "*****"]


def test_chunkers():
    text = "alpha beta.\n\ngamma\n\n" + "z" * 25
    assert chunking._fixed(text, 20, 5) == ["alpha beta.\n\ngamma", "z" * 20, "z" * 10]
    assert all(len(c) <= 20 for c in chunking._recursive("one two three. four five six seven. " * 4, 20, 5))
    assert "".join(chunking._recursive("a b c", 20, 5)) == "a b c" and chunking._recursive("  ", 20, 5) == []
    doc = "intro\n# One\nx\n## A\ny\n# Two\n## B\nz"
    assert chunking._hierarchical(doc, 2) == [("One\n## A\ny", ["One", "A"]), ("Two\n## B\nz", ["Two", "B"])]
    assert [p for _, p in chunking._hierarchical(doc, 4)] == [["One"], ["Two"]]
    with pytest.raises(ValueError):
        chunking._check(10, 10)


def test_gate_and_upsert_do_not_depend_on_partitions(spark):
    from graphloom.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    nodes, edges, rules = fx.draft_nodes(spark, sf), fx.draft_edges(spark, sf), fx.ontology(spark)
    one = graph.gate(nodes, edges, *rules, require_evidence=True)[1].select("seq", "violation")
    two = graph.gate(nodes.repartition(7), edges.repartition(5, "seq"), *rules, require_evidence=True)[1].select("seq", "violation")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    merged = graph.upsert_nodes(nodes)
    again = graph.upsert_nodes(merged.unionByName(nodes).repartition(3))
    assert sorted(map(str, merged.select("id", "source_chunk_ids").collect())) == sorted(map(str, again.select("id", "source_chunk_ids").collect()))


def test_empty_schema_rejects_at_extraction_and_accepts_at_the_gate(spark):
    none = spark.createDataFrame([], "name string")
    rows = spark.createDataFrame([("n", "T")], "name string, entity_type string")
    assert fusion.validate_entities(rows, none).first().reason == "entity_type_not_in_schema"
    nodes = spark.createDataFrame([("1", "n", "T", [], [], 1)], "id string, name string, entity_type string, source_chunk_ids array<string>, evidence_quotes array<struct<chunk_id:string,quote:string,verified:boolean>>, seq bigint")
    edges = spark.createDataFrame([], "id string, source_id string, target_id string, relation_type string, seq bigint, source_chunk_ids array<string>, evidence_quotes array<struct<chunk_id:string,quote:string,verified:boolean>>")
    free = spark.createDataFrame([], "name string, source_types array<string>, target_types array<string>")
    assert graph.gate(nodes, edges, none, free)[0].first().violation is None


def test_evidence_merge_keeps_eight_distinct_non_empty(spark):
    quotes = [("c", f"q{i % 10}", True) for i in range(20)] + [("c", "", True)]
    rows = [("n", "T", i, ["c"], [q]) for i, q in enumerate(quotes)]
    df = spark.createDataFrame(rows, "name string, entity_type string, seq bigint, source_chunk_ids array<string>, evidence_quotes array<struct<chunk_id:string,quote:string,verified:boolean>>")
    assert [q.quote for q in graph.upsert_nodes(df).first().evidence_quotes] == [f"q{i}" for i in range(8)]


def test_corrections_cascade(spark):
    entities = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "T")], "name string, entity_type string")
    relations = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "s")], "source_name string, target_name string, relation_type string")
    fixes = spark.createDataFrame([("entity", "remove", "a", None), ("entity", "modify", "b", "U")], "kind string, action string, target_name string, new_value string")
    left, rest = fusion.apply_corrections(entities, relations, fixes)
    assert {tuple(r) for r in left.collect()} == {("b", "U"), ("c", "T")} and [tuple(r) for r in rest.collect()] == [("b", "c", "r")]


def test_vector_pairs_are_exact(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    vectors = [[x + rng.gauss(0, 0.25) for x in rng.choice(base)] for _ in range(80)]
    df = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(vectors)], "group int, id int, embedding array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if i % 2 == j % 2 and cos(vectors[i], vectors[j]) >= 0.8}
    assert {(r.a, r.b) for r in fusion.vector_pairs(df).collect()} == want


def test_directed_bfs_keeps_a_branch_on_its_side(spark):
    edges = spark.createDataFrame([("s", "d1", "r", 1), ("d1", "d2", "r", 2), ("x", "d1", "r", 3), ("u1", "s", "r", 4), ("u1", "y", "r", 5)], "source_id string, target_id string, relation_type string, seq bigint")
    seeds = spark.createDataFrame([("s",)], "id string")
    walked = {(r.source_id, r.target_id) for r in traversal.fan_out_bfs(edges, seeds, 2, directed=True).collect()}
    assert walked == {("s", "d1"), ("d1", "d2"), ("u1", "s")}


def test_modularity_splits_two_cliques(spark):
    clique = lambda names: [(a, b) for a in names for b in names if a < b]
    pairs = clique("abcd") + clique("wxyz") + [("d", "w")] + [("hub", f"leaf{i}") for i in range(30)]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    nodes = spark.createDataFrame([(n,) for n in sorted({n for p in pairs for n in p} | {"alone"})], "id string")
    found = {}
    for r in traversal.communities(nodes, edges).collect():
        found.setdefault(r.community_id, set()).add(r.id)
    star = {"hub", *(f"leaf{i}" for i in range(30))}
    assert found[1] == star and sorted(map(sorted, (found[2], found[3]))) == [list("abcd"), list("wxyz")] and len(found) == 3


def test_plans_round_trip_and_report_problems():
    options = {"disambiguate": True, "cross_chunk": False, "self_correct": True, "induce": False, "post_correct": False}
    plan = governance.compile_plan(options)
    assert governance.parse_plan(plan) == options and governance.plan_problems(plan) == []
    plan[0].depends_on.append(plan[-1].id)
    assert "cycle" in governance.plan_problems(plan)[0]


def test_parsers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    book = io.BytesIO()
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>k</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>')
    files = {"a.txt": b"x  \n\n\n\ny", "b.md": b"# T\n\n**bold** [l](u)\n", "c.csv": "甲,乙\n,\n1,\n".encode("gb18030"), "d.docx": doc.getvalue(), "e.xlsx": book.getvalue(), "f.bin": b"?", "g.docx": b"broken"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in parsers.parse_files(spark, str(tmp_path)).collect()}
    assert {k: got[k].text for k in ("a.txt", "b.md", "c.csv", "d.docx", "e.xlsx")} == {"a.txt": "x\n\ny", "b.md": "# T\nbold l", "c.csv": "甲 | 乙\n1 |", "d.docx": "## Head\nBody\na | b", "e.xlsx": "k | 2"}
    assert got["f.bin"].error and got["g.docx"].error and got["g.docx"].text is None


def test_incremental_ingest_takes_each_content_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    put = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
    seen = lambda: sorted(r.text for r in spark.read.option("recursiveFileLookup", True).parquet(target).collect())
    put([(1, "a"), (2, "b"), (3, "a")])
    ingest(spark, source, "doc_id bigint, text string", target, checkpoint)
    assert seen() == ["a", "b"]
    put([(4, "b"), (5, "c")])
    ingest(spark, source, "doc_id bigint, text string", target, checkpoint)
    assert seen() == ["a", "b", "c"]
