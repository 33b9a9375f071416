"""Decisions, groundings and folds on hand-made rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom import cli, queries
from factloom.functions import context, names, numbers
from factloom.operators import audit, compare, entities, extract, layout
from factloom.plans import pipeline
from factloom.sources import documents
from factloom.schemas import BLOCKS, CELLS, FACTS


def passages(spark, *texts):
    rows = [(f"p{i}", f"d{i % 2}", 0, i, "body", t, 100, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, document_id string, page_index int, reading_order int, role string, text string, char_start int, subject_id string")


def facts_of(spark, *texts):
    return extract.numeric_facts(passages(spark, *texts))


def verdict(spark, left, right):
    facts, _ = facts_of(spark, left, right)
    return [r["relation_type"] for r in compare.relations(compare.pairs(facts)).collect()]


LINE = "The revenue on {scope}basis for {fy} stood at {v}."


@pytest.mark.parametrize(("left", "right", "expected"), [
    (LINE.format(scope="consolidated ", fy="FY24", v="₹ 81,415.38 million"), LINE.format(scope="consolidated ", fy="FY24", v="₹8,142 crore"), "corroborates"),
    (LINE.format(scope="consolidated ", fy="FY24", v="₹100 crore"), LINE.format(scope="consolidated ", fy="FY24", v="₹120 crore"), "contradicts"),
    (LINE.format(scope="consolidated ", fy="FY24", v="₹100 crore"), LINE.format(scope="standalone ", fy="FY24", v="₹120 crore"), "reconciled_by_scope"),
    (LINE.format(scope="consolidated ", fy="FY24", v="₹100 crore"), LINE.format(scope="consolidated ", fy="FY23", v="₹120 crore"), "reconciled_by_period"),
    (LINE.format(scope="consolidated ", fy="FY24", v="₹100 crore"), LINE.format(scope="standalone ", fy="FY23", v="₹120 crore"), "incomparable"),
    (LINE.format(scope="consolidated ", fy="FY24", v="₹100 crore"), "The revenue for FY24 stood at ₹120 crore.", "needs_review"),
])
def test_decisions(spark, left, right, expected):
    assert verdict(spark, left, right) == [expected]


def test_prose_and_unlabelled(spark):
    facts, lost = facts_of(spark, "The revenue from operations on consolidated basis for\nFY24 stood at ₹ 81,415.38 million as against ₹72,253.01 million for FY23.", "Approximately ₹100 crore.", "Annual Report 2024\nPage 47\n5\n(1)", "Revenue increased by 12.7% during FY24.")
    got = {r["quote"]: r for r in facts.collect()}
    assert got["₹ 81,415.38 million"]["predicate_key"] == "revenue_from_operations"
    assert float(got["₹ 81,415.38 million"]["value"]["number"]) == 81415380000
    assert got["12.7%"]["predicate_key"] == "revenue_percentage_change"
    # "as against" finds no label either: the words before "stood at" end in a number
    assert sorted((r["passage_id"], r["reason"]) for r in lost.collect()) == [(p, "no label was found for the number") for p in ("p0", "p1")]


def test_unicode_boundaries(spark):
    df = spark.createDataFrame([("é12,5 und 13,500 %",)], "t string")
    assert [s["text"] for s in df.select(extract.spans(F.col("t"), extract.CANDIDATE).alias("s")).first()["s"]][-1] == "13,500 %"


def test_strict_tolerance(spark):
    df = spark.createDataFrame([("₹100 crore", "₹101 crore")], "a string, b string").withColumns({"x": numbers.number(F.col("a")), "y": numbers.number(F.col("b"))})
    assert df.select(numbers.compare(F.col("x"), F.col("y")).alias("c")).first()["c"]["agrees"] is False


def test_context(spark):
    df = spark.createDataFrame([("Audited consolidated actual results for India for FY 2023-24",), ("Standalone and consolidated actual and forecast values for FY24",), ("Revenue increased significantly",)], "t string")
    a, b, c = (r["c"] for r in df.select(context.context(F.col("t")).alias("c")).collect())
    assert (a["scope"], a["basis"], a["geography"], a["confidence"]) == ("consolidated", "audited; actual", "India", 0.95)
    assert b["confidence"] == 0.65 and {"ambiguous_scope", "ambiguous_value_status"} <= set(b["warnings"])
    assert c["confidence"] == 0.45 and c["warnings"] == ["missing_context"]


def test_status_records(spark):
    df = passages(spark, "Mr. Suvir Suren Sujan, Non-Executive Director (DIN: 01173669), resigned from the Board with effect from August 24, 2023.", "Delhivery Limited (CIN: U63090DL2011PLC221234)")
    a, b = extract.identifier_records(df).orderBy("scheme", ascending=False).collect()
    assert (a["name"], a["status"], str(a["as_of"])) == ("Suvir Suren Sujan", "resigned", "2023-08-24")
    assert (b["name"], b["identifier"]) == ("Delhivery Limited", "U63090DL2011PLC221234")


def test_record_over_a_page_break(spark):
    rows = [(0, 0, "Mr. First Person (DIN: 00000001)"), (0, 1, "Ms. Second Person, address: Mumbai"), (1, 0, "Occupation: Service"), (1, 1, "DIN: 00000002, since 2020. DIN: 00000003"), (2, 0, "DIN: 00000004")]
    df = spark.createDataFrame([(f"p{p}{k}", "d", p, k, "body", t, 0, "s") for p, k, t in rows], "id string, document_id string, page_index int, reading_order int, role string, text string, char_start int, subject_id string")
    assert {r["identifier"]: r["name"] for r in extract.identifier_records(df).collect()} == {"00000001": "First Person", "00000002": "Second Person", "00000003": None, "00000004": None}


def test_table_numbers_are_no_prose_facts(spark):
    block = lambda k, y, t: ("d", 0, 600.0, 800.0, k, 50.0, float(y), 300.0, y + 20.0, t)
    line = LINE.format(scope="consolidated ", fy="FY24", v="{}")
    df = spark.createDataFrame([block(0, 200, line.format("₹100 crore")), block(1, 400, line.format("₹200 crore"))], BLOCKS)
    placed = layout.placed(df).withColumn("subject_id", F.lit("s"))
    tables = spark.createDataFrame([("d", 0, 40.0, 390.0, 400.0, 500.0), ("d", 1, 0.0, 0.0, 600.0, 800.0), ("d", 0, 40.0, 212.0, 400.0, 300.0)], "document_id string, page_index int, x0 double, y0 double, x1 double, y1 double")
    assert [r["quote"] for r in pipeline.run(placed, tables=tables).facts.collect()] == ["₹100 crore"]
    assert pipeline.run(placed).facts.count() == 2


def test_tables(spark):
    cells = spark.createDataFrame([("d", 0, 0, r, c, t) for r, row in enumerate([["₹ Cr", "FY23", "FY24"], ["Revenue from customers", "7,225", "8,142"], ["Margin", "18.4%", "x"]]) for c, t in enumerate(row)], CELLS)
    got = {r["raw"]: r for r in extract.table_facts(cells).collect()}
    assert float(got["8,142"]["value"]["number"]) == 81420000000 and got["8,142"]["predicate_key"] == "revenue_from_operations"
    assert got["18.4%"]["value"]["unit"] == "percent" and got["18.4%"]["warnings"] == []


def test_entities(spark):
    catalogue = spark.createDataFrame([("imf", "International Monetary Fund", "company", {}, []), ("p", "Suvir Sujan", "person", {"din": "01173669"}, []), ("b1", "Sahil Barua", "person", {}, []), ("b2", "Sahil Baruah", "person", {}, [])], "id string, canonical_name string, entity_type string, identifiers map<string,string>, aliases array<string>")
    mentions = spark.createDataFrame([("1", "International Monetary Funds", "company", {}), ("2", "Mr. S. Sujan", "person", {"DIN": "0117 3669"}), ("3", "Sahil Baru", "person", {}), ("4", "Somebody New", "person", {}), ("5", "Suvir Sujan", "person", {"din": "99999999"})], "id string, name string, entity_type string, identifiers map<string,string>")
    got = {r["id"]: r["method"] for r in entities.resolve(mentions, catalogue).collect()}
    assert got == {"1": "fuzzy_name", "2": "identifier", "3": "needs_review", "4": "new_entity", "5": "conflict"}
    assert round(entities.similarity("international monetary fund", "international monetary funds"), 2) == 98.18


def test_similar_names_equal_brute_force(spark):
    rng = random.Random(8)
    names_c = sorted({" ".join("".join(rng.choices("abcdeor", k=rng.randint(2, 9))) for _ in range(rng.randint(1, 3))) for _ in range(60)} | {"alphabet holdings of rome", "alphabet holdings of romo"})
    cut = lambda n, k: n[:k] + rng.choice(["", "x", n[k] + "e"]) + n[k + 1 :]
    mentions = {str(i): n for i, n in enumerate({cut(n, rng.randrange(len(n))) for n in names_c for _ in range(3)} | {"alphabet holdings of romeo"})}
    key = lambda n: spark.createDataFrame([(x,) for x in n], "n string").select(names.name_key(F.col("n"))).collect()
    keys_m, keys_c = ([r[0] for r in key(n)] for n in (mentions.values(), names_c))
    want = {}
    for i, k in zip(mentions, keys_m, strict=True):
        scores = sorted((entities.similarity(k, c) for c in keys_c if len(k) >= 5), reverse=True)
        best, second = [*(s for s in scores if s >= entities.REVIEW), 0.0, 0.0][:2]
        exact = keys_c.count(k)
        want[i] = "needs_review" if exact > 1 else "exact_name" if exact else "fuzzy_name" if best >= entities.MERGE and best - second >= entities.MARGIN else "needs_review" if best else "new_entity"
    df = spark.createDataFrame([(i, n, "company", {}) for i, n in mentions.items()], "id string, name string, entity_type string, identifiers map<string,string>")
    catalogue = spark.createDataFrame([(n, n, "company", {}, []) for n in names_c], "id string, canonical_name string, entity_type string, identifiers map<string,string>, aliases array<string>")
    assert {r["id"]: r["method"] for r in entities.resolve(df, catalogue).collect()} == want
    assert {"fuzzy_name", "needs_review", "new_entity"} <= set(want.values())


def test_layout(spark):
    page = lambda p, k, x0, y0, x1, y1, t: ("d", p, 600.0, 800.0, k, float(x0), float(y0), float(x1), float(y1), t)
    blocks = [page(p, 0, 50, 30, 300, 40, "Annual Report") for p in range(3)] + [page(p, 9, 50, 780, 90, 790, f"Page {p}") for p in range(3)]
    blocks += [page(p, 1 + k, x, y, x + 200, y + 20, f"{side} {k} of the body text") for p in range(2) for k, (side, x, y) in enumerate([("right", 340, 100), ("left", 50, 100), ("left", 50, 400), ("right", 340, 400)])]
    df = spark.createDataFrame(blocks, BLOCKS)
    got = layout.passages(df)
    order = [r["text"].split()[0] for r in got.where("page_index = 0 and role = 'body'").orderBy("reading_order").collect()]
    assert order == ["left", "left", "right", "right"]
    assert [r["page_index"] for r in layout.ocr_needed(df, got).collect()] == [2]
    assert {r["role"] for r in got.where("page_index = 2").collect()} == {"header", "footer"}
    assert all(len(t) <= 120 for _, t in layout.split_text("This is one sentence of text. " * 30, 120))


def test_passage_layout_equals_brute_force(spark, tmp_path):
    docs = [(1, "\n".join(f"Line {chr(97 + i)} of one" for i in range(19))), (2, "Only line"), (3, None), (4, "\n\n")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, text in docs:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        for p in range(0, len(lines), 8):
            heading, *rest = lines[p : p + 8]
            parts = [("body", heading)]
            for column in (rest[::2], rest[1::2]):  # the left one whole, then the right one; blocks that touch are one
                parts += [("body", "\n".join(column[i : i + 2])) for i in range(0, len(column), 2)]
            edges = [("header", "Annual Report")], [("footer", f"Page {p // 8 + 1}")]
            if len(lines) <= 8:  # on one page only: no furniture, and as narrow blocks at the edges in the columns' order
                edges = [("body", "Annual Report")], [("body", f"Page {p // 8 + 1}")]
            parts = edges[0] + parts + edges[1]
            digest = hashlib.sha256("\n\n".join(f"{r}:{t}" for r, t in parts).encode()).hexdigest()
            want[str(d), p // 8] = (len(parts), *(sum(r == k for r, _ in parts) for k in ("header", "footer")), sum(len(t) for _, t in parts), digest)
    got = {(r["document_id"], r["page_index"]): tuple(r)[2:] for r in queries.passage_layout(spark, tmp_path).collect()}
    assert got == want and len(got) == 4


def test_incremental_equals_full(spark):
    facts, _ = facts_of(spark, *(LINE.format(scope="consolidated ", fy=fy, v=v) for fy, v in (("FY24", "₹100 crore"), ("FY24", "₹100 crore"), ("FY23", "₹90 crore"), ("FY24", "₹120 crore"))))
    facts = spark.createDataFrame(facts.collect(), FACTS.replace("number:", "number:"))
    full = {(r["fact_a_id"], r["fact_b_id"], r["relation_type"]) for r in compare.relations(compare.pairs(facts)).collect()}
    old, new = facts.where("passage_id in ('p0', 'p1')"), facts.where("passage_id not in ('p0', 'p1')")
    parts = {(r["fact_a_id"], r["fact_b_id"], r["relation_type"]) for df in (compare.pairs(old), compare.pairs(old, new=new)) for r in compare.relations(df).collect()}
    assert parts == full and len(full) == 6


def test_names(spark):
    df = spark.createDataFrame([("Delhivery Pvt. Ltd.",), ("  Dr. Émile  Zölà, ",)], "n string")
    assert [r[0] for r in df.select(names.name_key(F.col("n"))).collect()] == ["delhivery", "emile zola"]


def test_repeated_furniture_finds_lines_at_any_place(spark, tmp_path):
    rows = [(1, "a", "First one\nbody\nPage 1 of 9"), (2, "a", "Another\n\nPage 22 of 9"), (3, "b", "First one\nbody"), (4, "a", "body\nbody\n"), (5, "a", None)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(queries.repeated_furniture(spark, tmp_path).collect()) == [("a", "body", 2), ("a", "page # of", 2)]


def test_label_after_a_colon(spark):
    facts, lost = facts_of(spark, "Segment: Revenue ₹5 crore for FY24.", "Revenue: ₹5 crore", "Our total revenue (1) was ₹10 crore during FY24.", "The profit on a consolidated basis for Q1 FY24 grew by 2.5%.")
    got = {r["passage_id"]: (r["predicate_key"], r["extraction_confidence"]) for r in facts.collect()}
    assert got == {"p0": ("revenue", 0.72), "p2": ("revenue_from_operations", 0.92), "p3": ("profit_percentage_change", 0.9)}
    assert [r["passage_id"] for r in lost.collect()] == ["p1"]


def test_clean_labels(spark):
    cases = {"The Revenue (a+b)": "Revenue", "and the total income on a consolidated basis": "total income", "profit for Q1 FY24 of all": "profit", "growth of": None, "values": None, "for FY": None, "whatever our net debt*": "net debt", "a": None, "x" * 121: None, "EBITDA (margin)": "EBITDA (margin)"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", extract.clean_label(F.col("t"))).collect()} == cases


def test_the_latest_break_splits():
    text = "a" * 70 + "\n\n" + "b" * 15 + " " + "c" * 60
    assert layout.split_text(text, 100) == [(0, text[:87]), (88, text[88:])]
    assert layout.split_text("x" * 80 + ". " + "y" * 60, 100)[0] == (0, "x" * 80 + ".")


def test_a_company_cited_later_is_not_reported_on(spark):
    rows = [("d", 0, "Foo Limited"), ("d", 1, "of Foo Limited, CIN: U63090DL2011PLC221234"), *(("d", k, "Bar Limited") for k in range(3, 7)), ("e", 0, "growth in India"), ("e", 1, "data of Census India Private Limited"), ("f", 0, None)]
    got = {r["document_id"]: (r["name"], r["entity_type"], r["id"]) for r in extract.reporting_entity(spark.createDataFrame(rows, "document_id string, page_index int, text string")).collect()}
    assert got == {"d": ("Foo Limited", "company", "cin:U63090DL2011PLC221234"), "e": ("India", "place", "place:india"), "f": (None, None, None)}


def test_a_scheme_written_twice(spark):
    catalogue = spark.createDataFrame([("p", "First Person", "person", {"din": "00000001"}, [])], "id string, canonical_name string, entity_type string, identifiers map<string,string>, aliases array<string>")
    mentions = spark.createDataFrame([("1", "First Person", "person", {"DIN": "1", "din": "00000001", "lei": "a"}), ("2", "First Person", "person", {"din": "1", "LEI": "b"})], "id string, name string, entity_type string, identifiers map<string,string>")
    row = entities.merged(catalogue, entities.resolve(mentions, catalogue)).where("id = 'p'").first()
    assert row["identifiers"] == {"din": "00000001", "lei": "A"}


def test_evidence_keeps_every_place(spark):
    facts, _ = facts_of(spark, LINE.format(scope="consolidated ", fy="FY24", v="₹100 crore"), "-", LINE.format(scope="consolidated ", fy="FY24", v="₹100 crore"))
    facts = spark.createDataFrame(facts.collect(), FACTS)
    old, new = facts.where("passage_id = 'p0'"), facts.where("passage_id = 'p2'")
    assert documents.store_facts(old, new).count() == 1
    assert {(r["fact_id"], r["passage_id"]) for r in documents.evidence(old, new).collect()} == {(old.first()["id"], p) for p in ("p0", "p2")}


def test_cells_become_facts_with_evidence(spark):
    grid = [["₹ Cr", "FY23", "FY24"], ["Revenue from customers", "7,225", "8,142"], ["Costs", "99", "1,000"]]
    cells = spark.createDataFrame([("d0", 0, 0, r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)], CELLS)
    held = passages(spark, "₹ Cr FY23 FY24 Revenue from customers 7,225 8,142 Costs 99")
    facts, lost = extract.cell_facts(cells, held)
    text = held.first()["text"]
    for r in facts.collect():
        assert text[r["quote_start"] - 100 : r["quote_end"] - 100] == r["quote"] and r["subject_id"] == "s"
    assert {r["quote"] for r in facts.collect()} == {"7,225", "8,142", "99"} and lost.count() == 1
    assert spark.createDataFrame(facts.collect(), FACTS).schema == spark.createDataFrame([], FACTS).schema


def test_command_line_links_tables(spark, tmp_path):
    text = "₹ Cr FY23 FY24 Revenue 7,225 8,142"
    spark.createDataFrame([(f"p{i}", f"d{i}", 0, 0, "body", text, 0, "s", 0.0, 0.0, 10.0, 10.0) for i in range(2)], "id string, document_id string, page_index int, reading_order int, role string, text string, char_start int, subject_id string, x0 double, y0 double, x1 double, y1 double").write.parquet(f"{tmp_path}/passages")
    grid = [["₹ Cr", "FY23", "FY24"], ["Revenue", "7,225", "8,142"]]
    spark.createDataFrame([(f"d{i}", 0, 0, r, c, grid[r][c]) for i in range(2) for r in range(2) for c in range(3)], CELLS).write.parquet(f"{tmp_path}/cells")
    spark.createDataFrame([(f"d{i}", 0, 0.0, 0.0, 10.0, 10.0) for i in range(2)], "document_id string, page_index int, x0 double, y0 double, x1 double, y1 double").write.parquet(f"{tmp_path}/tables")
    assert cli.main(["link", f"{tmp_path}/passages", f"{tmp_path}/out", "--cross-document-only", "--tables", f"{tmp_path}/tables", "--cells", f"{tmp_path}/cells"]) == 0
    facts = spark.read.parquet(f"{tmp_path}/out/facts").collect()
    assert sorted((r["document_id"], r["predicate_key"], r["quote"]) for r in facts) == [(d, "revenue", q) for d in ("d0", "d1") for q in ("7,225", "8,142")]
    assert all(text[r["quote_start"] : r["quote_end"]] == r["quote"] for r in facts)
    relations = spark.read.parquet(f"{tmp_path}/out/relations").groupBy("relation_type").count().collect()
    assert {r["relation_type"]: r["count"] for r in relations} == {"corroborates": 2, "reconciled_by_period": 2}


def test_near_keys_equal_brute_force(spark):
    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("abc 019") for _ in range(n))
    clean = lambda t: " ".join(t.split())
    ckeys = sorted({clean(f"{word(draw.randrange(2, 10))} {word(draw.randrange(3, 60))}") for _ in range(60)} - {""})

    def changed(t):
        for _ in range(draw.randrange(0, 12)):
            at = draw.randrange(len(t) + 1)
            t = draw.choice([t[:at] + t[at + 1 :], t[:at] + draw.choice("abz") + t[at:]])
        return clean(" ".join(draw.sample(t.split(), len(t.split()))) if draw.random() < 0.3 else t)

    keys = sorted({k for c in ckeys for k in (changed(c), changed(c), changed(c)) if len(k) >= 5})
    want = {(a, b): s for a in keys for b in ckeys if (s := entities.similarity(a, b)) >= entities.REVIEW}
    got = entities.near_keys(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(k,) for k in ckeys], "key string")).collect()
    assert {(r["key"], r["ckey"]): r["score"] for r in got} == want and len(got) == len(want)
    few = {max(len(a), len(b)) < 24 for a, b in want}
    assert few == {True, False} and len(want) > 60


def test_names_alike_in_most_letters_are_not_all_compared(spark, monkeypatch):
    monkeypatch.setattr(entities, "name_score", lambda a, b: F.lit(entities.REVIEW))
    row = "id string, {} string, entity_type string, identifiers map<string,string>"
    catalogue = spark.createDataFrame([(f"s{k}", f"Supplier#{k * 7919 % 10**9:09d}", "company", {}, []) for k in range(1, 400)], row.format("canonical_name") + ", aliases array<string>")
    mentions = spark.createDataFrame([(str(k), f"Zupplier#{k * 7919 % 10**9:09d}", "company", {}) for k in range(1, 101)], row.format("name"))
    got = entities.resolve(mentions, catalogue).selectExpr("array_contains(candidates, 's' || id) AS own", "size(candidates) AS n").collect()
    assert all(r["own"] for r in got) and sum(r["n"] for r in got) < 4000  # of 39,900 pairs


def test_pages_are_laid_out_in_one_stream(spark):
    at = lambda p, k, y, t: ("d", p, 600.0, 800.0, k, 50.0, float(y), 300.0, float(y + 10), t)
    blocks = [at(p, k, 150 + 100 * k, f"Text {k} of page {p}") for p in range(3 * layout.ROWS // 5) for k in range(2)] + [at(None, 0, 150, "No page"), at(None, 1, 250, "is known")]
    got = layout.passages(spark.createDataFrame(blocks, BLOCKS).repartition(3))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # a call a page
    rows = {(r["page_index"], r["reading_order"]): (r["role"], r["text"], r["char_start"]) for r in got.collect()}
    want = {(p, k): ("body", f"Text {k} of page {p}", k * (len(f"Text 0 of page {p}") + 2)) for p in range(3 * layout.ROWS // 5) for k in range(2)}
    assert rows == want | {(None, 0): ("body", "No page", 0), (None, 1): ("body", "is known", 9)}


def test_totals_read_their_cells_once(spark):
    rows = [("s", 1, "line_1", "₹ 1.00"), ("s", 2, "line_2", "₹ 2.00"), ("s", 3, "total", "₹ 3.00"), ("s", 4, "line_4", "₹ 4.00"), ("s", 5, "line_5", "5%"), ("s", 6, "line_6", "₹ 6.00"), ("s", 7, "sub_total", "₹ 12.00"), ("s", 8, "line_8", "₹ 1.00"), ("t", 1, "line_1", "₹ 1.00"), ("t", 2, "total", "₹ 1.00"), (None, 1, "line_1", "₹ 1.00"), (None, 2, "line_2", "₹ 1.00"), (None, 3, "total", "₹ 2.00")]
    cells = spark.createDataFrame(rows, "subject_id string, row_index int, predicate_key string, raw string").select("subject_id", F.lit("d").alias("document_id"), F.lit(0).alias("page_index"), F.lit(0).alias("table_index"), F.lit(1).alias("column_index"), "row_index", "predicate_key", numbers.number(F.col("raw")).alias("value"))
    got = audit.totals(cells, complete=True)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["subject_id"], r["section"], r["total_key"]): (r["n_components"], float(r["difference"]), r["relation_type"]) for r in got.collect()} == {("s", 0, "total"): (2, 0.0, "corroborates"), ("s", 1, "sub_total"): (2, 2.0, "contradicts")}
