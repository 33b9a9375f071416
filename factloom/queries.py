"""Queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import context as _context
from factloom.functions import names, numbers, periods
from factloom.operators import audit, compare, entities, extract, layout, registry
from factloom.plans import pipeline, rendered, views
from factloom.sources import documents, replay, store
from factloom.sources.stored import stored

_NUMBERS = [
    ("1 thousand", 1000.0, None, None, None), ("1.5 lakh", 150000.0, None, None, None), ("2 million", 2000000.0, None, None, None), ("3 crore", 30000000.0, None, None, None),
    ("1.2 billion", 1200000000.0, None, None, None), ("(₹1,23,456.75 crore)", -1234567500000.0, "rupee", "INR", None), ("12.5%", 12.5, "percent", None, None),
    ("75 basis points", 0.75, "percentage_point", None, None), ("1.8x", 1.8, "ratio", None, None), ("3:2", 1.5, "ratio", None, None), ("2 million tonnes", 2000000.0, "tonne", None, None),
    ("450 shipments", 450.0, "shipment", None, None), ("approximately ₹8,142 crore", 81420000000.0, "rupee", "INR", None), ("42 widgets", 42.0, None, None, "unknown_unit"),
    ("Revenue changed from 10 to 12", None, None, None, "ambiguous_number"), ("no digits", None, None, None, "missing_number"), ("5:0", None, None, None, "invalid_ratio"),
]
_RANGES = [("between ₹10–12 crore", 1e8, 1.2e8, None), ("12 to 10 percent", None, None, "reversed_range"), ("about 10 percent", None, None, "missing_range")]
_DATES = [("2024-03-31", "2024-03-31", "day", None), ("March 31st, 2024", "2024-03-31", "day", None), ("31 March 2024", "2024-03-31", "day", None), ("March 2024", "2024-03-01", "month", None), ("2024", "2024-01-01", "year", "year_only"), ("February 30, 2024", None, None, "invalid_date")]
_PERIODS = [
    ("FY24", "2023-04-01", "2024-03-31", None, "fiscal_year"), ("FY 2023-24", "2023-04-01", "2024-03-31", None, "fiscal_year"), ("year ended March 31, 2024", "2023-04-01", "2024-03-31", None, "date_range"),
    ("Q4 FY24", "2024-01-01", "2024-03-31", None, "quarter"), ("Q1 2024", "2024-01-01", "2024-03-31", None, "quarter"), ("month ended February 2024", "2024-02-01", "2024-02-29", None, "month"),
    ("as of March 31, 2024", None, None, "2024-03-31", "point_in_time"), ("as at 31 March 2024", None, None, "2024-03-31", "point_in_time"), ("from April 1, 2023 to March 31, 2024", "2023-04-01", "2024-03-31", None, "date_range"),
    ("2024", "2024-01-01", "2024-12-31", None, "calendar_year"), ("year ended February 29, 2024", "2023-03-01", "2024-02-29", None, "date_range"), ("FY99", "1998-04-01", "1999-03-31", None, "fiscal_year"),
    ("during the period under review", None, None, None, None), ("as of February 30, 2024", None, None, None, None),
]
_KEYS = [("Revenue from Operations", "revenue_from_operations"), ("Revenue from operations (₹ million)", "revenue_from_operations"), ("Profit & Loss", "profit_and_loss"), ("EBITDA %", "ebitda_percentage"), ("2024 estimate", "measure_2024_estimate"), ("Total Revenue", "revenue_from_operations")]


def _literal(x) -> str:
    return "NULL" if x is None else f"{x!r}::DOUBLE" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], *columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


def _inputs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in rows], "raw string")


def _facts(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, failures), extracted once."""
    return extract.parted(stored(extract.extracted(passages), "extracted"))


def number_golden(spark, sf_dir):
    v = F.col("v")
    return _inputs(spark, _NUMBERS).withColumn("v", numbers.number(F.col("raw"))).select("raw", v["number"].cast("double").alias("number"), v["unit"].alias("unit"), v["currency"].alias("currency"), v["warning"].alias("warning"))


def range_golden(spark, sf_dir):
    v = F.col("v")
    return _inputs(spark, _RANGES).withColumn("v", numbers.number_range(F.col("raw"))).select("raw", v["low"].cast("double").alias("low"), v["high"].cast("double").alias("high"), v["warning"].alias("warning"))


def date_golden(spark, sf_dir):
    v = F.col("v")
    return _inputs(spark, _DATES).withColumn("v", periods.date_value(F.col("raw"))).select("raw", v["value"].cast("string").alias("value"), v["precision"].alias("precision"), v["warning"].alias("warning"))


def period_golden(spark, sf_dir):
    v = F.col("v")
    return _inputs(spark, _PERIODS).withColumn("v", periods.period(F.col("raw"))).select("raw", *(v[k].cast("string").alias(n) for k, n in (("start", "start_date"), ("end", "end_date"), ("as_of", "as_of"), ("kind", "kind"))))


def key_golden(spark, sf_dir):
    return _inputs(spark, _KEYS).select("raw", _context.measure_key(F.col("raw")).alias("key"))


def number_roundtrip(spark, sf_dir):
    """Amounts of all lines, rendered and parsed."""
    lines = rendered.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    parsed = lines.withColumn("raw", F.concat(F.lit("₹ "), rendered.amount(F.col("cents")), F.lit(" thousand"))).withColumn("v", numbers.reused(numbers.number, "raw"))
    return parsed.select("l_orderkey", "l_linenumber", F.round(F.col("v.number").cast("double"), 2).alias("number"), F.col("v.currency").alias("currency"))


def relations_linked(spark, sf_dir):
    """For each nation and fiscal year: does report B corroborate, contradict, or differ by context from report A on order value?"""
    facts, _ = _facts(rendered.two_reports(spark, sf_dir))
    rel = compare.relations(compare.pairs(facts, cross_document=True))
    label = facts.select(F.col("id").alias("fact_a_id"), F.col("context.period.label").alias("fiscal_year"), "document_id")
    same = rel.join(label, "fact_a_id").join(facts.select(F.col("id").alias("fact_b_id"), F.col("context.period.label").alias("other")), "fact_b_id").where("fiscal_year = other")
    return same.select(F.col("subject_id").alias("nation"), "fiscal_year", "relation_type", F.col("value_comparison.difference").cast("double").alias("difference"), F.round("confidence", 4).alias("confidence"))


def relation_types(spark, sf_dir):
    return views.counts(relations_linked(spark, sf_dir), "relation_type")


def period_reconciled(spark, sf_dir):
    """Pairs of neighbouring and other years within report A: all differ by period only."""
    facts, _ = _facts(rendered.two_reports(spark, sf_dir).where("document_id = 'report-a'"))
    return compare.relations(compare.pairs(facts)).groupBy(F.col("subject_id").alias("nation"), "relation_type").agg(F.count(F.lit(1)).alias("n"))


def evidence_verified(spark, sf_dir):
    """Each fact's quotation, cut again from its passage."""
    p = rendered.two_reports(spark, sf_dir)
    facts, _ = _facts(p)
    j = facts.join(p.select(F.col("id").alias("passage_id"), "text", "char_start"), "passage_id")
    again = F.substring("text", F.col("quote_start") - F.col("char_start") + 1, F.col("quote_end") - F.col("quote_start"))
    return j.groupBy(F.col("document_id")).agg(F.count(F.lit(1)).alias("facts"), F.count_if(again == F.col("quote")).alias("verified"))


def growth_checks(spark, sf_dir):
    facts, _ = _facts(rendered.growth_report(spark, sf_dir))
    return audit.discover_growth(facts).select(F.col("subject_id").alias("nation"), F.col("stated.context.period.label").alias("fiscal_year"), "relation_type", F.round("calculated", 4).alias("calculated"))


def component_totals(spark, sf_dir):
    return audit.totals(rendered.line_grids(spark, sf_dir), complete=True).select("subject_id", "n_components", "relation_type", F.round(F.col("difference").cast("double"), 2).alias("difference"))


def table_cells_to_facts(spark, sf_dir):
    t = extract.table_facts(stored(rendered.grids(spark, sf_dir), "cells"))
    return t.select(F.col("document_id").alias("nation"), "predicate_key", F.col("context.period.label").alias("fiscal_year"), F.col("value.number").cast("double").alias("number"), F.col("value.currency").alias("currency"), F.array_join("warnings", ",").alias("warnings"))


def candidate_counts(spark, sf_dir):
    """Numeric candidates of the raw documents: seen and ignored."""
    docs = rendered.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").cast("string").alias("id"), "text", F.lit("body").alias("role"))
    return extract.statistics(docs)


def document_dedupe(spark, sf_dir):
    docs = rendered.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), F.format_string("%012d", "doc_id").alias("original_filename"))
    return documents.register(docs, docs.limit(0))


def repeated_furniture(spark, sf_dir):
    """Lines, at any place, that two documents of a source share, documents as pages."""
    docs = rendered.read(spark, sf_dir, "documents")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\r?\n")).alias("raw")).where(F.trim("raw") != "").select("source", layout.furniture_key(F.col("raw")).alias("line"), "doc_id").distinct()
    return lines.groupBy("source", "line").agg(F.count("doc_id").alias("pages")).where("pages >= 2")


def predicate_registry(spark, sf_dir):
    """Part types as measures of the kind that their first part has."""
    p = rendered.read(spark, sf_dir, "part").select(_context.measure_key(F.col("p_type")).alias("key"), F.col("p_type").alias("label"), F.when(F.col("p_partkey") % 2 == 0, "number").otherwise("text").alias("value_kind"), F.col("p_partkey").alias("ord"))
    good, bad = registry.register(p)
    return good.select("key", "value_kind", F.size("aliases").cast("bigint").alias("aliases")).join(bad.groupBy("key").agg(F.count(F.lit(1)).alias("conflicts")), "key", "left").select("key", "value_kind", "aliases", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def _suppliers(spark, sf_dir):
    s = rendered.read(spark, sf_dir, "supplier")
    cin = F.lpad(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")), 21, "0")
    none = F.create_map().cast("map<string,string>")
    catalogue = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat("s_name", F.lit(" Limited")).alias("canonical_name"), F.lit("company").alias("entity_type"), F.create_map(F.lit("cin"), cin).alias("identifiers"), F.array().cast("array<string>").alias("aliases"))
    kind = F.col("s_suppkey") % 4
    mentions = s.where("s_suppkey % 4 <> 3").select(
        F.col("s_suppkey").cast("string").alias("id"), F.when(kind == 1, F.concat(F.lit("Mr. "), F.upper("s_name"), F.lit(" Pvt. Ltd."))).when(kind == 0, F.lit("Another Name")).otherwise(F.concat_ws(" ", F.lit("Zephyr"), F.sha2(F.col("s_suppkey").cast("string"), 256))).alias("name"),
        F.lit("organisation").alias("entity_type"), F.when(kind == 0, F.create_map(F.lit("CIN"), F.lower(cin))).otherwise(none).alias("identifiers"))
    return mentions, catalogue


def entity_resolution(spark, sf_dir):
    r = entities.resolve(*_suppliers(spark, sf_dir))
    return r.select("id", "method", F.when(F.col("method") == "new_entity", "new").otherwise(F.col("entity_id")).alias("entity"), F.round("confidence", 4).alias("confidence"))


def entity_resolution_near(spark, sf_dir):
    """All suppliers: those of entity_resolution, and the others by a name with a letter more (one good match) or another letter (none good enough)."""
    mentions, catalogue = _suppliers(spark, sf_dir)
    s = rendered.read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 3")
    near = F.when(F.col("s_suppkey") % 8 == 3, F.concat("s_name", F.lit("x"))).otherwise(F.regexp_replace("s_name", "^.", "Z"))
    more = s.select(F.col("s_suppkey").cast("string").alias("id"), near.alias("name"), F.lit("organisation").alias("entity_type"), F.create_map().cast("map<string,string>").alias("identifiers"))
    r = entities.resolve(mentions.unionByName(more), catalogue)
    entity = F.when(F.col("method") == "new_entity", "new").when(F.col("method").isin("conflict", "needs_review"), "review").otherwise(F.col("entity_id"))
    return r.select("id", "method", entity.alias("entity"), F.round("confidence", 4).alias("confidence"), F.array_contains("candidates", F.concat(F.lit("s"), "id")).alias("found"))


def incremental_equals_full(spark, sf_dir):
    """Relations found by linking report B's facts to stored ones of report A."""
    facts, _ = _facts(rendered.two_reports(spark, sf_dir))
    a, b = (facts.where(F.col("document_id") == d) for d in ("report-a", "report-b"))
    return views.counts(pipeline.link_new(a, b, cross_document=True), "relation_type")


def facts_page(spark, sf_dir):
    """The second page of ten facts of report A."""
    facts, _ = _facts(rendered.two_reports(spark, sf_dir).where("document_id = 'report-a'"))
    return views.page(facts, 2, 10, "subject_id", "context.period.label").select("subject_id", F.col("context.period.label").alias("fiscal_year"), F.col("value.number").cast("double").alias("number"))


def document_counts(spark, sf_dir):
    facts, lost = _facts(rendered.two_reports(spark, sf_dir))
    rel = compare.relations(compare.pairs(facts, cross_document=True))
    return views.document_counts(facts.select(F.col("document_id").alias("id")).distinct(), facts, rel, lost)


def interleaved_facts(spark, sf_dir):
    facts, _ = _facts(rendered.two_reports(spark, sf_dir))
    return views.interleaved(facts).select("turn", "document_id").groupBy("turn").agg(F.count(F.lit(1)).alias("documents"))


def reprocess_isolation(spark, sf_dir):
    """What is left of facts and relations after report B is cleared."""
    facts, lost = _facts(rendered.two_reports(spark, sf_dir))
    rel = compare.relations(compare.pairs(facts))
    p = rendered.two_reports(spark, sf_dir)
    left = documents.clear_document("report-b", facts, rel, audit.repeated_metrics(rel), lost, p)
    return left["facts"].select(F.lit("facts").alias("what")).unionAll(left["relations"].select(F.lit("relations"))).unionAll(left["passages"].select(F.lit("passages"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def page_blocks(docs):
    """Documents (doc_id, text) as pages of up to eight lines: a wide heading, then two columns of blocks, in turn; a header and a numbered footer on each page.

    Block numbers don't follow the reading order. In a column, each second block touches the one above it.
    """
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    rows = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(lines).alias("at", "text"))
    k, page = F.col("at") % 8, (F.col("at") / 8).cast("int")
    slot = ((k - 1) / 2).cast("int")  # place in its column
    left = k % 2 == 1
    y0 = F.when(k == 0, 110.0).otherwise(150.0 + slot * 100 - F.when(slot % 2 == 1, 75.0).otherwise(0.0))
    x0 = F.when(k == 0, 40.0).when(left, 50.0).otherwise(340.0)
    box = lambda *c: [x.cast("double").alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"), strict=True)]
    size = [F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height")]
    body = rows.select("document_id", page.alias("page_index"), *size, (9 - k).cast("int").alias("block_no"), *box(x0, y0, F.when(k == 0, 560.0).otherwise(x0 + 200), y0 + 20), "text")
    one = rows.select("document_id", page.alias("page_index")).distinct()
    edge = lambda no, y, text: F.struct(F.lit(no).alias("block_no"), *box(F.lit(50.0), F.lit(y), F.lit(300.0), F.lit(y + 10)), text.alias("text"))
    edges = F.inline(F.array(edge(0, 30.0, F.lit("Annual Report")), edge(10, 780.0, F.concat(F.lit("Page "), (F.col("page_index") + 1).cast("string")))))
    return body.unionByName(one.select("document_id", "page_index", *size, edges))


def passage_layout(spark, sf_dir):
    """Documents as pages with furniture, a heading and two columns: passages by role, and a hash of their texts in reading order."""
    made = layout.passages(page_blocks(rendered.read(spark, sf_dir, "documents")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "role", "text"))), lambda x: F.concat_ws(":", x["role"], x["text"])), "\n\n")
    return made.groupBy("document_id", "page_index").agg(F.count(F.lit(1)).alias("passages"), F.count_if(F.col("role") == "header").alias("headers"), F.count_if(F.col("role") == "footer").alias("footers"), F.sum(F.length("text")).alias("chars"), F.sha2(text, 256).alias("digest"))


def model_replay_grounding(spark, sf_dir):
    """Recorded answers on one passage: a fact, an invented quotation, an invented subject, a broken answer."""
    text = "Delhivery Limited reported revenue of ₹100 crore in FY24."
    item = '{{"facts":[{{"subject":{s},"predicate":"Revenue","value_kind":"number","raw_value":"{r}","quote":"{q}","confidence":0.9}}]}}'
    answers = [("ok", item.format(s='"Delhivery Limited"', r="₹100 crore", q="revenue of ₹100 crore")), ("quote", item.format(s="null", r="₹999 crore", q="Revenue was ₹999 crore.")), ("raw", item.format(s="null", r="₹999 crore", q="revenue of ₹100 crore")), ("subject", item.format(s='"Imaginary Logistics Limited"', r="₹100 crore", q="revenue of ₹100 crore")), ("schema", '{"facts":[{"predicate":"Revenue"}]}')]
    rows = spark.createDataFrame([(k, "d", text, 250, a) for k, a in answers], "id string, document_id string, text string, char_start int, response_json string")
    return replay.ground(rows).select("passage_id", F.substring_index("reason", ":", 1).alias("reason"), F.col("quote_start").cast("bigint").alias("quote_start"))


def name_keys(spark, sf_dir):
    """Normalized supplier names."""
    s = rendered.read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", names.name_key(F.concat(F.lit("Dr. "), "s_name", F.lit(", Private Limited"))).alias("key"))


def table_relations(spark, sf_dir):
    """Order values in tables against report A's prose: table facts have evidence and meet prose facts."""
    cells = stored(rendered.grids(spark, sf_dir), "cells")
    facts, _ = extract.cell_facts(layout.keep_tables(cells).withColumn("document_id", F.concat(F.lit("grid of "), "document_id")), rendered.grid_passages(cells))
    prose, _ = _facts(rendered.two_reports(spark, sf_dir).where("document_id = 'report-a'"))
    both = stored(prose.unionByName(facts), "facts")
    rel = compare.relations(compare.pairs(both, cross_document=True))
    year = lambda k: both.select(F.col("id").alias(f"fact_{k}_id"), F.col("context.period.label").alias(f"year_{k}"))
    same = rel.join(year("a"), "fact_a_id").join(year("b"), "fact_b_id").where("year_a = year_b")
    return same.select(F.col("subject_id").alias("nation"), F.col("year_a").alias("fiscal_year"), "relation_type", F.col("value_comparison.difference").cast("double").alias("difference"))


def repeated_findings(spark, sf_dir):
    """Findings and evidence of all of report A's and B's facts in one run."""
    facts, _ = _facts(rendered.two_reports(spark, sf_dir))
    found = audit.repeated_metrics(compare.relations(compare.pairs(facts, cross_document=True)))
    places = documents.evidence(facts, facts.limit(0))
    return views.counts(found, "relation_type").unionAll(places.agg(F.lit("evidence"), F.count(F.lit(1))))


def component_totals_open(spark, sf_dir):
    """Totals as a grid leaves them: complete components are never proven."""
    return audit.totals(rendered.line_grids(spark, sf_dir)).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_components").alias("components"), F.count_if(F.col("difference") <= F.col("tolerance")).alias("within"))


def context_fields(spark, sf_dir):
    """Scope, basis, geography and fiscal year of a sentence on each order."""
    o = rendered.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda n, *words: F.get(F.array(*map(F.lit, words)), (F.floor(k / n) % len(words)).cast("int"))
    text = F.concat_ws(" ", pick(1, "The", "Standalone", "Consolidated", "Stand-alone and consolidated"), pick(2, "audited", "unaudited", "plain"), pick(3, "actual", "projected", "other"), F.lit("figures of"), pick(5, "India", "the world", "domestic and worldwide markets"), F.lit("for"), rendered.fy_short(F.year("o_orderdate")))
    c = F.col("c")
    return o.select("o_orderkey", text.alias("text")).withColumn("c", numbers.reused(_context.context, "text")).select("o_orderkey", c["scope"].alias("scope"), c["basis"].alias("basis"), c["geography"].alias("geography"), c["period"]["label"].alias("fiscal_year"), c["confidence"].alias("confidence"), F.array_join(c["warnings"], ",").alias("warnings"))


def director_records(spark, sf_dir):
    """DIN records of all customers as directors: name, status and date."""
    letters = F.initcap(F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    k = F.col("c_custkey") % 3
    end = F.when(k == 0, ", resigned from the Board on August 24, 2023.").when(k == 1, ", appointed on April 1st, 2020.").otherwise(", an independent member.")
    c = rendered.read(spark, sf_dir, "customer")
    text = F.concat(F.lit("Mr. A"), letters, F.lit(" Vander-Berg"), F.lit(" (DIN: "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(")"), end)
    p = c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("document_id"), F.lit(0).alias("page_index"), F.lit(0).alias("reading_order"), F.lit("body").alias("role"), text.alias("text"), F.lit(0).alias("char_start"))
    return extract.identifier_records(p).select("document_id", "scheme", "identifier", "name", "status", F.col("as_of").cast("string").alias("as_of"))


def reporting_entities(spark, sf_dir):
    """Reports of each nation's holding: named up front and again, once only (then the place), or not at all."""
    n = rendered.read(spark, sf_dir, "nation")
    who, kind = F.concat(F.initcap(F.translate("n_name", "_0123456789", "-abcdefghij")), F.lit(" Holdings Limited")), F.col("n_nationkey") % 3
    vendor = F.lit("Cited Vendor Limited, Cited Vendor Limited, Cited Vendor Limited and Cited Vendor Limited sell data.")
    front = F.when(kind == 2, "A report on the economy.").otherwise(F.concat(F.lit("The "), who, F.lit(" presents its report.")))
    later = F.when(kind == 0, F.concat(F.lit("Of "), who, F.lit(", more.")))
    page = lambda k, text: n.select(F.col("n_name").alias("document_id"), F.lit(k).alias("page_index"), text.alias("text"))
    pages = page(0, front).unionAll(page(1, F.when(kind == 1, "Growth in India was high.").otherwise("Nothing else."))).unionAll(page(3, F.coalesce(later, F.lit("-")))).unionAll(page(4, vendor))
    return extract.reporting_entity(pages).select("document_id", "name", "entity_type", "id")


def entity_merge(spark, sf_dir):
    """The catalogue of suppliers after mentions with a scheme spelled twice and names of their own."""
    s = rendered.read(spark, sf_dir, "supplier")
    cin = F.lpad(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")), 21, "0")
    _, catalogue = _suppliers(spark, sf_dir)
    mentions = s.select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("Known as "), F.col("s_suppkey").cast("string")).alias("name"), F.lit("company").alias("entity_type"), F.create_map(F.lit("CIN"), F.lower(cin), F.lit("cin"), cin, F.lit("LEI"), F.lit(" ")).alias("identifiers"))
    m = entities.merged(catalogue, entities.resolve(mentions, catalogue))
    return m.select("id", "canonical_name", "entity_type", F.col("identifiers")["cin"].alias("cin"), F.size("identifiers").alias("schemes"), F.array_join("aliases", "|").alias("aliases"))


def status_updates(spark, sf_dir):
    """Orders as documents: status changes, and rows replaced by the latest of their line items."""
    o = rendered.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("registered").alias("status"), F.lit(1).alias("page_count"))
    changes = o.select("id", F.when(F.col("id") % 3 == 0, "complete").when(F.col("id") % 3 == 1, "failed").alias("status"), F.when(F.col("id") % 2 == 0, 9).alias("page_count")).where("id % 5 <> 0")
    lines = rendered.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit(None).cast("string").alias("status"), (F.col("l_linenumber") * 100).cast("int").alias("page_count"))
    return documents.upsert(documents.set_status(o, changes), lines.where("id % 7 = 0"), ["id"], latest="page_count").select("id", "status", "page_count")


def text_rules(spark, sf_dir):
    """Redaction, spellings, text keys and conflicting identifiers of customers."""
    c = rendered.read(spark, sf_dir, "customer")
    ids = lambda v: F.create_map(F.lit("lei"), v, F.lit("din"), F.lit("1"))
    other = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("none")
    return c.select(
        "c_custkey", names.redacted(F.concat(F.lit("API_KEY= "), "c_mktsegment", F.lit(" of "), "c_name")).alias("safe"), F.size(names.unique_text(F.array("c_name", F.upper("c_name"), F.lower("c_name"), "c_mktsegment"))).alias("spellings"),
        (names.text_key(F.upper("c_name")) == names.text_key(F.concat(F.lit(" "), "c_name", F.lit("!")))).alias("same"), F.array_join(names.identifier_conflicts(ids(F.col("c_mktsegment")), ids(other)), ",").alias("conflicts"),
    )


def period_forms(spark, sf_dir):
    """Periods written in several ways, from each order's date."""
    o = rendered.read(spark, sf_dir, "orders")
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 6
    two = F.lpad(((y + 1) % 100).cast("string"), 2, "0")
    text = (
        F.when(k == 0, F.concat(F.lit("growth in FY "), y.cast("string"), F.lit("-"), two)).when(k == 1, F.concat(F.lit("Fiscal year "), y.cast("string"))).when(k == 2, F.concat(F.lit("as of "), F.date_format("o_orderdate", "MMMM d, yyyy")))
        .when(k == 3, F.concat(F.lit("fiscal "), y.cast("string"))).when(k == 4, F.concat(F.lit("Q3 FY"), two)).otherwise(F.concat(F.lit("FY "), y.cast("string"), F.lit("-"), (y + 2).cast("string")))
    )
    p = F.col("p")
    return o.select("o_orderkey", text.alias("text")).withColumn("p", numbers.reused(periods.period, "text")).select("o_orderkey", p["label"].alias("label"), p["start"].cast("string").alias("start_date"), p["end"].cast("string").alias("end_date"), p["as_of"].cast("string").alias("as_of"), p["kind"].alias("kind"))


def measure_keys(spark, sf_dir):
    """Keys of part types as measures, with unit notes, other brackets and none."""
    p = rendered.read(spark, sf_dir, "part")
    note = F.get(F.array(*map(F.lit, (" (₹ crore)", " (others)", " in INR million", " & more %", ""))), (F.col("p_partkey") % 5).cast("int"))
    return p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 11 == 0, "7 ").otherwise(""), F.when(F.col("p_partkey") % 13 == 0, "₹").otherwise(F.col("p_type")), note).alias("label")).select("p_partkey", numbers.reused(_context.measure_key, "label").alias("key"))


def evidence_store(spark, sf_dir):
    """Evidence on customers' names: spans stored before, quotations that fail, ids that other evidence has."""
    c = rendered.read(spark, sf_dir, "customer")
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    row = lambda df, id_, fact, passage, quote, n: df.select(id_.alias("id"), fact.alias("fact_id"), passage.alias("passage_id"), quote.alias("quote"), F.lit(100).alias("quote_start"), F.lit(100 + n).alias("quote_end"))
    fact, place, quote = F.concat(F.lit("f"), key), F.concat(F.lit("p"), key), F.substring("c_name", 1, 8)
    passages = c.select(place.alias("id"), F.col("c_name").alias("text"), F.lit(100).alias("char_start"))
    new = row(c, F.concat(F.lit("e"), key), fact, F.when(k == 2, F.concat(F.lit("x"), key)).otherwise(place), F.when(k == 1, "elsewhere").otherwise(quote), 8)
    before = row(c.where(k == 0), F.concat(F.lit("s"), key), fact, place, quote, 8).unionAll(row(c.where(k == 3), F.concat(F.lit("e"), key), F.lit("other"), place, F.substring("c_name", 1, 1), 1))
    kept, lost = store.store_evidence(before, new, passages)
    return kept.select("fact_id", "passage_id", F.when(F.col("id").startswith("evidence_"), "renamed").otherwise("kept").alias("outcome")).unionAll(lost.select("fact_id", "passage_id", "reason"))


def finding_store(spark, sf_dir):
    """Totals of orders as findings: some checked before, some with a line that isn't a stored fact."""
    lines = rendered.read(spark, sf_dir, "lineitem")
    fact = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    facts = lines.where("not (l_orderkey % 4 = 1 and l_linenumber = 1)").select(fact.alias("id")).distinct()
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(fact)).alias("fact_ids"))
    finding = lambda mark: made.select(F.concat(F.lit(mark), F.col("l_orderkey").cast("string")).alias("id"), F.lit("component_total").alias("check_type"), F.lit("sum").alias("formula"), "fact_ids")
    none = finding("n").limit(0).withColumn("fingerprint", F.lit(""))
    before, _, _ = store.store_findings(none, finding("s").where("substr(id, 2) % 4 = 2"), facts)
    kept, operands, lost = store.store_findings(before, finding("n"), facts)
    n = operands.groupBy(F.col("finding_id").alias("id")).agg(F.count(F.lit(1)).alias("operands"), F.max("position").alias("last"))
    return views.findings(kept, check_type="component_total").join(n, "id").select("id", "operands", "last", F.lit("").alias("missing")).unionAll(lost.select("id", F.lit(0).cast("bigint"), F.lit(None).cast("int"), F.array_join("missing", ",")))


def recorded_answers(spark, sf_dir):
    """The answer that a chain of two models has on record for each customer, from tables of an older layout and a newer batch."""
    c = rendered.read(spark, sf_dir, "customer").select(F.col("c_name").alias("passage_hash"), (F.col("c_custkey") % 2 == 0).alias("even"))
    row = lambda df, model, answer, at: df.select("passage_hash", F.lit(model).alias("model"), F.lit(1).alias("prompt_version"), F.lit(answer).alias("response_json"), F.lit(at).alias("created_at"))
    old = store.migrated({"answers": row(c, "a", "old", 1)}, 2)["answers"]
    new = row(c.where("even"), "a", "a", 2).unionAll(row(c, "b", "first", 3)).unionAll(row(c, "b", "second", 4)).withColumn("schema_version", F.lit(2))
    return replay.recorded(store.store_answers(old, new), ("a", "b"), schema_version=2, prompt_version=1)


def fact_details(spark, sf_dir):
    """Facts of report A with their normalized values, and the page of their evidence."""
    p = rendered.two_reports(spark, sf_dir)
    facts, _ = _facts(p)
    seen = views.evidence(documents.evidence(facts, facts.limit(0)).withColumn("id", F.col("fact_id")), p, document="report-a").select(F.col("fact_id").alias("id"), "page_index", "quote_start")
    return views.fact_details(views.facts(facts, document="report-a")).join(seen, "id").select(F.col("subject_id").alias("nation"), F.col("context.period.label").alias("fiscal_year"), F.col("normalized_value").cast("double").alias("normalized"), "page_index", (F.col("confidence") <= F.least("extraction_confidence", "normalization_confidence")).alias("least"))


def stored_entities(spark, sf_dir):
    """Suppliers as subjects of facts, found by id, by name in other letters, or new."""
    s = rendered.read(spark, sf_dir, "supplier")
    key, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    known = s.select(F.concat(F.lit("s"), key).alias("id"), F.col("s_name").alias("canonical_name"), F.lit("company").alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("ready").alias("review_state"))
    name = F.when(k == 1, F.upper("s_name")).when(k == 2, F.concat(F.lit("New "), "s_name")).otherwise("Any Name")
    subjects = s.select(key.alias("fact_id"), F.when(k == 0, F.concat(F.lit("s"), key)).alias("subject_id"), name.alias("name"), F.lit("company").alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit("ready").alias("review_state"))
    found, all_ = store.store_entities(known, subjects)
    return found.join(all_.select(F.col("id").alias("entity_id"), "canonical_name", "confidence"), "entity_id").select("fact_id", F.when(F.col("entity_id").startswith("entity_"), "new").otherwise(F.col("entity_id")).alias("entity"), "canonical_name", "confidence")


def alias_evidence(spark, sf_dir):
    """Evidence of the names that orders give to their customers, if the order's status is one of a sure match."""
    o = rendered.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity_id"), F.concat(F.lit("Buyer "), (F.col("o_orderkey") % 3).cast("string")).alias("name"), F.when(F.col("o_orderkey") % 4 == 0, "needs_review").when(F.col("o_orderkey") % 4 == 1, "identifier").otherwise("exact_name").alias("method"))
    got = store.alias_evidence(o, o.select(F.col("id").alias("mention_id"), F.concat(F.lit("ev"), "id").alias("evidence_id")))
    return got.select("entity_id", "alias", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def run_counts(spark, sf_dir):
    """Counters of a run over both reports, after one over report A alone with all its answers recorded."""
    p, cells = rendered.two_reports(spark, sf_dir), stored(rendered.grids(spark, sf_dir), "cells")
    facts, lost = _facts(p)
    rel = stored(compare.relations(compare.pairs(facts, cross_document=True)).select("fact_a_id", "fact_b_id"), "pairs")
    first = facts.where("document_id = 'report-a'").select("id")
    cached = p.where("document_id = 'report-a'").select(F.sha2("text", 256).alias("passage_hash"), F.lit("{}").alias("response_json"), F.lit("m").alias("model"))
    asked, _ = replay.budgeted(p, cached, budget=20)
    return views.run_counts(p, cells, extract.statistics(p), facts, first, lost, rel, rel.limit(0), asked)


_VALUE = """WITH v AS (
  SELECT n_name AS nation, n_nationkey AS rule, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT *, (cents + 500000) // 1000000 AS a, CASE WHEN rule % 5 = 0 THEN (cents * 11 + 50000000) // 100000000 ELSE (cents + 5000000) // 10000000 END AS b,
  'FY ' || (fy - 1) || '-' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS label FROM v),
x AS (SELECT *, abs(a * 10000 - b * 100000) AS d, CASE WHEN rule % 5 = 1 THEN 'reconciled_by_scope' WHEN abs(a * 10000 - b * 100000) < 55000 THEN 'corroborates' ELSE 'contradicts' END AS kind FROM w)
"""
_G = _VALUE + """, g AS (SELECT w.nation, w.label, w.rule, w.a, p.a AS p, round((w.a - p.a) * 10000 / p.a) / 100 + CASE WHEN w.rule % 3 = 0 THEN 5 ELSE 0 END AS stated FROM w JOIN w AS p ON p.nation = w.nation AND p.fy = w.fy - 1),
h AS (SELECT *, CAST(a - p AS DOUBLE) / p * 100 AS calc, 0.5 / p * 100 + a * 0.5 / p / p * 100 + 0.005 AS tol FROM g)
"""

_SQL = {
    "number_golden": _values(_NUMBERS, "raw", "number", "unit", "currency", "warning"),
    "range_golden": _values(_RANGES, "raw", "low", "high", "warning"),
    "date_golden": _values(_DATES, "raw", "value", "precision", "warning"),
    "period_golden": _values(_PERIODS, "raw", "start_date", "end_date", "as_of", "kind"),
    "key_golden": _values(_KEYS, "raw", "key"),
    "number_roundtrip": "SELECT l_orderkey, l_linenumber, round(round(l_extendedprice * 100) * 10, 2) AS number, 'INR' AS currency FROM lineitem",
    "relations_linked": _VALUE + "SELECT nation, label AS fiscal_year, kind AS relation_type, CAST(d AS DOUBLE) AS difference, CAST(round(CASE kind WHEN 'corroborates' THEN 0.98 WHEN 'contradicts' THEN 0.96 ELSE 0.92 END * 0.92, 4) AS DOUBLE) AS confidence FROM x",
    "relation_types": _VALUE + "SELECT kind AS relation_type, count(*) AS n FROM x GROUP BY 1",
    "period_reconciled": _VALUE + "SELECT nation, 'reconciled_by_period' AS relation_type, count(*) * (count(*) - 1) // 2 AS n FROM w GROUP BY nation HAVING count(*) > 1",
    "evidence_verified": _VALUE + "SELECT d AS document_id, count(*) AS facts, count(*) AS verified FROM w, (VALUES ('report-a'), ('report-b')) AS t(d) GROUP BY d",
    "growth_checks": _G + "SELECT nation, label AS fiscal_year, CASE WHEN abs(calc - stated) <= tol THEN 'corroborates' ELSE 'contradicts' END AS relation_type, round(calc, 4) AS calculated FROM h",
    "component_totals": "SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, count(*) AS n_components, CASE WHEN l_orderkey % 7 = 0 THEN 'contradicts' ELSE 'corroborates' END AS relation_type, CASE WHEN l_orderkey % 7 = 0 THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS difference FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2",
    "table_cells_to_facts": _VALUE + "SELECT nation, 'order_value' AS predicate_key, label AS fiscal_year, CAST(b * 100000 AS DOUBLE) AS number, 'INR' AS currency, 'unit_from_table_header' AS warnings FROM w",
    "document_dedupe": "SELECT sha256(text) AS content_hash, printf('%012d', min(doc_id)) AS original_filename FROM documents GROUP BY 1",
    "repeated_furniture": r"WITH l AS (SELECT source, doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS raw FROM documents) SELECT source, trim(regexp_replace(regexp_replace(lower(raw), '\d+', '#', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ·|—-#') AS line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(raw) <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2",
    "predicate_registry": "WITH p AS (SELECT p_partkey, p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS key, CASE WHEN p_partkey % 2 = 0 THEN 'number' ELSE 'text' END AS kind FROM part), f AS (SELECT key, arg_min(kind, p_partkey) AS value_kind FROM p GROUP BY key) SELECT key, value_kind, count(DISTINCT p_type) FILTER (kind = value_kind) AS aliases, count(*) FILTER (kind <> value_kind) AS conflicts FROM p JOIN f USING (key) GROUP BY ALL",
    "entity_resolution": "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE s_suppkey % 4 WHEN 0 THEN 'identifier' WHEN 1 THEN 'exact_name' ELSE 'new_entity' END AS method, CASE WHEN s_suppkey % 4 = 2 THEN 'new' ELSE 's' || s_suppkey END AS entity, CASE s_suppkey % 4 WHEN 0 THEN 0.99 WHEN 1 THEN 0.96 ELSE 0.9 END::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 4 <> 3",
    "entity_resolution_near": "WITH k AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'identifier' WHEN 4 THEN 'identifier' WHEN 1 THEN 'exact_name' WHEN 5 THEN 'exact_name' WHEN 3 THEN 'fuzzy_name' WHEN 7 THEN 'needs_review' ELSE 'new_entity' END AS method FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS id, method, CASE method WHEN 'new_entity' THEN 'new' WHEN 'needs_review' THEN 'review' ELSE 's' || s_suppkey END AS entity, CASE method WHEN 'identifier' THEN 0.99 WHEN 'exact_name' THEN 0.96 WHEN 'fuzzy_name' THEN 0.95 WHEN 'needs_review' THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, method <> 'new_entity' AS found FROM k",
    "facts_page": _VALUE + "SELECT nation AS subject_id, label AS fiscal_year, CAST(a * 10000 AS DOUBLE) AS number FROM w ORDER BY nation, label LIMIT 10 OFFSET 10",
    "document_counts": _VALUE + ", r AS (SELECT count(*) AS n FROM w JOIN w AS o USING (nation)) SELECT d AS document_id, count(*) AS facts, any_value(r.n) AS relations, 0::BIGINT AS failures FROM w, r, (VALUES ('report-a'), ('report-b')) AS t(d) GROUP BY d",
    "interleaved_facts": _VALUE + "SELECT CAST(i AS INTEGER) AS turn, 2::BIGINT AS documents FROM (SELECT count(*) AS n FROM w), range(1, 1000000) AS t(i) WHERE i <= n",
    "reprocess_isolation": _VALUE + ", k AS (SELECT nation, count(*) AS c FROM w GROUP BY nation) SELECT 'facts' AS what, CAST(sum(c) AS BIGINT) AS n FROM k UNION ALL SELECT 'passages', CAST(sum(c) AS BIGINT) FROM k UNION ALL SELECT 'relations', CAST(sum(c * (c - 1) // 2) AS BIGINT) FROM k",
    "model_replay_grounding": "SELECT * FROM (VALUES ('ok', NULL, 277::BIGINT), ('quote', 'grounding', NULL), ('raw', 'grounding', NULL), ('subject', 'grounding', NULL), ('schema', 'schema', NULL)) AS t(passage_id, reason, quote_start)",
    "name_keys": "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS key FROM supplier",
    "incremental_equals_full": _VALUE + ", c AS (SELECT nation, rule, count(*) AS n FROM w GROUP BY ALL) SELECT relation_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT kind AS relation_type, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT CASE WHEN rule % 5 = 1 THEN 'incomparable' ELSE 'reconciled_by_period' END, n * (n - 1) FROM c WHERE n > 1) GROUP BY 1",
    "table_relations": _VALUE + "SELECT nation, label AS fiscal_year, CASE WHEN d < 55000 THEN 'corroborates' ELSE 'needs_review' END AS relation_type, CAST(d AS DOUBLE) AS difference FROM x WHERE nation IN (SELECT nation FROM w GROUP BY nation HAVING count(*) >= 1)",
    "repeated_findings": _VALUE + "SELECT kind AS relation_type, count(*) AS n FROM x WHERE kind <> 'reconciled_by_scope' GROUP BY 1 UNION ALL SELECT 'evidence', 2 * count(*) FROM w",
    "component_totals_open": "SELECT 'needs_review' AS relation_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS components, count(*) FILTER (l_orderkey % 7 <> 0) AS within FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1 HAVING count(*) >= 2)",
    "context_fields": """WITH k AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 4 AS s, (o_orderkey // 2) % 3 AS a, (o_orderkey // 3) % 3 AS v, (o_orderkey // 5) % 3 AS g FROM orders)
SELECT o_orderkey, CASE s WHEN 1 THEN 'standalone' WHEN 2 THEN 'consolidated' END AS scope, nullif(concat_ws('; ', CASE a WHEN 0 THEN 'audited' WHEN 1 THEN 'unaudited' END, CASE v WHEN 0 THEN 'actual' WHEN 1 THEN 'forecast' END), '') AS basis, CASE g WHEN 0 THEN 'India' END AS geography,
  'FY ' || (y - 1) || '-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS fiscal_year, CASE WHEN s = 3 THEN 0.65 ELSE 0.95 END::DOUBLE AS confidence, concat_ws(',', CASE WHEN s = 3 THEN 'ambiguous_scope' END, CASE WHEN g = 2 THEN 'ambiguous_geography' END) AS warnings FROM k""",
    "director_records": "SELECT 'd' || c_custkey AS document_id, 'din' AS scheme, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS identifier, 'A' || upper(translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')[1]) || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')[2:] || ' Vander-Berg' AS name, CASE c_custkey % 3 WHEN 0 THEN 'resigned' WHEN 1 THEN 'appointed' END AS status, CASE c_custkey % 3 WHEN 0 THEN '2023-08-24' WHEN 1 THEN '2020-04-01' END AS as_of FROM customer",
    "reporting_entities": "WITH k AS (SELECT n_name, n_nationkey % 3 AS k, upper(n_name[1]) || lower(translate(n_name[2:], '_0123456789', '-abcdefghij')) AS t FROM nation) SELECT n_name AS document_id, CASE k WHEN 0 THEN t || ' Holdings Limited' WHEN 1 THEN 'India' END AS name, CASE k WHEN 0 THEN 'company' WHEN 1 THEN 'place' END AS entity_type, CASE k WHEN 1 THEN 'place:india' END AS id FROM k",
    "entity_merge": "SELECT 's' || s_suppkey AS id, s_name || ' Limited' AS canonical_name, 'company' AS entity_type, lpad('C' || s_suppkey, 21, '0') AS cin, 1 AS schemes, 'Known as ' || s_suppkey || '|' || s_name || ' Limited' AS aliases FROM supplier",
    "status_updates": "WITH l AS (SELECT l_orderkey AS id, max(l_linenumber) * 100 AS pages FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1), c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'registered' WHEN o_orderkey % 3 = 0 THEN 'complete' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'registered' END AS status, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 9 ELSE 1 END AS page_count FROM orders) SELECT id, status, CAST(coalesce(pages, page_count) AS INTEGER) AS page_count FROM c FULL JOIN l USING (id)",
    "text_rules": "SELECT c_custkey, 'API_KEY= [redacted] of ' || c_name AS safe, 2 AS spellings, true AS same, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'lei' END AS conflicts FROM customer",
    "period_forms": """WITH k AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) AS y, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders),
s AS (SELECT *, CASE k WHEN 0 THEN y WHEN 1 THEN y - 1 WHEN 4 THEN y WHEN 5 THEN y END AS a, CASE k WHEN 0 THEN y + 1 WHEN 1 THEN y WHEN 4 THEN y + 1 WHEN 5 THEN y + 2 END AS b FROM k)
SELECT o_orderkey, CASE WHEN k = 4 THEN 'Q3 ' ELSE '' END || 'FY ' || a || '-' || lpad(CAST(b % 100 AS VARCHAR), 2, '0') AS label, CASE k WHEN 4 THEN a || '-10-01' ELSE a || '-04-01' END AS start_date, CASE k WHEN 4 THEN a || '-12-31' ELSE b || '-03-31' END AS end_date, CASE WHEN k = 2 THEN d END AS as_of,
  CASE k WHEN 2 THEN 'point_in_time' WHEN 3 THEN NULL WHEN 4 THEN 'quarter' ELSE 'fiscal_year' END AS kind FROM s""",
    "measure_keys": "WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') END AS t, CASE p_partkey % 5 WHEN 1 THEN 'others' WHEN 3 THEN 'and_more_percentage' ELSE '' END AS n, p_partkey % 11 = 0 AS seven FROM part), j AS (SELECT p_partkey, concat_ws('_', CASE WHEN seven THEN 'measure_7' END, nullif(t, ''), nullif(n, '')) AS key FROM k) SELECT p_partkey, CASE WHEN key = '' THEN 'unnamed_measure' ELSE key END AS key FROM j",
    "evidence_store": """WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS c, c_custkey % 5 AS k FROM customer)
SELECT 'f' || c AS fact_id, CASE WHEN k = 2 THEN 'x' ELSE 'p' END || c AS passage_id, CASE k WHEN 1 THEN 'grounding: the quotation was not found at its place' WHEN 2 THEN 'missing passage' WHEN 3 THEN 'renamed' ELSE 'kept' END AS outcome FROM k UNION ALL SELECT 'other', 'p' || c, 'kept' FROM k WHERE k = 3""",
    "finding_store": "WITH k AS (SELECT l_orderkey AS o, count(DISTINCT l_linenumber) AS n, l_orderkey % 4 = 1 AND bool_or(l_linenumber = 1) AS lost FROM lineitem GROUP BY 1) SELECT CASE WHEN o % 4 = 2 THEN 's' ELSE 'n' END || o AS id, CASE WHEN lost THEN 0 ELSE n END AS operands, CASE WHEN NOT lost THEN CAST(n - 1 AS INTEGER) END AS last, CASE WHEN lost THEN o || ':1' ELSE '' END AS missing FROM k",
    "recorded_answers": "SELECT c_name AS passage_hash, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'second' END AS response_json, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM customer",
    "fact_details": _VALUE + "SELECT nation, label AS fiscal_year, CAST(a * 10000 AS DOUBLE) AS normalized, 0 AS page_index, true AS least FROM w",
    "stored_entities": "SELECT CAST(s_suppkey AS VARCHAR) AS fact_id, CASE WHEN s_suppkey % 3 = 2 THEN 'new' ELSE 's' || s_suppkey END AS entity, CASE WHEN s_suppkey % 3 = 2 THEN 'New ' ELSE '' END || s_name AS canonical_name, CASE WHEN s_suppkey % 3 = 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM supplier",
    "alias_evidence": "SELECT 'c' || o_custkey AS entity_id, 'Buyer ' || (o_orderkey % 3) AS alias, array_to_string(list_sort(list(DISTINCT 'ev' || o_orderkey)), ',') AS evidence_ids FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL",
    "run_counts": _VALUE + """, n AS (SELECT count(*) AS n FROM w), p AS (SELECT count(*) AS p FROM w JOIN w AS o USING (nation))
SELECT counter, CAST(CASE counter WHEN 'pages' THEN 2 WHEN 'passages' THEN 2 * n WHEN 'tables' THEN (SELECT count(DISTINCT nation) FROM w) WHEN 'candidates_seen' THEN 2 * n WHEN 'facts_extracted' THEN 2 * n WHEN 'facts_created' THEN n WHEN 'facts_reused' THEN n WHEN 'failures' THEN 0 WHEN 'relations_created' THEN p WHEN 'relations_updated' THEN 0 WHEN 'cache_hits' THEN n WHEN 'provider_calls' THEN least(n, 20) END AS BIGINT) AS n
FROM n, p, unnest(['pages', 'passages', 'tables', 'candidates_seen', 'facts_extracted', 'facts_created', 'facts_reused', 'failures', 'relations_created', 'relations_updated', 'cache_hits', 'provider_calls']) AS t(counter)""",
}

_ALL = (
    number_golden, range_golden, date_golden, period_golden, key_golden, number_roundtrip, relations_linked, relation_types, period_reconciled, evidence_verified, growth_checks, component_totals, table_cells_to_facts,
    candidate_counts, document_dedupe, repeated_furniture, predicate_registry, entity_resolution, entity_resolution_near, incremental_equals_full, facts_page, document_counts, interleaved_facts, reprocess_isolation, passage_layout, model_replay_grounding, name_keys,
    table_relations, repeated_findings, component_totals_open, context_fields, director_records, reporting_entities, entity_merge, status_updates, text_rules, period_forms, measure_keys,
    evidence_store, finding_store, recorded_answers, fact_details, stored_entities, alias_evidence, run_counts,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
