"""What keeps queries over many small documents linear and cheap: tables that are counted, one crossing, no shuffle of cells."""

import pytest
from pyspark.sql import functions as F

from folio.functions import sql
from folio.kernel import block, inline, parse
from folio.kernel.flatten import Nodes, block_rows, block_tuples, inline_tuples, item_tuples, shape_of, task_counts, text_tuples
from folio.kernel.html import to_html
from folio.operators import relations as R
from folio.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [
    "# h\n\n| a | *b* |\n| :-- | --: |\n| x \\| y | `p\\|q` |\n| 1 | 2 | 3 |\n| &amp; |\n\n- [x] t *u*\n- v\n",
    "| a |\n|---|\n",
    "t\n\n| www.a.bc | c@d.ef |\n|:-:|---|\n|||\n| | [l] |\nend\n\n[l]: /u\n\n| z |\n| - |\n| ***y*** |\n",
    "| a |\n|---|\n| b[^n] |\n\n[^n]: note\n\n| c[^n] |\n|---|\n",
]


def _made(text: str):
    doc = parse(text)
    for b in doc.blocks:
        _ = b.children
    return doc


@pytest.mark.parametrize("text", TABLES)
def test_tables_that_are_not_made_give_what_their_blocks_give(text):
    doc, made = parse(text), _made(text)
    raw = [b.made is None for b in doc.blocks if b.kind == "Table"]
    assert raw and all(raw) == ("[^" not in text)
    for only in (None, frozenset({"TableCell"}), frozenset({"TableRow"}), frozenset({"Paragraph", "Table"})):
        for rows in (block_tuples, lambda n, o: block_tuples(n, o, True), text_tuples, item_tuples):
            assert rows(Nodes(doc), only) == rows(Nodes(made), only)
    for only, under in ((None, None), (frozenset({"Text"}), frozenset({"Italic"})), (frozenset({"Link", "Autolink"}), None)):
        assert inline_tuples(Nodes(doc), only, under) == inline_tuples(Nodes(made), only, under)
    assert to_html(doc) == to_html(made) and shape_of(Nodes(doc)) == shape_of(Nodes(made))


ITEMS = ["- a\n- b", "- a\n\n- b", "x\n- [ ] a\nb\n- [X] c\n* d", "- a\n  - b\n- c", "> q\n- a", "1. x\n- a", "- a\n===\n- b", "- [x] \n- [x]y", "[^a]: b\n- c", "- a | b\n- | -", "> [!NOTE]\n- a", "- a\n\n  b\n- c\n"]


STARS = ["a **b** and *c-d* e", "*a*", "**a** *b*c", "*a **b** c*", "* a *b*", "*a* &amp; **b**.", "**a*", "a *b@c.de*", "| *a* | **b *c* d** |\n|---|---|\n| x | ~~y~~ |\n", "[*a*](b) _c_", "*a*[^1]\n\n[^1]: *b*"]


@pytest.mark.parametrize("text", STARS)
def test_plain_emphasis_is_paired_as_runs_are(text, monkeypatch):
    rows = inline_tuples(Nodes(parse(text)))
    monkeypatch.setattr(inline, "_BUT_STARS", block.re.compile(""))
    assert rows == inline_tuples(Nodes(parse(text))) and to_html(parse(text)).count("<em>") == sum(r[6] == "Italic" for r in rows)


def test_what_emphasis_holds_is_what_the_join_gives(spark):
    docs = spark.createDataFrame([*enumerate([*STARS, *TABLES, None])], "doc_id long, text string").cache()
    inlines = R.parse_inlines(docs)
    for kind in ("Italic", "Bold", "Strikethrough", "Link"):
        holders = inlines.where(F.col("kind") == kind).select("doc_id", F.col("inline_id").alias("parent_inline_id"))
        want = inlines.join(holders, ["doc_id", "parent_inline_id"]).select("doc_id", "kind", "text")
        assert R.same_structure(R.parse_inlines(docs, under={kind}, columns=("doc_id", "kind", "text")), want)
        assert R.same_structure(R.parse_inlines(docs, under={kind}).select("doc_id", "kind", "text"), want)


@pytest.mark.parametrize("text", ITEMS)
@pytest.mark.parametrize("dialect", ["gfm", "commonmark"])
def test_plain_items_are_read_as_the_stack_reads_them(text, dialect, monkeypatch):
    got = to_html(parse(text, block.Options(dialect))), block_tuples(Nodes(parse(text, block.Options(dialect))))
    monkeypatch.setattr(block, "_PLAIN_ITEM", block.re.compile(r"(?!)"))
    assert got == (to_html(parse(text, block.Options(dialect))), block_tuples(Nodes(parse(text, block.Options(dialect)))))


def test_items_and_shapes_are_what_grouping_gives(spark):
    docs = spark.createDataFrame(list(enumerate([*TABLES, "", None])), "doc_id long, text string").cache()
    cells = R.parse_texts(docs, kinds={"TableCell"}).groupBy("doc_id", "table_id", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text", "align"))), lambda x: F.struct(x["text"], x["align"])).alias("c"))
    rows = R.parse_items(docs, kinds={"TableHead", "TableRow"})
    assert R.same_structure(rows.select("doc_id", "table_id", "row_no", "cells", "aligns"), cells.select("doc_id", "table_id", "row_no", F.col("c")["text"].alias("cells"), F.col("c")["align"].alias("aligns")))
    assert R.same_structure(R.row_columns(rows, {0: "a", 9: "z"}), R.table_pivot(R.parse_texts(docs, kinds={"TableCell"}), {0: "a", 9: "z"}))
    shapes = R.parse_blocks(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "kind", "depth"))), lambda x: F.concat(x["kind"], x["depth"].cast("string"))), ",").alias("shape"))
    assert R.same_structure(R.parse_shapes(docs), shapes)
    blocks = R.parse_blocks(docs, kinds={"Table"}, columns=("columns", "doc_id"))
    assert R.same_structure(blocks, R.parse_blocks(docs).where("kind = 'Table'").select("columns", "doc_id"))


#: Of queries over order reports: crossings into Python, shuffles and joins above them, columns that leave the kernel.
PLANS = {
    "md_table_align": (1, 1, 0, 1),
    "md_emphasis": (1, 0, 0, 2),
    "md_strong": (1, 1, 0, 2),
    "md_tables": (1, 0, 0, 3),
    "md_near_dup_outline": (1, 1, 0, 2),
    "md_order_reports": (1, 2, 1, 4),
    "md_window_top_rows": (1, 1, 0, 5),
    "md_task_rate": (1, 2, 1, 3),
    "md_table_pivot": (1, 0, 0, 5),
    "md_headings": (1, 0, 0, 3),
    "md_tasks": (1, 1, 0, 3),
}


@pytest.mark.parametrize("name", PLANS)
def test_nothing_is_parsed_twice_or_joined_to_itself(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    above = plan[0]
    columns = plan[1].partition("[")[2].partition("]")[0].count("#") if len(plan) > 1 else 0
    assert (len(plan) - 1, above.count("Exchange"), above.count("Join"), columns) == PLANS[name]


def test_table_functions_give_the_relations(spark):
    """And not by an Arrow batch for each call: a small table's rows are dealt to all cores and pickled."""
    sql.register(spark)
    docs = spark.createDataFrame([*enumerate([*TABLES, "- ```x\n  a\n\tb\n  ```\n\n[l]: /u 't'\n\n[l] **b**", None])], "doc_id long, text string")
    docs.createOrReplaceTempView("scale_docs")
    for name, parsed in (("blocks", R.parse_blocks(docs)), ("inlines", R.parse_inlines(docs)), ("link_defs", R.parse_link_defs(docs)), ("texts", R.parse_texts(docs))):
        got = spark.sql(f"select f.* from scale_docs d, lateral md_{name}(d.doc_id, d.text, 'gfm') f")
        assert R.same_structure(got, parsed) and got.schema == parsed.schema
    plan = catalogue.QUERIES["md_sql_names"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" not in plan and "RoundRobinPartitioning" in plan.partition("PythonUDTF")[2]


@pytest.mark.parametrize("text", TABLES[:3])
def test_rendering_makes_no_blocks_of_a_table(text):
    doc = parse(text)
    assert to_html(doc) == to_html(_made(text)) and all(b.made is None for b in doc.blocks if b.kind == "Table")


LISTS = [*ITEMS, "- a\n- b\n- c", "- [x] a\n- [ ] b\n- c\n\nd", "- a\n- b\n+ c\n- d\n1. e", "- a\n- b\nlazy\n- c", "- a\n- b\n  - [x] c\n- d", "- a\n- b\n\n- c\n- d\n# e\n- f", "x[^a]\n- *a*[^a]\n- b[^b]\n\n[^b]: c\n[^a]: d", "> - a\n> - [x] b\n\n- c\n- d\n\n  > - [ ] e"]


@pytest.mark.parametrize("text", LISTS)
@pytest.mark.parametrize("dialect", ["gfm", "commonmark"])
def test_lists_that_are_not_made_give_what_their_blocks_give(text, dialect, monkeypatch):
    options = block.Options(dialect)
    none = frozenset()
    doc, made = parse(text, options, none), parse(text, options, none)
    block_rows(made)  # makes them
    for only in (None, frozenset({"ListItem"}), frozenset({"Paragraph"}), frozenset({"TableRow"})):
        for rows in (block_tuples, lambda n, o: block_tuples(n, o, True), text_tuples, item_tuples):
            assert rows(Nodes(doc), only) == rows(Nodes(made), only)
    assert shape_of(Nodes(doc)) == shape_of(Nodes(made)) and task_counts(doc) == task_counts(made)
    html = to_html(parse(text, options))
    marked = inline_tuples(Nodes(parse(text, options, None, R._DELIMITER)), None, frozenset({"Italic"}), R._DELIMITER)
    monkeypatch.setattr(block, "_PLAIN_ITEM", block.re.compile(r"(?!)"))
    stacked = parse(text, options, none)
    assert block_tuples(Nodes(doc)) == block_tuples(Nodes(stacked)) and task_counts(doc) == task_counts(stacked) and html == to_html(parse(text, options))
    assert marked == inline_tuples(Nodes(parse(text, options, None, R._DELIMITER)), None, frozenset({"Italic"}), R._DELIMITER)


def test_items_are_made_only_where_they_are_asked_for():
    lists = [b for b in parse("- a\n- [x] b\n- c\n", inline=frozenset({"TableCell"})).blocks if b.kind == "UnorderedList"]
    assert [(b.made, b.tasks, b.sources, b.rest) for b in lists] == [(None, [None, "checked", None], ["a", "b", "c"], [])]


@pytest.mark.parametrize("text", [*TABLES, "# a | b\n| - | - |\nc", "p\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n| 4 | 5 | 6 |", "| a |\n| b |", "p\n# h\nq\n## \n#x\n#", "|\n|-|", "- a\n# h\n| a |\n|---|", "| a |\n|---|\n| b  |\n|  c |", "| a |\n|---|\n| \u00e9 |\n| x_y |"])
@pytest.mark.parametrize("dialect", ["gfm", "commonmark"])
def test_headings_and_tables_at_the_margin_are_read_as_the_stack_reads_them(text, dialect, monkeypatch):
    options = block.Options(dialect)
    tidy = [r[-2] for r in item_tuples(Nodes(parse(text, options)))]
    got = to_html(parse(text, options)), block_tuples(Nodes(parse(text, options)))
    monkeypatch.setattr(block, "_TIDY", block.re.compile(r"(?!)"))
    assert tidy == [r[-2] for r in item_tuples(Nodes(parse(text, options)))]
    indented = "\n".join(f" {x}" if x[:1] in ("#", "|") else x for x in text.split("\n"))  # no margin: by the stack
    assert got == (to_html(parse(indented, options)), block_tuples(Nodes(parse(indented, options))))


def test_counts_of_tasks_are_what_grouping_gives(spark):
    docs = spark.createDataFrame([*enumerate([*LISTS, *TABLES, "", None])], "doc_id long, text string").cache()
    want = R.tasks(R.parse_blocks(docs)).groupBy("doc_id").agg(F.count("*").alias("tasks"), F.count_if("checked").alias("checked"))
    assert R.same_structure(R.parse_task_counts(docs), want)
    twice = docs.unionByName(docs).select(F.col("doc_id").alias("k"), "text")
    assert R.same_structure(R.parse_task_counts(twice, id_col="k"), want.unionByName(want))


def test_lines_are_gathered_once_and_in_order(spark):
    """Dealt by order before they are gathered: no partial lists are sorted and shuffled."""
    from folio.sources import compose

    lines = compose.order_lines(spark, SF)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan.partition("Exchange")[2] and plan.count("Exchange") == 1
    assert lines.where(~F.expr("items <=> array_sort(items)")).isEmpty() and lines.agg(F.sum(F.size("items"))).first()[0] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
