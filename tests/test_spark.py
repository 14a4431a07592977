"""The Spark side: relations, native functions, SQL names, streams, files, and every query's oracle."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folio.functions import native, sql
from folio.kernel import lexer as lx
from folio.kernel import parse
from folio.operators import relations as R
from folio.plans import catalogue
from folio.sources import files
from folio.streaming import documents as streaming

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(df):
    def plain(x):
        if x is None or (not isinstance(x, list | dict) and pd.isna(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x == int(x) else x

    return sorted(map(repr, (tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_its_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
    else:
        assert len(got)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["doc_id", "status", "table_rows", "ticked", "quantity"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "# a", "y"), (3, "b", "z"), (3, "b", "z")], "doc_id long, text string, kind string")
    assert sorted((r.doc_id or 0, r.kind) for r in R.parse_blocks(docs).collect()) == [(0, "Heading"), (3, "Paragraph"), (3, "Paragraph")]
    assert sorted((r.doc_id or 0, r.html) for r in R.render_html(docs).where("doc_id is null or doc_id < 3").collect()) == [(0, "<h1>a</h1>\n"), (1, None), (2, "")]
    assert R.parse_blocks(docs.limit(0)).count() == 0


def test_texts_are_what_the_joins_give(spark):
    from folio.sources import compose

    for docs in (compose.ragged_tables(spark, SF), compose.region_chapters(spark, SF), compose.order_reports(spark, SF).limit(50)):
        docs = docs.cache()
        blocks, inlines, texts = R.parse_blocks(docs), R.parse_inlines(docs), R.parse_texts(docs)
        assert R.same_structure(R.headings(blocks, inlines), texts.where("kind = 'Heading'").select("doc_id", "node_id", "level", "text"))
        cells = texts.where("kind = 'TableCell'").select("doc_id", "table_id", "row_no", "col_no", "align", "text")
        assert R.same_structure(R.table_cells(blocks, inlines), cells)


def test_native_line_functions_agree_with_the_kernel(spark):
    lines = [*catalogue._LINES, "  \t x", "> q", "    - a", "***a", "- ", "-\tb", "10) x", "`` ` ``", "~~~", "#\tq", "# a # b ##", "+ + +", "_ _ _", "1.", "1.x", "  # in", "=", "= ="]
    cols = {
        "blank": native.is_blank("t"), "shallow": native.has_shallow_indent("t"), "spaces": native.leading_spaces("t"), "cols": native.leading_columns("t"), "fence": native.opens_fence("t"), "rule": native.is_rule("t"),
        "level": native.heading_level("t"), "head": native.heading_text("t"), "marker": native.list_marker("t"), "setext": native.setext_level("t"), "begins": native.begins_block("t"), "content": native.content_column("t"),
    }
    for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", *(c.alias(k) for k, c in cols.items())).collect():
        n = lx.indent_of(r.t)
        body = r.t[n:] if n is not None else None
        assert (r.blank, r.shallow, r.spaces, r.cols) == (lx.is_blank(r.t), n is not None, lx.spaces(r.t), lx.columns(r.t)), r.t
        if body is None:
            assert not (r.fence or r.rule or r.level or r.marker or r.setext)
            continue
        m = lx.marker(body) if not lx.is_rule(body) else None
        assert (r.fence, r.rule) == (lx.fence(body) is not None, lx.is_rule(body)), r.t
        assert (r.level, r.head) == (lx.atx(body) or (None, None)), r.t
        assert r.marker == (body[: m.width] if m else None) and r.setext == lx.setext(body), r.t
        assert r.begins == (lx.begins_block(body) or lx.is_blank(r.t)), r.t
        if m and "\t" not in r.t:
            assert r.content == m.content_column(n, body[m.width :]), r.t


def test_native_escapes(spark):
    df = spark.createDataFrame([("\ta\n      b", 'x & <"y">', "| a \\| b | c |", " a ")], "c string, e string, r string, s string")
    r = df.select(native.strip_code_indent("c"), native.escape_html("e"), native.split_row("r"), native.escape_code_span("s"), native.strip_columns(F.lit("\tq"), 2), native.alignment(F.lit(":-:")), native.same_family(F.lit("1."), F.lit("23.")), native.closes_fence(F.lit(" ```` "), F.lit("```")), native.info_string(F.lit("``` a b ")), native.list_delimiter(F.lit("3)")), native.could_start_block(F.lit("x")), native.may_have_url(F.lit("a://b")), native.has_inline_syntax(F.lit("plain"))).first()
    assert tuple(r) == ("a\n  b", "x &amp; &lt;&quot;y&quot;&gt;", ["a \\| b", "c"], "a", "  q", "center", True, True, "a b", ")", False, True, False)


def test_filters_and_columns_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 5")
    plan = R.parse_blocks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_sql_names(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "# Hi\n\n[a]: /b\n\n[a]")], "doc_id long, text string").createOrReplaceTempView("d")
    assert spark.sql("select md_to_html(text, 'gfm') from d").first()[0] == '<h1>Hi</h1>\n<p><a href="/b">a</a></p>\n'
    assert [r.kind for r in spark.sql("select b.kind from d, lateral md_blocks(d.doc_id, d.text, 'gfm') b order by node_id").collect()] == ["Heading", "Paragraph"]
    assert spark.sql("select count(*) from d, lateral md_link_defs(d.doc_id, d.text, 'gfm')").first()[0] == 1
    r = spark.sql("select md_label_norm(' A  b '), md_decode_entities('&lt;'), md_href('a b'), md_escape_text('&amp;<'), md_link_title('\\\\\"x'), md_footnote_id('a b'), md_autolink_href('[')").first()
    assert tuple(r) == ("a b", "<", "a%20b", "&amp;&lt;", "&quot;x", "a%20b", "%5B")


def test_sql_names_of_native_functions(spark):
    sql.register(spark)
    r = spark.sql(r"select md_normalize('a\r\nb\rc'), md_is_blank(' \t'), md_is_hr(' * * *'), md_is_hr('--'), md_heading_level('### x'), md_heading_level('x'), md_task_state('[x] a'), md_task_state('a'), md_escape_html('<\"&>')").first()
    assert tuple(r) == ("a\nb\nc", True, True, False, 3, None, "checked", None, "&lt;&quot;&amp;&gt;")


def test_footnotes_numbered_by_windows(spark):
    docs = spark.createDataFrame([(1, "[^b] [^a] [^b]\n\n[^a]: x [^c]\n[^b]: y\n[^c]: z\n"), (2, "none"), (3, "[^a][^a]\n\n[^a]: q")], "doc_id long, text string")
    refs = R.parse_inlines(docs, kinds={"FootnoteRef"}).select("doc_id", "inline_id", "fn_label", "fn_number", "fn_occurrence")
    assert refs.count() == 6 and R.same_structure(refs, R.number_footnotes(refs.drop("fn_number", "fn_occurrence")).select(refs.columns))


def test_files_and_relations_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\r\n\r\ntext\rmore\r\n")
    docs = files.read_markdown(spark, f"{tmp_path}/*.md")
    assert docs.first().text == "# A\n\ntext\nmore\n"
    blocks = R.parse_blocks(docs)
    files.write_relations(blocks, f"{tmp_path}/out", 2)
    assert R.same_structure(blocks, spark.read.parquet(f"{tmp_path}/out"))
    files.write_html(R.render_html(docs), f"{tmp_path}/html")
    assert spark.read.parquet(f"{tmp_path}/html").first().html.startswith("<h1>A</h1>")
    assert files.read_documents(spark, f"{SF}/documents.parquet").columns == ["doc_id", "text"]


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    docs = spark.createDataFrame([(i, f"# H{i}\n\ntext *x*") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(src)
    q = streaming.write_stream(streaming.parsed_stream(streaming.read_stream(spark, src)), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert R.same_structure(spark.read.parquet(f"{tmp_path}/out"), R.parse_blocks(docs))
    counted = streaming.kind_counts(streaming.parsed_stream(streaming.read_stream(spark, src))).writeStream.format("memory").queryName("kinds").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(60)
    assert {r.kind: r.n for r in spark.table("kinds").collect()} == {"Heading": 20, "Paragraph": 20}


def test_words_of_documents_with_markup(spark, tmp_path):
    rows = [(1, "*a* **b c**"), (2, 'see [the link](http://x "t") now'), (3, "`code x` &amp; y \\[z"), (4, "- one two\n- three\n"), (5, ""), (6, "plain\twords here"), (7, None), (8, "# A head!\n\n| a | b c |\n|---|---|\n| d | ~~e~~ |\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.words for r in catalogue.QUERIES["md_word_count_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 4, 3: 5, 4: 3, 5: 0, 6: 3, 7: 0, 8: 7}


def test_every_native_sql_name_gives_what_the_function_gives(spark):
    sql.register(spark)
    lines = [*catalogue._LINES, "'quoted' \\ back", "ΣΣ ß x", "`` ` ``", "| a \\| b | c\\\\| d |", "www.x"]
    spark.createDataFrame([(x,) for x in lines], "x string").createOrReplaceTempView("native_lines")
    own = {**sql.NATIVE, "md_leading_columns": native.leading_columns, "md_split_row": native.split_row, "md_label_key": native.label_norm}
    assert set(own) == {*sql.NATIVE, *sql.HIGHER_ORDER}
    want = spark.table("native_lines").select("x", *(f("x").alias(k) for k, f in own.items())).collect()
    got = spark.sql(f"select x, {', '.join(f'{k}(x) as {k}' for k in own)} from native_lines").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_walks_and_ancestors_follow_the_tree(spark):
    text = "> - a\n>   1. b\n>\n>      c\n> - d\n\n# e\n\n| x | y |\n|---|---|\n| 1 | 2 |\n"
    docs = spark.createDataFrame([(1, text), (2, "f\n\n- g"), (3, "")], "doc_id long, text string")
    blocks = R.parse_blocks(docs, more=True).cache()
    want = []

    def visit(doc_id, nodes):
        for b in nodes:
            want.append((doc_id, "enter", b.kind))
            visit(doc_id, b.children)
            want.append((doc_id, "leave", b.kind))

    for i, t in ((1, text), (2, "f\n\n- g")):
        visit(i, parse(t).blocks)
    got = R.walk(blocks).orderBy("doc_id", "step").collect()
    assert [(r.doc_id, r.event, r.kind) for r in got] == want
    assert [r.step for r in got if r.doc_id == 1] == list(range(2 * blocks.where("doc_id = 1").count()))
    plain = blocks.drop("ancestors", "text")
    assert R.same_structure(R.descendants(blocks).select("doc_id", "node_id", "kind", "below_id", "below_kind"), R.descendants(plain).select("doc_id", "node_id", "kind", "below_id", "below_kind"))
    assert R.same_structure(R.ancestors(blocks, blocks), R.ancestors(plain, plain))
    assert sorted((r.doc_id, r.kind, r.text) for r in blocks.where("text is not null").collect()) == [(1, "Heading", "e"), (1, "Paragraph", "a"), (1, "Paragraph", "b"), (1, "Paragraph", "c"), (1, "Paragraph", "d"), *((1, "TableCell", x) for x in "12xy"), (2, "Paragraph", "f"), (2, "Paragraph", "g")]


def test_dealing_a_table_runs_nothing(spark):
    """Of one small file all cores get a part; nothing is run to find that out, above a join neither."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    joined = docs.join(docs.groupBy("doc_id").count().hint("merge"), "doc_id")
    spark.sparkContext.setJobGroup("spread", "planning only")
    try:
        dealt, same = R.spread(docs), R.spread(joined)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and same.columns == joined.columns
