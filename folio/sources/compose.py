"""Markdown documents composed of star-schema tables: known structure, so that queries have an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey with its line items, sorted: ``items`` of (line, part, supp, qty, flag).

    Lines are dealt by order first: few of an order stand in one file, and gathering them there would only sort them once more.
    """
    li = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag")).alias("i"),
    )
    return li.repartition("o_orderkey").groupBy("o_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per order: heading, a bold status and an italic priority, a table of its lines, a task for each."""
    rows = "array_join(transform(items, i -> concat('| ', i.line, ' | ', i.part, ' | ', i.supp, ' | ', i.qty, ' |')), '\\n')"
    todo = "array_join(transform(items, i -> concat('- [', if(i.flag = 'R', 'x', ' '), '] line ', i.line)), '\\n')"
    body = F.expr(f"if(items is null, '', concat('\\n| line | part | supp | qty |\\n| ---: | :--- | :---: | --- |\\n', {rows}, '\\n\\n', {todo}, '\\n'))")
    head = F.concat(F.lit("# Order "), "o_orderkey", F.lit("\n\nStatus **"), "o_orderstatus", F.lit("** and *"), "o_orderpriority", F.lit("* priority\n"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(order_lines(spark, sf_dir), "o_orderkey", "left").select(F.col("o_orderkey").cast("long").alias("doc_id"), F.concat(head, body).alias("text"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document: regions as an ordered list from 3, nations as bullets within, loose for region 0."""
    nations = _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    per = _t(spark, sf_dir, "region").join(nations, "r_regionkey").select(
        "r_regionkey", F.concat((F.col("r_regionkey") + 3).cast("string"), F.lit(") "), "r_name", F.lit("\n"), F.expr("array_join(transform(n, x -> concat('   - ', x)), if(r_regionkey = 0, '\\n\\n', '\\n'))")).alias("t")
    )
    return per.groupBy().agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "t"))).alias("l")).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.expr("array_join(transform(l, x -> x.t), '\\n')"), F.lit("\n")).alias("text"))


def region_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per region: a setext title, a rule, a section with a paragraph of two lines per nation."""
    part = F.concat(F.lit("## "), "n_name", F.lit("\n\nNation "), F.col("n_nationkey").cast("string"), F.lit("\nof the region\n\n***\n\n"))
    nations = _t(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", part.alias("t")).alias("s")).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("s")).alias("l"))
    return _t(spark, sf_dir, "region").join(nations, "r_regionkey").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat("r_name", F.lit("\n====\n\n"), F.expr("array_join(transform(l, x -> x.t), '')")).alias("text"))


def customer_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert per customer, its kind by nation, every second one titled; within it a quote with a list."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("NOTE", "Tip", "important", "WARNING", "Caution")]), F.col("c_nationkey") % 5 + 1)
    title = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise("")
    text = F.concat(F.lit("> [!"), kind, F.lit("]"), title, F.lit("\n> Customer "), "c_name", F.lit("\nlazily continued\n>\n> > deeper\n> > - item\n"))
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), text.alias("text"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per user: events' properties as a fenced block, their count as indented code."""
    lines = _t(spark, sf_dir, "events").where("props is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("l"))
    return lines.select(
        F.col("user_id").cast("long").alias("doc_id"), F.concat(F.lit("```json log\n"), F.expr("array_join(transform(l, x -> x.props), '\\n')"), F.lit("\n```\n\ncounted\n\n    n = "), F.expr("size(l)").cast("string"), F.lit("\n")).alias("text")
    )


def supplier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per nation: a reference link per supplier (every fifth undefined), definitions twice, addresses."""
    s = _t(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"),
        F.struct("s_suppkey", F.concat(F.lit("["), "s_name", F.lit("][S "), "s_suppkey", F.lit("] and www.s"), "s_suppkey", F.lit(".example.com or s"), "s_suppkey", F.lit("@example.com\n")).alias("t")).alias("x"),
        F.struct("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("[s  "), "s_suppkey", F.lit("]: /supp/"), "s_suppkey", F.lit(' "T'), "s_suppkey", F.lit('"\n[S '), "s_suppkey", F.lit("]: /late\n"))).otherwise("").alias("d")).alias("y"),
    )
    per = s.groupBy("n_nationkey").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.array_sort(F.collect_list("y")).alias("ys"))
    return per.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.expr("array_join(transform(xs, x -> x.t), '')"), F.lit("\n"), F.expr("array_join(transform(ys, y -> y.d), '')")).alias("text"))


def order_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer with orders: a reference per order (the first one twice), definitions in reverse, one unused."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    refs = "array_join(transform(k, x -> concat('order[^o', x, ']')), ' ')"
    notes = "array_join(transform(reverse(k), x -> concat('[^o', x, ']: note ', x)), '\\n')"
    return o.select(F.col("o_custkey").cast("long").alias("doc_id"), F.expr(f"concat({refs}, ' again[^o', k[0], ']\\n\\n', {notes}, '\\n[^unused]: never\\n')").alias("text"))


def part_zoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per part with one of each inline construct."""
    text = F.concat(
        F.lit("`"), "p_name", F.lit("` ~~"), "p_brand", F.lit("~~ **"), "p_type", F.lit("** *size "), F.col("p_size").cast("string"), F.lit("* \\*esc\\* &amp; &copy; &#35;\\\n[site](http://x"), "p_partkey",
        F.lit('.example/a?b=1&c "T") ![pic '), "p_partkey", F.lit("](/img/"), "p_partkey", F.lit(".png) <https://a.example/"), "p_partkey", F.lit("> <b>raw</b> <script>\n\n<div>\nblock <style>\n</div>\n\n<title>x</title>\n"),
    )
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), text.alias("text"))


def ragged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per nation whose body rows have too few, or too many cells."""
    text = F.concat(F.lit("| a | b | c |\n|:--|--:|:-:|\n| "), "n_name", F.lit(" |\n| 1 | 2 | 3 | 4 | 5 |\n| x \\| y | `p\\|q` | |\n"))
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
