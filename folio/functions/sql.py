"""SQL names: scalar functions and table functions over the kernel.

``register(spark)`` makes available the native line functions and escapes (``md_is_blank``,
``md_line_kind``, ``md_heading_level``, ... see NATIVE), then ``md_to_html(text, dialect)``, ``md_label_norm``,
``md_decode_entities``, ``md_href`` and ``md_link_title`` as Arrow-batched scalars, and ``md_blocks``,
``md_inlines``, ``md_link_defs`` and ``md_texts`` as table functions, for use with LATERAL. Their rows are pickled:
an Arrow batch for each call costs more than it carries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from folio.functions import native
from folio.kernel import html as rendering
from folio.kernel import lexer as lx
from folio.kernel.block import Options, parse
from folio.operators import relations
from folio.session import ship


def _each(f):
    return lambda s: s.map(f, na_action="ignore")


@pandas_udf(T.StringType())
def md_to_html(text: pd.Series, dialect: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else rendering.to_html(parse(t, Options(d))) for t, d in zip(text, dialect, strict=True)], dtype=object)


@pandas_udf(T.StringType())
def md_label_norm(label: pd.Series) -> pd.Series:
    return _each(lx.label_key)(label)


@pandas_udf(T.StringType())
def md_decode_entities(text: pd.Series) -> pd.Series:
    return _each(lx.decode_entities)(text)


@pandas_udf(T.StringType())
def md_href(url: pd.Series) -> pd.Series:
    return _each(rendering.href)(url)


@pandas_udf(T.StringType())
def md_autolink_href(url: pd.Series) -> pd.Series:
    return _each(rendering.link_target)(url)


@pandas_udf(T.StringType())
def md_escape_text(text: pd.Series) -> pd.Series:
    return _each(rendering.escape_text)(text)


@pandas_udf(T.StringType())
def md_link_title(text: pd.Series) -> pd.Series:
    return _each(rendering.title)(text)


@pandas_udf(T.StringType())
def md_footnote_id(label: pd.Series) -> pd.Series:
    return _each(rendering.note_id)(label)


SCALARS = (md_to_html, md_label_norm, md_decode_entities, md_href, md_autolink_href, md_escape_text, md_link_title, md_footnote_id)


def _table_function(relation: str):
    """A table function: each call gives the rows of one document."""

    class Rows:
        def eval(self, doc_id: int, text: str, dialect: str):
            if text is not None:
                yield from relations._kernel(relation, Options(dialect), None)(doc_id, text)

    Rows.__name__ = f"Md{relation.title().replace('_', '')}"
    return udtf(Rows, returnType=relations.SCHEMAS[relation], useArrow=False)


#: Native line functions by SQL name. Their expressions become the bodies of SQL functions, inlined into the query.
NATIVE = {
    "md_normalize": native.normalize, "md_is_blank": native.is_blank, "md_shallow_indent": native.has_shallow_indent, "md_leading_spaces": native.leading_spaces, "md_opens_fence": native.opens_fence,
    "md_fence_mark": native.fence_mark, "md_info_string": native.info_string, "md_is_hr": native.is_rule, "md_heading_level": native.heading_level, "md_heading_text": native.heading_text,
    "md_list_marker": native.list_marker, "md_list_delimiter": native.list_delimiter, "md_content_column": native.content_column, "md_setext_level": native.setext_level, "md_begins_block": native.begins_block,
    "md_could_start_block": native.could_start_block, "md_opens_html": native.opens_html, "md_delimiter_columns": native.delimiter_columns, "md_alignment": native.alignment, "md_task_state": native.task_state,
    "md_alert_kind": native.alert_kind, "md_line_kind": native.line_kind, "md_escape_html": native.escape_html, "md_escape_code_span": native.escape_code_span, "md_strip_code_indent": native.strip_code_indent,
    "md_cell_literal": native.cell_literal, "md_filter_tags": native.filter_tags, "md_autolink_prefix": native.autolink_prefix, "md_may_have_url": native.may_have_url, "md_has_inline_syntax": native.has_inline_syntax,
}
#: Those of higher-order functions, whose text Spark doesn't give back: name to type and body.
HIGHER_ORDER = {
    "md_leading_columns": ("int", r"aggregate(split(regexp_extract(x, r'^([ \t]*)', 1), ''), 0, (n, c) -> case c when '\t' then n + 4 - n % 4 when ' ' then n + 1 else n end)"),
    "md_split_row": ("array<string>", r"transform(split(regexp_replace(trim(x), r'^\||\|\z', ''), r'(?<=(?<!\\)(?:\\\\){0,100})\|', -1), c -> trim(c))"),
    "md_label_key": ("string", f"replace(array_join(transform(regexp_extract_all(regexp_replace(regexp_replace(x, r'[{native._BLANKS}]+', ' '), r'^ | \\z', ''), '(?s).', 0), c -> lower(c)), ''), 'ß', 'ss')"),
}


def _sql_of(spark: SparkSession, f) -> tuple[str, str]:
    """(type, SQL text) of a native function of a string column x."""
    one = spark.createDataFrame([], "x string").select(f("x").alias("y"))
    expression = one._jdf.queryExecution().analyzed().expressions().head().child()
    return one.schema["y"].dataType.simpleString(), expression.sql()


def register(spark: SparkSession) -> None:
    ship(spark)
    bodies = {name: _sql_of(spark, f) for name, f in NATIVE.items()} | HIGHER_ORDER
    for name, (kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns {kind} return {body}")
    for f in SCALARS:
        spark.udf.register(f.__name__, f)
    for relation in ("blocks", "inlines", "link_defs", "texts"):
        spark.udtf.register(f"md_{relation}", _table_function(relation))


def to_html(column: str, dialect: str = "gfm"):
    """``md_to_html`` as a column."""
    return md_to_html(F.col(column), F.lit(dialect))
