from folio.llm import line_dedup

from tests.llm.conftest import ODD


def _brute(rows, width=3):
    """Texts after removal, by (doc_id, text)."""
    seen, out = set(), {}
    for doc_id, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(full) - width + 1):
            w = tuple(lines[i] for i in full[k : k + width])
            if w in seen:
                gone |= set(range(full[k], full[k + width - 1] + 1))
            else:
                seen.add(w)
        # blank lines between two removed lines that follow each other
        for a, b in zip(full, full[1:], strict=False):
            if a in gone and b in gone:
                gone |= set(range(a, b))
        out[doc_id, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = _brute(rows)
    for r in line_dedup.line_dedup(documents.withColumnRenamed("n_chars", "n_lines")).collect():
        assert r.text == want[r.doc_id, dict(rows)[r.doc_id]]


def test_merged_windows_and_blank_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\na\n\nb\nc\nd\n\ny"), (3, "a\nb"), (4, "q\nq\nq\nq\nq\nend")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: ("a\nb\nc\nd\ne", 0), 2: ("x\n\ny", 4), 3: ("a\nb", 0), 4: ("q\nend", 4)}


def test_no_python_on_the_main_path(spark, documents):
    plan = line_dedup.line_dedup(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd, none):
    got = line_dedup.line_dedup(odd).collect()
    assert len(got) == len(ODD) and set(odd.columns) <= set(got[0].asDict())
    texts = sorted((r.doc_id, r.text) for r in got if r.doc_id in (1, 2, 3, 4, 5) and r.text is not None)
    assert texts == sorted([(1, ODD[0][1]), (2, "Zero\nlast of them"), (2, "Zero\nlast of them"), (4, ""), (5, " \n\t \n"), (2, "another text under a used id")])
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert line_dedup.line_dedup(none).count() == 0
