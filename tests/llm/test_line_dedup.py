"""Line dedup on a small site each."""

from skyseries.llm import line_dedup as L

SCHEMA = "doc_id bigint, source string, text string"


def cleaned(spark, rows, schema=SCHEMA, **options):
    return {r.doc_id: r for r in L.without_boilerplate(spark.createDataFrame(rows, schema), count_col="gone", **options).collect()}


def test_a_line_goes_where_its_share_of_the_host_is_large(spark):
    rows = [(i, "a", f"own {i}\nmenu\n  menu \nmenu") for i in range(5)] + [(10 + i, "a", f"other {i}") for i in range(20)]
    rows += [(100 + i, "b", f"menu\nown {i}" if i < 4 else f"own {i}") for i in range(60)]
    found = cleaned(spark, rows)
    assert [(found[i].text, found[i].gone) for i in range(5)] == [(f"own {i}", 3) for i in range(5)]
    assert found[100].text == "menu\nown 0" and found[100].gone == 0


def test_too_few_pages_or_exactly_the_ratio(spark):
    rows = [(i, "a", "menu\nx") for i in range(3)] + [(10 + i, "b", "menu" if i < 4 else f"own {i}") for i in range(40)]
    found = cleaned(spark, rows)
    assert found[0].text == "menu\nx" and found[10].text == "menu"


def test_nulls_blank_lines_and_repeated_rows(spark):
    rows = [(i, None, "\n\nmenu\n\n") for i in range(6)] + [(6, None, None), (7, "a", ""), (8, None, "\n")] + [(9, "c", "copy\ncopy")] * 4
    found = L.without_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in found if r.text is not None) == sorted([(i, "\n\n\n") for i in range(6)] + [(7, ""), (8, "\n")] + [(9, "")] * 4)
    assert [r.doc_id for r in found if r.text is None] == [6]


def test_columns_with_the_names_used_inside(spark):
    rows = [(i, "a", f"menu\nown {i}", 1, 2, 3) for i in range(6)]
    schema = SCHEMA + ", _host int, _boilerplate int, host int"
    df = spark.createDataFrame(rows, schema)
    out = L.without_boilerplate(df)
    assert out.columns == df.columns
    assert sorted(r.text for r in out.collect()) == [f"own {i}" for i in range(6)]
    assert L.without_boilerplate(df.limit(0)).collect() == []


SENTENCE = "This line of some words is no chance."
LONG_LINE = " ".join(f"word{i}" for i in range(40))


def test_longer_lines_go_at_smaller_shares(spark):
    own = lambda i: f"own text {i} which is the longest line of all on its page {i}{i}"
    rows = [(i, "a", f"{own(i)}\n{SENTENCE}\nLes.") for i in range(6)] + [(100 + i, "a", own(i)) for i in range(400)]
    found = cleaned(spark, rows)
    # Six of 406 pages hold it; the short line is left, as it is below a tenth.
    assert found[0].text == f"{own(0)}\nLes." and found[0].gone == 1
    assert cleaned(spark, rows, longer={})[0].gone == 0
    few = [(i, "a", f"{i}{LONG_LINE}{i}{i}\n{LONG_LINE}\n{SENTENCE}") for i in range(4)] + [(100 + i, "a", own(i)) for i in range(600)]
    assert cleaned(spark, few)[1].text == f"1{LONG_LINE}11\n{SENTENCE}"


def test_sentences_of_copies_are_no_boilerplate(spark):
    page = f"{SENTENCE}\n{LONG_LINE}\nthe end of the page, with words"
    rows = [(i, "a", page if i % 2 else page + f"\nno {i}") for i in range(40)] + [(100 + i, "a", f"own {i}") for i in range(800)]
    assert cleaned(spark, rows)[1].text == page
    # Beyond a tenth of the host even those go.
    assert cleaned(spark, rows[:200])[1].text == ""
