"""Text extracts with awkward values, and vocabularies without a cut."""

from pyspark.sql import types as T

from sentria.operators import nested, vocab
from sentria.sources import extract

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def test_quotes_backslashes_and_separators(spark, tmp_path):
    (tmp_path / "t.txt").write_text('1$"say ""hi"" $ there"$x\n2$"back\\"$y\n3$NA\n4$p$q$too many\nword$r$s\n')
    t = extract.read_extract(spark, str(tmp_path), {"t": SCHEMA}, corrupt="bad")["t"].collect()
    by = {r.id: r for r in t}
    assert (by[1].a, by[1].b) == ('say "hi" $ there', "x")
    assert (by[2].a, by[2].b) == ("back\\", "y")
    assert (by[3].a, by[3].b) == (None, "")
    assert by[4].bad == "4$p$q$too many" and by[None].bad == "word$r$s" and by[1].bad in ("", None)


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "t.txt").write_text('1$"one\ntwo"$x\n2$c$d\n')
    t = extract.read_extract(spark, str(tmp_path), {"t": SCHEMA}, multi_line=True)["t"].orderBy("id").collect()
    assert [(r.id, r.a, r.b) for r in t] == [(1, "one\ntwo", "x"), (2, "c", "d")]


def test_hierarchy_keeps_blanks(spark, tmp_path):
    (tmp_path / "h.asc").write_text("1$2$3$4$pt$hlt$hlgt$soc$ab$$5$Y$\n1$2$3$4$$hlt$hlgt$soc$ab$$5$Y$\n")
    rows = extract.read_hierarchy(spark, str(tmp_path / "h.asc"), "v").orderBy("PT_Term").collect()
    assert [r.PT_Term for r in rows] == ["", "pt"]


def test_vocabularies_are_whole(spark):
    names = [f"name {k:05d}" for k in range(1500)]
    t = spark.createDataFrame([(n,) for n in [*names, "bad\x07name", " ", None]], "n string")
    assert [r.term for r in vocab.vocabulary(t, "n", clean=True).collect()] == names
    assert vocab.vocabulary(t, "n").count() == 1502
    docs = spark.createDataFrame([([n],) for n in [*names, "a,b"]], "terms array<string>")
    assert [r.term for r in nested.nested_vocabulary(docs, "terms").collect()] == names
    assert nested.nested_vocabulary(docs, "terms", k=10).count() <= 10
