"""Records with quoted line breaks, in splits of every size, against the reader that takes a file in one task."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.sources import extract
from sentria.sources.records import ends_open, read_records

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])


@pytest.fixture
def splits(spark):
    """Reads with splits of a given size."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, size)

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


def _text(seed, rows=400, end="\n"):
    rng = random.Random(seed)
    words = ["plain", "", " spaced ", "a 5\" pipe", "\\", "Ünï", "#x", "NA"]
    quoted = ['"one line"', f'"two{end}lines"', '"a ""word"" here"', f'"$ and {end}{end} blank"', '""', f'"{end}"', f' "led{end}by blanks"',
              '"long ' + end.join(f"line {k}" for k in range(12)) + '"']
    field = lambda: rng.choice(words) if rng.random() < 0.75 else rng.choice(quoted)
    lines = []
    for k in range(rows):
        lines.append(f"{k}${field()}${field()}")
        if rng.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if seed % 2 else "")


OPTIONS = {"sep": "$", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}


def _rows(t):
    return sorted(tuple(r) for r in t.na.fill("", ["b", "c"]).collect())


@pytest.mark.parametrize("size", [37, 400, 5000, 1 << 27])
def test_same_rows_as_one_task(spark, splits, tmp_path, size):
    for seed in (1, 2):
        (tmp_path / f"{seed}.txt").write_text(_text(seed, 40 if size < 100 else 250))
    whole = _rows(spark.read.schema(SCHEMA).options(**OPTIONS).option("multiLine", True).csv(str(tmp_path)))
    splits(size)
    records = read_records(spark, str(tmp_path))
    parsed = records.select(F.from_csv("value", F.lit(SCHEMA.toDDL()), OPTIONS).alias("r")).select("r.*")
    assert _rows(parsed) == whole


def test_extract_with_line_breaks(spark, splits, tmp_path):
    (tmp_path / "reports.txt").write_text('1$"first\nsecond"$x\n2$ y $NA\n3\nz$bad$"q\n$\n"$much\n')
    splits(5)
    t = extract.read_extract(spark, str(tmp_path), {"reports": SCHEMA}, corrupt="line", multi_line=True)["reports"]
    got = {r.b: (r.a, r.c, r.line) for r in t.collect()}
    assert got == {
        "first\nsecond": (1, "x", None), "y": (2, None, None), "": (3, "", got[""][2]),
        "bad": (None, "q\n$\n", 'z$bad$"q\n$\n"$much'),
    }


def test_carriage_returns(spark, splits, tmp_path):
    (tmp_path / "r.txt").write_bytes(b'1$"a\r\nb"$c\r\n2$d$e\r\n')
    splits(4)
    assert sorted(r.value for r in read_records(spark, str(tmp_path / "r.txt")).collect()) == ['1$"a\nb"$c', "2$d$e"]


def test_no_quotes_no_rows_and_an_open_quote(spark, splits, tmp_path):
    for name, text in (("plain", "a$b\n\nc$d"), ("none", ""), ("open", 'a$b\nc$"d\ne\nf')):
        (tmp_path / name).write_text(text)
    splits(2)
    read = lambda name: sorted(r.value for r in read_records(spark, str(tmp_path / name)).collect())
    assert read("plain") == ["a$b", "c$d"] and read("none") == [] and read("open") == ["a$b", 'c$"d\ne\nf']


@pytest.mark.parametrize("line, closed, opened", [
    ("a$b", False, True), ('a$"b', True, False), ('a$"b"', False, True), ('"a""b"$c', False, True), ('"a"" $', True, True),
    ('5" pipe$x', False, False), ('x$ "y', True, False), ('"', True, False), ('""', False, True), ('"$"', False, True),
])
def test_ends_open(line, closed, opened):
    assert ends_open(line, False, "$", '"') == closed
    if line in ("a$b", '"', "5\" pipe$x"):
        assert ends_open(line, True, "$", '"') == {"a$b": True, '"': False, "5\" pipe$x": False}[line]
