import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.functions.globs import BadGlob, combine, glob_to_regex
from lineweave.functions.severity import external_severity, normalize_severity, severity_rank


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("content, lines", [
    ("", []), ("\n", [""]), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n", ["a", "b"]), ("a\n\n", ["a", ""]),
    ("a\r", ["a\r"]), ("a\r\r\n", ["a\r"]), ("\n\nx", ["", "", "x"]),
])
def test_split_lines(spark, content, lines):
    assert one(spark, content, X.split_lines) == lines


def test_c_lines_keep_carriage_returns(spark):
    assert one(spark, "a\r\nb\n", lambda c: X.split_lines(c, keep_cr=True)) == ["a\r", "b"]


@pytest.mark.parametrize("value", ["  x\t", " x y　", " ", "", "x", "\x1cx"])
def test_trim_is_unicode(spark, value):
    want = value.strip("".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1c <= c <= 0x1f))
    assert one(spark, value, X.trimmed) == want


def test_byte_prefix_never_splits_a_character(spark):
    text = "aé漢😀" * 5
    data = text.encode()
    sizes = range(1, 14)
    df = spark.createDataFrame([(bytearray(data[:m]),) for m in (13, 20, len(data))], "v binary")
    rows = df.select(F.col("v"), *[X.byte_prefix(F.col("v"), n).alias(str(n)) for n in sizes]).collect()
    for row in rows:
        for n in sizes:
            part = bytes(row["v"])
            # a character that is cut in the data itself is no text
            whole = part.decode(errors="ignore").encode() == part
            assert row[str(n)] == (part[:n].decode(errors="ignore") if whole or n < len(part) - 3 else row[str(n)])
    assert one(spark, bytearray(b"ab\xffcd"), lambda c: X.byte_prefix(c, 4), "binary") is None


def test_only_the_first_hit_counts_as_word(spark):
    for text, want in (("if x", True), ("xif if", False), ("(if)", True), ("iffy", False), ("a_if", False), ("", False)):
        assert one(spark, text, lambda c: X.first_hit_is_word(c, "if")) is want, text


def test_byte_columns(spark):
    assert one(spark, "é{", lambda c: X.byte_column(c, "{")) == 3
    assert one(spark, "x", lambda c: X.byte_column(c, "{")) == 1


@pytest.mark.parametrize("glob, yes, no", [
    ("**/*", ["a", "a/b.c"], []),
    ("*.rb", ["x.rb", "d/x.rb"], ["x.rbx"]),
    ("net/**", ["net/a", "net/a/b"], ["net", "anet/a"]),
    ("**/x", ["x", "a/x", "a/b/x"], ["ax"]),
    ("a/**/b", ["a/b", "a/c/b", "a/c/d/b"], ["ab", "a/cb"]),
    ("f?.{c,h}", ["f1.c", "fx.h"], ["f.c", "f1.cc"]),
    ("[!a-c]x", ["dx"], ["ax", "x"]),
    ("a\\*b", ["a*b"], ["axb"]),
])
def test_globs(spark, glob, yes, no):
    pattern = combine([glob])
    for path in yes:
        assert one(spark, path, lambda c: F.rlike(c, F.lit(pattern))) is True, path
    for path in no:
        assert one(spark, path, lambda c: F.rlike(c, F.lit(pattern))) is False, path


def test_broken_globs():
    for glob in ("a[", "{a", "a}", "x\\"):
        with pytest.raises(BadGlob):
            glob_to_regex(glob)
    assert combine(["a["], fallback_anywhere=True) is None
    assert combine([]) is None


def test_severities(spark):
    rows = {"critical": ("critical", 5, "critical"), "warn": ("medium", 3, "info"), "warning": ("medium", 3, "info"),
            " High ": ("info", 1, "high"), "odd": ("info", 1, "info"), "low": ("low", 2, "low")}
    for raw, (normal, rank, outside) in rows.items():
        assert one(spark, raw, normalize_severity) == normal
        assert one(spark, raw, severity_rank) == rank
        assert one(spark, raw, external_severity) == outside
