import pytest
from pyspark.sql import functions as F

from docjson.functions import formats, pointer


def test_codec():
    assert pointer.unescape("a~1b~0c") == "a/b~c"
    assert pointer.unescape("~01") == "~1"
    assert pointer.escape("a/b~c") == "a~1b~0c"
    assert pointer.join("", "sections") == "/sections"
    assert pointer.join("/sections", 0) == "/sections/0"


def test_dialects():
    assert pointer.tokens("") == pointer.tokens("/") == []
    assert pointer.tokens("/a/b") == ["a", "b"]
    with pytest.raises(ValueError):
        pointer.tokens("a/b")
    assert pointer.tokens("a/b", lenient=True) == ["a", "b"]
    assert pointer.tokens("/a%20b", percent=True) == ["a b"]
    assert pointer.tokens("/a%20b") == ["a%20b"]
    assert pointer.tokens("/a%zz", percent=True) == ["a%zz"]


def test_walk():
    d = {"name": "x", "a": {"b": {"c": 1}}, "items": [10, 20], "none": None}
    at = lambda p: pointer.walk(d, pointer.tokens(p, lenient=True))
    assert at("/") is d and at("/name") == "x" and at("/a/b/c") == 1 and at("/items/1") == 20 and at("/none") is None
    for lost in ("/missing", "/items/-", "/items/5", "/name/x", "/none/x"):
        assert at(lost) is pointer.MISSING


def test_columns_agree_with_python(spark):
    paths = ["", "/", "/a", "/a~1b/~0c", "/a//b", "x/y"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", pointer.col_tokens(F.col("p")).alias("s"), pointer.col_tokens(F.col("p"), lenient=True).alias("l")).collect()
    for r in rows:
        assert r["l"] == pointer.tokens(r["p"], lenient=True)
        assert r["s"] == (None if r["p"] == "x/y" else pointer.tokens(r["p"]))


CASES = [
    ("email", "user@example.com", True), ("email", "user@sub.domain.com", True), ("email", "not-email", False), ("email", "@missing.user", False),
    ("date", "2024-01-15", True), ("date", "2024-13-01", False), ("date", "2024-02-30", False), ("date", "not-a-date", False), ("date", "0000-01-01", False),
    ("date-time", "2024-01-15T10:30:00Z", True), ("date-time", "2024-01-15T10:30:00+03:00", True), ("date-time", "not-datetime", False), ("date-time", "2024-01-15T10:30:60Z", False),
    ("time", "10:30:60", True), ("time", "24:00:00", False), ("time", "10:30:00.5+01:00", True),
    ("duration", "P1Y2M", True), ("duration", "P", False), ("duration", "PT", False), ("duration", "P3W", True), ("duration", "P1DT", True), ("duration", "PT1.5S", True),
    ("uri", "https://example.com", True), ("uri", "ftp://files.org/doc", True), ("uri", "not a uri", False),
    ("uri-reference", "/x", True), ("uri-reference", "", True), ("uri-template", "/a/{b}", True), ("uri-template", "/a/{b{c}", False), ("uri-template", "/a/{b", False),
    ("iri", "https://example.com/ä", True), ("iri-reference", "#x", True), ("iri-reference", "x y", False),
    ("hostname", "a-b.example.com", True), ("hostname", "-a.com", False), ("hostname", "a..b", False), ("hostname", "x" * 64 + ".de", False),
    ("idn-hostname", "bücher.de", True), ("idn-hostname", "-x.de", False),
    ("ipv4", "192.168.1.1", True), ("ipv4", "0.0.0.0", True), ("ipv4", "256.1.1.1", False), ("ipv4", "1.2.3", False), ("ipv4", "01.2.3.4", False), ("ipv4", "1.2.3.4.", False),
    ("ipv6", "::1", True), ("ipv6", "2001:db8::8a2e:370:7334", True), ("ipv6", "1:2:3", False),
    ("uuid", "550e8400-e29b-41d4-a716-446655440000", True), ("uuid", "not-a-uuid", False),
    ("json-pointer", "", True), ("json-pointer", "/a~1b", True), ("json-pointer", "/a~2", False), ("json-pointer", "a", False),
    ("relative-json-pointer", "0#", True), ("relative-json-pointer", "1/a", True), ("relative-json-pointer", "01", False),
    ("regex", "a+", True), ("regex", "(", False), ("made-up", "anything", True),
]


@pytest.mark.parametrize(("name", "value", "good"), CASES)
def test_formats(name, value, good):
    assert formats.matches(name, value) is good


def test_format_of_no_string():
    assert not formats.matches("email", 123)


def test_native_formats_agree(spark):
    native = {*formats.PATTERNS, "date", "hostname"}
    for name in sorted(native):
        values = [v for n, v, _ in CASES if n == name] + ["", "PT"]
        got = spark.createDataFrame([(v,) for v in values], "v string").select("v", formats.col_matches(name, F.col("v")).alias("g")).collect()
        for r in got:
            if name != "uri":
                assert r["g"] == formats.matches(name, r["v"]), (name, r["v"])
