"""Identifiers, texts, scores and ignore patterns."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import identifiers as names
from lodestar.functions import scores
from lodestar.sources import ignore


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "words"),
    [("load_user", ["load", "user"]), ("HTTPServerV2", ["HTTPServer", "V", "2"]), ("", []), ("__x__", ["x"]), ("aB", ["a", "B"]), ("m3u8", ["m", "3", "u", "8"])],
)
def test_words(spark, name, words):
    got = value(spark, names.words_of(F.lit(name)))
    assert [w.lower() for w in got] == [w.lower() for w in words] or "".join(got) == "".join(words)


def test_query_tokens(spark):
    assert value(spark, names.query_tokens(F.lit("load_user  Load userName"))) == ["loaduser", "load", "user", "name"]
    assert value(spark, names.query_tokens(F.lit("  "))) == []


def test_ids(spark):
    assert value(spark, names.module_of(F.lit("a/b.py"))) == "a.b"
    assert value(spark, names.function_id(F.lit("p/__init__.py"), F.lit("C"), F.lit(None).cast("string"), F.lit("f"))) == "p.__init__.C.f"
    r = value(spark, names.lookup_parts(F.lit("a.B.run")))
    assert (r["name"], r["class"]) == ("run", "B")
    assert value(spark, names.superclass_name(F.lit("Base[T] "))) == "Base"


@pytest.mark.parametrize(
    ("annotation", "inner"),
    [
        ("Iterator[Row]", "Row"),
        ("List[Optional[Row]]", "Row"),
        ("Generator[Row, int, Dict[str, int]]", "Row"),
        ("Union[None, Row]", "Row"),
        ("Union[A, B]", None),
        ("Dict[str, Row]", None),
        ("Tuple[Row, ...]", None),
        ("int", None),
        ("List[int]", None),
        ("row", None),
        ("Row", "Row"),
        ("List[Row", None),
        ("", None),
        (None, None),
        ("Optional[Dict[str, Row]]", None),
    ],
)
def test_inner_class(spark, annotation, inner):
    assert names.inner_class(annotation) == inner
    assert value(spark, names.inner_class_of(F.lit(annotation).cast("string"))) == inner


def test_scores(spark):
    assert value(spark, scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert abs(value(spark, scores.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0)))) - 1) < 1e-12
    assert value(spark, scores.rrf(F.lit(1), F.lit(1))) == pytest.approx(4 / 61)
    assert value(spark, scores.rrf(F.lit(None).cast("int"), F.lit(2))) == pytest.approx(1 / 62)


@pytest.mark.parametrize(
    ("path", "patterns", "is_ignored"),
    [
        ("a/b.log", ["*.log"], True),
        ("a/keep.log", ["*.log", "!keep.log"], False),
        ("build/x.py", ["build/"], True),
        ("a/build/x.py", ["build/"], True),
        ("a/build", ["/build"], False),
        ("docs/a/b.py", ["docs/**/b.py"], True),
        ("docs/b.py", ["docs/**/b.py"], True),
        ("x/docs/b.py", ["docs/b.py"], False),
        ("a1.py", ["a?.py"], True),
        ("a/b.py", ["# a", ""], False),
        ("a.py", ["[ab].py"], True),
        ("c.py", ["[!ab].py"], True),
        ("abc/x", ["ab"], False),
    ],
)
def test_ignore(spark, path, patterns, is_ignored):
    assert ignore.is_ignored(path, patterns) == is_ignored
    assert value(spark, ignore.ignored(F.lit(path), patterns)) == is_ignored


def test_excluded(spark):
    for path, want in (("venv/a.py", True), ("src/x.egg-info/a.py", True), ("src/environment/a.py", False), ("a/.git/b.py", True)):
        assert value(spark, ignore.excluded(F.lit(path))) == want
