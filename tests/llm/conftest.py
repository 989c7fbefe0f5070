"""Documents for the tests: the small table, and rows that are odd in every column."""

import re

import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return SPACE.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def thue_morse(n, zero, one):
    """Two sequences of n parts, complements of each other. Sums of powers of any odd number modulo 2**64 take them for equal
    from a length of 1024 on."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return [[one if b else zero for b in bits], [zero if b else one for b in bits]]


def alike_rows():
    """Texts that differ, but that weak hashes take for equal: words, lines and documents."""
    rows = []
    for n in (1024, 2048):
        x, y = ("".join(z) for z in thue_morse(n, "a", "b"))
        rows += [f"{x} {y}", f"{y} {x} {y}", f"{x}\n{y}", " ".join([x] * 60), " ".join([y] * 60), *(" ".join(z) for z in thue_morse(n, "yes", "no"))]
    return rows


def odd_rows():
    line = " ".join(f"word{i % 37} Other{i % 11}" for i in range(90))
    texts = [
        None, "", "   \t\n", "one", "Zwei Wörter", line, line, line + " tail", "head " + line, "x " * 3000, line.upper(), " no break ", "naïve 𝔘𝔫𝔦 \U0001f600 ok",
        "mail a.b@c.de and a@b.c_d@e.f or x@y, call +49 (30) 123-456-78 or +1-2; 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 007.08.9.255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005 5500005555555559 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
        "Same line\nSame line\n\nother\r\nSame line \nSame line", "<|endoftext|> don't STOP <|startoftext|>x ''s 12345 ½ é é", "a\0b c", "#*$ %& | <> " * 30, "\n".join(["one two three four"] * 40), "Ä" * 5000, "verylong" * 9000,
    ]
    texts += alike_rows()
    rows = [(1_000_000 + i, t, ["en", None, "de"][i % 3], None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (None, line, None, None, None), (None, None, None, None, None), (1_000_005, line, "en", "s", len(line)), (1_000_005, "another text for the same id", "en", "s", 1), rows[6]]


@pytest.fixture(scope="session")
def given(spark, sf):
    """The rows (doc_id, text, lang) as a list."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()] + [r[:3] for r in odd_rows()]


@pytest.fixture(scope="session")
def docs(spark, sf, tmp_path_factory):
    """The same as a table, with more columns of unhandy names."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd_rows(), SCHEMA))
    extra = ["th", "n_words", "length", "key", "fp", "component_id", "rank", "e", "t", "spans", "quality", "s1", "u", "v", "a b"]
    rows.selectExpr("*", *[f"'x' AS `{c}`" for c in extra]).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def all_null(spark):
    return spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def same(left, right):
    """Equal as bags."""
    assert sorted(map(repr, left)) == sorted(map(repr, right))
