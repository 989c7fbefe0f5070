import hashlib
import re

from hypothesis import HealthCheck, given as drawn, settings, strategies as st

from loomsketch.llm import privacy

from . import brute as plain
from .conftest import rows_of, same

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def fine(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == 1:
        return all(int(p) <= 255 for p in x.split("."))
    if kind == 2:
        back = [int(c) for c in digits[::-1]]
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(back)) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "", re.ASCII) if fine(k, m[0]))


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def expected(rows):
    for i, t, *_ in rows:
        s = brute(t)
        yield i, *(sum(k == x for _, k, _ in s) for x in range(4)), hashlib.sha256(listed(s).encode()).hexdigest()


COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def test_base_spans_equal_brute_force(docs, given):
    out = privacy.sanitise(docs)
    same(rows_of(out, *COLUMNS), expected(given))
    for t, spans, base in zip(*[[r[k] for r in out.collect()] for k in ("sanitised", "spans", "base_sha256")], strict=True):
        mine = [x for x in spans.split(",") if x and x.split(":")[0] in KINDS]
        assert hashlib.sha256(",".join(mine).encode()).hexdigest() == base
        assert (t is None) == (spans == "")


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@drawn(st.lists(st.text(alphabet="019+-.@ ()a_%é𝔘\n", max_size=60), min_size=150, max_size=150))
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(rows_of(privacy.sanitise(df), *COLUMNS), expected(rows))


def runs(n):
    return ["1" * n, "1." * (n // 2), "a" * n, "a@" * (n // 2), "a@b" + ".c" * (n // 2), "+1" + "(" * n, "1 " * (n // 2), "+1 2" * (n // 4), "a@b.c " * (n // 6), "1.1.1.1 " * (n // 8)]


def test_long_runs_equal_brute_force(spark):
    rows = list(enumerate(runs(2000)))
    same(rows_of(privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")), *COLUMNS), expected(rows))


def test_long_runs_end(spark):
    """Texts of 300,000 characters; a brute force would take the square of that."""
    df = spark.createDataFrame(list(enumerate(runs(300_000))), "doc_id long, text string")
    out = {r["doc_id"]: r for r in privacy.sanitise(df).select(*COLUMNS).collect()}
    assert len(out) == 10 and out[8]["n_email"] == 50_000 and out[9]["n_ip"] == 37_500


def test_disclosing_terms_go_and_others_stay(spark):
    """zebrafish stands only with one address, in five texts; the others are common."""
    rows = [(i, f"contact agent zebrafish number {i} at secret@corp.com about agent things {'x' * i}") for i in range(5)]
    rows += [(100 + i, f"contact agent about things number {i} please") for i in range(200)]
    out = {r["doc_id"]: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        assert "zebrafish" not in out[i]["sanitised"] and "secret" not in out[i]["sanitised"] and "agent" in out[i]["sanitised"] and "remove:" in out[i]["spans"]
    assert all(out[100 + i]["sanitised"] is None for i in range(200))


def test_disclosing_terms_go_far_from_the_mention(spark):
    """In the last text the term stands a thousand words from the address."""
    rows = [(i, f"contact agent zebrafish number {i} at secret@corp.com about agent things {'x' * i}") for i in range(5)]
    rows += [(50, "zebrafish first " + "agent things " * 500 + " secret@corp.com " + "contact number " * 500 + " zebrafish last")]
    rows += [(100 + i, f"contact agent about things number {i} please") for i in range(200)]
    out = {r["doc_id"]: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zebrafish" not in out[i]["sanitised"] for i in (0, 1, 2, 3, 4, 50))
    assert out[50]["n_terms"] == 2 and out[50]["sanitised"].count("agent") == 500


def test_terms_at_the_edges_without_spaces_and_far_in_characters(spark):
    """The first and the last word, words joined to the mention, and the sixth word beyond 144 characters."""
    long = " ".join("agent" * 8 + x for x in "abcde")
    rows = []
    for i in range(5):
        rows += [(10 * i, f"zebrafish one@corp.com {i} okapi"), (10 * i + 1, f"斑马鱼养殖two@corp.com。{i}"), (10 * i + 2, f"{i} quetzal {long} three@corp.com {long} narwhal {i}"), (10 * i + 3, f"Axolotl:<four@corp.com> {i}")]
    rows += [(100 + i, f"contact agent about things number {i} {long}") for i in range(200)]
    out = {r["doc_id"]: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        assert out[10 * i]["sanitised"] == f" [EMAIL] {i} " and out[10 * i + 1]["sanitised"] == f"[EMAIL]。{i}"
        assert out[10 * i + 2]["sanitised"] == f"{i}  {long} [EMAIL] {long}  {i}" and out[10 * i + 3]["sanitised"] == f":<[EMAIL]> {i}"


def test_all_spans_and_texts_equal_brute_force(docs, given):
    """The method's spans as well, and the text with all of them replaced; the same from the table twice over."""
    named = lambda s: ",".join(f"{plain.KINDS[k]}:{a}:{b}" for a, k, b in s)
    spans = list(plain.all_spans([t for _, t, _ in given]))
    want = [(i, named(s), plain.replaced(t, s) if s else None) for (i, t, _), s in zip(given, spans, strict=True)]
    same(rows_of(privacy.sanitise(docs), "doc_id", "spans", "sanitised"), want)
    same(rows_of(privacy.sanitise(docs.unionAll(docs)), "doc_id", "spans", "sanitised"), want * 2)


def test_masked(spark):
    from pyspark.sql import functions as F

    texts = ["a@b.c", "é𝔘 1.2.3.4 +49 30 1234567 x", "x" * 1020 + "y a@b.c" + "z" * 3000 + " a@b.cc", "4111 1111 1111 1111@b.c +4111 1111 1111 1111@b.c"]
    for t, m in spark.createDataFrame([(t,) for t in texts], "text string").select("text", privacy.masked(F.col("text"), privacy.base_spans(F.col("text")))).collect():
        want = list(t)
        for a, _, b in brute(t):
            want[a:b] = " " * (b - a)
        assert m == "".join(want)


def test_sanitised_table(docs, given):
    out = privacy.sanitised(docs)
    assert out.columns == docs.columns and out.count() == len(given)
    clean = [(i, t) for i, t, _ in given if not brute(t)]
    left = {(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()}
    assert all(x in left for x in clean)
    assert not any(brute(t) for _, t in left)


def test_nothing(empty, all_null):
    assert privacy.sanitise(empty).count() == 0
    assert privacy.sanitise(all_null).count() == 3 and privacy.sanitised(all_null).count() == 3
