"""Text and list functions against plain Python, on cases that the tables don't have."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sidera.functions import arrays as A
from sidera.functions import text as X
from sidera.operators import semantic_ids as ids
from sidera.operators import statistics

TEXTS = [None, "", " ", "NA", "na", "\t x  ", "a  b c", "one two three", "one two three four five six seven eight nine", "```json\n{}\n```", "Dog cat", "the catalogue", "x" * 130, "Hello, world! Is it (really) so?", "été Été", "A > B >  > C", ">", "<|im_start|>hi<|im_end|>"]


def each(spark, column, values=TEXTS, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, c {kind}")
    return [r.r for r in df.select("k", column(F.col("c")).alias("r")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("column", "twin"),
    [
        (X.strip, lambda t: None if t is None else t.strip()),
        (X.squeeze, lambda t: None if t is None else re.sub(r"\s+", " ", t).strip()),
        (X.as_text, lambda t: t or ""),
        (X.ensure_text, lambda t: (t or "").strip()),
        (X.na_to_null, lambda t: None if t is None or not t.strip() or t == "NA" else t),
        (X.words, lambda t: None if t is None else t.split(" ")),
        (X.prefix_words, lambda t: None if t is None else " ".join(t.split(" ")[:6])),
        (X.middle_words, lambda t: None if t is None else " ".join((w := t.split(" "))[max(len(w) // 2 - 2, 0) :][:4])),
        (X.snippets, lambda t: None if t is None else [s for i, s in ((k, t[k:][:50]) for k in (50, 100, 200)) if i + 60 <= len(t) and len(s.strip()) > 9]),
        (X.category_path, lambda t: [p.strip() for p in (t or "").strip().split(">") if p.strip()]),
        (X.alnum_words, lambda t: None if t is None else re.findall("[a-z0-9]+", t.lower())),
        (lambda c: X.second_level(c), lambda t: None if t is None else (t.split(" > ") + [t.split(" > ")[0]])[1 if " > " in t else 0]),
        (X.intent, lambda t: next((to for w, to in X.keyword_pairs() if w in (t or "").lower()), None)),
        (X.strip_special, lambda t: None if t is None else t.replace("<|im_start|>", "").replace("<|im_end|>", "").strip()),
    ],
)
def test_text(spark, column, twin):
    got = each(spark, column)
    want = [twin(t) for t in TEXTS]
    assert [g if not isinstance(g, list) else list(g) for g in got] == [w for w in want] or (column is X.snippets and [g or [] for g in got] == [w or [] for w in want])


def test_tokens(spark):
    def twin(t):
        spaced = "".join(" " if ch in "\"()[]{}<>" else ch for ch in t.lower().strip())
        for sign in ".,!?;:":
            spaced = spaced.replace(f"{sign} ", f" {sign} ")
        return spaced.split()

    values = [t for t in TEXTS if t is not None]
    assert each(spark, X.tokens, values) == [twin(t) for t in values]


def test_fences_and_labels(spark):
    assert each(spark, X.strip_fence, ["```json\n{}\n```", "plain", " ```\nx```"]) == ["{}", "plain", "x"]
    df = spark.createDataFrame([(" a ", None), ("", "b"), (None, None)], "t string, d string")
    assert [r[0] for r in df.select(X.labelled([("Title", F.col("t")), ("Description", F.col("d"))])).collect()] == ["Title: a", "Description: b", ""]


LISTS = [[], ["a"], ["a", "b"], ["a", "a", "b", "c"], [str(k) for k in range(12)]]


def test_lists(spark):
    kind = "array<string>"
    assert each(spark, lambda c: A.tail(c, 3), LISTS, kind) == [x[-3:] for x in LISTS]
    for w in (2, 4):
        want = [[(x[i], x[j]) for i in range(len(x) - 1) for j in range(len(x)) if i < j <= i + w] for x in LISTS]
        assert [[tuple(p) for p in r] for r in each(spark, lambda c: A.forward_pairs(c, w), LISTS, kind)] == want
    assert each(spark, A.split_points, LISTS, kind) == [list(range(2, len(x))) for x in LISTS]
    assert each(spark, lambda c: A.others(c, F.lit("a")), LISTS, kind) == [[y for y in x if y != "a"][:5] for x in LISTS]


def test_text_scores(spark):
    from collections import Counter

    pairs = [("", ""), ("a", ""), ("Abc d", "abd"), ("aab b", "ab cc"), ("xyz", "qqq")]

    def char_f1(a, b):
        x, y = re.sub(r"\s+", "", a.lower()), re.sub(r"\s+", "", b.lower())
        if not x and not y:
            return 1.0
        n = sum((Counter(x) & Counter(y)).values())
        return 0.0 if not x or not y or not n else 2 * n / (len(x) + len(y))

    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").orderBy("k")
    assert [r[0] for r in df.select(A.char_f1(F.col("a"), F.col("b"))).collect()] == pytest.approx([char_f1(*p) for p in pairs])
    got = [tuple(r) for r in df.select(A.jaccard(X.alnum_words(F.col("a")), X.alnum_words(F.col("b"))), A.set_f1(X.tokens(F.col("a")), X.tokens(F.col("b")))).collect()]
    sets = [(set(re.findall("[a-z0-9]+", a.lower())), set(re.findall("[a-z0-9]+", b.lower()))) for a, b in pairs]
    want = [(1.0 if not x | y else len(x & y) / len(x | y), 0.0 if not x & y else 2 * len(x & y) / (len(x) + len(y))) for x, y in sets]
    assert sum(got, ()) == pytest.approx(sum(want, ()))


def test_identifiers(spark):
    token = "<|sid_start|><|A1|><|B22|><|C3|><|D0|><|sid_end|>"
    values = [f"x {token} y {token}", "<|A1|><|B2|><|C3|><|D4|>", "<|sid_start|><|B1|><|A2|><|sid_end|>", "", None]
    assert [None if r is None else tuple(r) for r in each(spark, ids.parse, values)] == [("1", "22", "3", "0"), None, None, None, None]
    assert [None if r is None else tuple(r) for r in each(spark, ids.parse_bare, values)][:2] == [("1", "22", "3", "0"), ("1", "2", "3", "4")]
    assert each(spark, ids.parse_token, values) == [token, None, "<|sid_start|><|B1|><|A2|><|sid_end|>", None, None]
    assert [None if r is None else len(r) for r in each(spark, ids.parse_all, values)] == [2, 0, 0, 0, None]
    assert ids.vocabulary(spark).count() == 1027 and ids.vocabulary(spark).select("token").distinct().count() == 1027
    listed = ids.from_list(spark.createDataFrame([([1, 2, 3],), ([4, 5, 6, 7],)], "semantic_ids array<int>"))
    assert [(r.A, r.B, r.C, r.D) for r in listed.collect()] == [(1, 2, 3, 0), (4, 5, 6, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert statistics.lcs(a, b) == table[-1][-1]
