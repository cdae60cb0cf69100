import random

import naive
from pyspark.sql import functions as F

from muster.functions import posts, scoring, text

LETTERS = "ابتثجحخدأإآٱىةؤئيوهـ ًُِّْٰٖٕۖ ٓﻻﷲﺣe1  ٠۳\tﬁ"


def random_texts(n, seed, alphabet=LETTERS, size=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_normalize_equals_the_plain_statement(spark):
    values = random_texts(600, 1) + ["", "   ", "أَحْمَد  الْعَلِيّ", "ﷺ", "é"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    c = F.col("s")
    rows = df.select(
        "s",
        text.normalize(c).alias("p"),
        text.normalize(c, soft=True).alias("q"),
        text.normalize(c, soft=True, compact=True).alias("r"),
    ).collect()
    for row in rows:
        assert row.p == naive.normalize(row.s), repr(row.s)
        assert row.q == naive.normalize(row.s, True)
        assert row.r == naive.normalize(row.s, True, True)


def test_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(text.normalize(F.col("s"))).head()[0] == ""


def test_osa_distance_equals_the_plain_statement(spark):
    rng = random.Random(2)
    words = random_texts(60, 3, "abcd", 8)
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(500)] + [("", "ab"), ("ab", ""), ("", ""), ("ca", "abc")]
    long = [w for w in random_texts(160, 8, "abcé😀", 90) if len(w) > 50]  # about the width of the bit vectors and beyond
    pairs += [(rng.choice(long), rng.choice(long)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.select("a", "b", scoring.osa_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert row.d == naive.osa(row.a, row.b), row


def test_token_score_equals_the_plain_statement(spark):
    rng = random.Random(4)
    words = [w for w in random_texts(80, 5, "abc", 9) if w]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(800)]
    pairs += [("abcdefg", "abcdfeg"), ("abcdefg", "acbdfeg"), ("abcdef", "acbdfe"), ("ab", "ac")]
    df = spark.createDataFrame(pairs, "q string, n string")
    for row in df.select("q", "n", scoring.token_score(F.col("q"), F.col("n")).alias("s")).collect():
        assert row.s == naive.token(row.q, row.n), row


def test_titles(spark):
    cases = {
        "": posts.TITLE_DEFAULT,
        "قصة قصيرة! ثم بقية": "قصة قصيرة",
        "  .نص https://a.b/c!d #وسم_جديد هنا.": "نص   هنا",
        "سطر.\nآخر": "سطر.",
        "كلمة " * 30: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for row in df.select("s", posts.title(F.col("s")).alias("t")).collect():
        expected = cases[row.s]
        if expected is None:
            assert row.t.endswith("كلمة…") and len(row.t) <= 90
        else:
            assert row.t == expected


def test_arabic_rules(spark):
    df = spark.createDataFrame(
        [("لقاء سلوكي في الحافلة",), ("حافلات النقل",), ("حصة رياضيات لطلاب الصف ٦ وصف الخامس",), ("يوم جميل",)], "s string"
    )
    c = F.col("s")
    rows = df.select(posts.category(c).alias("c"), F.sort_array(posts.grade_mentions(c)).alias("g"),
                     posts.audiences(c, posts.is_flagged(posts.category(c))).alias("a")).collect()
    assert [r.c for r in rows] == ["guidance", "transport", "teaching", "student-life"]
    assert rows[2].g == [5, 6]
    assert rows[0].a == ["الأخصائيون"] and rows[2].a == ["الطلبة"] and rows[3].a == ["المجتمع المدرسي"]


def test_labels_and_dates(spark):
    df = spark.createDataFrame([("٠٣/١٢/٢٠٢٥", "5 / 11", "x"), ("31/02/2025", "", "ثامن 7"), ("3/1/25", "", "x")], "d string, h string, s string")
    rows = df.select(text.printed_date(F.col("d")).alias("d"), text.class_from_header(F.col("h"), F.col("s")).alias("c")).collect()
    assert str(rows[0].d) == "2025-12-03" and rows[1].d is None and rows[2].d is None
    assert tuple(rows[0].c) == (5, 11) and tuple(rows[1].c) == (8, 7) and rows[2].c is None
