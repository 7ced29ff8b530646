from feedloom.llm import canonical_dedup as C

SCHEMA = "row_id bigint, url string, title string, company string, h string, x string, root string"


def df(spark, *rows):
    return spark.createDataFrame([(i, *r, "clash", "clash", "clash") for i, r in enumerate(rows, 1)], SCHEMA)


def test_formatting_is_ignored_and_letters_are_not(spark, rows):
    u = "https://x.example/job?id=7&lang=en"
    data = df(
        spark,
        (u, "C# Developer - Payments, Term", "Co Ltd."), (" HTTPS://X.example/job/?lang=en&id=7# ", "Payments, term | \"c# developer\" -", "CO\tltd"),
        (u, "Co Ltd.", "C# Developer: Payments Term"), (u, "C++ Developer - Payments, Term", "Co Ltd."), (u, "C# Developer - Payments, Term", "Co Limited"),
        ("https://x.example/job?id=8&lang=en", "C# Developer - Payments, Term", "Co Ltd."), (u, "C# Developer - Payments, Term", "Ltd Co"),
    )
    assert rows(C.later_copies(data)) == [(1, 2), (1, 3)]
    assert rows(C.copy_groups(data)) == [(1, 3), (4, 1), (5, 1), (6, 1), (7, 1)]
    assert C.collisions(data).count() == 0


def test_exchanged_columns_meet_through_differently_written_rows(spark, rows):
    data = df(spark, ("u", "Data Analyst", "A & B, Ltd"), ("u", "A B ltd", "Analyst: Data"), ("u", "Analyst, Data", "AB Ltd"), ("v", "Data Analyst", "AB Ltd"))
    assert rows(C.later_copies(data)) == [(1, 2), (1, 3)]


def test_nulls_blanks_repeats_and_empty(spark, rows):
    data = df(spark, ("u", None, None), ("U/", "", " "), (None, "t", "c"), ("", "T", "C"), ("v", "x" * 100_000, "c"), ("v", "X" * 100_000, "c"))
    assert rows(C.later_copies(data)) == [(1, 2), (3, 4), (5, 6)]
    twice = data.unionByName(data)
    assert rows(C.later_copies(twice)) == [(1, 2), (3, 4), (5, 6)]
    assert sum(r["copies"] for r in C.copy_groups(twice).collect()) == 12
    assert C.later_copies(data.limit(0)).count() == 0 and C.copy_groups(data.limit(0)).count() == 0


def test_a_hot_set_keeps_every_row(spark):
    rows_ = spark.range(1, 3001).selectExpr("id as row_id", "'u' as url", "if(id % 2 = 0, 'T - x', 't X') as title", "'c' as company")
    got = C.later_copies(rows_)
    assert got.count() == 2999 and got.select("first_row_id").distinct().count() == 1


def test_compatibility_forms_are_copies(spark, rows):
    data = df(spark, ("u", "Ｊａｖａ Developer", "Straße GmbH"), ("u", "JAVA Developer", "STRASSE GMBH"), ("u", "Cafe\u0301 Clerk", "Co"), ("u", "CAFÉ clerk", "co"), ("u", "Cafe clerk", "Co"), ("u", None, "É"), ("u", "", "e\u0301"))
    assert rows(C.later_copies(data)) == [(1, 2), (3, 4), (6, 7)]


def test_ascii_rows_fold_alike_on_both_sides(spark):
    every = "".join(map(chr, range(128)))
    assert C.folded(every) == every.lower()
