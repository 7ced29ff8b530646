import random

import pytest

from feedloom.llm import matching as M

ROSTER = "snapshot_id int, member_id string, company_name string, website_url string, rule string"
ROWS = "recon_id bigint, company_name string, urls array<string>, member string, id int"


def test_rules(spark):
    roster = [
        ("1", "Bolur Weplul Learning Centre Inc.", "HTTPS://www.bolur.example/en/"), ("1", "Bolur Weplul Learning Centre Inc.", None), ("2", "Honve Pliwe Aerospace Ltd", "honve.example"),
        ("3", "Honve Pliwe Digital LLP", "https://honve.example/"), ("4", "Grukre Software (formerly Old Grukre Robotics)", "sites.builder.example/g1"), ("5", "Tosde Logistics", "sites.builder.example/t1"),
        (None, "Nobody Systems", "nobody.example"), ("6", None, "six.example"), ("7", "Plusi Marine Services", "plusi.example"),
    ]
    r = spark.createDataFrame([(8, *x, "clash") for x in roster], ROSTER)
    rows = [
        (1, "bolur weplul learning centre", ["https://careers.bolur.example/job/1"]), (2, "Weplul Bolur Lrng Ctr", None), (3, "Bolur Wepllu", ["http://bolur.example/x", None]), (4, "Honvee Pliwe Aerospace", []),
        (5, "Honve Pliwe", ["https://honve.example/1"]), (6, None, ["https://jobs.six.example/1"]), (7, "Unknown", ["https://board.example/tosde-logistics/jobs/9"]), (8, "Old Grukre Robotics Inc", None),
        (9, "Honve Pliwe Robotics", ["https://plusi.example/a"]), (10, "Tosde", None), (10, "Tosde", None), (11, "", None), (None, "Tosde", None), (12, "Plusu", []), (13, "x" * 3000, None), (14, "Nobody Systems", ["https://nobody.example"]),
    ]
    d = spark.createDataFrame([(*x, "clash", 0) for x in rows], ROWS)
    got = M.match(d, r).collect()
    assert {x["recon_id"]: (x["member_id"], x["rule"]) for x in got} == {
        1: ("1", "host_and_name"), 2: ("1", "name"), 3: ("1", "host_and_spelling"), 4: ("2", "spelling"), 6: ("6", "host"), 7: ("5", "slug"), 8: ("4", "name"), 10: ("5", "words"), 12: ("7", "words_spelling"),
    }
    assert len(got) == 9 and all(0 < x["confidence"] < 1 for x in got)
    assert M.match(d.limit(0), r).count() == 0 and M.match(d, r.limit(0)).count() == 0


def test_deletion_keys_meet_for_up_to_two_errors():
    rng = random.Random(3)
    for _ in range(200):
        w = "".join(rng.choice("abcdef") for _ in range(rng.randint(8, 12)))
        v = list(w)
        for _ in range(2):
            k, what = rng.randrange(len(v) - 1), rng.randrange(4)
            if what == 0:
                v[k] = "x"
            elif what == 1:
                del v[k]
            elif what == 2:
                v.insert(k, "y")
            else:
                v[k], v[k + 1] = v[k + 1], v[k]
        assert M.deletion_keys(w) & M.deletion_keys("".join(v))


def test_keys_meet_for_three_errors_in_long_names():
    rng = random.Random(4)
    for n in range(300):
        w = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(15, 150)))
        v = list(w)
        for _ in range(2 if len(w) < 21 else 3):
            k, what = rng.randrange(len(v)), rng.randrange(3)
            if what == 0:
                v[k] = "x"
            elif what == 1:
                del v[k]
            else:
                v.insert(k, "y")
        assert M.spelling_keys("".join(v), True) & M.spelling_keys(w, False), (w, "".join(v))
    assert len(M.spelling_keys("q" * 17 + "abcdefgh" * 20, True)) < 250  # they don't grow with the length


def test_three_errors_and_reordered_words_match(spark):
    r = spark.createDataFrame([("1", "Alderbirch Cedarwood Holm Systems", None), ("2", "Alder Birch Cedar Dogwood", None), ("3", "Marine Institute Ltd", None)], "member_id string, company_name string, website_url string")
    d = spark.createDataFrame([(1, "Aldrbirch Cedrwood Hoolm Systems", []), (2, "Birch Alder Cedar Dogwood", []), (3, "Cedar Birch Dogwod Alder", None), (4, "Institute, Marine", [])], "recon_id int, company_name string, urls array<string>")
    assert {x["recon_id"]: x["member_id"] for x in M.match(d, r).collect()} == {1: "1", 2: "2", 3: "2", 4: "3"}


def test_confidence_is_the_precision_by_other_evidence(spark):
    """40 members of two names each: names lie in one of ten rows, sites in one of five; each rule is judged over all rows."""
    names = [f"{a}{b}or Systems" for a in ("Kral", "Vresh", "Plim", "Trong", "Bulf", "Zand", "Hosk", "Merv") for b in ("udip", "ekon", "afol", "osti", "ibru")]
    roster = spark.createDataFrame([(str(i), n, f"https://m{i}.example") for i, n in enumerate(names)], "member_id string, company_name string, website_url string")
    rows = []
    for i in range(400):
        k = i % 40
        site = (k + 1) % 40 if i % 10 == 0 else k  # the site says another member than the name in one row of ten
        rows.append((i, names[k] if i % 4 else names[k].replace("or Sys", "oor Sys"), [f"https://m{site}.example/x"] if i % 5 < 3 else None))
    rows += [(1000 + i, None, [f"https://m{i}.example"]) for i in range(40)]
    got = M.match(spark.createDataFrame(rows, "recon_id int, company_name string, urls array<string>"), roster).collect()
    conf = {x["rule"]: x["confidence"] for x in got}
    assert len(got) == 440
    # of the rows with a site, 20 of 180 with an exact name and 20 of 60 with a mistyped one have the wrong site
    assert conf["name"] == pytest.approx(160 / 180, abs=0.01) and conf["spelling"] == pytest.approx(40 / 60, abs=0.02) and conf["host"] == pytest.approx(160 / 180, abs=0.01)
    assert conf["host_and_name"] > 0.95 and conf["host_and_name"] > conf["name"] and 0.5 not in conf.values()
