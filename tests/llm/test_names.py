import itertools

import pytest

from feedloom.llm import names as N
from feedloom.llm.components import components
from feedloom.llm.nameparts import edits, parse, same_given, trade_word

ONE = [
    ["Bolur Weplul Learning Centre Inc.", "bolur  weplul learning centre", "Bolur Wepllu Learning Centre Inc", "Bolurweplul Lrng Ctr.", "Learning Centre, Bolur Weplul Limited", "Bolur Weplul", "The Weplul Bolur Learning Centre (BWLC)", "BOLUR WEPLUL LEARNING CENTRE / ASHLOW"],
    ["Joseph Dilorbolbo Associates Ltd", "Joe Dilorbolbo Associates", "J. Dlorbolbo Assoc. Ltd", "Dilorbolbo, Joseph Associates"],
    ["Quellharrow Atlantic Group", "QAG - Quellharrow", "Quellharrow Atlantic", "The Quellharrow Group (Atlantic)"],
    ["Honve Pliwe Aerospace Ltd", "Honve Plíwe Aero"], ["Honve Pliwe Digital LLP", "Honve Pliwe Digital, L.L.P."],
    ["Maria Trukrel & Sons", "Maria Trukrel + Sons", "Maria Trukrel and Sons Ltée"],
]
NOBODY = ["", "  ", "Unknown", "Confidential", "Senior QA Analyst - Night Shift", "CHARGÉE DE PROJET", "Honve Pliwe"]


def test_spellings_of_one_organisation(spark, rows):
    names = [n for g in ONE for n in g] + NOBODY + ["Seafood Grukre Technologies Inc"]
    data = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "company string")
    want = {tuple(sorted(p)) for g in ONE for p in itertools.combinations(g, 2)}
    got = rows(N.same_organisation(data, frozenset(["ashlow"])))
    assert set(got) == want and len(got) == len(want)
    clustered = {r["name"]: r["cluster"] for r in N.clusters(data, frozenset(["ashlow"])).collect()}
    assert set(clustered) == set(names) - set(NOBODY[:-1])  # a name left with two possible trades stands alone
    assert sum(c == clustered["Honve Pliwe"] for c in clustered.values()) == 1


def test_empty_and_long(spark):
    assert N.clusters(spark.createDataFrame([], "n string")).count() == 0
    assert N.same_organisation(spark.createDataFrame([("Grukre " * 300,), ("x" * 5000,), ("ZZ",)], "n string")).count() == 0


def test_prefixes_miss_no_pair_above_the_threshold():
    import random

    rng = random.Random(1)
    cores = ["".join(rng.choice(["gro", "pli", "tus", "vel", "kra", "zo", "mi"]) for _ in range(rng.randint(2, 5))) for _ in range(150)]
    counts = {}
    for c in set(cores):
        for g in N.grams(c):
            counts[g] = counts.get(g, 0) + 1
    v = N.Vectors(counts, len(set(cores)))
    for t in (0.3, 0.6, 0.9):
        prefix = {c: v.prefix(c, t) for c in cores}
        for a, b in itertools.combinations(sorted(set(cores)), 2):
            if v.cosine(a, b) >= t:
                assert set(prefix[a]) & set(prefix[b])
                # the first sequence in common, by weight, is in both prefixes, so pairs are judged where they meet first
                first = next(g for g in v.of(a) if g in v.of(b))
                assert first in prefix[a] and first in prefix[b]


def test_hot_index_keys_are_salted_without_loss(spark, rows, monkeypatch):
    data = spark.createDataFrame([(f"Grukreflosjun{c} Robotics",) for c in "bcdfghklmnprst"], "n string")
    whole = rows(N.same_organisation(data))
    monkeypatch.setattr(N, "HOT", 3)
    assert rows(N.same_organisation(data)) == whole and whole


def test_average_linkage_breaks_chains():
    nodes = [("a", "grukre flosjun", "", "robotics"), ("b", "grukre flosjan", "", "robotics"), ("c", "vomilte", "", "robotics")]
    assert N.average_linkage(nodes, N.Vectors({}, 10), {"robotics"}) == [0, 0, 2]


def test_large_components_lose_no_spelling(spark, rows, monkeypatch):
    # reordered words, a leading word left out and errors in the first letters are no neighbours in the order of letters
    data = spark.createDataFrame([(f"{n} Robotics",) for n in ("Grukre Flosjun Vomilte", "Vomilte Grukre Flosjun", "Flosjun Vomilte Grukre", "Rgukre Flosjun Vomilte", "Grukre Flosjun Vomitle", "Grukreflosjun Vomilte", "Ozdarwin Plemt", "Ozdarwin Plemtt")], "n string")
    whole = rows(N.same_organisation(data))
    assert len(whole) == 15 + 1
    monkeypatch.setattr(N, "MAX_MATRIX", 3)
    assert rows(N.same_organisation(data)) == whole


def test_chained_linkage_finds_the_clusters_of_the_matrix():
    import random

    rng = random.Random(3)
    for n in (3, 40, 90):
        # every core once and counts that are no whole numbers, so no two means are equal
        cores = sorted({"".join(rng.choice(["gru", "kre", "flo", "sjun", "vom", "ilte", "ple"]) for _ in range(rng.randint(2, 5))) for _ in range(n)})
        nodes = [(c, c, rng.choice(["", "", "joseph", "james"]), rng.choice(["robotics", "marine", ""])) for c in cores]
        v = N.Vectors({g: 1 + 30 * rng.random() for c in cores for g in N.grams(c)}, 100)
        for least in (0.1, 0.3, 0.6):
            found = N.average_linkage(nodes, v, {"robotics", "marine"}, least)
            assert N.chained_linkage(nodes, v, {"robotics", "marine"}, least) == found and 1 < len(set(found))


def test_components(spark, rows):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("z", "y"), ("q", "q"), (None, "n01"), ("z", "y")]
    got = components(spark.createDataFrame(chain, "a string, b string"))
    assert rows(got) == [(f"n{i:02d}", "n00") for i in range(21)] + [("y", "y"), ("z", "y")]
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("word,full", [("srvcs", "services"), ("enginering", "engineering"), ("softw", "software"), ("fincl", "financial"), ("communicatinos", "communications"), ("grukre", None), ("flosjun", None)])
def test_trade_words(word, full):
    assert trade_word(word, False) == full


def test_parts():
    p = parse("Dirjunwarvi, Beth & Partners LLP - Ashlow", frozenset(["ashlow"]))
    assert (p.core, p.given, p.trade) == (("dirjunwarvi",), "elizabeth", ("partners",))
    assert same_given("e", "elizabeth") and same_given("", "x") and not same_given("joseph", "james")
    assert edits("weplul", "wepllu", 2) == 1 and edits("abc", "xyz", 1) == 2


def test_names_of_trades_and_titles_are_not_lost(spark):
    data = ["Marine Institute", "Marine Institute Inc", "Executive Staffing", "Executive Staffing Ltd", "Lead Mining Corp", "Lead Minning Corp.", "Contract Logistics Group", "Remote Sensing Labs", "Remote Sensing Laboratories",
            "Senior Research Associate", "Research Associate", "Lead Product Designer", "Junior Software Developer - Systems"]
    df = spark.createDataFrame([(x,) for x in data], "name string")
    got = {tuple(r) for r in N.same_organisation(df).collect()}
    assert {("Marine Institute", "Marine Institute Inc"), ("Executive Staffing", "Executive Staffing Ltd"), ("Lead Mining Corp", "Lead Minning Corp."), ("Remote Sensing Laboratories", "Remote Sensing Labs")} == got
    assert "Contract Logistics Group" in {r["name"] for r in N.clusters(df).collect()}


def test_joined_and_reordered_words_link(spark):
    data = ["Krala Dupe Vreshi Plimo Wobe Bulfa Zandi Systems", "Kraladupevreshiplimowobebulfazandi Systems", "Alder Birch Cedar Dogwood", "Birch Alder Cedar Dogwood", "Alder Birch Cedar Oakwood"]
    got = {tuple(r) for r in N.same_organisation(spark.createDataFrame([(x,) for x in data], "name string")).collect()}
    assert {("Krala Dupe Vreshi Plimo Wobe Bulfa Zandi Systems", "Kraladupevreshiplimowobebulfazandi Systems"), ("Alder Birch Cedar Dogwood", "Birch Alder Cedar Dogwood")} == got


def made_up(n):
    import random

    rng = random.Random(7)
    parts = ["gru", "kre", "flo", "sjun", "vom", "il", "ple", "dar", "wi", "tus", "bel", "ozd", "nak", "hir", "pomp"]
    return sorted({"".join(rng.choice(parts) for _ in range(4)).capitalize() for _ in range(n)})


def test_pairs_to_compare_grow_with_the_names_not_with_their_square(spark):
    def count(cores):
        nodes = N.parsed(spark.createDataFrame([(f"{c} Robotics",) for c in cores], "name string")).select("node", "core", "given", "trade")
        share = spark.sparkContext.broadcast
        return N.candidates(nodes, share(N._vectors(nodes)), share(N.complete_trades(nodes))).distinct().count()

    cores = made_up(4000)
    assert count(cores) < 30 * len(cores)  # pairs with a sequence in common: several hundred a name


def test_long_lists_miss_no_link(spark, rows, monkeypatch):
    import random

    rng = random.Random(9)
    names = []
    for c in made_up(150):
        k = rng.randrange(2, len(c) - 2)
        names += [f"{c} Robotics", f"{c[:k]}{c[k + 1]}{c[k]}{c[k + 2:]} Robotics Inc", f"{c[:k]}x{c[k:]} Robotics", f"{c}", f"{c[:6]} {c[6:]} Marine Ltd", f"Tusnak {c}", f"Tusnak {c[1:]} Robotics"]
    data = spark.createDataFrame([(n,) for n in names], "n string")
    monkeypatch.setattr(N, "HOT", 0)
    by_letters = rows(N.same_organisation(data))
    monkeypatch.setattr(N, "HOT", 10**9)
    assert by_letters == rows(N.same_organisation(data)) and len(by_letters) > 400


def test_spellings_have_one_signature_in_common():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abcdefghiklé語") for _ in range(rng.randint(5, 24)))
        most, b = N.allowed(len(a)), a
        for _ in range(most):
            k = rng.randrange(len(b) - 1)
            b = rng.choice([b[:k] + b[k + 1 :], b[:k] + "z" + b[k:], b[:k] + "y" + b[k + 1 :], b[:k] + b[k + 1] + b[k] + b[k + 2 :]])
        if edits(a, b, N.allowed(min(len(a), len(b)))) <= N.allowed(min(len(a), len(b))):
            text, key, gone = N.signatures([a, b[2:] + " " + b[:2]], [most, N.allowed(len(b))])
            own = [list(zip(key[text == i].tolist(), gone[text == i].tolist())) for i in (0, 1)]
            assert sum(k == q and not g & h for k, g in own[0] for q, h in own[1]) == 1
    assert all(len(x) == 1 for x in N.signatures(["abc"], [0]))
