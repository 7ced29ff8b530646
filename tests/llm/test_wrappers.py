import random

import numpy as np
import pytest

from feedloom.llm import wrappers as W

SCHEMA = "row_id bigint, url string, title string, company string, description string, host string, block int, line_no int"
#: Words of three languages for generated pages: furniture at the top, buttons, list titles, furniture at the bottom, headings, and parts of sentences.
WORDS = {
    "de": ("Startseite|Über uns|Kontakt|Anmelden|Suche|Presse", "Teilen|Merken|Jetzt bewerben", "Ähnliche Stellen|Weitere Angebote", "Impressum|Datenschutz|© 2027 Werft. Alle Rechte vorbehalten.|Wir verwenden Cookies für Statistik.",
           "Ihre Aufgaben|Ihr Profil|Wir bieten|Bewerbung", "Sie|prüfen leiten bauen warten ordnen|täglich oft gern selten|die Anlagen.|den Bestand.|das Lager.|die Boote."),
    "fi": ("Etusivu|Meistä|Yhteys|Kirjaudu|Haku|Uutiset", "Jaa|Tallenna|Hae nyt", "Muita paikkoja|Katso myös", "Tietosuoja|Ehdot|© 2027 Telakka.|Käytämme evästeitä tilastoihin ja palveluun.",
           "Tehtävät|Edellytykset|Tarjoamme|Näin haet", "Sinä|tarkistat johdat rakennat huollat järjestät|päivittäin usein mielellään harvoin|laitteet hallissa.|varaston alhaalla.|veneet satamassa.|koneet pihalla."),
    "en": ("Home|About us|Contact|Log in|Search|Press", "Share|Save|Apply now", "Similar roles|See also", "Privacy|Terms|© 2027 Yard.|We use cookies for our statistics.",
           "Duties|What you bring|We offer|How to apply", "You|check run build mend sort|daily often gladly seldom|the plant in town.|the stock below.|the boats outside.|the engines here."),
}


def made(language, n, seed=3):
    """(text, numbers of its furniture lines) of n generated pages."""
    rng = random.Random(seed)
    top, buttons, lists, bottom, heads, parts = (x.split("|") for x in WORDS[language])
    sentence = lambda: " ".join([parts[0], rng.choice(parts[1].split()), rng.choice(parts[2].split()), rng.choice(parts[3:])])
    out = []
    for i in range(n):
        lines = []
        if rng.random() < 0.8:
            lines += [(x, True) for x in rng.sample(top, rng.randint(1, 4))]
        lines.append((f"{sentence()} {sentence()} {chr(97 + i % 26)}{i}.", False))
        for h in rng.sample(heads, 3):
            lines += [(h, False)] + [(rng.choice(["- ", ""]) + sentence(), False) for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.15:
                lines.append((rng.choice(buttons), True))
        if rng.random() < 0.6:
            lines += [(x, True) for x in rng.sample(buttons, 2)]
        if rng.random() < 0.5:
            lines += [(rng.choice(lists), True)] + [(f"{rng.choice('ABCDEFG')}{rng.choice('aeiou')}{chr(107 + k)}tor {i}{chr(97 + k)}x", True) for k in range(2)]
        if rng.random() < 0.8:
            lines += [(x, True) for x in rng.sample(bottom, rng.randint(1, 4))]
        out.append(("\n".join(x for x, _ in lines), {k for k, (_, f) in enumerate(lines) if f}))
    return out


@pytest.mark.parametrize("language", sorted(WORDS))
def test_furniture_of_a_host_in_any_language(language):
    pages = made(language, 300)
    w = W.Wrapper([W.Page(i, "h", text, None, None) for i, (text, _) in enumerate(pages)])
    found, true = {(i, n) for i in range(len(pages)) for n in w.furniture(i)}, {(i, n) for i, (_, own) in enumerate(pages) for n in own}
    assert len(found & true) / len(found) >= 0.95 and len(found & true) / len(true) >= 0.95


def test_the_fitted_wrapper_decides(monkeypatch):
    """With the nodes' memberships left as their forms have them, much furniture is lost; without nodes, the buttons are."""
    pages = made("en", 300)
    true = {(i, n) for i, (_, own) in enumerate(pages) for n in own}

    def wrong():
        w = W.Wrapper([W.Page(i, "h", text, None, None) for i, (text, _) in enumerate(pages)])
        return len({(i, n) for i in range(len(pages)) for n in w.furniture(i)} ^ true)

    fitted = wrong()
    monkeypatch.setattr(W, "SUPPORT", 10**9)
    assert wrong() > 5 * fitted and wrong() > 0.05 * len(true)


def test_edges(spark, rows):
    body = "\n".join(x for x, _ in made("en", 1))
    data = [(i, f"https://a.example/{i}", "Clerk", "Co", text) for i, (text, _) in enumerate(made("en", 60))]
    data += [
        (100, None, None, None, None), (101, "", "", "", ""), (102, None, "T", "C", " \n\t\n"), (None, "https://a.example/6", "x", "y", body), (103, "https://b.example", "T", "C", "x" * 50_000),
        (104, "https://a.example/9", "T", "C", "\n" * 5_000 + body), (104, "https://a.example/9", "T", "C", "\n" * 5_000 + body), (105, "u", None, None, "Page not found.\nPlease go back or try again later."),
    ]
    df = spark.createDataFrame([(*d, "clash", 1, 2) for d in data], SCHEMA)
    got = rows(W.furniture_lines(df, clip=None))
    assert got and {r for r, _ in got} <= set(range(60)) | {104}
    own = [n for r, n in got if r == 104]
    assert all(own.count(n) == 2 and n >= 5_000 for n in own)
    assert W.furniture_lines(df.limit(0)).count() == 0 and W.wrappers(df.limit(0)).count() == 0
    text = {r["row_id"]: r["description"] for r in W.main_content(df, clip=None).collect()}
    assert text[103] == "x" * 50_000 and text[101] == "" and 100 not in text
    for i, (value, _) in enumerate(made("en", 60)):
        gone = {n for r, n in got if r == i}
        assert text[i] == "\n".join(x for n, x in enumerate(value.split("\n")) if n not in gone)


def test_cut_last_line_is_the_constant_it_begins():
    pages = made("de", 200)
    cut = pages[0][0] + "\nDatensch"
    w = W.Wrapper([W.Page(-1, "h", cut, None, None, clip=len(cut))] + [W.Page(i, "h", text, None, None) for i, (text, _) in enumerate(pages)])
    assert cut.count("\n") in w.furniture(0)


def test_alignment_is_a_union_free_expression():
    a = W.Alignment()
    for stream in ("abc", "ac", "abbcde"):
        a.align([(t, W.FURNITURE) for t in stream])
    assert a.pattern() == "[f] (a) (b)* (c) (d e)?"
    b = W.Alignment()
    for stream in ("axbyc", "abxc", "abc"):  # the longest run in order is matched, not the first
        b.align([(t, W.FURNITURE) for t in stream])
    assert b.pattern().startswith("[f] (a)") and b.pattern().endswith("(c)") and "(b)" in b.pattern()


def test_blocks_of_a_large_host_lose_no_page(spark, monkeypatch):
    pages = made("fi", 700)
    df = spark.createDataFrame([(i, f"https://big.example/{i}" if i < 600 else f"https://small{i}.example/", "T", "C", text) for i, (text, _) in enumerate(pages)], "row_id int, url string, title string, company string, description string")
    monkeypatch.setattr(W, "BLOCK_PAGES", 200)
    got = {tuple(r) for r in W.furniture_lines(df).collect()}
    true = {(i, n) for i, (_, own) in enumerate(pages) for n in own}
    assert len(got & true) / len(got) >= 0.95 and len(got & true) / len(true) >= 0.95
    assert W.wrappers(df).agg({"pages": "sum"}).first()[0] == 700
    monkeypatch.setattr(W, "MAX_LARGE_HOSTS", 0)
    assert {tuple(r) for r in W.furniture_lines(df).collect()} == got


def test_matches_add_up_to_one():
    w = W.Wrapper([W.Page(i, "h", text, None, None) for i, (text, _) in enumerate(made("en", 50))])
    for _, at, clipped in w._slabs():
        assert np.allclose(w._match(at, clipped, w.member).sum(-1), 1)
