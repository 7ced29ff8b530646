import math
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import langid as L

EN = "The office opens at nine and we answer every letter. The new colleagues check the list and plan the week. You work with a small team on the boats."
FR = "Le bureau ouvre à neuf heures et nous répondons à chaque lettre. Les nouveaux collègues vérifient la liste. Vous travaillez avec une petite équipe sur les bateaux."
JA = "事務所は九時に開きます。新しい仲間はリストを確認します。船の仕事をします。"
SAMPLES = [("en", EN), ("fr", FR), ("ja", JA), ("en", "We plan the letters with the team."), ("fr", "Nous écrivons les lettres avec l'équipe."), (None, "x"), ("en", None)]


@pytest.fixture(scope="module")
def model():
    return L.PPM([(a, b) for a, b in SAMPLES if a and b])


@pytest.mark.parametrize("text", ["the boats are new", "les bateaux", "zz@9 qé", "船の"])
def test_code_lengths_equal_a_plain_ppm(model, text):
    data = np.frombuffer(L.normal([text])[0], np.uint8)
    got = model.code_lengths(data, np.array([0]))[0]
    for k, lang in enumerate(model.languages):
        count = Counter()
        for a, t in SAMPLES:
            if a == lang and t:
                for v in {L.normal([t])[0], L.normal([L._plain(t)])[0]}:
                    count.update(v[i : i + n] for n in range(1, L.ORDER + 2) for i in range(len(v) - n + 1))
        follow = {}
        for s, c in count.items():
            follow.setdefault(s[:-1], []).append(c)
        bits, raw = 0.0, L.normal([text])[0]
        for i in range(len(raw)):
            for o in range(min(i, L.ORDER), -1, -1):
                seen = follow.get(raw[i - o : i])
                if not seen:
                    continue
                t, d = sum(seen), len(seen)
                if c := count.get(raw[i - o : i + 1]):
                    bits -= math.log2(c / (t + d))
                    break
                bits -= math.log2(d / (t + d))
            else:
                bits += 8
        assert got[k] == pytest.approx(bits, rel=1e-4)


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").orderBy("sample_id").collect()
    model = L.PPM([(r["lang"], r["text"]) for r in rows[::2]])
    held = rows[1::2]
    right = sum(bool(s) and max(s, key=lambda x: x[1] - x[0])[2] == r["lang"] for r, s in zip(held, L.segments([r["text"] for r in held], model)))
    assert right / len(held) >= 0.9


def test_labels_in_any_spelling():
    for label in ("en", " EN", "en_US", "English", "eng", "en-CA"):
        assert L.label_code(label) == "en"
    assert [L.label_code(x) for x in (None, "", "und", "xx", "mul", "??", "français", "UKR")] == [None] * 6 + ["fr", "uk"]


def test_cases(spark, rows):
    docs = [
        (1, EN, "fr"), (2, EN, "en-GB"), (3, FR, None), (4, EN + "\n" + FR, "en"), (5, None, "en"), (6, "", None), (7, " \n", "xx"), (8, "12 / 34 --- ☎ ??", None), (None, EN, None), (9, EN, "xx"), (9, EN, "xx"),
        (10, JA, "en"), (11, EN + " Une petite équipe sur les bateaux.", "en"), (12, (EN + " ") * 300, "de"), (13, EN + "\nhttps://une.example/petite jobs@equipe.example\nwww.bateaux.example", "en"),
    ]
    d = spark.createDataFrame([(*x, 0, "clash") for x in docs], "doc_id bigint, text string, lang string, segment int, language string")
    s = spark.createDataFrame(SAMPLES, "lang string, text string")
    assert rows(L.wrong_labels(d, s)) == sorted([(1, "en"), (3, "fr"), (4, "en"), (4, "fr"), (9, "en"), (10, "ja"), (12, "en")], key=repr)
    seg = L.language_segments(d.where("doc_id in (4, 6, 8)"), s).orderBy("segment").collect()
    assert [(r["language"], r["sentences"]) for r in seg] == [("en", 3), ("fr", 3)]
    assert all(0.9 < r["confidence"] <= 1 for r in seg) and (seg[0]["begin_at"], seg[1]["end_at"]) == (0, len(EN) + 1 + len(FR))
    assert L.wrong_labels(d.limit(0), s).count() == 0 and L.language_segments(d.limit(0), s).count() == 0
    with pytest.raises(ValueError):
        L.wrong_labels(d, s.limit(0))


def test_many_samples_keep_every_language(spark, monkeypatch):
    df = spark.createDataFrame([("de", f"Satz {i}") for i in range(50)] + [("pt", f"frase {i}") for i in range(30)] + [("uk", "речення"), (None, "x"), ("uk", None)], "lang string, text string")
    assert len(L._samples(df, "lang", "text")) == 81
    monkeypatch.setattr(L, "MAX_SAMPLES", 21)
    assert Counter(a for a, _ in L._samples(df, "lang", "text")) == {"de": 10, "pt": 10, "uk": 1}
    assert set(L._train(df, df, "lang", "text", 0).languages) == {"de", "pt", "uk"}


def test_parts_are_made_normal_as_if_alone():
    parts = ["A  b\n", "", " \t", "x@y.org Mail 12", "see https://a.example/b?c now", "a\0b", "É 2027\u3000x", "..."]
    data, lengths = L.normal(parts)
    cuts = np.cumsum(lengths)
    assert [data[e - n : e] for e, n in zip(cuts, lengths)] == [L.normal([p])[0] for p in parts]
    assert L.normal(["A  b\n"])[0] == b" a b " and L.normal([""])[0] == b"  " and L.normal(["x@y.org Mail 12"])[0] == b" mail 0 "


def test_confidence_fits_held_out_texts(spark):
    """Mean confidence of held-out sentences, single words too, is within 0.05 of the share that is right."""
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").orderBy("sample_id").collect()]
    model = L.PPM(rows[::2])
    model.worth = L._worth(rows[::2])
    assert 0 < model.worth <= 1
    held = [(lang, text[s:e]) for lang, text in rows[1::2] for s, e in L.sentences(text)]
    held += [(lang, w) for lang, text in rows[1::2] for w in text.split()[:3] if len(w) >= L.LEAST_LETTERS]
    found = [(s[0][3], s[0][2] == lang) for (lang, _), s in zip(held, L.segments([t for _, t in held], model)) if s]
    confidence, right = (np.array(x, float) for x in zip(*found))
    assert abs(confidence.mean() - right.mean()) <= 0.05
