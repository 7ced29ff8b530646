import random

import numpy as np
import pytest

from feedloom.llm import residue as R

REAL = [
    "We are hiring a technician for the harbour team.\nYou check the pumps and write the log.", "You track 404 and 500 errors across our sites.", "Knowledge of {curly} and [square] notation is a plus.",
    "Shell variables like $PATH and ${HOME} hold no surprises.", "Templates with {{ }} are yours to escape.", "Salary [negotiable], hours [flexible].", "Solid JavaScript skills are needed.", "Was this page useful? Yes / No",
]
BAD = [
    "Please enable JavaScript to view this job.", "404 Not Found", "Une erreur est survenue, veuillez réessayer.", "Lorem dolor amet sit elit.\nAdipiscing ipsum magna.", "Apply to {{job.title}} now, we have a good team here.",
    "Hours <%= hours %> a week on the boats.", "The %JOB_TITLE% leads the team.", "__department__", "We pay (salary to be filled in) a year.", "You work with *|team|* on boats.", "TODO: describe role", "Good pay.\nINSERT DUTIES HERE",
    "HTTP status 500.\nReference number: a1b2.",
]


@pytest.fixture(scope="module")
def model():
    return R.Model.of(REAL * 30 + ["Payroll Clerk", "JavaScript Developer", "Title Examiner", "404 Ranch Tour Guide", "[Remote] Data Steward"] * 30)


@pytest.mark.parametrize("text", REAL + ["JavaScript Developer", "Title Examiner", "404 Ranch Tour Guide", "[Remote] Data Steward"])
def test_real_text(model, text):
    assert not model.is_residue(text)


@pytest.mark.parametrize("text", BAD)
def test_residue(model, text):
    assert model.is_residue(text)


def test_unsure_syntax_is_learnt_from_sure_one(model):
    learnt = R.Model.of(REAL * 30 + ["Test Engineer {Embedded}"] * 5 + ["{{start date}} on", "@@start date@@", "[[team name]] x"])
    assert learnt.is_residue("You begin on {start date} in the harbour.") and learnt.is_residue("[team name]")
    assert not learnt.is_residue("Test Engineer {Embedded}")


def test_rows(spark, rows, model):
    data = [(1, "404 Not Found", REAL[0], "clash"), (2, None, None, "c"), (3, "", " \n", "c"), (4, "Clerk", BAD[0], "c"), (4, "Clerk", BAD[0], "c"), (None, "404 Not Found", None, "c"), (5, "{{x.y}}", (REAL[0] + "\n") * 2000 + "@@x@@", "c")]
    df = spark.createDataFrame(data, "row_id bigint, title string, description string, field string")
    assert rows(R.residue(df, model=model)) == [(1, "title"), (4, "description"), (4, "description"), (5, "description"), (5, "title")]
    assert {(1, "title"), (5, "title"), (5, "description")} <= set(rows(R.residue(df)))  # fitted on these rows themselves
    assert R.residue(df.limit(0)).count() == 0
    assert sorted(r["row_id"] or 0 for r in R.without_residue(df, model=model).collect()) == [0, 2, 3]


def test_a_distributed_fit_is_the_local_one(spark):
    rare = "Kindly reload: lorem glitch in the harbour widget"
    texts = [REAL[i % 8] + f"\nBoat {'abcdefgh'[i % 8]} {'stuvw'[i % 5]} sails." for i in range(80)] + BAD + [rare, "Harbour widget glitch, kindly reload", "{start date}", "{{start date}}"]
    df = spark.createDataFrame([(i, "Clerk" if i % 2 else None, x) for i, x in enumerate(texts)], "row_id bigint, title string, description string").repartition(5)
    whole, counted = R.Model.of(["Clerk"] * (len(texts) // 2) + texts), R.fit(df, ("title", "description"))
    np.testing.assert_allclose(whole.prose, counted.prose, atol=1e-9)
    np.testing.assert_allclose(whole.spans, counted.spans, atol=1e-9)
    assert (whole.judge(texts) == counted.judge(texts)).all()


def test_half_of_the_seeds_find_what_the_others_say():
    """The passages of one half of the seeds are residue to a model that was given the other half and pages that mix both."""
    rng = random.Random(5)
    every = [s for s in R.seed_records(R.FILLER) if len(s.split()) > 4]
    pages = ["\n".join(rng.sample(every, 4)) for _ in range(30)] + REAL * 200
    seeds = {k: R.seed_records(k)[1::2] for k in (R.FILLER, R.NOTE)}
    model = R.Model.of(pages, seeds)
    held_out = [s for s in every if s not in seeds[R.FILLER]]
    assert model.judge(pages)[:30].mean() >= 0.85 and not model.judge(pages)[30:].any()
    assert model.judge(held_out).mean() >= 0.4


def test_a_trusted_syntax_is_decided_by_its_score(model):
    kind, inner = R.spans("See [[nodiscard]] there")[0]
    assert kind in R.SURE and model.span_odds(kind, inner) > 0
    assert model.is_residue(REAL[0] + " [[nodiscard]]")
    model.spans[R._span_features(kind, inner)] = -3
    assert not model.is_residue(REAL[0] + " [[nodiscard]]")


def test_units_of_a_batch():
    texts = ["One two. Three\nfour", "", "404 nights in 1999", "é à\n\n…"]
    u = R.Units(texts)
    assert u.record.tolist() == [0, 0, 0, 2, 3, 3] and u.letters.tolist() == [7, 5, 4, 15, 4, 3]
    alone = R.Units(["Three"])
    assert set(alone.feature) == set(u.feature[u.unit == 1])  # a word's hash doesn't depend on its place
    assert not set(R.Units(["404"]).feature) & set(R.Units(["500"]).feature) and set(R.Units(["12"]).feature) == set(R.Units(["1999"]).feature)


def test_marked_spans_are_those_of_a_scan_of_the_whole_pattern():
    rng = random.Random(8)
    bits = ["{{", "}}", "{", "}", "[[", "]]", "[", "]", "<%=", "%>", "<<", ">>", "<", ">", "*|", "|*", "&lt;", "&gt;", "@@", "__", "#{", "${", "%s", "%", "$", "(", " to be filled in)", "<insert ", " here>", "job", "é", " ", "\n", "x.y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)] + BAD + REAL
    marked, rest = R._split(texts)
    assert rest == [R._SPAN.sub(" ", t) for t in texts]
    assert marked == [R.spans(t) for t in texts] == [[(m.lastgroup, m[m.lastgroup] or "") for m in R._SPAN.finditer(t)] for t in texts]
    assert sum(map(len, marked)) > 1000


def test_splitting_costs_less_than_a_scan_of_the_whole_pattern():
    """Best of several runs each; a tenth to a fifth of a scan, where finding and cutting took two."""
    import time

    texts = ["You check the pumps of the harbour and write the log (every day). " * 20 + "[x]"] * 300

    def cost(f):
        times = []
        for _ in range(5):
            begin = time.process_time()
            f(texts)
            times.append(time.process_time() - begin)
        return min(times)

    assert cost(R._split) < 0.6 * cost(lambda own: [list(R._SPAN.finditer(t)) for t in own])
