import pytest

from gleanery.llm.replies import defects, is_copy, is_empty, is_other_language, is_refusal, open_end

Q = "What net sales did Alpha Foods report for Beta One in 2031?"
A = "Alpha Foods reported net sales of $5.1 million for Beta One in 2031 [1]."


@pytest.mark.parametrize("a", [None, "", " \n", "N/A", "[1][2].", "```\n```", "<p></p>", "Answer:", "**Answer:** ", "--", "...", "null", "None", "TBD", "​", "{}", "?"])
def test_empty(a):
    assert is_empty(a)


@pytest.mark.parametrize("a", ["No.", "2031", "Yes [1].", "None.", "$5.1 million", A])
def test_short_replies_are_not_empty(a):
    assert not is_empty(a)


@pytest.mark.parametrize("a", [Q, Q.lower(), f"**{Q}**", f"Question: {Q[:-1]}", f"You asked: {Q}", f"{Q} {Q}", f"> {Q}", "  " + Q.replace(" ", "  ") + "\n", "The question is: " + Q])
def test_copies(a):
    assert is_copy(Q, a)


@pytest.mark.parametrize("a", [A, f"{Q} It was $5.1 million [1].", f"{Q} No.", "Beta One.", "", "2031"])
def test_no_copies(a):
    assert not is_copy(Q, a)


@pytest.mark.parametrize("a", ["I'm sorry, but I cannot answer this.", "The context does not contain enough information to say what Alpha reported.", "None of the passages I was shown mentions Beta One.", "No answer found.", "Unable to comply.", "Dazu kann ich leider keine Auskunft geben.", "Aucun passage fourni ne traite de Beta One.", "Lo siento, no puedo responder a esa pregunta.", "抱歉，我无法回答这个问题。", "申し訳ありませんが、お答えできません。", "Thank you for asking; however, it is not possible for me to work this out."])
def test_refusals(a):
    assert is_refusal(a)


@pytest.mark.parametrize("a", [A, "Alpha Foods states that it cannot estimate the outcome of the claim [2].", "No, it is unable to obtain cover at a reasonable price [2].", "Unfortunately for Alpha Foods, no: the contract cannot be cancelled before 2030 [1].", '"We are sorry to report that we cannot give guidance," the letter says; it expects less [1].', 'Beta said, "I cannot answer the tender in time," and withdrew [1].', "It does not [1]."])
def test_no_refusals(a):
    assert not is_refusal(a)


def test_languages():
    assert is_other_language(Q, "Laut Bericht der Alpha Foods betrifft Beta One vor allem das Jahr 2031 [1].")
    assert is_other_language(Q, "Segundo o relatório de Alpha Foods, Beta One pesou nas contas de 2031 [1].")
    assert is_other_language(Q, "Alpha Foodsの報告書によれば、Beta Oneは主に2031年度に影響します[1]。")
    assert is_other_language("Alpha Foods在2031年对Beta有何说明？", A)
    assert not is_other_language("Answer in French: what does Alpha say?", "Selon Alpha, la demande devrait rester stable en 2031 [1].")
    assert not is_other_language("What term does the German report use for revenue?", "„Umsatzerlöse aus Verträgen mit Kunden“ [1].")
    assert not is_other_language(Q, A) and not is_other_language(Q, "$5.1 million") and not is_other_language(None, A)


def test_ends_that_tell():
    assert open_end("It fell by")[0] == "ask" and open_end("It fell,")[0] == "cut" and open_end("It fell ...")[0] == "cut"
    assert open_end("It fell [1]")[0] == "whole" and open_end("It fell.")[0] == "whole" and open_end("They are:\n\n- Alpha\n- Beta")[0] == "whole" and open_end("They are:\n\n1.")[0] == "cut"


def test_table(spark):
    replies = [f"Alpha Foods reported net sales of ${i}.5 million for Beta One in 20{i} [1]. Management links this to the launch of Gamma Two [2]." for i in range(10, 60)]
    rows = [(i, Q, a) for i, a in enumerate(replies)]
    bad = [(100, None, "empty"), (101, Q, "copied_question"), (102, "I cannot answer this.", "refusal"), (103, "Laut Bericht der Alpha betrifft das vor allem das Jahr 2031 [1].", "other_language"), (104, "Alpha Foods reported net sales of $5.5 mill", "truncated"), (105, replies[0] + " Management links this to the", "truncated"), (106, replies[0] + " Management links this to the launch of", "truncated")]
    good = [(200, "$5.1 million"), (201, replies[0][:-1]), (202, "Yes"), (204, "2031"), (203, Q + " " + A)]
    rows += [(i, Q, a) for i, a, _ in bad] + [(i, Q, a) for i, a in good] + [(100, Q, None), (None, Q, None), (300, None, "")]
    df = spark.createDataFrame(rows, "result_id long, question string, answer string")
    got = {r["result_id"]: r["defect"] for r in defects(df).collect()}
    assert got == {i: k for i, _, k in bad} | {300: "empty"}
    assert defects(df.limit(0)).count() == 0


def test_short_replies_do_not_vote_for_themselves(spark):
    replies = [f"Alpha Foods reported royalty income of ${i}.5 million for Beta One in 20{i} [1]. It names royalty income of Gamma first [2]." for i in range(10, 60)]
    cuts = ["Calzushaw Networks reported royalty income of", "Delta reported royalty income of"]
    good = ["Xanzerix & Lumnemond LLP", "Yes", "$383.2 million", "USD 5 billion", "Zeta", "Bank of Omega"]
    rows = [(i, Q, a) for i, a in enumerate(replies)] + [(100, Q, cuts[0])] + [(200 + i, Q, cuts[1]) for i in range(40)] + [(300 + i, Q, a) for i, a in enumerate(good)]
    got = {r["result_id"]: r["defect"] for r in defects(spark.createDataFrame(rows, "result_id long, question string, answer string")).collect()}
    assert got == {i: "truncated" for i in [100, *range(200, 240)]}
