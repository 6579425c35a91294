import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.sentences import segment, sentences

CASES = {
    "abbreviations": ["In Sept. 2031 the St. Mark depot, est. 2031, was sold for USD 665.2 million.", "Vol. 21, p. 915, of the report lists Alpha, etc. as discontinued."],
    "company at the end": ["We sold the stake to Zeta Corp.", "Rent for 5 sites rose."],
    "company within": ["Our partner Zeta Corp. holds 5.1 % of it, i.e. $4.2 million at cost."],
    "initials": ["Mr. Alpha Jr. and Ms. N. C. Beta did not stand.", "Dr. P. Gamma joined."],
    "quotation": ['The letter said: "Demand held up. Margins did not."', "It was short."],
    "split quotation": ['"Sales will recover," the minutes record, "but not before 2035."', "2029 was better."],
    "hyphenated name": ["It is due to demand for Alpha-S.", "New tariffs came."],
    "footnote": ["Sales fell after downtime.[22]", "eAlpha is sold online."],
    "bracket": ["(See Note 21 for it.)", "We agreed."],
    "ellipsis": ["The rate moved from 4.7 to 5.2 ... and then back.", "So be it!"],
    "German": ["Am 12. August 2035 prüfte der Vorstand das, z. B. bei Alpha, im 3. Quartal auf 3,4 Mio. Euro.", "Das gilt.", "Im Brief heißt es: „Wir bleiben. Ihr geht.“", "Nach Nr. 5 Abs. 9 haftet die AG, vgl. Anhang 5.", "Zum 3. Mai war Schluss."],
    "French": ["L’art. 14 limite la perte à 8,4 M€, cf. note 2.", "Le rapport indique : « la marge tiendra. Le site restera ouvert. »", "En 2024, tout va."],
    "Spanish": ["Según el art. 15, la pérdida no supera 3,8 millones (véase pág. 974).", "¿Peligra?", "El informe dice: «Se mantiene Alpha. La planta sigue».", "Fin."],
    "Chinese": ["营业利润回落至7.3亿元！", "公告称：“继续销售。工厂开放。”", "截至5月4日，余额为5.2亿元。"],
    "Japanese": ["報告書には「販売は続ける。工場は閉じない。」と記載されている。", "費用が改善しました！"],
    "Hindi": ["डॉ. Alpha की रिपोर्ट 11.3% बदली।", "क्या यह घटेगी?"],
    "Arabic": ["بلغ نحو 3.5 مليون دولار.", "هل يتراجع؟"],
}


@pytest.mark.parametrize("name", CASES)
def test_running_text(name):
    units = CASES[name]
    text = ("" if name in ("Chinese", "Japanese") else " ").join(units)
    assert [text[a:b] for a, b in segment(text)] == units


def test_thai_by_spaces():
    text = "ฝ่ายบริหารได้ติดตามแผนกับ Alpha จำนวน 29 ฉบับ กองทุนครบกำหนดในปี 2035 โดยมีคณะกรรมการ"
    assert [text[a:b] for a, b in segment(text)] == ["ฝ่ายบริหารได้ติดตามแผนกับ Alpha จำนวน 29 ฉบับ", "กองทุนครบกำหนดในปี 2035 โดยมีคณะกรรมการ"]


def test_lines():
    text = "Alpha Overview\nOur main risks are:\n- Changes in rates\n- A downgrade. It hurts.\n\n(in millions)   2032   2031\nSales, Alpha   5.2   $ 6.1\nCosts   3.1   (2.0)\n\nA line that is wrapped\nat a width of thirty goes on\nand ends here. Then one\nmore."
    assert [text[a:b] for a, b in segment(text)] == ["Alpha Overview", "Our main risks are:", "- Changes in rates", "- A downgrade. It hurts.", "(in millions)   2032   2031", "Sales, Alpha   5.2   $ 6.1", "Costs   3.1   (2.0)", "A line that is wrapped\nat a width of thirty goes on\nand ends here.", "Then one\nmore."]


def test_heading_with_full_stop():
    text = "Item 11. Selected Matters\n\nWe agreed. They did not."
    assert [text[a:b] for a, b in segment(text)] == ["Item 11. Selected Matters", "We agreed.", "They did not."]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\t\"“”()„«»[]1-•。字ก’", max_size=80))
def test_units_cover_everything_in_order(text):
    end = 0
    for a, b in segment(text):
        assert a < b and a >= end and not text[end:a].strip() and text[a:b] == text[a:b].strip()
        end = b
    assert not text[end:].strip()


def test_table(spark):
    import datetime as dt

    t = dt.datetime(2030, 1, 1)
    rows = [("a", "One. Two.", t), ("a", "One. Two.", t + dt.timedelta(1)), ("b", None, t), ("c", "", None), ("d", " \n ", t), (None, "X.", t), ("e", "Lone", None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, loaded_at timestamp")
    got = sorted((r["chunk_id"] or "", r["sentence_index"], r["start_pos"], r["end_pos"]) for r in sentences(df).collect())
    assert got == [("", 0, 0, 2), ("a", 0, 0, 4), ("a", 1, 5, 9), ("e", 0, 0, 4)]
    assert sentences(df.limit(0)).count() == 0
    long_ = spark.createDataFrame([("l", "A word here. " * 60_000, t)], "chunk_id string, text string, loaded_at timestamp")
    assert sentences(long_).count() == 60_000


@pytest.mark.parametrize("a,b", ["“”", "„“", "«»", "()", "[]", '""', "「」"])
def test_long_pairs_stay_whole_and_open_marks_do_not(a, b):
    inner = "Sales rose in the year. " * 80
    whole = f"He wrote {a}{inner.strip()}{b} to all holders."
    text = f"{whole} Then he left."
    assert [text[x:y] for x, y in segment(text)] == [whole, "Then he left."]
    left = f"He wrote {a}{inner}Then 5{b} he left." if a in "([\"" else f"He wrote {a}{inner}Then he left."
    assert len(segment(left)) > 70


def test_long_table_rows():
    rows = ["| " + " | ".join(f"Item {i}. Value {j}. It rose" for j in range(30)) + " |" for i in range(3)]
    text = "\n".join(rows)
    assert len(rows[0]) > 400 and [text[x:y] for x, y in segment(text)] == rows


@pytest.mark.parametrize("quotation", ["“%s”", '"%s"', "«%s»", "„%s“"])
def test_a_quotation_of_five_thousand_characters_stays_whole(quotation):
    body = ("All is well. " * 400).strip()
    text = f"He said: {quotation % body} Then he left."
    assert len(body) > 5_000 and [text[a:b] for a, b in segment(text)][-1] == "Then he left."
    assert len(segment(text)) == 2


@pytest.mark.parametrize("text", ["(" * 100_000, "(“[‘" * 25_000 + " x. Y", "a." * 100_000, "- x\n" * 50_000, "(a.) " * 40_000, "word" * 100_000 + ". Next one.", "Mr. " * 50_000, '"a ' * 50_000], ids=list("abcdefgh"))
def test_long_texts_with_much_left_open_take_linear_time(text):
    began = time.perf_counter()
    units = segment(text)
    assert time.perf_counter() - began < 5
    assert "".join(text[a:b] for a, b in units).replace(" ", "") == "".join(text.split()) or "\n" in text


def test_list_levels_close_with_what_ends_a_list():
    text = "The plan:\n- first point\n  1. a step that\n  goes on and\n  on and\n  on and\n  on and\n  on and\n  on and\n  on\n  2. another step\n- second point\n\nAfter it comes prose. More of it."
    units = [text[a:b] for a, b in segment(text)]
    assert units[1] == "- first point" and units[2].startswith("1. a step") and units[2].endswith("on") and units[3:] == ["2. another step", "- second point", "After it comes prose.", "More of it."]
