import time
import unicodedata

import pytest

from gleanery.llm.personal import FEMALE, FEMALE_OTHER, Finder, Surrogates, _ADDR, _EMAIL, _STREET, mentions, redact, with_placeholders

FIND = Finder().find

CASES = [
    ("My name is Rosalind Quillfeather and I hold 40 shares; write me at rosa_1989@corp.example.", [("name", "Rosalind Quillfeather"), ("email", "rosa_1989@corp.example")]),
    ("Applicant Farrah Mordwell / SSN 000652220 / far.rah(at)web dot test", [("name", "Farrah Mordwell"), ("id_number", "000652220"), ("email", "far.rah(at)web dot test")]),
    ("We copied Edwyn Ravensby's passport no. F00369734 into the form.", [("name", "Edwyn Ravensby"), ("id_number", "F00369734")]),
    ("The witness lives at Flat 2, 20 Holpavex Drive, Dunmarrow QQ9 1ZZ.", [("address", "Flat 2, 20 Holpavex Drive, Dunmarrow QQ9 1ZZ")]),
    ("The parcel for 2062 Hespe Rd.\nWesterloch, ZZ 00252 came back.", [("address", "2062 Hespe Rd.\nWesterloch, ZZ 00252")]),
    ("Operator: our next question comes from V. Stodsparrow of the pension fund.", [("name", "V. Stodsparrow")]),
    ("Mobile +1-415-555-0146, fax (212) 555-0123.", [("phone", "+1-415-555-0146"), ("phone", "(212) 555-0123")]),
    ("In a letter dated last week Torcombley, Isolde, a pensioner, gave 303/555-0130 ext. 40 as a daytime number.", [("name", "Torcombley, Isolde"), ("phone", "303/555-0130 ext. 40")]),
    ("Bitte senden Sie die Unterlagen an Dr. Rüdiger Mühlrad, Solzuwickstraße 6, D-00215 Obergrünbach.", [("name", "Rüdiger Mühlrad"), ("address", "Solzuwickstraße 6, D-00215 Obergrünbach")]),
    ("Jörg Achterfeld ist unter +49 (0)30 23125 281 zu erreichen.", [("name", "Jörg Achterfeld"), ("phone", "+49 (0)30 23125 281")]),
    ("Je soussignée Clotilde Rochebruyère, numéro de sécurité sociale 1 26 29 00 634 847 35, conteste le vote.", [("name", "Clotilde Rochebruyère"), ("id_number", "1 26 29 00 634 847 35")]),
    ("Merci d’écrire à Mme Léonie Grandelle, 83 bis, rue de Ostwerix, 00638 Saint-Vérèze.", [("name", "Léonie Grandelle"), ("address", "83 bis, rue de Ostwerix, 00638 Saint-Vérèze")]),
    ("Yo, Nélida Fuentes Albar, con DNI 00.782.876-I, reclamo el dividendo.", [("name", "Nélida Fuentes Albar"), ("id_number", "00.782.876-I")]),
    ("Escriban a Dña. Inés Buitra, Avda. Yeljawick 154, 2.º B, 00921 Peñablanca.", [("name", "Inés Buitra"), ("address", "Avda. Yeljawick 154, 2.º B, 00921 Peñablanca")]),
    ("联系人欧阳穗宁，电话10000294012，邮箱u1934+ir@post.example。", [("name", "欧阳穗宁"), ("phone", "10000294012"), ("email", "u1934+ir@post.example")]),
    ("股东上官楚萤（身份证号996660200819847343）对表决提出异议。请将材料寄给令狐煦野，地址：云砚市柳岸路200号2单元300室。", [("name", "上官楚萤"), ("id_number", "996660200819847343"), ("name", "令狐煦野"), ("address", "云砚市柳岸路200号2单元300室")]),
    ("資料は鵜ノ瀬 澪斗様、霧浜市青葉町5丁目20番1号までお送りください。", [("name", "鵜ノ瀬 澪斗"), ("address", "霧浜市青葉町5丁目20番1号")]),
    ("此致\n慕容竺青\n+86 100 0000 5711股东令狐墨筠（身份证号995726198719717053）反对。", [("name", "慕容竺青"), ("phone", "+86 100 0000 5711"), ("name", "令狐墨筠"), ("id_number", "995726198719717053")]),
    ("株主の椋ノ木暁仁（マイナンバー0000 3775 4390）が異議を申し立てた。", [("name", "椋ノ木暁仁"), ("id_number", "0000 3775 4390")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [(k, text[a:b]) for a, b, k in FIND(text)] == want


@pytest.mark.parametrize(
    "text",
    ["Lot 17 Harbour Road is a board game sold by Alpha.", "Main Street lenders and Wall Street desks cut targets.", "Build 4.2.1@Zeta fixed the ledger.", "Follow @Zeta for updates; 3 units @ $4.50 each were sold.", "Part number 000-41-7755 belongs to Zeta.", "Account 0000 6020 5727 is a ledger code.", "Invoice 2031-555-05632 was paid.", "Order ranges 415-555 to 617-720 were voided.", "Commission File Number 001-4991; IRS Employer Identification No. 00-0123377.", "Dr. Quillwin tablets and Aunt Hester pies were delisted.", "The Marlene unit at Zeta and the Jasper well produced 831,046 barrels.", "Torlemere & Quillingsby LLP acted as counsel.", "The Peningsby Foundation index rose 368.6 points.", "Plan administrators under Section 401(k) met 891 times.", "CUSIP 009340ZQ7 covers the notes.", ""],
)
def test_look_alikes(text):
    assert FIND(text) == []


@pytest.mark.parametrize("at", [" at ", " AT ", "(at)", " [ at ] ", "<AT>", " {ät} ", "(arroba)", "@", " @ ", "[@]"])
@pytest.mark.parametrize("dot", [f"{a}{w}{b}" for w in ("dot", "DOT", "punkt", "point", "punto") for a, b in ((" ", " "), ("(", ")"), (" [", "] "), ("<", ">"), ("{ ", " }"))])
def test_spelt_out_mail(at, dot):
    mail = f"jane.doe{at}firma{dot}fr"
    assert [mail] == [m.group() for m in _EMAIL.finditer(mail)]
    assert [(k, f"Write {mail}, please"[a:b]) for a, b, k in FIND(f"Write {mail}, please")] == [("email", mail)]


@pytest.mark.parametrize("text", ["We looked at this point in time.", "Margins rose at that point to levels of 2019.", "Sales peaked at some point we cannot name.", "It trades at 50 point premiums.", "Trends at retailers point to weakness.", "It sold at price point one."])
def test_points_in_prose_are_no_mail(text):
    assert FIND(text) == []


STREETS = [w for x in _STREET[3:-1].split("|") for w in ([x[:-3], x[:-2].replace("\\", "") + "."] if x.endswith(r"\.?") else [x])]


@pytest.mark.parametrize("street", STREETS)
@pytest.mark.parametrize("rest", [", Austin, TX 78701", " Apt 4, Austin, TX 78701", "\nAustin, TX 78701"])
def test_every_street_is_found(street, rest):
    place = f"12 Elm {street}{rest}"
    assert _ADDR[0].fullmatch(place)
    assert [(k, place[a:b]) for a, b, k in FIND(place)] == [("address", place)]
    for end in ("", ";", ")"):
        assert [k for _, _, k in FIND(f"He lives at 12 Elm {street}{end}")] == ["address"]


@pytest.mark.parametrize(
    "text,place",
    [(f"Zu finden: Mühl{w} 7, 00215 Obergrünbach", f"Mühl{w} 7, 00215 Obergrünbach") for w in ("straße", "strasse", "str.", "allee", "weg", "gasse", "platz", "ring", "damm", "ufer", "chaussee", "steig", "stieg")]
    + [(f"12 {w}{b}Foch, 00638 Vérèze", f"12 {w}{b}Foch, 00638 Vérèze") for w in ("rue", "avenue", "av.", "bd", "boulevard", "place", "impasse", "allée", "chemin", "quai", "cours", "route", "square", "passage") for b in ("", " ", " de la ", " d'", " des ")]
    + [(f"{w}{b}Yelja 15, 00921 Peñablanca", f"{w}{b}Yelja 15, 00921 Peñablanca") for w in ("Calle", "C/", "Avda", "Avda.", "Avenida", "Plaza", "Pza", "Pza.", "Paseo", "Camino", "Carretera", "Ronda", "Travesía", "Glorieta") for b in ("", " ", " de la ")],
)
def test_every_road_is_found(text, place):
    assert [(k, text[a:b]) for a, b, k in FIND(text)] == [("address", place)]


@pytest.mark.parametrize("label", ["SSN", "social security number", "tax ID", "taxpayer identification no.", "TIN", "ITIN", "passport", "national insurance no.", "NI number", "NI no.", "NINO", "driver’s license", "national identity card number", "ID card", "ID no.", "Steuer-ID", "SteuerID", "numéro fiscal", "n° de passeport", "DNI", "NIE", "NIF", "pasaporte", "número de identidad"])
def test_every_label_is_reached(label):
    assert [(k, f"{label}: 000652220"[a:b]) for a, b, k in FIND(f"{label}: 000652220")] == [("id_number", "000652220")]
    assert FIND("The smelter sold tin 250000 of tonnes.") == []


def test_surname_alone_and_coreference():
    text = "Nathan Fendunnow asked about margins. Mr. Fendunnow was not satisfied. Hi Fendunnow, go ahead. The Fendunnow Foundation paid."
    got = [text[a:b] for a, b, _ in FIND(text)]
    assert got == ["Nathan Fendunnow", "Fendunnow", "Fendunnow"]
    s = Surrogates(b"k").replace(text, FIND(text))
    first, last = s.split(" asked")[0].rsplit(" ", 1)
    assert "Nathan" not in s and f"Mr. {last} was" in s and f"Hi {last}," in s and "The Fendunnow Foundation" in s and first


def test_surrogates_are_keyed_typed_and_apart():
    text = "My name is Rosalind Quill and I moved; call me back on +1-415-555-0146, or mail rosa@corp.example. SSN 000652220. Signed: /s/ TAMSIN BRACK"
    places = FIND(text)
    one, again, other = (Surrogates(k).replace(text, places) for k in (b"a", b"a", b"b"))
    assert one == again != other
    kinds = [(k, one[a:b]) for a, b, k in FIND(one)]
    assert [k for k, _ in kinds] == [k for _, _, k in places] and len(set(kinds)) == len(kinds)
    assert not {text[a:b] for a, b, _ in places} & {m for _, m in kinds}
    assert kinds[-1][1].isupper() and kinds[1][1].startswith("+1-") and kinds[2][1].endswith(".example") and "corp" not in kinds[2][1]


def test_placeholders():
    text = "Regards, Tamsin Brack\nTel.: 030/23125229"
    assert with_placeholders(text, FIND(text)) == "Regards, [NAME]\nTel.: [PHONE]"


def test_tables(spark):
    rows = [(1, CASES[0][0]), (1, CASES[0][0]), (2, None), (3, ""), (None, CASES[3][0]), (4, "nothing here " * 20_000 + CASES[6][0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kind"]) for r in mentions(df).distinct().collect()) == [(0, "address"), (1, "email"), (1, "name"), (4, "phone"), (4, "phone")]
    masked = redact(df, key="secret").collect()
    assert len(masked) == 6 and [r["mention_count"] for r in masked] == [2, 2, 0, 0, 1, 2]
    assert masked[2]["masked_text"] is None and masked[0]["surrogate_text"] == masked[1]["surrogate_text"] != masked[0]["masked_text"]
    assert redact(df).first()["surrogate_text"] is None
    assert mentions(df.limit(0)).count() == 0


NAMES_HELD_OUT = [
    ("Minutes were taken by Oluwaseun Adeyemi in Lagos.", "Oluwaseun Adeyemi"),
    ("The letter was drafted by Siobhan Gallagher, our counsel.", "Siobhan Gallagher"),
    ("Chief executive Hiroshi Tanabe thanked the staff.", "Hiroshi Tanabe"),
    ("Our auditor, Marek Wojcik, resigned in June.", "Marek Wojcik"),
    ("Fatima Benali wrote that the notice came late.", "Fatima Benali"),
    ("On Monday, Dmitri Volkov phoned the branch.", "Dmitri Volkov"),
    ("Tenant Abena Owusu complained about the heating.", "Abena Owusu"),
    ("Lars Eriksson and Birgit Holm signed the deed.", "Birgit Holm"),
    ("Geschäftsführer Thilo Brandner sagte ab.", "Thilo Brandner"),
    ("Das Protokoll wurde von Wiebke Harmsen geführt.", "Wiebke Harmsen"),
    ("Le notaire Gaspard Delorme a signé l'acte.", "Gaspard Delorme"),
    ("El abogado Nicanor Quiroga firmó el acta.", "Nicanor Quiroga"),
    ("Письмо подписал Сергей Кузнецов.", "Сергей Кузнецов"),
    ("We met Ngozi Okafor at the site.", "Ngozi Okafor"),
    ("Thanks to Imran Qureshi for the data.", "Imran Qureshi"),
    ("Jane Whitcombe lives in Leeds.", "Jane Whitcombe"),
    ("The claim of Peter Mbeki was paid.", "Peter Mbeki"),
    ("Dr. Aiko Yamamoto treated him.", "Aiko Yamamoto"),
]
NO_NAMES_HELD_OUT = ["Chief executive pay rose.", "Northwind Logistics said demand fell.", "The report was signed by Falk Industries on May 4.", "Director Alpha Therapeutics resigned its mandate.", "Lake Superior lies to the north.", "New York wrote off the loan.", "Golden Gate Capital wrote to us.", "The plan was led by Bright Horizon Partners."]


def test_names_without_frames_held_out():
    """Figures in the README; sentences were written by the hand that wrote the rules, after them, before they were run. The
    first was a known example."""
    found = [t for t, name in NAMES_HELD_OUT if ("name", name) in {(k, t[a:b]) for a, b, k in FIND(t)}]
    wrong = [t for t in NO_NAMES_HELD_OUT if any(k == "name" for _, _, k in FIND(t))]
    assert len(found) >= 0.7 * len(NAMES_HELD_OUT) and len(wrong) <= 2


@pytest.mark.parametrize("text,kind", [("Her CPF is 529.982.247-25.", "id_number"), ("Ref 529.982.247-26 is a file.", None), ("Aadhaar number: 2345 6789 0123", "id_number"), ("Scriva a Via Garibaldi 12, 20121 Milano.", "address"), ("Elle habite 1200 rue Sainte-Catherine Ouest, Montréal, QC H3B 1K9.", "address"), ("Keizersgracht 123, 1015 CJ Amsterdam", "address"), ("Rua das Flores, 45 - Centro, São Paulo - SP, 01234-567", "address")])
def test_forms_of_more_countries(text, kind):
    assert [k for _, _, k in FIND(text)] == ([kind] if kind else [])


def test_gender_comes_from_a_table():
    s = Surrogates(b"k")
    women = {n.casefold() for n in FEMALE | FEMALE_OTHER}
    for n in ("George", "Percy", "Larry", "Anthony", "Pierre", "Uwe"):
        assert s.word(n).casefold() in s.next and s.word(n).casefold() not in women, n
    for n in ("Karen", "Susan", "Helen", "Ruth", "Carmen", "Ingrid"):
        assert s.word(n).casefold() in women, n
    # no two given names share one, and none keeps its own
    assert len(set(map(str.casefold, s.next.values()))) == len(s.next) and all(k != v.casefold() for k, v in s.next.items())


@pytest.mark.parametrize("word,alphabet", [("Иванов", "Cyrillic"), ("Παπαδόπουλος", "Greek"), ("張偉", "Cjk"), ("さくら", "Hiragana"), ("タナカ", "Katakana"), ("김민수", "Hangul"), ("राहुल", "Devanagari"), ("محمد", "Arabic")])
def test_script_is_kept(word, alphabet):
    new = Surrogates(b"k").word(word)
    assert new != word and len(new) == len(word) and all(unicodedata.name(c).upper().startswith(alphabet.upper()) for c in new)


def test_one_entity_has_one_surrogate_in_all_texts():
    s = Surrogates(b"k")
    texts = ["Mr. George Smith moved.", "Regards, George Smith\nTel.: 030/23125229", "Signed: Smith, George", "George Smith and Karen Smith wrote; reach George Smith at george.smith@smithfamily.example."]
    pairs = [dict(zip([(k, t[a:b]) for a, b, k in FIND(t)], s.of(t, FIND(t)))) for t in texts]
    one = pairs[0]["name", "George Smith"]
    assert all(p.get(("name", "George Smith"), one) == one for p in pairs)
    first, last = one.split(" ")
    assert pairs[2]["name", "Smith, George"] == f"{last}, {first}"
    assert pairs[3]["name", "Karen Smith"].split(" ")[1] == last and pairs[3]["email", "george.smith@smithfamily.example"].startswith(f"{first}.{last}@".lower())
    assert "smith" not in pairs[3]["email", "george.smith@smithfamily.example"]
    many = {("phone", f"030/{i:08d}"): None for i in range(3000)}
    assert len(set(s.assign(many).values())) == 3000


def test_a_long_text_takes_linear_time():
    part = "My name is Nathan Fendunnow and my number is +1-415-555-0146. Nothing else happened that day. "
    times = []
    for n in (500, 2000):
        text = "".join(part.replace("Fendunnow", f"Fendunnow{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}") for i in range(n))
        began = time.perf_counter()
        places = FIND(text)
        Surrogates(b"k").replace(text, places)
        times.append(time.perf_counter() - began)
        assert len(places) == 2 * n
    assert times[1] < 10 * times[0] + 0.5
